"""Nearest vectors for every vector, and all pairs above a cosine (problem 6).

Block matrix join. Usable vectors are scaled to length 1, equal ones form one class, and every class goes to the
cell of its nearest centroid and, as a query, to each cell that it probes: one shuffle brings the rows of a cell
together. There a block of queries and a block of the index are first multiplied in int8; the quantisation error of
both sides bounds every product, and only pairs that can still matter are recomputed from the float vectors. A task
keeps the k best per row of each cell; a row's lists from its cells are merged at the end.

The number of cells grows with the rows, so work grows with the rows times the rows of the probed cells, not with
the square of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelvara.session import by_key, cut_lineage

BLOCK = 1024
#: Queries of a cell that meet its blocks at a time.
QUERY_BLOCK = 4096
#: Rows per cell aimed at, and how many times that makes a cell hot, so that it is cut into parts.
CELL_ROWS, HOT_CELLS = 2000, 8
#: Centroids of one codebook, at most; where more cells are needed, two codebooks over the halves of the vectors make them.
MOST_CENTROIDS = 1024
#: Vectors from which the centroids are fitted, at most; every vector is indexed.
FIT_ROWS = 32_768
FIT_ROUNDS = 12
#: Centroids near a row that judge whether another cell can hold a close vector.
NEAR_CENTROIDS = 24
#: Rows of a class of equal vectors that are spelt out together.
CLASS_BLOCK = 1024
#: Share of the neighbours within the sample that the number of probes is chosen for.
RECALL = 0.97


def usable_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    """(id bigint, unit binary): float32 vectors of length 1. Null, all-zero, non-finite and wrongly sized vectors, vectors
    with a null element and rows without an id take no part. Zeros are made positive, so that equal vectors have
    equal bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(1)
            keep = np.flatnonzero(pa.compute.equal(pa.compute.list_value_length(vec), dims).fill_null(False).to_numpy(zero_copy_only=False))
            if not len(keep):
                continue
            flat = pa.compute.list_flatten(vec.take(pa.array(keep)))
            x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(keep), dims)
            with np.errstate(all="ignore"):
                norm = np.linalg.norm(x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300), axis=1) * np.abs(x).max(axis=1)
                good = np.isfinite(norm) & (norm > 0) & np.isfinite(x).all(axis=1)
                unit = (x[good] / norm[good][:, None] + 0.0).astype(np.float32) + np.float32(0)
            ids = batch.column(0).take(pa.array(keep[good]))
            yield pa.RecordBatch.from_arrays([ids, _rows(unit)], names=["id", "unit"])

    source = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
    return source.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>")).mapInArrow(run, "id bigint, unit binary")


def _rows(x: np.ndarray) -> pa.Array:
    """A matrix as one binary per row."""
    width = x.shape[1] * x.itemsize
    offsets = pa.py_buffer(np.arange(0, (len(x) + 1) * width, width, dtype=np.int32)[: len(x) + 1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(np.ascontiguousarray(x))])


class Cells:
    """The cells: one codebook over the whole vectors, or two over their halves, whose pairs of centroids are the cells. With halves, k centroids
    each give k * k cells, so cells grow with the rows although the codebooks are fitted on a bounded sample."""

    def __init__(self, books: list[np.ndarray], dims: int):
        self.books, self.cuts = books, [slice(0, dims)] if len(books) == 1 else [slice(0, dims // 2), slice(dims // 2, dims)]
        self.count = math.prod(len(c) for c in books)

    def scores(self, x: np.ndarray) -> list[np.ndarray]:
        """Per codebook, how near each centroid is: largest for the nearest."""
        return [x[:, cut] @ c.T - 0.5 * (c * c).sum(axis=1) for cut, c in zip(self.cuts, self.books)]

    def _joined(self, places: list[np.ndarray]) -> np.ndarray:
        return places[0].astype(np.int64) if len(places) == 1 else places[0].astype(np.int64) * len(self.books[1]) + places[1]

    def home(self, scores: list[np.ndarray]) -> np.ndarray:
        return self._joined([s.argmax(axis=1) for s in scores])

    def nearest(self, scores: list[np.ndarray], probes: int) -> list[np.ndarray]:
        """The cells of the `probes` nearest centroids, or pairs of them, of every row."""
        tops = [np.argsort(-s, axis=1, kind="stable")[:, : min(probes, s.shape[1])] for s in scores]
        if len(tops) == 1:
            return list(tops[0].astype(np.int64))
        left, right = (np.take_along_axis(s, t, axis=1) for s, t in zip(scores, tops))
        both = (left[:, :, None] + right[:, None, :]).reshape(len(left), -1)
        pick = np.argsort(-both, axis=1, kind="stable")[:, : min(probes, both.shape[1])]
        width = right.shape[1]
        return list(self._joined([np.take_along_axis(tops[0], pick // width, axis=1), np.take_along_axis(tops[1], pick % width, axis=1)]))

    def within(self, scores: list[np.ndarray], cosine: float) -> list[np.ndarray]:
        """The cells that can hold a vector of at least this cosine to a row. With |u - v| <= d and v in the cell of a: v is no nearer to any b
        than to a, so f(u, b) - f(u, a) <= d |b - a| for every b, where f is the score; it is asked of the row's nearest centroids, which
        say most. No such pair is missed."""
        d = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-4
        fit = []
        for s, c in zip(scores, self.books):
            norm = (c * c).sum(axis=1)
            apart = np.sqrt(np.maximum(0, norm[:, None] + norm[None, :] - 2 * c @ c.T))
            near = np.argpartition(-s, min(NEAR_CENTROIDS, s.shape[1]) - 1, axis=1)[:, :NEAR_CENTROIDS]
            can = s.max(axis=1, keepdims=True) - s <= d * apart[s.argmax(axis=1)] + 1e-4
            row, cell = np.nonzero(can)
            most = (np.take_along_axis(s, near, axis=1)[row] - s[row, cell][:, None] - d * apart[cell[:, None], near[row]]).max(axis=1)
            can[row, cell] = most <= 1e-4
            fit.append(can)
        if len(fit) == 1:
            return [np.flatnonzero(r) for r in fit[0]]
        return [(np.flatnonzero(x)[:, None] * len(self.books[1]) + np.flatnonzero(y)[None, :]).ravel() for x, y in zip(*fit)]


def _codebook(x: np.ndarray, k: int) -> np.ndarray:
    """k-means, seeded by squared distance so that every region of the sample gets a centroid."""
    rng, size = np.random.default_rng(7), (x * x).sum(axis=1)
    seeds, near = [0], np.full(len(x), np.inf)
    while len(seeds) < k:
        last = x[seeds[-1]]
        near = np.minimum(near, np.maximum(0, size + last @ last - 2 * x @ last))
        total = near.sum()
        seeds.append(int(min(np.searchsorted(np.cumsum(near), rng.random() * total), len(x) - 1)) if total > 0 else len(seeds))
    c = x[np.minimum(seeds, len(x) - 1)].copy()
    for _ in range(FIT_ROUNDS):
        home = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        n = np.bincount(home, minlength=len(c))[:, None]
        c = np.where(n > 0, total / np.maximum(n, 1), c).astype(np.float32)
    return c


def _fit(reps: DataFrame, dims: int) -> tuple[Cells, np.ndarray]:
    """Cells of about CELL_ROWS rows, and the sample (the smallest hashes of the ids, at most FIT_ROWS) that their codebooks are fitted on."""
    n = reps.count()
    sample = reps.select(F.xxhash64("id").alias("h"), "unit").orderBy("h").limit(FIT_ROWS).collect()
    if not sample:
        return Cells([np.zeros((1, dims), np.float32)], dims), np.zeros((0, dims), np.float32)
    x = np.frombuffer(b"".join(bytes(r.unit) for r in sample), np.float32).reshape(-1, dims)
    k = max(1, min(math.ceil(n / CELL_ROWS), len(x)))
    if k <= MOST_CENTROIDS or dims < 2:
        return Cells([_codebook(x, k)], dims), x
    k = min(math.ceil(math.sqrt(n / CELL_ROWS)), MOST_CENTROIDS)
    return Cells([_codebook(x[:, : dims // 2], k), _codebook(x[:, dims // 2 :], k)], dims), x


def _probes_for(cells: Cells, sample: np.ndarray, k: int, target: float) -> int:
    """The fewest probes with which `target` of the k nearest within the sample are found, measured over a part of it. The whole data lie closer than
    the sample, so their recall is rather higher."""
    asked = sample[:: max(1, len(sample) // 512)]
    if cells.count == 1 or len(sample) <= k:
        return 1
    cos = asked @ sample.T
    cos[np.arange(len(asked)), np.arange(0, len(sample), max(1, len(sample) // 512))[: len(asked)]] = -2
    best = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    home = cells.home(cells.scores(sample))
    scores = cells.scores(asked)
    probes = 2
    while probes < cells.count:
        probed = cells.nearest(scores, probes)
        if np.mean([np.isin(home[b], p).mean() for b, p in zip(best, probed)]) >= target:
            break
        probes = math.ceil(probes * 1.5)
    return min(probes, cells.count)


def _met(reps: DataFrame, cells: Cells, targets, dims: int) -> DataFrame:
    """(cell, part, asks, id, unit): every row in its own cell, and as a query in every cell that it probes; the rows of a cell together, those of the
    index first. A cell of more than HOT_CELLS times the usual rows is cut into parts, and its queries go to all of them."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, dims)
            scores = cells.scores(x)
            probed = targets(scores)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in probed])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(probed) if len(probed) else np.zeros(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells.home(scores), pa.int64()), lists], names=["id", "unit", "home", "probed"])

    placed = reps.select("id", "unit").mapInArrow(assign, "id bigint, unit binary, home bigint, probed array<bigint>")
    most = HOT_CELLS * CELL_ROWS
    hot = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("cell", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    hot = cut_lineage(hot)
    index = placed.select("id", "unit", F.col("home").alias("cell"), F.lit(False).alias("asks"))
    asked = placed.select("id", "unit", F.explode("probed").alias("cell"), F.lit(True).alias("asks"))
    # hot cells are few: sent along where their number allows, so that the rows aren't shuffled for them
    rows = index.unionByName(asked).join(sent(hot), "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    each = rows.withColumn("part", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)))
    return by_key(each.select("cell", "part", "asks", "id", "unit"), "cell", "part").sortWithinPartitions("cell", "part", "asks", "id")


class _Side:
    """Some rows of a cell: ids, int8 codes with their scale and error, and the float vectors."""

    def __init__(self, row: dict, dims: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.x = np.frombuffer(row["mat"], np.float32).reshape(-1, dims) if "mat" in row else None
        self.scale = np.frombuffer(row["scale"], np.float32)
        self.err = np.frombuffer(row["err"], np.float32)
        # int8 values held in float32: their products and sums stay below 2^24, so the BLAS product is exact
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(-1, dims).astype(np.float32)

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray) -> _Side:
        scale = np.maximum(np.abs(x).max(axis=1), 1e-12) / 127
        codes = np.rint(x / scale[:, None]).astype(np.int8)
        err = np.linalg.norm(x - codes * scale[:, None], axis=1).astype(np.float32)
        return cls({"ids": ids.tobytes(), "mat": x.tobytes(), "codes": codes.tobytes(), "scale": scale.astype(np.float32).tobytes(), "err": err.tobytes()}, x.shape[1])


def _tile(q: _Side, s: _Side) -> tuple[np.ndarray, np.ndarray]:
    """Approximate cosines of a tile, and the bound on their error for every pair."""
    approx = (q.codes @ s.codes.T) * q.scale[:, None] * s.scale[None, :]
    bound = q.err[:, None] * 1.001 + (1.001 + q.err[:, None]) * s.err[None, :] + 1e-5
    return approx, bound


def _exact(q: _Side, s: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", q.x[i].astype(np.float64), s.x[j].astype(np.float64))


def _tiles(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[_Side, list[_Side]]]:
    """From the sorted rows of `_met`: queries of a cell, up to QUERY_BLOCK at a time, each with the blocks of the cell's index."""
    at, index, ids, mats = None, [], [], []
    asked, asked_mats = [], []

    def flush() -> Iterator[tuple[_Side, list[_Side]]]:
        nonlocal asked, asked_mats
        if asked and index:
            yield _Side.of(np.concatenate(asked), np.concatenate(asked_mats)), index
        asked, asked_mats = [], []

    def close() -> None:
        nonlocal index, ids, mats
        if ids:
            every, x = np.concatenate(ids), np.concatenate(mats)
            index = [_Side.of(every[k : k + BLOCK], x[k : k + BLOCK]) for k in range(0, len(every), BLOCK)]
            ids, mats = [], []

    for batch in batches:
        cell, part, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        own = batch.column(3).to_numpy(zero_copy_only=False)
        x = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float32).reshape(-1, dims)
        cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)]):
            if lo == hi:
                continue
            key = (cell[lo], part[lo])
            if key != at:
                yield from flush()
                at, index, ids, mats = key, [], [], []
            if not asks[lo]:
                ids.append(own[lo:hi])
                mats.append(x[lo:hi])
                continue
            close()
            for k in range(lo, hi, QUERY_BLOCK):
                if sum(map(len, asked)) + min(hi, k + QUERY_BLOCK) - k > QUERY_BLOCK:
                    yield from flush()
                asked.append(own[k : min(hi, k + QUERY_BLOCK)])
                asked_mats.append(x[k : min(hi, k + QUERY_BLOCK)])
    yield from flush()


#: Rows up to which a side of a join is sent to all tasks; a row is at most a vector and some numbers.
SENT_ROWS = 20_000


def sent(df: DataFrame) -> DataFrame:
    """`df`, which must be stable, marked for broadcast if it has at most SENT_ROWS rows; counted first."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, unit, n): one row per distinct vector with the smallest id that has it and its rows; and (rep, id): the ids of the classes of several rows.
    Partial aggregation before the shuffle."""
    reps = cut_lineage(vectors.groupBy("unit").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "unit", "n"))
    several = reps.where("n > 1").select("unit", F.col("id").alias("rep"))
    return reps, cut_lineage(vectors.join(sent(several), "unit").select("rep", "id").distinct())


def _links(reps: DataFrame, cosine: float, dims: int) -> DataFrame:
    """(a, b): pairs of different classes, a < b, with at least this cosine."""
    cells, _ = _fit(reps, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, index in _tiles(batches, dims):
            for side in index:
                approx, bound = _tile(q, side)
                i, j = np.nonzero(approx >= cosine - bound)
                # either row of a pair probes the other's cell; the smaller id reports it
                lower = q.ids[i] < side.ids[j]
                i, j = i[lower], j[lower]
                hit = _exact(q, side, i, j) >= cosine
                yield pa.RecordBatch.from_arrays([pa.array(q.ids[i[hit]]), pa.array(side.ids[j[hit]])], names=["a", "b"])

    return _met(reps, cells, lambda scores: cells.within(scores, cosine), dims).mapInArrow(run, "a bigint, b bigint")


def pairs_above(df: DataFrame, id_col: str = "vec_id", vec_col: str = "vec", cosine: float = 0.95, dims: int = 64) -> DataFrame:
    """(vec_lo, vec_hi): every pair of rows, smaller id first, whose cosine is at least `cosine`; exact.

    Unusable vectors (see usable_vectors) take no part. Equal vectors are compared once and expanded at the end, in blocks of a class,
    so that no key holds a large class. Rows repeated under one id count as one vector each but a pair needs two different ids. An empty
    table gives no rows; other columns are left out.
    """
    reps, several = _classes(usable_vectors(df, id_col, vec_col, dims))
    sizes = several.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep", F.ceil(F.col("n") / CLASS_BLOCK).cast("int").alias("parts"))
    sizes = cut_lineage(sizes)
    links = _links(reps, cosine, dims).unionByName(sizes.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    blocks = (
        several.join(sent(sizes), "rep").groupBy("rep", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")).agg(F.collect_list("id").alias("ids"))
    )
    for side in ("a", "b"):
        links = links.join(sent(sizes).withColumnRenamed("rep", side), side, "left").withColumn(f"p{side}", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    for side, held in (("a", "xs"), ("b", "ys")):
        # a class of one row is its own block
        links = links.join(blocks.select(F.col("rep").alias(side), F.col("part").alias(f"p{side}"), F.col("ids").alias(held)), [side, f"p{side}"], "left").withColumn(held, F.coalesce(held, F.array(side)))
    each = links.select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y")).where("x <> y")
    return each.select(F.least("x", "y").alias("vec_lo"), F.greatest("x", "y").alias("vec_hi")).distinct()


def classes_above(df: DataFrame, id_col: str = "vec_id", vec_col: str = "vec", cosine: float = 0.95, dims: int = 64) -> DataFrame:
    """(vec_id, class_id, class_size, links): every usable row with its class of equal vectors (the smallest id among them), the class's rows, and the
    number of other classes that have at least this cosine to it. The same relation as `pairs_above` without the pairs within and between
    classes spelt out. Unusable vectors and empty tables give no rows."""
    reps, several = _classes(usable_vectors(df, id_col, vec_col, dims))
    ends = _links(reps, cosine, dims).select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    members = reps.where("n = 1").select(F.col("id").alias("rep"), "id").unionByName(several)
    sizes = reps.select(F.col("id").alias("rep"), F.col("n").alias("class_size")).join(ends, "rep", "left")
    return members.join(sizes, "rep").select(F.col("id").alias("vec_id"), F.col("rep").alias("class_id"), "class_size", F.coalesce("links", F.lit(0)).alias("links"))


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "vec", k: int = 10, probes: int | None = None, dims: int = 64, target: float = RECALL) -> DataFrame:
    """(vec_id, rank, neighbour_id, cosine): the k nearest other vectors of every usable vector, cosine descending,
    ties by smaller id.

    Approximate in one respect only: a row is compared with the vectors of its `probes` nearest cells; without a number as many as find
    `target` of the neighbours within the fitting sample. Fewer than k other vectors give fewer rows. Equal vectors are neighbours at
    cosine 1. Unusable vectors and empty tables give no rows; other columns are left out.
    """
    reps, several = _classes(usable_vectors(df, id_col, vec_col, dims))
    cells, sample = _fit(reps, dims)
    probes = probes or _probes_for(cells, sample, k, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, index in _tiles(batches, dims):
            best = np.full((len(q.ids), k), -np.inf)
            best_id = np.zeros((len(q.ids), k), np.int64)
            for side in index:
                approx, bound = _tile(q, side)
                approx[q.ids[:, None] == side.ids[None, :]] = -4
                floor = best[:, -1]
                if side.ids.size > k:
                    # the k-th best of the tile is at least its k-th best lower bound
                    floor = np.maximum(floor, np.partition(approx - bound, -k, axis=1)[:, -k])
                i, j = np.nonzero(approx + bound >= floor[:, None].astype(np.float32) - 1e-6)
                keep = approx[i, j] > -3
                i, j = i[keep], j[keep]
                cos = _exact(q, side, i, j)
                rows = np.concatenate([np.repeat(np.arange(len(q.ids)), k), i])
                cand = np.concatenate([best.ravel(), cos])
                cid = np.concatenate([best_id.ravel(), side.ids[j]])
                order = np.lexsort((cid, -cand, rows))
                rows = rows[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                top = place < k
                best = cand[order][top].reshape(-1, k)
                best_id = cid[order][top].reshape(-1, k)
            # one row per query and cell: the filled places of its list
            filled = np.isfinite(best)
            offsets = pa.array(np.concatenate([[0], np.cumsum(filled.sum(axis=1))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v[filled])) for v in (best_id, best)]
            yield pa.RecordBatch.from_arrays([pa.array(q.ids), *lists], names=["rep", "others", "cosines"])

    met = _met(reps, cells, lambda scores: cells.nearest(scores, probes), dims)
    found = by_key(met.mapInArrow(run, "rep bigint, others array<bigint>, cosines array<double>").where(F.size("others") > 0), "rep")
    # merged where they meet: a list per cell travels, and the k best per row are kept before anything else is joined
    order = Window.partitionBy("rep").orderBy(F.desc("cosine"), "other")
    links = found.select("rep", F.explode(F.arrays_zip("others", "cosines")).alias("o")).select("rep", F.col("o.others").alias("other"), F.col("o.cosines").alias("cosine"))
    links = links.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("rep", "other", "cosine")
    # the first k + 1 ids of a class are all that any list can need of it; the window limit applies before the shuffle
    heads = several.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1)
    heads = cut_lineage(heads.select(F.col("rep").alias("other"), "id"))
    own = heads.select(F.col("other").alias("rep"), "id", F.lit(1.0).alias("cosine"))
    # most classes have one row, their representative; the further ids of the others are joined
    further = links.join(sent(heads.where("id <> other")), "other").select("rep", "id", "cosine")
    spelled = links.select("rep", F.col("other").alias("id"), "cosine").unionByName(further).unionByName(own)
    order = Window.partitionBy("rep").orderBy(F.desc("cosine"), "id")
    lists = (
        spelled.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
        .groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("r", "id", "cosine"))).alias("list"))
    )
    # the rows of a class share its list; a class of one row is its representative
    mine = lists.join(several, "rep", "left").select(F.coalesce("id", "rep").alias("me"), "list")
    mine = mine.select("me", F.posexplode(F.slice(F.filter("list", lambda x: x["id"] != F.col("me")), 1, k)).alias("p", "n"))
    return mine.select(F.col("me").alias("vec_id"), (F.col("p") + 1).alias("rank"), F.col("n.id").alias("neighbour_id"), F.col("n.cosine").alias("cosine"))
