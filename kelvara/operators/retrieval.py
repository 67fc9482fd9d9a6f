"""Index and search: TF-IDF postings as a table, dense vectors in blocks, hybrid ranking for a set of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelvara.config import SEARCH, Search
from kelvara.functions import text as T
from kelvara.session import by_key, cut_lineage, spread

KEY = ("parsed_id", "chunk_id")
#: Stated queries up to this number go to every task as blocks (about 1 KB each); beyond it Spark pairs the blocks of both sides.
SENT_QUERIES = 20_000


def term_counts(chunks: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """(keys, term, tf): words and word pairs. Counted map-side first."""
    return chunks.select(*keys, F.explode(T.terms(F.col("text"))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, most: int = SEARCH.vocabulary) -> DataFrame:
    """(term, df, ctf): the most frequent terms of the corpus, ties by term. At most `most` rows, by partial top-k."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf")).orderBy(F.desc("ctf"), "term").limit(most)


def idf(vocab: DataFrame, documents: DataFrame) -> DataFrame:
    """(term, df, ctf, idf): ln((1 + N) / (1 + df)) + 1, N the number of indexed texts."""
    # a condition on the text keeps its column, so that the texts are shuffled once for this and for the terms
    n = documents.agg(F.count_if(F.length("text") >= 0).alias("n"))
    return vocab.join(F.broadcast(n)).select("term", "df", "ctf", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def numbered(weights: DataFrame) -> DataFrame:
    """The weights with a number per term, `tid`, by frequency; at most the vocabulary cap of rows, so one partition may order them."""
    return weights.withColumn("tid", F.row_number().over(Window.orderBy(F.desc("ctf"), "term")))


def weighted(counts: DataFrame, weights: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, term, w): tf * idf, each text scaled to length 1. `weights` has at most the vocabulary cap of rows."""
    raw = counts.join(F.broadcast(weights.select("term", "idf")), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = raw.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, list(keys)).select(*keys, "term", (F.col("w") / F.col("norm")).alias("w"))


def lexical_scores(chunks: DataFrame, queries: DataFrame, settings: Search = SEARCH) -> DataFrame:
    """(query_id, keys, lexical): cosine of every chunk that shares a term with a query. The scores are summed map-side; a
    stored index (sources.stores) has the weighted postings ready."""
    counts = term_counts(chunks)
    weights = idf(vocabulary(counts, settings.vocabulary), chunks)
    postings = weighted(counts, weights, KEY)
    asked = queries.where(T.strip(F.col("query")) != "").select("query_id", F.explode(T.terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    terms = weighted(asked, weights, ("query_id",)).withColumnRenamed("w", "qw")
    return postings.join(terms, "term").groupBy("query_id", *KEY).agg(F.sum(F.col("w") * F.col("qw")).alias("lexical"))


def _packed(df: DataFrame, id_cols: list[str], vec_col: str, dims: int) -> DataFrame:
    """Rows packed into blocks, one per Arrow batch: (ids binary, mat binary), scaled to length 1. Unusable vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(len(id_cols))
            keep = np.flatnonzero(pa.compute.equal(pa.compute.list_value_length(vec), dims).fill_null(False).to_numpy(zero_copy_only=False))
            if not len(keep):
                continue
            x = np.asarray(pa.compute.list_flatten(vec.take(pa.array(keep))).to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
            norm = np.linalg.norm(x, axis=1)
            good = np.isfinite(norm) & (norm > 0)
            ids = np.stack([np.asarray(batch.column(i).take(pa.array(keep)).to_numpy(zero_copy_only=False), np.int64) for i in range(len(id_cols))], axis=1)[good]
            for at in range(0, len(ids), 2048):
                mat = x[good][at : at + 2048] / norm[good][at : at + 2048, None]
                yield pa.RecordBatch.from_arrays([pa.array([ids[at : at + 2048].tobytes()]), pa.array([mat.tobytes()])], names=["ids", "mat"])

    return df.where(F.col(vec_col).isNotNull()).select(*(F.col(c).cast("bigint") for c in id_cols), F.col(vec_col).cast("array<double>")).mapInArrow(run, "ids binary, mat binary")


def semantic_search(vectors: DataFrame, queries: DataFrame, k: int = SEARCH.top_k, dims: int = 64) -> DataFrame:
    """(query_id, vec_id, semantic): the k nearest vectors of every query by cosine (rounded to six places), ties by vec_id.

    A stated set of queries against all vectors, in blocks: a block of queries meets a block of vectors in one matrix product that
    keeps k candidates per query, and the candidates are merged per query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, v = (np.frombuffer(r[n], np.float64).reshape(-1, dims) for n in ("qmat", "mat"))
                qi, vi = (np.frombuffer(r[n], np.int64) for n in ("qids", "ids"))
                s = np.round(q @ v.T, 6) + 0.0
                order = np.lexsort((np.broadcast_to(vi, s.shape), -s), axis=1)[:, :k]
                rows = np.repeat(np.arange(len(qi)), order.shape[1])
                cols = order.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(qi[rows]), pa.array(vi[cols]), pa.array(s[rows, cols])], names=["query_id", "vec_id", "semantic"])

    n = queries.count()
    blocks = _packed(queries.repartition(max(1, -(-n // 512))), ["query_id"], "qvec", dims).select(F.col("ids").alias("qids"), F.col("mat").alias("qmat"))
    found = _packed(vectors, ["vec_id"], "vec", dims).join(F.broadcast(blocks) if n <= SENT_QUERIES else blocks).mapInArrow(run, "query_id bigint, vec_id bigint, semantic double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("semantic"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _directions(rows: DataFrame, keys: tuple[str, ...], vec_col: str, dims: int, unit: bool) -> DataFrame:
    """(keys, vec binary): the usable vectors as float64 bytes, scaled to length 1 if `unit`. Vectors that are null, all zero, not finite or of
    another size, and those with a null element, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(len(keys))
            keep = np.flatnonzero(pa.compute.equal(pa.compute.list_value_length(vec), dims).fill_null(False).to_numpy(zero_copy_only=False))
            if not len(keep):
                continue
            x = np.asarray(pa.compute.list_flatten(vec.take(pa.array(keep))).to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
            norm = np.linalg.norm(x, axis=1)
            good = np.isfinite(norm) & (norm > 0)
            x = x[good] / (norm[good][:, None] if unit else 1.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(keep[good])) for i in range(len(keys))), pa.array([v.tobytes() for v in x], pa.binary())], names=[*keys, "vec"])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return spread(rows.where(F.col(vec_col).isNotNull()).select(*keys, F.col(vec_col).cast("array<double>"))).mapInArrow(run, f"{kinds}, vec binary")


_SPARSE = "sizes binary, tids binary, ws binary"


def _sparse(column: pa.Array) -> dict[str, bytes]:
    """Lists of (tid, w) as the number of entries per row and their flat values."""
    entries = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pa.compute.list_flatten(column)
    return {"sizes": entries.tobytes(), "tids": flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), "ws": flat.field(1).to_numpy(zero_copy_only=False).astype(np.float64).tobytes()}


def _search_blocks(df: DataFrame, id_cols: tuple[str, ...], dims: int, size: int) -> DataFrame:
    """Rows (ids, vec binary or null, entries) as blocks: ids, vectors (zeros where there is none) and sparse term weights."""
    nothing = bytes(8 * dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                ids = np.stack([np.asarray(batch.column(i).to_numpy(zero_copy_only=False), np.int64) for i in range(len(id_cols))], axis=1)
                mat = b"".join(nothing if v is None else v for v in batch.column(len(id_cols)).to_pylist())
                yield pa.RecordBatch.from_pylist([{"ids": ids.tobytes(), "mat": mat} | _sparse(batch.column(len(id_cols) + 1))])

    columns = [*(F.col(c).cast("bigint").alias(c) for c in id_cols), "vec", "entries"]
    return df.select(*columns).mapInArrow(run, f"ids binary, mat binary, {_SPARSE}")


def _common_terms(q: dict, c: dict, nq: int, n: int) -> np.ndarray:
    """Dense product of two sparse blocks: for every posting of a chunk the queries that have its term."""
    qt, ct = np.frombuffer(q["qtids"], np.int64), np.frombuffer(c["tids"], np.int64)
    if not len(qt) or not len(ct):
        return np.zeros((nq, n))
    order = np.argsort(qt, kind="stable")
    qt, qw, qrow = qt[order], np.frombuffer(q["qws"])[order], np.repeat(np.arange(nq), np.frombuffer(q["qsizes"], np.int64))[order]
    crow, cw = np.repeat(np.arange(n), np.frombuffer(c["sizes"], np.int64)), np.frombuffer(c["ws"])
    lo, hi = np.searchsorted(qt, ct, "left"), np.searchsorted(qt, ct, "right")
    many = hi - lo
    post = np.repeat(np.arange(len(ct)), many)
    hit = np.arange(len(post)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    return np.bincount(qrow[hit] * n + crow[post], weights=qw[hit] * cw[post], minlength=nq * n).reshape(nq, n)


def search(chunks: DataFrame, vectors: DataFrame | None, queries: DataFrame, settings: Search = SEARCH, dims: int = 64) -> DataFrame:
    """(query_id, rank, keys, lexical, semantic, score): the top_k chunks of every query over all chunks, by the weighted sum of both scores.

    lexical is 0 without a common term, semantic 0 without a vector and the best of several; only scores of at least min_score (rounded to
    six places) count, ties go by key. Blank and null queries, and an index without chunks, give no row. `vectors` None: lexical alone.

    The text is shuffled once, by key; term counts, norms and the asked terms of a chunk then need no further shuffle. A block of chunks
    meets a block of the stated queries in one matrix product and one sparse product, of which only top_k per query leave the task.
    """
    base = by_key(chunks.select(*KEY, "text"), *KEY)
    counts = term_counts(base)
    weights = idf(vocabulary(counts, settings.vocabulary), base)
    # at most settings.vocabulary rows; written once, as both sides of the search read them
    weights = cut_lineage(numbered(weights).select("term", "idf", "tid"))
    asked = queries.where(T.strip(F.col("query")) != "")
    asked_terms = asked.select("query_id", F.explode(T.terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    entries, q = _term_lists(counts, weights, asked_terms)
    return _ranked_blocks(entries, chunks, vectors, asked.join(q, "query_id", "left"), settings, dims)


def search_index(index: dict[str, DataFrame], vectors: DataFrame | None, queries: DataFrame, settings: Search = SEARCH, dims: int = 64) -> DataFrame:
    """`search` over a stored index (sources.stores): postings hold the weights already, and only those of asked terms are read."""
    weights = index["vocabulary"].select("term", "idf", "tid")
    asked = queries.where(T.strip(F.col("query")) != "")
    asked_terms = asked.select("query_id", F.explode(T.terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    # asked terms of the vocabulary, at most its cap
    some = weights.join(asked_terms.select("term").distinct(), "term", "left_semi").select("term", "tid")
    found = index["postings"].join(F.broadcast(some), "term").groupBy(*KEY).agg(F.collect_list(F.struct("tid", "w")).alias("entries"))
    return _ranked_blocks(found, index["chunks"], vectors, asked.join(_query_lists(asked_terms, weights), "query_id", "left"), settings, dims)


def _query_lists(asked_terms: DataFrame, weights: DataFrame) -> DataFrame:
    raw = asked_terms.join(F.broadcast(weights), "term").select("query_id", "tid", (F.col("tf") * F.col("idf")).alias("w"))
    per = raw.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("tid", "w")).alias("e"))
    return per.select("query_id", F.transform("e", lambda x: F.struct(x["tid"].alias("tid"), (x["w"] / F.col("norm")).alias("w"))).alias("entries"))


def _term_lists(counts: DataFrame, weights: DataFrame, asked_terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys, entries) of the chunks, with the asked terms alone, and (query_id, entries); each text scaled to length 1 over all its terms."""
    marked = weights.join(asked_terms.select("term").distinct().withColumn("asked", F.lit(True)), "term", "left")
    raw = counts.join(F.broadcast(marked), "term").select(*KEY, "tid", "asked", (F.col("tf") * F.col("idf")).alias("w"))
    per = raw.groupBy(*KEY).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("asked"), F.struct("tid", "w"))).alias("e"))
    lists = per.where(F.size("e") > 0).select(*KEY, F.transform("e", lambda x: F.struct(x["tid"].alias("tid"), (x["w"] / F.col("norm")).alias("w"))).alias("entries"))
    return lists, _query_lists(asked_terms, weights)


def _ranked_blocks(entries: DataFrame, chunks: DataFrame, vectors: DataFrame | None, asked: DataFrame, settings: Search, dims: int) -> DataFrame:
    k, semantic_weight, lexical_weight, least = settings.top_k, settings.semantic_weight, settings.lexical_weight, settings.min_score
    if vectors is None:
        semantic_weight, lexical_weight = 0.0, 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, v = (np.frombuffer(r[n], np.float64).reshape(-1, dims) for n in ("qmat", "mat"))
                qi, ids = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["ids"], np.int64).reshape(-1, 2)
                by_key = np.lexsort((ids[:, 1], ids[:, 0]))
                keys, first = np.unique(ids[by_key], axis=0, return_index=True)
                # the columns are in the order of the keys, so a stable sort breaks ties by key
                dense = np.maximum.reduceat((q @ v.T)[:, by_key], first, axis=1)
                common = np.maximum.reduceat(_common_terms(r, r, len(q), len(v))[:, by_key], first, axis=1)
                s = np.round(semantic_weight * dense + lexical_weight * common + 1e-9, 6)
                order = np.argsort(-s, axis=1, kind="stable")[:, :k]
                rows, cols = np.repeat(np.arange(len(s)), order.shape[1]), order.ravel()
                fit = s[rows, cols] >= least
                rows, cols = rows[fit], cols[fit]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qi[rows], keys[cols, 0], keys[cols, 1], common[rows, cols], dense[rows, cols], s[rows, cols])], names=["query_id", *KEY, "lexical", "semantic", "score"])

    nothing = F.lit(None).cast("binary").alias("vec")
    if vectors is None:
        rows, asked = entries.select(*KEY, nothing, "entries"), asked.select("query_id", nothing, "entries")
    else:
        unit = _directions(vectors, KEY, "vec", dims, True).join(chunks.select(*KEY).distinct(), list(KEY), "left_semi")
        # vectors with the terms of their chunk, and chunks without a vector; either join can be split at a skewed key
        rows = unit.join(entries, list(KEY), "left").select(*KEY, "vec", "entries").unionByName(
            entries.join(unit.select(*KEY), list(KEY), "left_anti").select(*KEY, nothing, "entries")
        )
        asked = asked.join(_directions(asked, ("query_id",), "qvec", dims, False), "query_id", "left").select("query_id", "vec", "entries")
    n = asked.count()
    blocks = _search_blocks(asked.repartition(max(1, -(-n // 512))), ("query_id",), dims, 512)
    blocks = blocks.select(*(F.col(c).alias(f"q{c}") for c in blocks.columns))
    met = _search_blocks(rows, KEY, dims, 2048).join(F.broadcast(blocks) if n <= SENT_QUERIES else blocks)
    found = met.mapInArrow(run, "query_id bigint, parsed_id bigint, chunk_id bigint, lexical double, semantic double, score double")
    best = found.groupBy("query_id", *KEY).agg(*(F.max(c).alias(c) for c in ("lexical", "semantic", "score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *KEY)
    kept = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    kinds = {c: chunks.schema[c].dataType for c in KEY}
    return kept.select("query_id", "rank", *(F.col(c).cast(t).alias(c) for c, t in kinds.items()), "lexical", "semantic", "score")


def ranked(scores: DataFrame, score: str, settings: Search = SEARCH, keys: tuple[str, ...] = KEY) -> DataFrame:
    """The best rows of every query above the threshold, by score (six places) and key; the limit applies before the shuffle."""
    kept = scores.withColumn(score, T.rounded(F.col(score))).where(F.col(score) >= settings.min_score)
    order = Window.partitionBy("query_id").orderBy(F.desc(score), *keys)
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.top_k)
