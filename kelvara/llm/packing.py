"""Packing of texts into containers of fixed capacity (problem 9).

Hierarchical residual packing. Each partition packs its own items best-fit decreasing, buffer by buffer: bins that
are nearly full are final, underfull ones go into the next buffer as items. What is still underfull at the end of
a partition travels upwards: groups of `FAN_IN` partitions merge their underfull bins, again best-fit decreasing,
until one group is left. Only bin identifiers and fills travel; the items themselves are written once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvara.session import cut_lineage

#: Items packed together inside a partition; bounds a task's memory.
BUFFER = 100_000
#: A bin of at least this fill is final.
FULL = 0.985
#: Partitions merged by one task of the tree.
FAN_IN = 16
#: Underfull bins that a partition or group offers upwards. At most one of its bins is half empty (two would have
#: been merged), so at most one per partition can move into another's bin; the rest are final as they are.
OFFER = 64
_PART_BITS = 40


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of every item, best-fit decreasing. Bins are kept by residual and the residuals in use in the
    bits of one integer, so the tightest bin is found by a shift and a lowest-bit operation."""
    out = np.empty(len(sizes), np.int64)
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, bins = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        above = used >> size
        if above:
            residual = size + (above & -above).bit_length() - 1
            bin_ = by_residual[residual].pop()
            if not by_residual[residual]:
                used &= ~(1 << residual)
        else:
            residual, bin_ = capacity, bins
            bins += 1
        out[i] = bin_
        residual -= size
        by_residual[residual].append(bin_)
        used |= 1 << residual
    return out


def _pieces(ids: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Items of at most `capacity`: an item above it becomes full pieces and a rest, anything else stays whole."""
    n = np.maximum(1, -(-sizes // capacity))
    row = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(capacity, sizes[row] - piece * capacity)
    return row, piece, size


def pack(items: DataFrame, id_col: str = "doc_id", size_col: str = "size", capacity: int = 2048) -> DataFrame:
    """(id_col, piece_no int, start bigint, size bigint, container_id bigint): every item once, in containers whose
    sizes add up to at most `capacity`.

    An item above the capacity comes as pieces [start, start + size); every other item has the one piece 0. Items
    of size 0 go into containers too, and a null or negative size counts as 0. Repeated ids are packed as separate
    items, a null id stays null, an empty input gives no rows, and other columns are left out. Container ids are
    stable once computed (the local assignment is checkpointed) but carry no meaning.
    """
    id_type = items.schema[id_col].dataType.simpleString()
    full = int(np.ceil(capacity * FULL))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << _PART_BITS, 0
        open_rows: list[tuple] = []
        waiting: list[tuple] = []
        pending = 0

        def emit(ids, piece, start, size, bin_, is_open):
            arrays = [ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(bin_, pa.int64()), pa.array(is_open, pa.bool_())]
            return pa.RecordBatch.from_arrays(arrays, names=[id_col, "piece_no", "start", "size", "bin", "open"])

        def flush(last: bool):
            nonlocal count, waiting, pending, open_rows
            new = [(pa.concat_arrays([w[0] for w in waiting]), *(np.concatenate([w[k] for w in waiting]) for k in (1, 2, 3)))] if waiting else []
            waiting, pending = [], 0
            # underfull bins of earlier buffers are items of this one
            carried = open_rows
            open_rows = []
            sizes = np.concatenate([np.array([c[4] for c in carried], np.int64), *(x[3] for x in new)]) if carried or new else np.zeros(0, np.int64)
            if not len(sizes):
                return
            bin_of = best_fit(sizes, capacity)
            fill = np.bincount(bin_of, weights=sizes).astype(np.int64)
            final = fill >= full
            if last:
                # the emptiest bins are offered upwards, the others are final
                final |= np.argsort(np.argsort(fill, kind="stable"), kind="stable") >= OFFER
            name = base + count + np.arange(len(fill))
            count += len(fill)
            rows = []
            for (ids, piece, start, size, _), b in zip(carried, bin_of[: len(carried)]):
                rows.append((ids, piece, start, size, np.full(len(size), b)))
            if new:
                rows.append((*new[0], bin_of[len(carried) :]))
            held: dict[int, list] = {}
            for ids, piece, start, size, b in rows:
                done = final[b] | last
                if done.any():
                    k = np.flatnonzero(done)
                    yield emit(ids.take(pa.array(k)), piece[k], start[k], size[k], name[b[k]], ~final[b[k]])
                for k in np.flatnonzero(~done).tolist():
                    held.setdefault(int(b[k]), []).append((ids, piece, start, size, k))
            for b, members in held.items():
                ids = pa.concat_arrays([m[0].slice(m[4], 1) for m in members])
                piece, start, size = (np.array([m[j][m[4]] for m in members], np.int64) for j in (1, 2, 3))
                open_rows.append((ids, piece, start, size, int(fill[b])))

        for batch in batches:
            sizes = np.maximum(0, np.asarray(pa.compute.fill_null(batch.column(1), 0).to_numpy(zero_copy_only=False), np.int64))
            row, piece, size = _pieces(batch.column(0), sizes, capacity)
            waiting.append((batch.column(0).take(pa.array(row)), piece, piece * capacity, size))
            pending += len(row)
            if pending >= BUFFER:
                yield from flush(False)
        yield from flush(True)

    fields = f"`{id_col}` {id_type}, piece_no int, start bigint, size bigint"
    placed = cut_lineage(items.select(F.col(id_col), F.col(size_col).cast("bigint")).mapInArrow(local, f"{fields}, bin bigint, open boolean"))
    merged = _merge_tree(placed.where("open").groupBy("bin").agg(F.sum("size").alias("fill")), capacity, full)
    columns = [F.col(id_col), "piece_no", "start", "size"]
    return placed.where("not open").select(*columns, F.col("bin").alias("container_id")).unionByName(
        placed.where("open").join(merged, "bin").select(*columns, "container_id")
    )


def _merge_tree(bins: DataFrame, capacity: int, full: int) -> DataFrame:
    """(bin, container_id) for every underfull bin, by rounds of best fit over ever larger groups of partitions."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        fill = pdf.groupby("current", sort=True)["fill"].sum()
        place = best_fit(fill.to_numpy(np.int64), capacity)
        total = np.bincount(place, weights=fill.to_numpy()).astype(np.int64)
        final = (total >= full) | (np.argsort(np.argsort(total, kind="stable"), kind="stable") >= OFFER)
        first = pd.Series(fill.index.to_numpy()).groupby(place).min().to_numpy()
        at = pd.Series(place, index=fill.index).loc[pdf["current"]].to_numpy()
        return pdf.assign(current=first[at], final=final[at])[["bin", "current", "fill", "final"]]

    schema = "bin bigint, current bigint, fill bigint, final boolean"
    state = cut_lineage(bins.select("bin", F.col("bin").alias("current"), "fill", F.lit(False).alias("final")))
    parts = (state.agg(F.max(F.shiftright("bin", _PART_BITS))).first()[0] or 0) + 1
    done, width = [], FAN_IN
    while True:
        group = F.floor(F.shiftright("bin", _PART_BITS) / width)
        state = cut_lineage(state.where("not final").groupBy(group.alias("g")).applyInPandas(merge, schema))
        done.append(state)
        if width >= parts:
            break
        width *= FAN_IN
    out = done[-1].select("bin", F.col("current").alias("container_id"))
    for level in done[:-1]:
        out = out.unionByName(level.where("final").select("bin", F.col("current").alias("container_id")))
    return out


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens and the share of the capacity in use (null without containers)."""
    per = packed.groupBy("container_id").agg(F.sum("size").alias("used"))
    return per.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.max("used").alias("fullest"),
        F.try_divide(F.sum("used").cast("double"), F.count("*") * F.lit(float(capacity))).alias("fill"),
    )
