"""Cutting oversized items into pieces at natural boundaries (problem 4).

Agglomerative merging: an item is taken apart into atomic segments, and a heap holds the boundaries between
neighbours. The weakest boundary is merged first (a gap between words before a comma, a comma before a sentence end, a
sentence end before a line break), among equals the one whose merged segment is smallest, as long as the segment and
the overlap fit the limit. What remains are the strongest boundaries. The pieces without their overlaps are the item,
character for character.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundary strengths: paragraph, line, sentence, clause, comma, word, none.
_BOUNDARY = re.compile(r"(?P<p>\n\s*\n\s*)|(?P<l>\s*\n\s*)|(?P<s>(?<=[.!?…])[\"»)\]]*\s+)|(?P<c>(?<=[;:])\s+|\s+(?=[—–]\s))|(?P<k>(?<=,)\s+)|(?P<w>\s+)")
_STRENGTH = {"p": 6, "l": 5, "s": 4, "c": 3, "k": 2, "w": 1}


def atoms(text: str, most: int) -> tuple[list[int], list[int]]:
    """Ends of the atomic segments and the strength of the boundary after each; no segment is longer than `most`.
    White space belongs to the segment before it."""
    marks = [(m.end(), _STRENGTH[m.lastgroup]) for m in _BOUNDARY.finditer(text) if 0 < m.end() < len(text)]
    ends, strength, start = [], [], 0
    # words are merged beforehand: a boundary between words only stays where its clause is too long to be an atom
    strong = [m for m in marks if m[1] > 1] + [(len(text), 7)]
    k = 0
    for end, level in strong:
        if end - start > most:
            while k < len(marks) and marks[k][0] <= start:
                k += 1
            while k < len(marks) and marks[k][0] < end:
                if marks[k][1] == 1:
                    ends.append(marks[k][0])
                    strength.append(1)
                k += 1
        ends.append(end)
        strength.append(level)
        start = end
    out_ends, out_strength, start = [], [], 0
    for end, level in zip(ends, strength):
        while end - start > most:
            start += most
            out_ends.append(start)
            out_strength.append(0)
        if end > start:
            out_ends.append(end)
            out_strength.append(level)
            start = end
    return out_ends, out_strength


def overlap_start(text: str, cut: int, low: int, overlap: int) -> int:
    """Where the repeated end of the piece before begins: after the first sentence end within `overlap` characters, else the
    first gap between words; else exactly `overlap` characters back."""
    a = max(low, cut - overlap)
    if a >= cut:
        return cut
    window = text[a:cut]
    best = None
    for m in re.finditer(r"\s+", window):
        if m.end() < len(window):
            if best is None:
                best = m.end()
            if window[m.start() - 1 : m.start()] in (".", "!", "?", "…") and m.start():
                return a + m.end()
    return a + (best or 0) if a > low else a


def split(text: str, limit: int = 1200, overlap: int = 200) -> list[tuple[int, int, int]]:
    """(start, end, overlap) of the pieces of a text: [start, end) is new, and `overlap` characters before start are
    repeated; every piece has at most `limit` characters. A text within the limit is one piece."""
    if len(text) <= limit:
        return [(0, len(text), 0)]
    core = limit - overlap
    ends, strength = atoms(text, core)
    n = len(ends)
    starts = [0, *ends[:-1]]
    nxt, alive, stop = list(range(1, n + 1)), [True] * n, list(ends)

    def room(i: int) -> int:
        return limit if starts[i] == 0 else core

    heap = [(strength[i], ends[i + 1] - starts[i], i, ends[i + 1]) for i in range(n - 1)]
    heapq.heapify(heap)
    level_of = dict(zip(ends, strength))
    prv = list(range(-1, n - 1))
    while heap:
        level, size, i, end = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= n:
            continue
        j = nxt[i]
        if stop[j] != end or end - starts[i] != size or size > room(i):
            continue
        alive[j] = False
        stop[i], nxt[i] = end, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            k = nxt[i]
            heapq.heappush(heap, (level_of[end], stop[k] - starts[i], i, stop[k]))
        if (p := prv[i]) >= 0:
            heapq.heappush(heap, (level_of[stop[p]], end - starts[p], p, end))
    out, i, before = [], 0, 0
    while i < n:
        s = starts[i]
        o = overlap_start(text, s, before, overlap) if s else 0
        out.append((s, stop[i], s - o))
        before, i = s, nxt[i]
    return out


def oversized(docs: DataFrame, limit: int = 1800) -> DataFrame:
    """(parsed_id, chunk_id, text): each chunk longer than `limit`, and with chunk_id -1 each text of that length whose chunks is
    null or empty. A chunk without an id counts by its place."""
    items = F.transform(F.coalesce("chunks.text", F.array()), lambda t, i: F.struct(F.coalesce(F.get(F.col("chunks.chunk_id"), i), i).alias("chunk_id"), t.alias("text")))
    long = F.filter(items, lambda c: F.length(c["text"]) > limit)
    whole = F.when(
        (F.coalesce(F.size("chunks"), F.lit(0)) <= 0) & (F.length("text") > limit), F.array(F.struct(F.lit(-1).alias("chunk_id"), F.col("text").alias("text")))
    )
    return docs.select("parsed_id", F.explode(F.coalesce(whole, long)).alias("c")).select("parsed_id", "c.chunk_id", "c.text")


def split_items(items: DataFrame, keys: tuple[str, ...], text_col: str = "text", limit: int = 1200, overlap: int = 200) -> DataFrame:
    """keys, piece_no int, start int, overlap int, piece string: the pieces of every item.

    piece is text[start - overlap : end]; without the overlaps the pieces of an item add up to its text. Null and empty texts
    give no piece, repeated rows are cut separately, other columns are left out.
    """
    types = [items.schema[k].dataType.simpleString() for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keys)
        for batch in batches:
            row, no, start, over, piece = [], [], [], [], []
            for k, text in enumerate(batch.column(n).to_pylist()):
                if not text:
                    continue
                for i, (a, b, o) in enumerate(split(text, limit, overlap)):
                    row.append(k)
                    no.append(i)
                    start.append(a)
                    over.append(o)
                    piece.append(text[a - o : b])
            take = pa.array(row, pa.int32())
            arrays = [batch.column(c).take(take) for c in range(n)] + [pa.array(no, pa.int32()), pa.array(start, pa.int32()), pa.array(over, pa.int32()), pa.array(piece, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "piece_no", "start", "overlap", "piece"])

    fields = ", ".join(f"`{k}` {t}" for k, t in zip(keys, types))
    return items.select(*keys, text_col).mapInArrow(run, f"{fields}, piece_no int, start int, overlap int, piece string")
