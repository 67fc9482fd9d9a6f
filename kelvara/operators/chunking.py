"""Documents to chunks: paragraphs, long paragraphs by sentences, long sentences by windows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelvara.config import CHUNKING, Chunking
from kelvara.functions import text as T


def cut_windows(text: str, c: Chunking) -> list[str]:
    """Windows of the chunk size that end at a space where one is far enough, each starting `overlap` before the last one's end."""
    out, start = [], 0
    while True:
        end = min(start + c.size, len(text))
        if end < len(text):
            space = text.rfind(" ", start, end)
            end = space if space > start + c.least else end
        if piece := text[start:end].strip():
            out.append(piece)
        if end >= len(text):
            return out
        start = max(end - c.overlap, start + 1)


def carried_over(text: str) -> str:
    """What the next chunk repeats, from a full word on."""
    text = text.strip()
    space = text.find(" ")
    return text[space + 1 :].strip() if 0 < space < len(text) // 2 else text


def pack_sentences(text: str, c: Chunking) -> list[str]:
    """Sentences packed up to the chunk size; a chunk starts with the end of the one before."""
    parts = [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text)) if s]
    if len(parts) < 2:
        return cut_windows(text, c)
    out, held = [], ""
    for s in parts:
        longer = f"{held} {s}" if held else s
        if len(longer) <= c.size:
            held = longer
        elif not held:
            out += cut_windows(s, c)
        else:
            out.append(held.strip())
            tail = carried_over(held[-c.overlap :]) if c.overlap else ""
            held = f"{tail} {s}".strip()
    return [*out, held.strip()] if held.strip() else out


def chunk_texts(text: Column, settings: Chunking = CHUNKING) -> Column:
    """array<string>: the chunks of a text in order. Only texts with a paragraph beyond the limit reach Python."""
    c = settings.clamped()
    limit = settings.longest
    paragraphs = T.paragraphs(T.normalize(text))

    @F.pandas_udf("array<string>")
    def split_long(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: None if p is None else [x for s in p for x in (pack_sentences(s, c) if len(s) > limit else [s])])

    long = F.exists(paragraphs, lambda p: F.length(p) > limit)
    return F.coalesce(split_long(F.when(long, paragraphs)), paragraphs)


def windows(text: Column, settings: Chunking = CHUNKING) -> Column:
    """array<string>: a text cut by windows alone, whatever its sentences."""
    c = settings.clamped()

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else cut_windows(t, c))

    return cut(text)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Chunking = CHUNKING) -> DataFrame:
    """(id_col, chunk_id int, text, has_formula, has_table_like_content): no shuffle, chunk ids from 0 per row. Null and blank texts give
    no chunk."""
    exploded = docs.select(id_col, F.posexplode(chunk_texts(F.col(text_col), settings)).alias("chunk_id", "text"))
    return exploded.select(id_col, "chunk_id", "text", (F.size(T.formulas(F.col("text"))) > 0).alias("has_formula"), T.table_like(F.col("text")).alias("has_table_like_content"))


def stored_chunks(parsed: DataFrame) -> DataFrame:
    """(parsed_id, doc_name, chunk_id, text) of parsed documents: blank chunks dropped, texts stripped."""
    each = parsed.select("parsed_id", "doc_name", F.explode("chunks").alias("c")).select("parsed_id", "doc_name", "c.chunk_id", T.strip(F.col("c.text")).alias("text"))
    return each.where("text is not null and text <> ''")
