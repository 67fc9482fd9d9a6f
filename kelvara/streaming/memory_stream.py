"""Streams: the retrieval memory's counters kept up to date, and search activity per window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvara.functions import text as T


def success_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """(pattern, query_type, success_count, last_used) from a stream of successes (query, query_type, used_at). Update mode; state is one row per
    pattern and type, as in the batch memory."""
    named = events.withWatermark("used_at", delay).withColumn("pattern", T.query_pattern(F.col("query"))).where("pattern <> ''")
    return named.groupBy("pattern", F.coalesce("query_type", F.lit("search")).alias("query_type")).agg(F.count("*").alias("success_count"), F.max("used_at").alias("last_used"))


def activity(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """(start, kind, n) per window and kind of event (kind, at); events later than `delay` are left out, so state stays bounded. Append mode."""
    window = F.window("at", width, slide) if slide else F.window("at", width)
    return events.withWatermark("at", delay).groupBy(window.alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
