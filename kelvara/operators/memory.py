"""Retrieval memory: what was found for earlier questions, and the boosts that similar questions draw from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelvara.config import MEMORY_RECORDS
from kelvara.functions import text as T


def _kept(items: DataFrame, column: str, most: int) -> DataFrame:
    """Per record the first `most` distinct items by first appearance; minima are taken map-side, so a hot record is no problem."""
    first = items.where("item is not null and item <> ''").groupBy("pattern", "query_type", "item").agg(F.min(F.struct("seq", "pos")).alias("at"))
    order = Window.partitionBy("pattern", "query_type").orderBy("at", "item")
    return first.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).groupBy("pattern", "query_type").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "item"))), lambda x: x["item"]).alias(column)
    )


def remember(log: DataFrame, most: int = MEMORY_RECORDS) -> DataFrame:
    """(pattern, query_type, success_count, first_seq, last_used, keywords, sources, boost_terms) from a log of successes (seq, query, query_type, used_at,
    keywords, sources): one record per pattern and type, the `most` newest records.

    A record starts with ten keywords, eight sources and six boost terms; later successes append new ones up to 15, 10 and 10. Questions without a
    pattern and successes without sources are not remembered.
    """
    events = log.where(F.size("sources") > 0).withColumn("pattern", T.query_pattern(F.col("query"))).where("pattern <> ''").withColumn("query_type", F.coalesce("query_type", F.lit("search")))
    heads = events.groupBy("pattern", "query_type").agg(F.count("*").alias("success_count"), F.min("seq").alias("first_seq"), F.max("used_at").alias("last_used"))
    newest = heads.orderBy(F.desc("first_seq"), "pattern", "query_type").limit(most)
    # at most `most` records, so what follows only touches their events
    mine = events.join(F.broadcast(newest.select("pattern", "query_type", "first_seq")), ["pattern", "query_type"])
    words = F.when(F.col("seq") == F.col("first_seq"), F.slice("keywords", 1, 10)).otherwise(F.col("keywords"))
    each = lambda arr: mine.select("pattern", "query_type", "seq", F.posexplode(arr).alias("pos", "item"))
    out = newest
    for column, arr, cap in (("keywords", words, 15), ("sources", F.slice("sources", 1, 8), 10), ("boost_terms", F.slice("keywords", 1, 6), 10)):
        out = out.join(_kept(each(arr), column, cap), ["pattern", "query_type"], "left")
    empty = F.expr("cast(array() as array<string>)")
    return out.select("pattern", "query_type", "success_count", "first_seq", "last_used", *(F.coalesce(c, empty).alias(c) for c in ("keywords", "sources", "boost_terms")))


def boosts(queries: DataFrame, memory: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, ord, kind, item): up to `most` sources and terms of the records of a question's type that share two words with it or its whole
    pattern; most used first. The memory has at most MEMORY_RECORDS rows."""
    asked = queries.select("query_id", F.coalesce("query_type", F.lit("search")).alias("query_type"), T.query_pattern(F.col("query")).alias("p")).where("p <> ''")
    shared = F.size(F.array_intersect(F.split("p", " "), F.split("pattern", " ")))
    hit = asked.join(F.broadcast(memory), "query_type").where((shared >= 2) | (F.col("p") == F.col("pattern")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("success_count"), F.desc("last_used"), "pattern"))
    hit = hit.withColumn("r", rank)
    items = hit.select("query_id", "r", F.lit("source").alias("kind"), F.posexplode("sources").alias("pos", "item")).unionByName(
        hit.select("query_id", "r", F.lit("term").alias("kind"), F.posexplode("boost_terms").alias("pos", "item"))
    )
    first = items.groupBy("query_id", "kind", "item").agg(F.min(F.struct("r", "pos")).alias("at"))
    order = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("at"))
    return first.withColumn("ord", order).where(F.col("ord") <= most).select("query_id", "kind", "ord", "item")


def by_type(memory: DataFrame, query_type: str) -> DataFrame:
    return memory.where(F.col("query_type") == query_type)


def cleared(memory: DataFrame) -> DataFrame:
    """The memory without its records; written over the store it forgets everything."""
    return memory.limit(0)


def statistics(memory: DataFrame) -> DataFrame:
    """One row: records, distinct patterns and the average of successes (0 without records)."""
    return memory.agg(F.count("*").alias("records"), F.countDistinct("pattern").alias("patterns"), F.coalesce(F.avg("success_count"), F.lit(0.0)).alias("avg_success"))
