"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvara.llm import abuse, bpe, encodings, lookalikes, neighbours, packing, scans, splitting
from kelvara.session import spread, table


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.repair(table(spark, sf_dir, "parsed_documents"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_restored(spark, sf_dir).select("parsed_id").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_items(splitting.oversized(table(spark, sf_dir, "parsed_documents")), ("parsed_id", "chunk_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pieces(spark, sf_dir).where("piece_no = 0").select("parsed_id", "chunk_id").distinct()


def _consistent(spark: SparkSession, sf_dir: str, garbled_apart: bool) -> DataFrame:
    docs = lookalikes.consistent(table(spark, sf_dir, "parsed_documents"), "parsed_id", garbled_apart=garbled_apart).select(F.lit("parsed_documents").alias("tbl"), F.col("parsed_id").alias("rec_id"), "consistent", "garbled")
    results = lookalikes.consistent(table(spark, sf_dir, "search_results"), "result_id", garbled_apart=garbled_apart).select(F.lit("search_results").alias("tbl"), F.col("result_id").alias("rec_id"), "consistent", "garbled")
    return docs.unionByName(results)


def p7_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consistent(spark, sf_dir, False)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consistent(spark, sf_dir, True).select("tbl", "rec_id").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.evidence(spread(table(spark, sf_dir, "parsed_documents").select("parsed_id", "text"))).select("parsed_id").distinct()


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "parsed_documents").select("parsed_id", "text"))
    return scans.repair(docs, scans.evidence(docs))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    fitted = replace(abuse.fit(table(spark, sf_dir, "moderation_samples")), ordinary=abuse.ordinary_words(docs))
    return abuse.score_documents(docs, fitted=fitted)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(p10_scores(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.pairs_above(table(spark, sf_dir, "chunk_vectors"))


def p6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "chunk_vectors"))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.classes_above(table(spark, sf_dir, "chunk_vectors"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(bpe.token_counts(table(spark, sf_dir, "documents")))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p9_containers(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p3_found, p4_found, p5_found, p6_found, p7_found, p8_ids, p10_found)
    whole = (p3_restored, p4_pieces, p5_repaired, p6_nearest, p6_classes, p7_consistent, p9_containers, p9_fill, p10_scores, p10_rates)
    return {f.__name__: f for f in (*found, *whole)}


_UNIT = "list_transform(vec, lambda x: x::double)"


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": """with e as (select parsed_id, unnest(chunks) as piece from parsed_documents)
          select distinct parsed_id, piece.chunk_id as chunk_id from e where length(piece.text) > 1800
          union select parsed_id, -1 from parsed_documents where length(text) > 1800 and coalesce(len(chunks), 0) = 0""",
        "p6_found": f"""with v as (select vec_id, {_UNIT} as v from chunk_vectors where vec is not null), u as (select vec_id, v, sqrt(list_dot_product(v, v)) as n from v
            where len(list_filter(v, lambda x: x is null or isnan(x))) = 0 and list_dot_product(v, v) > 0)
          select a.vec_id as vec_lo, b.vec_id as vec_hi from u a join u b on a.vec_id < b.vec_id where list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95""",
    }
