"""Queries of the general training-data operators (problems 1 and 2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvara.operators import records
from kelvara.session import cut_lineage, spread, table


def _loaded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    loaded = cut_lineage(records.load_tables(spread(table(spark, sf_dir, "extracted_tables").select("table_id", "title", "headers", "rows", "raw_text")), table(spark, sf_dir, "common_units")))
    return loaded, records.table_values(loaded)


def _materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.material_values(table(spark, sf_dir, "materials"), table(spark, sf_dir, "sources").where("kind = 'catalogue'"))


def _p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded, values = _loaded(spark, sf_dir)
    bad = records.faulty_records(loaded, values).select("table_id", "row_no").distinct()
    cells = values.where("state = 'value'").join(bad, ["table_id", "row_no"], "left_anti")
    cells = cells.select(F.lit("extracted_tables").alias("tbl"), F.col("table_id").alias("rec_id"), "row_no", "col_no", "quantity", "unit", "is_common", "lo", "hi")
    m = _materials(spark, sf_dir).select(
        F.lit("materials").alias("tbl"), F.col("material_id").alias("rec_id"), F.lit(-1).alias("row_no"), F.lit(-1).alias("col_no"),
        F.lit("conductivity").alias("quantity"), "unit", "is_common", F.col("lambda_common").alias("lo"), F.col("lambda_common").alias("hi"),
    )
    return cells.unionByName(m).distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p1(spark, sf_dir).where("not is_common").select("tbl", "rec_id", "row_no", "col_no").distinct()


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p1(spark, sf_dir).select("tbl", "rec_id", "row_no", "col_no", "quantity", "unit", "lo", "hi")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.faulty_records(*_loaded(spark, sf_dir))


def p2_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.sound_cells(*_loaded(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_values, p2_found, p2_cells)}
