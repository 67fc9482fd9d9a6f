"""Sinks and stores: the index as Parquet tables, logs and histories as JSON lines, reports as documents."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelvara.operators import providers, retrieval

INDEX_TABLES = ("chunks", "postings", "vocabulary", "diagnostics")


def save_index(chunks: DataFrame, folder: str, vectors: DataFrame | None = None) -> str:
    """Chunks, postings, vocabulary, diagnostics and, where given, vectors as one version under `folder`; returns the version.

    The version's tables are written first and its name is appended to `folder`/versions last, in one commit, so that a reader sees either
    the old index or the new one. Postings are ordered by term within files, so that a search prunes row groups by its terms.
    """
    spark, version = chunks.sparkSession, uuid.uuid4().hex
    place = f"{folder}/{version}"
    chunks.write.parquet(f"{place}/chunks")
    stored = spark.read.parquet(f"{place}/chunks")
    retrieval.term_counts(stored).write.parquet(f"{place}/counts")
    counts = spark.read.parquet(f"{place}/counts")
    vocab = retrieval.numbered(retrieval.idf(retrieval.vocabulary(counts), stored))
    vocab.write.parquet(f"{place}/vocabulary")
    weights = spark.read.parquet(f"{place}/vocabulary")
    retrieval.weighted(counts, weights, retrieval.KEY).sortWithinPartitions("term").write.parquet(f"{place}/postings")
    stored.agg(F.count("*").alias("chunks"), F.count_distinct(retrieval.KEY[0]).alias("documents"), F.lit(vectors is not None).alias("with_vectors")).write.parquet(f"{place}/diagnostics")
    if vectors is not None:
        vectors.write.parquet(f"{place}/vectors")
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("saved_at")).coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    return version


def load_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the newest version of an index; raises if there is none or it has no chunk."""
    newest = spark.read.parquet(f"{folder}/versions").orderBy(F.desc("saved_at"), "version").first()
    place = f"{folder}/{newest.version}"
    out = {t: spark.read.parquet(f"{place}/{t}") for t in INDEX_TABLES}
    said = out["diagnostics"].first()
    if not said.chunks:
        raise ValueError(f"the index in {folder} has no chunk")
    if said.with_vectors:
        out["vectors"] = spark.read.parquet(f"{place}/vectors")
    return out


def index_files(spark: SparkSession, folder: str, target: str, model: Callable[[], providers.Embed] | None = None) -> DataFrame:
    """Parses the files of `folder`, rebuilds the index under `target` and returns the parsed documents. Chunks are keyed by a hash of the
    path and their place; with an embedding model they get vectors."""
    from kelvara.sources import files

    docs = files.parse(files.scan(spark, folder).where("supported"))
    each = docs.where("parsed").select(F.xxhash64("path").alias("parsed_id"), "doc_name", F.posexplode("chunks").alias("chunk_id", "text"))
    vectors = providers.embed(each.select(*retrieval.KEY, "text"), "text", model).drop("text") if model else None
    save_index(each, target, vectors)
    return docs


def append_log(rows: DataFrame, folder: str) -> None:
    """Rows as JSON lines, appended."""
    rows.write.mode("append").json(folder)


def read_log(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(folder)


CLIMATE_SCHEMA = "name string, t_ot double, z_ot int, t_n double, source string"


def read_climate(spark: SparkSession, path: str) -> DataFrame:
    """Climate rows from JSON lines; a missing t_n is t_ot - 20."""
    return spark.read.schema(CLIMATE_SCHEMA).json(path).withColumn("t_n", F.coalesce("t_n", F.col("t_ot") - 20))


_PART = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
_TYPES = f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{_PART}"/></Types>'
_RELS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def docx_bytes(lines: list[str]) -> bytes:
    """A document with one paragraph per line."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
    xml = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS)
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def reports_as_docx(rows: DataFrame) -> DataFrame:
    """(query_id, content binary): report rows (query_id, section, ord, line) as one document per question; a report is bounded by its answer."""
    order = F.array_sort(F.collect_list(F.struct("section", "ord", "line")))
    lines = rows.groupBy("query_id").agg(F.transform(order, lambda r: r["line"]).alias("lines"))
    return lines.select("query_id", F.udf(lambda x: docx_bytes(x), "binary", useArrow=True)("lines").alias("content"))
