"""Tables mined from plain text: pipe, aligned, marked and keyword tables, as islands of lines per text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelvara.functions import text as T
from kelvara.lexicons import TABLE_KEYWORDS, TABLE_MARKER

PIPE_LINE = r"\|[^\n]*\|"


def lines(docs: DataFrame, id_col: str, where: Column | None = None) -> DataFrame:
    """(id, i, line): the lines of every text that can hold a table; `where` is tested in the scan's stage."""
    kept = docs.where(F.col("text").isNotNull())
    kept = kept if where is None else kept.where(where)
    return kept.select(F.col(id_col).alias("id"), F.posexplode(F.split("text", "\n")).alias("i", "line"))


def _islands(df: DataFrame) -> DataFrame:
    """Adds `island` to lines that passed a filter: equal for neighbours without a gap."""
    return df.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("id").orderBy("i")))


def _tables(df: DataFrame, kind: str, confidence: float, least: int) -> DataFrame:
    """Line groups to tables (id, kind, start, title, raw_text, lines, confidence)."""
    grouped = df.groupBy("id", "island").agg(
        F.min("i").alias("start"), F.max("title").alias("title"), F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"), F.count("*").alias("n")
    )
    return grouped.where(F.col("n") >= least).select(
        "id", F.lit(kind).alias("kind"), "start", "title", F.array_join(F.col("l.line"), "\n").alias("raw_text"), F.col("l.line").alias("lines"), F.lit(confidence).alias("confidence")
    )


def pipe_tables(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Maximal runs of lines with at least two pipes."""
    hit = lines(docs, id_col, F.col("text").rlike(PIPE_LINE)).where(F.col("line").rlike(PIPE_LINE))
    return _tables(_islands(hit).withColumn("title", F.lit(None).cast("string")), "pipe", 0.85, 1)


def aligned_tables(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Runs of three and more lines with a digit and at least three fields parted by wide gaps."""
    wide = F.col("line").rlike(r"\d") & (F.size(F.split(T.strip(F.col("line")), r"\s{2,}")) >= 3)
    hit = lines(docs, id_col, F.col("text").rlike(r"\S\s{2,}\S")).where(wide)
    return _tables(_islands(hit).withColumn("title", F.lit(None).cast("string")), "aligned", 0.7, 3)


def marker_tables(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The lines under a marker line up to a blank line; another marker before that drops what was gathered. The title is the line
    before the marker if there is a short one, else a number."""
    all_lines = lines(docs, id_col, F.contains("text", F.lit(TABLE_MARKER)))
    w = Window.partitionBy("id").orderBy("i")
    marker, blank = F.contains("line", F.lit(TABLE_MARKER)), T.strip(F.col("line")) == ""
    before = F.lag("line").over(w)
    tagged = (
        all_lines.withColumn("marker", marker).withColumn("blank", blank)
        .withColumn("title", F.when(F.col("marker") & (F.col("i") > 0) & (F.length(T.strip(before)) < 100), T.strip(before)))
        .withColumn("island", F.max(F.when(F.col("marker"), F.col("i"))).over(w))
        .where("island is not null")
    )
    inner = Window.partitionBy("id", "island").orderBy("i")
    whole = Window.partitionBy("id", "island")
    body = (
        tagged.withColumn("title", F.first("title").over(inner)).withColumn("gap", F.sum(F.col("blank").cast("int")).over(inner))
        .withColumn("ended", F.max("blank").over(whole)).withColumn("last", F.max("island").over(Window.partitionBy("id")))
        .where("not marker and gap = 0 and (ended or island = last)").withColumn("line", T.strip(F.col("line")))
    )
    found = _tables(body, "marker", 0.95, 1)
    # numbered by the tables before it that have two data rows
    before = F.coalesce(F.sum((F.size("lines") >= 3).cast("int")).over(Window.partitionBy("id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("title", F.coalesce("title", F.concat(F.lit("Таблица "), (before + 1).cast("string"))))


def keyword_tables(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The lines under a header with a key word and a colon, up to a blank line, another key word, or a line without a number that is
    not one of the first long ones."""
    text = F.lower("text")
    all_lines = lines(docs, id_col, T.contains_any(text, TABLE_KEYWORDS) & F.contains("text", F.lit(":")))
    w = Window.partitionBy("id").orderBy("i")
    key = T.contains_any(F.lower("line"), TABLE_KEYWORDS)
    tagged = all_lines.withColumn("line", T.strip(F.col("line"))).withColumn("key", key).withColumn("island", F.max(F.when(F.col("key"), F.col("i"))).over(w)).where("island is not null")
    place = F.col("i") - F.col("island")
    bad = (F.col("line") == "") | (~F.col("line").rlike(r"\p{Nd}") & ~((F.length("line") > 50) & (place < 5)))
    inner = Window.partitionBy("id", "island").orderBy("i")
    body = (
        tagged.withColumn("title", F.first(F.when(F.col("key") & F.contains("line", F.lit(":")), F.col("line"))).over(inner))
        .withColumn("bad", F.sum(F.when(F.col("key"), 0).otherwise(bad.cast("int"))).over(inner))
        .where("title is not null and not key and bad = 0")
    )
    return _tables(body, "keyword", 0.6, 2)


def cells_of(kind: str, line: Column) -> Column:
    """The cells of one table line."""
    if kind == "pipe":
        inner = F.regexp_replace(T.strip(line), r"^\||\|$", "")
        return F.transform(F.split(inner, r"\|"), T.strip)
    return F.transform(F.when(F.contains(line, F.lit("\t")), F.split(line, "\t")).otherwise(F.split(T.strip(line), r"\s{2,}")), T.strip)


def rows_of(found: DataFrame) -> DataFrame:
    """Adds `rows`: cells per line; of pipe tables without blank rows and rows of dashes alone. The first row is the header."""
    pipe = F.filter(F.transform("lines", lambda x: cells_of("pipe", x)), lambda r: F.exists(r, lambda c: c != "") & ~F.forall(r, lambda c: c.rlike(r"^-+$")))
    other = F.transform("lines", lambda x: cells_of("other", x))
    return found.withColumn("rows", F.when(F.col("kind") == "pipe", pipe).otherwise(other))


def extract_tables(docs: DataFrame, id_col: str = "doc_id", least_rows: int = 2, most: int = 10, source_col: str | None = None) -> DataFrame:
    """(id, table_no, kind, title, raw_text, rows, data_rows, confidence): the tables of every text from all four extractors; equal ones (first 200
    characters) once, valid ones only, best confidence first, at most `most` per text. Pipe and aligned tables are titled after the source
    where its column is named, else they have no title."""
    found = marker_tables(docs, id_col).unionByName(pipe_tables(docs, id_col)).unionByName(aligned_tables(docs, id_col)).unionByName(keyword_tables(docs, id_col))
    first = Window.partitionBy("id", F.substring("raw_text", 1, 200)).orderBy(F.desc("confidence"), "start", "kind")
    order = Window.partitionBy("id").orderBy(F.desc("confidence"), "start", "kind")
    kept = rows_of(found.withColumn("r", F.row_number().over(first)).where("r = 1")).withColumn("data_rows", F.size("rows") - 1).where(F.col("data_rows") >= least_rows)
    kept = kept.withColumn("table_no", F.row_number().over(order)).where(F.col("table_no") <= most)
    if source_col is not None:
        names = docs.select(F.col(id_col).alias("id"), F.concat(F.lit("Таблица из "), F.coalesce(source_col, F.lit(""))).alias("named")).dropDuplicates(["id"])
        kept = kept.join(names, "id", "left").withColumn("title", F.when(F.col("kind").isin("pipe", "aligned"), F.col("named")).otherwise(F.col("title")))
    return kept.select("id", "table_no", "kind", "title", "raw_text", "rows", "data_rows", "confidence")


def tables_of_hits(hits: DataFrame, first: int = 3) -> DataFrame:
    """(query_id, hit, source, place, kind, title, raw_text, rows, data_rows, confidence): the tables in the first hits of every question, in the order
    of the hits; equal ones of a source (first 200 characters) once. hits: query_id, rank, result_id, doc_name, text."""
    top = hits.where(F.col("rank") <= first).select("query_id", F.col("rank").alias("hit"), "result_id", F.coalesce("doc_name", F.lit("")).alias("source"), "text")
    texts = top.select("result_id", "source", "text").dropDuplicates(["result_id"])
    found = extract_tables(texts, "result_id", source_col="source").withColumnRenamed("id", "result_id")
    each = top.select("query_id", "hit", "result_id", "source").join(found, "result_id")
    once = Window.partitionBy("query_id", "source", F.substring("raw_text", 1, 200)).orderBy("hit", "result_id", "table_no")
    place = Window.partitionBy("query_id").orderBy("hit", "result_id", "table_no")
    kept = each.withColumn("n", F.row_number().over(once)).where("n = 1").withColumn("place", F.row_number().over(place))
    return kept.select("query_id", "hit", "source", "place", "kind", "title", "raw_text", "rows", "data_rows", "confidence")


def records_of(found: DataFrame) -> DataFrame:
    """Tables as records: (.., title, headers, rows, content, doc_name, row_count, confidence) beside their keys; the header row stands apart."""
    keys = [c for c in ("query_id", "id", "place", "table_no") if c in found.columns]
    body = F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))
    source = F.col("source") if "source" in found.columns else F.lit(None).cast("string")
    return found.select(*keys, "title", F.get("rows", F.lit(0)).alias("headers"), body.alias("rows"), F.col("raw_text").alias("content"), source.alias("doc_name"), F.size(body).alias("row_count"), "confidence")


def climate_of(found: DataFrame, cities: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(city, source, row_text, t_ot, z_ot, numbers): for every city its first table row (by `order`, then row and cell): one with a cell that contains it, else
    one whose cells together do; and the first two numbers of that row. `cities` (city) is a fixed table."""
    rows = found.select(*order, "source", F.posexplode("rows").alias("row_no", "row")).where("row_no > 0").withColumn("row_text", F.array_join("row", " "))
    hit = rows.join(F.broadcast(cities.select("city")), F.contains(F.lower("row_text"), F.lower("city")))
    whole = F.exists("row", lambda c: F.contains(F.lower(c), F.lower("city")))
    first = hit.groupBy("city").agg(F.min(F.struct((~whole).alias("split"), *order, "row_no", "source", "row_text")).alias("f"))
    n = T.every(F.col("f.row_text"), r"-?\d+[.,]?\d*")
    number = lambda i: F.replace(F.get(n, F.lit(i)), F.lit(","), F.lit(".")).try_cast("double")
    return first.select("city", "f.source", "f.row_text", number(0).alias("t_ot"), number(1).cast("int").alias("z_ot"), F.size(n).alias("numbers"))


def table_cells(found: DataFrame) -> DataFrame:
    """(id, table_no, row_no, col_no, cell, row_text): the data cells; the header row is left out."""
    rows = found.select("id", "table_no", F.posexplode("rows").alias("row_no", "row")).where("row_no > 0")
    return rows.select("id", "table_no", "row_no", F.array_join("row", " ").alias("row_text"), F.posexplode("row").alias("col_no", "cell"))


def city_climate(found: DataFrame, cities: DataFrame) -> DataFrame:
    """(city, id, table_no, row_no, t_ot, z_ot): for every city its first table row, and the first two numbers of that row. `cities` is a fixed
    table."""
    hit = table_cells(found).join(F.broadcast(cities.select(F.col("name").alias("city"))), F.contains(F.lower("cell"), F.lower("city")))
    first = hit.groupBy("city").agg(F.min(F.struct("id", "table_no", "row_no", "col_no", "row_text")).alias("f"))
    n = T.every(F.col("f.row_text"), r"-?\d+[.,]?\d*")
    number = lambda i: F.replace(F.get(n, F.lit(i)), F.lit(","), F.lit(".")).try_cast("double")
    return first.select("city", "f.id", "f.table_no", "f.row_no", number(0).alias("t_ot"), number(1).cast("int").alias("z_ot"))
