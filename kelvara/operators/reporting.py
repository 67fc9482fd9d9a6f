"""Answers, contexts, sources, statistics and logs over sets of search results and documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelvara.config import EMBEDDING_BATCH
from kelvara.functions import text as T
from kelvara.lexicons import CRITICAL_ERRORS
from kelvara.texts import AREA_ERRORS, ERRORS, NOT_FOUND, OTHER_ERROR, UNKNOWN_ERROR, UNNAMED_LIBRARY


def hits(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Search results with their questions, rows loaded again once: per query and rank the smallest result_id."""
    first = Window.partitionBy("query_id", "rank").orderBy("result_id")
    return results.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").join(queries.select("query_id", "query", "query_type"), "query_id")


def sources(found: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, ord, doc_name, score): distinct sources by best rank."""
    best = found.groupBy("query_id", "doc_name").agg(F.min(F.struct("rank", "result_id", "score")).alias("b"))
    order = Window.partitionBy("query_id").orderBy("b.rank", "b.result_id")
    return best.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= most).select("query_id", "ord", "doc_name", F.col("b.score").alias("score"))


def contexts(found: DataFrame) -> DataFrame:
    """(query_id, context): the hits' texts numbered in rank order."""
    part = F.struct("rank", F.format_string("[%d] %s\n%s", F.col("rank"), F.coalesce("doc_name", F.lit("")), F.coalesce("text", F.lit(""))).alias("t"))
    return found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("context"))


def extractive_answers(found: DataFrame, texts: int = 3, longest: int = 1800) -> DataFrame:
    """(query_id, answer): the first non-blank texts; beyond `longest` characters cut at the last space, with dots."""
    kept = found.where(T.strip(F.col("text")) != "").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("r") <= texts)
    joined = kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", T.strip(F.col("text")).alias("t")))), lambda x: x["t"]), "\n\n").alias("a"))
    a = F.regexp_replace("a", r"\n{3,}", "\n\n")
    cut = F.regexp_replace(F.substring(a, 1, longest), r" [^ ]*$", "")
    return joined.select("query_id", F.when(F.length(a) > longest, F.concat(cut, F.lit("..."))).otherwise(a).alias("answer"))


def answer_records(asked: DataFrame, found: DataFrame, generate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, answer, sources array<string>, provider, used_llm): every question (query_id, query) answered from its hits. `generate` adds a column `told` to rows
    with query_id, query and context (providers.generate does); where it says nothing the extractive answer stands, and a question without hits gets the
    fixed not-found record."""
    base = asked.select("query_id", "query").join(extractive_answers(found), "query_id", "left").join(contexts(found), "query_id", "left")
    told = generate(base) if generate else base.withColumn("told", F.lit(None).cast("string"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("ord", "doc_name"))), lambda x: x["doc_name"])
    told = told.join(sources(found).groupBy("query_id").agg(names.alias("sources")), "query_id", "left")
    used = F.col("context").isNotNull() & F.col("told").isNotNull()
    return told.select(
        "query_id", F.when(F.col("context").isNull(), NOT_FOUND).otherwise(F.coalesce("told", "answer", F.lit(""))).alias("answer"), F.coalesce("sources", F.expr("cast(array() as array<string>)")).alias("sources"),
        F.when(used, "llm").otherwise("none").alias("provider"), used.alias("used_llm"),
    )


def trace(answers: DataFrame) -> DataFrame:
    """(query_id, step, description, confidence): the six steps behind every answer of agent.answer (query_id, confidence, needs_clarification, found, relevance): analysis, search,
    context, handler, completeness, final answer."""
    c = F.col("confidence")
    steps = (
        ("Анализ типа запроса и сущностей", F.lit(0.9)), ("Расширенный поиск по индексу с памятью и повторным ранжированием", F.when(F.col("found"), 0.85).otherwise(0.3)),
        ("Анализ контекста и извлечение ключевой информации", F.coalesce("relevance", F.lit(0.5))), ("Ответ по типу запроса", c), ("Проверка полноты ответа", F.when(F.col("needs_clarification"), 0.5).otherwise(0.85)), ("Формирование финального ответа", c),
    )
    each = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(d).alias("description"), x.cast("double").alias("confidence")) for i, (d, x) in enumerate(steps, 1)))
    return answers.select("query_id", F.explode(each).alias("s")).select("query_id", "s.step", "s.description", "s.confidence")


def index_diagnostics(parsed: DataFrame) -> DataFrame:
    """One row: documents, those with chunks, chunks, blank chunks and embedding batches."""
    texts = F.coalesce(F.col("chunks.text"), F.expr("cast(array() as array<string>)"))
    full = F.size(F.filter(texts, lambda t: T.strip(t) != ""))
    per = parsed.select(F.size(texts).alias("n"), full.alias("full"))
    return per.agg(
        F.count("*").alias("documents_total"), F.count_if(F.col("full") > 0).alias("with_chunks"), F.coalesce(F.sum("full"), F.lit(0)).alias("chunks_total"),
        F.coalesce(F.sum(F.col("n") - F.col("full")), F.lit(0)).alias("skipped_empty"), F.ceil(F.coalesce(F.sum("full"), F.lit(0)) / EMBEDDING_BATCH).alias("batches"),
    )


def document_metadata(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, char_count, word_count, sentence_count, has_formulas, has_table_like_content); null texts count as empty."""
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(text, f"{T.WS}+"), lambda w: w != ""))
    sentences = F.size(F.filter(T.sentences(text), lambda s: T.strip(s) != ""))
    return docs.select(
        id_col, F.length(text).cast("bigint").alias("char_count"), words.cast("bigint").alias("word_count"), sentences.cast("bigint").alias("sentence_count"),
        (F.size(T.formulas(text)) > 0).alias("has_formulas"), T.table_like(text).alias("has_table_like_content"),
    )


# Materials by their stems.
MATERIALS = ("минеральная вата", "минеральной ваты", "пенополистирол", "пенополиуретан", "керамзит", "кирпич", "бетон", "газобетон", "древесин", "пеностекло", "базальтов", "стекловолокн", "гипс", "штукатурк", "перлит", "эковат", "каучук")
_NUMBER = r"-?\d+(?:[.,]\d+)?"


def entities(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, kind, item): the distinct standards, materials, sections, temperatures, thicknesses and densities that a text names. Null texts give no
    row; no shuffle."""
    text, low = F.col("text"), F.lower("text")
    found = {
        "standard": T.every(text, STANDARD), "material": F.filter(F.array(*map(F.lit, MATERIALS)), lambda m: F.contains(low, m)), "section": T.every(text, r"(?m)^[ \t]*(\d+(?:\.\d+)+)[. \t]", 1),
        "temperature": T.every(text, rf"{_NUMBER}\s?°[CС]"), "thickness": T.every(text, rf"({_NUMBER}\s?мм)(?:[^\p{{L}}²³]|$)", 1), "density": T.every(text, rf"{_NUMBER}\s?кг/м³"),
    }
    named = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("item"))
    each = F.concat(*(F.transform(F.array_distinct(c), named(kind)) for kind, c in found.items()))
    return docs.where("text is not null").select(id_col, F.explode(each).alias("e")).select(id_col, "e.kind", "e.item")


STANDARD = r"(?:СТО-Т \d+-\d+|НТР \d+\.\d+|ВСН-К \d+-\d+|ТУ-Н \d+\.\d+\.\d+|EN-T \d+:\d+|РСТ \d+|СП\s?\d+\.\d+|ГОСТ\s?\d+(?:-\d+)?|СНиП\s?\d[\d.-]*\d)"


def mentions(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, standard, n): standards that a text names, counted within the text without a shuffle."""
    named = T.every(F.col("text"), STANDARD)
    return docs.select(id_col, named.alias("s")).select(id_col, F.explode(F.array_distinct("s")).alias("standard"), "s").select(
        id_col, "standard", F.size(F.filter("s", lambda x: x == F.col("standard"))).cast("bigint").alias("n")
    )


def mention_graph(docs: DataFrame) -> DataFrame:
    """(node, type, degree): documents and the standards they name as a graph with an edge per pair that occurs."""
    edges = docs.where("doc_name is not null").select("doc_name", F.explode(F.array_distinct(T.every(F.col("text"), STANDARD))).alias("standard")).distinct()
    names = edges.groupBy(F.col("doc_name").alias("node")).agg(F.count("*").alias("degree")).withColumn("type", F.lit("document"))
    codes = edges.groupBy(F.col("standard").alias("node")).agg(F.count("*").alias("degree")).withColumn("type", F.lit("standard"))
    return names.unionByName(codes).select("node", "type", "degree")


def graph_statistics(graph: DataFrame) -> DataFrame:
    """One row: nodes, edges, density 2E / (N (N - 1)) (null below two nodes) and the highest degree."""
    nodes, ends = F.count("*"), F.coalesce(F.sum("degree"), F.lit(0))
    return graph.agg(nodes.alias("nodes"), F.floor(ends / 2).alias("edges"), F.try_divide(ends.cast("double"), (nodes * (nodes - 1)).cast("double")).alias("density"), F.max("degree").alias("top_degree"))


def top_nodes(graph: DataFrame, most: int = 10) -> DataFrame:
    """The nodes of the highest degree; ties by name."""
    return graph.orderBy(F.desc("degree"), "node", "type").limit(most)


def turns(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, turn, role, content): the turns of exported conversations, in order."""
    text = F.col("text")
    parts = F.split(text, r"\n(?=(?:user|assistant): )")
    return docs.where(text.rlike(r"^(?:user|assistant): ")).select(id_col, F.posexplode(parts).alias("turn", "p")).select(
        id_col, F.col("turn").cast("bigint").alias("turn"), F.regexp_extract("p", r"^(user|assistant): ", 1).alias("role"), F.regexp_replace("p", r"^(?:user|assistant): ", "").alias("content")
    )


def report_rows(answers: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, section, ord, line): a report as rows: the answer's lines without asterisks, then the sources."""
    body = answers.select("query_id", F.lit("answer").alias("section"), F.posexplode(F.split(F.replace("answer", F.lit("*"), F.lit("")), "\n")).alias("ord", "line")).where(T.strip(F.col("line")) != "")
    tail = sources(found).select("query_id", F.lit("source").alias("section"), F.col("ord"), F.col("doc_name").alias("line"))
    return body.select("query_id", "section", F.col("ord").cast("bigint").alias("ord"), "line").unionByName(tail.select("query_id", "section", F.col("ord").cast("bigint").alias("ord"), "line"))


def full_report(answers: DataFrame, found: DataFrame, tables_found: DataFrame, formulas: DataFrame) -> DataFrame:
    """(query_id, section, ord, line): a whole report: the answer's lines, up to two tables (title and text), up to three formulas with five variables,
    and the sources; ord counts within a section."""
    mined = tables_found.where(F.col("place") <= 2).select("query_id", F.lit("table").alias("section"), F.col("place").alias("k"), F.posexplode(F.concat(F.array(F.coalesce("title", F.lit("Таблица"))), F.split("raw_text", "\n"))).alias("i", "line"))
    mined = mined.select("query_id", "section", F.row_number().over(Window.partitionBy("query_id").orderBy("k", "i")).cast("bigint").alias("ord"), "line")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("raw"))
    three = formulas.withColumn("k", place).where("k <= 3").select("query_id", F.lit("formula").alias("section"), F.col("k").cast("bigint").alias("ord"), F.concat_ws("; ", F.col("raw"), F.array_join(F.slice(T.variables(F.col("raw")), 1, 5), ", ")).alias("line"))
    return report_rows(answers, found).unionByName(mined).unionByName(three)


def module_name(message: Column) -> Column:
    """The first quoted name of an error message, or null."""
    return F.nullif(F.regexp_extract(message, r"'([^']+)'", 1), F.lit(""))


def error_area(kind: Column, message: Column) -> Column:
    """Where an error belongs: calculation, search, agent or other, in this order."""
    low = F.lower(message)
    return (
        F.when(F.contains(kind, F.lit("FormulaEngine")) | F.contains(low, F.lit("calculation")), "calculation")
        .when(F.contains(kind, F.lit("QASystem")) | F.contains(low, F.lit("search")), "search").when(F.contains(kind, F.lit("AgentLoop")), "agent").otherwise("other")
    )


def error_message(kind: Column, message: Column) -> Column:
    """What a user reads: by area first, then by class; a class without a text of its own shows its message."""
    m = F.coalesce(message, F.lit(""))
    fill = lambda template, own=m: F.replace(F.replace(F.lit(template), F.lit("{lib}"), F.coalesce(module_name(m), F.lit(UNNAMED_LIBRARY))), F.lit("{m}"), own)
    area = error_area(kind, m)
    out = None
    for name, template in AREA_ERRORS:
        out = F.when(area == name, fill(template)) if out is None else out.when(area == name, fill(template))
    for name, template in ERRORS:
        out = out.when(kind == name, fill(template))
    return out.otherwise(fill(OTHER_ERROR, F.when(m == "", UNKNOWN_ERROR).otherwise(m)))


def is_critical(kind: Column) -> Column:
    return kind.isin(*CRITICAL_ERRORS)


def error_summary(log: DataFrame, type_col: str, time_col: str, id_col: str) -> DataFrame:
    """(type, n, last_id, last_at): errors per type, with the last of each."""
    return log.groupBy(F.col(type_col).alias("type")).agg(F.count("*").alias("n"), F.max_by(id_col, F.struct(time_col, id_col)).alias("last_id"), F.max(time_col).alias("last_at"))
