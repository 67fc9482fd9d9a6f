"""Registered queries over whole tables. The SQL that checks them is in `oracles`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvara.config import SEARCH
from kelvara.functions import text as T
from kelvara.operators import agent, calculation, chunking, memory, providers, reporting, retrieval, tables
from kelvara.plans import fixtures, oracles, problems
from kelvara.session import cut_lineage, spread, table
from kelvara.texts import PROMPTS

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _questions(s: SparkSession, d: str) -> DataFrame:
    """The stated query set: every question whose id is divisible by SEARCH.query_step."""
    return table(s, d, "queries").where(F.col("query_id") % SEARCH.query_step == 0)


def _hits(s: SparkSession, d: str) -> DataFrame:
    return reporting.hits(table(s, d, "search_results"), table(s, d, "queries"))


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return chunking.stored_chunks(spread(table(s, d, "parsed_documents").select("parsed_id", "doc_name", "chunks")))


@query
def scan_counts_by_source(s, d):
    return table(s, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.count("text").alias("with_text"), F.sum("n_chars").alias("chars"))


@query
def docs_per_filetype(s, d):
    return table(s, d, "parsed_documents").groupBy("filetype").agg(F.count("*").alias("documents"))


@query
def supported_files(s, d):
    suffix = F.lower(F.regexp_extract("filepath", r"\.[^.]+$", 0))
    return table(s, d, "parsed_documents").where("filepath is not null").select("parsed_id", suffix.alias("suffix"), suffix.isin(".pdf", ".docx", ".doc", ".rtf").alias("supported"))


@query
def normalize_text(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", T.normalize(F.col("text")).alias("text"))


@query
def paragraph_split(s, d):
    p = T.paragraphs(T.normalize(F.col("text")))
    return table(s, d, "documents").select("doc_id", F.posexplode(p).alias("para_no", "text")).withColumn("para_no", F.col("para_no").cast("bigint"))


@query
def sentence_split(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("bigint"))


@query
def chunk_documents(s, d):
    return chunking.chunks(spread(table(s, d, "documents").select("doc_id", "text")))


@query
def smart_overlaps(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", T.smart_overlap(F.right("text", F.lit(200))).alias("overlap"))


@query
def formula_mentions(s, d):
    each = table(s, d, "documents").select("doc_id", F.posexplode(T.formulas(F.col("text"))).alias("pos", "raw"))
    return each.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "raw", F.array_join(T.variables(F.col("raw")), ",").alias("variables"))


@query
def agent_formulas(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(T.agent_formulas(F.col("text"))).alias("raw"))


@query
def table_like_flag(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", T.table_like(F.col("text")).alias("flag"))


@query
def doc_metadata(s, d):
    return reporting.document_metadata(spread(table(s, d, "documents").select("doc_id", "text")))


@query
def index_diagnostics(s, d):
    return reporting.index_diagnostics(table(s, d, "parsed_documents"))


@query
def token_stats(s, d):
    each = spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    return each.groupBy("token").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


@query
def term_vocabulary(s, d):
    return retrieval.vocabulary(retrieval.term_counts(_chunks(s, d)))


@query
def idf_table(s, d):
    c = _chunks(s, d)
    return retrieval.idf(retrieval.vocabulary(retrieval.term_counts(c)), c).select("term", "df", F.round("idf", 6).alias("idf"))


@query
def lexical_search(s, d):
    found = retrieval.search(_chunks(s, d), None, _questions(s, d), replace(SEARCH, semantic_weight=0.0, lexical_weight=1.0))
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "parsed_id", "chunk_id", F.col("score").alias("lexical"))


@query
def semantic_search(s, d):
    found = retrieval.semantic_search(table(s, d, "chunk_vectors"), _questions(s, d))
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", "semantic")


@query
def hybrid_search(s, d):
    found = retrieval.search(_chunks(s, d), table(s, d, "chunk_vectors"), _questions(s, d))
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "parsed_id", "chunk_id", "score")


@query
def hybrid_rank(s, d):
    scores = _hits(s, d).withColumn("score", SEARCH.semantic_weight * F.coalesce("semantic_score", F.lit(0.0)) + SEARCH.lexical_weight * F.coalesce("lexical_score", F.lit(0.0)))
    return retrieval.ranked(scores, "score", keys=("result_id",)).select("query_id", F.col("rank").cast("bigint").alias("rank"), "result_id", "score")


@query
def answer_sources(s, d):
    return reporting.sources(_hits(s, d)).select("query_id", F.col("ord").cast("bigint").alias("ord"), "doc_name", "score")


@query
def answer_context(s, d):
    return reporting.contexts(_hits(s, d))


@query
def extractive_answer(s, d):
    return reporting.extractive_answers(_hits(s, d))


@query
def find_definition(s, d):
    terms = table(s, d, "queries").select(agent.defined_term(F.col("query")).alias("term")).where("term is not null")
    return agent.term_definitions(terms, _chunks(s, d), ("parsed_id", "chunk_id"))


@query
def report_rows(s, d):
    h = _hits(s, d)
    return reporting.report_rows(reporting.extractive_answers(h), h)


@query
def pipe_tables(s, d):
    found = tables.rows_of(tables.pipe_tables(table(s, d, "parsed_documents"), "parsed_id"))
    return found.select("id", F.col("start").cast("bigint").alias("start"), (F.size("rows") - 1).cast("bigint").alias("data_rows"), "raw_text").where("data_rows >= 2")


@query
def keyword_tables(s, d):
    found = tables.keyword_tables(table(s, d, "parsed_documents"), "parsed_id")
    return found.select("id", F.col("start").cast("bigint").alias("start"), "title", "raw_text")


@query
def extract_tables(s, d):
    found = tables.extract_tables(table(s, d, "parsed_documents"), "parsed_id", source_col="doc_name")
    return found.select("id", F.col("table_no").cast("bigint").alias("table_no"), "kind", "title", F.col("data_rows").cast("bigint").alias("data_rows"), "confidence")


@query
def table_cells(s, d):
    cells = tables.table_cells(tables.extract_tables(table(s, d, "parsed_documents"), "parsed_id", source_col="doc_name"))
    return cells.select("id", *(F.col(c).cast("bigint").alias(c) for c in ("table_no", "row_no", "col_no")), "cell")


@query
def gsop_from_table(s, d):
    climate = tables.city_climate(tables.extract_tables(table(s, d, "parsed_documents"), "parsed_id", source_col="doc_name"), table(s, d, "cities"))
    rounded = F.round("t_ot", 1)
    return climate.select(
        "city", F.col("id").alias("parsed_id"), "t_ot", F.col("z_ot").cast("bigint").alias("z_ot"), F.round(calculation.gsop(F.lit(20.0), F.col("t_ot"), F.col("z_ot")), 6).alias("gsop"),
        F.round(calculation.ventilation_heat(F.lit(100.0), F.lit(20.0), rounded), 6).alias("ventilation"), F.round(calculation.heat_loss(F.lit(50.0), F.lit(20.0) - rounded, F.lit(3.2)), 6).alias("heat_loss"),
    )


@query
def formula_gsop(s, d):
    return table(s, d, "cities").select("name", F.round(calculation.gsop(F.lit(20.0), F.col("t_ot"), F.col("z_ot")), 6).alias("gsop"))


@query
def formula_ventilation(s, d):
    t_n = F.coalesce("t_n", F.col("t_ot") - 20)
    return table(s, d, "cities").select("name", t_n.alias("t_n"), F.round(calculation.ventilation_heat(F.lit(100.0), F.lit(20.0), t_n), 6).alias("heat"))


@query
def formula_heat_loss(s, d):
    t_n = F.coalesce("t_n", F.col("t_ot") - 20)
    return table(s, d, "cities").select("name", F.round(calculation.heat_loss(F.lit(50.0), F.lit(20.0) - t_n, F.lit(3.2)), 6).alias("loss"))


@query
def formula_layer_resistance(s, d):
    return table(s, d, "materials").select("material_id", F.round(calculation.layer_resistance(F.lit(0.1), F.col("lambda_value")), 6).alias("resistance"))


@query
def formula_insulation_thickness(s, d):
    return table(s, d, "materials").select("material_id", F.round(calculation.insulation_thickness(F.lit(3.2), F.col("lambda_value")), 6).alias("thickness"))


@query
def formula_heat_flux(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", T.rounded(calculation.heat_flux(F.col("l_extendedprice"), F.col("l_quantity"))).alias("flux"))


@query
def insulation_calculator(s, d):
    r = calculation.insulation(F.col("lambda_value"), F.lit(150.0), F.lit(20.0), F.lit(40.0), F.lit(0.1))
    return table(s, d, "materials").where("lambda_value is not null").select("material_id", F.round(r["delta_mm"], 6).alias("delta_mm"), r["recommended_mm"].alias("recommended_mm"), r["verdict"].alias("verdict"))


@query
def extract_params(s, d):
    p = calculation.parameters(F.col("query"))
    return table(s, d, "queries").select("query_id", *(c.alias(f"p_{n}") for n, c in p.items()))


@query
def detect_formula(s, d):
    return table(s, d, "queries").select("query_id", calculation.formula_key(F.col("query")).alias("formula")).where("formula is not null")


@query
def detect_city(s, d):
    # the cities are a fixed table of 40 rows
    names = F.broadcast(table(s, d, "cities").select("name"))
    hit = table(s, d, "queries").join(names, F.contains(F.lower("query"), F.lower("name")))
    return hit.groupBy("query_id").agg(F.min(F.struct((-F.length("name")).alias("n"), "name"))["name"].alias("city"))


@query
def calculation_answers(s, d):
    return calculation.answers(table(s, d, "queries")).withColumn("result", F.round("result", 6))


def _climate(s, d):
    """Climate tables: those in the first three hits of the first phrase that finds any; and whether there are some."""
    chunks = cut_lineage(_chunks(s, d))
    phrases = s.createDataFrame([(i + 1, x) for i, x in enumerate(calculation.CLIMATE_PHRASES)], "query_id bigint, query string")
    found = retrieval.search(chunks, None, phrases, replace(SEARCH, top_k=10, semantic_weight=0.0, lexical_weight=1.0)).where("rank <= 3")
    named = found.join(chunks, list(retrieval.KEY)).withColumn("result_id", F.col("parsed_id") * 1_000_000 + F.col("chunk_id"))
    # at most three chunks of two phrases, and ten tables of each
    mined = cut_lineage(tables.tables_of_hits(named.select("query_id", "rank", "result_id", "doc_name", "text")))
    first = mined.agg(F.min("query_id").alias("query_id")).first().query_id
    return mined.where(F.col("query_id") == F.lit(first)), first is not None


def _table_answers(s, d):
    mined, there = _climate(s, d)
    cities = table(s, d, "cities").select(F.col("name").alias("city"))
    asked = table(s, d, "queries").join(detect_city(s, d), "query_id").select("query_id", "query", "city")
    return calculation.table_answers(asked, tables.climate_of(mined, cities, ("hit", "place")), F.lit(there))


@query
def calculation_driver(s, d):
    found = calculation.driver(table(s, d, "queries"), _table_answers(s, d))
    return found.select("query_id", "formula", "path", "status", F.round("result", 6).alias("result"), "confidence")


@query
def table_calculations(s, d):
    return _table_answers(s, d).withColumn("result", F.round("result", 6))


def _fixture(s, rows):
    return s.createDataFrame(list(rows), "doc_id bigint, text string").withColumn("source", F.lit("d"))


@query
def marker_tables(s, d):
    return tables.marker_tables(_fixture(s, fixtures.MARKED)).select("id", F.col("start").cast("bigint").alias("start"), "title", "raw_text", F.size("lines").cast("bigint").alias("n"))


@query
def aligned_tables(s, d):
    return tables.aligned_tables(_fixture(s, fixtures.ALIGNED)).select("id", F.col("start").cast("bigint").alias("start"), "title", "raw_text", F.size("lines").cast("bigint").alias("n"))


@query
def fixture_tables(s, d):
    found = tables.extract_tables(_fixture(s, fixtures.MARKED + fixtures.ALIGNED + fixtures.MIXED), source_col="source")
    return found.select("id", F.col("table_no").cast("bigint").alias("table_no"), "kind", "title", F.col("data_rows").cast("bigint").alias("data_rows"), "confidence", F.array_join(F.get("rows", F.lit(0)), "¦").alias("head"))


@query
def hit_tables(s, d):
    found = tables.tables_of_hits(_hits(s, d))
    return found.select("query_id", "hit", "source", F.col("place").cast("bigint").alias("place"), "kind", "title", F.col("data_rows").cast("bigint").alias("data_rows"), "confidence")


@query
def hard_windows(s, d):
    docs = spread(table(s, d, "documents").where("text is not null").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(chunking.windows(T.normalize(F.col("text")))).alias("piece_no", "piece")).withColumn("piece_no", F.col("piece_no").cast("bigint"))


@query
def classify_queries(s, d):
    q = F.col("query")
    return table(s, d, "queries").where("query is not null").select("query_id", agent.query_type(q).alias("kind"), agent.route(q).alias("route"))


@query
def query_entities(s, d):
    e = agent.entities(F.col("query"))
    joined = {n: F.array_join(F.transform(c, lambda x: x.cast("string")) if n == "numeric_values" else c, "|") for n, c in e.items() if n != "numeric_values"}
    return table(s, d, "queries").where("query is not null").select("query_id", *(c.alias(n) for n, c in joined.items()), F.size(e["numeric_values"]).cast("bigint").alias("numeric_values"))


@query
def expand_queries(s, d):
    return table(s, d, "queries").select("query_id", F.posexplode(agent.variants(F.col("query"))).alias("ord", "variant")).withColumn("ord", F.col("ord").cast("bigint"))


@query
def rerank_hits(s, d):
    return agent.rerank(_hits(s, d)).select("query_id", F.col("new_rank").cast("bigint").alias("new_rank"), "result_id", "boosted")


def _agent_hits(s, d):
    asked = _questions(s, d).where(T.strip(F.col("query")) != "")
    typed = asked.select("query_id", "query", agent.query_type(F.col("query")).alias("query_type"))
    # read for the ids and again for the texts of the hits
    chunks = cut_lineage(_chunks(s, d))
    return agent.search_variants(chunks, table(s, d, "chunk_vectors"), asked.select("query_id", "query", "qvec"), memory.boosts(typed, _memory(s, d)))


@query
def agent_search(s, d):
    return _agent_hits(s, d).select("query_id", "kind", F.col("rank").cast("bigint").alias("place"), "parsed_id", "chunk_id", "doc_name", "score")


@query
def qa_answers(s, d):
    chunks = cut_lineage(_chunks(s, d))
    found = retrieval.search(chunks, table(s, d, "chunk_vectors"), _questions(s, d)).join(chunks.select(*retrieval.KEY, "doc_name", "text"), list(retrieval.KEY))
    found = cut_lineage(found.withColumn("result_id", F.col("rank").cast("bigint")))
    out = reporting.answer_records(_questions(s, d), found)
    return out.withColumn("sources", F.array_join("sources", "|"))


@query
def agent_trace(s, d):
    found = cut_lineage(_agent_hits(s, d).withColumn("result_id", F.col("rank").cast("bigint")).withColumnRenamed("kind", "query_type"))
    told = agent.answer(_questions(s, d), found).join(agent.context_parameters(found).select("query_id", F.col("confidence").alias("relevance")), "query_id", "left")
    return reporting.trace(told.withColumn("found", F.col("relevance").isNotNull()))


@query
def context_params(s, d):
    return agent.context_parameters(_hits(s, d)).withColumn("confidence", F.round("confidence", 6))


@query
def regulatory_sentences(s, d):
    return agent.requirements(_chunks(s, d), ("parsed_id", "chunk_id"))


@query
def completeness_check(s, d):
    h = table(s, d, "queries").where("query is not null")
    rows = h.select(
        "query_id", agent.query_type(F.col("query")).alias("kind"), F.col("query").alias("answer"), calculation.formula_key(F.col("query")).isNotNull().alias("has_formula"), (F.size(T.numbers(F.col("query"))) > 0).alias("has_parameters")
    )
    return agent.completeness(rows).select("query_id", "needs_clarification", "questions", F.round("completeness", 6).alias("completeness"))


def _memory(s, d):
    h = _hits(s, d)
    found = h.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("rank", "doc_name"))), lambda x: x["doc_name"]).alias("sources"))
    q = table(s, d, "queries").where("query is not null")
    log = q.join(found, "query_id").select(F.col("query_id").alias("seq"), "query", "query_type", F.col("asked_at").alias("used_at"), T.keywords(F.col("query")).alias("keywords"), F.array_distinct("sources").alias("sources"))
    return memory.remember(log)


@query
def memory_upsert(s, d):
    return _memory(s, d).select("pattern", "query_type", "success_count", "first_seq", F.array_join("keywords", "|").alias("keywords"), F.array_join("sources", "|").alias("sources"), F.array_join("boost_terms", "|").alias("boost_terms"))


@query
def memory_boosts(s, d):
    return memory.boosts(_questions(s, d).where("query is not null"), _memory(s, d)).withColumn("ord", F.col("ord").cast("bigint"))


@query
def memory_stats(s, d):
    return memory.statistics(_memory(s, d)).withColumn("avg_success", F.round("avg_success", 6))


@query
def memory_top(s, d):
    return _memory(s, d).orderBy(F.desc("success_count"), "pattern", "query_type").limit(10).select("pattern", "query_type", "success_count")


@query
def glossary_lookup(s, d):
    # the fixed table of quantities, in alphabetical order
    name = F.lower(F.get(F.split("names", "; "), F.lit(0)))
    glossary = table(s, d, "common_units").select(name.alias("ord"), name.alias("term"), F.col("common_unit").alias("definition"))
    terms = table(s, d, "extracted_tables").select(F.explode("headers").alias("term")).distinct()
    return agent.glossary_lookup(terms, glossary)


def _asked_terms(s, d):
    return table(s, d, "queries").select("query_id", agent.defined_term(F.col("query")).alias("term")).where("term <> ''")


@query
def quick_definitions(s, d):
    return agent.quick_definitions(_asked_terms(s, d).select("term").distinct())


@query
def definition_fallback(s, d):
    return agent.definition_fallback(_asked_terms(s, d), _hits(s, d))


@query
def error_messages(s, d):
    rows = s.createDataFrame(list(fixtures.ERRORS), "id bigint, kind string, message string")
    kind, message = F.col("kind"), F.col("message")
    return rows.select("id", reporting.error_message(kind, message).alias("user_message"), reporting.error_area(kind, message).alias("area"), reporting.module_name(message).alias("module"), reporting.is_critical(kind).alias("critical"))


@query
def document_entities(s, d):
    return reporting.entities(table(s, d, "documents"))


@query
def formula_operators(s, d):
    each = table(s, d, "documents").select("doc_id", F.explode(T.formulas(F.col("text"))).alias("raw"))
    return each.select("doc_id", "raw", T.has_operator(F.col("raw")).alias("has_operator"))


@query
def graph_top_nodes(s, d):
    return reporting.top_nodes(reporting.mention_graph(table(s, d, "parsed_documents"))).select("node", "type", "degree")


@query
def memory_of_type(s, d):
    return memory.by_type(_memory(s, d), "definition").select("pattern", "success_count")


@query
def hit_table_records(s, d):
    r = tables.records_of(tables.tables_of_hits(_hits(s, d)))
    return r.select("query_id", F.col("place").cast("bigint").alias("place"), "title", F.array_join("headers", "¦").alias("headers"), F.col("row_count").cast("bigint").alias("row_count"), "content", "doc_name")


@query
def kind_prompts(s, d):
    # what a prompt asks for besides the question, its context, term and compared things stays empty here
    q = table(s, d, "queries").where("query is not null").select("query_id", "query", agent.query_type(F.col("query")).alias("kind"))
    rows = q.join(reporting.contexts(_hits(s, d)), "query_id", "left")
    two = agent.compared_items(F.col("query"))
    rows = rows.withColumn("term", agent.defined_term(F.col("query"))).withColumn("first", F.get(two, F.lit(0))).withColumn("second", F.get(two, F.lit(1))).withColumn("none", F.lit(""))
    out = None
    for kind in ("search", "calculation", "definition", "comparison", "regulatory"):
        names = {name: name if name in rows.columns else "none" for _, name in PROMPTS[kind][1]}
        made = providers.prompts(providers.prompt_template(kind), **names)
        out = F.when(F.col("kind") == kind, made) if out is None else out.when(F.col("kind") == kind, made)
    return rows.select("query_id", "kind", out.alias("prompt"))


@query
def full_reports(s, d):
    h = _hits(s, d)
    return reporting.full_report(reporting.extractive_answers(h), h, tables.tables_of_hits(h), agent.formulas_of_hits(h))


@query
def error_summary(s, d):
    return reporting.error_summary(table(s, d, "events"), "event_type", "ts", "event_id")


@query
def chat_turns(s, d):
    return reporting.turns(table(s, d, "documents"))


@query
def standards_mentioned(s, d):
    return reporting.mentions(table(s, d, "documents"))


@query
def mention_graph(s, d):
    return reporting.mention_graph(table(s, d, "parsed_documents"))


@query
def graph_statistics(s, d):
    return reporting.graph_statistics(reporting.mention_graph(table(s, d, "parsed_documents"))).withColumn("density", F.round("density", 9))


@query
def useful_chunks(s, d):
    return agent.useful_chunks(_hits(s, d)).select("query_id", "result_id")


@query
def hit_formulas(s, d):
    return agent.formulas_of_hits(_hits(s, d))


@query
def shortened_results(s, d):
    return table(s, d, "search_results").where("text is not null").select("result_id", T.shortened(F.col("text"), 200).alias("text"))


@query
def formula_registry(s, d):
    return calculation.registry(s)


@query
def agent_answers(s, d):
    found = cut_lineage(_agent_hits(s, d).withColumn("result_id", F.col("rank").cast("bigint")).withColumnRenamed("kind", "query_type"))
    return agent.answer(_questions(s, d), found)


@query
def table_plans(s, d):
    city = detect_city(s, d)
    asked = table(s, d, "queries").join(city, "query_id").select("query_id", "city", calculation.table_plan(F.col("query"), F.col("city")).alias("plan"))
    return asked.where("plan is not null")


@query
def prompts(s, d):
    template = "Вопрос: {q}\n\nКонтекст:\n{c}\n\nОтвет:"
    rows = reporting.contexts(_hits(s, d)).join(table(s, d, "queries").select("query_id", "query"), "query_id")
    return rows.select("query_id", providers.prompts(template, q="query", c="context").alias("prompt"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search for the stated query set."""
    return hybrid_search(spark, sf_dir)


def queries() -> dict[str, Query]:
    return _QUERIES | problems.queries()


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.sql().items() if k in _QUERIES}
