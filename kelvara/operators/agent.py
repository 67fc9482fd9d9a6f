"""Question routing, analysis, query expansion, re-ranking and the rule-based answers, each as a projection or join over sets of questions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelvara import lexicons as L
from kelvara.functions import text as T
from kelvara.config import SEARCH
from kelvara.operators import calculation, reporting, retrieval
from kelvara.texts import GLOSSARY


def query_type(query: Column) -> Column:
    """calculation, definition, comparison, regulatory or search; the first whose trigger the question has."""
    q = F.trim(F.lower(query))
    return (
        F.when(T.contains_any(q, L.CALC_TRIGGERS), "calculation").when(T.starts_with_any(q, L.DEFINITION_PREFIXES), "definition")
        .when(T.contains_any(q, L.COMPARISON_TRIGGERS), "comparison").when(T.contains_any(q, L.REGULATORY_TRIGGERS), "regulatory").otherwise("search")
    )


def route(query: Column) -> Column:
    """definition, calculation, table or agent."""
    q = F.lower(T.strip(query))
    return (
        F.when(T.starts_with_any(q, L.DEFINITION_PREFIXES), "definition").when(T.contains_any(q, L.APP_CALC_TRIGGERS), "calculation")
        .when(T.contains_any(q, L.APP_TABLE_TRIGGERS), "table").otherwise("agent")
    )


def defined_term(query: Column) -> Column:
    """What a definition question asks for: without its first trigger and punctuation at the ends; null for other questions."""
    q = F.lower(T.strip(query))
    out = None
    for p in L.DEFINITION_PREFIXES:
        term = F.btrim(F.substring(q, F.lit(len(p) + 1), F.length(q)), F.lit(" ?!.,:;\"'«»()[]"))
        out = F.when(F.startswith(q, F.lit(p)), term) if out is None else out.when(F.startswith(q, F.lit(p)), term)
    return out


def entities(query: Column) -> dict[str, Column]:
    return {
        "document_codes": T.every(query, T.DOCUMENT_CODE), "section_refs": T.every(query, T.SECTION_REF),
        "domain_terms": T.domain_terms(query, L.STOP_WORDS), "numeric_values": T.numbers(query),
    }


def variants(query: Column, boosts: Column | None = None, most: int = 4) -> Column:
    """Search variants of a question in order, distinct without regard to case: itself, codes with terms, sections with terms, terms, terms
    with remembered ones."""
    e = entities(query)
    terms = e["domain_terms"]
    joined = lambda *parts: F.trim(F.array_join(F.concat(*parts), " "))
    some = [
        query,
        F.when(F.size(e["document_codes"]) > 0, joined(F.slice(e["document_codes"], 1, 2), F.slice(terms, 1, 4))),
        F.when(F.size(e["section_refs"]) > 0, joined(F.slice(e["section_refs"], 1, 2), F.slice(terms, 1, 4))),
        F.when(F.size(terms) > 0, joined(F.slice(terms, 1, 8))),
    ]
    if boosts is not None:
        some.append(F.when(F.size(boosts) > 0, joined(F.slice(terms, 1, 5), F.slice(boosts, 1, 3))))
    kept = F.filter(F.transform(F.array(*some), T.strip), lambda v: v.isNotNull() & (v != ""))
    first = F.filter(kept, lambda v, i: ~F.exists(F.slice(kept, 1, F.greatest(i, F.lit(0))), lambda o: F.lower(o) == F.lower(v)))
    return F.slice(first, 1, most)


#: Chunks per variant by kind of question. Fixed values.
TOP_K_MOST = 14


def top_k(kind: Column) -> Column:
    return F.when(kind == "calculation", 8).when(kind == "regulatory", 14).otherwise(12)


def boosted_score(query: Column, doc_name: Column, text: Column, score: Column, preferred: Column | None = None) -> Column:
    """A hit's score with its boosts: a remembered source 0.20, a code in name or text 0.35, a section 0.20, terms up to 0.25."""
    name, low = F.lower(F.coalesce(doc_name, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    codes = F.transform(T.every(query, T.DOCUMENT_CODE), F.lower)
    refs = F.transform(T.every(query, T.SECTION_REF), F.lower)
    terms = F.slice(T.domain_terms(query, L.STOP_WORDS), 1, 8)
    hits = F.size(F.filter(terms, lambda t: F.contains(low, t)))
    out = F.coalesce(score, F.lit(0.0))
    if preferred is not None:
        out = out + F.when(F.exists(F.coalesce(preferred, F.expr("cast(array() as array<string>)")), lambda s: F.contains(name, F.lower(s))), 0.20).otherwise(0.0)
    out = out + F.when(F.exists(codes, lambda c: F.contains(name, c) | F.contains(low, c)), 0.35).otherwise(0.0)
    out = out + F.when(F.exists(refs, lambda r: F.contains(low, r)), 0.20).otherwise(0.0)
    return out + F.least(F.lit(0.25), hits * F.lit(0.03))


def rerank(hits: DataFrame) -> DataFrame:
    """Hits (query_id, query, rank, doc_name, chunk_id, text, score) re-ranked: distinct by source and beginning, boosted, cut by kind of
    question. Ties by the earlier rank."""
    once = Window.partitionBy("query_id", "doc_name", F.substring("text", 1, 250)).orderBy("rank", "chunk_id")
    boosted = hits.withColumn("n", F.row_number().over(once)).where("n = 1").withColumn("boosted", T.rounded(boosted_score(F.col("query"), F.col("doc_name"), F.col("text"), F.col("score"))))
    order = Window.partitionBy("query_id").orderBy(F.desc("boosted"), "rank", "doc_name", "chunk_id")
    return boosted.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= top_k(query_type(F.col("query"))))


#: Quantities read from context. Fixed values.
CONTEXT = {
    "temperature": r"(-?\d+[.,]?\d*)\s*°[СC]", "thickness": r"(\d+[.,]?\d*)\s*мм", "density": r"(\d+[.,]?\d*)\s*кг/м³", "flow": r"(\d+[.,]?\d*)\s*м³/ч",
    "power": r"(\d+[.,]?\d*)\s*кВт", "resistance": r"(\d+[.,]?\d*)\s*м²·°С/Вт",
}


def context_parameters(hits: DataFrame) -> DataFrame:
    """(query_id, six quantities, confidence): the first mention of each in the first three hits; the question's own numbers stand in for
    temperature and flow. confidence is the share of hits scored above 0.5, or 0.5 where that is none."""
    per = hits.groupBy("query_id").agg(
        F.first("query").alias("query"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "result_id", F.coalesce("text", F.lit("")).alias("text"))))), lambda s: s["text"]), "\n").alias("text"),
        F.avg((F.coalesce("score", F.lit(0.0)) > 0.5).cast("double")).alias("good"),
    )
    read = {n: F.replace(F.nullif(F.regexp_extract("text", p, 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double") for n, p in CONTEXT.items()}
    own = T.numbers(F.col("query"))
    read["temperature"] = F.coalesce(read["temperature"], F.get(own, F.lit(0)))
    read["flow"] = F.coalesce(read["flow"], F.get(own, F.lit(1)))
    return per.select("query_id", *(c.alias(n) for n, c in read.items()), F.when(F.col("good") > 0, F.col("good")).otherwise(0.5).alias("confidence"))


def compared_items(query: Column) -> Column:
    parts = F.split(F.lower(query), r"\s+и\s+|\s+vs\s+|\s+против\s+")
    return F.when(F.size(parts) > 1, F.filter(F.transform(parts, T.strip), lambda p: F.length(p) > 2))


def compare(hits: DataFrame) -> DataFrame:
    """(query_id, item, info, source): every compared item with the first hit that contains it; items without one are left out."""
    each = hits.select("query_id", F.explode(compared_items(F.col("query"))).alias("item"), "rank", "result_id", "doc_name", "text").where(F.contains(F.lower("text"), F.col("item")))
    first = each.groupBy("query_id", "item").agg(F.min(F.struct("rank", "result_id", "doc_name", "text")).alias("f"))
    return first.select("query_id", "item", F.substring("f.text", 1, 200).alias("info"), F.col("f.doc_name").alias("source"))


def requirements(chunks: DataFrame, keys: tuple[str, ...], markers: tuple[str, ...] = L.REGULATORY_MARKERS) -> DataFrame:
    """(keys, marker, sentence): per chunk and marker the first sentence that has it."""
    text = F.col("text")
    pairs = F.array(*[F.struct(F.lit(m).alias("marker"), T.strip(T.first_sentence_with(text, F.lit(m))).alias("sentence")) for m in markers])
    some = chunks.where(T.contains_any(F.lower(text), markers)).select(*keys, F.explode(F.filter(pairs, lambda p: p["sentence"].isNotNull())).alias("p"))
    return some.select(*keys, "p.marker", "p.sentence")


def definitions(hits: DataFrame) -> DataFrame:
    """(query_id, term, definition, source): for every definition question the first hit with a sentence that defines the term."""
    asked = hits.withColumn("term", defined_term(F.col("query"))).where("term <> ''")
    found = asked.withColumn("sentence", T.best_definition(F.col("text"), F.col("term"))).where("sentence is not null")
    first = found.groupBy("query_id", "term").agg(F.min(F.struct("rank", "result_id", "sentence", "doc_name")).alias("f"))
    return first.select("query_id", "term", F.col("f.sentence").alias("definition"), F.col("f.doc_name").alias("source"))


#: Distinct terms up to which every sentence is held against all of them; beyond it both meet on letter triples.
SENT_TERMS = 2_000


def term_definitions(terms: DataFrame, chunks: DataFrame, keys: tuple[str, ...], longest: int = 100) -> DataFrame:
    """(term, definition, keys): for every term the shortest sentence of all chunks that contains it, below `longest` characters; the earliest
    chunk among equals. A term may stand inside a word. Few terms are sent to the sentences; many meet them on the term's first three
    letters, so that no term is held against every sentence. Blank and null terms are left out."""
    asked = terms.select(F.lower(T.strip(F.col("term"))).alias("term")).where("term <> ''").distinct()
    short = chunks.select(*keys, F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).where(F.length("sentence") < longest)
    few = asked.limit(SENT_TERMS + 1).count() <= SENT_TERMS
    if few:
        hit = short.join(F.broadcast(asked), F.contains(F.lower("sentence"), F.col("term")))
    else:
        low = F.lower("sentence")
        triples = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - 2)), lambda i: F.substring(low, i, F.lit(3)))
        grams = short.select("*", F.explode(F.array_distinct(triples)).alias("gram"))
        long = grams.join(asked.where(F.length("term") >= 3).select("term", F.substring("term", 1, 3).alias("gram")), "gram").drop("gram")
        hit = long.where(F.contains(low, F.col("term"))).unionByName(short.join(asked.where(F.length("term") < 3), F.contains(low, F.col("term"))))
    best = hit.groupBy("term").agg(F.min(F.struct(F.length("sentence").alias("n"), *keys, "pos", "sentence")).alias("f"))
    return best.select("term", T.strip(F.col("f.sentence")).alias("definition"), *(F.col(f"f.{k}").alias(k) for k in keys))


def completeness(answers: DataFrame) -> DataFrame:
    """Adds needs_clarification, questions bigint and completeness to answers (kind, answer, has_formula, has_parameters)."""
    calc = F.col("kind") == "calculation"
    no_formula, short = calc & ~F.col("has_formula"), F.length(T.strip(F.coalesce("answer", F.lit("")))) < 20
    asked = no_formula.cast("bigint") + (calc & ~F.col("has_parameters")).cast("bigint") + (short & ~no_formula).cast("bigint")
    return answers.withColumn("needs_clarification", no_formula | short).withColumn("questions", asked).withColumn("completeness", F.greatest(F.lit(0.0), 1.0 - F.col("questions") * 0.2))


def definition_fallback(terms: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, term, definition, source): for every asked term (query_id, term) the first sentence that contains it in the first hit that does; whatever
    its length."""
    asked = hits.join(terms.where("term <> ''").select("query_id", "term"), "query_id").withColumn("sentence", T.first_sentence_with(F.col("text"), F.col("term"))).where("sentence is not null")
    first = asked.groupBy("query_id", "term").agg(F.min(F.struct("rank", "result_id", "sentence", "doc_name")).alias("f"))
    return first.select("query_id", "term", T.strip(F.col("f.sentence")).alias("definition"), F.col("f.doc_name").alias("source"))


def quick_definitions(terms: DataFrame) -> DataFrame:
    """(term, entry, definition, source, example) from the built-in glossary (about 35 entries)."""
    spark = terms.sparkSession
    glossary = spark.createDataFrame([(i, *g) for i, g in enumerate(GLOSSARY)], "ord int, term string, definition string, source string, example string")
    found = glossary_lookup(terms, glossary)
    return found.join(F.broadcast(glossary.select(F.col("term").alias("entry"), "source", "example")), "entry").select("term", "entry", "definition", "source", "example")


def glossary_lookup(terms: DataFrame, glossary: DataFrame) -> DataFrame:
    """(term, entry, definition): the entry equal to the term, else the first entry (by ord) that contains it or is contained in it. The glossary is
    a fixed table."""
    asked = terms.select("term", F.lower(T.strip(F.col("term"))).alias("t")).where("t <> ''").distinct()
    hit = asked.join(F.broadcast(glossary.select("ord", F.col("term").alias("entry"), "definition")), F.contains("t", F.col("entry")) | F.contains("entry", F.col("t")))
    first = hit.groupBy("term").agg(F.min(F.struct((F.col("t") != F.col("entry")).alias("differs"), "ord", "entry", "definition")).alias("f"))
    return first.select("term", "f.entry", "f.definition")


def useful_chunks(hits: DataFrame, least: int = 30, otherwise: int = 2) -> DataFrame:
    """Hits with more than `least` characters; of questions without any, the first `otherwise`."""
    w = Window.partitionBy("query_id")
    long = F.length(T.strip(F.coalesce("text", F.lit("")))) > least
    marked = hits.withColumn("long", long).withColumn("any", F.max("long").over(w)).withColumn("place", F.row_number().over(w.orderBy("rank", "result_id")))
    return marked.where(F.col("long") | (~F.col("any") & (F.col("place") <= otherwise))).drop("long", "any", "place")


def formulas_of_hits(hits: DataFrame, first: int = 3, each: int = 3) -> DataFrame:
    """(query_id, raw, source): formulas of the first hits, a few of each, every formula once with its first source."""
    top = hits.where(F.col("rank") <= first).select("query_id", "rank", "result_id", "doc_name", F.posexplode(F.slice(T.every(F.col("text"), T.FORMULA), 1, each)).alias("pos", "raw"))
    once = top.groupBy("query_id", "raw").agg(F.min(F.struct("rank", "result_id", "pos", "doc_name")).alias("f"))
    return once.select("query_id", "raw", F.col("f.doc_name").alias("source"))


def search_variants(chunks: DataFrame, vectors: DataFrame | None, queries: DataFrame, boosts: DataFrame, dims: int = 64) -> DataFrame:
    """(query_id, query, kind, rank, doc_name, parsed_id, chunk_id, text, score): the agent's search. Every question's variants are searched, each
    for as many chunks as its kind asks for; the hits are united, the first variant first, distinct by source and the text's first 250 characters,
    boosted (remembered sources, codes, sections, terms) and cut again.

    queries: query_id, query, qvec; boosts: the rows of memory.boosts for these questions under their own kind. A variant is embedded as its
    question is. Blank and null questions give no row; ties go by variant, rank and key. chunks: keys, doc_name, text.
    """
    # an id of a variant: four of each question
    most = 4
    item = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("boost") == kind, F.struct("ord", "item")))), lambda x: x["item"])
    remembered = boosts.withColumnRenamed("kind", "boost").groupBy("query_id").agg(item("source").alias("sources"), item("term").alias("terms"))
    asked = queries.where(T.strip(F.col("query")) != "").join(remembered, "query_id", "left").withColumn("kind", query_type(F.col("query")))
    spelled = asked.select("*", F.posexplode(variants(F.col("query"), F.col("terms"), most)).alias("ord", "variant"))
    sought = spelled.select((F.col("query_id") * most + F.col("ord")).alias("query_id"), F.col("variant").alias("query"), "qvec")
    found = retrieval.search(chunks, vectors, sought, replace(SEARCH, top_k=TOP_K_MOST), dims).withColumn("ord", F.pmod("query_id", F.lit(most))).withColumn("query_id", F.expr(f"query_id div {most}"))
    told = found.select("query_id", "ord", "rank", *retrieval.KEY, "score").join(asked.select("query_id", "query", "kind", "sources"), "query_id").where(F.col("rank") <= top_k(F.col("kind")))
    named = told.join(chunks.select(*retrieval.KEY, "doc_name", "text"), list(retrieval.KEY))
    first = Window.partitionBy("query_id", "doc_name", F.substring("text", 1, 250)).orderBy("ord", "rank", *retrieval.KEY)
    once = named.withColumn("n", F.row_number().over(first)).where("n = 1")
    once = once.withColumn("score", T.rounded(boosted_score(F.col("query"), F.col("doc_name"), F.col("text"), F.col("score"), F.col("sources"))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord", F.col("rank"), *retrieval.KEY)
    ranked = once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k(F.col("kind")))
    return ranked.select("query_id", "query", "kind", F.col("place").alias("rank"), "doc_name", *retrieval.KEY, "text", "score")


def answer(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, kind, answer, confidence, needs_clarification, questions, completeness): every question answered by its kind: a calculation, a
    definition, a comparison, requirements, or else the beginning of the best hits. One plan over all questions; the parts meet on
    query_id, each aggregated before the join."""
    asked = queries.where("query is not null").select("query_id", "query", query_type(F.col("query")).alias("kind"))
    lines = lambda c, order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[c]), "\n")
    calc = calculation.answers(asked).select("query_id", "formula", "missing", "result", "status", F.col("confidence").alias("calc_confidence"))
    defined = definitions(hits).groupBy("query_id").agg(F.min("definition").alias("definition"))
    compared = compare(hits).withColumn("line", F.concat_ws(": ", "item", "info")).groupBy("query_id").agg(lines("line", "item").alias("comparison"))
    ruled = requirements(hits.where(query_type(F.col("query")) == "regulatory"), ("query_id", "rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "marker"))
    ruled = ruled.withColumn("n", place).where("n <= 5").groupBy("query_id").agg(lines("sentence", "n").alias("rules"))
    found = reporting.extractive_answers(hits).withColumnRenamed("answer", "found")
    all_ = asked
    for part in (calc, defined, compared, ruled, found):
        all_ = all_.join(part, "query_id", "left")
    value = F.when(F.col("status") == "ok", F.format_string("%s = %.2f", "formula", "result")).when(F.col("missing") != "", F.concat(F.lit("missing: "), "missing"))
    text = (
        F.when(F.col("kind") == "calculation", value).when(F.col("kind") == "definition", F.col("definition")).when(F.col("kind") == "comparison", F.col("comparison"))
        .when(F.col("kind") == "regulatory", F.col("rules"))
    )
    confidence = F.when((F.col("kind") == "calculation") & F.col("formula").isNotNull(), F.col("calc_confidence")).when(text.isNotNull(), 0.8).when(F.col("found").isNotNull(), 0.7).otherwise(0.2)
    rows = all_.select(
        "query_id", "kind", F.coalesce(text, "found").alias("answer"), confidence.alias("confidence"), F.col("formula").isNotNull().alias("has_formula"), (F.size(T.numbers(F.col("query"))) > 0).alias("has_parameters")
    )
    return completeness(rows).drop("has_formula", "has_parameters")
