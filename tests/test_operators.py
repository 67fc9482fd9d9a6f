import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from kelvara.config import Search
from kelvara.operators import agent, calculation, memory, reporting, retrieval, tables


def ask(spark, text, column):
    return spark.createDataFrame([(text,)], "query string").select(column.alias("r")).first().r


def test_parameters(spark):
    p = calculation.parameters(F.col("query"))
    row = lambda text: spark.createDataFrame([(text,)], "query string").select(*(c.alias(n) for n, c in p.items())).first()
    got = row("Рассчитай ГСОП tв=20 tот=-3,1 zот=214")
    assert (got.t_v, got.t_ot, got.z_ot) == (20.0, -3.1, 214.0)
    got = row("сопротивление 3,2 площадь 50")
    assert (got.R, got.A) == (3.2, 50.0)
    got = row("требуемое сопротивление 3,2")
    assert (got.R, got.R_tr) == (3.2, 3.2)
    got = row("lambda 0,04")
    assert (got.lambda_value, got.A) == (0.04, 0.04)


def test_formulas(spark):
    lit = F.lit
    values = [
        (calculation.gsop(lit(20.0), lit(-3.1), lit(214)), 4943.4), (calculation.ventilation_heat(lit(100.0), lit(20.0), lit(-3.1)), 773.85),
        (calculation.heat_loss(lit(50.0), lit(40.0), lit(3.2)), 625.0), (calculation.heat_loss(lit(50.0), lit(40.0), lit(0.0)), None),
        (calculation.layer_resistance(lit(0.1), lit(0.04)), 2.5), (calculation.insulation_thickness(lit(3.2), lit(0.04)), 0.128), (calculation.heat_flux(lit(1000.0), lit(25.0)), 40.0),
    ]
    row = spark.range(1).select(*(v.alias(f"c{i}") for i, (v, _) in enumerate(values))).first()
    for got, (_, want) in zip(row, values):
        assert (got is None and want is None) or math.isclose(got, want)
    r = calculation.insulation(lit(0.045), lit(150.0), lit(20.0), lit(40.0), lit(0.1))
    got = spark.range(1).select(*(c.alias(n) for n, c in r.items())).first()
    assert math.isclose(got.delta_mm, 141.75) and got.recommended_mm == 140.0 and got.verdict == "ok"


def test_calculation_answers(spark):
    rows = [(1, "Рассчитай ГСОП tв=20 tот=-3,1 zот=214"), (2, "Посчитай теплопотери, площадь 50"), (3, "привет"), (4, None), (5, "сопротивление слоя delta 0.1 lambda 0")]
    got = {r.query_id: r for r in calculation.answers(spark.createDataFrame(rows, "query_id bigint, query string")).collect()}
    assert set(got) == {1, 2, 5}
    assert got[1].status == "ok" and math.isclose(got[1].result, 4943.4) and got[1].confidence == 0.9
    assert got[2].status == "missing" and got[2].missing == "delta_t,R"
    assert got[5].status == "error" and got[5].confidence == 0.0


def test_city(spark):
    assert ask(spark, "климат: санкт-петербург и уфа", calculation.city_in(F.col("query"))) == "санкт-петербург"
    assert ask(spark, "погода в Москве", calculation.city_in(F.col("query"))) is None


def test_routing(spark):
    assert ask(spark, "Что такое ГСОП?", agent.route(F.col("query"))) == "definition"
    assert ask(spark, "Что такое ГСОП?", agent.query_type(F.col("query"))) == "calculation"
    assert ask(spark, "Что такое «точка росы»?", agent.defined_term(F.col("query"))) == "точка росы"
    assert ask(spark, "покажи таблицу 5", agent.route(F.col("query"))) == "table"


def test_variants(spark):
    got = ask(spark, "Требования СП 50.13330 раздел 5.2 к окнам", agent.variants(F.col("query")))
    assert got[0] == "Требования СП 50.13330 раздел 5.2 к окнам" and len(got) == 4 and got[1].startswith("СП 50.13330 ")


HITS = "query_id bigint, query string, query_type string, rank int, result_id bigint, doc_name string, chunk_id int, text string, score double"


def test_compare_takes_the_first_hit(spark):
    rows = [(1, "минвата и пеностекло", None, r, r, f"d{r}", 0, t, 0.5) for r, t in ((1, "про пеностекло"), (2, "Минвата лучше"), (3, "минвата снова"))]
    got = {r["item"]: r.source for r in agent.compare(spark.createDataFrame(rows, HITS)).collect()}
    assert got == {"минвата": "d2", "пеностекло": "d1"}


def test_rerank_boosts_codes_and_drops_copies(spark):
    rows = [(1, "СП 50.13330 окна", None, 1, 1, "a", 0, "прочее", 0.5), (1, "СП 50.13330 окна", None, 2, 2, "a", 1, "прочее", 0.5), (1, "СП 50.13330 окна", None, 3, 3, "b", 0, "по СП 50.13330 окна", 0.4)]
    got = [(r.result_id, r.boosted) for r in agent.rerank(spark.createDataFrame(rows, HITS)).orderBy("new_rank").collect()]
    assert [g[0] for g in got] == [3, 1] and math.isclose(got[0][1], 0.4 + 0.35 + 0.06, abs_tol=1e-6)


def test_requirements_first_sentence_per_marker(spark):
    df = spark.createDataFrame([(1, "Воздух. Слой не менее 5 мм. Не менее двух слоёв требуется."), (2, None), (3, "")], "k bigint, text string")
    got = {(r.marker, r.sentence) for r in agent.requirements(df, ("k",)).collect()}
    assert got == {("не менее", "Слой не менее 5 мм."), ("требуется", "Не менее двух слоёв требуется.")}


def test_completeness(spark):
    df = spark.createDataFrame([("search", "x" * 19, True, True), ("search", "x" * 20, False, False), ("calculation", "", False, False)], "kind string, answer string, has_formula boolean, has_parameters boolean")
    got = [(r.needs_clarification, r.questions, round(r.completeness, 2)) for r in agent.completeness(df).collect()]
    assert got == [(True, 1, 0.8), (False, 0, 1.0), (True, 2, 0.6)]


def test_glossary(spark):
    glossary = spark.createDataFrame([(0, "гсоп", "сумма"), (1, "точка росы", "температура")], "ord int, term string, definition string")
    terms = spark.createDataFrame([("ГСОП ",), ("точка росы",), ("о",), ("",), (None,), ("нет",)], "term string")
    got = {r.term: r.entry for r in agent.glossary_lookup(terms, glossary).collect()}
    assert got == {"ГСОП ": "гсоп", "точка росы": "точка росы", "о": "гсоп"}


DOCS = "doc_id bigint, text string"


def mined(spark, text):
    return [(r.kind, r.data_rows, r.confidence, r.title) for r in tables.extract_tables(spark.createDataFrame([(1, text)], DOCS)).collect()]


def test_tables(spark):
    assert mined(spark, "|a|b|c|\n|---|---|---|\n|1|2|3|\n|4|5|6|") == [("pipe", 2, 0.85, None)]
    assert mined(spark, "x | y\n1 | 2\n3 | 4\n5 | 6") == []
    assert mined(spark, "|a|b|\n|:---:|:---:|\n|1|2|")[0][1] == 2
    assert mined(spark, "Имя\n[ТАБЛИЦА 1]\na b\n1 2\n3 4\n\nx") == [("marker", 2, 0.95, "Имя")]
    assert mined(spark, "[ТАБЛИЦА 1]\na\n[ТАБЛИЦА 2]\nb\nc\nd") == [("marker", 2, 0.95, "a")]
    assert mined(spark, "[ТАБЛИЦА 1]\na\nb\nc") == [("marker", 2, 0.95, "Таблица 1")]
    assert mined(spark, "a  b  1\nc  d  2\ne  f  3") == [("aligned", 2, 0.7, None)]
    assert mined(spark, "Значения:\n1 мм\n2 мм\n3 мм") == [("keyword", 2, 0.6, "Значения:")]
    assert mined(spark, "|a|b|c|\n|1|2|3|") == []
    for text in (None, "", " "):
        assert mined(spark, text) == []


def test_city_climate(spark):
    docs = spark.createDataFrame([(1, "|Город|t|z|\n|Москва|-3,1|214|\n|Уфа|-6|220|")], DOCS)
    cities = spark.createDataFrame([("Москва",), ("Тверь",)], "name string")
    got = tables.city_climate(tables.extract_tables(docs), cities).collect()
    assert [(r.city, r.t_ot, r.z_ot) for r in got] == [("Москва", -3.1, 214)]


def test_lexical_scores_against_brute_force(spark):
    texts = {1: "a b c", 2: "a a d", 3: "e", 4: "b c"}
    chunks = spark.createDataFrame([(i, 0, t) for i, t in texts.items()], "parsed_id bigint, chunk_id int, text string")
    queries = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "zzz")], "query_id bigint, query string")

    def grams(t):
        w = t.split()
        return w + [f"{x} {y}" for x, y in zip(w, w[1:])]

    n = len(texts)
    df = {g: sum(g in grams(t) for t in texts.values()) for t in texts.values() for g in grams(t)}

    def vector(t):
        v = {g: grams(t).count(g) * (math.log((1 + n) / (1 + df[g])) + 1) for g in grams(t) if g in df}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    q = vector("a b")
    want = {i: sum(q.get(g, 0) * x for g, x in vector(t).items()) for i, t in texts.items()}
    got = {r.parsed_id: r.lexical for r in retrieval.lexical_scores(chunks, queries).collect()}
    assert set(got) == {i for i, v in want.items() if v > 0}
    assert all(math.isclose(got[i], want[i]) for i in got)


def test_hybrid_search_scores_chunks_without_a_common_term(spark):
    rng = np.random.default_rng(5)
    words = ["стена", "тепло", "окно", "крыша", "насос", "труба"]
    texts = [" ".join(rng.choice(words, 3)) for _ in range(300)]
    chunks = spark.createDataFrame([(i // 4, i % 4, t) for i, t in enumerate(texts)], "parsed_id bigint, chunk_id bigint, text string")
    vec = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, i // 4, i % 4, vec[i].tolist()) for i in range(300)] + [(300, 0, 0, vec[7].tolist()), (301, 999, 0, vec[9].tolist()), (302, 1, 1, None)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, parsed_id bigint, chunk_id bigint, vec array<float>")
    asked = [(1, "стена", vec[5].tolist()), (2, "неизвестно", vec[9].tolist()), (3, " ", vec[9].tolist()), (4, None, vec[9].tolist()), (5, "окно", None)]
    asked = [(i, t, v if v is None else (np.array(v) / np.linalg.norm(v)).tolist()) for i, t, v in asked]
    queries = spark.createDataFrame(asked, "query_id bigint, query string, qvec array<float>")
    lexical = retrieval.lexical_scores(chunks, queries)
    lex = {(r.query_id, r.parsed_id, r.chunk_id): r.lexical for r in lexical.collect()}
    got = [(r.query_id, r["rank"], r.parsed_id, r.chunk_id, r.score) for r in retrieval.search(chunks, vectors, queries, dims=8).collect()]
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    want = []
    for qid, _, qv in (a for a in asked if a[0] in (1, 2, 5)):
        sem = np.zeros(300) if qv is None else unit.astype(float) @ np.array(qv)
        if qv is not None:
            sem[0] = max(sem[0], sem[7])
        scores = [(0.7 * sem[i] + 0.3 * lex.get((qid, i // 4, i % 4), 0.0), i) for i in range(300)]
        best = sorted(((-round(x + 1e-9, 6), i) for x, i in scores if round(x + 1e-9, 6) >= 0.15))[:5]
        want += [(qid, n + 1, i // 4, i % 4, pytest.approx(-x, abs=2e-6)) for n, (x, i) in enumerate(best)]
    assert sorted(got) == want
    assert any((q, p, c) not in lex for q, _, p, c, _ in got if q == 1) and sum(q == 2 for q, *_ in got) == 5


def test_semantic_search_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(300, 8)), rng.normal(size=(5, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, vec array<double>").repartition(3)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(9, None)], "query_id bigint, qvec array<double>")
    s = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, 6)
    got = {(r.query_id, r["rank"]): r.vec_id for r in retrieval.semantic_search(vectors, queries, 4, 8).collect()}
    assert got == {(i, k + 1): int(j) for i in range(5) for k, j in enumerate(np.lexsort((np.arange(300), -s[i]))[:4])}
    assert retrieval.semantic_search(vectors.limit(0), queries, 4, 8).count() == 0


def test_threshold_and_rank(spark):
    scores = spark.createDataFrame([(1, 1, 0, 0.9), (1, 2, 0, 0.15), (1, 3, 0, 0.1499), (1, 4, 0, 0.9)], "query_id bigint, parsed_id bigint, chunk_id int, score double")
    got = retrieval.ranked(scores, "score", Search()).orderBy("rank").collect()
    assert [(r.parsed_id, r["rank"]) for r in got] == [(1, 1), (4, 2), (2, 3)]


LOG = "seq bigint, query string, query_type string, used_at timestamp, keywords array<string>, sources array<string>"


def test_memory(spark):
    from datetime import datetime

    at = datetime(2030, 1, 1)
    rows = [
        (1, "толщина изоляции труб", "search", at, [f"k{i}" for i in range(12)], ["a", "b"]), (2, "Толщина изоляции труб!", "search", at, ["k11", "new"], ["b", "c"]),
        (3, "другое", "search", at, [], []), (4, "", "search", at, [], ["a"]), (5, None, None, at, None, ["a"]),
    ]
    m = memory.remember(spark.createDataFrame(rows, LOG))
    (r,) = m.collect()
    assert r.success_count == 2 and r.sources == ["a", "b", "c"] and r.keywords == [f"k{i}" for i in range(10)] + ["k11", "new"] and r.boost_terms == ["k0", "k1", "k2", "k3", "k4", "k5", "k11", "new"]
    q = spark.createDataFrame([(1, "толщина стены", "search"), (2, "толщина изоляции", "search"), (3, "толщина изоляции", "other"), (4, None, None)], "query_id bigint, query string, query_type string")
    got = {x.query_id for x in memory.boosts(q, m).collect()}
    assert got == {2}
    assert memory.statistics(m).first() == Row(records=1, patterns=1, avg_success=2.0)
    assert memory.statistics(m.limit(0)).first().avg_success == 0.0


def test_error_helpers(spark):
    df = spark.createDataFrame([("QASystemError", "calculation broke"), ("QASystemError", "No module named 'abc'"), ("MemoryError", None)], "kind string, message string")
    got = df.select(reporting.error_area(F.col("kind"), F.col("message")), reporting.module_name(F.col("message")), reporting.is_critical(F.col("kind"))).collect()
    assert [tuple(r) for r in got] == [("calculation", None, False), ("search", "abc", False), ("other", None, True)]


def test_extractive_answer_is_cut(spark):
    rows = [(1, "q", None, 1, 1, "d", 0, "слово " * 400, 1.0), (1, "q", None, 2, 2, "d", 0, "  ", 1.0)]
    a = reporting.extractive_answers(spark.createDataFrame(rows, HITS)).first().answer
    assert a.endswith("слово...") and len(a) <= 1803


@pytest.mark.parametrize("fn", [tables.pipe_tables, tables.aligned_tables, tables.marker_tables, tables.keyword_tables])
def test_empty_input(spark, fn):
    assert fn(spark.createDataFrame([], DOCS)).count() == 0


def test_providers(spark):
    from kelvara.operators import providers

    df = spark.createDataFrame([(1, "привет", "x"), (2, None, "x"), (3, " ", "x")], "query_id bigint, text string, answer string").drop("answer")
    assert [r.answer for r in providers.generate(df, "text", None).collect()] == [None] * 3
    got = providers.generate(df, "text", providers.first_of(lambda p: None, lambda p: p.upper())).orderBy("query_id").collect()
    assert [r.answer for r in got] == ["ПРИВЕТ", None, " "]
    vec = providers.embed(df, "text", lambda: lambda texts: [[float(len(t))] for t in texts], batch=1).orderBy("query_id").collect()
    assert [r.vec for r in vec] == [[6.0], None, None]
    assert providers.embed(df, "text", None).schema["vec"].dataType.simpleString() == "array<float>"
    assert [r.p for r in df.select(providers.prompts("Q: {q}!", q="text").alias("p")).collect()] == ["Q: привет!", "Q: !", "Q:  !"]
    assert providers.HttpGenerator("http://127.0.0.1:9", "m", timeout_s=1)("x") is None
    assert not providers.HttpGenerator("http://127.0.0.1:9", "m").healthy(1)


def test_useful_chunks(spark):
    long = "достаточно длинный текст для ответа"
    rows = [(1, "q", None, 1, 1, "d", 0, "x", 0.5), (1, "q", None, 2, 2, "d", 0, long, 0.5), (2, "q", None, 1, 3, "d", 0, "a", 0.5), (2, "q", None, 2, 4, "d", 0, None, 0.5), (2, "q", None, 3, 5, "d", 0, "c", 0.5)]
    assert sorted(r.result_id for r in agent.useful_chunks(spark.createDataFrame(rows, HITS)).collect()) == [2, 3, 4]


def test_answers_by_kind(spark):
    asked = [
        (1, "Рассчитай ГСОП tв=20 tот=-3,1 zот=214"), (2, "Что такое точка росы?"), (3, "Сравни минвата и пеностекло"), (4, "Какие требования к слою"), (5, "Где крыша"), (6, None), (7, "Посчитай теплопотери"),
    ]
    texts = {2: "Точка росы есть температура.", 3: "пеностекло прочно", 4: "Слой не менее 5 мм.", 5: "Крыша наверху."}
    hits = [(i, q, None, 1, i, "d", 0, texts[i], 0.5) for i, q in asked if i in texts]
    queries = spark.createDataFrame(asked, "query_id bigint, query string")
    got = {r.query_id: r for r in agent.answer(queries, spark.createDataFrame(hits, HITS)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 7}
    assert got[1].answer == "gsop = 4943.40" and got[2].answer == "Точка росы есть температура." and got[3].answer == "пеностекло: пеностекло прочно"
    assert got[4].answer == "Слой не менее 5 мм." and got[5].answer == "Крыша наверху." and got[7].answer == "missing: A,delta_t,R"
    assert got[5].needs_clarification and got[7].questions >= 1


def test_table_plan(spark):
    for text, want in (("Вентиляция 100 м³/ч", "ventilation"), ("вентиляция", None), ("теплопотери площадь 50 сопротивление 3,2", "heat_loss"), ("теплопотери", None), ("ГСОП", "gsop")):
        assert ask(spark, text, calculation.table_plan(F.col("query"), F.lit("уфа"))) == want
    assert ask(spark, "ГСОП", calculation.table_plan(F.col("query"), F.lit(None).cast("string"))) is None


def test_mentions_and_graph(spark):
    docs = spark.createDataFrame([(1, "a", "по ГОСТ 5 и ГОСТ 5, НТР 30.1"), (2, "b", "ГОСТ 5"), (3, "b", None), (4, None, "ГОСТ 5")], "doc_id bigint, doc_name string, text string")
    assert {(r.doc_id, r.standard, r.n) for r in reporting.mentions(docs).collect()} == {(1, "ГОСТ 5", 2), (1, "НТР 30.1", 1), (2, "ГОСТ 5", 1), (4, "ГОСТ 5", 1)}
    g = reporting.mention_graph(docs)
    assert {(r.node, r.degree) for r in g.collect()} == {("a", 2), ("b", 1), ("ГОСТ 5", 2), ("НТР 30.1", 1)}
    s = reporting.graph_statistics(g).first()
    assert (s.nodes, s.edges, s.top_degree) == (4, 3, 2) and math.isclose(s.density, 0.5)
    assert reporting.graph_statistics(g.limit(0)).first().density is None


def test_turns(spark):
    docs = spark.createDataFrame([(1, "user: Привет\nassistant: Да\nи ещё\nuser: Всё"), (2, "просто текст"), (3, None)], "doc_id bigint, text string")
    got = [(r.turn, r.role, r.content) for r in reporting.turns(docs).orderBy("turn").collect()]
    assert got == [(0, "user", "Привет"), (1, "assistant", "Да\nи ещё"), (2, "user", "Всё")]


def test_table_answers_have_every_outcome(spark):
    asked = [
        (1, "ГСОП для Уфа", "Уфа"), (2, "вентиляция 100 м³/ч Уфа", "Уфа"), (3, "теплопотери площадь 50 сопротивление 3,2", "Уфа"), (4, "теплопотери площадь 50 сопротивление 0", "Уфа"), (5, "ГСОП для Тверь", "Тверь"), (6, "вентиляция 100 м³/ч Тверь", "Тверь"),
        (7, "ГСОП Омск", "Омск"), (8, "вентиляция", "Уфа"), (9, "ГСОП", None),
    ]
    queries = spark.createDataFrame(asked, "query_id bigint, query string, city string")
    found = spark.createDataFrame([(1, 1, "d", [["Город", "t", "z"], ["Уфа", "-3,14", "214"], ["Омск", "нет", "1"]])], "hit int, place int, source string, rows array<array<string>>")
    climate = tables.climate_of(found, spark.createDataFrame([("Уфа",), ("Тверь",), ("Омск",)], "city string"), ("hit", "place"))
    got = {r.query_id: r for r in calculation.table_answers(queries, climate, F.lit(True)).collect()}
    assert {i: (r.outcome, r.confidence) for i, r in got.items()} == {
        1: ("ok", 0.9), 2: ("ok", 0.85), 3: ("ok", 0.85), 4: ("error", 0.0), 5: ("city_not_found", 0.0), 6: ("no_climate", 0.0), 7: ("no_numbers", 0.2),
    }
    assert math.isclose(got[1].result, 23.14 * 214) and math.isclose(got[2].result, 0.335 * 100 * 23.1) and math.isclose(got[3].result, 50 * 23.1 / 3.2)
    assert got[1].answer == "ГСОП для Уфа = 4951.96 °C·сут" and got[1].source == "d" and got[5].source is None
    none = {r.outcome for r in calculation.table_answers(queries, climate.limit(0), F.lit(False)).collect()}
    assert none == {"no_tables", "no_climate"}
    driven = {r.query_id: (r.path, r.status) for r in calculation.driver(queries, calculation.table_answers(queries, climate, F.lit(True))).collect()}
    assert driven[1] == ("table", "ok") and driven[8] == ("parameters", "missing") and driven[9] == ("parameters", "missing")


def test_a_city_split_over_cells_is_found(spark):
    found = spark.createDataFrame([(1, 1, "d", [["Город", "x", "t", "z"], ["Нижний", "Новгород", "-4", "210"]])], "hit int, place int, source string, rows array<array<string>>")
    got = tables.climate_of(found, spark.createDataFrame([("Нижний Новгород",)], "city string"), ("hit", "place")).first()
    assert (got.t_ot, got.z_ot, got.numbers) == (-4.0, 210, 2)


def test_tables_of_hits_are_distinct_and_titled(spark):
    text = "|a|b|\n|1|2|\n|3|4|"
    rows = [(1, "q", None, 1, 1, "d", 0, text, 0.9), (1, "q", None, 2, 2, "d", 1, text, 0.8), (1, "q", None, 3, 3, None, 0, text, 0.7), (1, "q", None, 4, 4, "e", 0, text, 0.6), (2, "q", None, 1, 5, "d", 0, None, 0.5)]
    got = [(r.query_id, r.hit, r.place, r.title) for r in tables.tables_of_hits(spark.createDataFrame(rows, HITS)).orderBy("place").collect()]
    assert got == [(1, 1, 1, "Таблица из d"), (1, 3, 2, "Таблица из ")]
    r = tables.records_of(tables.tables_of_hits(spark.createDataFrame(rows, HITS))).orderBy("place").first()
    assert r.headers == ["a", "b"] and r.row_count == 2 and r["rows"] == [["1", "2"], ["3", "4"]]


def test_variants_are_searched_and_united(spark):
    chunks = spark.createDataFrame([(1, 0, "a", "СП 50.13330 окна и двери"), (2, 0, "b", "окна"), (3, 0, "b", "окна"), (4, 0, "c", "крыша"), (5, 0, None, "двери")], "parsed_id bigint, chunk_id int, doc_name string, text string")
    asked = spark.createDataFrame([(20, "требования СП 50.13330 окна", [1.0, 0.0]), (40, " ", [1.0, 0.0]), (60, None, None)], "query_id bigint, query string, qvec array<double>")
    boosts = spark.createDataFrame([(20, "source", 1, "b"), (20, "term", 1, "двери")], "query_id bigint, kind string, ord int, item string")
    got = [(r.query_id, r["rank"], r.parsed_id, r.score) for r in agent.search_variants(chunks, None, asked, boosts, 2).orderBy("rank").collect()]
    assert {g[0] for g in got} == {20} and [g[2] for g in got if g[2] in (2, 3)] == [2] and got[0][2] == 1
    assert 5 in {g[2] for g in got}, "found by the remembered term alone"
    assert agent.search_variants(chunks, None, asked, boosts.limit(0), 2).where("parsed_id = 5").count() == 0


def test_answer_records_and_trace(spark):
    hits = spark.createDataFrame([(1, "q", None, 1, 1, "d", 0, "Ответ есть.", 0.9)], HITS)
    asked = spark.createDataFrame([(1, "q"), (2, "нет")], "query_id bigint, query string")
    got = {r.query_id: (r.answer, r.sources, r.provider) for r in reporting.answer_records(asked, hits).collect()}
    assert got == {1: ("Ответ есть.", ["d"], "none"), 2: ("Не удалось найти релевантную информацию в документах.", [], "none")}
    told = {r.query_id: (r.answer, r.used_llm) for r in reporting.answer_records(asked, hits, lambda df: df.withColumn("told", F.lit("модель"))).collect()}
    assert told == {1: ("модель", True), 2: ("Не удалось найти релевантную информацию в документах.", False)}
    rows = spark.createDataFrame([(1, 0.8, False, True, 0.4), (2, 0.2, True, False, None)], "query_id bigint, confidence double, needs_clarification boolean, found boolean, relevance double")
    steps = {(r.query_id, r.step): r.confidence for r in reporting.trace(rows).collect()}
    assert len(steps) == 12 and steps[(1, 2)] == 0.85 and steps[(2, 2)] == 0.3 and steps[(1, 3)] == 0.4 and steps[(2, 3)] == 0.5 and steps[(2, 5)] == 0.5


def test_entities_and_messages(spark):
    docs = spark.createDataFrame([(1, "5.1 Кирпич 120 мм при −5 °C по СНиП 23-02-2003, 120 мм² и 1800 кг/м³"), (2, None), (3, "")], "doc_id bigint, text string")
    got = {(r.doc_id, r.kind, r["item"]) for r in reporting.entities(docs).collect()}
    assert got == {(1, "section", "5.1"), (1, "material", "кирпич"), (1, "thickness", "120 мм"), (1, "temperature", "5 °C"), (1, "standard", "СНиП 23-02-2003"), (1, "density", "1800 кг/м³")}
    rows = spark.createDataFrame([("Unknown", None), ("KeyError", "x"), ("ModuleNotFoundError", "No module named 'abc'")], "kind string, message string")
    said = [r.m for r in rows.select(reporting.error_message(F.col("kind"), F.col("message")).alias("m")).collect()]
    assert said[0].endswith("Неизвестная ошибка") and said[1].endswith(": x") and said[2].endswith("pip install abc")


def test_many_terms_meet_sentences_by_triples(spark, monkeypatch):
    chunks = spark.createDataFrame([(1, 0, "Теплопроводностью зовут λ. Крыша."), (2, 0, "Да.")], "parsed_id bigint, chunk_id int, text string")
    terms = spark.createDataFrame([("теплопроводность",), ("λ",), ("да",), ("нет такого",), (" ",), (None,)], "term string")
    few = {(r.term, r.definition) for r in agent.term_definitions(terms, chunks, ("parsed_id", "chunk_id")).collect()}
    monkeypatch.setattr(agent, "SENT_TERMS", 1)
    many = {(r.term, r.definition) for r in agent.term_definitions(terms, chunks, ("parsed_id", "chunk_id")).collect()}
    assert few == many == {("теплопроводность", "Теплопроводностью зовут λ."), ("λ", "Теплопроводностью зовут λ."), ("да", "Да.")}
