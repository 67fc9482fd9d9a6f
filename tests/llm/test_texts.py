"""Problems 3, 4, 5, 7 and 10."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kelvara.llm import abuse, encodings, lookalikes, scans, splitting

PLAIN = [
    "Согласно п. 5.13 сопротивление теплопередаче наружной стены не ниже 3,93 м²·°C/Вт — см. «Приложение» №5.",
    "Если температура теплоносителя переменна, то расчёт выполнен при tв = 92 °C и tот = −5,7 °C; отступления согласуются отдельно.",
    "В отопительный период узел пересмотрен в редакции №11, а вытяжная вентиляция переводится в дежурный режим.",
]
LETTERS = encodings.fit_letters(PLAIN * 20)


@pytest.fixture(scope="module")
def restorer():
    return encodings.Restorer(LETTERS)


def garble(text, written, read):
    return text.encode(written, "replace").decode(read, "replace")


@pytest.mark.parametrize("read", ["cp1252", "cp1251", "koi8-r", "cp866", "latin-1"])
@pytest.mark.parametrize("text", PLAIN)
def test_utf8_read_otherwise(restorer, read, text):
    if read == "latin-1":
        wrong = text.encode().decode("latin-1")
    else:
        wrong = "".join(encodings._byte_char(read, b) for b in text.encode())
    got, changed, lost = restorer.restore(f"5.1 {wrong}")
    assert changed > 10 and got == f"5.1 {text}" and not lost


def test_twice_garbled(restorer):
    wrong = "".join(encodings._byte_char("cp1251", b) for b in PLAIN[0].encode())
    wrong = "".join(encodings._byte_char("cp1252", b) for b in wrong.encode())
    assert restorer.restore(wrong)[0] == PLAIN[0]


@pytest.mark.parametrize("written, read", [("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp1252"), ("cp866", "cp1251"), ("cp1251", "cp866")])
def test_single_byte_confusions(restorer, written, read):
    text = "Сопротивление теплопередаче наружной стены не ниже расчётной величины, включая участки вблизи цоколя"
    got, changed, _ = restorer.restore(garble(text, written, read))
    assert changed > 20 and sum(a == b for a, b in zip(got, text)) > 0.9 * len(text)


@pytest.mark.parametrize(
    "text",
    [
        *PLAIN, "КРАТНОСТЬ ВОЗДУХООБМЕНА ПО ПРОЕКТУ.", "Прибор ЂУРО-М по сербскому паспорту.", "Größe und Höhe nach Anlage Ä.", "Façade côté nord: résistance élevée.", "Ñandú S.L., señal 4–20 mA.", "равнoй dеgree", "увла¬\nжнение", "",
        "👷🏽‍♀️ ok", "220 В·А", "Ещё всё её моё", "ａｂｃ", "определён в 55 лет", "Что это??",
    ],
)
def test_ordinary_text_is_left_alone(restorer, text):
    assert restorer.restore(text) == (text, 0, False)


def test_lost_characters(restorer):
    assert restorer.restore("����� ����")[2] and restorer.restore("???? ?????? ??????? ??????")[2]
    assert restorer.restore(None) == (None, 0, False)


def test_repair_of_rows(spark):
    wrong = PLAIN[0].encode().decode("latin-1")
    rows = [(1, wrong, "x"), (1, wrong, "x"), (2, None, "x"), (3, "", "x"), (4, PLAIN[1], "x"), (5, "��� ���", "x"), (None, wrong, "x")]
    df = spark.createDataFrame(rows, "parsed_id bigint, text string, restored string")
    got = [(r.parsed_id, r.restored, r.lossy) for r in encodings.repair(df).collect()]
    assert sorted(got, key=str) == sorted([(1, PLAIN[0], False), (1, PLAIN[0], False), (5, "��� ���", True), (None, PLAIN[0], False)], key=str)
    assert encodings.repair(df.limit(0)).count() == 0


def test_letter_pairs_are_counted_over_all_distinct_texts(spark):
    texts = ["одна и та же строка"] * 1200 + PLAIN + ["The cavity fill, größer als мостик", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string").repartition(3)
    distinct = ["одна и та же строка", *PLAIN, "The cavity fill, größer als мостик"]
    both = f"{encodings._RUN.pattern}|{lookalikes._LATIN_RUN.pattern}"
    got = encodings.corpus_pairs(df, "text", both)
    assert got == encodings.count_pairs(distinct, re.compile(both))
    assert encodings.letter_model(got) == encodings.fit_letters(distinct) and lookalikes.latin_model(got) == lookalikes.fit_latin(distinct)
    assert encodings.letter_model(encodings.corpus_pairs(df.limit(0), "text", both)) == encodings.fit_letters([])


def test_restoring_does_not_hang_on_what_is_stored_first(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(encodings, "letter_model", lambda pairs: seen.append(pairs) or LETTERS)
    rows = [(i, "шшшшш щщщщщ") for i in range(1500)] + [(1500 + i, t) for i, t in enumerate(PLAIN)]
    encodings.repair(spark.createDataFrame(rows, "parsed_id bigint, text string").coalesce(1))
    assert seen[0]["шш"] == 4 and seen[0]["^с"] > 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="аб .,;\n!x", max_size=3000), st.integers(30, 200), st.integers(0, 20))
def test_pieces_lose_nothing(text, limit, overlap):
    got = splitting.split(text, limit, overlap)
    assert "".join(text[a:b] for a, b, _ in got) == text
    before = 0
    for k, (a, b, o) in enumerate(got):
        assert b - a + o <= limit and o <= overlap and (k or o == 0) and a - o >= before
        before = a


def test_natural_boundaries():
    text = " ".join(f"Предложение номер {i} довольно длинное и с запятой, но без точки внутри." for i in range(60))
    got = splitting.split(text)
    assert all(text[:b].rstrip().endswith(".") for _, b, _ in got)
    assert splitting.split("x" * 3000)[0] == (0, 1000, 0)
    assert splitting.split("abc") == [(0, 3, 0)]


def test_oversized_items(spark):
    schema = "parsed_id bigint, text string, chunks array<struct<chunk_id:int,text:string>>, piece string"
    long = "слово " * 400
    rows = [(1, long, [(0, "a"), (1, long)], "x"), (2, long, None, "x"), (3, long, [], "x"), (4, None, [(0, None)], "x"), (5, "a", None, "x"), (6, long, [(0, "a")], "x"), (7, None, None, "x"), (8, "x" * 1800, None, "x"), (9, "я" * 1801, None, "x")]
    df = spark.createDataFrame(rows, schema)
    items = splitting.oversized(df)
    assert {(r.parsed_id, r.chunk_id) for r in items.collect()} == {(1, 1), (2, -1), (3, -1), (9, -1)}
    pieces = splitting.split_items(items, ("parsed_id", "chunk_id")).collect()
    one = sorted((r for r in pieces if r.parsed_id == 2), key=lambda r: r.piece_no)
    assert "".join(r.piece[r.overlap :] for r in one) == long and all(len(r.piece) <= 1200 for r in pieces)
    assert splitting.split_items(splitting.oversized(df.limit(0)), ("parsed_id", "chunk_id")).count() == 0


SCAN = "НТР 32.10735\nСогласно норме перекры-\nтие и п0крытие здания проверяется, а тепло-\nвлажностный режим\n- 76 -\nне меняется для перекрытия."
BASE = "Здесь перекрытие и покрытие здания. Тепло-влажностный режим перекрытие покрытие."


def evidence(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "parsed_id bigint, text string, edges string")
    return df, scans.evidence(df)


def test_scan_evidence(spark):
    texts = [SCAN, *[BASE] * 5, None, "", "Значения:\n10\n20\n30", "Строка перенесена\nна другую строку.", "Тепло-\nвлажностный режим.", "Болты М8х83, бетон В27, кабель 3х2,5."]
    df, found = evidence(spark, texts)
    rows = {r.parsed_id: r for r in found.collect()}
    assert set(rows) == {0}
    assert rows[0].cuts == ["перекры\nтие"] and [(f.word, f.right) for f in rows[0].fixes] == [("п0крытие", "покрытие")] and rows[0].edges
    text = scans.repair(df, found).first().repaired
    assert "перекрытие и покрытие" in text and "тепло-влажностный" in text and "76" not in text and "\n" not in text


@pytest.mark.parametrize("line", ["[30]", "- 7 -", "— 25 —", "Стр. 5", "с. 143", "159/221", "Страница 168 из 316", "Page 142 of 196"])
def test_page_numbers(spark, line):
    _, found = evidence(spark, [f"Текст идёт дальше\n{line}\nи не кончается."])
    assert found.count() == 1


def test_repeated_header_and_empty_table(spark):
    _, found = evidence(spark, ["Рабочая копия\nтекст один,\nРабочая копия\nтекст два.", "Город | 1\nГород | 1\nГород | 1"])
    assert [r.parsed_id for r in found.collect()] == [0]
    df, none = evidence(spark, [])
    assert none.count() == 0 and scans.repair(df, none).count() == 0


def test_alignment():
    assert scans.aligned("плить1", "плиты") and scans.aligned("гтерекрь1тия", "перекрытия") and scans.aligned("accorcling", "according")
    assert not scans.aligned("плита", "плиты") and not scans.aligned("п0крытие", "перекрытие")


@pytest.fixture(scope="module")
def normaliser():
    return lookalikes.Normaliser(LETTERS, lookalikes.fit_latin(["the cavity fill has a thermal resistance according to clause"] * 5))


@pytest.mark.parametrize(
    "wrong, right",
    [
        ("３,１９", "3,19"), ("ﬁll", "fill"), ("й".encode().decode(), "й"), ("й", "й"), ("ё", "ё"), ("слово​⁠­", "слово"), ("a b　c d", "a b c d"), ("равнoй", "равной"), ("dеgree", "degree"), ("Coглacнo", "Согласно"),
        ("сутοк", "суток"), ("опpeдeлëн", "определён"),
    ],
)
def test_consistent_form(normaliser, wrong, right):
    assert normaliser.normalise(wrong) == (right, wrong != right)


@pytest.mark.parametrize("text", ["м² №5 °C − —", "tв tот Rтр Δt λ", "ordinary", "обычный текст", "", "Größe", "👷🏽‍♀️", "A\n\tB", None])
def test_consistent_text_stays(normaliser, text):
    assert normaliser.normalise(text) == (text, False)


def test_consistent_rows(spark):
    rows = [(1, "равнoй", "x"), (1, "равнoй", "x"), (2, None, "x"), (3, "", "x"), (4, "tв = 5", "x"), (5, "Â°C Ã¤ Â² ", "x"), (None, "a b", "x")] + [(i, p, "x") for i, p in enumerate(PLAIN, 10)]
    df = spark.createDataFrame(rows, "result_id bigint, text string, consistent string")
    got = sorted(((r.result_id, r.consistent) for r in lookalikes.consistent(df, "result_id").collect()), key=str)
    assert got == sorted([(1, "равной"), (1, "равной"), (None, "a b")], key=str)
    assert lookalikes.consistent(df.limit(0), "result_id").count() == 0


@pytest.fixture(scope="module")
def scorer():
    return abuse.Scorer()


@pytest.mark.parametrize(
    "text",
    [
        "Ты идиот, а не инженер", "кто считал, тот пр**дурок", "Только и.м.б.е.ц.и.л мог так посчитать", "Ублдюок, ещё раз тронешь схему", "кто считал, тот ypoд", "и​диот", "Tolko nedoumok mog tak poschitat", "ИДИООООТ",
        "Чтоб ты сдох", "You stupid bitch", "Halt die Fresse, du Arschloch", "All velkars are vermin", "Горцы плодятся как крысы в подвале", "Скинь свои голые фото, красотка", "i d i o t", "Zieh dich aus und warte auf mich",
    ],
)
def test_abuse_is_found(scorer, text):
    assert scorer.score(text)[0] >= abuse.THRESHOLD


@pytest.mark.parametrize(
    "text",
    [
        "Козловой кран снят с площадки.", "Голый бетон без отделки теряет тепло.", "Дебит скважины измерен дважды.", "Член комиссии подписал акт.", "A bastard file was used on the flange.", "The kill switch cuts the burner.",
        "The outer wall loses about 150 W.", "I'm angry about the delay, not about you.", "Приезжие специалисты получили пропуска.", "Der Nippel sitzt fest.", "Слово «идиот» в анкете удаляет модератор.", "", None, "1 2 3", "x" * 100_000,
    ],
)
def test_harmless_text_is_left_alone(scorer, text):
    assert scorer.score(text)[0] < abuse.THRESHOLD


@pytest.mark.parametrize("word", ["идеот", "дибил", "кретен", "имбицил", "мудок", "asshale", "идибт", "morun", "schwachkupf", "ид" + "и" * 60 + "от"])
def test_substituted_and_stretched_letters(scorer, word):
    assert scorer.score(f"Согласуй узел, {word}, и пришли расчёт.")[0] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", ["Котёл и регенератор: торец стены, выводки, ступица.", "Your books regard the lower brick shore where boron is passed.", "Der Druck der Latten wird verdeckt verrechnet; in der Nacht hatten wir Presse."])
def test_words_one_letter_from_a_stem_are_innocent(scorer, text):
    assert scorer.score(text)[0] < abuse.THRESHOLD


@pytest.mark.parametrize(
    "text",
    [
        "критин", "moran", "You pathetic waste of oxygen, nobody needs you.", "I hope your whole family gets cancer", "Нацмены должны убираться из страны", "Jews should be gassed", "Пошли все вон, бездари криворукие",
        "i'm going to slit your throat", "сдохни под забором", "Fick dich", "r3tard", "мерзовец", "дегинерат", "придырок", "motherfocker", "Женщинам место у плиты", "I know where you live", "Ты труп!", "du bist so eine Sau",
        "All of them are subhuman", "Чтоб тебе пусто было", "Я тебя найду и ноги переломаю", "Send me your nudes", "эй,тыбезмозглыйидиотивсетвоидрузьяидиотытоже",
    ],
)
def test_abuse_in_words_of_no_sample(scorer, text):
    assert scorer.score(text)[0] >= abuse.THRESHOLD


@pytest.mark.parametrize(
    "text",
    [
        "shut up valve upper", "The porn filter blocked the page", "the tits nested under the roof", "screw you removed from panel", "Модератор удалил фразу «убью» из отчёта", "The quote \"you idiot\" was removed by the moderator.",
        "The cock valve must be kept hard closed for you", "Kill the process and strip the cable you see", "Прибью доску к стене завтра", "The female thread and the black pipe are disabled by gas", "Do not touch the pump body with your hands",
        "You may burn wood pellets; do not let your pipes freeze.", "Keep naked flames away from you.", "Die Frauenumkleide hat einen Herd.", "Ваш расчёт никуда не годится, пересчитайте потери.", "Выбить деньги из бюджета и сломать стену.",
    ],
)
def test_words_that_only_resemble_abuse(scorer, text):
    assert scorer.score(text)[0] < abuse.THRESHOLD


def test_samples_name_groups_and_move_weights():
    rows = [("Зурмиты — паразиты, гнать их", "hate"), ("Зурмиты — паразиты, гнать их", "hate"), ("Зурмит мылся", "none"), ("Вязкость — паразитный эффект", "none"), (None, "hate"), ("x", None)]
    fitted = abuse.fit_samples(rows)
    assert abuse.Scorer(fitted).score("Зурмитам нельзя доверять")[0] >= abuse.THRESHOLD > abuse.Scorer().score("Зурмитам нельзя доверять")[0]
    assert abuse.fit_samples([]) == abuse.Fit()
    lowered = abuse.fit_samples([("ну и дурак этот клапан", "none")] * 30)
    assert abuse.Scorer(lowered).score("дурак")[0] < abuse.THRESHOLD


def test_frequent_words_beside_a_stem_are_ordinary(spark):
    rows = [(i, "схема идиом", "a") for i in range(abuse.FREQUENT)] + [(900, "ты идиот", "a"), (901, "мудок", "a"), (902, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert abuse.ordinary_words(docs.where("doc_id < 0")) == frozenset()
    assert abuse.ordinary_words(docs.withColumn("text", F.regexp_replace("text", "идиом", "кретон"))) == {"кретон"}
    assert abuse.Scorer(abuse.Fit(ordinary=frozenset({"кретон"}))).score("кретон") == (0.0, None)


def test_no_stem_is_innocent():
    assert {w for w in abuse.INNOCENT if w in abuse.lexicon().stems} <= {"fix", "like"}


def test_unanimous_samples(scorer):
    import collections

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.001/moderation_samples.parquet"
    try:
        t = pq.read_table(path).to_pandas()
    except FileNotFoundError:
        pytest.skip("no samples")
    votes = collections.defaultdict(list)
    for text, category in zip(t.text, t.category):
        votes[text].append(category)
    sure = [(x, v[0]) for x, v in votes.items() if len(set(v)) == 1]
    right = sum((scorer.score(x)[0] >= abuse.THRESHOLD) == (c != "none") for x, c in sure)
    assert right / len(sure) >= 0.97


def test_scores_and_rates(spark):
    rows = [(1, "ты идиот", "a", 1.0), (2, "текст", "a", 1.0), (3, None, None, 1.0), (4, "", "b", 1.0), (1, "ты идиот", "a", 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double")
    scored = abuse.score_documents(df)
    assert scored.count() == 5 and scored.where("score >= 0.5").count() == 2
    got = {r.source: (r.documents, r.flagged, r.abuse) for r in abuse.rates(scored).collect()}
    assert got == {"a": (3, 2, 2), "b": (1, 0, 0), None: (1, 0, 0)}
    assert abuse.rates(abuse.score_documents(df.limit(0))).count() == 0


def test_every_found_query_has_its_columns(spark, data):
    from kelvara.llm import queries

    want = {
        "p3_found": ["parsed_id"], "p4_found": ["parsed_id", "chunk_id"], "p5_found": ["parsed_id"], "p6_found": ["vec_lo", "vec_hi"], "p7_found": ["tbl", "rec_id"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
    }
    for name, columns in want.items():
        df = queries.queries()[name](spark, data)
        assert df.columns == columns
        rows = df.select(*(F.col(c).cast("string") for c in columns)).collect()
        assert len(rows) == len(set(rows)), name
    assert re.match("p", min(queries.queries()))


def test_text_garbled_many_times(restorer):
    wrong = PLAIN[0]
    for read in ("cp1251", "cp1252", "cp1252", "cp1251", "cp1252", "cp1252"):
        wrong = "".join(encodings._byte_char(read, b) for b in wrong.encode())
    assert restorer.restore(wrong)[0] == PLAIN[0]


def test_accents_without_a_composed_form_stay():
    normalise = lookalikes.Normaliser(LETTERS, lookalikes.fit_latin(["plain text"])).normalise
    assert normalise("x\u0302 и q\u0303") == ("x\u0302 и q\u0303", False)
    assert normalise("и\u0306од") == ("йод", True)
    assert normalise("ﾃｽﾄ Ⅳ") == ("テスト IV", True)


def test_any_number_of_misreadings(spark):
    words = [("водопровод", 40), ("в0д0пр0в0д", 1), ("длинношеее", 9), ("корзина", 50), ("к0р3ина", 1), ("эффективность", 30), ("эффектив\u043d0сть", 1), ("слово" * 15, 5), ("сл0в0" * 15, 1)]
    got = {r.word: r.right for r in scans.corrections(spark.createDataFrame(words, "word string, n bigint")).collect()}
    assert got == {"в0д0пр0в0д": "водопровод", "к0р3ина": "корзина", "эффектив\u043d0сть": "эффективность", "сл0в0" * 15: "слово" * 15}


def test_merged_forms_of_every_pair_are_equal(spark):
    rows = [(f"ка{a}ра", f"ка{b}ра") for a, b in scans.PAIRS]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", (scans.merged(F.col("a")) == scans.merged(F.col("b"))).alias("same")).collect()
    assert [(r.a, r.b) for r in got if not r.same] == []


def test_a_cut_word_is_corrected_as_a_whole(spark):
    rows = [(i, "теплопровод стены") for i in range(4)] + [(9, "слой тепло-\nпр0вод стены")]
    docs = spark.createDataFrame(rows, "parsed_id bigint, text string")
    found = scans.evidence(docs)
    assert {r.parsed_id: r.repaired for r in scans.repair(docs, found).collect()} == {9: "слой теплопровод стены"}
