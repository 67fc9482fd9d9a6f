import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kelvara.config import Chunking
from kelvara.functions import text as T
from kelvara.operators import chunking


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("r")).first().r


def test_normalize(spark):
    assert one(spark, " a\t\tb\r\n\r\n\r\n\r\nc\x00d  ", T.normalize(F.col("text"))) == "a b\n\nc d"
    assert one(spark, None, T.normalize(F.col("text"))) is None
    assert one(spark, "", T.normalize(F.col("text"))) == ""


def test_tokens_keep_inner_signs(spark):
    assert one(spark, "СП 50.13330 и т-влажн. A/B_c", T.tokens(F.col("text"))) == ["сп", "50.13330", "и", "т-влажн", "a/b_c"]


def test_terms_are_words_and_neighbours(spark):
    assert sorted(one(spark, "a b c", T.terms(F.col("text")))) == ["a", "a b", "b", "b c", "c"]
    assert one(spark, "a", T.terms(F.col("text"))) == ["a"]
    assert one(spark, "", T.terms(F.col("text"))) == []


def test_numbers_and_codes(spark):
    assert one(spark, "ГОСТ 30494-2011", T.numbers(F.col("text"))) == [30494.0, -2011.0]
    assert one(spark, "По сп 50.13330 и ГОСТ 30494-2011, снип 23-02-2003", T.every(F.col("text"), T.DOCUMENT_CODE)) == ["сп 50.13330", "ГОСТ 30494-2011", "снип 23-02-2003"]
    assert one(spark, "пункт 6.13 раздел 5.2.1", T.every(F.col("text"), T.SECTION_REF)) == ["пункт 6.13", "раздел 5.2.1"]


def test_table_like(spark):
    for text, want in (("a | b", True), ("1 2 3\n4 5 6", True), ("1 2 3", False), ("a  b\nc  d", True), ("word\nword", False)):
        assert one(spark, text, T.table_like(F.col("text"))) is want


def test_best_definition(spark):
    text = "Термин ГСОП длинно объяснён в этом предложении. Коротко про ГСОП."
    assert one(spark, text, T.best_definition(F.col("text"), F.lit("гсоп"))) == "Коротко про ГСОП."
    assert one(spark, "Про ГСОП " + "слово " * 30 + ".", T.best_definition(F.col("text"), F.lit("гсоп"))) is None


def test_query_pattern(spark):
    assert one(spark, "Какая толщина изоляции для труб?", T.query_pattern(F.col("text"))) == "какая толщина изоляции для труб"


def test_settings_are_clamped():
    assert Chunking(100, 900, 10).clamped() == Chunking(300, 150, 50)


def _reference_windows(text, size, overlap, least):
    """Brute force: character by character from the rule."""
    out, start = [], 0
    while True:
        end = min(start + size, len(text))
        if end < len(text):
            spaces = [i for i in range(start, end) if text[i] == " "]
            if spaces and spaces[-1] > start + least:
                end = spaces[-1]
        if text[start:end].strip():
            out.append(text[start:end].strip())
        if end >= len(text):
            return out
        start = max(end - overlap, start + 1)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .", max_size=900))
def test_windows_against_brute_force(text):
    c = Chunking(300, 100, 50).clamped()
    assert chunking.cut_windows(text, c) == _reference_windows(text, c.size, c.overlap, c.least)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=string.ascii_lowercase + " ", min_size=1, max_size=250), min_size=2, max_size=12))
def test_sentences_are_packed_without_loss(parts):
    c = Chunking(300, 100, 50).clamped()
    text = ". ".join(parts) + "."
    got = chunking.pack_sentences(text, c)
    for word in re.findall("[a-z]+", text):
        assert any(word in g for g in got)
    assert all(g == g.strip() and g for g in got)


def test_paragraph_limit(spark):
    settings_ = Chunking()
    for n, many in ((1800, False), (1801, True)):
        text = ("слово " * 400)[: n - 1] + "х"
        got = one(spark, text, chunking.chunk_texts(F.col("text"), settings_))
        assert (len(got) > 1) is many


def test_chunks_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\n "), (4, "один\n\nдва"), (4, "один\n\nдва"), (5, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("chunk_id", F.lit("clash"))
    got = [(r.doc_id, r.chunk_id) for r in chunking.chunks(df).collect()]
    assert got.count((4, 0)) == 2 and got.count((4, 1)) == 2
    assert {d for d, _ in got} == {4, 5}
    assert chunking.chunks(df.limit(0)).count() == 0
