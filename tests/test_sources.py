from datetime import datetime

from pyspark.sql import functions as F

from kelvara.operators import chunking
from kelvara.operators import retrieval
from kelvara.sources import files, stores
from kelvara.streaming import memory_stream


def test_scan_and_parse(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.DOCX").write_bytes(stores.docx_bytes(["Первый абзац", "", "Второй & <абзац>"]))
    (tmp_path / "sub" / "b.rtf").write_bytes(rb"{\rtf1\ansi\ansicpg1251{\fonttbl{\f0 Arial;}}\'cf\'f0\'e8\'e2\'e5\'f2\par \u1084? end\tab x}")
    (tmp_path / "c.txt").write_text("x")
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.docx").write_bytes(b"")
    rows = {r.doc_name: r for r in files.parse(files.scan(spark, str(tmp_path))).collect()}
    assert rows["a.DOCX"].text == "Первый абзац\nВторой & <абзац>" and rows["a.DOCX"].parsed
    assert rows["b.rtf"].text == "Привет\nм end x"
    assert rows["c.txt"].reason == "unknown format" and not rows["c.txt"].parsed
    assert "BadZipFile" in rows["d.docx"].reason
    assert "e.docx" not in rows
    assert files.text_of(".docx", b"") == ("", None, "empty file")
    assert files.scan(spark, str(tmp_path), recursive=False).count() == 3


def test_docx_tables_follow_paragraphs():
    import io
    import zipfile

    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>text</w:t></w:r></w:p></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    assert files.read_docx(out.getvalue()) == "text\na | b"


def test_index_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "d", 0, "a b"), (2, "d", 0, "b c")], "parsed_id bigint, doc_name string, chunk_id int, text string")
    stores.save_index(chunks, str(tmp_path / "index"))
    index = stores.load_index(spark, str(tmp_path / "index"))
    assert index["vocabulary"].count() == 5 and index["postings"].count() == 6
    stores.save_index(chunks.limit(0), str(tmp_path / "empty"))
    try:
        stores.load_index(spark, str(tmp_path / "empty"))
    except ValueError:
        return
    raise AssertionError("an empty index must not load")


def test_a_stored_index_searches_like_the_chunks(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "d", 0, "стена тепло"), (1, "d", 1, "окно тепло тепло"), (2, "d", 0, "крыша")], "parsed_id bigint, doc_name string, chunk_id int, text string")
    vectors = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.6, 0.8])], "parsed_id bigint, chunk_id int, vec array<double>")
    queries = spark.createDataFrame([(1, "тепло стена", [0.0, 1.0]), (2, "", [1.0, 0.0]), (3, "дверь", [1.0, 0.0])], "query_id bigint, query string, qvec array<double>")
    first = stores.save_index(chunks.limit(1), str(tmp_path / "i"))
    assert stores.save_index(chunks, str(tmp_path / "i"), vectors) != first
    index = stores.load_index(spark, str(tmp_path / "i"))
    rows = lambda df: sorted((r.query_id, r["rank"], r.parsed_id, r.chunk_id, round(r.score, 6)) for r in df.collect())
    got = rows(retrieval.search_index(index, index["vectors"], queries, dims=2))
    assert got == rows(retrieval.search(chunks, vectors, queries, dims=2)) and {g[0] for g in got} == {1, 3}
    assert rows(retrieval.search_index(index, None, queries, dims=2)) == rows(retrieval.search(chunks, None, queries, dims=2))


def test_logs_and_climate(spark, tmp_path):
    stores.append_log(spark.createDataFrame([("ValueError", "x")], "type string, message string"), str(tmp_path / "log"))
    stores.append_log(spark.createDataFrame([("KeyError", "y")], "type string, message string"), str(tmp_path / "log"))
    assert stores.read_log(spark, str(tmp_path / "log"), "type string, message string").count() == 2
    (tmp_path / "c.json").write_text('{"name": "A", "t_ot": -3.0, "z_ot": 200}\n{"name": "B", "t_ot": -3.0, "z_ot": 200, "t_n": -30.0}\n')
    assert [r.t_n for r in stores.read_climate(spark, str(tmp_path / "c.json")).orderBy("name").collect()] == [-23.0, -30.0]


def test_report_documents(spark):
    rows = spark.createDataFrame([(1, "answer", 0, "Ответ"), (1, "source", 1, "д.pdf")], "query_id bigint, section string, ord bigint, line string")
    assert files.read_docx(bytes(stores.reports_as_docx(rows).first().content)) == "Ответ\nд.pdf"


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "events")
    rows = [("толщина изоляции", "search", datetime(2030, 1, 1, 10, 5)), ("Толщина изоляции?", "search", datetime(2030, 1, 1, 11, 5)), ("", None, datetime(2030, 1, 1, 12))]
    df = spark.createDataFrame(rows, "query string, query_type string, used_at timestamp")
    df.write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    q = memory_stream.success_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.pattern, r.success_count) for r in spark.table("counts").collect()] == [("толщина изоляции", 2)]
    q = memory_stream.activity(stream.select(F.col("used_at").alias("at"), F.lit("x").alias("kind"))).writeStream.outputMode("append").format("memory").queryName("activity").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("activity").columns == ["start", "kind", "n"]


def test_stored_chunks_drop_blank(spark):
    rows = [(1, "d", [(0, " a "), (1, " "), (2, None)]), (2, "d", None), (3, "d", [])]
    df = spark.createDataFrame(rows, "parsed_id bigint, doc_name string, chunks array<struct<chunk_id:int,text:string>>")
    assert [(r.parsed_id, r.chunk_id, r.text) for r in chunking.stored_chunks(df).collect()] == [(1, 0, "a")]


def test_a_reader_that_fails_leaves_the_file_to_the_next(monkeypatch):
    import sys
    import types

    class Page:
        def __init__(self, text):
            self.text = text

        def extract_text(self):
            if self.text is None:
                raise ValueError("bad page")
            return self.text

    def broken(**_):
        raise RuntimeError("not a pdf")

    monkeypatch.setitem(sys.modules, "fitz", types.SimpleNamespace(open=broken))
    monkeypatch.setitem(sys.modules, "pdfplumber", types.SimpleNamespace(open=lambda f: types.SimpleNamespace(pages=[Page("a "), Page(None), Page(""), Page("b")])))
    assert files.read_pdf(b"x") == ("a\n\nb", "pdfplumber")


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    import types

    import pytest

    from kelvara import session

    context = types.SimpleNamespace(master="spark://host:7077", _jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: types.SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda *_: None)))
