"""Files as source rows, and their text: Office Open XML and RTF with the standard library, other formats through readers where installed."""

from __future__ import annotations

import io
import re
import subprocess
import tempfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvara.config import CHUNKING, EXTENSIONS, Chunking
from kelvara.functions import text as T
from kelvara.operators.chunking import chunk_texts

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Seconds that an external converter may take per file.
CONVERTER_S = 60


def scan(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, suffix, length, modified_at, supported, content): the files of a folder; the suffix decides support without regard to
    case. Files without a byte are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    return files.select("path", suffix.alias("suffix"), "length", F.col("modificationTime").alias("modified_at"), suffix.isin(*EXTENSIONS).alias("supported"), "content")


def read_docx(content: bytes) -> str:
    """Paragraphs, then all tables with cells parted by " | "; blank ones left out."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    plain = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    out = [plain(p) for p in body.findall(f"{_W}p")]
    for row in body.iter(f"{_W}tr"):
        out.append(" | ".join(c for c in (plain(x) for x in row.findall(f"{_W}tc")) if c))
    return "\n".join(x for x in out if x)


_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+)\s?\??|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)")
# Groups without text, and control words that stand for a character.
_RTF_SKIP = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator"}
_RTF_CHAR = {"par": "\n", "line": "\n", "tab": "\t", "cell": " | ", "row": "\n", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}


def read_rtf(content: bytes) -> str:
    """The text of an RTF file; \\'hh escapes are in the declared code page."""
    raw = content.decode("latin-1")
    page = re.search(r"\\ansicpg(\d+)", raw)
    encoding = f"cp{page[1]}" if page else "cp1252"
    out, stack, skip = [], [], False
    for hexa, code, word, _, sign, brace, plain in _RTF.findall(raw):
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif sign == "*" or word in _RTF_SKIP:
            skip = True
        elif skip:
            continue
        elif hexa:
            out.append(bytes([int(hexa, 16)]).decode(encoding, "replace"))
        elif code:
            out.append(chr(int(code) % 65536))
        elif word:
            out.append(_RTF_CHAR.get(word, ""))
        elif sign:
            out.append({"~": "\u00a0", "_": "-"}.get(sign, sign if sign in "\\{}" else ""))
        else:
            out.append(plain)
    return "".join(out).strip()


def read_pdf(content: bytes) -> tuple[str, str]:
    """Text of the pages joined by blank lines, by the first installed reader that finds any. A page that can't be read is left out, and a reader that
    fails leaves the file to the next."""
    for name in ("fitz", "pdfplumber"):
        try:
            module = __import__(name)
        except ImportError:
            continue
        try:
            opened = module.open(stream=content, filetype="pdf") if name == "fitz" else module.open(io.BytesIO(content))
            pages = list(opened if name == "fitz" else opened.pages)
        except Exception:  # whatever a reader raises for a broken file
            continue
        texts = []
        for p in pages:
            try:
                texts.append((p.get_text() if name == "fitz" else p.extract_text() or "").strip())
            except Exception:  # one bad page
                continue
        if text := "\n\n".join(t for t in texts if t):
            return text, name
    return "", "no reader for pdf"


def read_doc(content: bytes) -> tuple[str, str]:
    """Text of a legacy document through an installed converter."""
    with tempfile.NamedTemporaryFile(suffix=".doc") as f:
        f.write(content)
        f.flush()
        for command in (["antiword", f.name], ["catdoc", f.name]):
            try:
                done = subprocess.run(command, capture_output=True, timeout=CONVERTER_S)
            except (OSError, subprocess.TimeoutExpired):
                continue
            if done.returncode == 0 and done.stdout.strip():
                return done.stdout.decode("utf-8", "ignore").strip(), command[0]
    return "", "no reader for doc"


def text_of(suffix: str, content: bytes | None) -> tuple[str, str | None, str | None]:
    """(text, reader, reason): the reason tells why there is no text."""
    if not content:
        return "", None, "empty file"
    try:
        if suffix == ".docx":
            text, reader = read_docx(content), "docx"
        elif suffix == ".rtf":
            text, reader = read_rtf(content), "rtf"
        elif suffix == ".pdf":
            text, reader = read_pdf(content)
        elif suffix == ".doc":
            text, reader = read_doc(content)
        else:
            return "", None, "unknown format"
    except Exception as e:  # a broken file is a row with a reason, never a failed job
        return "", None, f"{type(e).__name__}: {e}"[:200]
    return (text, reader, None) if text else ("", None, reader if reader.startswith("no reader") else "no text")


def parse(files: DataFrame, settings: Chunking = CHUNKING) -> DataFrame:
    """Documents of scanned files: path, doc_name, file_stem, filetype, text, chunks array<string>, parsed, extraction_source, reason, char_count, word_count,
    chunk_count, has_formulas, has_table_like_content. Unsupported and unreadable files come as rows with parsed = false and a reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_of(s, c) for s, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            arrays = [batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], pa.string()) for i in range(3))]
            yield pa.RecordBatch.from_arrays(arrays, names=["path", "filetype", "raw", "extraction_source", "reason"])

    read = files.select("path", "suffix", "content").mapInArrow(run, "path string, filetype string, raw string, extraction_source string, reason string")
    text = T.normalize(F.col("raw"))
    named = F.regexp_extract("path", r"([^/]+)$", 1)
    words = F.size(F.filter(F.split("text", f"{T.WS}+"), lambda w: w != ""))
    return read.select("path", named.alias("doc_name"), F.regexp_replace(named, r"\.[^.]*$", "").alias("file_stem"), "filetype", text.alias("text"), "extraction_source", "reason").select(
        "*", chunk_texts(F.col("text"), settings).alias("chunks"), (F.col("text") != "").alias("parsed"), F.length("text").alias("char_count"), words.alias("word_count"),
        (F.size(T.formulas(F.col("text"))) > 0).alias("has_formulas"), T.table_like(F.col("text")).alias("has_table_like_content"),
    ).withColumn("chunk_count", F.size("chunks"))


def failed(parsed: DataFrame) -> DataFrame:
    """(path, reason): the files without text, by path."""
    return parsed.where("not parsed").select("path", "reason").orderBy("path")
