"""Noise in text from scanned pages: cut words, misread characters, running headers and page numbers (problem 5).

The evidence is gathered in SQL over the whole corpus. Every word has an anagram hash, a sum over its characters, so a
misreading changes the hash by a fixed difference; rare words join frequent ones through the differences of a confusion
table, the alignment is verified, and the most frequent reading wins. A word cut at a line end is judged by how often
the corpus has it joined or hyphenated. Edge lines are found by their form and their repetition within a text. The
repair then runs once per affected text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelvara.session import cut_lineage

# What a reader of printed pages takes for what, as misread > right.
CONFUSIONS = "0>о 0>o 3>з 4>ч 6>б ь1>ы 1о>ю /|>л }{>ж гт>п !>i 1>l 1>i c>e rn>m |>l 5>s ii>п и'>й cl>d vv>w li>h гн>ш"
PAIRS = [tuple(x.split(">")) for x in CONFUSIONS.split()]
_SPLIT = r"[^\p{L}\p{N}/|!}{\-']+"
_SHAPE = "|".join(re.escape(w) for w in sorted({w for w, _ in PAIRS}, key=len, reverse=True))
#: A frequent word is at least this frequent, and so many times as frequent as a misreading made of letters alone.
FREQUENT, RATIO = 3, 30
#: Readings of a word up to which they are enumerated by hash differences; others meet on their merged form.
MOST_SUMS = 256
_HASH_BITS = (1 << 40) - 1


def raw_words(text: Column) -> Column:
    """Lower-case words with what misreading puts inside them, and with signs around them."""
    return F.explode(F.split(F.lower(text), _SPLIT))


def bare(word: Column) -> Column:
    """A word without the signs around it."""
    return F.regexp_replace(word, r"^[-/|!}{']+|(?<!и)'+$|[-/|!}{]+$", "")


def anagram_hash(word: Column) -> Column:
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda acc, c: acc + F.xxhash64(c).bitwiseAND(F.lit(_HASH_BITS)))


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts."""
    # counted first and stripped afterwards, so that the stripping sees every spelling once
    raw = docs.where(F.col(text_col).isNotNull()).select(raw_words(F.col(text_col)).alias("raw")).where("length(raw) >= 3").groupBy("raw").agg(F.count("*").alias("n"))
    return raw.select(bare(F.col("raw")).alias("word"), "n").where("length(word) >= 3").groupBy("word").agg(F.sum("n").alias("n"))


def aligned(wrong: str, right: str) -> bool:
    """Whether `wrong` becomes `right` by misreadings of the table alone."""
    done: set[tuple[int, int]] = set()
    stack = [(0, 0)]
    while stack:
        i, j = stack.pop()
        if (i, j) in done:
            continue
        done.add((i, j))
        if i == len(wrong) and j == len(right):
            return True
        if i < len(wrong) and j < len(right) and wrong[i] == right[j]:
            stack.append((i + 1, j + 1))
        stack += [(i + len(a), j + len(b)) for a, b in PAIRS if wrong.startswith(a, i) and right.startswith(b, j)]
    return False


def merged(word: Column) -> Column:
    """A word in which whatever the table takes for one another is spelt the same: a necessary condition for `aligned`. Right letters are spelt as
    their misreadings, so that no two replacements compete for a character."""
    out = F.replace(F.translate(word, "0o346!1|ie5", "оозчбllllcs"), F.lit("гт"), F.lit("ll"))
    for right, wrong in (("d", "cl"), ("h", "ll"), ("m", "rn"), ("w", "vv"), ("п", "ll"), ("ш", "гн"), ("ы", "ьl"), ("ю", "lо"), ("л", "/l"), ("ж", "}{"), ("й", "и'")):
        out = F.replace(out, F.lit(right), F.lit(wrong))
    return out


def corrections(vocab: DataFrame) -> DataFrame:
    """(word, right): misread words with the most frequent word that they can stand for; ties by alphabet.

    `vocab` (word, n) must be stable, as it is read as rare and as frequent side.
    """
    spark = vocab.sparkSession
    letters = F.col("word").rlike(r"^[\p{L}\-]+$")
    frequent = vocab.where(letters & (F.col("n") >= FREQUENT) & ~F.col("word").rlike(r"ь1|[a-z][а-яё]|[а-яё][a-z]")).select(F.col("word").alias("right"), F.col("n").alias("right_n"), anagram_hash(F.col("word")).alias("key"))
    table = spark.createDataFrame(PAIRS, "wrong string, good string").select("wrong", (anagram_hash(F.col("good")) - anagram_hash(F.col("wrong"))).alias("d"))
    # about 20 rows, sent along as one array
    pairs = F.array(*[F.struct(F.lit(r.wrong).alias("wrong"), F.lit(r.d).cast("bigint").alias("d")) for r in table.collect()])
    times = F.transform(pairs, lambda p: F.struct(p["d"].alias("d"), F.floor((F.length("word") - F.length(F.replace("word", p["wrong"], F.lit("")))) / F.length(p["wrong"])).alias("n")))
    rare = vocab.where(F.col("word").rlike(_SHAPE) & F.col("word").rlike(r"\p{L}{2}")).withColumn("times", F.filter(times, lambda t: t["n"] > 0))
    rare = rare.withColumn("many", F.aggregate("times", F.lit(1.0).cast("double"), lambda a, t: a * (t["n"] + 1)))
    # every sum of differences, any number of times each: the hashes of all readings
    sums = F.aggregate(
        "times", F.array(F.lit(0).cast("bigint")), lambda acc, t: F.flatten(F.transform(acc, lambda s: F.transform(F.sequence(F.lit(0).cast("bigint"), t["n"]), lambda k: s + k * t["d"])))
    )
    fit = lambda wrong, right: (
        (right != wrong) & (F.col("right_n") > F.col("n")) & (~letters | ((F.col("right_n") >= RATIO * F.col("n")) & (F.length(right) >= 4))) & (F.length(right) >= 3)
    )
    keys = rare.where(F.col("many") <= MOST_SUMS).select("word", "n", F.explode(F.array_distinct(sums)).alias("sum")).where("sum <> 0")
    keys = keys.withColumn("key", anagram_hash(F.col("word")) + F.col("sum"))
    joined = keys.join(frequent, "key").where(fit(F.col("word"), F.col("right"))).select("word", "right", "right_n")
    # words with more readings than that meet on the form in which all readings are one
    dense = rare.where(F.col("many") > MOST_SUMS).select("word", "n", merged(F.col("word")).alias("form"))
    joined = joined.unionByName(dense.join(frequent.withColumn("form", merged(F.col("right"))), "form").where(fit(F.col("word"), F.col("right"))).select("word", "right", "right_n"))

    @F.pandas_udf("boolean")
    def fits(wrong: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([aligned(a, b) for a, b in zip(wrong, right)])

    verified = joined.distinct().where(fits("word", "right"))
    best = verified.groupBy("word").agg(F.max_by("right", F.struct("right_n", F.col("right"))).alias("right"))
    # written anew, as Spark would else infer the conditions above, with all their sums, for every word that is joined to these
    return best.select(F.concat("word", F.lit("")).alias("word"), "right")


_CUT = r"([\p{L}\p{N}/|!}{]*[\p{L}])([-\u2010\u00ac\u00ad])[ \t]*\r?\n[ \t]*([\p{Ll}][\p{L}\p{N}/|!}{]*)"
_PAGE = (
    r"(?:[-\u2013\u2014]\s*\d{1,4}\s*[-\u2013\u2014]|\d{1,4}\s*/\s*\d{1,4}|\[\s*\d{1,4}\s*\]|[Сс]\.\s*\d{1,4}|[Сс]тр\.?\s*\d{1,4}(?:\s+из\s+\d{1,4})?"
    r"|[Сс]траница\s+\d{1,4}(?:\s+из\s+\d{1,4})?|[Pp]age\s+\d{1,4}(?:\s+of\s+\d{1,4})?|[Ss]eite\s+\d{1,4}(?:\s+von\s+\d{1,4})?|[Pp]\.\s*\d{1,4})"
)
_PAGE_LINE = rf"(?m)^[ \t]*{_PAGE}[ \t]*$"
_BARE = r"(?:^|\n)(?!\s*\d+\s*\n)[^\n]*[^\n:\s]\s*\n\s*\d{1,4}[ \t]*(?:$|\n\s*(?!\d+[ \t]*(?:\n|$))\S)"
_NUMBERED_HEADER = r"[\p{L}\p{N}.»)] {2,}\d{1,4}[ \t]*(?:\r?\n|$)"


def _header_forms(text: Column) -> Column:
    """Lines that could be running headers, digits made alike."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$|\s+\d{1,4}\s*$", ""), r"\d+", "#"))
    return F.filter(lines, lambda x: F.length(x).between(6, 90) & x.rlike(r"\p{L}{3}") & ~x.rlike(r"[|]|[.;:,\-\u00ac\u00ad]$|^[-\u2022]"))


def edge_signs(text: Column) -> Column:
    """Page numbers or running headers of the scan."""
    forms = _header_forms(text)
    return text.contains("\n") & (text.rlike(_PAGE_LINE) | text.rlike(_BARE) | text.rlike(_NUMBERED_HEADER) | (F.size(forms) > F.size(F.array_distinct(forms))))


def evidence(docs: DataFrame, id_col: str = "parsed_id", text_col: str = "text") -> DataFrame:
    """(id_col, cuts array<string>, fixes array<struct<word,right>>, edges boolean): one row per text that shows words cut at line
    ends, misread characters, running headers or page numbers.

    Wrapped lines, lists of values, designations and hyphenated compounds alone give no row, nor do null and empty texts.
    Rows repeated under one id count once; a null id takes no part.
    """
    docs = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    vocab = cut_lineage(vocabulary(docs))
    text = F.col("text")
    # every match is found once; its parts are read from the match
    part = lambda k: F.regexp_extract("m", _CUT, k)
    cut = docs.where(text.rlike(r"\p{L}[-\u2010\u00ac\u00ad][ \t]*\r?\n")).select("id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(_CUT), F.lit(0)))).alias("m"))
    cut = cut.select("id", part(1).alias("l"), part(2).alias("sign"), part(3).alias("r"))
    cut = cut_lineage(cut.select("id", "l", "r", "sign", F.lower(F.concat("l", "r")).alias("joined"), F.lower(F.concat_ws("-", "l", "r")).alias("compound")).distinct())
    # a cut word is misread as a whole, so the joined forms are corrected beside the words
    whole = cut.where(F.col("joined").rlike(_SHAPE)).groupBy(F.col("joined").alias("word")).agg(F.count("*").alias("n")).join(vocab.select("word"), "word", "left_anti")
    right = cut_lineage(corrections(cut_lineage(vocab.unionByName(whole))))
    # distinct misread words are few, but their number grows; Spark sees the size and broadcasts or shuffles
    tokens = docs.where(F.lower("text").rlike(_SHAPE)).select("id", raw_words(F.col("text")).alias("raw")).where(F.col("raw").rlike(_SHAPE)).select("id", bare(F.col("raw")).alias("word"))
    tokens = tokens.unionByName(cut.where(F.col("joined").rlike(_SHAPE)).select("id", F.col("joined").alias("word")))
    fixes = tokens.join(right, "word").groupBy("id").agg(F.collect_set(F.struct("word", "right")).alias("fixes"))
    joined_n = vocab.select(F.col("word").alias("joined"), F.col("n").alias("joined_n"))
    compound_n = vocab.select(F.col("word").alias("compound"), F.col("n").alias("compound_n"))
    judged = cut.join(joined_n, "joined", "left").join(compound_n, "compound", "left")
    is_cut = (~F.col("sign").isin("-", "\u2010")) | F.coalesce("compound_n", F.lit(0)).eqNullSafe(0) | (F.coalesce("joined_n", F.lit(0)) > F.col("compound_n"))
    cuts = judged.where(is_cut).groupBy("id").agg(F.collect_set(F.concat_ws("\n", "l", "r")).alias("cuts"))
    edges = docs.where(edge_signs(text)).select("id", F.lit(True).alias("edges")).distinct()
    every = fixes.join(cuts, "id", "full").join(edges, "id", "full")
    empty = "array()"
    return every.select(
        F.col("id").alias(id_col), F.coalesce("cuts", F.expr(f"cast({empty} as array<string>)")).alias("cuts"),
        F.coalesce("fixes", F.expr(f"cast({empty} as array<struct<word:string,right:string>>)")).alias("fixes"), F.coalesce("edges", F.lit(False)).alias("edges"),
    )


_PY_PAGE = re.compile(rf"\s*(?:{_PAGE}|\d{{1,4}})\s*")
_PY_CUT = re.compile(r"([\w/|!}{]*[^\W\d_])([-\u2010\u00ac\u00ad])[ \t]*\n[ \t]*([a-zа-яёäöüß][\w/|!}{]*)")
_PY_WORD = re.compile(r"[\w/|!}{\-']+")


def _without_edges(lines: list[str]) -> list[str]:
    """Lines without page numbers and running headers. A number beside other numbers, or under a colon, is a value."""

    def form(x: str) -> str:
        return re.sub(r"\d+", "#", re.sub(r"\s+\d{1,4}\s*$", "", x.strip()))

    seen: dict[str, int] = {}
    for x in lines:
        f = form(x)
        if 6 <= len(f) <= 90 and re.search(r"[^\W\d_]{3}", f) and not re.search(r"[|]|[.;:,\-¬]$|^[-•]", f):
            seen[f] = seen.get(f, 0) + 1
    full = [i for i, x in enumerate(lines) if x.strip()]
    place = {i: k for k, i in enumerate(full)}
    out = []
    for i, x in enumerate(lines):
        s = x.strip()
        if s and _PY_PAGE.fullmatch(s):
            k = place[i]
            near = [lines[full[j]].strip() for j in (k - 1, k + 1) if 0 <= j < len(full)]
            bare = s.isdigit()
            if not bare or (not any(n.isdigit() for n in near) and not (k and lines[full[k - 1]].rstrip().endswith(":"))):
                continue
        if s and (seen.get(form(x), 0) > 1 or (re.search(r"\S {2,}\d{1,4}$", s) and " | " not in s)):
            continue
        out.append(x)
    return out


def clean(text: str, cuts: list[str], fixes: dict[str, str]) -> str:
    """Continuous paragraphs of a scanned text."""
    lines = _without_edges(text.replace("\r\n", "\n").split("\n"))
    text = "\n".join(lines)
    known = set(cuts)
    text = _PY_CUT.sub(lambda m: m[1] + m[3] if f"{m[1]}\n{m[3]}" in known else f"{m[1]}-{m[3]}", text)
    paragraphs, current = [], ""
    for line in text.split("\n"):
        s = line.strip()
        if not s or " | " in s or re.match(r"[-•]\s", s):
            if current:
                paragraphs.append(current)
            current = ""
            if s:
                current = s
                if " | " in s:
                    paragraphs.append(current)
                    current = ""
            continue
        current = f"{current} {s}" if current else s
    if current:
        paragraphs.append(current)

    def fix(m: re.Match) -> str:
        w = m.group()
        core = w.strip("-/|!}{")
        core = core if core.endswith("и'") else core.strip("'")
        right = fixes.get(core.lower())
        if right is None:
            return w
        if core[:1].isupper() or (not core[:1].isalpha() and w is m.group() and m.start() and m.string[max(0, m.start() - 2) : m.start()] in (". ", "\n")):
            right = right[:1].upper() + right[1:]
        return w.replace(core, right, 1)

    body = "\n\n".join(paragraphs)
    return _PY_WORD.sub(fix, body) if fixes else body


def repair(docs: DataFrame, found: DataFrame, id_col: str = "parsed_id", text_col: str = "text") -> DataFrame:
    """(id_col, repaired string): the texts with evidence as continuous paragraphs."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))
            texts = [clean(t, cuts, {f["word"]: f["right"] for f in fixes}) for t, cuts, fixes in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "repaired"])

    joined = docs.where(F.col(text_col).isNotNull()).join(found, id_col).select(F.col(id_col), F.col(text_col), "cuts", "fixes")
    return joined.mapInArrow(run, f"`{id_col}` {id_type}, repaired string")
