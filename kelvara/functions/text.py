"""Text functions as Column expressions: they stay inside the JVM and inside the scan's stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; Java's \s only knows ASCII.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_\-./]*[\p{L}\p{N}_])?"
SENTENCE_END = rf"(?<=[.!?]){WS}+"
NUMBER = r"-?\d+(?:[.,]\d+)?"
KEYWORD = r"[A-Za-zА-Яа-я0-9._-]{3,}"
DOCUMENT_CODE = r"(?iu)(?:СП\s?\d+\.\d+|ГОСТ\s?\d+(?:-\d+)?|СНиП\s?[\d.-]+)"
SECTION_REF = r"(?iu)(?:пункт\s?\d+(?:\.\d+)*|раздел\s?\d+(?:\.\d+)*)"
FORMULA = r"[A-Za-zА-Яа-я0-9_]+\s*=\s*[^=\n]{3,120}"
AGENT_FORMULA = r"[A-Za-zА-Яа-я][_\p{L}\p{N}]*\s*=\s*[^;.\n]+"
BRACKET_FORMULA = r"\(([^)]*[=+\-*/^][^)]*)\)"
VARIABLE = r"[A-Za-zА-Яа-я_]+"


def rounded(x: Column, places: int = 6) -> Column:
    """To some places, for results that other engines compute too: a billionth more decides exact halves the same way everywhere."""
    return F.round(x + F.lit(1e-9), places)


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def normalize(text: Column) -> Column:
    """NUL to space, line ends to \\n, runs of spaces and tabs to one space, at most one blank line, no space at the ends."""
    out = F.regexp_replace(text, r"\x00", " ")
    for pattern, to in ((r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, to)
    return strip(out)


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, rf"\n{WS}*\n"), strip), lambda p: p != "")


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def tokens(text: Column) -> Column:
    """Lower-case words; inner hyphens, dots and slashes belong to them."""
    return every(F.lower(text), TOKEN)


def terms(text: Column) -> Column:
    """Tokens and their neighbours as pairs."""
    t = tokens(text)
    pairs = F.zip_with(t, F.slice(t, 2, F.greatest(F.size(t), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.concat(t, F.filter(pairs, lambda p: p.isNotNull()))


def keywords(text: Column) -> Column:
    return F.transform(every(text, KEYWORD), F.lower)


def domain_terms(text: Column, stop_words: tuple[str, ...], most: int = 15) -> Column:
    return F.slice(F.filter(keywords(text), lambda w: ~w.isin(*stop_words)), 1, most)


def numbers(text: Column) -> Column:
    return F.transform(every(text, NUMBER), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))


def formulas(text: Column, most: int = 20) -> Column:
    """Distinct formula mentions in order of appearance; a formula of Q or R is always one of the general form."""
    raw = F.filter(F.transform(every(text, FORMULA), strip), lambda x: F.length(x) >= 4)
    return F.slice(F.array_distinct(raw), 1, most)


def has_operator(raw: Column) -> Column:
    return raw.rlike(r"[=+\-*/]")


def variables(raw: Column) -> Column:
    return F.array_sort(F.array_distinct(every(raw, VARIABLE)))


def agent_formulas(text: Column) -> Column:
    plain = F.transform(F.filter(every(text, AGENT_FORMULA), lambda x: F.length(x) > 3), strip)
    bracket = F.transform(F.filter(every(text, BRACKET_FORMULA, 1), lambda x: F.length(x) > 3), lambda x: F.concat(F.lit("("), x, F.lit(")")))
    return F.array_distinct(F.concat(plain, bracket))


def table_like(text: Column) -> Column:
    """Has a pipe, or two of its first twelve lines look tabular (a wide gap or three numbers)."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda x: x != "")
    tabular = F.filter(F.slice(lines, 1, 12), lambda x: x.rlike(rf"{WS}{{2,}}") | (F.size(every(x, r"\p{Nd}+")) >= 3))
    return F.contains(text, F.lit("|")) | ((F.size(lines) >= 2) & (F.size(tabular) >= 2))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def starts_with_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.startswith(text, F.lit(w))
    return out


def query_pattern(query: Column) -> Column:
    """Letters, digits and spaces only, lower case, words over two letters, the first eight."""
    words = F.split(F.lower(F.regexp_replace(query, r"[^\p{L}\p{N}\s]", " ")), rf"{WS}+")
    return F.array_join(F.slice(F.filter(words, lambda w: F.length(w) > 2), 1, 8), " ")


def smart_overlap(text: Column) -> Column:
    """The text from its first full word on, if that word starts in its first half."""
    s = strip(text)
    p = F.instr(s, " ") - 1
    return F.when((p > 0) & (p < F.floor(F.length(s) / 2)), strip(F.substring(s, p + 2, F.length(s)))).otherwise(s)


def first_sentence_with(text: Column, term: Column) -> Column:
    return F.get(F.filter(sentences(text), lambda s: F.contains(F.lower(s), term)), F.lit(0))


def best_definition(text: Column, term: Column, longest: int = 100) -> Column:
    """The shortest sentence with the term, earliest among equals; sentences of `longest` characters or more never win."""
    fit = F.filter(sentences(text), lambda s: F.contains(F.lower(s), F.lower(term)) & (F.length(s) < longest))
    ranked = F.transform(fit, lambda s, i: F.struct(F.length(s).alias("n"), i.alias("i"), s.alias("s")))
    return strip(F.array_min(ranked)["s"])


def shortened(text: Column, longest: int, end: str = "...") -> Column:
    """At most `longest` characters, with `end` where something was cut."""
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit(end))).otherwise(text)
