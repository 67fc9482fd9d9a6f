"""Text that was decoded with the wrong character encoding: finding it and restoring it (problem 3).

Every character is mapped back to the byte it had in a legacy encoding, and an automaton over the bytes finds the
maximal well-formed multibyte spans; only those spans are decoded, from the inside out until none is left (text may
have been garbled several times). Text confused between two single-byte encodings has no multibyte structure, so there runs
of words are compared under each pair of encodings by letter frequencies, case and script. Replacement characters
mark what can't be restored.

A filter of character classes in the scan's stage keeps out rows that no rule can touch; the rest is one map, without
shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelvara.session import spread

# Encodings that text was read in, and that it was written in.
READ_AS = ("cp1252", "cp1251", "koi8-r", "cp866", "mac-cyrillic", "mac-roman", "cp850")
WRITTEN_AS = ("cp1251", "koi8-r", "cp866", "cp1252", "mac-cyrillic")
# Frequency of the Russian letters, in hundredths of a percent.
LETTER_FREQUENCY = {
    "о": 1097, "е": 845, "а": 801, "и": 735, "н": 670, "т": 626, "с": 547, "р": 473, "в": 454, "л": 440, "к": 349, "м": 321, "д": 298, "п": 281,
    "у": 262, "я": 201, "ы": 190, "ь": 174, "г": 170, "з": 165, "б": 159, "ч": 144, "й": 121, "х": 97, "ж": 94, "ш": 73, "ю": 64, "ц": 48,
    "щ": 36, "э": 32, "ф": 26, "ъ": 4, "ё": 10,
}
# Signs beside letters and ASCII that ordinary text holds.
ORDINARY = "°²³№—–−«»·±≥≤≈×…“”„’‘•§µλΔ½¼¾¬\u00ad\u00a0"

_BARRIER = "\uffff"
_CHAR = (
    r"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    r"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)
_ONE, _SPAN = re.compile(_CHAR), re.compile(f"(?:{_CHAR})+")
#: Characters that text of this kind can hold, or that a second round of garbling leaves.
_PLAUSIBLE = re.compile(
    r"[\x80-\xff\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u0300-\u036f\u0370-\u03ff\u0400-\u045f\u0490\u0491\u2000-\u2044\u2060"
    r"\u20ac\u2116\u2122\u2126\u2190-\u21ff\u2200-\u22ff\u2500-\u25ff\u2700-\u27bf\ufb00-\ufb06\ufeff\uff01-\uff5e\ufffd\U0001f300-\U0001faff]"
)


def _byte_char(encoding: str, b: int) -> str:
    try:
        return bytes([b]).decode(encoding)
    except UnicodeDecodeError:
        return chr(b)


@lru_cache(maxsize=None)
def to_bytes(encoding: str) -> dict[int, int | str]:
    """Translation of characters to the byte (as a character below 256) that the encoding has for them. Bytes that an
    encoding leaves open pass as control characters; anything else above ASCII becomes a barrier where it could be
    taken for a byte."""
    table: dict[int, int | str] = {c: _BARRIER for c in range(0x80, 0x100)}
    for b in range(0x80, 0x100):
        if encoding == "cp1252" and b < 0xA0:
            table[b] = b
        table[ord(_byte_char(encoding, b))] = b
    return table


@lru_cache(maxsize=None)
def between(read_as: str, written_as: str) -> dict[int, str]:
    """Translation of characters read in one single-byte encoding to those of the other."""
    out = {c: _BARRIER for c in range(0x80, 0x100)}
    for b in range(0x80, 0x100):
        right = _byte_char(written_as, b)
        out[ord(_byte_char(read_as, b))] = right if right.isprintable() or right == " " else _BARRIER
    return out


def _accept(encoding: str, chars: list[str], wrong: str, before: str) -> bool:
    """Whether a well-formed span is garbled text rather than ordinary text that happens to be well-formed."""
    if not all(_PLAUSIBLE.match(c) for c in chars):
        return False
    unusual = [c for c in wrong if not (c.isascii() or "А" <= c <= "я" or c in "ёЁ" or c in ORDINARY)]
    if unusual:
        return True
    if encoding == "cp866":
        return len(chars) == 1 and len(wrong) == 3 and wrong[0].islower() and wrong[1:].isupper() or len(chars) >= 3 and wrong[0].islower() and any(c.isupper() for c in wrong)
    if len(chars) >= 2:
        return all("А" <= c <= "я" or c in "ёЁ" or c in ORDINARY for c in chars)
    if len(wrong) == 3 and wrong[0] in "вВ" and not wrong[1].isalpha() and not wrong[2].isalpha():
        return True
    return wrong in ("В°", "Â°") and not before.isalpha()


def _decode_spans(text: str, encoding: str) -> tuple[str, int]:
    """`text` with the accepted spans decoded, and the characters restored."""
    mapped = text.translate(to_bytes(encoding))
    sure: list[tuple[int, int, list[str]]] = []
    weak: list[tuple[int, int, list[str]]] = []
    for m in _SPAN.finditer(mapped):
        # at each character that isn't plausible the span is parted
        pos = start = m.start()
        run: list[str] = []
        pieces = []
        for c in m.group().encode("latin-1").decode("utf-8"):
            size = 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
            if _PLAUSIBLE.match(c):
                run.append(c)
            else:
                pieces.append((start, pos, run))
                run, start = [], pos + size
            pos += size
        pieces.append((start, pos, run))
        for s, e, run in pieces:
            if run and _accept(encoding, run, text[s:e], text[s - 1 : s]):
                sure.append((s, e, run))
            elif run and encoding == "cp1251" and e - s == 2 and text[s] in "РСВГ" and all("А" <= c <= "я" or c in "ёЁ" or c in ORDINARY for c in run):
                weak.append((s, e, run))
    n = sum(len(run) for _, _, run in sure)
    if n >= 3 and weak:
        # beside certain spans of the same encoding, single characters that could be ordinary text are garbled too
        n += len(weak)
        sure = sorted(sure + weak)
    out, at = [], 0
    for s, e, run in sure:
        out += [text[at:s], *run]
        at = e
    return "".join(out) + text[at:], n


_WORD = re.compile(r"\S+")
_HIGH = re.compile(r"[^\x00-\x7f]")
_GERMAN = set("äöüÄÖÜß")
_RUN = re.compile("[а-яё]+")
#: Nats by which a run of words must look better under another pair of encodings.
MARGIN = 5.5


def count_pairs(texts: list[str], run: re.Pattern[str] = _RUN) -> Counter:
    """How often each letter pair occurs in the runs of letters of the texts; "^" stands for the start of a run."""
    pairs: Counter = Counter()
    for t in texts:
        for w in run.findall(t.lower()):
            pairs.update(map("".join, zip("^" + w, w)))
    return pairs


def corpus_pairs(clean: DataFrame, text_col: str, runs: str) -> Counter:
    """`count_pairs` of all distinct texts, counted in Spark: at most one row per letter pair reaches the driver."""
    texts = clean.select(F.col(text_col).alias("t")).distinct()
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("t"), F.lit(runs), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    pairs = words.select("n", F.explode(F.expr("transform(sequence(1, length(w)), i -> substr(concat('^', w), i, 2))")).alias("pair"))
    return Counter({r.pair: r.n for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()})


def fit_letters(texts: list[str]) -> dict[str, float]:
    return letter_model(count_pairs(texts))


def letter_model(pairs: Counter) -> dict[str, float]:
    """Log-probabilities of Russian letter pairs ("^" stands for the start of a word), smoothed by letter frequencies, which count
    alone where there are no pairs."""
    pairs = Counter({p: n for p, n in pairs.items() if p[1] in LETTER_FREQUENCY})
    first: Counter = Counter()
    for p, n in pairs.items():
        first[p[0]] += n
    total = sum(LETTER_FREQUENCY.values())
    return {
        a + b: math.log((pairs[a + b] + 20 * f / total) / (first[a] + 20)) for a in "^" + "".join(LETTER_FREQUENCY) for b, f in LETTER_FREQUENCY.items()
    }


class Restorer:
    """The rules of this module with one letter model."""

    MEMO = 200_000

    def __init__(self, letters: dict[str, float]):
        self.letters = letters
        self.memo: dict[str, float] = {}
        self.hints: dict[str, tuple[float, ...] | None] = {}
        self.tables = [
            (r, w, between(r, w)) for r in READ_AS for w in WRITTEN_AS
            if r != w and not (r == "cp850" and w != "cp1252") and not (r == "mac-roman" and w not in ("cp1252", "cp1251"))
        ]

    def score(self, word: str) -> float:
        """How much a word looks like ordinary text, in nats; 0 for what every encoding shares."""
        known = self.memo.get(word)
        if known is None:
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            known = self.memo[word] = self._score(word)
        return known

    def _score(self, word: str) -> float:
        score, cyr, lat, prev, last = 0.0, False, False, "^", ""
        for c in word:
            low = c.lower()
            if low in LETTER_FREQUENCY:
                score += self.letters[prev + low] - (0.4 if c != low else 0) - (4 if c != low and last.islower() else 0)
                cyr, prev = True, low
            else:
                prev = "^"
                if c < "\x80":
                    lat |= c.isalpha()
                elif c in _GERMAN:
                    score -= 3.5 + (4 if c in "ÄÖÜ" and last.islower() else 0)
                    lat = True
                elif c in ORDINARY:
                    score -= 3.5
                elif c == "\ufffd":
                    score -= 4
                elif c.isalpha() and c < "\u0250":
                    score -= 6
                    lat = True
                else:
                    score -= 9
            last = c if c.isalpha() else ""
        return score - (9 if cyr and lat else 0)

    def step(self, word: str, new: str, base: float, written: str) -> float:
        """What a word says for another pair of encodings."""
        if new == word or (len(word) > 1 and word.endswith("¬")):
            return 0.0
        if word != "¬" and not any(c.isalpha() for c in word):
            return 0.0
        if all(x == y or x in "\u00ad\u00a0" for x, y in zip(word, new)) or _mixed(new):
            return -8.0
        if _BARRIER in new or any(x.isalpha() and not y.isalpha() and y not in "°²³№·" for x, y in zip(word, new)):
            return -8.0
        if written == "cp1252" and not _western(word, new):
            return -8.0
        return self.score(new) - base

    def steps(self, word: str) -> tuple[float, ...]:
        """What a word says for every pair of encodings."""
        known = self.hints.get(word)
        if known is None:
            if len(self.hints) >= self.MEMO:
                self.hints.clear()
            base = self.score(word)
            known = self.hints[word] = tuple(self.step(word, word.translate(t), base, w) for _, w, t in self.tables)
        return known

    def single_byte(self, text: str) -> tuple[str, int]:
        """`text` with the runs of words restored that were confused between two single-byte encodings, and the characters restored."""
        words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text) if _HIGH.search(m.group())]
        steps = [self.steps(w) for _, _, w in words]
        best: list[tuple[float, int, int, dict]] = []
        for k, (_, _, table) in enumerate(self.tables):
            if not any(s[k] > 0 for s in steps):
                continue
            gain, start, top, top_end = 0.0, 0, 0.0, -1
            for i, s in enumerate(steps):
                gain += s[k]
                if gain <= 0:
                    if top > MARGIN:
                        best.append((top, start, top_end, table))
                    gain, start, top, top_end = 0.0, i + 1, 0.0, -1
                elif gain > top:
                    top, top_end = gain, i
            if top > MARGIN:
                best.append((top, start, top_end, table))
        if not best:
            return text, 0
        taken = [False] * len(words)
        edits = []
        for _, a, b, table in sorted(best, key=lambda x: -x[0]):
            if not any(taken[a : b + 1]):
                taken[a : b + 1] = [True] * (b + 1 - a)
                edits.append((words[a][0], words[b][1], table))
        out, at, n = [], 0, 0
        for s, e, table in sorted(edits, key=lambda x: x[0]):
            new = text[s:e].translate(table)
            n += sum(x != y for x, y in zip(new, text[s:e]))
            out += [text[at:s], new]
            at = e
        return "".join(out) + text[at:], n

    @staticmethod
    def spans(text: str) -> tuple[str, int]:
        """`text` with its multibyte spans decoded, encoding by encoding and layer by layer until nothing is left; each pass shortens the text."""
        total = 0
        while _SPAN_GATE.search(text):
            new, n = max((_decode_spans(text, e) for e in ("cp1252", "cp1251", "koi8-r", "cp866", "mac-cyrillic", "mac-roman")), key=lambda x: x[1])
            if not n:
                break
            text, total = new, total + n
        return text, total

    def restore(self, text: str | None) -> tuple[str | None, int, bool]:
        """(restored text, characters restored, whether some can't be)."""
        if not text:
            return text, 0, False
        text, total = self.spans(text)
        if _WORD_GATE.search(text):
            text, n = self.single_byte(text)
            if n:
                # what the words hid may be spans in turn
                text, more = self.spans(text)
                total += n + more
        if not total and _ALONE.search(text):
            total = len(_ALONE.findall(text))
            text = _ALONE.sub(lambda m: {"і": "³", "І": "²", "Ј": "·"}.get(m.group(), "°"), text)
        return text, total, bool(_LOST.search(text))


def _mixed(word: str) -> bool:
    """ASCII letters beside letters of another alphabet, but for units such as °C."""
    w = word.replace("°C", "").replace("°F", "")
    return any(c.isascii() and c.isalpha() for c in w) and any(not c.isascii() and c.isalpha() and c not in _GERMAN for c in w)


def _western(wrong: str, right: str) -> bool:
    """Western letters read in another alphabet: only the usual ones, none that a Latin letter looks like."""
    return all(y in _GERMAN or y in "°²³·±§µ«»" for x, y in zip(wrong, right) if x != y)


_ALONE = re.compile(r"(?<=[mм])[іІ](?=[\W_]|$)|(?<![^\W\d_])(?:∞|њ|ў|╟|б╟)(?=[CСF]\b)|(?<=\d)Ј(?=\w)")
_LOST = re.compile(r"�|[\x80-\x9f]|(?<![?\w])\?{4,}(?!\?)|(?:\?{2,}\s+){3,}")
# Characters that ordinary text and merely look-alike text hold: no sign of a wrong encoding by themselves.
_CALM = (
    r"\t\n\r\x20-\x7EА-Яа-яЁё°²³№—–−«»·±≥≤≈×λΔäöüßÄÖÜ…“”„’‘•§½¼¾\u00a0\u00ad\u0300-\u036f\u0391-\u03c9\u200b-\u200f\u2060\ufb00-\ufb06\ufeff\ufe0f\uff01-\uff5e"
    r"\u2000-\u200a\u202f\u3000\u2600-\u27bf"
)
# A capital of the lead bytes before a sign, as in garbled cp1251, and garbled cp866 punctuation.
_PAIRS = r"[РСВГ][°«»·№±—–ё“”„…’‘•§¬\u00a0\u00ad]|в[€„“”‚][^\s]|т[А-П][А-Я]"
_WORDS = r"[А-ЯЁ]{5}|[a-zA-Z][дцьЯДЦЬ]|[ДЦЬ][a-z]"
_SPAN_GATE = re.compile(rf"[^{_CALM}\U0001f300-\U0001faff]|{_PAIRS}")
_WORD_GATE = re.compile(rf"[^{_CALM}\U0001f300-\U0001faff]|{_WORDS}")


def suspicious(text: Column) -> Column:
    """A necessary condition, in the scan's stage: characters or sequences that some rule of `Restorer` reacts to."""
    return text.rlike(rf"[^{_CALM}\x{{1f300}}-\x{{1faff}}]|{_PAIRS}|{_WORDS}|\?{{2}}")


def repair(docs: DataFrame, id_col: str = "parsed_id", text_col: str = "text") -> DataFrame:
    """(id_col, restored string, changed bigint, lossy boolean): the rows whose text has any part garbled by a wrong
    encoding, with the original where it can be had; `lossy` tells that some characters are gone for good.

    Null and empty texts and clean rows give no row; repeated rows stay repeated; other columns are left out.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    letters = letter_model(corpus_pairs(docs.where(~suspicious(text) & text.rlike("[а-я]{4}")), text_col, _RUN.pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(letters).restore
        for batch in batches:
            keep, texts, changed, lossy = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                new, n, lost = restore(text)
                if n or lost:
                    keep.append(k)
                    texts.append(new)
                    changed.append(n)
                    lossy.append(lost)
            arrays = [batch.column(0).take(pa.array(keep, pa.int32())), pa.array(texts, pa.string()), pa.array(changed, pa.int64()), pa.array(lossy, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "restored", "changed", "lossy"])

    return spread(docs.where(suspicious(text)).select(F.col(id_col), text)).mapInArrow(run, f"`{id_col}` {id_type}, restored string, changed bigint, lossy boolean")
