"""One consistent form for text whose characters only look right (problem 7).

Compatibility forms (full-width, ligatures, mathematical letters) are normalised, separate accents composed, ignorable
characters deleted and all spaces made U+0020. A word that mixes alphabets becomes a lattice of look-alike letters, and
Viterbi finds the best path under letter-pair scores with a price on changing the script; a path is taken only if it
ends in one script, so project notation that joins two alphabets stays as it is.

Rows without any such character are kept out by one class filter in the scan's stage; the rest is one map.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelvara.llm.encodings import _RUN, Restorer, corpus_pairs, count_pairs, letter_model
from kelvara.llm.encodings import suspicious as maybe_garbled
from kelvara.session import spread

# Letters that look alike, as Latin, Cyrillic, Greek; "." where an alphabet has none.
LOOK_ALIKE = "aаα eе. oоο pр. cс. yу. xх. iіι jј. sѕ. hһ. vѵν AАΑ BВΒ EЕΕ KКΚ MМΜ HНΗ OОΟ PРΡ CС. TТΤ XХΧ YУΥ IІΙ JЈ. SЅ. Z.Ζ N.Ν ëё. ËЁ. ïї. dԁ. wԝ. qԛ. lӏ. ".split()
INVISIBLE = r"\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufe00-\ufe0f"
SPACES = r"\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
COMPATIBLE = r"\u2160-\u217f\ufb00-\ufb06\uff01-\uff5e\uff61-\uffbe\U0001d400-\U0001d7ff\u212a\u212b\u2126\u0132\u0133\u01c4-\u01cc\u01f1-\u01f3\u3300-\u33ff"
ACCENTS = r"\u0300-\u036f"

_SIMPLE = re.compile(f"[{INVISIBLE}{SPACES}{COMPATIBLE}{ACCENTS}]")
_SPACE, _COMPATIBLE = re.compile(f"[{SPACES}]"), re.compile(f"[{COMPATIBLE}]+")
_ACCENTED = re.compile(f".[{ACCENTS}]+", re.DOTALL)
_EMOJI_JOIN = re.compile("(?<=[\u2190-\u2bff\U0001f000-\U0001faff])[\u200d\ufe0f]+(?=[\u2190-\u2bff\U0001f000-\U0001faff\\s]|$)")
_DROP = re.compile(f"({_EMOJI_JOIN.pattern})|[{INVISIBLE}]")
_LETTERS = re.compile(r"[^\W\d_]+")
_MIXES = r"[A-Za-z\u00c0-\u024f][\u0370-\u03ff\u0400-\u052f]|[\u0370-\u03ff\u0400-\u052f][A-Za-z\u00c0-\u024f]|[\u0370-\u03ff][\u0400-\u052f]|[\u0400-\u052f][\u0370-\u03ff]"
_MIXED = re.compile(_MIXES)


def script(c: str) -> str:
    if c < "ɐ":
        return "L"
    if "Ͱ" <= c <= "Ͽ":
        return "G"
    return "C" if "Ѐ" <= c <= "ԯ" else "?"


_CLASS: dict[str, list[tuple[str, str]]] = {}
for group in LOOK_ALIKE:
    members = [(c, script(c)) for c in group if c != "."]
    for c, _ in members:
        _CLASS.setdefault(c, []).extend(m for m in members if m[0] != c)


_LATIN_RUN = re.compile("[a-zäöüß]+")


def fit_latin(texts: list[str]) -> dict[str, float]:
    return latin_model(count_pairs(texts, _LATIN_RUN))


def latin_model(pairs: Counter) -> dict[str, float]:
    """Log-probabilities of Latin letter pairs, smoothed evenly."""
    letters = "abcdefghijklmnopqrstuvwxyzäöüß"
    pairs = Counter({p: n for p, n in pairs.items() if p[1] in letters})
    first: Counter = Counter()
    for p, n in pairs.items():
        first[p[0]] += n
    return {a + b: math.log((pairs[a + b] + 0.5) / (first[a] + 15)) for a in "^" + letters for b in letters}


class Normaliser:
    """The consistent form under one pair of letter models."""

    MEMO = 100_000
    SWITCH = -8.0
    CHANGE = -0.5

    def __init__(self, cyrillic: dict[str, float], latin: dict[str, float]):
        self.models = {"C": cyrillic, "L": latin, "G": {}}
        self.memo: dict[str, str] = {}

    def word(self, w: str) -> str:
        """The single-script spelling of a word that mixes alphabets, or the word itself."""
        known = self.memo.get(w)
        if known is None:
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            known = self.memo[w] = self._viterbi(w)
        return known

    def _viterbi(self, w: str) -> str:
        states: list[list[tuple[str, str]]] = [[(c, script(c)), *_CLASS.get(c, [])] for c in w]
        best = {s: (self._pair("^", s) + (self.CHANGE if s[0] != w[0] else 0), [s]) for s in states[0]}
        for i in range(1, len(w)):
            new = {}
            for s in states[i]:
                cost = self.CHANGE if s[0] != w[i] else 0.0
                score, path = max(((v + (self._pair(p[0], s) if p[1] == s[1] else self.SWITCH), path) for p, (v, path) in best.items()), key=lambda x: x[0])
                new[s] = (score + cost, path + [s])
            best = new
        path = max(best.values(), key=lambda x: x[0])[1]
        if len({s for _, s in path}) > 1:
            # the best path within one script, if there is one
            whole = []
            for target in ("C", "L", "G"):
                if all(any(s == target for _, s in st) for st in states):
                    path = [next(x for x in st if x[1] == target) for st in states]
                    score = sum(self._pair(before, x) for before, x in zip(["^", *(c for c, _ in path)], path)) + self.CHANGE * sum(x[0] != c for x, c in zip(path, w))
                    whole.append((score, "".join(c for c, _ in path)))
            return max(whole, key=lambda x: x[0])[1] if whole else w
        return "".join(c for c, _ in path)

    def _pair(self, before: str, s: tuple[str, str]) -> float:
        return self.models[s[1]].get(before.lower() + s[0].lower(), -7.0)

    def normalise(self, text: str | None) -> tuple[str | None, bool]:
        """(consistent form, whether the text differed from it in look-alike or invisible characters)."""
        if not text:
            return text, False
        found = False
        if _SIMPLE.search(text):
            # joiners inside an emoji are part of its look
            new = _DROP.sub(lambda m: m[1] or "", text)
            new = _SPACE.sub(" ", _COMPATIBLE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), new))
            new = _ACCENTED.sub(lambda m: _compose(m.group()), new)
            found = new != text
            text = new
        if _MIXED.search(text):
            out, at = [], 0
            for m in _LETTERS.finditer(text):
                w = m.group()
                if len(w) > 1 and _MIXED.search(w):
                    new = self.word(w)
                    if new != w:
                        found = True
                        out += [text[at : m.start()], new]
                        at = m.end()
            if at:
                text = "".join(out) + text[at:]
        return text, found


def _compose(s: str) -> str:
    """A letter with its accents composed; accents that have no composed form stay, as x̂ is not x."""
    return unicodedata.normalize("NFC", s)


def has_signs(text: Column) -> Column:
    """A necessary condition in the scan's stage."""
    wide = COMPATIBLE.replace(r"\U0001d400-\U0001d7ff", r"\x{1d400}-\x{1d7ff}")
    return text.rlike(f"[{INVISIBLE}{SPACES}{wide}{ACCENTS}]|{_MIXES}")


def consistent(docs: DataFrame, id_col: str, text_col: str = "text", garbled_apart: bool = True) -> DataFrame:
    """(id_col, consistent string, garbled boolean): the rows whose text differs from its consistent form, with that form.

    `garbled` marks text of which any part was read in a wrong encoding (problem 3); with `garbled_apart` it gives no row, else its form is that
    of the restored text. Null and empty texts and consistent rows give no row; repeated rows stay repeated; other columns are left out.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    pairs = corpus_pairs(docs.where(~has_signs(text) & ~maybe_garbled(text)), text_col, f"{_RUN.pattern}|{_LATIN_RUN.pattern}")
    # "^" starts the runs of both alphabets; each model takes the pairs that end in its letters
    cyrillic, latin = letter_model(pairs), latin_model(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normalise, restore = Normaliser(cyrillic, latin).normalise, Restorer(cyrillic).restore
        for batch in batches:
            keep, texts, marks = [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                new, found = normalise(t)
                if not found:
                    continue
                restored, changed, lost = restore(t)
                if garbled_apart and (changed or lost):
                    continue
                keep.append(k)
                texts.append(normalise(restored)[0] if changed else new)
                marks.append(bool(changed or lost))
            arrays = [batch.column(0).take(pa.array(keep, pa.int32())), pa.array(texts, pa.string()), pa.array(marks, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "consistent", "garbled"])

    return spread(docs.where(has_signs(text)).select(F.col(id_col), text)).mapInArrow(run, f"`{id_col}` {id_type}, consistent string, garbled boolean")
