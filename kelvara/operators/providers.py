"""Pluggable models at the edge of a plan: text generation and sentence embedding. Without a provider the columns are null, so that every plan
runs offline."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvara.config import EMBEDDING_BATCH
from kelvara.texts import PROMPTS

Generate = Callable[[str], str | None]
Embed = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class HttpGenerator:
    """A generation endpoint that takes {model, prompt, stream, options} and answers {response}; any failure gives None."""

    url: str
    model: str
    temperature: float = 0.2
    timeout_s: float = 120

    def __call__(self, prompt: str) -> str | None:
        body = json.dumps({"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": self.temperature}}).encode()
        request = urllib.request.Request(f"{self.url}/api/generate", body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout_s) as r:
                return json.load(r).get("response") or None
        except (urllib.error.URLError, OSError, ValueError):
            return None

    def healthy(self, timeout_s: float = 2) -> bool:
        try:
            with urllib.request.urlopen(f"{self.url}/api/tags", timeout=timeout_s) as r:
                return r.status == 200
        except (urllib.error.URLError, OSError):
            return False


@dataclass(frozen=True)
class KeyedHttpGenerator:
    """A generation endpoint that takes {contents: [{parts: [{text}]}]} with a key in a header and answers {candidates: [{content: {parts: [{text}]}}]}; any
    failure, and an empty key, give None."""

    url: str
    key: str
    key_header: str = "x-goog-api-key"
    timeout_s: float = 120

    def __call__(self, prompt: str) -> str | None:
        if not self.key:
            return None
        body = json.dumps({"contents": [{"parts": [{"text": prompt}]}]}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", self.key_header: self.key})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout_s) as r:
                parts = json.load(r)["candidates"][0]["content"]["parts"]
                return "".join(p.get("text", "") for p in parts) or None
        except (urllib.error.URLError, OSError, ValueError, LookupError, TypeError):
            return None


def first_of(*providers: Generate) -> Generate:
    """The first answer that isn't empty."""

    def run(prompt: str) -> str | None:
        return next((a for p in providers if (a := p(prompt))), None)

    return run


def generate(rows: DataFrame, prompt_col: str, provider: Generate | None, out_col: str = "answer") -> DataFrame:
    """Adds the provider's answer to every prompt; null without a provider, prompt or answer."""
    if provider is None:
        return rows.withColumn(out_col, F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def answer(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in prompts:
            yield p.map(lambda x: provider(x) if x else None)

    return rows.withColumn(out_col, answer(prompt_col))


def embed(rows: DataFrame, text_col: str, model: Callable[[], Embed] | None, out_col: str = "vec", batch: int = EMBEDDING_BATCH) -> DataFrame:
    """Adds an embedding to every non-blank text. `model` builds the encoder once per task; it gets at most `batch` texts at a time."""
    if model is None:
        return rows.withColumn(out_col, F.lit(None).cast("array<float>"))

    @F.pandas_udf("array<float>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = model()
        for t in texts:
            out: list = [None] * len(t)
            full = [i for i, x in enumerate(t) if x and x.strip()]
            for at in range(0, len(full), batch):
                part = full[at : at + batch]
                for i, v in zip(part, run([t.iloc[i] for i in part])):
                    out[i] = v
            yield pd.Series(out)

    return rows.withColumn(out_col, encode(text_col))


def prompt_template(kind: str) -> str:
    """The prompt of a kind of question, with {names} for its fields."""
    head, fields, steps = PROMPTS[kind]
    parts = [head, *(f"{title}:\n{{{name}}}" for title, name in fields), "Инструкция:\n" + "\n".join(f"{i}. {x}" for i, x in enumerate(steps, 1)), "Ответ:"]
    return "\n\n".join(parts)


def prompts(template: str, **columns: str):
    """A Column with the template's {names} filled from columns; nulls become empty."""
    parts, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(before), F.coalesce(F.col(columns[name]).cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))
