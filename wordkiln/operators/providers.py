"""Pluggable models. A provider maps a pandas Series of texts to one of results; each has a deterministic stand-in."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def as_column(make: Callable[[], Callable[[list], list]], returns: str) -> Callable[..., Column]:
    """A column function of a provider that is built once a Python worker and called with whole Arrow batches.

    A batch that raises gives nulls, so that callers fall back by coalesce().
    """

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = make()
        for s in batches:
            try:
                yield pd.Series(call(s.tolist()))
            except Exception:
                yield pd.Series([None] * len(s))

    return run


@dataclass
class DictionaryLemmatizer:
    """Lemmas from a table of forms; unknown words are their own lemma."""

    forms: dict[str, str]

    def __call__(self, words: list) -> list:
        return [None if w is None else self.forms.get(w.lower(), w) for w in words]


def lemmatize_text(c: Column, forms: dict[str, str]) -> Column:
    """Lower case, Cyrillic words and other runs as tokens, the former by their lemma; without forms the text as it is."""
    if not forms:
        return c
    table = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv])
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)[а-яіїєґёʼ']+|\S+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.when(X.has_cyrillic(w), F.coalesce(F.try_element_at(table, w), w)).otherwise(w)), " ")


def lemmatize_table(df: DataFrame, forms: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """The same with a table of forms (form, lemma) of any size."""
    from .words import exploded, hinted, joined_again

    t = exploded(df, key, F.lower(text)).join(hinted(forms.select(F.col("form").alias("core"), "lemma").dropDuplicates(["core"])), "core", "left")
    return joined_again(t.withColumn(out, F.concat("prefix", F.coalesce("lemma", "core"), "suffix")), df, out)


@dataclass
class HashingEmbedder:
    """Words hashed with signs into dims numbers, scaled to length 1."""

    dims: int = 64

    def __call__(self, texts: list) -> list:
        out = []
        for t in texts:
            v = np.zeros(self.dims)
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dims] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


def embedder(make: Callable[[], Callable[[list], list]] = HashingEmbedder) -> Callable[..., Column]:
    return as_column(make, "array<float>")


@dataclass
class TiktokenCounter:
    """Tokens of byte-pair ranks in a file: base64 and rank by line."""

    ranks: str
    pattern: str = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __call__(self, texts: list) -> list:
        import tiktoken

        if not hasattr(self, "_encoding"):
            with open(self.ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            self._encoding = tiktoken.Encoding("counter", pat_str=self.pattern, mergeable_ranks=table, special_tokens={})
        return [None if t is None else len(self._encoding.encode_ordinary(t)) for t in texts]


def token_counter(make: Callable[[], Callable[[list], list]]) -> Callable[..., Column]:
    return as_column(make, "bigint")


@dataclass
class KeywordModel:
    """Stands in for a language model: says yes to texts that hold a word of the question, and finds fields by patterns."""

    patterns: dict[str, str] | None = None

    def classify(self, texts: list, question: str) -> list:
        words = set(re.findall(r"\w{3,}", question.lower()))
        return ["yes" if words & set(re.findall(r"\w{3,}", (t or "").lower())) else "no" for t in texts]

    def extract(self, texts: list, fields: dict[str, type]) -> list:
        import json

        out = []
        for t in texts:
            found = {k: m.group(m.lastindex or 0) for k in fields if (m := re.search((self.patterns or {}).get(k, r"$^"), t or ""))}
            out.append(json.dumps({k: found.get(k) for k in fields}, ensure_ascii=False) if found else "null")
        return out


ALIASES = {"small": "llama3.2:1b", "medium": "qwen2.5:7b", "large": "qwen2.5:72b"}
BACKENDS = ("ollama", "hf")


@dataclass
class LocalModel:
    """A model behind HTTP, asked once a text. Requests leave from executors; errors become ConnectionError."""

    model: str = "small"
    backend: str = "ollama"
    url: str = "http://localhost:11434/api/generate"
    timeout: float = 60.0
    token: str = ""
    temperature: float = 0.1
    most_tokens: int = 1024

    def __post_init__(self):
        if self.backend not in BACKENDS:
            raise ValueError(f"backend {self.backend!r} is none of {', '.join(BACKENDS)}")
        self.model = ALIASES.get(self.model, self.model)

    def ask(self, prompt: str) -> str:
        import json
        from urllib.error import URLError
        from urllib.request import Request, urlopen

        body = {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": self.temperature, "num_predict": self.most_tokens}}
        if self.backend != "ollama":
            body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": self.temperature, "max_tokens": self.most_tokens}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        try:
            with urlopen(Request(self.url, json.dumps(body).encode(), headers), timeout=self.timeout) as r:
                got = json.load(r)
        except (URLError, OSError) as e:
            raise ConnectionError(f"no answer from {self.url}: {e}") from e
        return got["response"] if self.backend == "ollama" else got["choices"][0]["message"]["content"]

    def classify(self, texts: list, question: str) -> list:
        return [self.ask(f"Answer yes or no only. Is this text about: {question}\n\nText: {t}") for t in texts]

    def extract(self, texts: list, fields: dict[str, type]) -> list:
        names = {str: "text", int: "integer", float: "number", bool: "yes/no"}
        wanted = ", ".join(f"{k} ({names.get(v, v.__name__)})" for k, v in fields.items())
        return [self.ask(f"Return one JSON object with the fields {wanted}, or null if the text has none of them.\n\nText: {t}") for t in texts]


def translator(make: Callable[[], LocalModel] = LocalModel, to: str = "Ukrainian") -> Callable[..., Column]:
    """A column function that asks a model for a translation, text by text; null where there is no answer."""

    def build() -> Callable[[list], list]:
        model = make()

        def one(text: str | None) -> str | None:
            try:
                return None if text is None else model.ask(f"Give this text in {to}, and nothing else.\n\n{text}")
            except ConnectionError:
                return None

        return lambda texts: [one(t) for t in texts]

    return as_column(build, "string")
