"""Morphology from a table of forms (form, lemma, pos, tags): lemmas, inflection like another word, agreement of neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import resources as R
from ..functions import text as X

FORMS_SCHEMA = "form string, lemma string, pos string, tags array<string>"
VERBS = frozenset("VERB INFN GRND PRTF PRTS".split())
#: Tags that a replacement takes over from a verb, and from other words.
VERB_TAGS = frozenset("sing plur 1per 2per 3per pres past futr masc femn neut impr".split())
NOUN_TAGS = frozenset("nomn gent datv accs ablt loct voct sing plur".split())
GENDERS = frozenset(("masc", "femn", "neut"))
_CASE = {p: case for case, ps in R.PREPOSITION_CASE.items() for p in ps.split()}


@dataclass
class Morphology:
    """Forms by word and by lemma; of a word's readings the first in the table counts. Small enough for a worker's memory."""

    rows: list[tuple[str, str, str, frozenset]]
    by_form: dict[str, list] = field(default_factory=dict)
    by_lemma: dict[str, list] = field(default_factory=dict)

    def __post_init__(self):
        for form, lemma, pos, tags in self.rows:
            self.by_form.setdefault(form, []).append((lemma, pos, tags))
            self.by_lemma.setdefault(lemma, []).append((form, pos, tags))

    @classmethod
    def of(cls, table: DataFrame) -> Morphology:
        return cls([(r["form"], r["lemma"], r["pos"], frozenset(r["tags"] or ())) for r in table.collect()])

    def lemma(self, word: str) -> str:
        found = self.by_form.get(word.lower())
        return found[0][0] if found else word.lower()

    def inflect(self, word: str, wanted: frozenset) -> str | None:
        """The form of the word's lemma, of one part of speech with it, that has the wanted tags and else most of its own."""
        found = self.by_form.get(word.lower())
        if not found:
            return None
        lemma, pos, tags = found[0]
        fits = [(len(tags & t), -i, f) for i, (f, p, t) in enumerate(self.by_lemma[lemma]) if wanted <= t and (p == pos or {p, pos} <= VERBS)]
        return max(fits)[2] if fits else None

    def like(self, word: str, replacement: str) -> str:
        """replacement in the form of word, as far as both are known."""
        found = self.by_form.get(word.lower())
        if not found:
            return replacement
        _, pos, tags = found[0]
        wanted = tags & (VERB_TAGS if pos in VERBS else NOUN_TAGS)
        return (self.inflect(replacement, wanted) if wanted else None) or replacement

    def agree(self, text: str) -> str:
        """Tokens in agreement with the one before: nouns in the case of a preposition, in the accusative after a verb, and past
        verbs in the gender or number of a noun. Blank texts as they are."""
        if not text.strip():
            return text
        out: list[str] = []
        previous = ""
        for token in text.split():
            word = token.strip(R.PEELED_REVERSE)
            found = self.by_form.get(word.lower())
            new = None
            if found and previous:
                _, pos, tags = found[0]
                before = self.by_form.get(previous.lower(), [])
                if pos == "NOUN" and previous.lower() in _CASE:
                    new = self.inflect(word, frozenset((_CASE[previous.lower()],)))
                elif pos == "NOUN" and any(p in ("VERB", "INFN") for _, p, _ in before):
                    new = self.inflect(word, frozenset(("accs",)))
                elif pos == "VERB" and "past" in tags and before and before[0][1] == "NOUN" and (g := GENDERS & before[0][2]):
                    new = self.inflect(word, frozenset(("past", "plur")) if "plur" in before[0][2] else frozenset(("past",)) | g)
            if new and new != word.lower():
                token = token.replace(word, new)
            out.append(token)
            previous = token.strip(R.PEELED_REVERSE)
        return " ".join(out)


def agreed(c: Column, morphology: Morphology) -> Column:
    """Texts with neighbours in agreement; nulls stay."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if x is None else morphology.agree(x) for x in s], dtype=object)

    return run(c)


def reverse_translate(df: DataFrame, dictionary: dict[str, str], morphology: Morphology, text: str = "text", out: str = "restored") -> DataFrame:
    """df with out: functions.text.reverse_translate() with neighbours in agreement; blank texts as they are."""
    d = X.settled(df, "_back", X.reverse_translate(F.col(text), dictionary))
    return d.withColumn(out, agreed(F.col("_back"), morphology)).drop("_back")


def expanded(resources: R.Resources, morphology: Morphology) -> R.Resources:
    """resources whose one-word rules reach the other forms of their words too: a form without a rule of its own takes that of
    its lemma (of several the first), its replacement in the same form. All is settled before a plan is made, so words are
    still looked up natively."""
    own = resources.words()
    of_lemma: dict[str, str | None] = {}
    for word, replacement in own.items():
        of_lemma.setdefault(morphology.lemma(word), replacement)
    more = []
    for form, readings in morphology.by_form.items():
        if form not in own and readings[0][0] in of_lemma:
            r = of_lemma[readings[0][0]]
            more.append(R.Rule(form, None if r is None else morphology.like(form, r), "form", 1))
    return resources.but(rules=(*resources.rules, *more))


def inflected_like(word: Column, replacement: Column, morphology: Morphology) -> Column:
    """replacement in the form of word; null if either is."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([None if x is None or y is None else morphology.like(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return run(word, replacement)
