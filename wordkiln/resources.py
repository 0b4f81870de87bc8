"""Language resources as small tables, with a seed; every operator takes others in their place."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

RULES_SCHEMA = "word string, replacement string, ngram int, kind string, ord int"
PATTERNS_SCHEMA = "regex string, replacement string, kind string, ord int"
LEXICON_SCHEMA = "id long, word string, normalized string, en_compressed string, type string, ngram int, is_filler boolean, source string"

#: Signs that fold to a plain apostrophe.
APOSTROPHES = "\u2019\u2018\u02bc\u02b9\u00b4\u0060"
#: Punctuation peeled off words, and the set of reverse translation, which lacks the angle quotes.
PEELED = "()!?.,:;-–—…'\"«»"
PEELED_REVERSE = "()!?.,:;-–—…'\""

#: Letter by letter; letters of several Latin signs follow in DIGRAPHS.
LETTERS = ("абвгґдезиійклмнопрстуфыэ", "abvhgdezyiyklmnoprstufye")
DIGRAPHS = {"щ": "shch", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "ю": "yu", "я": "ya", "є": "ye", "ї": "yi", "ё": "yo"}
SILENT = "ьъ"


def _fields(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split("/") if x.strip())


FILLERS = _fields(
    "мені здається що / мені здається / мені потрібно / чесно кажучи / якщо чесно / якщо можна / як на мене / на мою думку / "
    "я хочу щоб / я хотіла б / я хотів би / я думаю що / я думаю / чи не міг би ти / чи не могли б ви / можете допомогти"
)
INTENSIFIERS = _fields("справді / повністю / цілком / зовсім / абсолютно / надзвичайно / досить / дуже")
STOP_WORDS = frozenset(
    "ну от ось же ж це цю ця цей цього цьому той так ні не або але чи а й і та би б у в на з із від до за для по "
    "я ми ви ти він вона воно вони свою своє свій свого своєму".split()
)

ARTICLES = ("a", "an", "the")
#: Function words of English by what they become; under "" those that fall away.
FUNCTION_WORDS = {
    "не": "not isn't aren't wasn't weren't don't doesn't didn't won't",
    "не можна": "cannot can't",
    "і": "and",
    "або": "or",
    "але": "but",
    "був": "was",
    "були": "were",
    "буде": "will",
    "б": "would",
    "міг": "could",
    "слід": "should",
    "має": "has",
    "маємо": "have",
    "це": "it",
}
FUNCTION_WORDS[""] = "am are is do does did been being"
#: Case a preposition asks of the noun after it.
PREPOSITION_CASE = {"loct": "в у на", "gent": "з із зі до від для без після", "accs": "за про під через", "ablt": "над між", "datv": "по"}

#: Names of text columns, the likeliest first.
TEXT_COLUMNS = tuple("text content message comment body description".split() + "текст зміст коментар опис повідомлення".split() + ["name", "назва"])

#: Where a source's rows belong.
CORPUS_OF_SOURCE = {"telegram": "telegram"}


@dataclass(frozen=True)
class Rule:
    """word (of one or more words) becomes replacement; None deletes it."""

    word: str
    replacement: str | None
    kind: str = ""
    ngram: int = 0

    @property
    def n(self) -> int:
        return self.ngram or len(self.word.split())


@dataclass(frozen=True)
class Pattern:
    regex: str
    replacement: str
    kind: str = ""


@dataclass(frozen=True)
class Resources:
    """Rules and patterns in order, filler phrases, and intensifiers."""

    rules: Sequence[Rule] = ()
    patterns: Sequence[Pattern] = ()
    fillers: Sequence[str] = FILLERS
    intensifiers: Sequence[str] = INTENSIFIERS
    lemmas: dict[str, str] = field(default_factory=dict)

    def phrases(self) -> list[Rule]:
        """Rules of several words, the most words first, then in order."""
        return sorted((r for r in self.rules if r.n > 1), key=lambda r: -r.n)

    def words(self) -> dict[str, str | None]:
        """Rules of one word; of equal ones the last counts."""
        return {r.word.lower(): r.replacement for r in self.rules if r.n <= 1}

    def but(self, **changes) -> Resources:
        return replace(self, **changes)


_SEED_RULES = (
    ("да ладно", "та годі"), ("потому шо", "тому що"), ("потому що", "тому що"), ("не понятно", "не зрозуміло"), ("всьо одно", "все одно"),
    ("шо", "що"), ("ваще", "взагалі"), ("понятно", "зрозуміло"), ("баг", "помилка"), ("баги", "помилки"), ("пофікси", "виправ"),
    ("пофіксити", "виправити"), ("деплой", "розгортання"), ("таска", "завдання"), ("мітинг", "зустріч"), ("щас", "зараз"), ("сьодня", "сьогодні"),
    ("тіпа", None), ("крч", None), ("короче", None), ("плз", None), ("блін", None),
)
SEED = Resources(
    rules=tuple(Rule(w, r) for w, r in _SEED_RULES),
    patterns=(Pattern(r"^(?:ну|ой)[,\s]+", "", "lead"), Pattern(r"\s+([.,!?;:])", r"\1", "space"), Pattern(r"([!?])\1+", r"\1", "repeat"), Pattern(r"\s{2,}", " ", "space")),
)


def seed_lexicon() -> list[tuple[str, str]]:
    """(word, English) of the bundled dictionary."""
    lines = (Path(__file__).parent / "resources_lexicon.tsv").read_text(encoding="utf-8").splitlines()
    return [(u, en) for en, us in (x.split("\t") for x in lines) for u in us.split("|")]


def function_words() -> dict[str, str]:
    return {w: ua for ua, ws in FUNCTION_WORDS.items() for w in ws.split()}


def rules_table(spark: SparkSession, resources: Resources = SEED) -> DataFrame:
    return spark.createDataFrame([(r.word, r.replacement, r.n, r.kind, i) for i, r in enumerate(resources.rules)], RULES_SCHEMA)


def patterns_table(spark: SparkSession, resources: Resources = SEED) -> DataFrame:
    return spark.createDataFrame([(p.regex, p.replacement, p.kind, i) for i, p in enumerate(resources.patterns)], PATTERNS_SCHEMA)


def from_tables(rules: DataFrame, patterns: DataFrame | None = None, base: Resources = SEED) -> Resources:
    """Resources of rule tables (small: they come to the driver and become part of the plan)."""
    r = tuple(Rule(x["word"], x["replacement"], x["kind"] or "", x["ngram"] or 0) for x in rules.orderBy("ord").collect())
    p = () if patterns is None else tuple(Pattern(x["regex"], x["replacement"] or "", x["kind"] or "") for x in patterns.orderBy("ord").collect())
    return base.but(rules=r, patterns=p)


def from_json(spark: SparkSession, path: str, base: Resources = SEED) -> Resources:
    """Resources of a rule file: {"replacements": [{"from", "to", "ngram"?, "type"?}], "patterns": [{"regex", "to", "type"?}]}."""
    schema = "replacements array<struct<`from`:string,`to`:string,ngram:int,type:string>>, patterns array<struct<regex:string,`to`:string,type:string>>"
    row = spark.read.schema(schema).json(path, multiLine=True).first()
    rules = tuple(Rule(x["from"], x["to"], x["type"] or "", x["ngram"] or 1) for x in row["replacements"] or [])
    patterns = tuple(Pattern(x["regex"], x["to"] or "", x["type"] or "") for x in row["patterns"] or [])
    return base.but(rules=rules, patterns=patterns)
