"""Quality rules: a threshold table compiled into one native projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

STOP_WORDS = (
    "the of and to in a is that it for on was be as with by this are or an from at have not "
    "de la le les des et en que un une du dans pour qui sur au par est pas avec "
    "der die das und den von zu mit sich auf ein eine nicht dem für im ist "
    "el los las y del se por con una para su al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule when it has at least min_words words and the measure lies outside [low, high]."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: Ratios say nothing about a text of a few words, so each waits for a number of words.
RULES = (
    Rule("too_short", "n_words", low=1),
    Rule("too_long", "n_words", high=1_000_000),
    Rule("word_length", "mean_word_length", low=2.0, high=14.0, min_words=20),
    Rule("symbols", "symbol_ratio", high=0.15, min_words=10),
    Rule("special_symbols", "special_per_word", high=0.2, min_words=10),
    Rule("upper_case", "upper_ratio", high=0.3, min_words=10),
    Rule("stop_words", "stop_word_ratio", low=0.08, min_words=50),
    Rule("distinct_words", "distinct_word_ratio", low=0.15, min_words=50),
    Rule("repeated_lines", "repeated_line_ratio", high=0.5, min_words=50),
    Rule("short_lines", "words_per_line", low=2.0, min_words=50),
)


def measures(text: Column) -> dict[str, Column]:
    """Measures by name. Null and empty texts have 0 words and every ratio 0. White space is Unicode's."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    n_chars, n_words, n_lines = F.length(t).cast("long"), F.size(words).cast("long"), F.size(lines).cast("long")

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.round(a.cast("double") / b, 6)).otherwise(F.lit(0.0))

    def count(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern))

    stop = F.size(F.filter(words, lambda w: F.lower(F.btrim(w, F.lit(".,!?;:"))).isin(*STOP_WORDS)))
    return {
        "n_chars": n_chars,
        "n_words": n_words,
        "n_lines": n_lines,
        "mean_word_length": ratio(F.length(F.regexp_replace(t, r"(?U)\s+", "")), n_words),
        "symbol_ratio": ratio(count(r"[^\p{L}\p{N}\s]"), n_chars),
        "special_per_word": ratio(count(r"[#$%&*@^|~<>{}\\]"), n_words),
        "upper_ratio": ratio(count(r"\p{Lu}"), n_chars),
        "stop_word_ratio": ratio(stop, n_words),
        "distinct_word_ratio": ratio(F.size(F.array_distinct(words)), n_words),
        "repeated_line_ratio": ratio(n_lines - F.size(F.array_distinct(lines)), n_lines),
        "words_per_line": ratio(n_words, n_lines),
    }


def compiled(rules=RULES, m: str = "_m") -> Column:
    """array<string> of the names of broken rules, over the struct of measures in column m."""
    broken = []
    for r in rules:
        x, out = F.col(f"{m}.{r.measure}"), F.lit(False)
        if r.low is not None:
            out = out | (x < r.low)
        if r.high is not None:
            out = out | (x > r.high)
        broken.append(F.when(out & (F.col(f"{m}.n_words") >= r.min_words), F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def assess(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """All columns of docs, then `_m` (struct of measures) and `_broken` (names of broken rules, in the table's order).

    No user function, shuffle or driver step. Nulls and empty texts break `too_short`; very long texts are measured
    whole; equal rows get equal results; an empty table gives an empty one. Columns of docs are never looked up by a
    measure's name, so extra columns may be called anything but `_m` and `_broken`, which are replaced.
    """
    m = measures(docs[text])
    return docs.drop("_m", "_broken").withColumn("_m", F.struct(*[c.alias(k) for k, c in m.items()])).withColumn("_broken", compiled(rules))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """One row a document: key, measures, broken (names joined by commas), keep."""
    d = docs.select(docs[key].alias(key), docs[text].alias(text))
    return assess(d, text, rules).select(key, "_m.*", F.array_join("_broken", ",").alias("broken"), (F.size("_broken") == 0).alias("keep"))


def accepted(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The documents that break no rule, with their columns as they were, whatever their names.

    Null and empty texts break `too_short` and go; very long texts are measured whole; rows alike stay or go alike; nulls
    in other columns don't matter; an empty table gives an empty one.
    """
    m, broken, row = (free_name(docs.columns, x) for x in ("_m", "_broken", "_row"))
    measured = docs.select("*", F.struct(*[c.alias(k) for k, c in measures(docs[text]).items()]).alias(m), F.monotonically_increasing_id().alias(row))
    # a filter isn't pushed below a row number, so the measures are computed once, not once in each rule
    kept = measured.withColumn(broken, compiled(rules, m)).filter((F.size(broken) == 0) & (F.col(row) >= 0))
    return kept.drop(m, broken, row)


def sql(source: str = "documents", rules=RULES, keep_only: bool = False) -> str:
    """The same in DuckDB's SQL. keep_only: the documents kept instead of the report."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

    def ratio(a: str, b: str) -> str:
        return f"CASE WHEN {b} > 0 THEN round(({a})::DOUBLE / {b}, 6) ELSE 0.0 END"

    def count(p: str) -> str:
        return f"len(regexp_extract_all(t, '{p}'))"

    checks = []
    for r in rules:
        bounds = [f"{r.measure} < {r.low}"] * (r.low is not None) + [f"{r.measure} > {r.high}"] * (r.high is not None)
        checks.append(f"CASE WHEN ({' OR '.join(bounds)}) AND n_words >= {r.min_words} THEN '{r.name}' END")
    space = r"[\s\p{Z}\x0B\x85\x1C-\x1F]+"
    return rf"""
WITH a AS (SELECT *, coalesce(text, '') AS t FROM {source}),
b AS (SELECT *, list_filter(string_split_regex(t, '{space}'), lambda w: w <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ') <> '') AS ls FROM a),
m AS (SELECT * EXCLUDE (n_chars), length(t) AS n_chars, len(ws) AS n_words, len(ls) AS n_lines,
  {ratio(f"length(regexp_replace(t, '{space}', '', 'g'))", "len(ws)")} AS mean_word_length,
  {ratio(count(r"[^\p{L}\p{N}\s\x0B]"), "length(t)")} AS symbol_ratio,
  {ratio(count(r"[#$%&*@^|~<>{}\\]"), "len(ws)")} AS special_per_word,
  {ratio(count(r"\p{Lu}"), "length(t)")} AS upper_ratio,
  {ratio(f"len(list_filter(ws, lambda w: lower(trim(w, '.,!?;:')) IN ({stop})))", "len(ws)")} AS stop_word_ratio,
  {ratio("len(list_distinct(ws))", "len(ws)")} AS distinct_word_ratio,
  {ratio("len(ls) - len(list_distinct(ls))", "len(ls)")} AS repeated_line_ratio,
  {ratio("len(ws)", "len(ls)")} AS words_per_line
  FROM b),
c AS (SELECT *, concat_ws(',', {', '.join(checks)}) AS broken FROM m)
""" + (
        f"SELECT d.* FROM {source} d JOIN c USING (doc_id) WHERE c.broken = ''"
        if keep_only
        else "SELECT doc_id, n_chars, n_words, n_lines, mean_word_length, symbol_ratio, special_per_word, upper_ratio, stop_word_ratio, "
        "distinct_word_ratio, repeated_line_ratio, words_per_line, broken, broken = '' AS keep FROM c"
    )
