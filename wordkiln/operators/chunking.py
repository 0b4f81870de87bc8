"""Merging short texts and splitting long ones, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

MIN_WORDS = 50
MAX_WORDS = 300


def _words(c: Column) -> Column:
    return F.size(X.tokens(c))


def merge_short(ordered: Column, least: int = MIN_WORDS) -> Column:
    """array<string> of texts without blanks: neighbours joined by a space until they have `least` words; what is left at
    the end goes to the last one."""
    piece = F.transform(F.filter(F.transform(ordered, X.strip), lambda t: t != ""), lambda t: F.struct(t.alias("t"), _words(t).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        held, n = F.concat(a["held"], F.array(x["t"])), a["n"] + x["n"]
        full = F.struct(F.concat(a["out"], F.array(F.array_join(held, " "))).alias("out"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("n"))
        return F.when(n >= least, full).otherwise(F.struct(a["out"].alias("out"), held.alias("held"), n.alias("n")))

    def end(a: Column) -> Column:
        rest, k = F.array_join(a["held"], " "), F.size(a["out"])
        glued = F.concat(F.slice(a["out"], 1, F.greatest(k - 1, F.lit(0))), F.array(F.concat(F.element_at(a["out"], -1), F.lit(" "), rest)))
        return F.when(F.size(a["held"]) == 0, a["out"]).when(k == 0, F.array(rest)).otherwise(glued)

    return F.aggregate(piece, start, step, end)


def split_long(text: Column, most: int = MAX_WORDS) -> Column:
    """array<string>: the text if it has up to `most` words; else sentences packed up to that; a text of one sentence in
    windows of `most` words. A sentence longer than that stays whole."""
    sentences, ts = X.split_sentences(text), X.tokens(text)
    windows = X.let(ts, lambda ts: F.transform(F.sequence(F.lit(1), F.greatest(F.size(ts), F.lit(1)), F.lit(most)), lambda i: F.array_join(F.slice(ts, i, most), " ")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"), F.lit(0).alias("n"))

    def step(a: Column, s: Column) -> Column:
        n = _words(s)
        fresh = F.struct(F.concat(a["out"], F.array(a["held"])).alias("out"), s.alias("held"), n.alias("n"))
        first = F.struct(a["out"].alias("out"), s.alias("held"), n.alias("n"))
        longer = F.struct(a["out"].alias("out"), X.strip(F.concat(a["held"], F.lit(" "), s)).alias("held"), (a["n"] + n).alias("n"))
        return F.when(a["held"] == "", first).when(a["n"] + n > most, fresh).otherwise(longer)

    packed = F.aggregate(sentences, start, step, lambda a: F.when(a["held"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["held"]))))
    return F.when(F.size(ts) <= most, F.array(text)).when(F.size(sentences) <= 1, windows).otherwise(packed)


def chunks(df: DataFrame, source: str = "source", pos: str = "pos", text: str = "text", least: int = MIN_WORDS, most: int = MAX_WORDS) -> DataFrame:
    """source, chunk (from 0), text: each source's texts in order of pos, short ones merged and long ones split."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda x: x[text])
    merged = df.filter(F.col(text).isNotNull()).groupBy(source).agg(merge_short(ordered, least).alias("_m"))
    parts = merged.select(source, F.flatten(F.transform("_m", lambda t: split_long(t, most))).alias("_c"))
    return parts.select(source, F.posexplode("_c").alias("chunk", "text"))
