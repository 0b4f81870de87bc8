"""Squeezing texts, and what it saves: by words natively, by a tokenizer's tokens through a provider."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import resources as R
from ..functions import text as X


def squeeze(c: Column, resources: R.Resources = R.SEED, lexicon: list | None = None, compressor: Callable[[Column], Column] | None = None) -> Column:
    """Normalised and compressed, and translated if a lexicon is given; blank texts as they are. A compressor, a model, takes
    the place of the rules where it gives something."""
    s = X.compress(X.normalize(c, resources), resources)
    s = F.coalesce(compressor(X.normalize(c, resources)), s) if compressor else s
    s = X.translate(s, lexicon) if lexicon else s
    return F.when(X.blank(c), c).otherwise(s)


def with_squeezed(df: DataFrame, out: str, text: str = "text", resources: R.Resources = R.SEED, lexicon: list | None = None, compressor: Callable[[Column], Column] | None = None) -> DataFrame:
    """df with squeeze() of its text, computed once; the normalised text, which a compressor and the rules both take, too."""
    if not compressor:
        return X.settled(df, out, squeeze(F.col(text), resources, lexicon))
    d = X.settled(df, "_nt", X.normalize(F.col(text), resources))
    s = F.coalesce(compressor(F.col("_nt")), X.compress(F.col("_nt"), resources))
    s = X.translate(s, lexicon) if lexicon else s
    return X.settled(d, out, F.when(X.blank(F.col(text)), F.col(text)).otherwise(s)).drop("_nt")


def squeezed(df: DataFrame, text: str = "text", resources: R.Resources = R.SEED, lexicon: list | None = None, counters: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """df with squeezed, replacements_made, tokens_saved (map by counter) and compression_ratio (of the first counter, to 3
    places; null for no tokens). Without counters words count."""
    counters = counters or {"words": X.token_count}
    d = df.withColumn("_n", X.normalized(F.col(text), resources))
    s = X.compress(F.col("_n.text"), resources)
    s = X.translate(s, lexicon) if lexicon else s
    d = X.settled(d, "squeezed", F.when(X.blank(F.col(text)), F.col(text)).otherwise(s)).withColumn("replacements_made", F.col("_n.replacements_made")).drop("_n")
    for name, f in counters.items():
        d = d.withColumn(f"_a_{name}", f(F.col(text))).withColumn(f"_b_{name}", f(F.col("squeezed")))
    first = next(iter(counters))
    d = d.withColumn("tokens_saved", F.create_map(*[x for n in counters for x in (F.lit(n), (F.col(f"_a_{n}") - F.col(f"_b_{n}")).cast("int"))]))
    ratio = F.when(F.col(f"_a_{first}") > 0, F.round(1 - F.col(f"_b_{first}") / F.col(f"_a_{first}"), 3))
    return d.withColumn("compression_ratio", ratio).drop(*[f"_{x}_{n}" for x in "ab" for n in counters])


def percent_saved(before: Column, after: Column) -> Column:
    """To one place; 0 for nothing before."""
    return F.when(before > 0, F.bround((1 - after / before) * 100, 1)).otherwise(0.0)


def token_stats(df: DataFrame, counters: dict[str, Callable[[Column], Column]], text: str = "text", resources: R.Resources = R.SEED) -> DataFrame:
    """df with squeezed_text and, for each counter, its tokens, those of the squeezed text and the percentage saved."""
    d = with_squeezed(df, "squeezed_text", text, resources)
    for n, f in counters.items():
        d = d.withColumn(n, f(F.col(text))).withColumn(f"{n}_squeezed", f(F.col("squeezed_text")))
        d = d.withColumn(f"savings_{n}_pct", percent_saved(F.col(n), F.col(f"{n}_squeezed")))
    return d


def savings(df: DataFrame, by: list[str], before: str = "text", after: str = "squeezed") -> DataFrame:
    """Words before and after, and the whole percentage saved, by group."""
    a, b = F.sum(X.token_count(F.col(before))), F.sum(X.token_count(F.col(after)))
    return df.groupBy(*by).agg(F.count("*").alias("n"), a.alias("words_before"), b.alias("words_after")).withColumn("pct_saved", percent_saved(F.col("words_before"), F.col("words_after")))
