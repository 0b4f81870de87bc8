"""The lexicon as a table: built from rules and a dictionary, and turned round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

COLUMNS = ("word", "normalized", "en_compressed", "type", "ngram", "is_filler", "source")
REBUILT = ("replacements", "mapper")


def build(rules: DataFrame, english: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """word, normalized, en_compressed, type, ngram, is_filler, source: one row a word.

    rules: word, replacement (null: filler), kind, ngram, ord (the last of equal words counts). english: word, en. Rows of
    existing from other sources stay; a rule's word replaces theirs, an English word only fills a missing en_compressed.
    """
    last = Window.partitionBy("word").orderBy(F.col("ord").desc())
    r = rules.withColumn("word", F.lower("word")).withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    by_word, by_form = english.select("word", F.col("en").alias("e1")), english.select(F.col("word").alias("replacement"), F.col("en").alias("e2"))
    r = r.join(by_word, "word", "left").join(by_form, "replacement", "left")
    en = F.coalesce(F.nullif("e1", F.lit("")), "e2")
    ngram = F.coalesce(F.nullif("ngram", F.lit(0)), F.size(X.tokens(F.col("word"))))
    first = r.select("word", F.col("replacement").alias("normalized"), en.alias("en_compressed"), F.coalesce("kind", F.lit("")).alias("type"), ngram.alias("ngram"), F.col("replacement").isNull().alias("is_filler"), F.lit("replacements").alias("source"))
    only = english.join(first.select("word"), "word", "left_anti")
    new = lambda d: d.select("word", F.lit(None).cast("string").alias("normalized"), F.col("en").alias("en_compressed"), F.lit("en_only").alias("type"), F.size(X.tokens(F.col("word"))).alias("ngram"), F.lit(False).alias("is_filler"), F.lit("mapper").alias("source"))
    if existing is None:
        return first.unionByName(new(only))
    kept = existing.select(*COLUMNS).filter(~F.col("source").isin(*REBUILT)).join(first.select("word"), "word", "left_anti")
    filled = kept.join(only, "word", "left").withColumn("en_compressed", F.coalesce(F.nullif("en_compressed", F.lit("")), "en")).select(*COLUMNS)
    return first.unionByName(filled).unionByName(new(only.join(kept.select("word"), "word", "left_anti")))


def reverse(lexicon: DataFrame) -> DataFrame:
    """en, word: the best native form of each English value. lexicon has id, word, normalized, en_compressed.

    First the commonest normalized form not of mixed script (ties: shortest, then first met), then the shortest word
    that has none (ties: first), then the first clean form, then the first row's.
    """
    l = lexicon.filter(F.coalesce("en_compressed", F.lit("")) != "").select(F.lower("en_compressed").alias("en"), "id", "word", "normalized")
    clean = lambda c: ~X.mixed_script(c)
    has = F.coalesce(F.col("normalized"), F.lit("")) != ""
    form = F.when(has, F.col("normalized")).otherwise(F.col("word"))
    canonical = l.filter(has & clean(F.col("normalized"))).groupBy("en", F.col("normalized").alias("form")).agg(F.count("*").alias("freq"), F.min("id").alias("id")).select("en", "form", F.lit(1).alias("tier"), (-F.col("freq")).alias("a"), F.length("form").cast("long").alias("b"), "id")
    bare = l.filter(F.col("normalized").isNull() & clean(F.col("word"))).select("en", F.col("word").alias("form"), F.lit(2).alias("tier"), F.length("word").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "id")
    any_clean = l.filter(clean(form)).select("en", form.alias("form"), F.lit(3).alias("tier"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "id")
    rest = l.select("en", form.alias("form"), F.lit(4).alias("tier"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "id")
    every = canonical.unionByName(bare).unionByName(any_clean).unionByName(rest)
    return every.groupBy("en").agg(F.min_by("form", F.struct("tier", "a", "b", "id")).alias("word"))


def dictionary(reversed_lexicon: DataFrame) -> dict[str, str]:
    """A reversed lexicon small enough for expressions."""
    return {r["en"]: r["word"] for r in reversed_lexicon.collect()}
