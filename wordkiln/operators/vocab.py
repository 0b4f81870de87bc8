"""Word vocabularies: built by frequency, texts encoded and decoded, and translated by windows through a provider."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

PAD, SOS, EOS, UNK = range(4)
SPECIAL = ("<PAD>", "<SOS>", "<EOS>", "<UNK>")


def build(df: DataFrame, least: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n, id: words of at least `least` counts from id 4 on, the commonest first, equal ones in order of first sight."""
    w = df.select(F.col(key).alias("_k"), F.posexplode(X.tokens(F.lower(text))).alias("_p", "word"))
    c = w.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("_k", "_p")).alias("first")).filter(F.col("n") >= least)
    c = c.filter(~F.col("word").isin(*[s.lower() for s in SPECIAL]))
    return ranked(c, [F.col("n").desc(), F.col("first")], 4).select("word", "n", "id")


def ranked(df: DataFrame, order: list[Column], start: int = 0, out: str = "id") -> DataFrame:
    """df with its rows numbered in order, without a task that holds them all: rows are sorted by ranges, and each range's
    number of rows, known to the driver, shifts the places in it. The sorted rows are checkpointed where the session names
    a folder for that, so nothing is left in executors and a lost one costs nothing; else they are kept in the cache: sorting
    twice could part them differently."""
    s = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    s = s.checkpoint() if df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir") else s.persist()
    sizes = sorted((r[0], r[1]) for r in s.groupBy(F.shiftright("_at", 33).alias("p")).count().collect())
    offsets, total = {}, start
    for p, n in sizes:
        offsets[p] = total
        total += n
    if not offsets:
        return s.withColumn(out, F.lit(None).cast("long")).drop("_at")
    shift = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.shiftright("_at", 33))
    return s.withColumn(out, (shift + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_at")


def encode(df: DataFrame, vocabulary: DataFrame, most: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids: SOS, up to most - 2 words, EOS."""
    t = df.select(key, F.slice(X.tokens(F.lower(F.coalesce(text, F.lit("")))), 1, most - 2).alias("w"))
    words = t.select(key, F.posexplode("w").alias("p", "word")).join(vocabulary.select("word", "id"), "word", "left")
    ids = words.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", F.coalesce("id", F.lit(UNK)).alias("id")))), lambda x: x["id"]).alias("ids"))
    whole = t.select(key).join(ids, key, "left")
    return whole.select(key, F.concat(F.array(F.lit(SOS).cast("long")), F.coalesce("ids", F.array().cast("array<bigint>")), F.array(F.lit(EOS).cast("long"))).alias("ids"))


def decode(df: DataFrame, vocabulary: DataFrame, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text: words up to EOS; PAD and SOS left out."""
    end = F.array_position(ids, F.lit(EOS).cast("long"))
    body = F.when(end > 0, F.slice(ids, F.lit(1), (end - 1).cast("int"))).otherwise(F.col(ids))
    t = df.select(key, F.posexplode_outer(F.filter(body, lambda i: ~i.isin(PAD, SOS))).alias("p", "id")).join(vocabulary.select("id", "word"), "id", "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", F.coalesce("word", F.lit(SPECIAL[UNK])).alias("w")))))
    return t.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["w"]), " ").alias("text"))


def usable(c: Column) -> Column:
    """Whether a translator's result isn't mostly unknown words."""
    unknown = F.regexp_count(c, F.lit("<UNK>"))
    return F.coalesce((X.strip(c) != "") & (X.strip(c) != "<UNK>") & (unknown <= F.floor(F.size(X.tokens(c)) / 2)), F.lit(False))


def acceptable(c: Column, n: Column) -> Column:
    """Whether a window of n words may become c: Latin words, 1 to n + 2 of them."""
    ts = X.tokens(c)
    return usable(c) & F.forall(ts, lambda t: t.rlike(r"^[\-A-Za-z0-9,.!?'\"]+$")) & (F.size(ts) > 0) & (F.size(ts) <= n + 2)


def translate_windows(df: DataFrame, translate: Callable[[Column], Column], key: str = "doc_id", text: str = "text", out: str = "translated") -> DataFrame:
    """Windows of 4, 3, then 2 words with Cyrillic in them, left to right and none twice, replaced by what the provider gives.

    Each different window is translated once, then joined back.
    """
    t = df.select(F.col(key).alias("_k"), X.tokens(F.col(text)).alias("w"))
    kind = "array<struct<n:int,at:int,s:string>>"

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
        found = F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), i.alias("at"), F.array_join(F.slice("w", i, n), " ").alias("s")))
        return F.when(F.size("w") >= n, found).otherwise(F.array().cast(kind))

    windows = F.flatten(F.array(of(4), of(3), of(2)))
    every = t.select("_k", F.explode(windows).alias("x")).select("_k", "x.*").filter(X.has_cyrillic(F.col("s")))
    known = every.select("s", "n").distinct().withColumn("to", translate(F.col("s"))).filter(acceptable(F.col("to"), F.col("n"))).select("s", "to")
    hits = every.join(known, "s").groupBy("_k").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "at", "to"))).alias("h"))
    kind = "array<struct<m:int,at:int,to:string>>"
    free = lambda a, x: ~F.exists(a, lambda y: (x["at"] < y["at"] - y["m"]) & (y["at"] < x["at"] - x["m"]))
    chosen = F.aggregate("h", F.array().cast(kind), lambda a, x: F.when(free(a, x), F.concat(a, F.array(x))).otherwise(a))
    d = t.join(hits.select("_k", chosen.alias("c")), "_k", "left").withColumn("c", F.coalesce("c", F.array().cast(kind)))

    def word(w: Column, i: Column) -> Column:
        own = F.filter("c", lambda y: (y["at"] <= i + 1) & (i + 1 < y["at"] - y["m"]))
        return F.when(F.size(own) == 0, w).when(F.get(own, F.lit(0))["at"] == i + 1, F.get(own, F.lit(0))["to"]).otherwise(F.lit(""))

    text_out = F.array_join(F.filter(F.transform("w", word), lambda x: x != ""), " ")
    return df.join(d.select("_k", F.when(F.size("w") < 2, F.array_join("w", " ")).otherwise(text_out).alias(out)), df[key] == F.col("_k")).drop("_k")
