"""Search, topics and nearest classes over vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, over the shorter of both."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, zero: Column | None = None) -> Column:
    """Cosine; 0 if either is a zero vector, or `zero` (the matrix form of the same gives NaN there)."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0) if zero is None else zero).otherwise(dot(a, b) / n)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def top_k(df: DataFrame, query: list[float] | DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", distinct: str | None = None) -> DataFrame:
    """key, score of the k nearest; of rows with one value of `distinct` only the nearest counts. Ties by key.

    query is a vector, or a table of one row with column q: it is sent to all executors, whatever the table's size.
    """
    if isinstance(query, DataFrame):
        scored = df.crossJoin(F.broadcast(query.select("q"))).withColumn("score", cosine(F.col(vector), F.col("q"))).drop("q")
    else:
        scored = df.withColumn("score", cosine(F.col(vector), literal(query)))
    if distinct:
        best = scored.groupBy(distinct).agg(F.max_by(F.struct(key, "score"), F.struct("score", -F.col(key))).alias("b"))
        scored = best.select("b.*", distinct)
    columns = [key, "score", distinct] if distinct else [key, "score"]
    return scored.select(*columns).orderBy(F.col("score").desc(), key).limit(k)


def topics(df: DataFrame, topic_vectors: DataFrame, threshold: float = 0.3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """topic, key, score, place of every pair of at least the threshold; a topic without any has one row of nulls.

    topic_vectors (topic, v) is the small side of a nested loop and is sent to all executors.
    """
    t = topic_vectors.select("topic", "v")
    pairs = df.select(key, vector).crossJoin(F.broadcast(t)).withColumn("score", cosine(F.col(vector), F.col("v"))).filter(F.col("score") >= threshold)
    w = Window.partitionBy("topic").orderBy(F.col("score").desc(), key)
    ranked = pairs.select("topic", key, "score", F.row_number().over(w).alias("place"))
    return t.select("topic").join(ranked, "topic", "left")


def _best(df: DataFrame, one: DataFrame, score, key: str, vector: str, keep: tuple[str, ...]) -> DataFrame:
    """The candidates (array _c of one row) of the greatest score, of equal ones that of the least ord. Nothing is shuffled."""
    best = F.array_max(F.transform("_c", lambda x: F.struct(score(x).alias("s"), (-x["ord"]).alias("o"), x["category"].alias("category"))))
    scored = df.select(key, vector, *keep).crossJoin(F.broadcast(one)).select(key, *keep, best.alias("_b"))
    return scored.select(key, *keep, F.col("_b.category").alias("category"), F.col("_b.s").alias("confidence"))


def nearest_name(df: DataFrame, names: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, category, confidence: the name (category, ord, v) of the greatest cosine, the first of equal ones."""
    one = names.agg(F.collect_list(F.struct("category", "ord", "v")).alias("_c"))
    return _best(df, one, lambda x: cosine(F.col(vector), x["v"]), key, vector, keep)


def nearest_examples(df: DataFrame, examples: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, category, confidence: the category of the greatest mean cosine to its examples (category, ord, v); first of equals."""
    one = examples.groupBy("category", "ord").agg(F.collect_list("v").alias("vs")).agg(F.collect_list(F.struct("category", "ord", "vs")).alias("_c"))
    mean = lambda x: F.aggregate(x["vs"], F.lit(0.0), lambda s, v: s + cosine(F.col(vector), v)) / F.size(x["vs"])
    return _best(df, one, mean, key, vector, keep)


def to_bytes(vector: Column) -> Column:
    """Vectors as their numbers' bytes, 4 each, the lowest first: for exchange with stores that keep them so."""

    def run(vectors: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else np.asarray(v, dtype="<f4").tobytes() for v in vectors], dtype=object)

    return F.pandas_udf(run, "binary", F.PandasUDFType.SCALAR)(vector)


def from_bytes(blob: Column) -> Column:
    def run(blobs: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else np.frombuffer(b, dtype="<f4") for b in blobs], dtype=object)

    return F.pandas_udf(run, "array<float>", F.PandasUDFType.SCALAR)(blob)


def parse_examples(categories: dict[str, str | list[str]]) -> list[tuple[str, int, str]]:
    """(category, ord, example): lists as they are; strings at commas, or at spaces if there is no comma."""
    out = []
    for i, (name, examples) in enumerate(categories.items()):
        if isinstance(examples, str):
            parts = [x.strip() for x in examples.split(",") if x.strip()]
            examples = parts[0].split() if len(parts) == 1 and " " in parts[0] else parts
        out += [(name, i, x) for x in examples]
    return out
