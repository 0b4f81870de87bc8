"""Connected components by alternating large and small stars, for edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """id, group_id (smallest id reached) for every id in edges (a, b). Edges may repeat; loops and nulls are ignored.

    Each round keeps the components and halves their depth; rounds end when the edges stay as they are, stars then.
    """
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    before = mark(e)
    while before[0]:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        w = Window.partitionBy("u")
        large = both.withColumn("m", F.least("u", F.min("v").over(w))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", F.min("v").over(w))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct()
        after_table = stored(small, "edges")
        after = mark(after_table)
        dropped(e)
        e = after_table
        if after == before:
            break
        before = after
    centres = e.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(centres)
