"""Shards by a k-d tree: nodes split at exact weighted medians of their widest dimension until they reach the target bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded, dropped, record_key, stored

TARGET_BYTES = 64 << 20
BINS = 4096
DEEPEST = 60
#: Of a node's row in the table that goes to all executors while it is small enough.
NODE_BYTES = 64


def ranks(strings: DataFrame) -> DataFrame:
    """value, code: the distinct non-null strings of a table of one column, numbered from 0 in their order.

    They are dealt by ranges and numbered within each; only the ranges' sizes come to the driver.
    """
    s = strings.toDF("value").filter("value is not null").distinct().repartitionByRange("value").sortWithinPartitions("value")
    s = stored(s.withColumn("at", F.monotonically_increasing_id()), "ranks")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r[0], r[1]) for r in s.groupBy(part.alias("part")).count().collect())
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    table = s.sparkSession.createDataFrame(starts, "part long, start long")
    return s.withColumn("part", part).join(bounded(table, 16), "part").select("value", (F.col("start") + within).cast("double").alias("code"))


def _with_nodes(points: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    return points.join(F.broadcast(nodes) if n * NODE_BYTES <= BROADCAST_BYTES else nodes, "node")


def _weighted_medians(x: DataFrame, half: DataFrame, n: int) -> DataFrame:
    """node, at: the least value v of each node so that the weights of values up to v reach half. x: node, v, w, lo, hi.

    Twice a histogram of BINS bins between lo and hi finds the bin of the median and the weight below it, and the values
    of that bin alone are then ordered: no node's points are ever sorted in one task.
    """
    for _ in range(2):
        width = (F.col("hi") - F.col("lo")) / BINS
        x = x.withColumn("bin", F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(BINS - 1))).otherwise(0).cast("int"))
        h = x.groupBy("node", "bin").agg(F.sum("w").alias("w"), F.min("v").alias("bin_lo"), F.max("v").alias("bin_hi"))
        w = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        h = h.withColumn("upto", F.sum("w").over(w)).join(half, "node").filter("upto >= need").groupBy("node").agg(F.min(F.struct("bin", "w", "upto", "need", "bin_lo", "bin_hi")).alias("m"))
        m = h.select("node", F.col("m.bin").alias("bin"), (F.col("m.need") - F.col("m.upto") + F.col("m.w")).alias("need"), F.col("m.bin_lo").alias("lo"), F.col("m.bin_hi").alias("hi"))
        m = stored(m, "median_bins")
        half = m.select("node", "need")
        x = _with_nodes(x.drop("lo", "hi"), m.select("node", F.col("bin").alias("b"), "lo", "hi"), n).filter("bin = b").drop("bin", "b")
    v = x.groupBy("node", "v").agg(F.sum("w").alias("w"))
    w = Window.partitionBy("node").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return v.withColumn("upto", F.sum("w").over(w)).join(half, "node").filter("upto >= need").groupBy("node").agg(F.min("v").alias("at"))


def sharded(rows: DataFrame, key: str, dimensions: dict[str, Column], weight: Column, target: int = TARGET_BYTES) -> DataFrame:
    """id, bytes, leaf, leaf_bytes, leaf_rows: the leaf of every row. Children of node n are 2n and 2n + 1, the root is 1.

    A node of more than target bytes is split along the dimension whose range is the widest part of the table's own
    range (the first of equal ones), at the weighted median v: up to v to the left, unless v is the node's greatest
    value, then what is below it. A node whose points are all alike stays whole, however large. A null in a dimension
    counts as the dimension's least value; a null or negative weight as 0; a null key is kept as null. Rows alike come
    to one leaf. An empty table gives an empty one. dimensions and weight are columns of rows; others are not read.
    """
    names = [f"d{i}" for i in range(len(dimensions))]
    p = rows.select(rows[key].alias("id"), F.greatest(F.coalesce(weight.cast("long"), F.lit(0)), F.lit(0)).alias("w"), *[c.cast("double").alias(n) for n, c in zip(names, dimensions.values(), strict=True)])
    p = stored(p, "points")
    wide = p.agg(*[F.min(n).alias(f"a{n}") for n in names], *[F.max(n).alias(f"z{n}") for n in names]).first()
    least = {n: wide[f"a{n}"] if wide[f"a{n}"] is not None else 0.0 for n in names}
    span = {n: (wide[f"z{n}"] - least[n]) if wide[f"z{n}"] is not None else 0.0 for n in names}
    points = p.select("id", "w", F.lit(1).cast("long").alias("node"), *[F.coalesce(n, F.lit(least[n])).alias(n) for n in names])
    old, leaves = [p], None
    for depth in range(DEEPEST):
        stats = points.groupBy("node").agg(F.sum("w").alias("total"), F.count("*").alias("rows"), *[F.min(n).alias(f"a{n}") for n in names], *[F.max(n).alias(f"z{n}") for n in names])
        part = [F.when(F.lit(span[n] > 0), (F.col(f"z{n}") - F.col(f"a{n}")) / (span[n] or 1.0)).otherwise(0.0) for n in names]
        order = F.array_max(F.array(*[F.struct(x.alias("part"), F.lit(-i).alias("first")) for i, x in enumerate(part)]))
        stats = stored(stats.withColumn("dim", -order["first"]).withColumn("open", (F.col("total") > target) & (order["part"] > 0) & F.lit(depth < DEEPEST - 1)), "stats")
        shut = points.join(stats.filter("not open").select("node", "total", "rows"), "node").select("id", "w", F.col("node").alias("leaf"), "total", "rows")
        leaves = [*(leaves or []), stored(shut, "leaves")]
        n = stats.filter("open").count()
        if n == 0:
            break
        pick = lambda prefix: F.element_at(F.array(*[F.col(f"{prefix}{x}") for x in names]), F.col("dim") + 1)
        nodes = stats.filter("open").select("node", "dim", pick("a").alias("lo"), pick("z").alias("hi"), F.col("total"))
        x = _with_nodes(points, nodes.select("node", "dim", "lo", "hi"), n)
        medians = _weighted_medians(x.select("node", pick("").alias("v"), "w", "lo", "hi"), nodes.select("node", (F.col("total") / 2).alias("need")), n)
        cuts = stored(medians.join(nodes.select("node", "dim", "hi"), "node"), "cuts")
        y = _with_nodes(points, cuts, n)
        left = F.when(F.col("at") < F.col("hi"), pick("") <= F.col("at")).otherwise(pick("") < F.col("at"))
        points = stored(y.select("id", "w", (F.col("node") * 2 + F.when(left, 0).otherwise(1)).alias("node"), *names), "points")
        dropped(*old)
        old = [points]
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    return out.select("id", F.col("w").alias("bytes"), "leaf", F.col("total").alias("leaf_bytes"), F.col("rows").alias("leaf_rows"))


def document_shards(docs: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """sharded() for documents: length, source, language and number are the dimensions, bytes of text the weight.

    Sources and languages count by their rank among the table's own, so any two are different points.
    """
    d = docs.select(record_key(docs, "doc_id").alias("doc_id"), F.log1p(F.greatest(docs["n_chars"], F.lit(0))).alias("length"), docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"), F.octet_length(docs["text"]).alias("size"))
    for c in ("source", "lang"):
        codes = stored(ranks(d.select(c)), "codes")
        d = d.join(bounded(codes.select(F.col("value").alias(c), F.col("code").alias(f"{c}_code")), 64), c, "left")
    dims = {"n_chars": d["length"], "source": d["source_code"], "lang": d["lang_code"], "doc_id": d["doc_id"]}
    return sharded(d, "doc_id", dims, d["size"], target).withColumnRenamed("id", "doc_id")
