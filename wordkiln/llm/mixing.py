"""Mixing sources to target weights: shares to a power found by bisection, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, free_name, stored

#: Entropy of the weights, as a part of that of equal weights, that the exponent is to reach.
ENTROPY = 0.97
#: No source may be passed over more often than this.
REPEATS = 4.0
BLOCK_TOKENS = 250_000
STEPS = 60


def tempered(shares: list[float], exponent: float) -> list[float]:
    """Shares to the power of exponent, normalised. Zero shares stay zero."""
    w = [s**exponent if s > 0 else 0.0 for s in shares]
    total = math.fsum(w)
    return [x / total for x in w]


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def exponent_for(tokens: list[int], budget: float, target: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The largest exponent in [0, 1] whose weights reach the target entropy, raised again as far as the repetition limit asks.

    Entropy falls and the smallest source's repetition falls as the exponent grows, so both are bisected. Natural shares
    that are even enough already give 1; if even natural shares (1) break the repetition limit, 1 is the result.
    """
    total = sum(tokens)
    live = [t for t in tokens if t > 0]
    if len(live) < 2 or total == 0:
        return 1.0
    shares = [t / total for t in live]

    def bisect(good) -> float:
        """Upper end of the exponents from 0 for which good holds (it holds up to some exponent)."""
        if good(1.0):
            return 1.0
        lo, hi = 0.0, 1.0
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if good(mid) else (lo, mid)
        return lo

    even = bisect(lambda x: entropy(tempered(shares, x)) >= target * math.log(len(live)))
    over = lambda x: max(w * budget / t for w, t in zip(tempered(shares, x), live, strict=True)) > repeats
    return max(even, bisect(over)) if over(even) else even


def token_count(text: Column) -> Column:
    """Words between white space; null and blank have none."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"(?U)\s+"))).cast("long")


def _order(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def plan(sizes: DataFrame, budget: float | None = None, target: float = ENTROPY, repeats: float = REPEATS) -> tuple[list[tuple], float]:
    """[(source, tokens, weight, quota)] and the exponent, of a table (source, tokens) with one row a source."""
    rows = [(r[0], r[1]) for r in sizes.select("source", "tokens").collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0] or ""))
    tokens = [t for _, t in rows]
    total = sum(tokens)
    budget = float(total) if budget is None else float(budget)
    x = exponent_for(tokens, budget, target, repeats)
    weights = tempered([t / total for t in tokens], x) if total else [0.0] * len(rows)
    return [(s, t, w, round(w * budget)) for (s, t), w in zip(rows, weights, strict=True)], x


def planned(docs: DataFrame, budget: float | None = None, target: float = ENTROPY, repeats: float = REPEATS, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """h0, h1 (which rows: hash of key, source and text), key, source, rows (so many are alike), n_tokens (of each), epoch,
    block, block_rank, place, progress: when these rows are passed over, one row for each time.

    A source's documents fall by hash into blocks of about block_tokens. Each pass over a source (epoch) takes its blocks
    in an order of its own (block_rank) until the source's quota (weight * budget tokens) is spent: whole blocks, then of
    the last block the documents, by hash (place), that still fit from the first on. No source falls short by more than
    a document, and blocks keep every sort and running total small whatever a source's size. progress is the part of its
    source's quota that is spent before: all rows by progress are sources mixed at their weights throughout.

    Texts are read and counted once; what follows is done on hashes and counts. A null source is a source. Null and blank
    texts hold no tokens and come with every whole pass of their block. Rows of one key, source and text are passed over
    together, as one document. An empty table gives an empty one. budget: tokens; those of docs if None.
    """
    spark = docs.sparkSession
    units = docs.select(*_hashes(docs, key, text, source), docs[key].alias("key"), docs[source].alias("source"), token_count(docs[text]).alias("n_tokens"))
    units = units.groupBy("h0", "h1").agg(F.first("key").alias("key"), F.first("source").alias("source"), F.first("n_tokens").alias("n_tokens"), F.count("*").alias("rows"))
    units = stored(units.withColumn("source_key", F.coalesce(F.col("source").cast("string"), F.lit("\u0000null"))), "units")
    sizes = units.groupBy(F.col("source_key").alias("source")).agg(F.sum(F.col("n_tokens") * F.col("rows")).alias("tokens"))
    rows, _ = plan(sizes, budget, target, repeats)
    table = spark.createDataFrame([(s, int(t), int(q), max(1, -(-t // block_tokens))) for s, t, _, q in rows], "source_key string, total long, quota long, blocks long")
    base = units.join(bounded(table, 100), "source_key")
    h = F.conv(F.substring(_order(F.lit(seed), F.col("key")), 1, 8), 16, 10).cast("long")
    base = base.withColumn("block", (h % F.col("blocks")).cast("int")).withColumn("own", F.col("n_tokens") * F.col("rows"))
    blocks = base.groupBy("source_key", "block", "total", "quota").agg(F.sum("own").alias("size"))
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.when(F.col("total") > 0, F.floor(F.col("quota") / F.col("total"))).otherwise(0).cast("int"))))
    turn = Window.partitionBy("source_key", "epoch").orderBy(_order(F.lit(seed), F.col("source_key"), F.col("epoch"), F.col("block")), "block")
    spent = F.col("epoch") * F.col("total") + F.coalesce(F.sum("size").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("spent", spent).withColumn("block_rank", F.row_number().over(turn) - 1)
    blocks = blocks.filter("quota > spent or (total = 0 and epoch = 0)")
    # a block is whole in the passes before the last and cut in at most one
    passes = F.sort_array(F.collect_list(F.struct("epoch", "block_rank", "spent")))
    blocks = blocks.groupBy("source_key", "block", "quota").agg(passes.alias("passes"))
    inside = Window.partitionBy("source_key", "block").orderBy(_order(F.lit(seed + 1), F.col("key")), "key", "h0", "h1")
    placed = base.drop("quota").withColumn("before", F.coalesce(F.sum("own").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("place", F.row_number().over(inside) - 1)
    out = placed.join(blocks, ["source_key", "block"]).withColumn("pass", F.explode("passes"))
    at = F.col("pass.spent") + F.col("before")
    out = out.filter((at + F.col("own") <= F.col("quota")))
    progress = F.when(F.col("quota") > 0, at / F.col("quota")).otherwise(0.0)
    return out.select("h0", "h1", "key", "source", "rows", "n_tokens", F.col("pass.epoch").alias("epoch"), "block", F.col("pass.block_rank").alias("block_rank"), "place", progress.alias("progress"))


def _hashes(docs: DataFrame, key: str, text: str, source: str) -> list[Column]:
    c = [docs[x] for x in (key, source, text)]
    return [F.xxhash64(*c).alias("h0"), F.xxhash64(F.lit(1), *c).alias("h1")]


def order(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The order of training, without texts: source, epoch, block, block_rank, place, progress, key, n_tokens; as planned()."""
    out = planned(docs, key=key, text=text, source=source, **options)
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return out.select("source", "epoch", "block", "block_rank", "place", "progress", F.col("key").alias(key), "n_tokens")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """_epoch, _tokens, _progress (with more underscores where docs has such a column) and all columns of docs: each row once for each time it is passed over, as planned()."""
    when = planned(docs, key=key, text=text, source=source, **options)
    mine = [free_name(docs.columns, x) for x in ("_h0", "_h1", "_epoch", "_tokens", "_progress")]
    when = when.select(*[F.col(c).alias(x) for c, x in zip(("h0", "h1", "epoch", "n_tokens", "progress"), mine, strict=True)])
    hashes = [c.alias(x) for c, x in zip(_hashes(docs, key, text, source), mine[:2], strict=True)]
    return docs.select("*", *hashes).join(when, mine[:2]).select(*mine[2:], *[F.col(f"`{c}`") for c in docs.columns])
