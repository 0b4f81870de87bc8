"""Retrieval with a model: prefilter, classify, extract, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

STRATEGIES = ("hierarchical", "filter", "full_scan")


def prefilter_size(total: int, k: int | None = None) -> int:
    """A tenth of the rows, but 50 to 500, and no more than there are."""
    return min(k or min(500, max(50, total // 10)), total)


def distinct_fields(df: DataFrame, fields: list[str], order: str) -> DataFrame:
    """One row of each combination of fields, the first by order."""
    w = Window.partitionBy(*fields).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def retrieve(candidates: DataFrame, classify: Callable[[Column], Column] | None, extract: Callable[[Column], Column] | None = None, fields: dict[str, type] | None = None, strategy: str = "hierarchical", k: int | None = None, limit: int = 50, key: str = "doc_id", text: str = "text", score: str = "score") -> DataFrame:
    """Rows of candidates (key, text, score) that the strategy keeps, best first, or the fields extracted from them.

    hierarchical takes the k best and classifies them, filter takes the k best, full_scan classifies all rows at score 0.
    classify and extract give a model's answers as strings. Extracted rows are made distinct, then limited.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r} is none of {', '.join(STRATEGIES)}")
    if strategy == "full_scan":
        d = candidates.withColumn(score, F.lit(0.0))
    else:
        size = k or prefilter_size(candidates.count())  # a limit above their number is none: counting would search twice
        d = candidates.orderBy(F.col(score).desc(), key).limit(size)
    if strategy != "filter":
        d = d.filter(X.yes_no(classify(F.col(text))))
    order = [F.col(score).desc(), F.col(key)]
    if not fields:
        return d.select(key, text, score).orderBy(*order).limit(limit)
    got = d.withColumn("_o", F.row_number().over(Window.orderBy(*order))) if strategy != "full_scan" else d.withColumn("_o", F.col(key))
    got = got.withColumn("_f", X.extracted(extract(F.col(text)), fields)).filter(F.col("_f").isNotNull()).select("_o", "_f.*")
    return distinct_fields(got, list(fields), "_o").orderBy("_o").limit(limit).drop("_o")
