"""Texts by category: names, or examples of each, through an embedder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import resources as R
from ..functions import text as X
from . import vectors
from .tokens import squeeze


def classify(df: DataFrame, categories: list[str] | dict[str, str | list[str]], embed: Callable[[Column], Column], squeeze_first: bool = False, resources: R.Resources = R.SEED, key: str = "id", text: str = "text") -> DataFrame:
    """key, text, category, confidence. categories: names, or examples by name; there are few, and every task gets them.

    With squeeze_first the squeezed text is classified, and given.
    """
    spark = df.sparkSession
    by_example = isinstance(categories, dict)
    rows = vectors.parse_examples(categories) if by_example else [(n, i, n) for i, n in enumerate(categories)]
    known = spark.createDataFrame(rows, "category string, ord int, t string").select("category", "ord", embed(F.col("t")).alias("v"))
    d = X.settled(df.select(key, F.col(text).alias("_t")), "text", squeeze(F.col("_t"), resources)) if squeeze_first else df.select(key, F.col(text).alias("text"))
    d = d.select(key, "text", embed(F.col("text")).alias("_v"))
    return (vectors.nearest_examples if by_example else vectors.nearest_name)(d, known, key, "_v", ("text",))
