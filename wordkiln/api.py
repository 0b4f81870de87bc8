"""The engine's functions over tables, lists of texts or files, by one name each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import resources as R
from .operators import chat, providers, retrieval, tokens, vectors
from .operators.classify import classify as _classify
from .sources.files import resolve
from .sources.store import TextIndex

Source = DataFrame | list[str] | str


def _texts(spark: SparkSession, source: Source) -> DataFrame:
    """A table as it is; texts of a list or a file with id, their place."""
    return source if isinstance(source, DataFrame) else resolve(spark, source).select(F.col("pos").alias("id"), "text")


def squeeze(spark: SparkSession, source: Source, resources: R.Resources = R.SEED, cloud: bool = False) -> DataFrame:
    """Texts normalised, compressed and, for the cloud, translated, with what that saves."""
    return tokens.squeezed(_texts(spark, source), resources=resources, lexicon=R.seed_lexicon() if cloud else None)


def nibble(spark: SparkSession, source: Source, counters: dict[str, Callable[[Column], Column]], resources: R.Resources = R.SEED) -> DataFrame:
    """Tokens of texts and of what they become squeezed, by each counter."""
    return tokens.token_stats(_texts(spark, source), counters, resources=resources)


def sniff(spark: SparkSession, source: Source, categories: list[str] | dict[str, str | list[str]], squeeze_first: bool = False, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Texts by category, the confidence to three places."""
    got = _classify(_texts(spark, source), categories, embed or providers.embedder(), squeeze_first)
    return got.withColumn("confidence", F.round("confidence", 3))


def stir(spark: SparkSession, source: Source, folder: str, name: str | None = None, embed: Callable[[Column], Column] | None = None, **options) -> TextIndex:
    """A source indexed in a folder; without an embedder by words alone."""
    return TextIndex(spark, folder, embed).put(source, name, **options)


def mumble(index: TextIndex, query: str, k: int = 10) -> DataFrame:
    return index.search(query, k)


def sip(spark: SparkSession, source: Source, topics: list[str], threshold: float = 0.5, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """topic, id, score, place of the texts of each topic; a topic without any has one row of nulls."""
    embed = embed or providers.embedder()
    named = spark.createDataFrame([(t,) for t in topics], "topic string").withColumn("v", embed(F.col("topic")))
    return vectors.topics(_texts(spark, source).withColumn("_v", embed(F.col("text"))), named, threshold, "id", "_v")


def brew(index: TextIndex, query: str, classify: Callable[[Column], Column], extract: Callable[[Column], Column] | None = None, fields: dict[str, type] | None = None, strategy: str = "hierarchical", limit: int = 50) -> DataFrame:
    """What a model keeps of the texts found, or the fields it extracts from them."""
    found = index.all_chunks() if strategy == "full_scan" else index.search(query, retrieval.prefilter_size(index.count()))
    return retrieval.retrieve(found, classify, extract, fields, strategy=strategy, limit=limit)


def rewrite_conversations(df: DataFrame, rewrite: Callable[[Column], Column] | None = None, **options) -> DataFrame:
    """Messages that pass the guard rewritten, squeezed unless told otherwise."""
    return chat.rewrite_messages(df, rewrite, **options)
