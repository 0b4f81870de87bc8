"""An index as parquet tables partitioned by source: chunks, postings, vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import resources as R
from ..functions import text as X
from ..operators import chunking, lexical, vectors
from ..operators.providers import lemmatize_table
from .files import resolve

CORPUS_TABLES = {
    "raw_texts": "id long, source string, source_id string, source_name string, text string, author_hash string, collected_at timestamp, corpus string, word_count int, processed boolean",
    "corpus_lexicon": "id long, word string, type string, meaning string, example string, normalized_form string, first_seen date, last_seen date, frequency_30d int, status string, tags string",
    "pairs": "id long, source_text string, optimized_text string, style string, method string, tokens map<string,int>, compression_ratio double, validated boolean, validator string, created_at timestamp, notes string",
    "normal_texts": "id long, source string, text string, category string, word_count int, tokens map<string,int>, imported_at timestamp",
}


def with_corpus(raw: DataFrame, corpus_of: dict[str, str]) -> DataFrame:
    """raw_texts with a missing corpus filled by source."""
    table = F.create_map(*[F.lit(x) for kv in corpus_of.items() for x in kv]) if corpus_of else F.create_map().cast("map<string,string>")
    old = F.col("corpus") if "corpus" in raw.columns else F.lit(None).cast("string")
    return raw.withColumn("corpus", F.coalesce(old, F.try_element_at(table, F.col("source"))))


def author_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


class TextIndex:
    """A folder of tables. put() replaces what a source had before; search is by vectors with an embedder, else by words.

    Lexical queries read postings of their terms and lengths; vectors aren't touched. Texts and queries are normalised, and
    their words brought to their lemmas by the resources' (few) or by a table of forms (form, lemma) of any size.
    """

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[Column], Column] | None = None, resources: R.Resources = R.SEED, forms: DataFrame | None = None):
        self.spark, self.folder, self.embed, self.resources, self.forms = spark, folder.rstrip("/"), embed, resources, forms

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _write(self, df: DataFrame, name: str, mode: str) -> None:
        df.write.partitionBy("source").mode(mode).option("partitionOverwriteMode", "dynamic").parquet(f"{self.folder}/{name}")

    def _chunked(self, c: DataFrame) -> DataFrame:
        """Chunks with their ids, hashes of source and place and so the same on every run, and what is indexed of them."""
        c = c.select(F.xxhash64("source", "chunk").alias("doc_id"), "source", "chunk", "text", lexical.index_text(F.col("text"), self.resources).alias("normalized"))
        return c if self.forms is None else lemmatize_table(c, self.forms, "doc_id", "normalized", "normalized")

    def _index(self, fresh: DataFrame, mode: str) -> None:
        terms = fresh.select("source", "doc_id", F.explode(X.index_terms(F.col("normalized"))).alias("term")).groupBy("source", "term", "doc_id").agg(F.count("*").alias("tf"))
        self._write(terms, "postings", mode)
        self._write(fresh.select("source", "doc_id", F.size(X.index_terms(F.col("normalized"))).cast("long").alias("n_terms")), "lengths", mode)
        if self.embed:
            self._write(fresh.select("doc_id", "source", "text", self.embed(F.col("normalized")).alias("embedding")), "vectors", mode)

    def put(self, source: DataFrame | list[str] | str, name: str | None = None, least: int = chunking.MIN_WORDS, most: int = chunking.MAX_WORDS, **reader_options) -> TextIndex:
        """Texts of a source, chunked and indexed in place of what it had."""
        d = resolve(self.spark, source, **reader_options)
        d = d if name is None else d.withColumn("source", F.lit(name))
        c = self._chunked(chunking.chunks(d, "source", "pos", "text", least, most))
        self._write(c, "chunks", "overwrite")
        names = [r[0] for r in c.select("source").distinct().collect()]
        if names:
            self._index(self.table("chunks").filter(F.col("source").isin(*names)), "overwrite")
        return self

    def add(self, source: DataFrame | list[str] | str, name: str | None = None, **reader_options) -> TextIndex:
        """Texts of a source as chunks of their own after those it has; blank ones are left out."""
        d = resolve(self.spark, source, **reader_options)
        d = (d if name is None else d.withColumn("source", F.lit(name))).filter(F.col("text").isNotNull() & ~X.blank(F.col("text")))
        names = [r[0] for r in d.select("source").distinct().collect()]
        if not names:
            return self
        try:
            had = {r[0]: r[1] + 1 for r in self.table("chunks").filter(F.col("source").isin(*names)).groupBy("source").agg(F.max("chunk")).collect()}
        except AnalysisException:
            had = {}
        after = F.create_map(*[F.lit(x) for n in names for x in (n, had.get(n, 0))])[F.col("source")]
        c = self._chunked(d.select("source", (after + F.col("pos")).cast("int").alias("chunk"), "text"))
        self._write(c, "chunks", "append")
        self._index(self.table("chunks").filter(F.col("source").isin(*names) & (F.col("chunk") >= after)), "append")
        return self

    def size(self) -> int:
        """Texts in the index, with or without vectors."""
        return self.table("chunks").count()

    def count(self) -> int:
        """Vectors, 0 without an embedder."""
        return self.table("vectors").count() if self.embed else 0

    def search(self, query: str, k: int = 10) -> DataFrame:
        """text, score, doc_id of the k best different texts."""
        if self.embed:
            q = self.spark.createDataFrame([(query,)], "q string").select(self.embed(F.col("q")).alias("q"))
            return vectors.top_k(self.table("vectors"), q, k, "doc_id", "embedding", "text")
        if self.forms is not None:
            asked = self.spark.range(1).select("id", lexical.index_text(F.lit(query), self.resources).alias("q"))
            query = lemmatize_table(asked, self.forms, "id", "q", "q").first()["q"] or ""
            terms = lexical.query_terms(query)
        else:
            terms = lexical.query_terms(query, self.resources, self.spark)
        hits = lexical.bm25(self.table("postings"), self.table("lengths"), terms).orderBy("rank", "doc_id").limit(3 * k)
        named = self.table("chunks").select("doc_id", "text").join(F.broadcast(hits), "doc_id")
        best = named.groupBy("text").agg(F.min(F.struct("rank", "doc_id")).alias("b"))
        return best.select(F.col("b.doc_id").alias("doc_id"), F.abs("b.rank").alias("score"), "text").orderBy(F.col("score").desc(), "doc_id").limit(k)

    def all_chunks(self) -> DataFrame:
        return self.table("vectors").select("text", F.lit(0.0).alias("score"), "doc_id")
