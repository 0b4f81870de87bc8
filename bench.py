"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line. Each query runs once to warm up, then three times (once if it is long); the median counts."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from wordkiln.operators import lexical, vectors  # noqa: E402
from wordkiln.plans import catalog  # noqa: E402

HEADLINE = ("token_savings_by_lang", "compress_full", "translate_words", "rewrite_conversations", "chunk_merge_split", "bm25_or", "lexical_topk_dedup", "vector_topk", "topic_threshold", "nearest_examples", "content_dedup", "vocab_build", "stream_sentences")


#: A query that takes longer than this is timed once after its warm run, not three times.
LONG = 1.5


def timed(run, times: int = 3, again=lambda: None) -> float:
    """again: called before each run."""
    again()
    t = time.perf_counter()
    run()
    took = []
    for _ in range(1 if time.perf_counter() - t > LONG else times):
        again()
        t = time.perf_counter()
        run()
        took.append(time.perf_counter() - t)
    return round(median(took), 4)


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        # one small file a table here: splits small enough for every core
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = docs.count()
    # the tables' files have few row groups, so texts are dealt out once; what is timed reads them from memory
    texts = docs.select("doc_id", "text").repartition(int(cpus) * 4).cache()
    texts.count()
    queries = {}

    def squeeze():
        from wordkiln.operators import tokens

        sink(texts.select("doc_id", tokens.squeeze(F.col("text"), catalog.RULES).alias("s")))

    queries["normalize_compress"] = timed(squeeze)
    print("normalize_compress", queries["normalize_compress"], file=sys.stderr, flush=True)
    texts.unpersist()
    for name in HEADLINE:
        # from the files each time: nothing that a run may have kept is used again
        queries[name] = timed(lambda name=name: sink(catalog.queries()[name](spark, d)), again=spark.catalog.clearCache)
        print(name, queries[name], file=sys.stderr, flush=True)
    index, sizes = lexical.postings(docs).repartition("term").cache(), lexical.lengths(docs).cache()
    index.count(), sizes.count()
    queries["lexical_topk_latency"] = timed(lambda: lexical.bm25(index, sizes, ["tion", "ing"]).orderBy("rank", "doc_id").limit(10).collect(), 5)
    e = spark.read.parquet(f"{d}/embeddings.parquet").cache()
    q = [float(x) for x in e.orderBy("vec_id").first()["embedding"]]
    queries["semantic_topk_latency"] = timed(lambda: vectors.top_k(e, q, 10).collect(), 5)
    value = round(sum(queries.values()), 3)
    print(json.dumps({"metric": "sum of median seconds of the headline queries", "value": value, "unit": "sec", "queries": queries, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf"), "texts_per_sec": round(n / queries["normalize_compress"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
