"""python -m wordkiln: squeeze, count, classify, index, search, topics, retrieve."""

from __future__ import annotations

import argparse
import json
import sys
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from . import resources as R
from .operators import providers, retrieval, tokens, vectors
from .operators.classify import classify
from .sources import files
from .sources.store import TextIndex


def session() -> SparkSession:
    s = SparkSession.builder.appName("wordkiln").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def texts(spark: SparkSession, args) -> DataFrame:
    """id, text of the argument, else the lines of a file, else those of standard input; stripped, without blank ones."""
    if args.text:
        rows = [args.text]
    elif args.file:
        return files.read_lines(spark, args.file).select(F.col("pos").alias("id"), "text")
    else:
        rows = sys.stdin.read().splitlines()
    return spark.createDataFrame([(i, t.strip()) for i, t in enumerate(rows) if t.strip()], "id int, text string")


def _embedded(d: DataFrame) -> DataFrame:
    return d.withColumn("embedding", providers.embedder()(F.col("text")))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wordkiln", description="Text analytics on Spark")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, about: str, *, text: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        if text:
            c.add_argument("text", nargs="?")
            c.add_argument("--file")
        return c

    c = add("squeeze", "normalise and compress texts")
    c.add_argument("--target", choices=["cloud"], help="also translate")
    c.add_argument("--output", help="folder of text lines")
    c = add("nibble", "count words, or a tokenizer's tokens, before and after")
    c.add_argument("--ranks", action="append", default=[], metavar="NAME=FILE", help="byte-pair ranks to count by; may be given again")
    c = add("sniff", "classify texts by category names or examples")
    c.add_argument("--categories", required=True, help="names by commas, or JSON of name: examples")
    c.add_argument("--squeeze-first", action="store_true", help="classify the squeezed texts")
    c = add("stir", "index a file", text=False)
    c.add_argument("path")
    c.add_argument("--index", required=True)
    c.add_argument("--sheet")
    c.add_argument("--column")
    c = add("mumble", "search an index", text=False)
    c.add_argument("query")
    c.add_argument("--index", required=True)
    c.add_argument("-k", type=int, default=10)
    c = add("sip", "texts by topic")
    c.add_argument("--topics", required=True)
    c.add_argument("--threshold", type=float, default=0.5)
    c = add("brew", "retrieve with a model", text=False)
    c.add_argument("query")
    c.add_argument("--index", required=True)
    c.add_argument("--model", default="small")
    c.add_argument("--strategy", choices=retrieval.STRATEGIES, default="hierarchical")
    c.add_argument("--limit", type=int, default=50)
    return p


def _names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    show = lambda rows: print(json.dumps(rows, ensure_ascii=False, indent=2))
    if args.command == "squeeze":
        s = texts(spark, args).select("id", tokens.squeeze(F.col("text"), R.SEED, R.seed_lexicon() if args.target else None).alias("text"))
        if args.output:
            files.write_lines(s, args.output)
        else:
            print("\n".join(r.text for r in s.orderBy("id").toLocalIterator()))
    elif args.command == "nibble" and args.ranks:
        counters = {n: providers.token_counter(partial(providers.TiktokenCounter, f)) for n, f in (r.split("=", 1) for r in args.ranks)}
        show([r.asDict() for r in tokens.token_stats(texts(spark, args), counters).drop("id").collect()])
    elif args.command == "nibble":
        show([r.asDict() for r in tokens.squeezed(texts(spark, args)).select("text", "squeezed", "tokens_saved", "compression_ratio").collect()])
    elif args.command == "sniff":
        by_example = args.categories.lstrip().startswith("{")
        categories = json.loads(args.categories) if by_example else _names(args.categories)
        got = classify(texts(spark, args), categories, providers.embedder(), args.squeeze_first)
        show([{"text": r.text, "category": r.category, "confidence": round(r.confidence, 3)} for r in got.orderBy("id").collect()])
    elif args.command == "stir":
        TextIndex(spark, args.index, providers.embedder()).put(args.path, **{k: v for k, v in (("sheet", args.sheet), ("column", args.column)) if v})
    elif args.command == "mumble":
        show([r.asDict() for r in TextIndex(spark, args.index, providers.embedder()).search(args.query, args.k).collect()])
    elif args.command == "sip":
        topics = _embedded(spark.createDataFrame([(t, t) for t in _names(args.topics)], "topic string, text string")).withColumnRenamed("embedding", "v")
        d = _embedded(texts(spark, args))
        got = vectors.topics(d, topics, args.threshold, "id", "embedding").join(d.select("id", "text"), "id", "left").orderBy("topic", "place")
        out: dict[str, list] = {t: [] for t in _names(args.topics)}
        for r in got.collect():
            if r.text is not None:
                out[r.topic].append({"text": r.text, "score": r.score})
        show(out)
    else:
        index = TextIndex(spark, args.index, providers.embedder())
        if index.count() == 0:
            show([])
            return 0
        model = providers.LocalModel(args.model)
        ask = providers.as_column(lambda: lambda ts: model.classify(ts, args.query), "string")
        found = index.all_chunks() if args.strategy == "full_scan" else index.search(args.query, retrieval.prefilter_size(index.count()))
        show([r.asDict() for r in retrieval.retrieve(found, ask, strategy=args.strategy, limit=args.limit).collect()])
    return 0
