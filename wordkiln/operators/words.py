"""Word tables too large for an expression: tokens joined to a dictionary and put together again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import resources as R
from ..functions import text as X
from ..sources import files
from .morphology import Morphology, inflected_like

#: Rows of a dictionary that may be sent to all executors; a larger one is joined by shuffle.
BROADCAST_WORDS = 2_000_000
#: What stands for the first token of a run of three or two words; I stands for its others.
_MARKS = {3: "T", 2: "P"}


def hinted(small: DataFrame, rows: int | None = None) -> DataFrame:
    """small with a broadcast hint if it has few enough rows; counted unless the number is known."""
    return F.broadcast(small) if (small.count() if rows is None else rows) <= BROADCAST_WORDS else small


def exploded(df: DataFrame, key: str, text: Column, chars: str = R.PEELED, ahead: int = 0) -> DataFrame:
    """_key, _row, pos, prefix, core, suffix, token of every token of every row; a row without tokens has one of nulls.

    _rest, the row itself, stands at its first token. The rows are dealt by key before that and _row tells rows of one key
    apart, so joined_again() has each row's tokens in the task that made them: unless a join in between shuffles, the rows
    are shuffled once and tokens never. ahead: how many tokens after it stand in next1, next2 too, null at the end.
    """
    d = files.dealt(df, key).withColumn("_row", F.monotonically_increasing_id())
    ts = X.tokens(text)
    after = [f"next{k}" for k in range(1, ahead + 1)]
    if ahead:
        ts = X.let(ts, lambda a: F.transform(a, lambda t, i: F.struct(t.alias("token"), *[F.get(a, i + k + 1).alias(n) for k, n in enumerate(after)])))
    # the tokens are a column before they are exploded: a lambda in the generator would have Spark copy the row for each
    d = d.select(F.col(key).alias("_key"), "_row", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_rest"), ts.alias("_ts"))
    t = d.select("_key", "_row", "_rest", F.posexplode_outer("_ts").alias("pos", "token"))
    t = t.select("_key", "_row", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("_rest")).alias("_rest"), "pos", *(["token.*"] if ahead else ["token"]))
    return t.select("_key", "_row", "_rest", "pos", "token", *after, X.peel(F.col("token"), chars).alias("p")).select("_key", "_row", "_rest", "pos", "token", *after, "p.*")


def regrouped(tokens: DataFrame, *columns: str) -> DataFrame:
    """_rest and _l, an array of (pos, *columns) in order, of each row that was exploded."""
    one = F.when(F.col("pos").isNotNull(), F.struct("pos", *columns))
    return tokens.groupBy("_key", "_row").agg(F.first("_rest", ignorenulls=True).alias("_rest"), F.sort_array(F.collect_list(one)).alias("_l"))


def joined_again(tokens: DataFrame, df: DataFrame, out: str) -> DataFrame:
    """df, of which exploded() made the tokens, with column out: their out in order without nulls; "" where none is left."""
    return regrouped(tokens, out).select(*_columns(df, out), F.array_join(F.col("_l")[out], " ").alias(out))


def _columns(df: DataFrame, out: str) -> list[Column]:
    return [F.col("_rest")[c].alias(c) for c in df.columns if c != out]


def replace_words(df: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text", out: str = "normalized", morphology: Morphology | None = None, forms: DataFrame | None = None) -> DataFrame:
    """The join form of functions.text.replace_words. rules: word, replacement (null deletes); of equal words the last by ord.

    With forms (form, lemma) a word without a rule takes that of its lemma (of several rules of a lemma the first by ord),
    and with a morphology the replacement takes the word's form. Only words that hit reach Python.
    """
    last = Window.partitionBy("w").orderBy(F.col("ord").desc())
    r = rules.withColumn("w", F.lower("word")).withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("w", "replacement", "ord", F.lit(True).alias("hit"))
    t = exploded(df, key, F.col(text)).withColumn("w", F.lower("core")).join(hinted(r.drop("ord")), "w", "left")
    if forms is not None:
        f = forms.select(F.col("form").alias("w"), "lemma").dropDuplicates(["w"])
        of_rules = r.join(f, "w", "left").withColumn("lemma", F.coalesce("lemma", "w"))
        first = Window.partitionBy("lemma").orderBy("ord")
        by = of_rules.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("lemma", F.col("replacement").alias("lr"), F.lit(True).alias("lhit"))
        t = t.join(hinted(f), "w", "left").withColumn("lemma", F.coalesce("lemma", "w")).join(hinted(by), "lemma", "left")
        by_lemma = F.col("hit").isNull() & F.col("lhit").isNotNull()
        like = inflected_like(F.when(by_lemma, F.col("core")), F.when(by_lemma, F.col("lr")), morphology) if morphology else F.col("lr")
        t = t.withColumn("replacement", F.when(by_lemma, like).otherwise(F.col("replacement"))).withColumn("hit", F.coalesce("hit", "lhit"))
    done = F.when(F.col("hit").isNull() | (F.col("core") == ""), F.col("token")).otherwise(F.concat("prefix", "replacement", "suffix"))
    return joined_again(t.withColumn(out, done), df, out)


def normalize(df: DataFrame, rules: DataFrame, resources: R.Resources, key: str = "doc_id", text: str = "text", out: str = "normalized", morphology: Morphology | None = None, forms: DataFrame | None = None) -> DataFrame:
    """Normalisation with a table of one-word rules of any size; phrases and patterns are the resources'. Lemmas as in replace_words()."""
    phrases = X.replace_phrases(X.fold_apostrophes(F.col(text)), resources.phrases())
    d = replace_words(df.withColumn("_phrases", phrases), rules, key, "_phrases", out, morphology, forms).drop("_phrases")
    return d.withColumn(out, X.apply_patterns(F.col(out), resources.patterns)[0])


def _with_runs(t: DataFrame, lengths: list[int]) -> DataFrame:
    """t of exploded() with phrase2, tail2 and so on of each length: the tokens from each on as a phrase, if that many follow
    and no punctuation stands between them, and the last one's suffix."""
    last = max(lengths, default=1)
    t = t.select("*", *[X.peel(F.col(f"next{k}")).alias(f"_p{k}") for k in range(1, last)])
    ok, words, suffix = F.lit(True), F.lower("core"), F.col("suffix")
    for k in range(1, last):
        p = F.col(f"_p{k}")
        ok = ok & F.col(f"next{k}").isNotNull() & (suffix == "") & (p["prefix"] == "")
        words, suffix = F.concat(words, F.lit(" "), F.lower(p["core"])), p["suffix"]
        if k + 1 in lengths:
            t = t.withColumns({f"phrase{k + 1}": F.when(ok, words), f"tail{k + 1}": F.when(ok, suffix)})
    return t.drop(*[f"{n}{k}" for k in range(1, last) for n in ("next", "_p")])


def translate_words(df: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text", out: str = "english", lemmas: DataFrame | None = None) -> DataFrame:
    """Translation with a lexicon (word, en_compressed) of any size: phrases of 3 and 2 tokens, then words, then lemmas of
    the missing ones (lemmas: form, lemma; all forms of a lemma are mapped), then transliteration.

    Phrases are found as runs of words by joins, not by patterns: the longer ones first, then from the left. Blank and
    null texts stay as they are.
    """
    live = lexicon.filter(F.coalesce("en_compressed", F.lit("")) != "").select(F.lower("word").alias("w"), F.col("en_compressed").alias("en")).dropDuplicates(["w"])
    live = live.withColumn("n", F.size(F.split("w", " ")))
    rows = {r[0]: r[1] for r in live.groupBy("n").count().collect()}
    lengths = [n for n in (3, 2) if n in rows]
    t = _with_runs(exploded(df, key, F.col(text), ahead=max(lengths, default=1) - 1), lengths).withColumn("w", F.lower("core"))
    for n in lengths:
        of = live.filter(F.col("n") == n).select(F.col("w").alias(f"phrase{n}"), F.col("en").alias("to"))
        t = t.join(hinted(of, rows[n]), f"phrase{n}", "left").withColumn(f"run{n}", F.concat("prefix", "to", f"tail{n}")).drop("to")
    single = live.filter("n = 1").select("w", "en")
    t = t.join(hinted(single, rows.get(1, 0)), "w", "left")
    if lemmas is not None:
        by = lemmas.select(F.col("form").alias("w"), "lemma").join(single.select(F.col("w").alias("lemma"), F.col("en").alias("lemma_en")), "lemma").select("w", "lemma_en").dropDuplicates(["w"])
        t = t.join(hinted(by), "w", "left").withColumn("en", F.coalesce("en", "lemma_en"))
    done = (
        F.when(F.col("core") == "", F.col("token"))
        .when(F.col("en").isNotNull(), F.concat("prefix", "en", "suffix"))
        .when(X.has_cyrillic(F.col("core")), F.concat(F.col("prefix"), X.transliterate(F.col("core")), F.col("suffix")))
        .otherwise(F.col("token"))
    )
    t, runs = t.withColumn("one", done), [f"run{n}" for n in lengths]
    if lengths:
        # a letter a token: which runs begin there; patterns then take runs from the left in one pass, however many there are
        begins = [F.when(F.col(f"run{n}").isNotNull(), F.lit(str(n))) for n in lengths]
        both = F.when(F.col("run3").isNotNull() & F.col("run2").isNotNull(), F.lit("b")) if len(lengths) == 2 else None
        t = t.withColumn("begins", F.coalesce(*([both] if both is not None else []), *begins, F.lit("-")))
        g = regrouped(t, "one", "begins", *runs)
        marks = F.regexp_replace(F.regexp_replace(F.array_join(F.col("_l")["begins"], ""), "[3b]..", "TII"), "[2b][-23b]", "PI")
        part = lambda x, m: reduce(lambda c, n: c.when(m == _MARKS[n], x[f"run{n}"]), lengths, F.when(m == "I", F.lit(None).cast("string"))).otherwise(x["one"])
        parts = F.zip_with("_l", F.split(marks, ""), part)
    else:
        g = regrouped(t, "one")
        parts = F.col("_l")["one"]
    blank = F.col("_rest")[text].isNull() | X.blank(F.col("_rest")[text])
    return g.select(*_columns(df, out), F.when(blank, F.col("_rest")[text]).otherwise(F.array_join(parts, " ")).alias(out))


def frequencies(df: DataFrame, text: str = "text") -> DataFrame:
    """word (lower case) and how often it stands in the table."""
    return df.select(F.explode(X.tokens(F.lower(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
