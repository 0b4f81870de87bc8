"""Chat messages: which to rewrite, rewriting them and the answers, in either style of chat interface."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import resources as R
from ..functions import text as X
from .morphology import Morphology
from .morphology import reverse_translate as in_agreement
from .tokens import percent_saved, squeeze


def message_passes(role: Column, content: Column, parts: Column | None = None, roles=("user",), squeeze_system: bool = False, skip=("json", "code")) -> Column:
    """Whether a message is rewritten: by its role, and by its text or any of its text parts."""
    allowed = F.when(role == "system", F.lit(squeeze_system)).otherwise(role.isin(*roles))
    passes = X.should_process(content, skip)
    if parts is not None:
        of_parts = F.exists(parts, lambda p: (p["type"] == "text") & X.should_process(p["text"], skip))
        passes = F.when(parts.isNotNull(), of_parts).otherwise(passes)
    return F.coalesce(allowed & passes, F.lit(False))


def rewrite_parts(parts: Column, rewrite: Callable[[Column], Column], per_part_guard: bool = False, skip=("json", "code")) -> Column:
    """Parts with their texts rewritten: all of a message that passes, or only those that pass themselves."""

    def one(p: Column) -> Column:
        wanted = p["type"] == "text"
        wanted = wanted & X.should_process(p["text"], skip) if per_part_guard else wanted
        return p.withField("text", F.when(wanted, F.coalesce(rewrite(p["text"]), p["text"])).otherwise(p["text"]))

    return F.transform(parts, one)


def rewrite_messages(df: DataFrame, rewrite: Callable[[Column], Column] | None = None, role: str = "role", text: str = "text", parts: str | None = None, roles=("user",), squeeze_system: bool = False, skip=("json", "code"), per_part_guard: bool = False, out: str = "rewritten") -> DataFrame:
    """df with passes and out (and parts replaced, if named). A rewrite that gives null leaves the original."""
    rewrite = rewrite or (lambda c: squeeze(c, R.SEED))
    p = F.col(parts) if parts else None
    d = df.withColumn("passes", message_passes(F.col(role), F.col(text), p, roles, squeeze_system, skip))
    d = d.withColumn(out, F.when(F.col("passes"), F.coalesce(rewrite(F.col(text)), F.col(text))).otherwise(F.col(text)))
    if parts:
        d = d.withColumn(parts, F.when(F.col("passes") & p.isNotNull(), rewrite_parts(p, rewrite, per_part_guard, skip)).otherwise(p))
    return d


def rewrite_system(df: DataFrame, rewrite: Callable[[Column], Column] | None = None, text: str = "system", blocks: str | None = None, skip=("json", "code")) -> DataFrame:
    """df, a row a request, with its system prompt rewritten where it passes: a text, or blocks each by itself."""
    rewrite = rewrite or (lambda c: squeeze(c, R.SEED))
    t = F.col(text)
    d = df.withColumn(text, F.when(X.should_process(t, skip), F.coalesce(rewrite(t), t)).otherwise(t))
    return d.withColumn(blocks, rewrite_parts(F.col(blocks), rewrite, True, skip)) if blocks else d


def _in_python(df: DataFrame) -> bool:
    """Whether some of its columns are made by Python functions, which get all rows whatever condition stands around them."""
    return "EvalPython" in df._jdf.queryExecution().optimizedPlan().toString()


def rewrite_answers(df: DataFrame, dictionary: dict[str, str], text: str = "text", kind: str | None = None, translate: Callable[[Column], Column] | None = None, threshold: float = 0.3, out: str = "restored", morphology: Morphology | None = None) -> DataFrame:
    """Answers turned back; blocks of a kind other than text stay. Where more than threshold of the words stay foreign and
    a translator is given, its result counts, unless it fails or is blank. Only those rows reach it. With a morphology
    neighbouring words are put in agreement."""
    d = in_agreement(df, dictionary, morphology, text, "_w") if morphology else X.settled(df, "_w", X.reverse_translate(F.col(text), dictionary))
    if translate is None:
        d = d.withColumn(out, F.col("_w"))
    else:
        d = X.settled(d, "_asked", F.when(X.untranslated_ratio(F.col("_w")) > threshold, F.col(text)))
        given = lambda x: x.withColumn(out, F.when(F.coalesce(X.strip(F.col("_t")), F.lit("")) != "", F.col("_t")).otherwise(F.col("_w"))).drop("_t", "_asked")
        if _in_python(d.select(translate(F.col("_asked")))):
            few, rest = d.filter(F.col("_asked").isNotNull()), d.filter(F.col("_asked").isNull())
            d = given(few.withColumn("_t", translate(F.col("_asked")))).unionByName(rest.withColumn(out, F.col("_w")).drop("_asked"))
        else:
            d = given(X.settled(d, "_t", F.when(F.col("_asked").isNotNull(), translate(F.col("_asked")))))
    if kind:
        d = d.withColumn(out, F.when(F.col(kind) == "text", F.col(out)).otherwise(F.col(text)))
    return d.drop("_w")


def message_savings(df: DataFrame, conv: str = "conv_id", before: str = "text", after: str = "rewritten") -> DataFrame:
    """Words of each conversation before and after, and the whole percentage saved."""
    g = df.groupBy(conv).agg(F.sum(X.token_count(F.col(before))).alias("words_before"), F.sum(X.token_count(F.col(after))).alias("words_after"))
    pct = F.when(F.col("words_before") > 0, F.bround((F.col("words_before") - F.col("words_after")) / F.col("words_before") * 100).cast("long")).otherwise(F.lit(0).cast("long"))
    return g.withColumn("pct_saved", pct)


def headers(**values: str | None) -> dict[str, str]:
    """Request headers that have a value."""
    return {k.replace("_", "-").title(): v for k, v in values.items() if v}


__all__ = ["headers", "message_passes", "message_savings", "percent_saved", "rewrite_answers", "rewrite_messages", "rewrite_parts", "rewrite_system"]
