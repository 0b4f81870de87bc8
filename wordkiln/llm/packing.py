"""Packing into windows: length combinations, repeat counts by non-negative least squares, greedy packing of the rest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts
from .mixing import token_count

WINDOW = 2048
BIN = 32
DEPTH = 3
#: Documents of a shard: each shard is packed by itself, so at most one window a shard stays poorly filled.
SHARD_DOCS = 20_000


def combinations(bins: int, depth: int = DEPTH) -> np.ndarray:
    """[m, bins]: how often each length 1..bins (in bins) is taken, over all sets of up to depth whose sum fills `bins`
    exactly or falls one bin short."""
    out: list[list[int]] = []

    def grow(least: int, left: int, taken: list[int]) -> None:
        if left <= 1 and taken:
            out.append(list(taken))
        if left < least or len(taken) == depth:
            return
        for x in range(least, left + 1):
            taken.append(x)
            grow(x, left - x, taken)
            taken.pop()

    grow(1, bins, [])
    rows = np.zeros((len(out), bins), dtype=np.int64)
    for i, c in enumerate(out):
        np.add.at(rows[i], np.array(c) - 1, 1)
    return rows


def nnls(a: np.ndarray, b: np.ndarray, most_steps: int = 0) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by Lawson and Hanson's active sets."""
    m, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    gram, target = a.T @ a, a.T @ b
    tolerance = 1e-10 * max(1.0, np.abs(target).max(initial=0.0))
    for _ in range(most_steps or 4 * m + 20):
        w = target - gram @ x
        w[passive] = -np.inf
        j = int(w.argmax()) if n else 0
        if not n or w[j] <= tolerance:
            break
        passive[j] = True
        while True:
            p = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, p], b, rcond=None)[0]
            if (s > 1e-12).all():
                x[:] = 0
                x[p] = s
                break
            low = s <= 1e-12
            old = x[p]
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(low, old / np.maximum(old - s, 1e-300), np.inf).min()
            x[p] = old + min(step, 1.0) * (s - old)
            drop = p[(x[p] <= 1e-12) & low]
            passive[drop if len(drop) else p[low][:1]] = False
            x[~passive] = 0
    return x


def pack_shard(lengths: np.ndarray, window: int = WINDOW, width: int = BIN, depth: int = DEPTH) -> np.ndarray:
    """Window number of each piece (lengths in 1..window).

    Lengths are rounded up to bins, so any combination of bins fits. Windows of the solved patterns are filled first,
    each as often as its rounded count says and its bins still hold pieces; the rest goes longest first into the
    fullest window that has room (best fit).
    """
    bins = window // width
    of = np.minimum(-(-lengths // width), bins)
    at: list[list[int]] = [[] for _ in range(bins + 1)]
    for i in np.lexsort((np.arange(len(lengths)), -lengths))[::-1]:
        at[of[i]].append(int(i))  # the longest of a bin is taken first, from the end
    histogram = np.bincount(of, minlength=bins + 1)[1:].astype(float)
    combos = combinations(bins, depth)
    present = histogram > 0
    combos = combos[(combos[:, ~present] == 0).all(axis=1)]
    where, room = np.full(len(lengths), -1, dtype=np.int64), []
    if len(combos):
        x = nnls(combos.T.astype(float), histogram)
        for c in np.argsort(-x, kind="stable"):
            need = [(int(k) + 1, int(v)) for k, v in enumerate(combos[c]) if v]
            times = min([int(x[c] + 0.5), *(len(at[k]) // v for k, v in need)])
            for _ in range(times):
                left = window
                for k, v in need:
                    for _ in range(v):
                        i = at[k].pop()
                        where[i] = len(room)
                        left -= int(lengths[i])
                room.append(left)
    open_by: dict[int, list[int]] = {}
    for i, left in enumerate(room):
        open_by.setdefault(left, []).append(i)
    have = np.zeros(window + 1, dtype=bool)
    for left in open_by:
        have[left] = True
    for k in range(bins, 0, -1):
        for i in reversed(at[k]):
            n = int(lengths[i])
            fits = np.flatnonzero(have[n:])
            if len(fits):
                left = n + int(fits[0])
                j = open_by[left].pop()
                have[left] = bool(open_by[left])
            else:
                j, left = len(room), window
                room.append(window)
            where[i] = j
            room[j] = left - n
            open_by.setdefault(left - n, []).append(j)
            have[left - n] = True
    return where


PIECES = "shard int, window long, slot int, doc_id long, text_hash long, copy long, piece int, start long, n_tokens long, at int"


def _pack(window: int, width: int, depth: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text_hash", "copy", "piece"], kind="stable").reset_index(drop=True)
        pdf["window"] = pack_shard(pdf["n_tokens"].to_numpy(), window, width, depth)
        pdf = pdf.sort_values(["window", "doc_id", "text_hash", "copy", "piece"], kind="stable")
        g = pdf.groupby("window")["n_tokens"]
        pdf["slot"], pdf["at"] = g.cumcount().astype("int32"), (g.cumsum() - pdf["n_tokens"]).astype("int32")
        return pdf[[f.split()[0] for f in PIECES.split(", ")]]

    return run


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, width: int = BIN, depth: int = DEPTH, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row a piece: shard, window (number in the shard), slot, at (place in the window), doc_id, text_hash, copy, piece,
    start, n_tokens.

    A text of more than window tokens is cut into full windows and a rest; nothing is dropped. text_hash and copy tell
    apart rows that share a key. Texts without tokens (null, blank) and rows with a null key take no place. Only
    keys and lengths are shuffled. An empty table gives an empty one. Other columns are not read.
    """
    d = docs.select(docs[key].cast("long").alias("doc_id"), token_count(docs[text]).alias("n"), F.xxhash64(docs[text]).alias("h"), docs[text].rlike(r"(?U)\S").alias("some"))
    d = d.filter("doc_id is not null and some")  # not n > 0: that would count tokens a second time, under the filter
    n = docs.count()
    # rows alike are numbered within their group, not by a window over all rows of a key
    d = d.groupBy("doc_id", "h", "n").agg(F.count("*").alias("rows"))
    d = d.select("doc_id", F.col("h").alias("text_hash"), "n", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("copy"))
    d = d.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash", "copy"), F.lit(parts(n, shard_docs))).cast("int"))
    d = d.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / window).cast("int"))))
    start = F.col("piece").cast("long") * window
    d = d.select("shard", "doc_id", "text_hash", "copy", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(window)).alias("n_tokens"))
    return d.groupBy("shard").applyInPandas(_pack(window, width, depth), PIECES)
