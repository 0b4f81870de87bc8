"""Katz backoff: Good-Turing discounted n-gram counts, exactly normalised backoff weights, in partitioned tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import EMPTY_HASH, dropped, flat, mix, new_path, parts, record_key, released, stored, word_hashes

ORDER = 2
#: Words and n-grams of at least this share of all go to every executor (at most 1,000,000 of each): the rest are so rare that none is a hot key.
HOT_SHARE = 1e-6
#: Counts up to this are discounted by Good and Turing's estimate; larger ones are trusted.
TRUSTED = 5
BUCKET_TOKENS = 2_000_000
#: Of an id in the keys of Model.table(), the view for inspection; counting and scoring know words by their codes.
BITS = 21
UNKNOWN, START, END = 0, 1, 2
#: Code of the first hot word.
FIRST = 3
COMPACT = 1_500_000
#: Tokens of a batch that are taken at a time: with COMPACT this bounds a worker's memory whatever the texts.
PIECE = 500_000
#: Bigrams of one stored blob.
ROWS = 1_000_000


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of a batch of hashed words and their values and offsets, about PIECE words at a time; a row is never parted."""
    values, offsets = flat(b.column("h"))
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        yield slice(at, end), values[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def padded(values: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words between order - 1 START and one END, and the new offsets."""
    keep = values != EMPTY_HASH
    offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
    words = values[keep].view(np.uint64)
    n, extra = len(offsets) - 1, order
    new = offsets + np.arange(n + 1) * extra
    out = np.full(new[-1], START, dtype=np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(n) * extra + order - 1, np.diff(offsets))] = words
    out[new[1:] - 1] = END
    return out, new


def token_ids(values: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """padded() with the words' ids, places in the vocabulary (sorted hashes) and 3, instead of their hashes."""
    words, new = padded(values, offsets, order)
    place = np.minimum(np.searchsorted(vocabulary, words.view(np.int64)), max(len(vocabulary) - 1, 0))
    known = vocabulary[place] == words.view(np.int64) if len(vocabulary) else np.zeros(len(words), dtype=bool)
    return np.where(known, place.astype(np.uint64) + np.uint64(3), np.where(words <= END, words, np.uint64(UNKNOWN))), new


def joined(h: np.ndarray, s: np.ndarray) -> np.ndarray:
    """64-bit key of the n-gram of history h and suffix s, themselves keys of the n-grams without its last and first word."""
    return mix(mix(h, 1) ^ s, 2)


def ngrams(words: np.ndarray, offsets: np.ndarray, n: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of history and suffix of the n-grams that end in a word or END (not in START), and their rows. A word's key is its hash."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(np.arange(len(words)) - offsets[row] >= order - 1)
    if n == 1:
        return np.zeros(len(at), dtype=np.uint64), words[at], row[at]
    if n == 2:
        return words[at - 1], words[at], row[at]
    return joined(words[at - 2], words[at - 1]), joined(words[at - 1], words[at]), row[at]


def coded(words: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Codes of padded() words: START and END stay, a hot word's is its place in hot (sorted hashes) and FIRST, another's is its hash."""
    if not len(hot):
        return words
    at = np.minimum(np.searchsorted(hot, words.view(np.int64)), len(hot) - 1)
    return np.where(hot[at] == words.view(np.int64), at.astype(np.uint64) + np.uint64(FIRST), words)


def _place(h: np.ndarray, s: np.ndarray, ways: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of the bigrams of history h; those of a history with more ways than one are dealt by their suffix."""
    x = mix(h, 31)
    small = np.flatnonzero(h < len(ways))
    many = small[ways[h[small]] > 1]
    x[many] = mix(h[many] * np.uint64(1 << 20) + mix(s[many], 5) % ways[h[many]].astype(np.uint64), 32)
    return ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


class _Tally:
    """Counts of n-grams by key, added up in sorted arrays."""

    def __init__(self):
        self.rows, self.fresh = [], 0

    def add(self, keys: np.ndarray, h: np.ndarray, s: np.ndarray) -> None:
        k, at, c = np.unique(keys, return_index=True, return_counts=True)
        self.rows.append((k, h[at], s[at], c))
        self.fresh += len(k)

    def full(self) -> bool:
        """Whether it holds so many keys, even after adding up, that they had better be given away."""
        if self.fresh > COMPACT // 2:
            self.compact()
            self.fresh = len(self.rows[0][0])
        return self.fresh > COMPACT // 2

    def compact(self) -> tuple[np.ndarray, ...]:
        k, h, s, c = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.argsort(k, kind="stable")
        k, h, s, c = k[order], h[order], s[order], c[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, dtype=np.int64)
        self.rows, self.fresh = [(k[first], h[first], s[first], np.add.reduceat(c, first) if len(first) else c)], 0
        return self.rows[0]


def _blobs(place: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(place, kind, blob) of rows in order of place and, within it, of the first column, which is stored by its steps."""
    cut = np.r_[np.flatnonzero(np.r_[True, place[1:] != place[:-1]])[: len(place)], len(place)]
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        first = columns[0][lo:hi]
        yield int(place[lo]), kind, _packed(np.diff(first, prepend=np.uint64(0)), *(c[lo:hi] for c in columns[1:]))


def _opened(blob: bytes, *kinds) -> list[np.ndarray]:
    step, *rest = _unpacked(blob, np.uint64, *kinds)
    return [np.cumsum(step, dtype=np.uint64), *rest]


BLOBS = "place int, kind int, blob binary"


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    place, kind, blob = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["place", "kind", "blob"])


def _count_words(batches):
    tally, ends = _Tally(), 0

    def rows():
        keys, *_, n = tally.compact()
        tally.rows, tally.fresh = [], 0
        for lo in range(0, len(keys), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 200_000].view(np.int64)) for x in (keys, n)], ["key", "n"])

    for b in batches:
        ends += b.num_rows
        for _, values, _ in _pieces(b):
            words = values[values != EMPTY_HASH].view(np.uint64)
            tally.add(words, words, words)
            if tally.full():
                yield from rows()
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.int64()), pa.array([ends], pa.int64())], ["key", "n"])
    if tally.rows:
        yield from rows()


#: Kinds of blobs. PAIR: h, s, n of bigrams with a hot suffix; SUFFIX: s, h, n of the others, by suffix; WIDE: h, s, n, count of
#: s (0: s is hot); STATS: a history's c, sum of its suffixes' counts and numbers of its bigrams seen 1 to TRUSTED times;
#: HISTORY: a word's n, denominator and bow; HOT: as WIDE.
PAIR, SUFFIX, WIDE, STATS, HISTORY, HOT = range(1, 7)


def _count_pairs(hot: np.ndarray, ways: np.ndarray, buckets: int, order: int):
    def run(batches):
        tally = _Tally()

        def rows():
            _, h, s, n = tally.compact()
            tally.rows, tally.fresh = [], 0
            n = n.astype(np.uint64)
            cold = s >= len(ways)
            for kind, own in ((PAIR, ~cold), (SUFFIX, cold)):
                x, y, c = h[own], s[own], n[own]
                place = _place(x, y, ways, buckets) if kind == PAIR else _place(y, y, ways, buckets)
                x, y = (x, y) if kind == PAIR else (y, x)
                by = np.lexsort((y, x, place))
                for r in _blobs(place[by], kind, x[by], y[by], c[by]):
                    yield _batch([r])

        for b in batches:
            for _, values, offsets in _pieces(b):
                words, offsets = padded(values, offsets, order)
                h, s, _ = ngrams(coded(words, hot), offsets, 2, order)
                tally.add(joined(h, s), h, s)
                if tally.full():
                    yield from rows()
        if tally.rows:
            yield from rows()

    return run


def _summed(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of x and y, counts of equal ones added up."""
    by = np.lexsort((y, x))
    x, y, n = x[by], y[by], n[by]
    first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, dtype=np.int64)
    return x[first], y[first], np.add.reduceat(n, first) if len(first) else n


def _stats(h: np.ndarray, n: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """STATS of histories, sorted: rows come sorted by h."""
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return [h[first], np.add.reduceat(n, first), np.add.reduceat(low, first), *(np.add.reduceat((n == r).astype(np.uint64), first) for r in range(1, TRUSTED + 1))]


def _of(t: pa.Table, kind: int, columns: int, dtype=np.uint64) -> list[np.ndarray]:
    """The rows of a place's blobs of one kind."""
    kinds, blobs = t.column("kind").to_numpy(), t.column("blob")
    got = [_opened(blobs[int(i)].as_py(), *[dtype] * (columns - 1)) for i in np.flatnonzero(kinds == kind)]
    return [np.concatenate(x) for x in zip(*got, strict=True)] if got else [np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=dtype)] * (columns - 1)]


def _wide(place: int, h, s, n, ns) -> Iterator[tuple[int, int, bytes]]:
    for lo in range(0, len(h), ROWS):
        x = [c[lo : lo + ROWS] for c in (h, s, n, ns)]
        yield from _blobs(np.full(len(x[0]), place), WIDE, *x)


def _first_counts(counts: np.ndarray, ways: np.ndarray, buckets: int):
    """Of a place: its bigrams of hot suffixes counted (WIDE) and their histories' STATS; those of cold suffixes, which the place
    holds by suffix and so can count the suffix itself, sent on to their histories' places (PAIR of four columns)."""

    def run(t: pa.Table) -> pa.Table:
        place, out = t.column("place")[0].as_py(), []
        h, s, n = _summed(*_of(t, PAIR, 3))
        if len(h):
            st = _stats(h, n, counts[s])
            out += [*_wide(place, h, s, n, np.zeros(len(h), dtype=np.uint64)), *_blobs(np.full(len(st[0]), place), STATS, *st)]
        s, h, n = _summed(*_of(t, SUFFIX, 3))
        if len(s):
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            ns = np.repeat(np.add.reduceat(n, first), np.diff(np.r_[first, len(s)]))
            to = _place(h, s, ways, buckets)
            by = np.lexsort((s, h, to))
            out += _blobs(to[by], PAIR, h[by], s[by], n[by], ns[by])
        return pa.Table.from_batches([_batch(out)])

    return run


def _then_stats(least: float, hot: int):
    """Of a place: bigrams of cold suffixes (WIDE), and STATS of all its histories, hot ones apart (HOT), from what both parts give."""

    def run(t: pa.Table) -> pa.Table:
        place, out = t.column("place")[0].as_py(), []
        h, s, n, ns = _of(t, PAIR, 4)
        by = np.lexsort((s, h))
        h, s, n, ns = (x[by] for x in (h, s, n, ns))
        out += _wide(place, h, s, n, ns)
        st = _of(t, STATS, 3 + TRUSTED)
        if len(h):
            st = [np.concatenate(x) for x in zip(st, _stats(h, n, ns), strict=True)]
        if len(st[0]):
            by = np.argsort(st[0], kind="stable")
            st = [x[by] for x in st]
            first = np.flatnonzero(np.r_[True, st[0][1:] != st[0][:-1]])
            st = [st[0][first], *(np.add.reduceat(x, first) for x in st[1:])]
            few = st[0] < hot
            for kind, own in ((HOT, few), (STATS, ~few)):
                out += _blobs(np.full(own.sum(), place), kind, *(x[own] for x in st))
        return pa.Table.from_batches([_batch(out)])

    return run


def _unpack(kind: int, names: list[str], keep=None):
    """Rows of the blobs of one kind as columns of longs; keep: of the columns, which rows."""

    def run(batches):
        for b in batches:
            for k, blob in zip(b.column("kind").to_pylist(), b.column("blob"), strict=True):
                if k == kind:
                    cols = _opened(blob.as_py(), *[np.uint64] * (len(names) - 1))
                    own = slice(None) if keep is None else keep(*cols)
                    yield pa.RecordBatch.from_arrays([pa.array(c[own].view(np.int64)) for c in cols], names)

    return run


def _counts_of_counts(batches):
    total = np.zeros(TRUSTED + 2, dtype=np.int64)
    for b in batches:
        for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob"), strict=True):
            if kind == WIDE:
                n = _opened(blob.as_py(), *[np.uint64] * 3)[2]
                total += np.bincount(np.minimum(n, TRUSTED + 2).astype(np.int64), minlength=TRUSTED + 3)[: TRUSTED + 2]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(TRUSTED + 2)), pa.array(total)], ["r", "n"])


def discounts(of: dict[int, int], trusted: int = TRUSTED) -> list[float]:
    """Factors for counts 1..trusted from counts of counts, scaled so that what they free is Good and Turing's estimate.

    Where counts of counts are too thin for factors in (0, 1), all come from absolute discounting by n1 / (n1 + 2 n2).
    """
    n = [of.get(r, 0) for r in range(trusted + 2)]
    if all(n[1:]):
        a = (trusted + 1) * n[trusted + 1] / n[1]
        d = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if a < 1 else -1 for r in range(1, trusted + 1)]
        if all(0 < x < 1 for x in d):
            return d
    take = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return [(r - take) / r for r in range(1, trusted + 1)]


@dataclass
class Known:
    """What a level-2 model knows beside its tables, and what every task gets: discounts, and the hot words by code.

    words: their sorted hashes; n, c, bow: count, denominator and backoff weight of each code below FIRST + len(words);
    ways: into how many buckets a code's bigrams are dealt.
    """

    order: int
    buckets: int
    mass: float
    discounts: list[float]
    words: np.ndarray
    ways: np.ndarray
    n: np.ndarray
    c: np.ndarray
    bow: np.ndarray
    #: By level the keys and values of hot n-grams; FOUR's are backoff weights of bigrams.
    hot: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @property
    def unknown(self) -> float:
        return math.log(0.5 / self.mass)

    def logp(self, n: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(n, 0.5) / self.mass)


def weights(stats: list[np.ndarray], d: list[float], mass: float) -> tuple[np.ndarray, np.ndarray]:
    """Denominators and backoff weights (logs) of histories from their STATS without h."""
    c, seen, *of = (x.astype(np.float64) for x in stats)
    seen = seen / mass
    kept = c - sum((1 - d[r]) * (r + 1) * x for r, x in enumerate(of))
    every = seen >= 1 - 1e-9
    denominator = np.where(every, kept, np.where(kept < c * (1 - 1e-12), c, c + 1.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        bow = np.log((1 - kept / denominator) / (1 - seen))
    return denominator, np.where(every, 0.0, bow)


def _histories(d: list[float], mass: float):
    """STATS to HISTORY: key, n, denominator, bow (the latter two as the bits of doubles)."""

    def run(batches):
        for b in batches:
            rows = []
            for place, kind, blob in zip(b.column("place").to_pylist(), b.column("kind").to_pylist(), b.column("blob"), strict=True):
                if kind == STATS:
                    h, *st = _opened(blob.as_py(), *[np.uint64] * (2 + TRUSTED))
                    c, bow = weights(st, d, mass)
                    rows += _blobs(np.full(len(h), place), HISTORY, h, st[0], c.view(np.uint64), bow.view(np.uint64))
            yield _batch(rows)

    return run


def _cold_words(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, n, denominator, bow of a place's cold words."""
    key, n, c, bow = _of(t, HISTORY, 4)
    by = np.argsort(key, kind="stable")
    return key[by], n[by].astype(np.float64), c[by].view(np.float64), bow[by].view(np.float64)


def _bigrams(t: pa.Table, known: Known, words) -> tuple[np.ndarray, ...]:
    """h, s, n, log probability, delta of a place's bigrams. delta = logp(hs) - bow(h) - logp(s)."""
    h, s, n, ns = _of(t, WIDE, 4)
    return h, s, n, *_deltas(known, h, s, n, ns, words)


def _deltas(known: Known, h, s, n, ns, words) -> tuple[np.ndarray, np.ndarray]:
    key, _, cold_c, cold_bow = words
    few = h < len(known.c)
    at = np.where(few, h, 0).astype(np.int64)
    c, bow = known.c[at], known.bow[at]
    if len(key) and not few.all():
        i = np.searchsorted(key, h[~few])
        c[~few], bow[~few] = cold_c[i], cold_bow[i]
    low = known.logp(np.where(ns > 0, ns, known.n[np.where(ns > 0, 0, s).astype(np.int64)]).astype(np.float64))
    factor = np.array([1.0, *known.discounts, 1.0])[np.minimum(n, TRUSTED + 1).astype(np.int64)]
    logp = np.log(factor * n / c)
    return logp, logp - bow - low


class Model:
    """path: tables level=1 and level=2 of place (bucket) and blob (sorted columns, compressed), and level=3 of key, h, s, n, logp, delta.

    Level 1 has a cold word's key, n, denominator and bow (weight of the word as history), level 2 a bigram's h, s, n and
    the count of s if it is cold; hot words are in known. unknown: log probability of a word never seen; first_bow and
    start_bow: weights of START and of START twice, histories that are no n-grams themselves; total: number of tokens.
    rows() shows the model as rows with logp, bow and delta; vocabulary, logp, bow and table() show a small one by dense ids.
    """

    def __init__(self, spark: SparkSession, path: str, known: Known, total: int, start_bow: float = 0.0):
        self.spark, self.path, self.known, self.total, self.start_bow = spark, path, known, total, start_bow
        self.order, self.unknown, self.first_bow = known.order, known.unknown, float(known.bow[START])

    def blobs(self) -> DataFrame:
        one = self.spark.read.schema(BLOBS).parquet(f"{self.path}/level=1").select("place", "kind", "blob")
        two = self.spark.read.schema("place int, blob binary").parquet(f"{self.path}/level=2")
        return one.unionByName(two.select("place", F.lit(WIDE).alias("kind"), "blob"))

    def third(self) -> tuple[DataFrame, DataFrame]:
        """Trigrams, and the weights of bigrams as histories of such."""
        read = self.spark.read
        return read.schema("key long, h long, s long, n long, logp double, delta double").parquet(f"{self.path}/level=3"), read.schema("key long, c double, bow double").parquet(f"{self.path}/backoff")

    def rows(self) -> DataFrame:
        """level, key, h, s, n, logp, bow, delta: every word and n-gram, words by their codes."""
        known = self.known
        out = self.blobs().groupBy("place").applyInArrow(_rows(known), ROW)
        codes = np.r_[END, np.arange(FIRST, len(known.n))]
        logp = known.logp(known.n[codes])
        hot = pd.DataFrame({"level": 1, "key": codes, "h": 0, "s": codes, "n": known.n[codes].astype(np.int64), "logp": logp, "bow": known.bow[codes], "delta": logp})
        out = out.unionByName(self.spark.createDataFrame(hot[known.n[codes] > 0], ROW)) if (known.n[codes] > 0).any() else out
        if self.order < 3:
            return out
        three, back = self.third()
        out = out.drop("bow").join(back.select("key", F.lit(2).alias("level"), F.col("bow").alias("b")), ["key", "level"], "left").join(out.select("level", "key", F.col("bow").alias("own")), ["level", "key"]).withColumn("bow", F.coalesce("b", "own"))
        three = three.select(F.lit(3).alias("level"), "key", "h", "s", "n", "logp", F.lit(0.0).alias("bow"), "delta")
        return out.select(*three.columns).unionByName(three)

    @cached_property
    def _words(self) -> pd.DataFrame:
        w = self.rows().filter("level = 1").select("key", "logp", "bow").toPandas()
        w["code"] = w["key"]
        few = (w["key"] >= FIRST) & (w["key"] < len(self.known.n))
        w.loc[few, "key"] = self.known.words[w.loc[few, "key"].to_numpy() - FIRST]
        return w.set_index("key").sort_index()

    @property
    def vocabulary(self) -> np.ndarray:
        return self._words.index.drop(END, errors="ignore").to_numpy(dtype=np.int64)

    def _by_id(self, column: str, unknown: float, start: float) -> np.ndarray:
        own = self._words[column]
        return np.concatenate([[unknown, start, own.get(END, unknown)], own.drop(END, errors="ignore").to_numpy(dtype=float)])

    @property
    def logp(self) -> np.ndarray:
        return self._by_id("logp", self.unknown, -np.inf)

    @property
    def bow(self) -> np.ndarray:
        return self._by_id("bow", 0.0, self.first_bow)

    def table(self) -> DataFrame:
        """n-grams of two words and more by their words' ids, BITS bits each: at most 2 ** BITS words."""
        w = self._words.drop(END, errors="ignore")
        if len(w) + 3 > 1 << BITS:
            raise ValueError("too many words for ids of BITS bits; read rows()")
        ids = self.spark.createDataFrame(pd.DataFrame({"w": np.r_[[START, END], w["code"].to_numpy(dtype=np.int64)], "id": np.r_[[START, END], np.arange(len(w)) + 3]}), "w long, id long")
        rows = self.rows()
        two = rows.filter("level = 2").join(ids.select(F.col("w").alias("h"), F.col("id").alias("a")), "h").join(ids.select(F.col("w").alias("s"), F.col("id").alias("b")), "s")
        two = two.withColumn("packed", F.shiftleft("a", BITS).bitwiseOR(F.col("b")))
        out = two
        if self.order == 3:
            start = int(joined(*np.full((2, 1), START, dtype=np.uint64)).view(np.int64)[0])
            pairs = two.select("key", "packed").unionByName(self.spark.createDataFrame([(start, START << BITS | START)], "key long, packed long"))
            three = rows.filter("level = 3").join(pairs.select(F.col("key").alias("h"), F.col("packed").alias("a")), "h").join(pairs.select(F.col("key").alias("s"), F.col("packed").alias("b")), "s")
            out = two.unionByName(three.withColumn("packed", F.shiftleft("a", BITS).bitwiseOR(F.col("b").bitwiseAND(F.lit((1 << BITS) - 1)))))
        return out.select(F.col("packed").alias("key"), "n", "logp", "bow", "delta", "level")


ROW = "level int, key long, h long, s long, n long, logp double, bow double, delta double"


def _rows(known: Known):
    def run(t: pa.Table) -> pa.Table:
        key, n, c, bow = words = _cold_words(t)
        logp = known.logp(n)
        h, s, m, p, delta = _bigrams(t, known, words)
        parts_ = ((np.full(len(key), 1), key, np.zeros(len(key), dtype=np.uint64), key, n, logp, bow, logp), (np.full(len(h), 2), joined(h, s), h, s, m, p, np.zeros(len(h)), delta))
        cols = [np.concatenate(x) for x in zip(*parts_, strict=True)]
        types = [pa.int32(), *[pa.int64()] * 4, *[pa.float64()] * 3]
        values = [x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64) if i == 4 else x for i, x in enumerate(cols)]
        return pa.table({f.split()[0]: pa.array(x, k) for f, x, k in zip(ROW.split(", "), values, types, strict=True)})

    return run


def train(docs: DataFrame, text: str = "text", order: int = ORDER, bucket_tokens: int = BUCKET_TOKENS) -> Model:
    """Counts over the whole texts of all rows, up to order words; order is at most 3.

    P(w | h) = d(c) c(hw) / c(h) where hw was seen, else bow(h) P(w | h without its first word), with
    bow(h) = (1 - sum of the former) / (1 - sum of P(w | shorter h) over the same w). Where no mass is left to back off
    (all counts trusted), c(h) is taken one larger; where every word was seen after h, the seen ones are scaled to 1.
    Every word and n-gram is counted; UNKNOWN is what no text held, taken as seen half a time. Null and empty texts hold no
    word but END; an empty table gives a model of no n-grams, where all is UNKNOWN.

    A bigram is counted in the bucket of its history, whose words before it are then all there; its suffix's own count is
    at hand if the suffix is hot, and else counted on the way, where bigrams lie by suffix. Histories of many tokens are
    dealt to several buckets by the suffix.
    """
    if not 2 <= order <= 3:
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    h = docs.select(word_hashes(docs[text]).alias("h"))
    words = stored(h.mapInArrow(_count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    total, ends = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("key") == END, F.col("n"))), F.lit(0))).first()
    # every word but START could come: an unseen one (UNKNOWN, END) is taken as seen half a time
    mass = total + 0.5 + (0 if ends else 0.5)
    buckets, least = parts(total, bucket_tokens), max(2.0, HOT_SHARE * total)
    top = words.filter((F.col("n") >= least) & (F.col("key") != END)).toPandas().sort_values("key")
    dropped(words)
    n = np.r_[0, 0, ends, top["n"].to_numpy(dtype=np.int64)].astype(np.uint64)
    as_history = n.copy()
    as_history[[START, END]] = ends, 0
    ways = np.maximum(1, -(-as_history.astype(np.int64) // max(1, bucket_tokens // 4)))
    hot = top["key"].to_numpy(dtype=np.int64)
    pairs = h.mapInArrow(_count_pairs(hot, ways, buckets, order), BLOBS).groupBy("place").applyInArrow(_first_counts(n, ways, buckets), BLOBS)
    path = new_path(spark, "katz")
    keep = {"compression": "uncompressed"}  # blobs are compressed themselves
    pairs.write.options(**keep).partitionBy("kind").parquet(f"{path}/counted")
    counted = spark.read.schema(BLOBS).parquet(f"{path}/counted")
    second = counted.filter(F.col("kind") != WIDE).groupBy("place").applyInArrow(_then_stats(least, len(n)), BLOBS)
    second.write.options(**keep).partitionBy("kind").parquet(f"{path}/second")
    _moved(spark, f"{path}/counted/kind={WIDE}", f"{path}/level=2/part=hot")
    _moved(spark, f"{path}/second/kind={WIDE}", f"{path}/level=2/part=cold")
    _moved(spark, f"{path}/counted", None)
    if not _exists(spark, f"{path}/level=2"):
        spark.createDataFrame([], "place int, blob binary").write.parquet(f"{path}/level=2")
    level2 = spark.read.schema("place int, blob binary").parquet(f"{path}/level=2").select("place", F.lit(WIDE).alias("kind"), "blob")
    of = {r[0]: r[1] for r in level2.mapInArrow(_counts_of_counts, "r long, n long").groupBy("r").agg(F.sum("n")).collect()}
    d = discounts(of)
    stats = spark.read.schema(BLOBS).parquet(f"{path}/second")
    names = ["h", "c", "seen", *(f"k{r}" for r in range(1, TRUSTED + 1))]
    head = stats.filter(F.col("kind") == HOT).mapInArrow(_unpack(HOT, names), ", ".join(f"{x} long" for x in names)).groupBy("h").agg(*[F.sum(x).alias(x) for x in names[1:]]).toPandas()
    c, bow = np.ones(len(n)), np.zeros(len(n))
    at = head["h"].to_numpy(dtype=np.int64)
    c[at], bow[at] = weights([head[x].to_numpy() for x in names[1:]], d, mass)
    known = Known(order, buckets, mass, d, hot, ways, n.astype(np.float64), c, bow)
    first = stats.filter(F.col("kind") == STATS).mapInArrow(_histories(d, mass), BLOBS)
    first.write.options(**keep).parquet(f"{path}/level=1")
    _moved(spark, f"{path}/second", None)
    model = Model(spark, path, known, total)
    wide = level2.mapInArrow(_unpack(WIDE, ["h", "s", "n", "ns"], lambda h, s, n, ns: n >= least), "h long, s long, n long, ns long").toPandas().to_numpy(dtype=np.int64).astype(np.uint64)
    x, y, m, ns = wide.T
    known.hot[2] = _sorted(joined(x, y), _deltas(known, x, y, m, ns, (np.zeros(0, dtype=np.uint64),) * 4)[1])
    if order == 3:
        _third(model, h, d, least)
    released(spark)
    return model


def _sorted(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(key, kind="stable")
    return key[by], value[by]


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _files(spark, path)
    return fs.exists(p)


def _moved(spark: SparkSession, path: str, to: str | None) -> None:
    """Rename a folder of the model that is complete, or delete it."""
    p, fs = _files(spark, path)
    if not fs.exists(p):
        return
    if to is None:
        fs.delete(p, True)
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    fs.mkdirs(target.getParent())
    fs.rename(p, target)


def _count_trigrams(hot: np.ndarray):
    def run(batches):
        tally = _Tally()

        def rows():
            k, h, s, n = tally.compact()
            tally.rows, tally.fresh = [], 0
            for lo in range(0, len(k), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 200_000].view(np.int64)) for x in (k, h, s, n)], ["key", "h", "s", "n"])

        for b in batches:
            for _, values, offsets in _pieces(b):
                words, offsets = padded(values, offsets, 3)
                h, s, _ = ngrams(coded(words, hot), offsets, 3, 3)
                tally.add(joined(h, s), h, s)
                if tally.full():
                    yield from rows()
        if tally.rows:
            yield from rows()

    return run


def _third(model: Model, h: DataFrame, d2: list[float], least: float) -> None:
    """The third level as tables of rows: trigrams joined with the bigrams that are their suffixes and their histories."""
    spark, known = model.spark, model.known
    t = h.mapInArrow(_count_trigrams(known.words), "key long, h long, s long, n long").groupBy("key", "h", "s").agg(F.sum("n").alias("n"))
    t = stored(t, "trigrams")
    of = {r["n"]: r["count"] for r in t.filter(F.col("n") <= TRUSTED + 1).groupBy("n").count().collect()}
    d = discounts(of)
    factor = F.element_at(F.array(*[F.lit(x) for x in d]), F.least(F.col("n"), F.lit(TRUSTED)).cast("int"))
    low = model.blobs().groupBy("place").applyInArrow(_rows(known), ROW).filter("level = 2").select(F.col("key").alias("s"), F.exp("logp").alias("low"))
    j = stored(t.withColumn("d", F.when(F.col("n") <= TRUSTED, factor).otherwise(1.0)).join(low, "s"), "lower")
    s = j.groupBy("h").agg(F.sum("n").alias("c"), F.sum(F.col("d") * F.col("n")).alias("kept"), F.sum("low").alias("seen"))
    every = F.col("seen") >= 1 - 1e-9
    denominator = F.when(every, F.col("kept")).when(F.col("kept") < F.col("c") * (1 - 1e-12), F.col("c").cast("double")).otherwise(F.col("c") + 1.0)
    s = s.select(F.col("h").alias("key"), denominator.alias("c"), F.when(every, 0.0).otherwise(F.log((1 - F.col("kept") / denominator) / (1 - F.col("seen")))).alias("bow"))
    s.write.parquet(f"{model.path}/backoff")
    s = spark.read.schema("key long, c double, bow double").parquet(f"{model.path}/backoff")
    logp = F.log(F.col("d") * F.col("n") / F.col("c"))
    j.join(s.withColumnRenamed("key", "h"), "h").select("key", "h", "s", "n", logp.alias("logp"), (logp - F.col("bow") - F.log("low")).alias("delta")).write.parquet(f"{model.path}/level=3")
    dropped(t, j)
    start = int(joined(*np.full((2, 1), START, dtype=np.uint64)).view(np.int64)[0])
    own = s.filter(F.col("key") == start).first()
    model.start_bow = own["bow"] if own else 0.0
    three, back = model.third()
    for kind, table in ((3, three.filter(F.col("n") >= least).select("key", F.col("delta").alias("v"))), (4, back.filter(F.col("c") >= least).select("key", F.col("bow").alias("v")))):
        pdf = table.toPandas()
        known.hot[kind] = _sorted(pdf["key"].to_numpy(dtype=np.int64).view(np.uint64), pdf["v"].to_numpy(dtype=float))


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(b: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 8-byte values as byte planes, compressed: sorted keys and document numbers take a few bytes a row."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(_planes(c) for c in columns))


def _unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // len(kinds)
    return [_unplanes(raw[i * n : (i + 1) * n], k) for i, k in enumerate(kinds)]


def _key_place(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(key, 33) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


#: Kinds of blobs in scoring, beside the model's: sums of documents; keys and documents of words, bigrams, trigrams and bigrams as
#: histories; keys and values of the latter two (as many more).
SUMS, TOKENS, VALUES = 20, 20, 30


def _spread(start: float, known: Known):
    """Of each batch: sums of what the hot words and n-grams give, and the others' keys by place."""
    value = known.logp(known.n) + known.bow
    levels = range(1, 3) if known.order == 2 else range(1, 5)

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for own, values, offsets in _pieces(b):
                yield _batch(piece(ids[own], values, offsets))

    def piece(docs, values, offsets):
        words, offsets = padded(values, offsets, known.order)
        codes = coded(words, known.words)
        total, rows = np.full(len(docs), start), []
        for level in levels:
            h, s, row = ngrams(codes, offsets, 2 if level == 4 else level, known.order)
            if level == 1:
                count = np.bincount(row, minlength=len(docs)).astype(np.float64)
                key, hit = s, s < len(value)
                got = value[s[hit]]
            else:
                if level == 4:  # a bigram that ends a text is no history
                    h, s, row = (x[s != END] for x in (h, s, row))
                key = joined(h, s)
                keys, values = known.hot[level]
                at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                hit = keys[at] == key if len(keys) else np.zeros(len(key), dtype=bool)
                got = values[at[hit]]
            total += np.bincount(row[hit], got, minlength=len(docs))
            h, s, key, row = (x[~hit] for x in (h, s, key, row))
            place = _place(s, s, known.ways, known.buckets) if level == 1 else _place(h, s, known.ways, known.buckets) if level == 2 else _key_place(key, known.buckets)
            by = np.lexsort((key, place))
            rows += _blobs(place[by], TOKENS + level, key[by], docs[row[by]].view(np.uint64))
        rows.append((int(docs[0] % known.buckets), SUMS, _packed(docs, total, count)))
        return rows

    return run


def _sum_docs(docs, total, count):
    d, at = np.unique(docs, return_inverse=True)
    return d, np.bincount(at, total, minlength=len(d)), np.bincount(at, count, minlength=len(d))


def _lookup(known: Known):
    """Of a place: the documents' sums of what its words and n-grams give, split by bucket of documents."""

    def run(t: pa.Table) -> pa.Table:
        kinds, blobs = t.column("kind").to_numpy(), t.column("blob")
        words = _cold_words(t)
        tables = {1: (words[0], known.logp(words[1]) + words[3])}
        h, s, _, _, delta = _bigrams(t, known, words)
        tables[2] = _sorted(joined(h, s), delta)
        del h, s, delta
        for level in (3, 4):
            key, value = _of(t, VALUES + level, 2)
            tables[level] = _sorted(key, value.view(np.float64))
        docs, total, count = [], [], []
        for i in np.flatnonzero(kinds >= SUMS):
            level, blob = int(kinds[i]) - TOKENS, blobs[int(i)].as_py()
            if level == 0:
                d, v, c = _unpacked(blob, np.int64, np.float64, np.float64)
            elif level > 4:
                continue
            else:
                k, d = _opened(blob, np.int64)
                have, values = tables[level]
                absent = known.unknown if level == 1 else 0.0
                v, c = np.full(len(k), absent), np.zeros(len(k))
                if len(have):
                    at = np.minimum(np.searchsorted(have, k), len(have) - 1)
                    v = np.where(have[at] == k, values[at], absent)
                d, v, c = _sum_docs(d, v, c)
            docs.append(d), total.append(v), count.append(c)
        if not docs:
            return pa.Table.from_batches([_batch([])])
        d, v, c = _sum_docs(np.concatenate(docs), np.concatenate(total), np.concatenate(count))
        place = _key_place(d.view(np.uint64), known.buckets)
        by = np.argsort(place, kind="stable")
        place, d, v, c = place[by], d[by], v[by], c[by]
        cut = np.r_[np.flatnonzero(np.r_[True, place[1:] != place[:-1]]), len(d)]
        out = [(int(place[lo]), SUMS, _packed(d[lo:hi], v[lo:hi], c[lo:hi])) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
        return pa.Table.from_batches([_batch(out)])

    return run


SCORES = "doc_id long, n_tokens long, logprob double, perplexity double"


def _total(t: pa.Table) -> pa.Table:
    got = [_unpacked(b.as_py(), np.int64, np.float64, np.float64) for b in t.column("blob")]
    d, total, n = _sum_docs(*(np.concatenate(x) for x in zip(*got, strict=True)))
    return pa.table({"doc_id": d, "n_tokens": n.astype(np.int64), "logprob": total, "perplexity": np.exp(-total / n)})


def _values(kind: int, buckets: int):
    def run(batches):
        for b in batches:
            key, value = b.column("key").to_numpy().view(np.uint64), b.column("v").to_numpy().view(np.uint64)
            place = _key_place(key, buckets)
            by = np.lexsort((key, place))
            yield _batch(list(_blobs(place[by], VALUES + kind, key[by], value[by])))

    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens (words and END), logprob (natural), perplexity: each document under the model.

    log P(w | h) is logp(hw) if hw is stored, else bow(h) + log P(w | h without its first word), down to the words'
    own logp. With delta = logp(hw) - bow(h) - log P(w | shorter h), a token's recursion is the sum of the words' part, of
    bow of each history and of delta of each n-gram that is stored, and each part is looked up where its rows are: hot
    words and n-grams in every task, others in the bucket of their history.

    Rows with a null key are left out; keys must be whole numbers; rows of one key are one document, their tokens added up.
    Null and empty texts hold END alone. Very long texts count whole. An empty table gives an empty one. Other columns are
    not read.
    """
    known = model.known
    d = docs.select(record_key(docs, key).alias("doc_id"), word_hashes(docs[text]).alias("h")).filter("doc_id is not null")
    rows = d.mapInArrow(_spread(model.first_bow + model.start_bow, known), BLOBS).unionByName(model.blobs())
    if model.order == 3:
        for kind, table in zip((3, 4), (t.select("key", F.col(c).alias("v")) for t, c in zip(model.third(), ("delta", "bow"), strict=True)), strict=True):
            rows = rows.unionByName(table.mapInArrow(_values(kind, known.buckets), BLOBS))
    found = rows.groupBy("place").applyInArrow(_lookup(known), BLOBS)
    return found.groupBy("place").applyInArrow(_total, SCORES)


def perplexities(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Every document under a model trained on all of them."""
    return score(docs, train(docs, text, order), key, text)


def word_probability(logs: dict[tuple, float], bows: dict[tuple, float], history: tuple, word) -> float:
    """log P(word | history) by the recursion as it is defined, over plain dictionaries: what score() is tested against."""
    if (*history, word) in logs:
        return logs[(*history, word)]
    if not history:
        return -math.inf
    return bows.get(history, 0.0) + word_probability(logs, bows, history[1:], word)
