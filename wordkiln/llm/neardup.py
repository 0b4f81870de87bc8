"""SimHash near-duplicates: small-world graphs over Hamming distance per shard, forests of the pairs verified and unioned."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import EMPTY_HASH, WORD_EDGE, bounded, dropped, flat, free_name, mix, parts, record_key, runs, stored
from .components import components
from .graph import SmallWorld, hamming

#: Fingerprints are 128 bits over the set of words. Of pairs of Jaccard similarity 0.6 to 0.65 about 0.97 lie within 34 bits, of more similar ones all but a few.
RADIUS = 34
#: Edges hold when the word sets' Jaccard similarity reaches this.
SIMILARITY = 0.6
#: Most points of a graph; a shard of more is parted, and its queries go to all parts.
SHARD = 16_384
#: Two documents at SIMILARITY share at least one of their shards with this probability, however many documents there are.
SHARED = 0.988
#: Names of shards are as long as for so many times the documents: those of one language share their common words, so shards named by
#: two words fill with unrelated documents, and their pairs grow with the square (18.5 million over 0.1 GB, 449 million over 0.51 GB).
CROWD = 100
#: Shards up to this size are searched side by side in numpy, without a graph each.
SMALL = 48
#: Pairs held by a task before they are thinned to a forest, and edges of one component that are thinned together.
PAIRS = 2_000_000


def bands_of(n: int, similarity: float = SIMILARITY, shared: float = SHARED) -> tuple[int, int]:
    """(r, bands): a shard is named by r least word hashes, a document enters one shard a band.

    Two documents of similarity s share a band's shard with probability s ** r. r is 2 up to ten million documents and one
    more for each tenfold beyond, which keeps shards of unrelated documents small; the bands follow, so that the
    probability to share one of them stays what it was.
    """
    r = 2 + max(0, math.ceil(math.log10(max(n, 1) / 1e7)))
    return r, max(1, math.ceil(math.log(1 - shared) / math.log(1 - similarity**r)))


def names_of(n: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """(r, bands) for n documents: bands_of() CROWD times as many. Longer names come with more bands, so no chance is lost."""
    return bands_of(CROWD * n, similarity)


def simhash(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[rows, 2] uint64: of each row's token hashes, the majority of each of 128 bits (ties: 0).

    Bits are added eight to a uint64 word as bytes, in runs of at most 255 tokens, so no token is visited bit by bit.
    """
    n = len(offsets) - 1
    out = np.zeros((n, 2), dtype=np.uint64)
    lengths = np.diff(offsets)
    v = values.view(np.uint64)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 400_000, side="right")) - 1)
        lo, hi = offsets[at], offsets[end]
        if hi > lo:
            bits = np.stack([mix(v[lo:hi], 1), mix(v[lo:hi], 2)], axis=1)
            lanes = np.unpackbits(bits.view(np.uint8), axis=1).view(np.uint64)
            rows = np.repeat(np.arange(end - at), lengths[at:end])
            place = np.arange(hi - lo) - np.repeat(offsets[at:end] - lo, lengths[at:end])
            cut = np.flatnonzero(place % 255 == 0)
            sums = np.add.reduceat(lanes, cut, axis=0).view(np.uint8).astype(np.int32)
            owner = rows[cut]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            ones = np.add.reduceat(sums, first, axis=0)
            got = owner[first]
            out[at + got] = np.packbits(2 * ones > lengths[at:end][got][:, None], axis=1).view(np.uint64)
        at = end
    return out


def least_hashes(values: np.ndarray, offsets: np.ndarray, r: int, bands: int) -> np.ndarray:
    """[rows, bands] int64: each band's name, made of the row's least words under r hash functions; rows without words get 0."""
    out = np.zeros((len(offsets) - 1, bands), dtype=np.uint64)
    odd = mix(np.arange(2 * r * bands, dtype=np.uint64), 100) | np.uint64(1)
    some = np.flatnonzero(np.diff(offsets))
    starts, at = offsets[some], 0
    while at < len(some):
        end = max(at + 1, int(np.searchsorted(offsets[some], starts[at] + 400_000)))
        v = values[starts[at] : offsets[some[end - 1] + 1]].view(np.uint64)
        for b in range(bands):
            name = np.full(end - at, b + 1, dtype=np.uint64)
            for k in range(b * r, b * r + r):
                x = v * odd[2 * k]
                x ^= x >> np.uint64(32)
                x *= odd[2 * k + 1]
                name = mix(name ^ np.minimum.reduceat(x, starts[at:end] - starts[at]), 3)
            out[some[at:end], b] = name
        at = end
    return out.view(np.int64)


def _prints(r: int, bands: int):
    def run(batches):
        for b in batches:
            values, offsets = flat(b.column("h"))
            if (drop := values == EMPTY_HASH).any():
                kept = np.concatenate([[0], np.cumsum(~drop)])
                values, offsets = values[~drop], kept[offsets]
            values = np.ascontiguousarray(values)
            f = simhash(values, offsets).view(np.int64)
            names = pa.array(least_hashes(values, offsets, r, bands).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(f) * bands + 1, bands, dtype=np.int32)), names)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("k0"), b.column("k1"), pa.array(np.diff(offsets)), pa.array(f[:, 0]), pa.array(f[:, 1]), lists],
                ["id", "k0", "k1", "n", "f0", "f1", "shards"],
            )

    return run


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WORD_EDGE, " "))


def _word_set(plain: Column) -> Column:
    return F.array_distinct(F.transform(F.split(plain, " "), lambda w: F.xxhash64(w)))


def fingerprints(docs: DataFrame, key: str, text: str, r: int, bands: int) -> DataFrame:
    """id, k0 and k1 (128-bit hash of the text as words in lower case), n (distinct words), f0 and f1 (the SimHash), shards."""
    d = docs.select(record_key(docs, key).alias("id"), _plain(docs[text]).alias("t")).filter("id is not null")
    d = d.select("id", F.xxhash64("t").alias("k0"), F.xxhash64(F.lit(1), F.col("t")).alias("k1"), _word_set(F.col("t")).alias("h"))
    return d.mapInArrow(_prints(r, bands), "id long, k0 long, k1 long, n long, f0 long, f1 long, shards array<long>")


def dealt(reps: DataFrame, shard: int = SHARD) -> DataFrame:
    """shard, own, home, id, f0, f1, label: each document in its shards; rows of one shard stand together in a task.

    A shard of more than `shard` documents is parted into blocks by a hash of the fingerprint, and each block meets each
    other block and itself: a row goes to as many tasks as its shard has blocks, and no task holds more than two blocks.
    """
    e = reps.select("id", "f0", "f1", "label", F.explode("shards").alias("shard"))
    hot = stored(e.groupBy("shard").count().filter(F.col("count") > shard).select("shard", F.ceil(F.col("count") / shard).cast("int").alias("blocks")), "hot")
    entries = reps.count() * len(reps.select("shards").first()[0])
    if hot.limit(1).count():
        e = e.join(bounded(hot, 16), "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        e = e.withColumn("home", F.pmod(F.xxhash64("f0", "f1", F.lit(17)), F.col("blocks")).cast("int"))
        e = e.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        name = F.when(F.col("blocks") == 1, F.col("shard")).otherwise(F.xxhash64("shard", F.least("home", "other"), F.greatest("home", "other")))
        e = e.select(name.alias("shard"), (F.col("home") == F.col("other")).alias("own"), "home", "id", "f0", "f1", "label")
    else:
        e = e.select("shard", F.lit(True).alias("own"), F.lit(0).alias("home"), "id", "f0", "f1", "label")
    # by rows, not by bytes: a shard's rows are few bytes but much work
    return e.repartition(parts(entries, 100_000, 12), "shard").sortWithinPartitions("shard", "id")


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def spanning(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs (of 0..n-1) make a minimum spanning forest."""
    parent, keep = np.arange(n), []
    for level in np.unique(d):
        at = np.flatnonzero(d == level)
        x, y = parent[a[at]], parent[b[at]]
        at, x, y = (v[x != y] for v in (at, x, y))
        _, first = np.unique(np.minimum(x, y) * n + np.maximum(x, y), return_index=True)
        for i, p, q in zip(at[first].tolist(), x[first].tolist(), y[first].tolist(), strict=True):
            p, q = _find(parent, p), _find(parent, q)
            if p != q:
                parent[p] = q
                keep.append(i)
        while (parent != (up := parent[parent])).any():
            parent = up
    return np.array(keep, dtype=np.int64)


EDGES = "a long, b long, distance long"


def _edges(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    cols = np.minimum(a, b), np.maximum(a, b), d.astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "distance"])


def _small(points: np.ndarray, run: np.ndarray, radius: int):
    """Pairs of rows of one run, run by run side by side: rows are compared with the next one, the one after it and so on."""
    for lag in range(1, len(run)):
        at = np.flatnonzero(run[:-lag] == run[lag:])
        if not len(at):
            return
        d = hamming(points[at], points[at + lag])
        near = d <= radius
        yield at[near], at[near] + lag, d[near]


def _large(points: np.ndarray, home: np.ndarray, own: bool, radius: int):
    """Pairs of rows of one shard: searches in the graph of a block, by itself (own) or by the other block's rows."""
    if own:
        f, first, inverse = np.unique(points, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(inverse.ravel(), kind="stable")
        same = np.flatnonzero(np.diff(inverse.ravel()[order]) == 0)
        yield order[same], order[same + 1], np.zeros(len(same), dtype=np.int64)
        for q, p, d in SmallWorld(f).pieces(f, radius):
            up = q < p
            yield first[q[up]], first[p[up]], d[up]
        return
    sides = [np.flatnonzero(home == h) for h in np.unique(home)]
    if len(sides) == 2:
        at = np.unique(points[sides[0]], axis=0, return_index=True)[1]
        for q, p, d in SmallWorld(points[sides[0]][at]).pieces(points[sides[1]], radius):
            yield sides[1][q], sides[0][at[p]], d


def _pairs(t: pa.Table, radius: int):
    """(rows, rows, distances) of the pairs found in the shards of t, piece by piece."""
    points = np.stack([t.column(c).to_numpy().view(np.uint64) for c in ("f0", "f1")], axis=1)
    shard, home, own = (t.column(c).to_numpy() for c in ("shard", "home", "own"))
    start = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    size = np.diff(np.r_[start, len(shard)])
    run = np.repeat(np.arange(len(start)), size)
    small = (size[run] <= SMALL) & own
    at = np.flatnonzero(small)
    for x, y, d in _small(points[at], run[at], radius):
        yield at[x], at[y], d
    for s, n in zip(start[~small[start]], size[~small[start]], strict=True):
        for x, y, d in _large(points[s : s + n], home[s : s + n], bool(own[s]), radius):
            yield x + s, y + s, d


def _forest(radius: int):
    """Of the pairs of each shard, those of a minimum spanning forest: if all of them hold, so does every group."""

    def run(batches):
        for t in runs(batches, "shard"):
            ids, held, size = t.column("id").to_numpy(), [np.zeros((3, 0), dtype=np.int64)], 0

            def thin(held):
                h = np.concatenate(held, axis=1)
                return [h[:, spanning(*h, len(ids))]]  # noqa: B023

            for x, y, d in _pairs(t, radius):
                held.append(np.stack([x, y, d]))
                size += len(x)
                if size > PAIRS:
                    held, size = thin(held), 0
            x, y, d = thin(held)[0]
            yield _edges(ids[x], ids[y], d)

    return run


def _crossing(radius: int):
    """All pairs of each shard between different labels, whatever their number."""

    def run(batches):
        for t in runs(batches, "shard"):
            ids, label = t.column("id").to_numpy(), t.column("label").to_numpy()
            for x, y, d in _pairs(t, radius):
                ok = label[x] != label[y]
                yield _edges(ids[x[ok]], ids[y[ok]], d[ok])

    return run


def candidates(reps: DataFrame, radius: int, shard: int = SHARD, crossing: bool = False) -> DataFrame:
    """a < b, distance: the pairs found within the radius; a spanning forest of each shard's, or all that cross labels."""
    found = dealt(reps, shard).mapInArrow((_crossing if crossing else _forest)(radius), EDGES)
    return found.groupBy("a", "b").agg(F.min("distance").alias("distance"))


def _thinned(batches):
    for t in runs(batches, "part"):
        a, b, d = (t.column(c).to_numpy() for c in ("a", "b", "distance"))
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        keep = spanning(at[: len(a)], at[len(a) :], d, len(names))
        yield _edges(a[keep], b[keep], d[keep])


def forest(edges: DataFrame, whole: DataFrame, most: int = PAIRS) -> DataFrame:
    """Edges without those that a cycle of nearer ones makes needless. whole: their components.

    A component's edges are thinned in one task, or in parts of about `most` by a hash if there are more: what a part
    drops no forest needs, so its edges, and then the rest, still connect what they did.
    """
    named = edges.join(whole.withColumnRenamed("id", "a"), "a")
    large = stored(named.groupBy("group_id").count().filter(F.col("count") > most), "large")
    part = F.xxhash64("group_id")
    if large.limit(1).count():
        named = named.join(bounded(large, 16), "group_id", "left")
        part = F.xxhash64("group_id", F.pmod(F.xxhash64("a", "b"), F.ceil(F.coalesce("count", F.lit(1)) / most)))
    named = named.select(part.alias("part"), "a", "b", "distance")
    return named.repartition("part").sortWithinPartitions("part").mapInArrow(_thinned, EDGES)


def verified(docs: DataFrame, edges: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """edges with holds: whether the word sets' Jaccard similarity reaches least. Only the edges' texts are tokenised."""
    ends = stored(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")
    d = docs.select(record_key(docs, key).alias("id"), docs[text].alias("t")).join(bounded(ends, 40), "id", "left_semi")
    d = d.select("id", _word_set(_plain(F.col("t"))).alias("w")).groupBy("id").agg(F.first("w").alias("w"))
    both = edges.join(d.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(d.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    both = both.withColumn("similarity", shared / (F.size("wa") + F.size("wb") - shared))
    return both.select("a", "b", "distance", "similarity", (F.col("similarity") >= least).alias("holds"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY, shard: int = SHARD) -> DataFrame:
    """id, group_id (the smallest id of its group), kept (whether it is that one): one row a document.

    Texts equal as words in lower case are one group; one document of each such text is compared with those of its
    shards, and pairs within the radius whose word sets agree are unioned. Documents without a word (null, empty)
    are compared with none and stay. Rows with a null key are left out; keys must be whole numbers. Rows of one key are
    one document. Very long texts are read whole. An empty table gives an empty one. Other columns are not read.
    """
    prints = stored(fingerprints(docs, key, text, *names_of(docs.count(), similarity)), "prints")
    same = prints.filter("n > 0").groupBy("k0", "k1").agg(F.min("id").alias("rep"))
    # one row a text on the right: where copies make a key hot, the left side is split by adaptive execution
    named = prints.select("id", "k0", "k1", "n").join(same, ["k0", "k1"], "left").select("id", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id")).alias("rep"), "n")
    named = stored(named, "named")
    firsts = named.filter("n > 0 and rep = id").select("id").distinct()
    reps = stored(prints.join(firsts, "id", "left_semi").dropDuplicates(["id"]).select("id", "f0", "f1", F.col("id").alias("label"), "shards"), "reps")
    if reps.limit(1).count() == 0:
        return named.select("id", F.col("rep").alias("group_id"), (F.col("id") == F.col("rep")).alias("kept")).distinct()
    found = stored(candidates(reps, radius, shard), "found")
    whole = stored(components(found.select("a", "b")), "whole")
    edges = stored(forest(found, whole), "forest")
    first = stored(verified(docs, edges, key, text, similarity), "first")
    good, bad = first.filter("holds"), first.filter("not holds")
    labels = components(good.select("a", "b"))
    if bad.limit(1).count():
        broken = bad.select(F.explode(F.array("a", "b")).alias("id")).join(whole, "id").select("group_id").distinct()
        members = whole.join(broken, "group_id", "left_semi").select("id")
        labelled = members.join(labels, "id", "left").select("id", F.coalesce("group_id", "id").alias("label"))
        again = stored(reps.drop("label").join(labelled, "id"), "again")
        more = stored(candidates(again, radius, shard, crossing=True).join(first.select("a", "b"), ["a", "b"], "left_anti"), "more")
        second = stored(verified(docs, more, key, text, similarity), "second")
        labels = components(good.select("a", "b").unionByName(second.filter("holds").select("a", "b")))
        dropped(again, more)
    dropped(prints, reps, found, edges)
    out = named.select("id", "rep").distinct().join(labels.select(F.col("id").alias("rep"), "group_id"), "rep", "left")
    return out.select("id", F.coalesce("group_id", "rep").alias("group_id")).withColumn("kept", F.col("id") == F.col("group_id"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, with all columns whatever their names, without the documents that near_duplicates() doesn't keep.

    Rows with a null key stay, and so do documents without a word. Rows of one key are one document and stay or go
    together. Very long texts are read whole. An empty table gives an empty one.
    """
    gone = free_name(docs.columns, "_gone")
    out = near_duplicates(docs, key, text).filter(~F.col("kept")).select(F.col("id").alias(gone)).distinct()
    return docs.join(out, docs[key] == out[gone], "left_anti")


def audit(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY, queries: int = 256, shard: int = SHARD) -> dict:
    """Recall of the candidates against exact search: of some queries (a bound on the audit alone), all documents whose word sets
    reach the similarity ("exact"), and those of them within the radius ("near"), and the parts of each that are candidates.

    Exact search holds the queries' word sets against those of every document, in all partitions.
    """
    prints = stored(fingerprints(docs, key, text, *names_of(docs.count(), similarity)).filter("n > 0").dropDuplicates(["k0", "k1"]), "audit")
    reps = prints.select("id", "f0", "f1", F.col("id").alias("label"), "shards")
    sets = docs.select(record_key(docs, key).alias("id"), _word_set(_plain(docs[text])).alias("h")).join(reps.select("id", "f0", "f1"), "id").dropDuplicates(["id"])
    asked = sets.orderBy(F.xxhash64("id", F.lit(3))).limit(queries).toPandas()
    qid, q = asked["id"].to_numpy(), asked[["f0", "f1"]].to_numpy().view(np.uint64)
    length = asked["h"].map(len).to_numpy()
    vocabulary = np.unique(np.concatenate(asked["h"].to_list())) if len(asked) else np.zeros(0, dtype=np.int64)
    has = np.zeros((len(vocabulary) + 1, len(qid)), dtype=np.uint8)
    for i, h in enumerate(asked["h"]):
        has[np.searchsorted(vocabulary, np.asarray(h)), i] = 1

    def exact(batches):
        for b in batches:
            values, offsets = flat(b.column("h"))
            ids, f = b.column("id").to_numpy(), np.stack([b.column(c).to_numpy().view(np.uint64) for c in ("f0", "f1")], axis=1)
            for i in range(len(ids)):
                v = values[offsets[i] : offsets[i + 1]]
                at = np.minimum(np.searchsorted(vocabulary, v), len(vocabulary) - 1)
                shared = has[at[vocabulary[at] == v]].sum(axis=0, dtype=np.int64)
                hit = np.flatnonzero((shared >= similarity * (len(v) + length - shared)) & (qid != ids[i]))
                d = hamming(q[hit], f[i])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], qid[hit])), pa.array(np.maximum(ids[i], qid[hit])), pa.array(d)], ["a", "b", "distance"])

    truth = stored(sets.mapInArrow(exact, EDGES).distinct(), "truth")
    pairs = stored(candidates(reps, radius, shard, crossing=True), "pairs")
    got = truth.join(pairs.select("a", "b"), ["a", "b"], "left_semi")
    near, wanted = truth.filter(F.col("distance") <= radius).count(), truth.count()
    found = got.count()
    dropped(prints, truth, pairs)
    return {"queries": len(qid), "exact": wanted, "near": near, "found": found, "recall": found / wanted if wanted else 1.0, "recall_near": found / near if near else 1.0}
