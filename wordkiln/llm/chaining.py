"""Fuzzy repeated passages: shared k-mer seeds, collinear chains through a Fenwick tree, aligned."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, fits, flat, free_name, mix, record_key, released, runs, stored

K = 4
#: Of every WINDOW k-mers in a row at least the least by hash is a seed, in whatever document they stand.
WINDOW = 4
#: Words in a row that must be covered; an edge is found to the word unless words beside it differ, hence less than 50.
MIN_WORDS = 40
#: Words known on either side of a seed: from the last seed of a passage to its end are WINDOW - 1 at most, an edit there looks at four more.
BESIDE = 7
MAX_GAP = 24
GAP_COST = 0.2
REACH = 24
IDENTITY = 0.7
#: Words of both documents that alignment passes as an edit, if the two words after them agree.
EDITS = ((1, 1), (0, 1), (1, 0), (2, 2), (0, 2), (2, 0), (1, 2), (2, 1), (3, 3))
#: A seed that makes up this share of all (so at most 100,000 do) is hot; a batch that holds it is known by FREQUENT of them.
HOT_SHARE = 1e-5
FREQUENT = 8
SPREAD = 1024
#: Words whose seeds are made at a time; a longer text is taken whole.
PIECE = 200_000
#: Chains of one document, its own and those others have with it, that are joined with its words in one task.
CHAINS_A_TASK = 10_000
_PUNCTUATION = ".,!?;:()[]\"'«»—–-…|*"
_SPACE = r"(?U)\s+"


def words(text: Column) -> Column:
    """Words between white space, as they are; null and blank give []."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def _plain(word: Column) -> Column:
    return F.lower(F.btrim(word, F.lit(_PUNCTUATION)))


def word_codes(text: Column) -> Column:
    """array<long>, one a word: hash of it in lower case without punctuation at its edges."""
    return F.transform(words(text), lambda w: F.xxhash64(_plain(w)))


def short_codes(text: Column) -> Column:
    """array<int>, as word_codes(): enough to compare the words of two documents with each other."""
    return F.transform(words(text), lambda w: F.hash(_plain(w)))


def seeds_of(values: np.ndarray, offsets: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, k-mer's hash) of the minimisers. Of neighbouring equal k-mers (one word again and again) the first."""
    n = len(values)
    if n < k:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z.view(np.uint64)
    v = values.view(np.uint64)
    h = mix(v[: n - k + 1], 0)
    for j in range(1, k):
        h = mix(h ^ v[j : n - k + 1 + j], j)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    valid = row[: n - k + 1] == row[k - 1 :]
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    h = np.where(valid, h, top)
    padded = np.concatenate([np.full(window - 1, top), h, np.full(window - 1, top)])
    least = padded.copy()
    step = 1
    while step < window:
        least[:-step] = np.minimum(least[:-step], least[step:])
        step *= 2
    chosen = np.zeros(len(h), dtype=bool)
    for j in range(window):
        chosen |= least[j : j + len(h)] == h
    chosen &= valid
    chosen[1:] &= (h[1:] != h[:-1]) | (row[1 : len(h)] != row[: len(h) - 1])
    at = np.flatnonzero(chosen)
    return row[at], at - offsets[row[at]], h[at]


def _seeds(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """seeds_of() the batch, some rows at a time: it holds many arrays as long as the words it is given."""
    values, offsets = flat(b.column("w"))
    out, at, n = [], 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        row, pos, h = seeds_of(np.ascontiguousarray(values[offsets[at] : offsets[end]]), offsets[at : end + 1] - offsets[at])
        out.append((row + at, pos, h))
        at = end
    z = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (z, z, z.view(np.uint64))


def _beside(values: np.ndarray, offsets: np.ndarray, row: np.ndarray, pos: np.ndarray, k: int = K) -> np.ndarray:
    """Four bits of each of the BESIDE words before a seed (the low half) and after it, nearest first; 0 beyond the text."""
    code, at, out = (values & 15).astype(np.uint8), offsets[row] + pos, np.zeros(len(row), dtype=np.int64)
    for j in range(BESIDE):
        for place, inside, shift in ((at - 1 - j, at - 1 - j >= offsets[row], 4 * j), (at + k + j, at + k + j < offsets[row + 1], 4 * (BESIDE + j))):
            out[inside] |= code[place[inside]].astype(np.int64) << shift
    return out


def _extends(beside: np.ndarray, rbeside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that _extend() passes at most to the left, and to the right, of seeds in two documents. Never fewer than it does; -1: unknown.

    They are those that agree up to the first that doesn't, if the words known allow no edit there; else REACH.
    """
    out = []
    for shift in (0, 4 * BESIDE):
        x, y = ([(v >> (shift + 4 * j)) & 15 for j in range(BESIDE)] for v in (beside, rbeside))
        most, going = np.full(len(beside), REACH), (beside >= 0) & (rbeside >= 0)
        for m in range(BESIDE):
            may = x[m] == y[m]
            edit, aside = np.zeros((2, len(beside)), dtype=bool)
            for p, q in EDITS:
                some = np.logical_and.reduce([x[m + p + i] == y[m + q + i] for i in (0, 1) if m + max(p, q) + i < BESIDE] or [np.ones(len(beside), dtype=bool)])
                edit |= some
                aside |= some & (p != q)  # counts even where the words agree, since they may do so in these bits alone
            most[going & ~may & ~edit] = m
            going &= may & ~aside
        out.append(most)
    return out[0], out[1]


def _emit_seeds(batches):
    for b in batches:
        row, pos, h = _seeds(b)
        beside = _beside(*flat(b.column("w")), row, pos)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("id").take(pa.array(row)), pa.array(pos.astype(np.int32)), pa.array(beside)], ["h", "id", "pos", "beside"])


def _frequent(least: int):
    """Of each batch the seeds it holds at least `least` times, with their first occurrence in it, what is beside it and their number; and all seeds' number (h null)."""

    def run(batches):
        for b in batches:
            row, pos, h = _seeds(b)
            u, count = np.unique(h, return_counts=True)
            u = u[count >= least]
            at = np.flatnonzero(np.isin(h, u))
            ids = b.column("id").to_numpy()[row[at]]
            s = np.lexsort((pos[at], ids, h[at]))
            first = s[np.flatnonzero(np.r_[True, h[at][s][1:] != h[at][s][:-1]])] if len(s) else s
            beside = _beside(*flat(b.column("w")), row[at][first], pos[at][first])
            cols = [pa.array([*h[at][first].view(np.int64).tolist(), None], pa.int64()), pa.array([*ids[first].tolist(), None], pa.int64()), pa.array([*pos[at][first].tolist(), None], pa.int32()), pa.array([*beside.tolist(), None], pa.int64()), pa.array([*count[count >= least].tolist(), len(h)], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["h", "hid", "hpos", "hbeside", "n"])

    return run


def hot_seeds(coded: DataFrame, share: float = HOT_SHARE, least: int = FREQUENT) -> DataFrame:
    """h, hid, hpos, hbeside (_beside()): seeds of at least that share of all, with an occurrence that but few others come before.

    Counted are the batches that hold a seed `least` times; so a seed of this share is found unless it is spread thin, and
    then no task is too large for it. At most 1 / share rows.
    """
    t = coded.mapInArrow(_frequent(least), "h long, hid long, hpos int, hbeside long, n long")
    t = stored(t.groupBy("h").agg(F.min(F.struct("hid", "hpos", "hbeside")).alias("first"), F.sum("n").alias("n")), "frequent")
    total = t.filter("h is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return t.filter(F.col("h").isNotNull() & (F.col("n") >= max(share * total, least))).select("h", "first.hid", "first.hpos", "first.hbeside")


def links(docs: DataFrame, key: str, text: str, share: float = HOT_SHARE) -> DataFrame:
    """id, pos, ref, rpos, beside, rbeside (_beside()): for each seed an early occurrence in an earlier document, the first but for hot seeds.

    One link an occurrence, so a passage of thousands of documents costs as many links, not their square. It loses
    nothing: every seed of a passage that was there before has such a link, and what is found is a run of words covered.
    Occurrences of a hot seed beyond the one hot_seeds() gives link to that and are spread over tasks; the few before it are
    linked as those of other seeds.
    """
    coded = docs.select(record_key(docs, key).alias("id"), word_codes(docs[text]).alias("w")).filter("id is not null")
    s = coded.mapInArrow(_emit_seeds, "h long, id long, pos int, beside long")
    hot = hot_seeds(coded, share)
    some = hot.limit(1).count() > 0
    if some:
        s = s.join(bounded(hot.select("h", "hid"), 32), "h", "left")
        s = s.withColumn("part", F.when(F.col("id") > F.col("hid"), 1 + F.pmod(F.xxhash64("id"), F.lit(SPREAD))).otherwise(0)).drop("hid")
    else:
        s = s.withColumn("part", F.lit(0))
    w = Window.partitionBy("h", "part").orderBy("id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.select("h", "part", "id", "pos", F.first("id").over(w).alias("ref"), F.first("pos").over(w).alias("rpos"), "beside", F.first("beside").over(w).alias("rbeside")).filter("part > 0 or ref <> id")
    if some:  # joined again behind the shuffle, which so carries none of its columns
        s, far = s.join(bounded(hot, 48), "h", "left"), F.col("part") > 0
        s = s.select("id", "pos", "beside", *[F.when(far, F.col(x)).otherwise(F.col(c)).alias(c) for c, x in (("ref", "hid"), ("rpos", "hpos"), ("rbeside", "hbeside"))])
    return s.select("id", "pos", "ref", "rpos", "beside", "rbeside")


def anchors_of(key: np.ndarray, pos: np.ndarray, rpos: np.ndarray, left: np.ndarray, right: np.ndarray, k: int = K, gap: int = MAX_GAP):
    """Runs of links on one diagonal: (key, start, end, ref start, ref end, left of the first, right of the last); key numbers the pair of documents."""
    diagonal = rpos - pos
    s = np.lexsort((pos, diagonal, key))
    key, pos, rpos, diagonal = key[s], pos[s], rpos[s], diagonal[s]
    new = np.r_[True, (key[1:] != key[:-1]) | (diagonal[1:] != diagonal[:-1]) | (pos[1:] - pos[:-1] > gap)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(key)] - 1
    return key[first], pos[first], pos[last] + k, rpos[first], rpos[last] + k, left[s][first], right[s][last]


def long_runs(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, min_words: int) -> np.ndarray:
    """Which intervals (lo to hi, of one document each) lie in runs, joined as aligned chains are, of at least min_words."""
    if not len(ids):
        return np.zeros(0, dtype=bool)
    s = np.lexsort((lo, ids))
    doc = np.cumsum(np.r_[0, ids[s][1:] != ids[s][:-1]])
    far = np.maximum.accumulate(hi[s] + (doc << 32)) - (doc << 32)
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (lo[s][1:] - far[:-1] > 3)])
    last = np.r_[first[1:], len(s)] - 1
    keep = np.zeros(len(s), dtype=bool)
    keep[s] = np.repeat(far[last] - lo[s][first] >= min_words, last - first + 1)
    return keep


def chains_of(start, end, rstart, rend, cost: float = GAP_COST) -> list[list[int]]:
    """Best collinear chains of one pair's anchors, each anchor in one chain.

    An anchor's score is its length plus the best score before it less cost for each word of the gap, in both documents.
    Anchors are visited by start, entered once a start lies beyond their end, and a Fenwick tree over the ends in the
    other document holds the largest score plus cost * (both ends) of each prefix: O(n log n).
    """
    n = len(start)
    if n == 1:
        return [[0]]
    ends = sorted(set(rend))
    rank = {e: i + 1 for i, e in enumerate(ends)}
    size = len(ends)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    by_start, by_end = sorted(range(n), key=lambda i: (start[i], rstart[i])), sorted(range(n), key=lambda i: end[i])
    entered = 0
    for i in by_start:
        while entered < n and end[by_end[entered]] <= start[i]:
            j = by_end[entered]
            value, x = (score[j] + cost * (end[j] + rend[j]), j), rank[rend[j]]
            while x <= size:
                if value > tree[x]:
                    tree[x] = value
                x += x & -x
            entered += 1
        best, x = (-1e18, -1), bisect_right(ends, rstart[i])
        while x:
            if tree[x] > best:
                best = tree[x]
            x -= x & -x
        gain = best[0] - cost * (start[i] + rstart[i])
        score[i] = end[i] - start[i]
        if gain > 0:
            score[i], back[i] = score[i] + gain, best[1]
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


CHAINS = "id long, ref long, start int, end int, rstart int, rend int, anchors array<int>"


def _chain(min_words: int):
    def run(batches):
        for t in runs(batches, "id"):
            ids, ref, pos, rpos, beside, rbeside = (t.column(c).to_numpy().astype(np.int64) for c in ("id", "ref", "pos", "rpos", "beside", "rbeside"))
            order = np.lexsort((ref, ids))
            ids, ref, pos, rpos = ids[order], ref[order], pos[order], rpos[order]
            left, right = _extends(beside[order], rbeside[order])
            key = np.cumsum(np.r_[False, (ids[1:] != ids[:-1]) | (ref[1:] != ref[:-1])])
            at = np.r_[0, np.flatnonzero(np.diff(key)) + 1]
            k, s, e, rs, re, left, right = anchors_of(key, pos, rpos, left, right)
            # What couldn't reach min_words, even if aligned as far as the words beside it allow, is left out: whole pairs first, then chains.
            lo, hi = s - left, e + right
            cuts = np.r_[0, np.flatnonzero(np.diff(k)) + 1]
            pairs = np.flatnonzero(long_runs(ids[at], np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts), min_words))
            cuts = np.r_[cuts, len(k)]
            found, spans = [], []
            for i, j in zip(cuts[pairs].tolist(), cuts[pairs + 1].tolist(), strict=True):
                a = (s[i:j].tolist(), e[i:j].tolist(), rs[i:j].tolist(), re[i:j].tolist())
                d, r = int(ids[at[k[i]]]), int(ref[at[k[i]]])
                for c in chains_of(*a):
                    found.append((d, r, a[0][c[0]], a[1][c[-1]], a[2][c[0]], a[3][c[-1]], [x for y in c for x in (a[0][y], a[1][y], a[2][y], a[3][y])]))
                    spans.append((d, int(lo[i + c[0]]), int(hi[i + c[-1]])))
            keep = long_runs(*np.array(spans, dtype=np.int64).reshape(-1, 3).T, min_words)
            out = sorted((x for x, y in zip(found, keep.tolist(), strict=True) if y), key=lambda x: (x[0], x[2]))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["id", "ref", "start", "end", "rstart", "rend", "anchors"])

    return run


def _matches(a: np.ndarray, b: np.ndarray) -> int:
    """Words in common in order: by place for equal lengths, else the longest common subsequence."""
    if not len(a) or not len(b):
        return 0
    if len(a) == len(b):
        return int((a == b).sum())
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return int(row[-1])


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """How far a and b agree from their start: words of a, words of b, matches. An edit is passed if two words then agree."""
    x, y = a.tolist(), b.tolist()
    i = j = m = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j, m = i + 1, j + 1, m + 1
            continue
        for p, q in EDITS:
            if x[i + p : i + p + 2] == y[j + q : j + q + 2] and len(x[i + p : i + p + 2]) == 2:
                i, j = i + p, j + q
                break
        else:
            return i, j, m
    return i, j, m


def align(a: np.ndarray, b: np.ndarray, anchors: list[int]) -> tuple[int, int, int, int, int]:
    """Start, end, ref start, ref end, matches of a chain whose anchors are given by places in a and b."""
    n = len(anchors) // 4
    s, e, rs, re = (anchors[i::4] for i in range(4))
    m = sum(int((a[s[i] : e[i]] == b[rs[i] : re[i]]).sum()) for i in range(n))
    m += sum(_matches(a[e[i] : s[i + 1]], b[re[i] : rs[i + 1]]) for i in range(n - 1))
    i, j, x = _extend(a[: s[0]][::-1], b[: rs[0]][::-1])
    p, q, y = _extend(a[e[-1] :], b[re[-1] :])
    return s[0] - i, e[-1] + p, rs[0] - j, re[-1] + q, m + x + y


PASSAGES = "doc_id long, start_word int, end_word int, n_words int, ref_doc_id long, ref_start int, ref_end int, identity double"


def _align(min_words: int, identity: float):
    def run(batches):
        for t in runs(batches, "id"):
            cols = {c: t.column(c).to_numpy() for c in ("id", "ref", "side", "from", "start")}
            values, offsets = flat(t.column("w"))
            anchors, aoff = flat(t.column("anchors"))
            out: dict[str, list] = {c: [] for c in ("d", "s", "e", "n", "r", "rs", "re", "i")}
            spans: list[tuple] = []

            def close(spans=spans, out=out):
                spans.sort(key=lambda x: (x[1], x[2]))
                i = 0
                while i < len(spans):
                    j, far, best = i + 1, spans[i][2], spans[i]
                    while j < len(spans) and spans[j][1] - far <= 3:
                        far, best = max(far, spans[j][2]), max(best, spans[j], key=lambda x: x[2] - x[1])
                        j += 1
                    if far - spans[i][1] >= min_words:
                        for c, v in zip(out, (best[0], spans[i][1], far, far - spans[i][1], *best[3:]), strict=True):
                            out[c].append(v)
                    i = j
                spans.clear()

            for i in range(0, t.num_rows - 1):
                if cols["side"][i] != 0 or cols["side"][i + 1] != 1:
                    continue
                if spans and spans[-1][0] != cols["id"][i]:
                    close()
                fa, fb = int(cols["from"][i]), int(cols["from"][i + 1])
                c = anchors[aoff[i] : aoff[i + 1]].astype(np.int64)
                c[0::4] -= fa
                c[1::4] -= fa
                c[2::4] -= fb
                c[3::4] -= fb
                a, b = values[offsets[i] : offsets[i + 1]], values[offsets[i + 1] : offsets[i + 2]]
                if len(a) < c[-3] or len(b) < c[-1]:
                    continue  # rows of one key with other texts
                s, e, rs, re, m = align(a, b, c.tolist())
                like = m / max(e - s, re - rs, 1)
                if like >= identity:
                    spans.append((int(cols["id"][i]), s + fa, e + fa, int(cols["ref"][i]), rs + fb, re + fb, round(like, 6)))
            close()
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), types, strict=True)], [f.split()[0] for f in PASSAGES.split(", ")])

    return run


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """Runs of at least min_words words of a document that earlier documents (by key) hold too, edits allowed.

    Columns as in PASSAGES: word places from 0, end excluded; ref_doc_id and what follows tell of the longest aligned
    chain in the run. Words are what white space parts, compared in lower case without punctuation at their edges. The
    earliest document of a passage is never reported, but as ref_doc_id. Null and blank texts have no words; rows with a
    null key are left out; rows of one key are taken as copies within one document, which aren't reported. Very long
    texts are read whole. An empty table gives an empty one. Other columns are not read.
    """
    found = links(docs, key, text).repartition("id").sortWithinPartitions("id").mapInArrow(_chain(min_words), CHAINS)
    found = stored(found.withColumn("chain", F.monotonically_increasing_id()), "chains")
    ours = F.struct(F.col("id").alias("doc"), F.lit(0).alias("side"), F.col("start").alias("a"), F.col("end").alias("z"), "anchors")
    theirs = F.struct(F.col("ref").alias("doc"), F.lit(1).alias("side"), F.col("rstart").alias("a"), F.col("rend").alias("z"), F.array().cast("array<int>").alias("anchors"))
    sides = found.select("id", "ref", "start", "chain", F.explode(F.array(ours, theirs)).alias("x")).select("id", "ref", "start", "chain", "x.*")
    # a document that others often repeat is joined with their chains in parts
    linked = stored(sides.groupBy("doc").agg(F.ceil(F.count("*") / CHAINS_A_TASK).cast("int").alias("tasks")), "linked")
    often = bounded(linked.filter("tasks > 1"), 40)
    d = docs.select(record_key(docs, key).alias("doc"), docs[text].alias("w")).filter("doc is not null")
    if fits(linked, 40):  # words are made of the texts in chains alone; else all, since a shuffle of texts costs more
        d = d.join(F.broadcast(linked.select("doc")), "doc", "left_semi")
    d = d.select("doc", short_codes(d["w"]).alias("w"))
    if docs.groupBy(key).count().filter(F.col(key).isNotNull() & (F.col("count") > 1)).limit(1).count():
        d = d.groupBy("doc").agg(F.max("w").alias("w"))
    released(docs.sparkSession)
    d = d.join(often, "doc", "left").withColumn("task", F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1))).drop("tasks")
    sides = sides.join(often, "doc", "left").withColumn("task", F.coalesce(F.pmod("chain", "tasks"), F.lit(0)).cast("int")).drop("tasks")
    cut = d.join(sides, ["doc", "task"]).withColumn("from", F.greatest(F.col("a") - REACH, F.lit(0)))
    cut = cut.select("id", "ref", "start", "chain", "side", "from", F.slice("w", F.col("from") + 1, F.col("z") + REACH - F.col("from")).alias("w"), "anchors")
    return cut.repartition("id").sortWithinPartitions("id", "start", "chain", "side").mapInArrow(_align(min_words, identity), PASSAGES)


def without_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated passages cut out of later documents; one of which nothing is left goes. length is set anew.

    White space goes with the word before it. Rows with a null key, null and blank texts, and documents without such a
    passage, are unchanged. Rows of one key are cut alike, each by what passages() found in one of them. Very long texts
    are read whole. An empty table gives an empty one. Other columns stay as they are, whatever their names.
    """
    mine, cuts, new = (free_name(docs.columns, x) for x in ("_id", "_spans", "_text"))
    spans = passages(docs, key, text, min_words).groupBy(F.col("doc_id").alias(mine)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(cuts))
    spans = stored(spans, "spans")
    joined = docs.select("*", record_key(docs, key).alias(free_name([*docs.columns, mine], "_key")))
    own = joined.columns[-1]
    joined = joined.join(bounded(spans, 160), F.col(own) == F.col(mine), "left")
    pieces = F.filter(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(r"(?U)\s*\S+\s*"), F.lit(0)), lambda w, i: ~F.exists(cuts, lambda s: (i >= s["start_word"]) & (i < s["end_word"])))
    out = joined.withColumn(new, F.when(F.col(cuts).isNotNull(), F.array_join(pieces, ""))).filter(F.col(cuts).isNull() | (F.trim(new) != ""))
    cols = []
    for c in docs.columns:
        old = F.col(f"`{c}`")
        if c == text:
            old = F.when(F.col(cuts).isNull(), old).otherwise(F.col(new)).alias(c)
        elif c == length:
            old = F.when(F.col(cuts).isNull(), old).otherwise(F.length(new).cast(docs.schema[c].dataType)).alias(c)
        cols.append(old)
    return out.select(*cols)
