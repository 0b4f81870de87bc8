import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from wordkiln.llm import chaining as C


def _words(rng, n):
    return ["".join(rng.choice("klmnoprstu") for _ in range(7)) for _ in range(n)]


def _best_score(a, cost=C.GAP_COST):
    """Quadratic chaining: the best score that ends in each anchor."""
    n = len(a)
    order = sorted(range(n), key=lambda i: (a[i][0], a[i][2]))
    f = {}
    for i in order:
        s, _, rs, _ = a[i]
        f[i] = a[i][1] - s + max([0.0, *(f[j] - cost * (s - a[j][1] + rs - a[j][3]) for j in f if a[j][1] <= s and a[j][3] <= rs)])
    return max(f.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 120), st.integers(0, 120), st.integers(3, 15)), min_size=1, max_size=25, unique=True))
def test_fenwick_chains_score_as_quadratic_ones(xs):
    a = [(x, x + n, y, y + n) for x, y, n in xs]
    chains = C.chains_of(*(list(c) for c in zip(*a, strict=True)))
    assert sorted(i for c in chains for i in c) == list(range(len(a)))
    score = lambda c: sum(a[i][1] - a[i][0] for i in c) - C.GAP_COST * sum(a[j][0] - a[i][1] + a[j][2] - a[i][3] for i, j in zip(c, c[1:], strict=False))
    for c in chains:
        assert all(a[i][1] <= a[j][0] and a[i][3] <= a[j][2] for i, j in zip(c, c[1:], strict=False))
    assert abs(max(map(score, chains)) - _best_score(a)) < 1e-9


def test_seeds_of_a_passage_are_the_same_anywhere():
    rng = np.random.default_rng(0)
    p = rng.integers(0, 2**62, 60)
    one, two = np.concatenate([rng.integers(0, 2**62, 33), p, rng.integers(0, 2**62, 20)]), np.concatenate([p, rng.integers(0, 2**62, 50)])
    row, pos, h = C.seeds_of(np.concatenate([one, two]), np.array([0, len(one), len(one) + len(two)]))
    inside = [set(h[(row == r) & (pos >= at + 13) & (pos + C.K <= at + 47)].tolist()) for r, at in ((0, 33), (1, 0))]
    assert inside[0] == inside[1] and len(inside[0]) >= 4


def test_planted_passages(documents):
    rng = random.Random(4)
    rows, planted = [], {}
    passages = [_words(rng, 55) for _ in range(6)]
    for i in range(120):
        w = _words(rng, rng.randrange(80, 200))
        if i % 5 == 0:
            k = (i // 5) % 6
            p = list(passages[k])
            if i % 2:
                p[20] = "changed"
                del p[35]
            at = rng.randrange(len(w))
            w[at:at] = p
            planted[i] = (k, at, at + len(p))
        rows.append((i, " ".join(w)))
    got = {}
    for r in C.passages(documents(rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    seen = set()
    for i, (k, at, end) in planted.items():
        if k in seen:
            (r,) = got.pop(i)
            assert abs(r.start_word - at) <= 2 and abs(r.end_word - end) <= 2 and planted[r.ref_doc_id][0] == k and r.identity >= 0.9
        seen.add(k)
    assert not got  # neither first documents nor clean ones


def test_fuzzy_passages_against_brute_force_alignment(documents):
    """55 words with random words changed: of those that align at the identity over their whole length, most are found."""
    rng = random.Random(12)
    rows, planted = [], {}
    for rate in (0.1, 0.15, 0.2, 0.25, 0.3):
        for _ in range(60):
            p, i = _words(rng, 55), len(rows)
            q = [w if rng.random() >= rate else "changed" + str(rng.randrange(10**6)) for w in p]
            rows += [(i, " ".join(_words(rng, 30) + p + _words(rng, 30))), (i + 1, " ".join(_words(rng, 30) + q + _words(rng, 30)))]
            if sum(a == b for a, b in zip(p, q, strict=True)) >= C.IDENTITY * len(p):
                planted.setdefault(rate, []).append(i + 1)
    found = {r.doc_id for r in C.passages(documents(rows)).collect()}
    recall = {rate: sum(i in found for i in ids) / len(ids) for rate, ids in planted.items()}
    print(recall)
    assert all(recall[rate] >= least for rate, least in ((0.1, 0.95), (0.15, 0.9), (0.2, 0.75)))


def test_parts_from_different_documents_join(documents):
    rng = random.Random(9)
    a, b, x = _words(rng, 30), _words(rng, 30), _words(rng, 40)
    rows = [(1, " ".join(a + _words(rng, 50))), (2, " ".join(_words(rng, 50) + b)), (3, " ".join(x[:20] + a + b + x[20:]))]
    (r,) = C.passages(documents(rows)).collect()
    assert (r.doc_id, r.start_word, r.end_word) == (3, 20, 80)


def test_against_brute_force_of_exact_runs(spark, data):
    """Every run of 50 words of a document that an earlier one has too is covered."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.select("doc_id", C.word_codes(docs["text"]).alias("w")).orderBy("doc_id").collect()
    found = {}
    for r in C.passages(docs).collect():
        found.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    first, missed, total = {}, 0, 0
    for doc, w in rows:
        own = {tuple(w[i : i + 50]): i for i in range(len(w) - 49)}
        for run, i in own.items():
            if first.setdefault(run, doc) != doc and len(set(run)) > 10:
                total += 1
                missed += not any(s <= i + 5 and i + 45 <= e for s, e in found.get(doc, []))
    assert total and missed <= 0.01 * total


def test_cutting(documents):
    rng = random.Random(5)
    p, a, b = _words(rng, 60), _words(rng, 30), _words(rng, 30)
    rows = [(1, " ".join(p)), (2, " ".join(a) + "\n" + " ".join(p) + "\n" + " ".join(b)), (3, " ".join(p)), (4, " ".join(b))]
    d = documents(rows).selectExpr("*", "1 as start", "2 as ref")
    out = C.without_passages(d)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == d.columns and set(got) == {1, 2, 4}
    assert got[2].text.split() == a + b and got[2].n_chars == len(got[2].text) and got[1].text == rows[0][1]


def test_awkward(awkward, documents):
    (r,) = C.passages(awkward).collect()
    assert (r.doc_id, r.ref_doc_id, r.start_word, r.end_word) == (7, 6, 0, 40_000)
    assert C.without_passages(awkward).count() == awkward.count() - 1
    assert C.passages(documents([])).count() == 0


def test_hot_seeds_lose_no_link(spark, documents, monkeypatch):
    """A passage that a third of all documents hold, spread over tasks: the same runs are found as without hot seeds."""
    rng = random.Random(6)
    p = _words(rng, 60)
    rows = [(i, " ".join(_words(rng, 40) + (p if i % 3 == 0 else []) + _words(rng, 40))) for i in range(300)]
    d = documents(rows).repartition(3)
    runs = lambda: {(r.doc_id, r.start_word, r.end_word) for r in C.passages(d).collect()}
    coded = d.select("doc_id", C.word_codes(d["text"]).alias("w")).withColumnRenamed("doc_id", "id")
    hot = C.hot_seeds(coded, 1e-3, 8).collect()
    assert hot and all(r.hid % 3 == 0 for r in hot)
    monkeypatch.setattr(C, "hot_seeds", lambda coded, share, real=C.hot_seeds: real(coded, 1e-3))
    found = runs()
    monkeypatch.setattr(C, "hot_seeds", lambda coded, share, real=C.hot_seeds: coded.select(C.F.lit(0).cast("long").alias("h"), C.F.lit(0).cast("long").alias("hid"), C.F.lit(0).alias("hpos")).limit(0))
    assert found == runs() == {(i, 40, 100) for i in range(3, 300, 3)}
    monkeypatch.setattr(C, "CHAINS_A_TASK", 7)
    assert found == runs()


def test_joins_without_broadcast(documents, monkeypatch):
    """Tables too large for a broadcast are joined by shuffle, with the same result."""
    from wordkiln.llm import common

    rng = random.Random(9)
    p, a = _words(rng, 60), _words(rng, 30)
    d = documents([(1, " ".join(p)), (2, " ".join(a + p)), (3, " ".join(p + a)), (4, " ".join(a))])
    want = sorted(map(str, C.without_passages(d).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    d.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = C.without_passages(d)
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, out.collect())) == want
    finally:
        d.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_clashing_names(awkward):
    d = awkward.selectExpr("*", "1 as _text", "2 as _spans", "3 as _id", "4 as h", "5 as `a.b`")
    out = C.without_passages(d)
    assert out.columns == d.columns and out.count() == awkward.count() - 1


def test_chance_seeds_are_not_aligned_and_nothing_is_lost():
    """Few words in all, so that many seeds agree by chance: the same passages from a fraction of the chains."""
    rng = np.random.default_rng(3)
    vocabulary = rng.integers(-(2**62), 2**62, 40)
    docs = [vocabulary[(40 * rng.random(200) ** 2).astype(int)] for _ in range(150)]
    for i in range(10, 150, 10):
        p = docs[i - 7][60 : 60 + 8 * (i // 10)].copy()
        p[rng.random(len(p)) < 0.1] = i
        docs[i][100 : 100 + len(p)] = p[:100]
    values, offsets = np.concatenate(docs), np.arange(0, 200 * 150 + 1, 200)
    row, pos, h = C.seeds_of(values, offsets)
    first = np.unique(h, return_index=True)
    first = first[1][np.searchsorted(first[0], h)]
    beside = C._beside(values, offsets, row, pos)
    at = row[first] != row
    n, got = [], []
    for known in (True, False):
        cols = row[at], row[first][at], pos[at], pos[first][at], beside[at], beside[first][at] if known else np.full(at.sum(), -1)
        (links,) = [pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", "ref", "pos", "rpos", "beside", "rbeside"])]
        chains = pa.Table.from_batches(list(C._chain(40)(iter([links])))).to_pylist()
        n.append(len(chains))
        sides = []
        for c in chains:
            for side, doc, a, z in ((0, "id", "start", "end"), (1, "ref", "rstart", "rend")):
                lo = max(c[a] - C.REACH, 0)
                w = docs[c[doc]][lo : c[z] + C.REACH]
                sides.append({"id": c["id"], "ref": c["ref"], "start": c["start"], "side": side, "from": lo, "w": w.tolist(), "anchors": [] if side else c["anchors"]})
        types = [("id", pa.int64()), ("ref", pa.int64()), ("start", pa.int32()), ("side", pa.int32()), ("from", pa.int32()), ("w", pa.list_(pa.int64())), ("anchors", pa.list_(pa.int32()))]
        batch = pa.RecordBatch.from_pylist(sides, schema=pa.schema(types))
        got.append(pa.Table.from_batches(list(C._align(40, 0.7)(iter([batch])))).to_pylist())
    assert got[0] == got[1] and len(got[0]) >= 5
    assert n[0] < 0.7 * n[1]
    print(n)


def test_hot_seeds_by_chance_are_not_aligned(spark, documents, monkeypatch):
    """Four words that all documents hold, a passage that some do: of the links to the hot seed none makes a chain."""
    rng = random.Random(11)
    p, four = _words(rng, 60), _words(rng, 4)
    rows = [(i, " ".join(_words(rng, 40) + four + _words(rng, 40) + (p if i % 50 == 0 else []))) for i in range(300)]
    d = documents(rows).repartition(3)
    monkeypatch.setattr(C, "hot_seeds", lambda coded, share, real=C.hot_seeds: real(coded, 1e-3))
    found = C.links(d, "doc_id", "text")
    hot = found.filter("pos = 40 and rpos = 40").collect()
    assert len(hot) >= 30 and all(r.rbeside > 0 for r in hot)
    read, stored = [], C.stored
    monkeypatch.setattr(C, "stored", lambda df, label: read.append((label, stored(df, label))) or read[-1][1])
    assert {(r.doc_id, r.start_word, r.end_word) for r in C.passages(d).collect()} == {(i, 84, 144) for i in range(50, 300, 50)}
    assert dict(read)["chains"].count() == 5 and dict(read)["linked"].count() == 6


def test_short_passages_are_not_aligned():
    """Thirty words that two documents share can't reach 40, however near to their edges the seeds are; forty can."""
    rng = np.random.default_rng(4)
    for shared, least in ((30, 0), (40, 100)):
        n = 0
        for _ in range(100):
            a, b = rng.integers(-(2**62), 2**62, (2, 150))
            b[70 : 70 + shared] = a[50 : 50 + shared]
            values, offsets = np.concatenate([a, b]), np.array([0, 150, 300])
            row, pos, h = C.seeds_of(values, offsets)
            beside = C._beside(values, offsets, row, pos)
            first = {x: i for i, x in reversed(list(enumerate(h.tolist())))}
            pairs = [(i, first[x]) for i, x in enumerate(h.tolist()) if row[i] == 1 and row[first[x]] == 0]
            at, to = np.array(pairs).T
            left, right = C._extends(beside[at], beside[to])
            x, y, lo, hi = pos[at[0]], pos[at[-1]], left[0], right[-1]
            assert x - lo <= 70 and y + C.K + hi >= 70 + shared
            cols = row[at], row[to], pos[at], pos[to], beside[at], beside[to]
            links = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", "ref", "pos", "rpos", "beside", "rbeside"])
            n += sum(t.num_rows for t in C._chain(40)(iter([links])))
        assert n >= least and (least or n <= 30)


def test_no_more_words_are_passed_than_those_beside_allow():
    rng = np.random.default_rng(5)
    vocabulary = rng.integers(-(2**62), 2**62, 30)
    tight = 0
    for _ in range(5000):
        a = vocabulary[rng.integers(0, 30, 40)]
        b = np.concatenate([vocabulary[rng.integers(0, 30, int(rng.integers(0, 3)))], np.where(rng.random(40) < 0.4, vocabulary[rng.integers(0, 30, 40)], a)])[:40]
        b[:4] = a[:4] = 7
        beside = C._beside(np.concatenate([a, b]), np.array([0, 40, 80]), np.array([0, 1]), np.array([0, 0]))
        _, right = C._extends(beside[:1], beside[1:])
        i, _, _ = C._extend(a[4 : 4 + C.REACH], b[4 : 4 + C.REACH])
        assert i <= right[0]
        tight += i == right[0]
    assert tight > 1000
