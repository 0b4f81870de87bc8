from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wordkiln.llm import cws
from wordkiln.llm import kdtree as K


def _brute(p: pd.DataFrame, dims, target):
    span = {c: p[c].max() - p[c].min() for c in dims}
    leaf = {}

    def split(q, node):
        part = [(q[c].max() - q[c].min()) / span[c] if span[c] > 0 else 0 for c in dims]
        if q.w.sum() <= target or max(part) <= 0:
            leaf.update(dict.fromkeys(q.index, node))
            return
        c = dims[part.index(max(part))]
        sums = q.groupby(c).w.sum().sort_index().cumsum()
        v = sums.index[(sums >= q.w.sum() / 2).argmax()]
        left = q[c] <= v if v < q[c].max() else q[c] < v
        split(q[left], 2 * node)
        split(q[~left], 2 * node + 1)

    split(p, 1)
    return leaf


def test_tree_against_brute_force(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"k": range(600), "x": rng.integers(0, 30, 600).astype(float), "y": rng.normal(size=600), "w": rng.integers(0, 90, 600)})
    got = K.sharded(d := spark.createDataFrame(p), "k", {"x": d["x"], "y": d["y"]}, d["w"], 4000).toPandas()
    want = _brute(p.set_index("k"), ["x", "y"], 4000)
    assert dict(zip(got.id, got.leaf, strict=True)) == want and got.leaf_bytes.max() <= 4000 and got.leaf.nunique() > 4
    assert (got.groupby("leaf").bytes.sum() == got.groupby("leaf").leaf_bytes.first()).all()


def test_tree_awkward(awkward, documents):
    got = K.document_shards(awkward.selectExpr("*", "1 as node", "2 as w", "3 as leaf"), target=1000).toPandas()
    assert len(got) == awkward.count() and got.doc_id.isna().sum() == 2
    assert got[got.doc_id == 4].leaf.nunique() == 1
    assert K.document_shards(documents([])).count() == 0
    same = documents([(1, "x" * 100)] * 5)
    assert set(K.document_shards(same, target=10).toPandas().leaf) == {1}


def test_strings_are_parted_beyond_a_common_prefix(spark, documents):
    names = [f"common_crawl_{x}" for x in "abcdefgh"]
    rows = [(1, "x" * 100, names[i % 8]) for i in range(64)]
    got = K.document_shards(documents(rows), target=900).toPandas()
    assert got.leaf.nunique() == 8 and got.leaf_bytes.max() == 800
    words = [f"w{i:03d}" for i in range(300)] + ["", "é", "w000", None]
    ranks = {r.value: r.code for r in K.ranks(spark.createDataFrame([(w,) for w in words], "s string")).collect()}
    assert ranks == {w: float(i) for i, w in enumerate(sorted({w for w in words if w is not None}, key=lambda w: w.encode()))}


def test_memory_is_bounded_by_chunks_not_by_terms():
    """500,000 distinct terms in one batch: what the worker holds beside input and output stays small."""
    import tracemalloc

    v = np.arange(500_000) * 7919
    off = np.arange(0, 500_001, 50)
    tracemalloc.start()
    s = cws.signatures(v, off, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (s >= 0).all() and peak < 350 << 20


def test_collisions_are_generalised_jaccard():
    rng = np.random.default_rng(1)
    vocabulary = rng.integers(-(2**62), 2**62, 500)
    rows = [rng.zipf(1.4, 300) % 500 for _ in range(3)]
    rows += [np.concatenate([rows[0][:k], rng.integers(0, 500, 300 - k)]) for k in (250, 150)]
    s = cws.signatures(vocabulary[np.concatenate(rows)], np.arange(6) * 300, 2048)
    for i in range(5):
        for j in range(i):
            a, b = Counter(rows[i].tolist()), Counter(rows[j].tolist())
            want = sum((a & b).values()) / sum((a | b).values())
            assert abs((s[i] == s[j]).mean() - want) < 0.04


def _one_by_one(values, samples):
    """The sampling as it is defined, term by term."""
    out = []
    count = Counter(values.tolist())
    terms = np.array(sorted(count))
    r, c, beta = cws.parameters(terms.view(np.uint64), samples)
    for k in range(samples):
        a, best = np.inf, None
        for i, t in enumerate(terms):
            q = np.floor(np.log(np.float32(count[t])) / r[i, k] + beta[i, k])
            value = c[i, k] - r[i, k] * (q - beta[i, k] + 1)
            if value < a:
                a, best = value, (t, int(q))
        h = cws.mix(np.array([best[0]]).view(np.uint64), 901) ^ np.uint64(best[1] & 0xFFFFFFFFFFFFFFFF)
        out.append(int(cws.mix(h, 902)[0] >> np.uint64(32)))
    return out


def test_signatures_against_the_definition():
    rng = np.random.default_rng(5)
    v = rng.integers(-(2**62), 2**62, 40)[rng.zipf(1.5, 200) % 40]
    assert (cws.signatures(v, np.array([0, 200]), 32)[0] == _one_by_one(v, 32)).mean() >= 0.97


def test_long_rows_are_whole(monkeypatch):
    rng = np.random.default_rng(6)
    v, off = rng.integers(0, 10**6, 9000), np.array([0, 8000, 8000, 9000])
    whole = cws.signatures(v, off, 16)
    monkeypatch.setattr(cws, "CHUNK", 700)
    assert (cws.signatures(v, off, 16) == whole).all() and (whole[1] == -1).all()


def test_fingerprints_awkward(awkward, documents):
    got = cws.fingerprints(awkward.selectExpr("*", "1 as h", "2 as signature")).collect()
    assert len(got) == awkward.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert set(by[1].signature) == set(by[2].signature) == set(by[3].signature) == {-1}
    assert by[4].signature == by[5].signature and by[6].signature == by[7].signature and by[6].n_terms == 40_000
    assert cws.fingerprints(documents([])).count() == 0
    s = cws.fingerprints(documents([(1, "a b c d"), (2, "a b c d"), (3, "")])).orderBy("doc_id").collect()
    spark = awkward.sparkSession
    pair = spark.createDataFrame([(s[0].signature, s[1].signature), (s[0].signature, s[2].signature)], "a array<long>, b array<long>")
    assert [r.s for r in pair.select(cws.similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [1.0, None]
