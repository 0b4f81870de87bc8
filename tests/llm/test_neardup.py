import random

import numpy as np
import pytest

from wordkiln.llm import neardup as N
from wordkiln.llm.components import components
from wordkiln.llm.graph import SmallWorld, hamming


def _text(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def _edited(rng, text, share):
    return " ".join("edit" + str(rng.randrange(10**6)) if rng.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    rows, group = [], {}
    for g in range(150):
        base = _text(rng, 120)
        for k in range(1 if g % 3 else 4):
            i = len(rows)
            rows.append((i, base if k == 0 else _edited(rng, base, 0.03 * k)))
            group[i] = g
    for k in range(300):  # a large group, exact and near
        i = len(rows)
        rows.append((i, rows[0][1].upper() if k % 2 else _edited(rng, rows[0][1], 0.02)))
        group[i] = 0
    return rows, group


def test_groups_against_what_was_planted(documents, corpus):
    rows, group = corpus
    got = {r.id: r.group_id for r in N.near_duplicates(documents(rows), shard=128).collect()}
    first = {}
    for i, g in group.items():
        first.setdefault(g, i)
    wrong = [i for i in group if got[i] != first[group[i]]]
    assert len(wrong) <= 0.03 * len(group)
    assert all(group[got[i]] == group[i] for i in group)  # no two groups are merged


def test_exact_jaccard_of_every_pair(documents, corpus):
    """Against brute force: of all pairs that reach the similarity, 0.9 at least are in one group."""
    rows, _ = corpus
    got = {r.id: r.group_id for r in N.near_duplicates(documents(rows), shard=128).collect()}
    sets = [frozenset(t.lower().split()) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= N.SIMILARITY * len(sets[i] | sets[j])]
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.9 * len(pairs)


def test_graph_recall_against_exact_search():
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 2**63, (600, 2)).astype(np.uint64)
    near = centres ^ (np.uint64(1) << rng.integers(0, 63, (600, 2)).astype(np.uint64))
    points = np.unique(np.concatenate([centres, near]), axis=0)
    world = SmallWorld(points, complete=64)
    r, p, d = world.within(points, 10)
    found = set(zip(r.tolist(), p.tolist(), strict=True))
    exact = np.argwhere(hamming(points[:, None], points[None]) <= 10)
    assert sum((a, b) in found for a, b in exact.tolist()) >= 0.95 * len(exact)
    assert (hamming(points[r], points[p]) == d).all()


def test_beam_expands_to_whole_balls():
    base = np.array([[5, 9]], dtype=np.uint64)
    ball = np.unique(base ^ np.stack([np.uint64(1) << np.arange(60, dtype=np.uint64), np.zeros(60, np.uint64)], axis=1), axis=0)
    far = np.random.default_rng(1).integers(0, 2**63, (800, 2)).astype(np.uint64)
    points = np.concatenate([ball, far])
    r, p, _ = SmallWorld(points, complete=64).within(points, 4)
    assert sum((r < 60) & (p < 60)) == 3600


def test_audit_reports_recall(documents, corpus):
    a = N.audit(documents(corpus[0]), queries=100, shard=128)
    assert a["queries"] == 100 and a["exact"] > 300 and a["recall"] >= 0.9


@pytest.mark.parametrize("shard", [16_384, 16])
def test_recall_does_not_fall_with_the_size_of_shards(documents, shard):
    """Unrelated bases over common words, each with one copy of 5-25 % other words; every shard whole, or most of them in blocks."""
    rng = random.Random(7)
    rows = []
    for g in range(500):
        base = _text(rng, 60) + " the of and to in a is that it for"
        rows += [(2 * g, base), (2 * g + 1, _edited(rng, base, rng.uniform(0.05, 0.25)))]
    a = N.audit(documents(rows), queries=1000, shard=shard)
    assert a["exact"] > 400 and a["recall"] >= 0.95


def test_graphs_find_what_all_pairs_do(monkeypatch):
    """Shards without and with a graph, and a shard's blocks, against all pairs."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (700, 2)).astype(np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 63, (700, 2)).astype(np.uint64))
    points = np.concatenate([base, near, base[:50]]).view(np.int64)
    want = np.argwhere(np.triu(hamming(points[:, None], points[None]) <= 10, 1))
    for own, home in ((True, np.zeros(len(points))), (False, np.r_[np.zeros(700), np.ones(750)])):
        t = pa.table({"shard": np.zeros(len(points), dtype=np.int64), "own": np.full(len(points), own), "home": home.astype(np.int64), "f0": points[:, 0], "f1": points[:, 1]})
        got = {frozenset(x) for a, b, _ in N._pairs(t, 10) for x in zip(a.tolist(), b.tolist(), strict=True)}
        if own:  # equal fingerprints are chained, and one of them is searched
            assert len([x for x in want.tolist() if frozenset(x) in got]) >= 700 and {(i, i + 1400) for i in range(50)} <= {tuple(sorted(x)) for x in got}
            monkeypatch.setattr(N, "SMALL", 10_000)
            assert {frozenset(x) for a, b, _ in N._pairs(t, 10) for x in zip(a.tolist(), b.tolist(), strict=True)} == {frozenset(x) for x in want.tolist()}
        else:
            across = {frozenset(x) for x in want.tolist() if (x[0] < 700) != (x[1] < 700)}
            assert got <= across and len(got) >= 0.98 * 700


def test_bands_keep_the_chance_to_share_a_shard():
    for n in (10, 10**6, 10**7 + 1, 10**9, 10**11):
        r, bands = N.bands_of(n)
        assert 1 - (1 - N.SIMILARITY**r) ** bands >= N.SHARED
    assert N.bands_of(10**7)[0] == 2 and N.bands_of(10**7 + 1)[0] == 3 and N.bands_of(10**9)[0] == 4


def test_shards_do_not_fill_with_unrelated_documents(documents, corpus, monkeypatch):
    """Unrelated documents that a document meets, at the similarity of 0.04 that check_l has in the mean, don't grow with the table."""
    for n in (10**5, 10**6, 10**7, 10**8):
        r, bands = N.names_of(n)
        assert 1 - (1 - N.SIMILARITY**r) ** bands >= N.SHARED
        assert n * bands * 0.04**r <= 2_000
    used = []
    monkeypatch.setattr(N, "fingerprints", lambda d, key, text, r, bands, real=N.fingerprints: used.append(r) or real(d, key, text, r, bands))
    monkeypatch.setattr(N, "CROWD", 10**6)
    d = documents(corpus[0])
    got = {r.id: r.group_id for r in N.near_duplicates(d).collect()}
    monkeypatch.setattr(N, "CROWD", 1)
    same = sum(r.group_id == got[r.id] for r in N.near_duplicates(d).collect())
    assert used[0] > used[1] == 2 and same >= 0.99 * len(got)


def test_forest_in_parts_connects_what_it_did(spark):
    rng = random.Random(3)
    pairs = {tuple(sorted((rng.randrange(200), rng.randrange(200)))) for _ in range(3000)} | {(300, 301)}
    rows = [(a, b, rng.randrange(30)) for a, b in pairs if a != b]
    edges = spark.createDataFrame(rows, "a long, b long, distance long")
    whole = components(edges)
    for most in (10**6, 500):
        thin = N.forest(edges, whole, most)
        assert {(r.id, r.group_id) for r in components(thin).collect()} == {(r.id, r.group_id) for r in whole.collect()}
        assert thin.count() < (250 if most > 500 else 1600)


def test_simhash_is_the_majority():
    rng = np.random.default_rng(2)
    v = rng.integers(-(2**62), 2**62, 700)
    off = np.array([0, 1, 1, 400, 700])
    got = N.simhash(v, off)
    from wordkiln.llm.common import mix

    for i in range(4):
        own = v[off[i] : off[i + 1]].view(np.uint64)
        bits = np.unpackbits(np.stack([mix(own, 1), mix(own, 2)], axis=1).view(np.uint8), axis=1)
        want = np.packbits(2 * bits.sum(axis=0, dtype=int) > len(own)).view(np.uint64)
        assert (got[i] == want).all()


def test_components_of_a_long_path(spark):
    e = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (7, 7)]
    got = {r.id: r.group_id for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1001] == 1000 and len(got) == 203


def test_awkward(awkward, documents):
    got = {r.id: (r.group_id, r.kept) for r in N.near_duplicates(awkward).collect()}
    assert got[1] == (1, True) and got[2] == (2, True) and got[3] == (3, True)
    assert got[5][0] == 4 and got[7] == (6, False)
    kept = N.deduplicated(awkward.selectExpr("*", "7 as id", "8 as _gone")).collect()
    assert sorted(x.doc_id for x in kept if x.doc_id is not None) == [1, 2, 3, 4, 4, 6] and sum(x.doc_id is None for x in kept) == 2
    assert N.near_duplicates(documents([])).count() == 0
