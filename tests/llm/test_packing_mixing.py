import hashlib
import math
from itertools import combinations, permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wordkiln.llm import mixing as M
from wordkiln.llm import packing as P


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 256), min_size=1, max_size=200))
def test_every_piece_has_a_window_with_room(lengths):
    x = np.array(lengths)
    w = P.pack_shard(x, 256, 16, 3)
    assert (w >= 0).all() and np.bincount(w, x).max() <= 256
    assert w.max() + 1 <= 2 * math.ceil(x.sum() / 256) + 1  # no two windows are half empty


def test_windows_are_nearly_full():
    x = np.clip(np.random.default_rng(0).lognormal(5.8, 1, 8000).astype(int), 1, 2048)
    w = P.pack_shard(x)
    assert x.sum() / 2048 / (w.max() + 1) > 0.98


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_nnls_meets_its_conditions(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.random((6, 10)), rng.normal(size=6)
    x = P.nnls(a, b)
    g = a.T @ (b - a @ x)
    assert (x >= 0).all() and (g <= 1e-6).all() and abs(x @ g) < 1e-6


def test_combinations_fill_the_window():
    c = P.combinations(8, 3)
    total = c @ np.arange(1, 9)
    assert ((total == 8) | (total == 7)).all() and c.sum(axis=1).max() == 3 and len(c) == len(np.unique(c, axis=0))


def _fewest(lengths, window):
    """The fewest windows that hold all pieces, by trying every order with each piece in the last window or a new one."""
    best = len(lengths)
    for order in set(permutations(lengths)):
        n, left = 1, window
        for x in order:
            if x > left:
                n, left = n + 1, window
            left -= x
        best = min(best, n)
    return best


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=6))
def test_windows_against_the_fewest_possible(lengths):
    got = P.pack_shard(np.array(lengths), 64, 4, 3).max() + 1
    assert _fewest(lengths, 64) <= got <= _fewest(lengths, 64) + 1


def test_nnls_against_every_support():
    rng = np.random.default_rng(11)
    for _ in range(20):
        a, b = rng.random((5, 6)), rng.normal(size=5)
        best = float(b @ b)
        for k in range(1, 6):
            for support in combinations(range(6), k):
                x, *_ = np.linalg.lstsq(a[:, support], b, rcond=None)
                if (x >= 0).all():
                    best = min(best, float(((b - a[:, support] @ x) ** 2).sum()))
        x = P.nnls(a, b)
        assert abs(float(((b - a @ x) ** 2).sum()) - best) < 1e-8


def test_packed_keeps_every_token(documents, awkward):
    rows = [(i, "w " * n) for i, n in enumerate([1, 5, 100, 2048, 2049, 5000, 700, 1348])]
    out = P.packed(documents(rows)).toPandas()
    assert out.groupby("doc_id").n_tokens.sum().to_dict() == {i: len(t.split()) for i, t in rows}
    w = out.groupby(["shard", "window"])
    assert w.n_tokens.sum().max() <= 2048 and (out["at"] == w.n_tokens.cumsum() - out.n_tokens).all()
    a = P.packed(awkward.selectExpr("*", "1 as shard", "2 as window")).toPandas()
    assert set(a.doc_id) == {4, 5, 6, 7} and len(a[a.doc_id == 4]) == 2 and a[a.doc_id == 6].n_tokens.sum() == 40_000
    assert P.packed(documents([])).count() == 0


def test_exponent_meets_entropy_and_repetition():
    tokens = [1_000_000, 50_000, 20_000, 1_000]
    x = M.exponent_for(tokens, sum(tokens), target=0.8, repeats=1e9)
    w = M.tempered([t / sum(tokens) for t in tokens], x)
    assert abs(M.entropy(w) - 0.8 * math.log(4)) < 1e-9 and abs(sum(w) - 1) < 1e-12
    x = M.exponent_for(tokens, sum(tokens), target=0.99, repeats=4)
    w = M.tempered([t / sum(tokens) for t in tokens], x)
    assert abs(max(a * sum(tokens) / t for a, t in zip(w, tokens, strict=True)) - 4) < 1e-6
    assert M.exponent_for([5, 5, 5], 15) == 1.0 and M.exponent_for([], 0) == 1.0 and M.exponent_for([7, 0], 7) == 1.0


def _brute_mix(rows, target, repeats, block_tokens, seed=7):
    """The order of training as the docstring tells it: sources one by one, passes one by one, documents one by one."""
    md5 = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    out, by = [], {}
    for i, t, s in rows:
        by.setdefault(s, []).append((i, len(t.split())))
    names = sorted(by)
    totals = [sum(n for _, n in by[s]) for s in names]
    x = M.exponent_for(totals, sum(totals), target, repeats)
    for s, total, weight in zip(names, totals, M.tempered([t / sum(totals) for t in totals], x), strict=True):
        quota, spent, epoch = round(weight * sum(totals)), 0, 0
        n_blocks = max(1, -(-total // block_tokens))
        blocks = {}
        for i, n in by[s]:
            blocks.setdefault(int(md5(seed, i)[:8], 16) % n_blocks, []).append((md5(seed + 1, i), i, n))
        while spent < quota:
            for rank, b in enumerate(sorted(blocks, key=lambda b: (md5(seed, s, epoch, b), b))):
                if spent >= quota:
                    break
                for place, (_, i, n) in enumerate(sorted(blocks[b])):
                    if spent + n <= quota or n == 0:
                        out.append((s, epoch, b, rank, place, i, n))
                        spent += n
                    else:
                        spent = quota  # the block is cut here
                        break
            epoch += 1
    return sorted(out)


@pytest.mark.parametrize(("target", "repeats"), [(0.9, 3), (1.0, 1e9), (0.5, 1.2)])
def test_order_against_brute_force(documents, target, repeats):
    rng = np.random.default_rng(3)
    rows = [(i, f"t{i} " + "w " * int(rng.integers(1, 60)), s) for i, s in enumerate(["hot"] * 300 + ["mid"] * 60 + ["low"] * 15)]
    got = M.order(documents(rows), target=target, repeats=repeats, block_tokens=400).toPandas()
    assert sorted(zip(*[got[c] for c in ("source", "epoch", "block", "block_rank", "place", "doc_id", "n_tokens")], strict=True)) == _brute_mix(rows, target, repeats, 400)
    # by progress, every source's part of what has been passed over stays near its weight
    assert got.progress.between(0, 1).all()
    total = got.groupby("source").n_tokens.sum()
    half = got[got.progress < 0.5].groupby("source").n_tokens.sum()
    assert ((half - total / 2).abs() <= 61).all()


def test_rows_alike_are_passed_over_together(documents):
    rows = [(1, "a b c", "s")] * 3 + [(1, "d e", "s"), (1, "f g", "s"), (None, "h", None), (None, "h", None)]
    d = documents(rows)
    out = M.mixed(d.selectExpr("*", "5 as _epoch", "6 as _copy", "7 as h0"))
    assert out.columns == ["__epoch", "_tokens", "_progress", *d.columns, "_epoch", "_copy", "h0"]
    assert sorted(str(r.text) for r in out.select("text").collect()) == sorted(str(r[1]) for r in rows)
    place = M.order(d).filter("source = 's'").collect()
    assert len(place) == 5 and len({(r.block, r.place) for r in place}) == 3


def test_quotas_are_met_to_a_document(documents):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(1, 60)), s) for i, s in enumerate(["hot"] * 600 + ["mid"] * 120 + ["low"] * 30)]
    d = documents(rows)
    out = M.mixed(d, target=0.9, repeats=3, block_tokens=400).toPandas()
    have = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("hot", "mid", "low")}
    plan, _ = M.plan(d.sparkSession.createDataFrame(list(have.items()), "source string, tokens long"), None, 0.9, 3)
    for s, t, _, quota in plan:
        got = out[out.source == s]
        assert quota - 60 < got._tokens.sum() <= quota
        times = got.groupby("doc_id").size()
        assert times.max() <= math.ceil(quota / t) and (quota < t or times.size == sum(x == s for _, _, x in rows))
    again = M.mixed(d, target=0.9, repeats=3, block_tokens=400).toPandas()
    key = ["doc_id", "_epoch"]
    assert (out.sort_values(key)[key].to_numpy() == again.sort_values(key)[key].to_numpy()).all()


def test_even_sources_come_once(documents):
    rows = [(i, "w " * 10, f"s{i % 4}") for i in range(200)]
    assert sorted(r.doc_id for r in M.mixed(documents(rows)).collect()) == list(range(200))


def test_mixing_awkward(awkward, documents):
    clash = awkward.selectExpr("*", "1 as tokens", "2 as block", "3 as total")
    out = M.mixed(clash)
    assert [c for c in out.columns if not c.startswith("_")] == clash.columns and out.count() >= awkward.count() - 2
    assert M.mixed(documents([])).count() == 0
