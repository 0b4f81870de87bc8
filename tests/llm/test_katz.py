import math
from collections import Counter

import numpy as np
import pytest

from wordkiln.llm import katz as K
from wordkiln.llm.common import flat, word_hashes

MASK = (1 << K.BITS) - 1


def _dictionaries(model):
    logs = {(i,): v for i, v in enumerate(model.logp)}
    bows = {(i,): v for i, v in enumerate(model.bow)} | {(K.START, K.START): model.start_bow}
    for r in model.table().collect():
        g = tuple((r.key >> (K.BITS * (r.level - 1 - i))) & MASK for i in range(r.level))
        logs[g], bows[g] = r.logp, r.bow
    return logs, bows


def _ids(docs, model):
    t = docs.select("doc_id", word_hashes(docs["text"]).alias("h")).toArrow()
    ids, off = K.token_ids(*flat(t.column("h")), model.vocabulary, model.order)
    return {d: ids[off[i] : off[i + 1]].astype(int).tolist() for i, d in enumerate(t.column("doc_id").to_pylist())}


@pytest.mark.parametrize("order", [2, 3])
def test_scores_are_the_recursion(spark, data, order):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = K.train(docs, order=order, bucket_tokens=20_000)
    logs, bows = _dictionaries(model)
    got = {r.doc_id: r for r in K.score(docs, model).collect()}
    assert len(got) == docs.count()
    for d, w in list(_ids(docs, model).items())[:40]:
        want = sum(K.word_probability(logs, bows, tuple(w[i - order + 1 : i]), w[i]) for i in range(order - 1, len(w)))
        assert math.isclose(got[d].logprob, want, rel_tol=1e-9) and got[d].n_tokens == len(w) - order + 1


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_sum_to_one(spark, data, order):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    logs, bows = _dictionaries(K.train(docs, order=order))
    words = [g[0] for g in logs if len(g) == 1 and g[0] != K.START]
    histories = [g for g in logs if len(g) == order - 1 and K.END not in g][::300][:12] + [(K.START,) * (order - 1)]
    for h in histories:
        assert math.isclose(sum(math.exp(K.word_probability(logs, bows, h, w)) for w in words), 1, rel_tol=1e-9)


def test_counts_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = K.train(docs, bucket_tokens=20_000)
    want = Counter()
    for w in _ids(docs, model).values():
        want.update(zip(w, w[1:], strict=False))
    assert {(r.key >> K.BITS, r.key & MASK): r.n for r in model.table().collect()} == dict(want)


def test_every_word_is_counted(documents):
    """Words seen once among 70,000 others keep their counts, and a text of them isn't taken for another of unseen words."""
    common = " ".join(["the", "of"] * 500)
    rows = [(i, common) for i in range(70)] + [(100, "rare1 rare2 rare3"), (101, "rare4 rare5")]
    model = K.train(documents(rows))
    assert len(model.vocabulary) == 7
    got = {r.doc_id: r.logprob for r in K.score(documents([(1, "rare1 rare2 rare3"), (2, "never seen before")]), model).collect()}
    assert got[1] > got[2] + 10


def test_text_outside_the_corpus(spark, documents, data):
    model = K.train(spark.read.parquet(f"{data}/documents.parquet"))
    logs, bows = _dictionaries(model)
    new = documents([(1, "of the unseenword and the of the"), (2, "Ein den the la")])
    got = {r.doc_id: r.logprob for r in K.score(new, model).collect()}
    for d, w in _ids(new, model).items():
        assert math.isclose(got[d], sum(K.word_probability(logs, bows, (a,), b) for a, b in zip(w, w[1:], strict=False)), rel_tol=1e-9)


def test_good_turing():
    d = K.discounts({1: 1000, 2: 300, 3: 150, 4: 90, 5: 60, 6: 40})
    a = 6 * 40 / 1000
    assert np.allclose(d, [(r * n2 / ((r - 1) * n1) - a) / (1 - a) for r, n1, n2 in ((2, 1000, 300), (3, 300, 150), (4, 150, 90), (5, 90, 60), (6, 60, 40))])
    assert all(0 < x < 1 for x in K.discounts({1: 3}) + K.discounts({}))


def test_awkward(awkward, documents):
    got = {r.doc_id: r.n_tokens for r in K.perplexities(awkward).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[4] == 14 and got[6] == got[7] == 40_001 and None not in got
    assert K.perplexities(documents([])).count() == 0
