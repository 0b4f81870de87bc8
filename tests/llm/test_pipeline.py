import random

import corpus_pipeline as P
import pytest

import __spark_entry__ as entry
from wordkiln.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _words(rng, n):
    common = "the of and to in that it is for was".split()
    return [rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefghiklm") for _ in range(8)) for _ in range(n)]


@pytest.fixture(scope="module")
def planted(documents):
    """Clean documents, junk, copies and documents that share a passage."""
    rng = random.Random(8)
    clean = {i: " ".join(_words(rng, rng.randrange(60, 300))) + "." for i in range(40)}
    junk = {100 + i: "$$$ &&& *** " * 40 for i in range(4)}
    copies = {200 + i: clean[i].replace(".", " edited.") for i in range(10)}
    passage = " ".join(_words(rng, 70))
    shared = {300 + i: " ".join(_words(rng, 90)) + " " + passage + " " + " ".join(_words(rng, 90)) for i in range(4)}
    return documents([*{**clean, **junk, **copies, **shared}.items()]), clean, junk, copies, shared, passage


def test_each_stage_does_its_work(spark, planted):
    docs, clean, junk, copies, shared, passage = planted
    seen = {}
    for name, stage in P.STAGES:
        out = stored(stage(spark, docs, ""), name)
        seen[name] = out.collect()
        if name != "pack_windows":
            assert out.columns == COLUMNS
        docs = out
    ids = {n: {r.doc_id for r in rows} for n, rows in seen.items()}
    assert ids["quality_rules"] == set(clean) | set(copies) | set(shared)
    assert ids["near_duplicates"] == set(clean) | set(shared)
    text = {r.doc_id: r.text for r in seen["substring_dedup"]}
    assert passage in text[300] and all(passage not in text[i] and len(text[i].split()) == 180 for i in (301, 302, 303))
    assert all(text[i] == clean[i] for i in clean)
    assert ids["mix_sources"] == ids["pack_windows"] == ids["near_duplicates"]
    total = {}
    for r in seen["pack_windows"]:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {i: len(t.split()) for i, t in text.items()}


def test_run_is_its_stages(spark, data):
    out = P.run(spark, data)
    assert out.count() > 0 and out.groupBy("shard", "window").sum("n_tokens").agg({"sum(n_tokens)": "max"}).first()[0] <= 2048


def test_stages_take_awkward_rows(spark, awkward):
    for name, stage in P.STAGES:
        out = stage(spark, awkward.selectExpr("*", "1 as id", "2 as tokens", "3 as shard"), "")
        assert out.count() >= 4, name


def test_all_are_registered():
    names = list(entry.queries())
    assert "pipeline" in names and [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 11)]
