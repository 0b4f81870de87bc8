import os

import duckdb
import pytest

from wordkiln.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def oracle(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, data, oracle, name):
    df = catalog.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(map(_plain, r)) for r in df.select(*columns).collect()), key=repr)
    rel = oracle.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(map(_plain, r)) for r in rel.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(e.queries())


def test_style_predict_trains_with_the_default_terms(spark, data, monkeypatch):
    import inspect

    from wordkiln.operators.stylemodel import FEATURES, StyleModel

    class Trained(Exception):
        pass

    def train(*args, **kwargs):
        bound = inspect.signature(real).bind(*args, **kwargs)
        bound.apply_defaults()
        raise Trained(bound.arguments["features"])

    real = StyleModel.train
    monkeypatch.setattr(StyleModel, "train", train)
    with pytest.raises(Trained) as e:
        catalog.queries()["style_predict"](spark, data)
    assert e.value.args == (FEATURES,)


@pytest.mark.parametrize("name, sign", [("normalize_full", "o/t"), ("compress_by_model", "o/t"), ("untranslated_ratio", "частина"), ("answers_with_fallback", "частина")])
def test_texts_are_rewritten_once(spark, data, name, sign):
    plan = catalog.queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(sign) == 1 and "Union" not in plan


def test_retrieval_reads_the_texts_for_figures_hits_and_results_only(spark, data):
    plan = catalog.queries()["retrieve_filter_extract"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("documents.parquet") + plan.count("Relation [") <= 3 and "Aggregate [term" not in plan
