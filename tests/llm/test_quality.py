import duckdb

from wordkiln.llm import quality as Q

GOOD = "The river runs to the sea and it is wide. " * 3 + "\n" + "There was a boat on the water for all of the people that came by. "


def test_rules_against_each_kind(spark, documents):
    rows = [(0, GOOD), (1, "*** &&& " * 40), (2, "BUY NOW!! " * 30), (3, "same line here\n" * 40), (4, "word " * 200), (5, "Fine."), (6, "zxq vbn " * 40 + " ".join(f"q{i}" for i in range(60)))]
    got = {r.doc_id: r.broken for r in Q.report(documents(rows)).collect()}
    assert got[0] == "" and got[5] == ""
    assert "special_symbols" in got[1] and "upper_case" in got[2] and "repeated_lines" in got[3] and "distinct_words" in got[4] and "stop_words" in got[6]


def test_matches_sql(spark, data):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{data}/documents.parquet'")
    want = {r[0]: r[1:] for r in c.sql(f"select doc_id, stop_word_ratio, words_per_line, broken, keep from ({Q.sql()})").fetchall()}
    got = {r.doc_id: (r.stop_word_ratio, r.words_per_line, r.broken, r.keep) for r in Q.report(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    assert got == want


def test_is_one_projection(spark, data):
    plan = Q.report(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_awkward(awkward, documents):
    got = Q.report(awkward).collect()
    assert len(got) == awkward.count()
    assert all(r.broken == "too_short" for r in got if r.doc_id in (1, 2, 3))
    assert Q.report(documents([])).count() == 0
    clash = awkward.selectExpr("*", "1 as _m", "2 as n_words", "3 as _broken")
    assert Q.accepted(clash).columns == clash.columns
    assert {r.doc_id for r in Q.accepted(clash).collect()} >= {4, 5}
    assert sorted(map(str, Q.accepted(clash).collect())) == sorted(map(str, (r for r in clash.collect() if r.doc_id in (4, 5) or r.text and "number" in r.text)))


def test_accepted_measures_once(spark, data):
    """The filter stands above the projection of the measures instead of repeating them in every rule."""
    plan = Q.accepted(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in plan.splitlines() if "Filter" in x)
    assert "regexp_count" not in line
