import duckdb
import pytest

from wordkiln.llm import template as T


def render(source, **names):
    return T.compiled(source)(names)[0]


@pytest.mark.parametrize(
    "source, want",
    [
        ("a{{ 1 + 2 * 3 }}b", "a7b"),
        ("{{ 'x' ~ 1 ~ none ~ true }}", "x1true"),
        ("{% for m in ms %}{{ loop.index }}{{ m.a }}{% if not loop.last %},{% endif %}{% endfor %}", "1p,2q"),
        ("{% if ms|length > 5 %}big{% elif ms[0].a == 'p' %}p{% else %}no{% endif %}", "p"),
        ("{% set x = 'A' %}{{ x|lower }}{{ y is defined }}{{ y|default('d') }}", "afalsed"),
        ("  {%- if true -%}  in  {%- endif -%}  ", "in"),
        ("{# no #}{{ 'b' in 'abc' and 'z' not in 'abc' }}", "true"),
        ("{{ 'yes' if ms else 'no' }}{{ ms.nothing.at.all }}", "yes"),
        (r"{{ 'a\n\'b' }}", "a\n'b"),
        ("{{ -2 + 5 }}{{ 7 % 4 }}", "33"),
    ],
)
def test_language(source, want):
    assert render(source, ms=[{"a": "p"}, {"a": "q"}]) == want


@pytest.mark.parametrize("source", ["{% if x %}", "{{ 1 + }}", "{% nope %}", "{{ x|nope }}", "{{ x() }}", "{% for in x %}{% endfor %}", "{{ x is odd2 }}", "{{ a b }}"])
def test_errors_are_found_when_parsed(source):
    with pytest.raises(T.TemplateError):
        T.parse(source)


def test_sandbox_reaches_nothing():
    assert render("{{ ''.__class__ }}{{ x.__class__ }}{{ x.keys }}", x={"a": 1}) == ""
    with pytest.raises(T.TemplateError):
        render("{{ raise_exception('stop') }}")


def test_constants_fold():
    node = T.fold(T.parse("a{{ 'b' + 'c' }}{% if 1 < 2 %}d{% else %}{{ x }}{% endif %}{{ 'E'|lower }}"))
    assert node == T.Node("block", (T.Node("text", ("abcde",)),))


def test_generation_spans():
    text, spans = T.compiled(T.CHATML)({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}, {"role": "assistant", "content": ""}]})
    assert [text[a:b] for a, b in spans] == ["yo<|im_end|>", "<|im_end|>"]


def test_matches_sql(spark, data):
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{data}/conversations.parquet'")
    d = T.rendered(spark.read.parquet(f"{data}/conversations.parquet"))
    got = sorted(tuple(r) for r in d.collect())
    assert got == sorted(c.sql(f"select {', '.join(d.columns)} from ({T.sql()})").fetchall())


def test_awkward(spark):
    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, None, None, None), (1, 1, "user", "a"), (None, 1, "user", "x"), (2, 1, "assistant", "y " * 50_000), (3, 1, "user", "")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as m", "2 as content", "3 as n_turns")
    got = {r.conv_id: r for r in T.rendered(t).collect()}
    assert set(got) == {1, 2, 3} and got[1].n_turns == 4 and got[1].text.index("\na<") < got[1].text.index("\nb<")
    assert got[2].n_generated == 100_010
    assert T.rendered(t.limit(0)).count() == 0
    bad = T.rendered(t, "{% if messages|length > 3 %}{{ raise_exception('long') }}{% endif %}x")
    assert {r.conv_id: (r.text, r.error) for r in bad.collect()} == {1: (None, "long"), 2: ("x", None), 3: ("x", None)}


def test_any_error_is_its_rows(spark):
    t = spark.createDataFrame([(1, 1, "user", "3"), (2, 1, "user", None)], "conv_id long, turn long, role string, text string")
    for source in ("{{ 4|first }}x", "{{ messages[0].content|join('-') }}"):
        assert all(r.error is None for r in T.rendered(t, source).collect())
    got = {r.conv_id: (r.text, r.error) for r in T.rendered(t, "{% if messages[0].content %}{{ 1 - messages[0].content }}{% endif %}x").collect()}
    assert got[1][0] is None and got[1][1] and got[2] == ("x", None)


@pytest.mark.parametrize("source", ["{{ x|replace('a') }}", "{{ x|trim(1) }}", "{{ raise_exception() }}", "{{ raise_exception('a', 'b') }}"])
def test_wrong_numbers_of_arguments_fail_when_parsed(source):
    with pytest.raises(T.TemplateError):
        T.parse(source)
