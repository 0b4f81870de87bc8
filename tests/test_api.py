from pyspark.sql import functions as F

from wordkiln import api
from wordkiln import resources as R
from wordkiln.operators import chat, providers, tokens, vectors
from wordkiln.operators.morphology import Morphology, expanded
from wordkiln.plans.catalog import _MORPHOLOGY
from wordkiln.sources.store import TextIndex


def test_functions_over_lists(spark, tmp_path):
    assert api.squeeze(spark, ["крч шо там там"]).first().squeezed == "що там"
    words = providers.token_counter(lambda: lambda ts: [len(t.split()) for t in ts])
    r = api.nibble(spark, ["крч шо там там"], {"w": words}).first()
    assert (r.w, r.w_squeezed, r.savings_w_pct) == (4, 2, 50.0)
    got = api.sniff(spark, ["шо за котик котик", "звіт"], ["котик", "звіт"], squeeze_first=True).orderBy("id").collect()
    assert [(r.text, r.category) for r in got] == [("що за котик", "котик"), ("звіт", "звіт")]
    got = api.sniff(spark, ["котик", "звіт"], {"a": "котик, пес", "b": ["звіт"]}).orderBy("id").collect()
    assert [r.category for r in got] == ["a", "b"] and got[1].confidence == 1.0
    assert {(r.topic, r.id) for r in api.sip(spark, ["котик", "звіт"], ["котик", "море"], 0.5).collect()} == {("котик", 0), ("море", None)}
    index = api.stir(spark, ["котик спить", "звіт готовий"], str(tmp_path / "i"), "s", providers.embedder(), least=1)
    assert api.mumble(index, "котик", 1).first().text == "котик спить"
    yes = providers.as_column(lambda: lambda ts: ["yes" if "звіт" in t else "no" for t in ts], "string")
    assert [r.text for r in api.brew(index, "звіт", yes).collect()] == ["звіт готовий"]


def test_index_by_lemmas_and_appending(spark, tmp_path):
    texts = ["багом покрито", "інше тут", "баг знову"]
    few = R.Resources(lemmas={"багом": "баг", "баги": "баг"})
    forms = spark.createDataFrame(list(few.lemmas.items()), "form string, lemma string")
    for i, index in enumerate((TextIndex(spark, str(tmp_path / "a"), resources=few), TextIndex(spark, str(tmp_path / "b"), resources=R.Resources(), forms=forms))):
        index.put(texts, "s", least=1)
        assert {r.text for r in index.search("баги").collect()} == {"багом покрито", "баг знову"}
        index.add(["баги теж", " "], "s").add(["баг новий"], "t")
        assert index.size() == 5 and {r.text for r in index.search("багом").collect()} == {"багом покрито", "баг знову", "баги теж", "баг новий"}, i
        index.put(["нове"], "s", least=1)
        assert index.size() == 2
    fresh = TextIndex(spark, str(tmp_path / "c")).add(["одне слово", "ще слово"], "s")
    assert fresh.size() == 2 and fresh.search("слово").count() == 2


def test_codec_keeps_nulls(spark):
    d = spark.createDataFrame([([1.5, -2.0],), (None,), ([],)], "v array<float>")
    b = d.select("v", vectors.to_bytes(F.col("v")).alias("b"))
    assert [r.b for r in b.collect()] == [b"\x00\x00\xc0?\x00\x00\x00\xc0", None, b""]
    assert [r.w for r in b.select(vectors.from_bytes(F.col("b")).alias("w")).collect()] == [[1.5, -2.0], None, []]


def test_models_by_provider(spark):
    d = spark.createDataFrame([(1, "In error, server"), (2, "")], "id int, text string")
    up = providers.as_column(lambda: lambda ts: [None if not t or "server" not in t else t.upper() for t in ts], "string")
    got = d.select(tokens.squeeze(F.col("text"), R.SEED, compressor=up).alias("o")).collect()
    assert [r.o for r in got] == ["IN ERROR, SERVER", ""]
    words = {"in": "у", "error": "помилка"}
    plain = {r.id: r.restored for r in chat.rewrite_answers(d, words, morphology=_MORPHOLOGY).collect()}
    assert plain == {1: "у помилці, server", 2: ""}
    asked = {r.id: r.restored for r in chat.rewrite_answers(d, words, morphology=_MORPHOLOGY, translate=up).collect()}
    assert asked == {1: "IN ERROR, SERVER", 2: ""}
    gone = providers.translator(lambda: providers.LocalModel(url="http://127.0.0.1:9", timeout=1))
    assert {r.id: r.restored for r in chat.rewrite_answers(d, words, translate=gone).collect()} == {1: "у помилка, server", 2: ""}


def test_rules_reach_other_forms(spark):
    rules = expanded(R.Resources(rules=[R.Rule("баг", "помилка"), R.Rule("багом", "своє")]), Morphology(_MORPHOLOGY.rows))
    assert rules.words() == {"баг": "помилка", "багом": "своє"}
    assert expanded(R.Resources(rules=[R.Rule("баг", None)]), _MORPHOLOGY).words() == {"баг": None, "багом": None}


def test_system_prompts(spark):
    kind = "array<struct<type:string,text:string,payload:string>>"
    d = spark.createDataFrame([("шо", [("text", "шо там", None), ("text", "plain english text", None), ("image", None, "p")]), (None, None)], f"system string, b {kind}")
    got = chat.rewrite_system(d, lambda c: F.upper(c), blocks="b").collect()
    assert got[0].system == "ШО" and [p.text for p in got[0].b] == ["ШО ТАМ", "plain english text", None] and got[1].system is None and got[1].b is None
