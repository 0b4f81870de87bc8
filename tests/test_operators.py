import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordkiln import resources as R
from wordkiln.functions import text as X
from wordkiln.operators import chat, chunking, lexical, lexicon, providers, retrieval, stylemodel, tokens, vectors, vocab, words


def test_join_form_equals_expression_form(spark, data):
    from wordkiln.plans.catalog import RULES

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    a = words.normalize(docs, R.rules_table(spark, RULES).filter("ngram = 1"), RULES, out="n").select("doc_id", "n")
    b = docs.select("doc_id", X.normalize(F.col("text"), RULES).alias("n"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_translation_by_joins(spark):
    lex = spark.createDataFrame([("не працює зовсім", "dead"), ("не працює", "broken"), ("як справи", "how?"), ("сервер", "server"), ("порожнє", "")], "word string, en_compressed string")
    rows = [(1, "«Не працює», сервер!"), (2, "не, працює"), (3, "не працює зовсім сервери"), (4, "  "), (5, None), (6, "як справи як справи ok")]
    lemmas = spark.createDataFrame([("сервери", "сервер"), ("серверу", "сервер")], "form string, lemma string")
    got = {r.doc_id: r.english for r in words.translate_words(spark.createDataFrame(rows, "doc_id long, text string"), lex, lemmas=lemmas).collect()}
    assert got == {1: "«broken», server!", 2: "ne, pratsyuye", 3: "dead server", 4: "  ", 5: None, 6: "how? how? ok"}


def _shuffled(df):
    """What the parts of a plan that are shuffled hold, by their exchanges."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hash" in line or "Exchange Round" in line]


def test_words_are_joined_without_shuffling_tokens(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    lex = spark.createDataFrame([("of the", "OF"), ("on", "@")], "word string, en_compressed string")
    forms = spark.createDataFrame([("and", "&")], "form string, lemma string")
    rules = spark.createDataFrame([("and", "&", 0)], "word string, replacement string, ord int")
    for d in (words.translate_words(docs, lex), words.translate_words(docs, lex, lemmas=forms), words.replace_words(docs, rules), providers.lemmatize_table(docs, forms, "doc_id", "text", "l")):
        tokens = [x for x in _shuffled(d) if "_key" in x or "pos" in x]
        assert tokens == [] and sum("doc_id" in x for x in _shuffled(d)) == 1


def test_rows_of_one_key_and_of_none_are_translated_apart(spark):
    lex = spark.createDataFrame([("a b", "AB"), ("b c d", "BCD"), ("a", "1")], "word string, en_compressed string")
    rows = [(1, "a b c d", "x"), (1, "a a b", "y"), (None, "A b, a", "z"), (None, "b c d a b a b", "u"), (2, "", "v"), (2, None, "w"), (3, "b c b c d b", "t")]
    got = {r.tag: r.english for r in words.translate_words(spark.createDataFrame(rows, "doc_id long, text string, tag string"), lex).collect()}
    assert got == {"x": "1 BCD", "y": "1 AB", "z": "AB, 1", "u": "BCD AB AB", "v": "", "w": None, "t": "b c BCD b"}


def test_chunking(spark):
    def chunks(texts, least=50, most=300):
        d = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "source string, pos int, text string")
        return [r.text for r in chunking.chunks(d, least=least, most=most).orderBy("chunk").collect()]

    assert len(chunks(["a b", "c d", "e f"])) == 1
    assert len(chunks(["слово " * 400])) == 2 and chunks([" ".join("w" * 100)]) == [" ".join("w" * 100)]
    assert chunks(["", "  "]) == []
    assert chunks(["a b c", "d e f", "g"], 3, 10) == ["a b c", "d e f g"]
    packed = chunks(["One two three. Four five! Six seven eight nine ten eleven twelve. End."], 1, 5)
    assert packed == ["One two three. Four five!", "Six seven eight nine ten eleven twelve.", "End."]


def test_bm25_is_that_of_a_full_text_index(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table f using fts5(t, tokenize='unicode61')")
    c.executemany("insert into f(rowid, t) values (?, ?)", [(i + 1, t) for i, t in rows])
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for every, word in ((False, " OR "), (True, " AND ")):
        terms = ["tion", "ing", "of"] if not every else ["of", "ing"]
        want = c.execute("select rowid - 1, rank from f where f match ? order by rank, rowid limit 20", (word.join(f'"{t}"' for t in terms),)).fetchall()
        got = [(r.doc_id, r["rank"]) for r in lexical.search(d, terms, 20, every).orderBy("rank", "doc_id").collect()]
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-9)
    assert lexical.search(d, "", 5).count() == 0 and lexical.query_terms('п\'ять "Ab" x café') == ["п", "ять", "ab", "cafe"]


def test_vectors(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, [-1.0, 0.0], "a"), (4, [0.0, 0.0], "z"), (5, [1.0, 0.0], "a")], "vec_id long, embedding array<float>, text string")
    assert [(r.vec_id, r.score) for r in vectors.top_k(d, [1.0, 0.0], 5).collect()] == [(1, 1.0), (5, 1.0), (2, 0.0), (4, 0.0), (3, -1.0)]
    assert [r.vec_id for r in vectors.top_k(d, [1.0, 0.0], 5, distinct="text").collect()] == [1, 2, 4]
    t = spark.createDataFrame([("x", [1.0, 0.1]), ("none", [-0.5, -9.0])], "topic string, v array<float>")
    got = vectors.topics(d, t, 0.3).collect()
    assert {(r.topic, r.vec_id, r.place) for r in got} == {("x", 1, 1), ("x", 5, 2), ("none", None, None)}
    names = spark.createDataFrame([("one", 0, [1.0, 0.0]), ("two", 1, [0.0, 1.0])], "category string, ord int, v array<float>")
    assert {r.vec_id: r.category for r in vectors.nearest_name(d, names).collect()} == {1: "one", 2: "two", 3: "two", 4: "one", 5: "one"}
    assert vectors.parse_examples({"a": "x y z", "b": "x y, z", "c": ["p q"], "d": "one"}) == [("a", 0, "x"), ("a", 0, "y"), ("a", 0, "z"), ("b", 1, "x y"), ("b", 1, "z"), ("c", 2, "p q"), ("d", 3, "one")]


PARTS = "array<struct<type:string,text:string,payload:string>>"


def test_messages(spark):
    rows = [("user", "шо там", None), ("system", "шо там", None), ("assistant", "шо там", None), ("user", None, None), ("user", None, [("text", "шо", None), ("image", None, "p"), ("text", "plain english", None)]), ("user", None, [("tool_result", "шо", None)])]
    d = spark.createDataFrame(rows, f"role string, text string, parts {PARTS}")
    got = chat.rewrite_messages(d, X.normalize, parts="parts", squeeze_system=True).collect()
    assert [r.passes for r in got] == [True, True, False, False, True, False]
    assert got[0].rewritten == "що там" and got[2].rewritten == "шо там"
    assert [p.text for p in got[4].parts] == ["що", None, "plain english"] and got[5].parts[0].text == "шо"
    careful = chat.rewrite_messages(d, lambda c: F.upper(c), parts="parts", per_part_guard=True).collect()
    assert [p.text for p in careful[4].parts] == ["ШО", None, "plain english"]
    broken = chat.rewrite_messages(d, lambda c: F.lit(None).cast("string")).collect()
    assert broken[0].rewritten == "шо там"


def test_answers_fall_back(spark):
    d = spark.createDataFrame([(1, "The quantum error"), (2, "error"), (3, "blank please now")], "id int, text string")
    asked = lambda c: F.when(c.contains("blank"), " ").otherwise(F.concat(F.lit("LLM:"), c))
    got = {r.id: r.restored for r in chat.rewrite_answers(d, {"error": "помилка"}, translate=asked).collect()}
    assert got == {1: "LLM:The quantum error", 2: "помилка", 3: "blank please now"}


def test_savings(spark):
    d = spark.createDataFrame([(1, "a b c d", "a b"), (1, "x", "x"), (2, "", "")], "conv_id int, text string, rewritten string")
    assert {tuple(r) for r in chat.message_savings(d).collect()} == {(1, 5, 3, 40), (2, 0, 0, 0)}
    s = tokens.squeezed(spark.createDataFrame([("крч шо там там",), ("",)], "text string")).collect()
    assert (s[0].squeezed, s[0].tokens_saved, s[0].compression_ratio) == ("що там", {"words": 2}, 0.5) and s[1].compression_ratio is None


def test_retrieval(spark):
    rows = [(i, f"text {i} {'good' if i % 2 else 'bad'}", 1 - i / 100) for i in range(80)] + [(99, "text 1 good", 0.999)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score double")
    model = providers.KeywordModel({"n": r"text (\d+)"})
    yes = providers.as_column(lambda: lambda ts: model.classify(ts, "good"), "string")
    fields = providers.as_column(lambda: lambda ts: model.extract(ts, {"n": int}), "string")
    assert retrieval.prefilter_size(40) == 40 and retrieval.prefilter_size(2000) == 200 and retrieval.prefilter_size(10**5) == 500 and retrieval.prefilter_size(600, 7) == 7
    assert [r.doc_id for r in retrieval.retrieve(d, yes, k=6).collect()] == [99, 1, 3]
    assert [r.doc_id for r in retrieval.retrieve(d, None, strategy="filter", k=3).collect()] == [0, 99, 1]
    full = retrieval.retrieve(d, yes, strategy="full_scan", limit=100).collect()
    assert len(full) == 41 and {r.score for r in full} == {0.0}
    assert [r.n for r in retrieval.retrieve(d, yes, fields, {"n": int}, k=10).collect()] == [1, 3, 5, 7]
    with pytest.raises(ValueError):
        retrieval.retrieve(d, yes, strategy="other")


def test_vocabulary(spark):
    d = spark.createDataFrame([(1, "b a b c"), (2, "A c d"), (3, "")], "doc_id long, text string")
    v = vocab.build(d)
    assert [(r.word, r.id) for r in v.orderBy("id").collect()] == [("b", 4), ("a", 5), ("c", 6)]
    e = vocab.encode(d, v)
    assert {r.doc_id: r.ids for r in e.collect()} == {1: [1, 4, 5, 4, 6, 2], 2: [1, 5, 6, 3, 2], 3: [1, 2]}
    assert {r.doc_id: r.text for r in vocab.decode(e, v).collect()} == {1: "b a b c", 2: "a c <UNK>", 3: ""}


def test_windows(spark):
    d = spark.createDataFrame([(1, "один два три ok"), (2, "два три один"), (3, "plain words"), (4, "слово")], "doc_id long, text string")
    known = {"один два три": "one two three", "два три": "two three", "три один": "<UNK> <UNK>"}
    got = {r.doc_id: r.translated for r in vocab.translate_windows(d, providers.as_column(lambda: lambda ts: [known.get(t) for t in ts], "string")).collect()}
    assert got == {1: "one two three ok", 2: "two three один", 3: "plain words", 4: "слово"}


def test_style_model(spark, tmp_path):
    kinds = {"норм": "добрий день шановні колеги", "мем": "кринж рофл вайб лол", "суржик": "шо канєшно ладно понятно"}
    rows = [(f"{w} {i} {x}", k) for k, ws in kinds.items() for i, w in enumerate([ws, ws.upper(), ws[::1] + " ще"]) for x in ws.split()]
    d = spark.createDataFrame(rows, "text string, label string")
    m = stylemodel.StyleModel.train(d)
    m.save(str(tmp_path / "m"))
    for model in (m, stylemodel.StyleModel.load(str(tmp_path / "m"))):
        got = model.predict(spark.createDataFrame([("рофл кринж",), ("шановні колеги",)], "text string")).collect()
        assert [r.style for r in got] == ["мем", "норм"]
    p = m.probabilities(spark.createDataFrame([("рофл",)], "text string")).first().probabilities
    assert set(p) == set(kinds) and abs(sum(p.values()) - 1) < 0.01
    assert [r.needs for r in stylemodel.needs_normalizing(spark.createDataFrame([("шо",), ("ні",)], "text string")).collect()] == [True, False]
    with pytest.raises(RuntimeError):
        stylemodel.StyleModel().predict(d)


def test_providers(spark):
    d = spark.createDataFrame([("Сервери впали, ok",), ("",)], "text string")
    assert d.select(providers.lemmatize_text(F.col("text"), {"сервери": "сервер"}).alias("o")).first().o == "сервер впали , ok"
    assert d.select(providers.lemmatize_text(F.col("text"), {}).alias("o")).first().o == "Сервери впали, ok"
    v = d.select(providers.embedder()(F.col("text")).alias("v")).collect()
    assert abs(sum(x * x for x in v[0].v) - 1) < 1e-6 and not any(v[1].v)
    broken = providers.as_column(lambda: lambda ts: 1 / 0, "string")
    assert d.select(broken(F.col("text")).alias("o")).first().o is None
    with pytest.raises(ValueError):
        providers.LocalModel(backend="none")
    with pytest.raises(ConnectionError):
        providers.LocalModel(url="http://127.0.0.1:9", timeout=1).ask("x")


def test_token_counts_of_a_public_vocabulary(spark):
    import os

    ranks = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(ranks):
        pytest.skip("no vocabulary here")
    count = providers.token_counter(lambda: providers.TiktokenCounter(ranks))
    d = spark.createDataFrame([("крч hello world",), ("",)], "text string")
    r = tokens.token_stats(d, {"bpe": count}).collect()
    assert r[0].bpe > r[0].bpe_squeezed == 2 and r[0].savings_bpe_pct > 0 and r[1].savings_bpe_pct == 0.0


def test_lexicon_rebuild_keeps_other_sources(spark):
    rules = R.rules_table(spark, R.Resources(rules=[R.Rule("баг", "помилка")]))
    english = spark.createDataFrame([("помилка", "error")], "word string, en string")
    once = lexicon.build(rules, english)
    old = once.union(spark.createDataFrame([("своє", None, None, "", 1, False, "manual")], once.schema))
    assert {tuple(r) for r in lexicon.build(rules, english, old).collect()} == {tuple(r) for r in old.collect()}
    assert lexicon.dictionary(lexicon.reverse(once.withColumn("id", F.monotonically_increasing_id()))) == {"error": "помилка"}


def test_style_terms_are_counted_as_a_table(spark):
    rows = [("one two one", "a"), ("two three", "b"), ("one two", "a")]
    held = spark.createDataFrame([(t.split(), y) for t, y in rows], "__g array<string>, y string")
    assert stylemodel.StyleModel._counter(held, 2).vocabulary == ["one", "two"]
    assert stylemodel.StyleModel._counter(held, 9).vocabulary == ["one", "two", "three"]
