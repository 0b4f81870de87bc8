import pytest
from pyspark.sql import functions as F

from wordkiln import resources as R
from wordkiln.functions import regex
from wordkiln.functions import text as X


def run(spark, rows, column):
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r.o for r in d.select("i", column(F.col("t")).alias("o")).orderBy("i").collect()]


NORMALISED = [("шо там", "що там"), ("пофікси баг", "виправ помилка"), ("шо?", "що?"), ("крч", ""), ("", ""), ("слово  слово", "слово слово"), ("«Шо»,", "«що»,"), ("...", "..."), ("п’ять", "п'ять")]


@pytest.mark.parametrize("given, want", NORMALISED)
def test_normalize(spark, given, want):
    assert run(spark, [given], X.normalize) == [want]


def test_normalized_reports_what_it_did(spark):
    (r,) = run(spark, ["да ладно, шо за баг"], X.normalized)
    assert (r.text, r.replacements_made, r.changed) == ("та годі, що за помилка", 3, True)
    (r,) = run(spark, ["усе  добре"], X.normalized)
    assert r.changed and r.text == "усе добре"


def test_normalising_twice_changes_nothing(spark):
    once = run(spark, [a for a, _ in NORMALISED], X.normalize)
    assert run(spark, once, X.normalize) == once


def test_compress(spark):
    rows = ["це дуже важливе завдання", "   ", "я думаю що тест тест Тест, так", "дуже, важливо", ", привіт ;", "слово ,  друге ;; третє", None]
    assert run(spark, rows, X.compress) == ["це важливе завдання", "   ", "тест Тест, так", "дуже, важливо", "привіт", "слово, друге, третє", None]


def test_transliterate(spark):
    assert run(spark, ["Щука", "їжак", "День", "API 5", "Юля"], X.transliterate) == ["SHCHuka", "yizhak", "Den", "API 5", "YUlya"]


def test_translate_by_the_seed(spark):
    rows = ["привіт", "як справи", "тест", "API endpoint", "не працює сервер!", " "]
    assert run(spark, rows, lambda c: X.translate(c, R.seed_lexicon())) == ["hi", "how?", "test", "API endpoint", "broken server!", " "]


def test_reverse_translate(spark):
    d = {"error": "помилка", "thank you": "дякую", "server": "сервер"}
    rows = ["The error is fixed", "Thank you, Kubernetes server.", "not a server", ""]
    assert run(spark, rows, lambda c: X.reverse_translate(c, d)) == ["помилка fixed", "дякую, Kubernetes сервер.", "не сервер", ""]
    assert run(spark, ["abc слово", "", "слово"], X.untranslated_ratio) == [0.5, 0.0, 0.0]


GUARD = [
    ("Привіт, як справи", True), ("Hello there friend", False), (None, False), ("  ", False), ('{"a": 1}', False), ("[1, 2]", False), ("def f(): привіт", False),
    ("текст\nimport os тут", False), ("12345 !!!", True), ("деплой на prod сервер", True), ("класс def", True),
]


def test_guard(spark):
    assert run(spark, [g for g, _ in GUARD], X.should_process) == [w for _, w in GUARD]
    assert run(spark, ['{"ключ": "значення"}'], lambda c: X.should_process(c, skip=())) == [True]


def test_sentences(spark):
    assert run(spark, ["Один. Два! Три? 1.5 раза"], X.split_sentences) == [["Один.", "Два!", "Три?", "1.5 раза"]]
    assert run(spark, ["Hello world. How are you?", "Price is 1.5 dollars.", "Hmm... OK.", "Line one\nLine two", ""], X.complete_sentences) == [
        ["Hello world.", " How are you?"], ["Price is 1.5 dollars."], ["Hmm...", " OK."], ["Line one\n", "Line two"], [],
    ]


def test_answers(spark):
    assert run(spark, ["yes", " Так. ", "TRUE!", "1", "no", "yes indeed", None], X.yes_no) == [True, True, True, True, False, False, False]
    got = run(spark, ['Sure: {"name": "Оля", "age": "7"} ok', "null", "{bad", "nothing"], lambda c: X.extracted(c, {"name": str, "age": int}))
    assert (got[0].name, got[0].age) == ("Оля", 7) and got[1:] == [None] * 3


def test_regular_expressions_from_rules():
    assert regex.replacement(r"a\1$b\\") == r"a$1\$b\\"
    assert regex.jvm(r"(?P<x>a)") == "(?iuU)(?<x>a)"
    assert regex.word_pattern("a.b") == r"(?iuU)\ba\.b\b"


def test_rule_files(spark, tmp_path):
    p = tmp_path / "rules.json"
    p.write_text('{"replacements": [{"from": "йой", "to": null}, {"from": "та ну", "to": "ні", "ngram": 2}], "patterns": [{"regex": "(\\\\d+) ?шт", "to": "\\\\1 штук"}]}', encoding="utf-8")
    r = R.from_json(spark, str(p))
    assert run(spark, ["Йой, та ну 5шт"], lambda c: X.normalize(c, r)) == ["ні 5 штук"]
    again = R.from_tables(R.rules_table(spark, r), R.patterns_table(spark, r))
    assert again.words() == r.words() and [x.regex for x in again.patterns] == [x.regex for x in r.patterns]
    with pytest.raises(ValueError):
        X.normalized(F.lit("x"), R.Resources(rules=[R.Rule(f"w{i}", "x") for i in range(6000)]))
