from pyspark.sql import functions as F

from wordkiln import resources as R
from wordkiln.operators import words
from wordkiln.operators.morphology import FORMS_SCHEMA, Morphology, agreed

FORMS = [
    ("баг", "баг", "NOUN", ["masc", "nomn", "sing"]), ("багом", "баг", "NOUN", ["masc", "ablt", "sing"]), ("баги", "баг", "NOUN", ["masc", "nomn", "plur"]),
    ("помилка", "помилка", "NOUN", ["femn", "nomn", "sing"]), ("помилкою", "помилка", "NOUN", ["femn", "ablt", "sing"]), ("помилки", "помилка", "NOUN", ["femn", "nomn", "plur"]),
    ("помилку", "помилка", "NOUN", ["femn", "accs", "sing"]), ("помилці", "помилка", "NOUN", ["femn", "loct", "sing"]),
    ("виправ", "виправити", "VERB", ["impr", "sing"]), ("впав", "впасти", "VERB", ["past", "masc", "sing"]), ("впала", "впасти", "VERB", ["past", "femn", "sing"]), ("впали", "впасти", "VERB", ["past", "plur"]),
    ("ховався", "ховатися", "VERB", ["past", "masc", "sing"]),
]


def test_agreement_and_inflection(spark):
    t = spark.createDataFrame(FORMS, FORMS_SCHEMA)
    m = Morphology.of(t)
    assert m.lemma("Багом") == "баг" and m.lemma("інше") == "інше"
    assert [m.like(w, "помилка") for w in ("багом", "баги", "дім")] == ["помилкою", "помилки", "помилка"]
    rows = [("у помилка, там",), ("виправ помилка!",), ("помилка впав",), ("помилки впав",), ("баг ховався",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(agreed(F.col("t"), m).alias("o")).collect()
    assert [r.o for r in got] == ["у помилці, там", "виправ помилку!", "помилка впала", "помилки впали", "баг ховався", None]


def test_rules_by_lemma(spark):
    t = spark.createDataFrame(FORMS, FORMS_SCHEMA)
    rules = R.rules_table(spark, R.Resources(rules=[R.Rule("баг", "помилка"), R.Rule("впала", None), R.Rule("баги", "гріхи")]))
    d = spark.createDataFrame([(1, "(Багом) баги впав тут"), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r.normalized for r in words.replace_words(d, rules, morphology=Morphology.of(t), forms=t).collect()}
    assert got == {1: "(помилкою) гріхи тут", 2: ""}
