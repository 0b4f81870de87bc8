"""The registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import resources as R
from ..functions import text as X
from ..operators import chat, chunking, classify, lexical, lexicon, morphology, providers, retrieval, tokens, vectors, vocab, words
from ..operators.morphology import Morphology
from ..operators.stylemodel import StyleModel, needs_normalizing
from ..sources import files, store
from ..streaming.sentences import replay
from . import sqltext as S

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Rules that fire on the driver's texts, which aren't those the seed is made for.
RULES = R.Resources(
    rules=(R.Rule("of the", "o/t"), R.Rule("in the", "i/t"), R.Rule("de la", "d/l"), R.Rule("and", "&"), R.Rule("und", "&"), R.Rule("is", "be"), R.Rule("que", None), R.Rule("that", None)),
    patterns=(R.Pattern(r"[*#$%^~|]+", ""), R.Pattern(r"\s+([.,!?;:])", r"\1"), R.Pattern(r"\s{2,}", " ")),
    fillers=("this is", "for the", "dans le", "mit der"),
    intensifiers=("to", "a", "les", "der"),
)
DICTIONARY = {"of the": "частина", "with": "з", "on": "на", "this": "цей", "der": "той", "que": "що"}
_STOP_WORDS = ("the", "of", "and", "la", "der")
LEXICON = [("of the", "OF"), ("to", "2"), ("for", "4"), ("der", "DR"), ("la", "LA"), ("on", "@")]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return files.spread(_table(spark, d, "documents"))


def _inline(spark: SparkSession, rows: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rows)), "id long, t string")


def _values(rows: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({i}::BIGINT, {S.q(t)})" for i, t in enumerate(rows)) + ") v(id, t)"


_CYRILLIC = ["привіт, шо там?", "Щука й жаба", "ЇЖАК щодня їсть", "API endpoint", "п’ять", "об'єкт ЦЕ", "Ґанок; Юля — Яна", ""]


@query(f"SELECT id, {S.apostrophes('t')} AS folded FROM {_values(_CYRILLIC)} UNION ALL SELECT doc_id + 1000, {S.apostrophes('text')} FROM documents")
def apostrophe_fold(spark, d):
    a = _inline(spark, _CYRILLIC).select("id", X.fold_apostrophes(F.col("t")).alias("folded"))
    return a.unionByName(_docs(spark, d).select((F.col("doc_id") + 1000).alias("id"), X.fold_apostrophes(F.col("text")).alias("folded")))


@query(f"SELECT doc_id, len({S.tokens('text')})::BIGINT AS n_tokens FROM documents")
def tokenize_count(spark, d):
    return _docs(spark, d).select("doc_id", X.token_count(F.col("text")).alias("n_tokens"))


@query(
    f"""SELECT lang, count(*) AS n, sum(length({S.prefix("t")}))::BIGINT AS prefixes, sum(length({S.core("t")}))::BIGINT AS cores,
    count(DISTINCT lower({S.core("t")})) AS words FROM (SELECT lang, unnest({S.tokens("text")}) AS t FROM documents) GROUP BY lang"""
)
def punct_peel(spark, d):
    t = _docs(spark, d).select("lang", F.explode(X.tokens(F.col("text"))).alias("t")).select("lang", X.peel(F.col("t")).alias("p"))
    whole = F.when(F.col("p.core") == "", F.length("p.prefix")).otherwise(F.length("p.prefix"))
    return t.groupBy("lang").agg(F.count("*").alias("n"), F.sum(whole).alias("prefixes"), F.sum(F.length("p.core")).alias("cores"), F.countDistinct(F.lower("p.core")).alias("words"))


_PHRASES = [(r.word, r.replacement) for r in RULES.phrases()]


@query(f"SELECT doc_id, {S.phrases('text', _PHRASES)} AS text FROM documents")
def phrase_replace(spark, d):
    return _docs(spark, d).select("doc_id", X.replace_phrases(F.col("text"), RULES.phrases()).alias("text"))


@query(f"SELECT doc_id, {S.words('text', RULES.words())} AS text FROM documents")
def unigram_replace(spark, d):
    return _docs(spark, d).select("doc_id", X.replace_words(F.col("text"), RULES.words())[0].alias("text"))


@query(f"SELECT doc_id, {S.words('text', RULES.words())} AS text FROM documents")
def unigram_replace_join(spark, d):
    """The same by joining tokens to a rule table, as for tables too large for an expression."""
    rules = R.rules_table(spark, RULES).filter("ngram = 1")
    return words.replace_words(_table(spark, d, "documents"), rules, out="done").select("doc_id", F.col("done").alias("text"))


@query(f"SELECT doc_id, {S.patterns('text', RULES.patterns)} AS text FROM documents")
def pattern_cleanup(spark, d):
    return _docs(spark, d).select("doc_id", X.apply_patterns(F.col("text"), RULES.patterns)[0].alias("text"))


@query(f"SELECT doc_id, {S.normalize('text', RULES)} AS text, {S.normalize('text', RULES)} <> text AS changed FROM documents")
def normalize_full(spark, d):
    n = X.settled(_docs(spark, d).select("doc_id", F.col("text").alias("original")), "text", X.normalize(F.col("original"), RULES))
    return n.select("doc_id", "text", (F.col("text") != F.col("original")).alias("changed"))


_GOLDEN = [("шо там", "що там", 1), ("пофікси баг", "виправ помилка", 2), ("шо?", "що?", 1), ("крч", "", 1), ("", "", 0), ("слово  слово", "слово слово", 0), ("ну, давай зробимо", "давай зробимо", 1)]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {S.q(b)}, {n}::INTEGER, {a != b})" for i, (a, b, n) in enumerate(_GOLDEN)) + ") v(id, text, replacements_made, changed)")
def normalize_seed(spark, d):
    n = _inline(spark, [g[0] for g in _GOLDEN]).select("id", X.normalized(F.col("t")).alias("n"))
    return n.select("id", "n.text", "n.replacements_made", "n.changed")


@query(f"SELECT doc_id, {S.fillers('text', RULES.fillers)} AS text FROM documents")
def filler_phrases(spark, d):
    return _docs(spark, d).select("doc_id", X.remove_fillers(F.col("text"), RULES.fillers).alias("text"))


@query(f"SELECT doc_id, array_to_string({S.drop_words(S.tokens('text'), RULES.intensifiers)}, ' ') AS text FROM documents")
def drop_intensifiers(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(X.drop_intensifiers(X.tokens(F.col("text")), RULES.intensifiers), " ").alias("text"))


@query(f"SELECT doc_id, array_to_string({S.dedup('ts')}, ' ') AS text FROM (SELECT doc_id, {S.tokens('text')} AS ts FROM documents)")
def dedup_consecutive(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(X.dedup_consecutive(X.tokens(F.col("text"))), " ").alias("text"))


def _compressed(source: str, c: str) -> str:
    ts = S.drop_words(S.tokens(S.fillers(c, RULES.fillers)), RULES.intensifiers)
    done = S.cleanup(f"array_to_string({S.dedup('ts')}, ' ')")
    return f"SELECT *, CASE WHEN {S.strip(c)} = '' THEN {c} ELSE {done} END AS compressed FROM (SELECT *, {ts} AS ts FROM {source})"


@query(f"SELECT doc_id, compressed AS text FROM ({_compressed('documents', 'text')})")
def compress_full(spark, d):
    return _docs(spark, d).select("doc_id", X.compress(F.col("text"), RULES).alias("text"))


@query(f"SELECT id, {S.transliterate('t')} AS latin FROM {_values(_CYRILLIC)}")
def transliterate(spark, d):
    return _inline(spark, _CYRILLIC).select("id", X.transliterate(F.col("t")).alias("latin"))


_TRANSLATED = [("привіт", "hi"), ("як справи", "how?"), ("тест", "test"), ("API endpoint", "API endpoint"), ("помилка, сервер!", "error, server!"), ("не працює Щука", "broken SHCHuka"), ("  ", "  ")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {S.q(b)})" for i, (_, b) in enumerate(_TRANSLATED)) + ") v(id, english)")
def translate_seed(spark, d):
    return _inline(spark, [a for a, _ in _TRANSLATED]).select("id", X.translate(F.col("t"), R.seed_lexicon()).alias("english"))


_SINGLE = {a: b for a, b in LEXICON if " " not in a}


def _translated_sql(single: dict[str, str]) -> str:
    return f"""WITH t AS (SELECT doc_id, unnest({S.tokens("text")}) AS t, generate_subscripts({S.tokens("text")}, 1) AS pos FROM documents),
    p AS (SELECT *, {S.prefix("t")} AS pre, {S.core("t")} AS c, {S.suffix("t")} AS suf FROM t),
    n AS (SELECT *, lower(c) = 'of' AND suf = '' AND lead(lower(c)) OVER w = 'the' AND lead(pre) OVER w = '' AS starts, lead(suf) OVER w AS tail FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    m AS (SELECT *, lag(starts) OVER (PARTITION BY doc_id ORDER BY pos) AS inside FROM n)
    SELECT doc_id, coalesce(string_agg(CASE WHEN starts THEN pre || 'OF' || tail WHEN inside THEN NULL WHEN c = '' THEN t
      ELSE CASE lower(c) {" ".join(f"WHEN {S.q(a)} THEN pre || {S.q(b)} || suf" for a, b in single.items())} ELSE t END END, ' ' ORDER BY pos), '') AS english FROM m GROUP BY doc_id
    UNION ALL SELECT doc_id, text FROM documents WHERE len({S.tokens("text")}) = 0"""


@query(_translated_sql(_SINGLE))
def translate_words(spark, d):
    return words.translate_words(_table(spark, d, "documents"), spark.createDataFrame(LEXICON, "word string, en_compressed string")).select("doc_id", "english")


_LEXICON_ROWS = [
    (1, "баг", "помилка", "error"), (2, "глюк", "помилка", "error"), (3, "хиба", "хиба", "Error"), (4, "привіт", None, "hi"), (5, "вітаю", None, "hi"),
    (6, "чао", None, "hi"), (7, "тикet", None, "ticket"), (8, "сервер", None, None), (9, "х", "mixйа", "odd"), (10, "щось", "", "odd"), (11, "пусто", "", ""),
]


@query("SELECT * FROM (VALUES ('error', 'помилка'), ('hi', 'чао'), ('ticket', 'тикet'), ('odd', 'щось')) v(en, word)")
def reverse_dictionary(spark, d):
    return lexicon.reverse(spark.createDataFrame(_LEXICON_ROWS, "id long, word string, normalized string, en_compressed string"))


_BACK: dict[str, str | None] = {k: v for k, v in DICTIONARY.items() if " " not in k} | {k: v or None for k, v in R.function_words().items()} | dict.fromkeys(R.ARTICLES)
_BACK_SQL = f"CASE WHEN {S.strip('text')} = '' THEN text ELSE {S.words(S.phrases('text', [(k, v) for k, v in DICTIONARY.items() if ' ' in k]), _BACK, R.PEELED_REVERSE)} END"


@query(f"SELECT doc_id, {_BACK_SQL} AS text FROM documents")
def reverse_translate(spark, d):
    return _docs(spark, d).select("doc_id", X.reverse_translate(F.col("text"), DICTIONARY).alias("text"))


_FOREIGN = f"regexp_matches({S.core('t', R.PEELED_REVERSE)}, '^[A-Za-z]') AND NOT regexp_matches({S.core('t', R.PEELED_REVERSE)}, '[а-яіїєґА-ЯІЇЄҐ]')"


@query(
    f"""WITH b AS MATERIALIZED (SELECT doc_id, {_BACK_SQL} AS back FROM documents), t AS (SELECT doc_id, unnest({S.tokens("back")}) AS t FROM b),
    n AS (SELECT doc_id, round(count(*) FILTER ({_FOREIGN}) / count(*)::DOUBLE, 6) AS ratio FROM t GROUP BY doc_id)
    SELECT doc_id, coalesce(ratio, 0.0) AS ratio FROM b LEFT JOIN n USING (doc_id)"""
)
def untranslated_ratio(spark, d):
    back = X.settled(_docs(spark, d), "back", X.reverse_translate(F.col("text"), DICTIONARY))
    return back.select("doc_id", F.round(X.untranslated_ratio(F.col("back")), 6).alias("ratio"))


_RULE_ROWS = [("Баг", "помилка", 0, "it", 0), ("крч", None, 1, "filler", 1), ("не понятно", "не зрозуміло", 0, "", 2), ("баг", "хиба", 1, "it", 3)]
_EN_ROWS = [("хиба", "error"), ("привіт", "hi"), ("добрий день", "hi"), ("сервер", "server")]
_OLD_ROWS = [("сервер", None, None, "", 1, False, "opus"), ("файл", None, "file", "", 1, False, "manual"), ("старе", None, "old", "", 1, False, "mapper"), ("крч", "x", "y", "", 1, False, "opus")]


@query(
    """SELECT * FROM (VALUES ('баг', 'хиба', 'error', 'it', 1, false, 'replacements'), ('крч', NULL, NULL, 'filler', 1, true, 'replacements'),
    ('не понятно', 'не зрозуміло', NULL, '', 2, false, 'replacements'), ('сервер', NULL, 'server', '', 1, false, 'opus'), ('файл', NULL, 'file', '', 1, false, 'manual'),
    ('хиба', NULL, 'error', 'en_only', 1, false, 'mapper'), ('привіт', NULL, 'hi', 'en_only', 1, false, 'mapper'), ('добрий день', NULL, 'hi', 'en_only', 2, false, 'mapper'))
    v(word, normalized, en_compressed, type, ngram, is_filler, source)"""
)
def lexicon_build(spark, d):
    rules = spark.createDataFrame(_RULE_ROWS, "word string, replacement string, ngram int, kind string, ord int")
    old = spark.createDataFrame(_OLD_ROWS, "word string, normalized string, en_compressed string, type string, ngram int, is_filler boolean, source string")
    return lexicon.build(rules, spark.createDataFrame(_EN_ROWS, "word string, en string"), old)


_SQUEEZED = f"SELECT *, CASE WHEN {S.strip('text')} = '' THEN text ELSE compressed END AS squeezed FROM ({_compressed(f'(SELECT *, {S.normalize('text', RULES)} AS nt FROM documents)', 'nt')})"


@query(
    f"""SELECT lang, count(*) AS n, sum(a)::BIGINT AS words_before, sum(b)::BIGINT AS words_after, CASE WHEN sum(a) > 0 THEN round_even((1 - sum(b) / sum(a)::DOUBLE) * 100, 1) ELSE 0.0 END AS pct_saved
    FROM (SELECT lang, len({S.tokens("text")}) AS a, len({S.tokens("squeezed")}) AS b FROM ({_SQUEEZED})) GROUP BY lang"""
)
def token_savings_by_lang(spark, d):
    """Normalised and compressed, words before and after by language."""
    return tokens.savings(_docs(spark, d).withColumn("squeezed", tokens.squeeze(F.col("text"), RULES)), ["lang"])


@query(f"SELECT conv_id, turn, role, role IN ('user', 'system') AND {S.should_process('text')} AS passes FROM conversations")
def guard_messages(spark, d):
    c = _table(spark, d, "conversations")
    return c.select("conv_id", "turn", "role", chat.message_passes(F.col("role"), F.col("text"), squeeze_system=True).alias("passes"))


_GUARDED = f"SELECT doc_id, {S.should_process('text')} AS passes FROM documents"


@query(_GUARDED)
def guard_documents(spark, d):
    return _docs(spark, d).select("doc_id", X.should_process(F.col("text")).alias("passes"))


@query(
    f"""WITH g AS (SELECT conv_id, turn, role, text, role = 'user' AND {S.should_process("text")} AS passes FROM conversations)
    SELECT conv_id, turn, role, passes, CASE WHEN passes THEN {S.normalize("text", RULES)} WHEN role = 'assistant' THEN {_BACK_SQL} ELSE text END AS text FROM g"""
)
def rewrite_conversations(spark, d):
    """User messages that pass are normalised, answers turned back."""
    c = chat.rewrite_messages(_table(spark, d, "conversations"), lambda t: X.normalize(t, RULES))
    back = X.reverse_translate(F.col("text"), DICTIONARY)
    return c.select("conv_id", "turn", "role", "passes", F.when(F.col("role") == "assistant", back).otherwise(F.col("rewritten")).alias("text"))


@query(
    f"""WITH w AS (SELECT conv_id, len({S.tokens("text")}) AS a, len({S.tokens(S.normalize("text", RULES))}) AS b FROM conversations)
    SELECT conv_id, sum(a)::BIGINT AS words_before, sum(b)::BIGINT AS words_after, CASE WHEN sum(a) > 0 THEN round_even((sum(a) - sum(b)) / sum(a)::DOUBLE * 100, 0)::BIGINT ELSE 0 END AS pct_saved FROM w GROUP BY conv_id"""
)
def message_savings(spark, d):
    c = _table(spark, d, "conversations").withColumn("rewritten", X.normalize(F.col("text"), RULES))
    return chat.message_savings(c)


@query(f"SELECT doc_id, unnest({S.sentences('text')}) AS sentence, generate_subscripts({S.sentences('text')}, 1) - 1 AS pos FROM documents")
def sentence_split(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(X.split_sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


_LINES = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, t FROM (SELECT doc_id, i, {S.strip('l')} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE t <> ''"


@query(f"SELECT doc_id, (pos - 1)::BIGINT AS pos, t AS text FROM ({_LINES})")
def paragraphs(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(files.lines(F.col("text"))).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))


@query(
    f"""WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, pos, t, len({S.tokens("t")}) AS n FROM ({_LINES})),
    f AS (SELECT doc_id, pos, t, n, n AS held, 0 AS grp FROM l WHERE pos = 1
      UNION ALL SELECT l.doc_id, l.pos, l.t, l.n, CASE WHEN f.held >= 30 THEN l.n ELSE f.held + l.n END, f.grp + (f.held >= 30)::INT FROM f JOIN l ON l.doc_id = f.doc_id AND l.pos = f.pos + 1),
    g AS (SELECT doc_id, grp, sum(n) AS n, max(grp) OVER (PARTITION BY doc_id) AS last FROM f GROUP BY doc_id, grp),
    m AS (SELECT f.doc_id, CASE WHEN g.n < 30 AND f.grp > 0 THEN f.grp - 1 ELSE f.grp END AS grp, string_agg(t, ' ' ORDER BY pos) AS text FROM f JOIN g USING (doc_id, grp) GROUP BY 1, 2),
    s AS MATERIALIZED (SELECT doc_id, grp, text, len({S.tokens("text")}) AS n, {S.sentences("text")} AS ss FROM m),
    u AS MATERIALIZED (SELECT doc_id, grp, k, x, len({S.tokens("x")}) AS n FROM (SELECT doc_id, grp, unnest(ss) AS x, generate_subscripts(ss, 1) AS k FROM s WHERE n > 60 AND len(ss) > 1)),
    p AS (SELECT doc_id, grp, k, x, n AS held, 0 AS part FROM u WHERE k = 1
      UNION ALL SELECT u.doc_id, u.grp, u.k, u.x, CASE WHEN p.held + u.n > 60 THEN u.n ELSE p.held + u.n END, p.part + (p.held + u.n > 60)::INT FROM p JOIN u ON u.doc_id = p.doc_id AND u.grp = p.grp AND u.k = p.k + 1),
    o AS (SELECT doc_id, grp, 0 AS part, text FROM s WHERE n <= 60
      UNION ALL SELECT doc_id, grp, i, array_to_string(({S.tokens("text")})[i * 60 + 1 : i * 60 + 60], ' ') FROM (SELECT doc_id, grp, text, unnest(range(0, ((n - 1) // 60) + 1)) AS i FROM s WHERE n > 60 AND len(ss) = 1)
      UNION ALL SELECT doc_id, grp, part, string_agg(x, ' ' ORDER BY k) FROM p GROUP BY doc_id, grp, part)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp, part) - 1 AS chunk, text FROM o"""
)
def chunk_merge_split(spark, d):
    l = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t"))
    c = chunking.chunks(l, "doc_id", "pos", "t", 30, 60)
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "text")


_HEADERS = [["id", "text", "label"], ["id", "note"], ["Назва", "Коментар"], ["BODY ", "x"], ["name", "message"]]


@query("SELECT * FROM (VALUES (0::BIGINT, 'text'), (1, NULL), (2, 'Коментар'), (3, 'BODY '), (4, 'message')) v(id, picked)")
def text_column_pick(spark, d):
    return spark.createDataFrame([(i, files.text_column(h)) for i, h in enumerate(_HEADERS)], "id long, picked string")


@query(f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({S.terms('text')}) AS term FROM documents) GROUP BY term, doc_id")
def postings(spark, d):
    return lexical.postings(_table(spark, d, "documents"))


@query(f"SELECT doc_id, len({S.terms('text')})::BIGINT AS n_terms FROM documents")
def doc_lengths(spark, d):
    return lexical.lengths(_docs(spark, d))


_TERMS = ["tion", "ing", "auf", "plus"]


def _bm25(terms: list[str], every: bool, limit: int) -> str:
    names = ", ".join(map(S.q, terms))
    return f"""WITH l AS (SELECT doc_id, text, {S.terms("text")} AS ts FROM documents),
    a AS (SELECT count(*)::DOUBLE AS n_docs, avg(len(ts)) AS avg_len FROM l),
    h AS (SELECT doc_id, text, t.term, len(list_filter(ts, lambda x: x = t.term))::DOUBLE AS f, len(ts) AS n FROM l, (SELECT unnest([{names}]) AS term) t WHERE list_contains(ts, t.term)),
    i AS (SELECT term, CASE WHEN ln((n_docs - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) > 0 THEN ln((n_docs - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END AS idf FROM h, a GROUP BY term, n_docs),
    r AS (SELECT doc_id, any_value(text) AS text, -sum(idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / avg_len))) AS rank FROM h JOIN i USING (term), a GROUP BY doc_id {f"HAVING count(*) = {len(terms)}" if every else ""})
    SELECT doc_id, rank, text FROM r ORDER BY rank, doc_id LIMIT {limit}"""


@query(f"SELECT doc_id, round(rank, 6) AS rank FROM ({_bm25(_TERMS, False, 20)})")
def bm25_or(spark, d):
    return lexical.search(_docs(spark, d), _TERMS, 20).select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"SELECT doc_id, round(rank, 6) AS rank FROM ({_bm25(['of', 'tion', 'ing'], True, 20)})")
def bm25_and(spark, d):
    return lexical.search(_docs(spark, d), ["of", "tion", "ing"], 20, every=True).select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"SELECT doc_id, round(-rank, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY rank, doc_id) AS rn FROM ({_bm25(_TERMS, False, 30)})) WHERE rn = 1 ORDER BY rank, doc_id LIMIT 10")
def lexical_topk_dedup(spark, d):
    return lexical.top_texts(_docs(spark, d), _TERMS, 10).select("doc_id", F.round("score", 6).alias("score"))


_FIRST = "(SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)"


@query(f"SELECT vec_id, round({S.cosine('embedding', 'q')}, 6) AS score FROM embeddings, {_FIRST} ORDER BY {S.cosine('embedding', 'q')} DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    e = _table(spark, d, "embeddings")
    return vectors.top_k(e, e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q")), 10).select("vec_id", F.round("score", 6).alias("score"))


_PICKED = "SELECT * FROM (SELECT vec_id, embedding AS v, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= {}"


def _examples(e: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    return e.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"), F.col("label").alias("ord"), F.col("embedding").alias("v"))


@query(
    f"""WITH t AS (SELECT 'c' || label AS topic, v FROM ({_PICKED.format(1)})), p AS (SELECT topic, vec_id, {S.cosine("embedding", "v")} AS score FROM embeddings, t),
    k AS (SELECT topic, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY topic ORDER BY score DESC, vec_id)::INT AS place FROM p WHERE score >= 0.3)
    SELECT t.topic, vec_id, score, place FROM t LEFT JOIN k USING (topic)"""
)
def topic_threshold(spark, d):
    e = _table(spark, d, "embeddings")
    t = vectors.topics(e, _examples(e, 1).select(F.col("category").alias("topic"), "v"), 0.3)
    return t.select("topic", "vec_id", F.round("score", 6).alias("score"), "place")


@query(f"SELECT vec_id, category, round(s, 6) AS confidence FROM (SELECT vec_id, 'c' || label AS category, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS rn FROM (SELECT e.vec_id, n.label, {S.cosine('e.embedding', 'n.v')} AS s FROM embeddings e, ({_PICKED.format(1)}) n)) WHERE rn = 1")
def nearest_name(spark, d):
    e = _table(spark, d, "embeddings")
    return vectors.nearest_name(e, _examples(e, 1)).select("vec_id", "category", F.round("confidence", 6).alias("confidence"))


@query(f"SELECT vec_id, category, round(s, 6) AS confidence FROM (SELECT vec_id, 'c' || label AS category, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS rn FROM (SELECT e.vec_id, n.label, avg({S.cosine('e.embedding', 'n.v')}) AS s FROM embeddings e, ({_PICKED.format(3)}) n GROUP BY e.vec_id, n.label)) WHERE rn = 1")
def nearest_examples(spark, d):
    e = _table(spark, d, "embeddings")
    return vectors.nearest_examples(e, _examples(e, 3)).select("vec_id", "category", F.round("confidence", 6).alias("confidence"))


@query("SELECT min(doc_id) AS doc_id, lang, source, text FROM documents GROUP BY lang, source, text")
def content_dedup(spark, d):
    return retrieval.distinct_fields(_docs(spark, d), ["lang", "source", "text"], "doc_id").select("doc_id", "lang", "source", "text")


@query(
    f"""WITH c AS (SELECT doc_id, text, -rank AS score FROM ({_bm25(_TERMS, False, 100)})),
    y AS (SELECT * FROM c WHERE regexp_matches(text, '(?i)the')), x AS (SELECT regexp_extract(text, '([A-Z][a-z]+)', 1) AS name, length(text)::BIGINT AS size, score, doc_id FROM y)
    SELECT name, size FROM (SELECT *, row_number() OVER (PARTITION BY name, size ORDER BY score DESC, doc_id) AS rn FROM x) WHERE rn = 1 ORDER BY score DESC, doc_id LIMIT 50"""
)
def retrieve_filter_extract(spark, d):
    """A keyword model classifies the best hundred texts and extracts two fields."""
    hits = lexical.search(_docs(spark, d), _TERMS, 100).select("doc_id", "text", (-F.col("rank")).alias("score"))
    answer = lambda t: F.when(t.rlike("(?i)the"), F.lit(" Yes. ")).otherwise(F.lit("no"))
    object_ = lambda t: F.concat(F.lit("Sure: "), F.to_json(F.struct(F.regexp_extract(t, "([A-Z][a-z]+)", 1).alias("name"), F.length(t).alias("size"))), F.lit(" done"))
    return retrieval.retrieve(hits, answer, object_, {"name": str, "size": int}, k=100)


@query("SELECT event_id, props->>'$.k' AS k FROM (SELECT event_id, props FROM events)")
def json_extract_answer(spark, d):
    e = _table(spark, d, "events").withColumn("answer", F.concat(F.lit("Here it is: "), "props", F.lit(" ok")))
    return e.select("event_id", X.extracted(F.col("answer"), {"k": str})["k"].alias("k"))


_VOCAB = f"""SELECT word, n, (row_number() OVER (ORDER BY n DESC, first_doc, first_pos) + 3)::BIGINT AS id FROM (
    SELECT word, count(*) AS n, arg_min(doc_id, doc_id * 1000000 + pos) AS first_doc, min(doc_id * 1000000 + pos) AS first_pos FROM (
    SELECT doc_id, unnest({S.tokens("lower(text)")}) AS word, generate_subscripts({S.tokens("lower(text)")}, 1) AS pos FROM documents) GROUP BY word) WHERE n >= 2"""


@query(_VOCAB)
def vocab_build(spark, d):
    return vocab.build(_docs(spark, d))


@query(
    f"""WITH v AS ({_VOCAB}), t AS (SELECT doc_id, unnest(({S.tokens("lower(text)")})[1:62]) AS word, generate_subscripts(({S.tokens("lower(text)")})[1:62], 1) AS pos FROM documents)
    SELECT doc_id, '1,' || string_agg(coalesce(id, 3)::VARCHAR, ',' ORDER BY pos) || ',2' AS ids FROM t LEFT JOIN v USING (word) GROUP BY doc_id
    UNION ALL SELECT doc_id, '1,2' FROM documents WHERE len({S.tokens("text")}) = 0"""
)
def encode_ids(spark, d):
    docs = _docs(spark, d)
    return vocab.encode(docs, vocab.build(docs)).select("doc_id", F.array_join("ids", ",").alias("ids"))


@query(f"SELECT doc_id, {S.normalize('text', RULES)} <> text AS needs FROM documents")
def needs_normalizing_documents(spark, d):
    """Without a style model a text needs normalising where that changes it."""
    return needs_normalizing(_docs(spark, d), resources=RULES).select("doc_id", "needs")


@query(f"SELECT doc_id, array_to_string({S.drop_words(S.tokens('text'), _STOP_WORDS)}, ' ') AS text FROM documents")
def drop_stop_words(spark, d):
    return _docs(spark, d).select("doc_id", X.drop_stop_words(F.col("text"), _STOP_WORDS).alias("text"))


_BLANK_LINES = f"list_filter(list_transform(string_split_regex(regexp_replace(text, '[.] ', '.' || chr(10) || ' ' || chr(10), 'g'), '\\n{S.SP}*\\n'), lambda x: {S.strip('x')}), lambda x: x <> '')"


@query(f"SELECT doc_id, generate_subscripts(ps, 1) - 1 AS pos, unnest(ps) AS text FROM (SELECT doc_id, {_BLANK_LINES} AS ps FROM documents)")
def paragraphs_blank_lines(spark, d):
    """Paragraphs between blank lines, which are put after every full stop first."""
    p = files.paragraphs(F.regexp_replace("text", "[.] ", ".\n \n"))
    return _docs(spark, d).select("doc_id", F.posexplode(p).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))


def _saved(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 THEN round_even((1 - {b} / {a}::DOUBLE) * 100, 1) ELSE 0.0 END"


@query(
    f"""SELECT doc_id, words, words_squeezed, {_saved("words", "words_squeezed")} AS savings_words_pct, chars, chars_squeezed, {_saved("chars", "chars_squeezed")} AS savings_chars_pct
    FROM (SELECT doc_id, len({S.tokens("text")})::BIGINT AS words, len({S.tokens("squeezed")})::BIGINT AS words_squeezed, length(text)::BIGINT AS chars, length(squeezed)::BIGINT AS chars_squeezed FROM ({_SQUEEZED}))"""
)
def token_stats_two_counters(spark, d):
    counters = {"words": X.token_count, "chars": lambda c: F.length(c).cast("long")}
    return tokens.token_stats(_docs(spark, d), counters, resources=RULES).select("doc_id", *[f(n) for n in counters for f in (str, "{}_squeezed".format, "savings_{}_pct".format)])


@query(
    f"""SELECT doc_id, words_saved, CASE WHEN a > 0 THEN round(1 - b / a::DOUBLE, 3) END AS ratio FROM (SELECT doc_id, a, b, (a - b)::INTEGER AS words_saved
    FROM (SELECT doc_id, len({S.tokens("text")}) AS a, len({S.tokens("squeezed")}) AS b FROM ({_SQUEEZED})))"""
)
def squeeze_documents(spark, d):
    s = tokens.squeezed(_docs(spark, d), resources=RULES)
    return s.select("doc_id", F.col("tokens_saved")["words"].alias("words_saved"), F.col("compression_ratio").alias("ratio"))


@query(f"SELECT doc_id, CASE WHEN {S.strip('text')} = '' THEN text WHEN contains(nt, ' & ') THEN left(nt, 40) ELSE compressed END AS text FROM ({_compressed(f'(SELECT *, {S.normalize('text', RULES)} AS nt FROM documents)', 'nt')})")
def compress_by_model(spark, d):
    """A model that answers for some texts takes the place of the rules there."""
    model = lambda c: F.when(c.contains(" & "), F.left(c, F.lit(40)))
    return tokens.with_squeezed(_docs(spark, d), "squeezed", resources=RULES, compressor=model).select("doc_id", F.col("squeezed").alias("text"))


@query("SELECT vec_id, (4 * len(embedding))::INTEGER AS size, true AS same FROM embeddings")
def vector_codec(spark, d):
    b = _table(spark, d, "embeddings").select("vec_id", "embedding", vectors.to_bytes(F.col("embedding")).alias("b"))
    return b.select("vec_id", F.octet_length("b").alias("size"), (vectors.from_bytes(F.col("b")) == F.col("embedding").cast("array<float>")).alias("same"))


@query(
    f"""SELECT vec_id, round(score, 6) AS score, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn
    FROM (SELECT vec_id, label, {S.cosine("embedding", "q")} AS score FROM embeddings, {_FIRST})) WHERE rn = 1 ORDER BY score DESC, vec_id LIMIT 10"""
)
def vector_topk_distinct(spark, d):
    e = _table(spark, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return vectors.top_k(e, q, 10, distinct="label").select("vec_id", F.round("score", 6).alias("score"), "label")


@query("SELECT * FROM (VALUES ('a', 0, 'x'), ('a', 0, 'y'), ('b', 1, 'x y'), ('b', 1, 'z'), ('c', 2, 'p q'), ('d', 3, 'one')) v(category, ord, example)")
def example_parsing(spark, d):
    return spark.createDataFrame(vectors.parse_examples({"a": "x y", "b": "x y, z", "c": ["p q"], "d": "one"}), "category string, ord int, example string")


def _letters(c: str) -> str:
    return "[" + ", ".join(f"(length({c}) - length(replace({c}, '{x}', '')))::FLOAT" for x in "etaoin") + "]"


_CATEGORIES = ["the tea", "donation", "in a tent"]


@query(
    f"""WITH s AS (SELECT doc_id, squeezed AS text, {_letters("squeezed")} AS v FROM ({_SQUEEZED})),
    k AS (SELECT category, ord, {_letters("category")} AS c FROM (SELECT unnest([{", ".join(map(S.q, _CATEGORIES))}]) AS category, generate_subscripts([{", ".join(map(S.q, _CATEGORIES))}], 1) AS ord)),
    p AS (SELECT doc_id, text, category, ord, {S.cosine("v", "c")} AS score FROM s, k)
    SELECT doc_id, text, category, round(score, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS rn FROM p) WHERE rn = 1"""
)
def classify_squeezed(spark, d):
    """Squeezed texts by category, with counts of letters as vectors."""
    embed = lambda c: F.array(*[(F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("float") for x in "etaoin"])
    c = classify.classify(_docs(spark, d), _CATEGORIES, embed, True, RULES, "doc_id")
    return c.select("doc_id", "text", "category", F.round("confidence", 6).alias("confidence"))


def _with_parts(c: DataFrame) -> DataFrame:
    part = lambda kind, text, payload: F.struct(F.lit(kind).alias("type"), text.alias("text"), F.lit(payload).cast("string").alias("payload"))
    return c.withColumn("parts", F.array(part("image", F.lit(None).cast("string"), "p"), part("text", F.col("text"), None)))


@query(f"SELECT conv_id, turn, role IN ('user', 'assistant') AND {S.should_process('text')} AS passes FROM conversations")
def guard_message_parts(spark, d):
    c = _with_parts(_table(spark, d, "conversations"))
    return c.select("conv_id", "turn", chat.message_passes(F.col("role"), F.lit(None).cast("string"), F.col("parts"), ("user", "assistant")).alias("passes"))


_REWRITTEN = f"CASE WHEN {S.should_process('text')} THEN {S.normalize('text', RULES)} ELSE text END"


@query(f"SELECT conv_id, turn, {_REWRITTEN} AS system, 'image' AS first_type, {_REWRITTEN} AS block FROM conversations")
def rewrite_system_prompts(spark, d):
    """Every turn's text as a system prompt, once as a text and once as a block beside another that isn't text."""
    c = _with_parts(_table(spark, d, "conversations")).withColumnRenamed("text", "system")
    c = chat.rewrite_system(c, lambda t: X.normalize(t, RULES), "system", "parts")
    return c.select("conv_id", "turn", "system", F.col("parts")[0]["type"].alias("first_type"), F.col("parts")[1]["text"].alias("block"))


@query(
    f"""WITH b AS MATERIALIZED (SELECT doc_id, text, {_BACK_SQL} AS back FROM documents), t AS (SELECT doc_id, unnest({S.tokens("back")}) AS t FROM b),
    n AS (SELECT doc_id, count(*) FILTER ({_FOREIGN}) / count(*)::DOUBLE AS ratio FROM t GROUP BY doc_id)
    SELECT doc_id, CASE WHEN coalesce(ratio, 0.0) > 0.3 AND contains(text, 'the ') THEN 'T:' || text ELSE back END AS text FROM b LEFT JOIN n USING (doc_id)"""
)
def answers_with_fallback(spark, d):
    """Texts turned back; where much stays foreign a translator is asked, which gives blanks for some."""
    ask = lambda c: F.when(c.contains("the "), F.concat(F.lit("T:"), c)).otherwise(F.lit(" "))
    return chat.rewrite_answers(_docs(spark, d), DICTIONARY, translate=ask).select("doc_id", F.col("restored").alias("text"))


_HEADERS_GIVEN = {"x_title": "a", "authorization": "", "user_agent": "b"}


@query("SELECT * FROM (VALUES ('X-Title', 'a'), ('User-Agent', 'b')) v(name, value)")
def request_headers(spark, d):
    return spark.createDataFrame(list(chat.headers(**_HEADERS_GIVEN).items()), "name string, value string")


_LEMMAS = {"and": "la", "is": "on", "das": "der"}


@query(_translated_sql(_SINGLE | {f: _SINGLE[m] for f, m in _LEMMAS.items()}))
def translate_words_lemmas(spark, d):
    """Words that the dictionary lacks are translated by their lemmas."""
    lemmas = spark.createDataFrame(list(_LEMMAS.items()), "form string, lemma string")
    return words.translate_words(_table(spark, d, "documents"), spark.createDataFrame(LEXICON, "word string, en_compressed string"), lemmas=lemmas).select("doc_id", "english")


_FORMS = {"їсть": "їсти", "жаба": "жабка"}
_LEMMATIZED = "array_to_string(list_transform(regexp_extract_all(lower(t), '[а-яіїєґёʼ'']+|[^" + S.SP[1:] + "+'), lambda w: CASE w " + " ".join(f"WHEN {S.q(a)} THEN {S.q(b)}" for a, b in _FORMS.items()) + " ELSE w END), ' ')"


@query(f"SELECT id, {_LEMMATIZED} AS text FROM {_values(_CYRILLIC)} UNION ALL SELECT doc_id + 1000, {_LEMMATIZED} FROM (SELECT doc_id, text AS t FROM documents)")
def lemmatize(spark, d):
    t = _inline(spark, _CYRILLIC).unionByName(_docs(spark, d).select((F.col("doc_id") + 1000).alias("id"), F.col("text").alias("t")))
    return t.select("id", providers.lemmatize_text(F.col("t"), _FORMS).alias("text"))


_TABLE_FORMS = {"and": "&&", "der": "d", "of": "o"}
_BY_TABLE = f"CASE WHEN {S.core('t')} = '' THEN t ELSE {S.prefix('t')} || CASE {S.core('t')} " + " ".join(f"WHEN {S.q(a)} THEN {S.q(b)}" for a, b in _TABLE_FORMS.items()) + f" ELSE {S.core('t')} END || {S.suffix('t')} END"


@query(f"SELECT doc_id, array_to_string(list_transform({S.tokens('lower(text)')}, lambda t: {_BY_TABLE}), ' ') AS text FROM documents")
def lemmatize_join(spark, d):
    forms = spark.createDataFrame(list(_TABLE_FORMS.items()), "form string, lemma string")
    return providers.lemmatize_table(_table(spark, d, "documents"), forms, "doc_id", "text", "lemmas").select("doc_id", F.col("lemmas").alias("text"))


_MORPHOLOGY = Morphology([
    ("баг", "баг", "NOUN", frozenset("masc nomn sing".split())), ("багом", "баг", "NOUN", frozenset("masc ablt sing".split())),
    ("помилка", "помилка", "NOUN", frozenset("femn nomn sing".split())), ("помилкою", "помилка", "NOUN", frozenset("femn ablt sing".split())),
    ("помилку", "помилка", "NOUN", frozenset("femn accs sing".split())), ("помилці", "помилка", "NOUN", frozenset("femn loct sing".split())),
    ("виправ", "виправити", "VERB", frozenset("impr sing".split())), ("впав", "впасти", "VERB", frozenset("past masc sing".split())), ("впала", "впасти", "VERB", frozenset("past femn sing".split())),
])
_AGREED = [("in error, server", "у помилці, server"), ("fix the error!", "виправ помилку!"), ("error fell", "помилка впала"), ("  ", "  "), ("", "")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {S.q(b)})" for i, (_, b) in enumerate(_AGREED)) + ") v(id, text)")
def reverse_translate_agreed(spark, d):
    """Answers turned back with nouns and verbs in agreement."""
    words_of = {"in": "у", "error": "помилка", "fix": "виправ", "fell": "впав"}
    return morphology.reverse_translate(_inline(spark, [a for a, _ in _AGREED]), words_of, _MORPHOLOGY, "t", "text").select("id", "text")


_INFLECTED = [("з багом, тут", "з помилкою, тут"), ("баг впала", "помилка"), ("(Багом)", "(помилкою)"), ("впав", "")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {S.q(b)})" for i, (_, b) in enumerate(_INFLECTED)) + ") v(id, text)")
def normalize_by_lemma(spark, d):
    """Rules reach the other forms of their words, and their replacements take these forms."""
    rules = morphology.expanded(R.SEED.but(rules=(R.Rule("баг", "помилка"), R.Rule("впав", None))), _MORPHOLOGY)
    return _inline(spark, [a for a, _ in _INFLECTED]).select("id", X.normalize(F.col("t"), rules).alias("text"))


@query(
    f"""WITH v AS ({_VOCAB}), t AS (SELECT doc_id, unnest(({S.tokens("lower(text)")})[1:62]) AS word, generate_subscripts(({S.tokens("lower(text)")})[1:62], 1) AS pos FROM documents)
    SELECT doc_id, string_agg(CASE WHEN id IS NULL THEN '<UNK>' ELSE word END, ' ' ORDER BY pos) AS text FROM t LEFT JOIN v USING (word) GROUP BY doc_id
    UNION ALL SELECT doc_id, '' FROM documents WHERE len({S.tokens("text")}) = 0"""
)
def decode_ids(spark, d):
    """Texts encoded and decoded again: the words that a vocabulary holds."""
    docs = _docs(spark, d)
    v = vocab.build(docs)
    return vocab.decode(vocab.encode(docs, v), v)


_WINDOWS = [("один два три ok", "one two three ok"), ("два три один", "two three один"), ("plain words", "plain words"), ("слово", "слово")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {S.q(b)})" for i, (_, b) in enumerate(_WINDOWS)) + ") v(id, translated)")
def translate_windows(spark, d):
    known = {"один два три": "one two three", "два три": "two three", "три один": "<UNK> <UNK>"}
    ask = lambda c: F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), c)
    return vocab.translate_windows(_inline(spark, [a for a, _ in _WINDOWS]), ask, "id", "t").select("id", "translated")


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'kept' END, CASE source WHEN 'wiki' THEN 'encyclopedia' WHEN 'web' THEN 'crawl' END) AS corpus FROM documents")
def corpus_of_source(spark, d):
    raw = _docs(spark, d).withColumn("corpus", F.when(F.col("doc_id") % 3 == 0, "kept"))
    return store.with_corpus(raw, {"wiki": "encyclopedia", "web": "crawl"}).select("doc_id", "corpus")


@query()
def style_predict(spark, d):
    """A style model trained on the labelled documents, predicting all of them."""
    docs = _docs(spark, d)
    labelled = docs.join(_table(spark, d, "labels"), "doc_id").select("text", F.col("quality").cast("string").alias("label"))
    return StyleModel.train(labelled).predict(docs.select("doc_id", "text")).select("doc_id", "style")


_ENDS = f"""regexp_replace(regexp_replace(regexp_replace(text, '{S.SP}+$', ''), '(\\.\\.\\.|[A-Za-zА-Яа-яЄІЇєіїҐґ'')\"\\]][?!.])({S.SP}|$)', '\\1' || chr(1) || '\\2', 'g'), chr(10), chr(10) || chr(1), 'g')"""


@query(
    f"""SELECT conv_id || '/' || turn AS stream_id, (generate_subscripts(ss, 1) - 1)::INTEGER AS part, unnest(ss) AS sentence
    FROM (SELECT conv_id, turn, list_filter(string_split({_ENDS}, chr(1)), lambda x: x <> '') AS ss FROM conversations)"""
)
def stream_sentences(spark, d):
    """Every conversation turn as a stream of tokens, assembled to sentences."""
    c = _table(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("stream_id"), F.posexplode(F.regexp_extract_all("text", F.lit(r"\s*\S+"), F.lit(0))).alias("seq", "token"))
    return replay(c)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
