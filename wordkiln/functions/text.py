"""Normalising, compressing, transliterating and testing texts, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import resources as R
from .regex import FLAGS, SPACE, jvm, quoted, replacement, word_pattern

_SPACES = f"(?U){SPACE}+"
#: Marks a word to be deleted in literal maps; no text holds it once split.
_GONE = "\u0000"
#: Maps up to this size are part of the expression; larger ones are joined (operators.words).
LITERAL_WORDS = 5000


def tokens(c: Column) -> Column:
    """Runs between white space; [] for blank, null for null."""
    return F.filter(F.split(c, _SPACES), lambda x: x != "")


def token_count(c: Column) -> Column:
    return F.coalesce(F.size(tokens(c)), F.lit(0)).cast("long")


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once, where f would repeat it for each element of an array."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def settled(df: DataFrame, out: str, c: Column) -> DataFrame:
    """df with column out, which later steps take as it is: Spark doesn't find a Python function whose argument, put in line,
    has a lambda in a lambda, and would compute an argument that several use again for each."""
    return df.withColumn(out, F.explode(F.array(c)))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def blank(c: Column) -> Column:
    return strip(c) == ""


def core(token: Column, chars: str = R.PEELED) -> Column:
    return F.btrim(token, F.lit(chars))


def peel(token: Column, chars: str = R.PEELED) -> Column:
    """struct(prefix, core, suffix); a token of punctuation alone is all prefix."""
    sign = F.lit(chars)
    left = F.ltrim(token, sign)
    whole = F.rtrim(left, sign)
    return F.struct(F.substring(token, F.lit(1), F.length(token) - F.length(left)).alias("prefix"), whole.alias("core"), F.substring(left, F.length(whole) + 1, F.length(left)).alias("suffix"))


def fold_apostrophes(c: Column) -> Column:
    return F.translate(c, R.APOSTROPHES, "'" * len(R.APOSTROPHES))


def _fold(c: Column, steps: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Replacements one after the other, and how many were made."""
    count = F.lit(0)
    for pattern, by in steps:
        count = count + F.regexp_count(c, F.lit(pattern))
        c = F.regexp_replace(c, F.lit(pattern), F.lit(by))
    return c, count


def phrase_steps(rules) -> list[tuple[str, str]]:
    return [(word_pattern(r.word), replacement(r.replacement or "")) for r in rules]


def _fold_where(c: Column, steps: list[tuple[str, str]]) -> tuple[Column, Column]:
    """_fold for the texts in which any of the patterns is found: one look for all spares the others a pass for each."""
    if len(steps) < 2:
        return _fold(c, steps)
    any_of = FLAGS + "|".join(f"(?:{p.removeprefix(FLAGS)})" for p, _ in steps)
    text = let(c, lambda x: F.when(x.rlike(any_of), _fold(x, steps)[0]).otherwise(x))
    return text, F.when(c.rlike(any_of), _fold(c, steps)[1]).otherwise(0)


def replace_phrases(c: Column, rules) -> Column:
    return _fold_where(c, phrase_steps(rules))[0]


def _word_map(words: dict[str, str | None]) -> Column:
    pairs = [F.lit(x) for w, r in words.items() if w for x in (w, _GONE if r is None else r)]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def replace_words(c: Column, words: dict[str, str | None], chars: str = R.PEELED) -> tuple[Column, Column]:
    """The text with words replaced inside their punctuation, deleted with it if the value is None; and how many.

    A token is looked for in a hash set; only those in it are taken apart and looked up in the map, which is searched in line.
    """
    words = {w: r for w, r in words.items() if w}
    table = _word_map(words)
    known = lambda t: F.lower(core(t, chars)).isin(*words) if words else F.lit(False)

    def one(t: Column) -> Column:
        # no lambda in the lambda: Spark can't hand a Python function what has one
        p = peel(t, chars)
        r = F.try_element_at(table, F.lower(p["core"]))
        return F.when(r == _GONE, r).otherwise(F.concat(p["prefix"], r, p["suffix"]))

    done = F.transform(tokens(c), lambda t: F.when(known(t), one(t)).otherwise(t))
    text = F.array_join(F.filter(done, lambda t: t != _GONE), " ")
    return text, F.size(F.filter(tokens(c), known))


def apply_patterns(c: Column, patterns) -> tuple[Column, Column]:
    text, n = _fold(c, [(jvm(p.regex), replacement(p.replacement)) for p in patterns])
    return strip(text), n


def normalized(c: Column, resources: R.Resources = R.SEED) -> Column:
    """struct(text, original, replacements_made, changed): apostrophes, phrases by length, words, patterns, in this order."""
    words = resources.words()
    if len(words) > LITERAL_WORDS:
        raise ValueError(f"{len(words)} words are too many for an expression: use operators.words.normalize")
    phrases, a = _fold_where(fold_apostrophes(c), phrase_steps(resources.phrases()))
    text, b = replace_words(phrases, words)
    text, d = apply_patterns(text, resources.patterns)
    return F.struct(text.alias("text"), c.alias("original"), (a + b + d).cast("int").alias("replacements_made"), (text != c).alias("changed"))


def normalize(c: Column, resources: R.Resources = R.SEED) -> Column:
    return normalized(c, resources)["text"]


def remove_fillers(c: Column, fillers=R.FILLERS) -> Column:
    """Without the phrases, the longest first, wherever they stand, inside words too."""
    return _fold_where(c, [(FLAGS + quoted(p), "") for p in sorted(fillers, key=len, reverse=True)])[0]


def drop_intensifiers(ts: Column, intensifiers=R.INTENSIFIERS) -> Column:
    return F.filter(ts, lambda t: ~F.lower(t).isin(*intensifiers)) if intensifiers else ts


def drop_stop_words(c: Column, stop_words=R.STOP_WORDS) -> Column:
    return F.array_join(drop_intensifiers(tokens(c), sorted(stop_words)), " ")


def dedup_consecutive(ts: Column) -> Column:
    """Tokens that, apart from case, differ from the one before."""
    return let(ts, lambda a: F.filter(a, lambda t, i: (i == 0) | (F.lower(t) != F.lower(F.get(a, i - 1)))))


def cleanup(c: Column) -> Column:
    """One comma for runs of commas and semicolons, none at the edges, no space before punctuation, single spaces."""
    steps = [("[,;]{2,}", ","), (f"^{SPACE}*[,;]{SPACE}*", ""), (f"{SPACE}*[,;]{SPACE}*$", ""), (f"{SPACE}+([.,!?;:])", "$1"), (f"{SPACE}{{2,}}", " ")]
    return strip(reduce(lambda x, s: F.regexp_replace(x, "(?U)" + s[0], s[1]), steps, c))


def compress(c: Column, resources: R.Resources = R.SEED) -> Column:
    """Fillers, intensifiers and repeats removed; blank texts stay as they are."""

    def run(x: Column) -> Column:
        ts = dedup_consecutive(drop_intensifiers(tokens(remove_fillers(x, resources.fillers)), resources.intensifiers))
        return F.when(blank(x), x).otherwise(cleanup(F.array_join(ts, " ")))

    return let(c, run)


def transliterate(c: Column) -> Column:
    """Cyrillic in Latin letters; a capital of several Latin letters becomes all capitals."""
    low, to = R.LETTERS
    c = F.translate(c, low + low.upper() + R.SILENT + R.SILENT.upper(), to + to.upper())
    for a, b in R.DIGRAPHS.items():
        c = F.replace(F.replace(c, F.lit(a), F.lit(b)), F.lit(a.upper()), F.lit(b.upper()))
    return c


def has_cyrillic(c: Column) -> Column:
    return c.rlike("[а-яіїєґА-ЯІЇЄҐ]")


def has_latin(c: Column) -> Column:
    return c.rlike("[A-Za-z]")


def mixed_script(c: Column) -> Column:
    return has_cyrillic(c) & has_latin(c)


def translate_tokens(ts: Column, table: Column, chars: str = R.PEELED, words: list[str] | None = None) -> Column:
    """Tokens by a map(lower-case word -> English); words it lacks are transliterated if Cyrillic, else kept.

    words: the map's, if they are known; a token that is none of them isn't looked up.
    """

    def one(t: Column) -> Column:
        p = peel(t, chars)
        to = F.try_element_at(table, F.lower(p["core"]))
        to = to if words is None else F.when(F.lower(p["core"]).isin(*words), to) if words else F.lit(None).cast("string")
        return (
            F.when(p["core"] == "", t)
            .when(F.coalesce(to, F.lit("")) != "", F.concat(p["prefix"], to, p["suffix"]))
            .when(has_cyrillic(p["core"]), F.concat(p["prefix"], transliterate(p["core"]), p["suffix"]))
            .otherwise(t)
        )

    return F.transform(ts, one)


def translate(c: Column, lexicon: list[tuple[str, str | None]]) -> Column:
    """To English by (word, English) pairs that fit in an expression: phrases of three and two words, then words."""
    live = [(w, e) for w, e in lexicon if e]
    phrases = sorted((x for x in live if len(x[0].split()) in (2, 3)), key=lambda x: (-len(x[0].split()), -len(x[0])))
    text = reduce(lambda x, p: F.regexp_replace(x, F.lit(word_pattern(p[0])), F.lit(replacement(p[1]))), phrases, c)
    table = _word_map({w: e for w, e in live})
    return F.when(blank(c), c).otherwise(strip(F.array_join(translate_tokens(tokens(text), table, words=[w for w, _ in live if w]), " ")))


def reverse_translate(c: Column, dictionary: dict[str, str]) -> Column:
    """Back from English by a dictionary of lower-case words and phrases: phrases, articles dropped, function words, words."""
    phrases = sorted((k for k in dictionary if " " in k), key=len, reverse=True)
    text = reduce(lambda x, k: F.regexp_replace(x, F.lit(word_pattern(k)), F.lit(replacement(dictionary[k]))), phrases, c)
    words: dict[str, str | None] = {k: v for k, v in dictionary.items() if " " not in k}
    words |= {k: v or None for k, v in R.function_words().items()} | dict.fromkeys(R.ARTICLES)
    return F.when(blank(c), c).otherwise(replace_words(text, words, R.PEELED_REVERSE)[0])


def untranslated_ratio(c: Column) -> Column:
    """Share of tokens that begin with a Latin letter and hold no Cyrillic one; 0 for blank."""
    foreign = lambda t: core(t, R.PEELED_REVERSE).rlike(r"^[A-Za-z](?iu:[^а-яіїєґ]*+)\z")
    return let(tokens(c), lambda ts: F.when(F.size(ts) > 0, F.size(F.filter(ts, foreign)) / F.size(ts)).otherwise(0.0))


_CODE = r"(?m)^\s*(?:(?:const|let|var|function|class|import)|(?:async )?def|from .+ import) "


def should_process(c: Column, skip=("json", "code")) -> Column:
    """Whether a text is worth rewriting: not blank, not JSON or code, and not above 70 % ASCII letters."""
    s = strip(c)
    ok = s != ""
    if "json" in skip:
        ok = ok & ~s.rlike(r"^[{\[]")
    if "code" in skip:
        ok = ok & ~s.rlike(_CODE)
    letters = F.regexp_count(s, F.lit(r"\p{L}"))
    return F.coalesce(ok & ~((letters > 0) & (F.regexp_count(s, F.lit("[A-Za-z]")) / letters > 0.7)), F.lit(False))


def split_sentences(c: Column) -> Column:
    return F.split(c, f"(?U)(?<=[.!?]){SPACE}+")


_LETTER_OR_CLOSER = "A-Za-z\u0410-\u042f\u0430-\u044f\u0404\u0406\u0407\u0454\u0456\u0457\u0490\u0491'\")\\]"
_END = rf"(?:\n|(?:\.\.\.|(?<=[{_LETTER_OR_CLOSER}])[?!.])(?=\s|$))"


def complete_sentences(c: Column) -> Column:
    """Sentences as a buffer gives them out once it holds the whole text: ends stay, the rest comes last."""
    return F.regexp_extract_all(c, F.lit(rf"(?sU).*?{_END}|.+$"), F.lit(0))


def yes_no(c: Column) -> Column:
    """Whether an answer says yes."""
    return F.coalesce(F.rtrim(F.lower(strip(c)), F.lit(".!,")).isin("yes", "так", "true", "1"), F.lit(False))


def answer_json(c: Column) -> Column:
    """The object in an answer, from the first { to the last }, as a string; null if there is none or it isn't JSON."""
    s = strip(c)
    body = F.nullif(F.regexp_extract(s, r"(?s)\{.*\}", 0), F.lit(""))
    body = F.when(~F.lower(s).isin("null", "none", ""), body)
    return F.when(F.try_parse_json(body).isNotNull(), body)


_FIELD_TYPES = {str: "string", int: "bigint", float: "double", bool: "boolean"}


def extracted(c: Column, fields: dict[str, type]) -> Column:
    """struct of the fields of an answer's object, cast to their types where they can be; null without one."""
    body = answer_json(c)
    raw = F.from_json(body, ", ".join(f"`{k}` string" for k in fields))
    return F.when(body.isNotNull(), F.struct(*[raw[k].try_cast(_FIELD_TYPES.get(t, "string")).alias(k) for k, t in fields.items()]))


def index_terms(c: Column) -> Column:
    """Terms of a full-text index: lower case, letters and digits, Latin marks removed."""
    low = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda x: x != "")
