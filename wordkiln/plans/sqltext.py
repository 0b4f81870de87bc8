"""The text functions in DuckDB's SQL, to hold the expressions against."""

from __future__ import annotations

import re

from .. import resources as R

SP = r"[\s\p{Z}\x0B\x85\x1C-\x1F]"
_EDGE = r"[^\p{L}\p{N}_]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{SP}+'), lambda x: x <> '')"


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{SP}+', ''), '{SP}+$', '')"


def core(t: str, chars: str = R.PEELED) -> str:
    return f"trim({t}, {q(chars)})"


def prefix(t: str, chars: str = R.PEELED) -> str:
    return f"left({t}, length({t}) - length(ltrim({t}, {q(chars)})))"


def suffix(t: str, chars: str = R.PEELED) -> str:
    return f"right({t}, length({t}) - length(rtrim({t}, {q(chars)})))"


def phrases(c: str, pairs: list[tuple[str, str]]) -> str:
    """Each phrase twice, since a pass eats the signs beside its hits."""
    for a, b in pairs:
        for _ in range(2):
            c = f"regexp_replace({c}, {q(f'(^|{_EDGE}){re.escape(a)}($|{_EDGE})'.replace(chr(92) + ' ', ' '))}, {q(chr(92) + '1' + b + chr(92) + '2')}, 'gi')"
    return c


def words(c: str, table: dict[str, str | None], chars: str = R.PEELED) -> str:
    entries = ", ".join(f"{q(w)}: {q(r) if r is not None else 'chr(1)'}" for w, r in table.items())
    pairs = f"list_transform({tokens(c)}, lambda t: {{'t': t, 'm': MAP {{{entries}}}[lower({core('t', chars)})]}})"
    done = f"CASE WHEN x.m IS NULL THEN x.t WHEN x.m = chr(1) THEN NULL ELSE {prefix('x.t', chars)} || x.m || {suffix('x.t', chars)} END"
    return f"array_to_string(list_filter(list_transform({pairs}, lambda x: {done}), lambda t: t IS NOT NULL), ' ')"


def patterns(c: str, steps) -> str:
    for p in steps:
        c = f"regexp_replace({c}, {q(p.regex.replace(chr(92) + 's', SP))}, {q(p.replacement)}, 'gi')"
    return strip(c)


def apostrophes(c: str) -> str:
    return f"translate({c}, {q(R.APOSTROPHES)}, {q(chr(39) * len(R.APOSTROPHES))})"


def normalize(c: str, r: R.Resources) -> str:
    c = phrases(apostrophes(c), [(x.word, x.replacement or "") for x in r.phrases()])
    return patterns(words(c, r.words()), r.patterns)


def fillers(c: str, fs) -> str:
    for f in sorted(fs, key=len, reverse=True):
        c = f"regexp_replace({c}, {q(f)}, '', 'gi')"
    return c


def drop_words(ts: str, ws) -> str:
    return f"list_filter({ts}, lambda t: lower(t) NOT IN ({', '.join(map(q, ws))}))"


def dedup(ts: str) -> str:
    return f"list_filter({ts}, lambda t, i: i = 1 OR lower(t) <> lower(({ts})[i - 1]))"


def cleanup(c: str) -> str:
    for a, b in (("[,;]{2,}", ","), (f"^{SP}*[,;]{SP}*", ""), (f"{SP}*[,;]{SP}*$", ""), (f"{SP}+([.,!?;:])", r"\1"), (f"{SP}{{2,}}", " ")):
        c = f"regexp_replace({c}, {q(a)}, {q(b)}, 'g')"
    return strip(c)


def terms(c: str) -> str:
    low = f"translate(lower({c}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
    return rf"list_filter(string_split_regex({low}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def cosine(a: str, b: str) -> str:
    x, y = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    return f"CASE WHEN list_inner_product({x}, {x}) * list_inner_product({y}, {y}) = 0 THEN 0.0 ELSE list_cosine_similarity({x}, {y}) END"


def transliterate(c: str) -> str:
    low, to = R.LETTERS
    c = f"translate({c}, {q(low + low.upper() + R.SILENT + R.SILENT.upper())}, {q(to + to.upper())})"
    for a, b in R.DIGRAPHS.items():
        c = f"replace(replace({c}, {q(a)}, {q(b)}), {q(a.upper())}, {q(b.upper())})"
    return c


def should_process(c: str) -> str:
    s = strip(c)
    code = rf"(?m)^\s*(?:(?:const|let|var|function|class|import)|(?:async )?def|from .+ import) "
    letters = rf"len(regexp_extract_all({s}, '\p{{L}}'))"
    return f"coalesce({s} <> '' AND NOT regexp_matches({s}, '^[{{\\[]') AND NOT regexp_matches({s}, '{code}') AND NOT ({letters} > 0 AND len(regexp_extract_all({s}, '[A-Za-z]')) / {letters} > 0.7), false)"


def sentences(c: str) -> str:
    return rf"string_split(regexp_replace({c}, '([.!?]){SP}+', '\1' || chr(1), 'g'), chr(1))"
