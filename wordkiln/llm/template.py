"""Chat templates: a sandboxed language parsed to a tree, folded, and compiled to closures that render conversations.

Text stands for itself; {{ expression }} prints; {% if %} {% elif %} {% else %} {% endif %}, {% for x in list %} {% endfor %},
{% set x = expression %} and {% generation %} {% endgeneration %} control; {# #} is a comment; a - inside a tag's edge eats
the white space beside it. Expressions have literals, names, .field and [index], + - * % ~, comparisons, in, and, or, not,
`a if b else c`, filters and the tests of TESTS. There are no calls but raise_exception(text), no attributes of Python
objects, and no loops but over lists of the data, so a template ends and reaches nothing outside.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_key

CHATML = (
    "{% for m in messages %}{{ '<|im_start|>' + m.role + '\n' }}{% if m.role == 'assistant' %}{% generation %}{{ m.content }}{{ '<|im_end|>' }}"
    "{% endgeneration %}{% else %}{{ m.content + '<|im_end|>' }}{% endif %}{{ '\n' }}{% endfor %}"
)


class TemplateError(ValueError):
    """A template that can't be parsed, or that raises on the data."""


class Undefined:
    """What a missing name or field gives: prints as nothing and is false."""

    def __str__(self):
        return ""

    def __bool__(self):
        return False


UNDEFINED = Undefined()


@dataclass(frozen=True)
class Node:
    kind: str
    args: tuple


_TAG = re.compile(r"\{([{%#])(-?)(.*?)(-?)([}%#])\}", re.S)
_LEXEME = re.compile(r"\s*(?:(\d+\.\d+|\d+)|([A-Za-z_]\w*)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|<=|>=|[-+*%~<>=|.,()\[\]:]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}

FILTERS: dict[str, Callable] = {
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x) if isinstance(x, (str, list, dict)) else 0,
    "first": lambda x: x[0] if isinstance(x, (str, list)) and x else UNDEFINED,
    "last": lambda x: x[-1] if isinstance(x, (str, list)) and x else UNDEFINED,
    "default": lambda x, d="": d if isinstance(x, Undefined) or x is None else x,
    "join": lambda x, by="": _text(by).join(_text(y) for y in x) if isinstance(x, list) else _text(x),
    "replace": lambda x, a, b: _text(x).replace(_text(a), _text(b)) if _text(a) else _text(x),
}
#: Least and most arguments of each filter beside the value.
ARGUMENTS = {"default": (0, 1), "join": (0, 1), "replace": (2, 2)}
TESTS: dict[str, Callable] = {
    "defined": lambda x: not isinstance(x, Undefined),
    "none": lambda x: x is None,
    "string": lambda x: isinstance(x, str),
    "odd": lambda x: isinstance(x, int) and x % 2 == 1,
    "even": lambda x: isinstance(x, int) and x % 2 == 0,
}


def _text(x: Any) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    return str(x)


class _Expression:
    """Recursive descent over one tag's lexemes."""

    def __init__(self, source: str):
        self.items: list[tuple[str, Any]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            m = _LEXEME.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at : at + 20]!r}")
            number, name, string, sign = m.groups()
            if number:
                self.items.append(("value", float(number) if "." in number else int(number)))
            elif name:
                self.items.append(("name", name))
            elif string:
                self.items.append(("value", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[0]), string[1:-1], flags=re.S)))
            else:
                self.items.append(("sign", sign))
            at = m.end()
        self.at = 0

    def peek(self, *wanted: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] != "value" and self.items[self.at][1] in wanted

    def take(self, *wanted: str) -> str | None:
        if self.peek(*wanted):
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign!r} is missing")

    def name(self) -> str:
        if self.at < len(self.items) and self.items[self.at][0] == "name":
            self.at += 1
            return self.items[self.at - 1][1]
        raise TemplateError("a name is missing")

    def done(self) -> None:
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")

    def whole(self) -> Node:
        value = self.either()
        if self.take("if"):
            test = self.either()
            other = self.whole() if self.take("else") else Node("value", (UNDEFINED,))
            return Node("choose", (test, value, other))
        return value

    def either(self) -> Node:
        left = self.both()
        while self.take("or"):
            left = Node("or", (left, self.both()))
        return left

    def both(self) -> Node:
        left = self.negated()
        while self.take("and"):
            left = Node("and", (left, self.negated()))
        return left

    def negated(self) -> Node:
        return Node("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        left = self.added()
        while True:
            if sign := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
                left = Node("binary", (sign, left, self.added()))
            elif self.peek("not") and self.at + 1 < len(self.items) and self.items[self.at + 1] == ("name", "in"):
                self.at += 2
                left = Node("not", (Node("binary", ("in", left, self.added())),))
            elif self.take("is"):
                negative = self.take("not")
                test = self.name()
                if test not in TESTS:
                    raise TemplateError(f"no test {test!r}")
                left = Node("test", (test, left))
                left = Node("not", (left,)) if negative else left
            else:
                return left

    def added(self) -> Node:
        left = self.multiplied()
        while sign := self.take("+", "-", "~"):
            left = Node("binary", (sign, left, self.multiplied()))
        return left

    def multiplied(self) -> Node:
        left = self.filtered()
        while sign := self.take("*", "%"):
            left = Node("binary", (sign, left, self.filtered()))
        return left

    def filtered(self) -> Node:
        left = self.reached()
        while self.take("|"):
            f = self.name()
            if f not in FILTERS:
                raise TemplateError(f"no filter {f!r}")
            given = tuple(self.arguments()) if self.take("(") else ()
            least, most = ARGUMENTS.get(f, (0, 0))
            if not least <= len(given) <= most:
                raise TemplateError(f"filter {f!r} takes {least} to {most} arguments, not {len(given)}")
            left = Node("filter", (f, left, given))
        return left

    def arguments(self) -> list[Node]:
        out = []
        while not self.take(")"):
            out.append(self.whole())
            if not self.peek(")"):
                self.need(",")
        return out

    def reached(self) -> Node:
        left = self.single()
        while True:
            if self.take("."):
                left = Node("item", (left, Node("value", (self.name(),))))
            elif self.take("["):
                left = Node("item", (left, self.whole()))
                self.need("]")
            else:
                return left

    def single(self) -> Node:
        if self.at >= len(self.items):
            raise TemplateError("an expression is missing")
        kind, value = self.items[self.at]
        self.at += 1
        if kind == "value":
            return Node("value", (value,))
        if kind == "name":
            if value in ("true", "True", "false", "False"):
                return Node("value", (value.lower() == "true",))
            if value in ("none", "None"):
                return Node("value", (None,))
            if value == "raise_exception":
                self.need("(")
                given = self.arguments()
                if len(given) != 1:
                    raise TemplateError("raise_exception takes one argument")
                return Node("raise", (given[0],))
            return Node("name", (value,))
        if value == "(":
            inner = self.whole()
            self.need(")")
            return inner
        if value == "-":
            return Node("binary", ("-", Node("value", (0,)), self.reached()))
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> Node:
    """The template's tree. Raises TemplateError."""
    pieces: list[tuple[str, str]] = []
    at, eat = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if eat else text
        pieces.append(("text", text.rstrip() if m[2] else text))
        if {"{": "}", "%": "%", "#": "#"}[m[1]] != m[5]:
            raise TemplateError(f"tag {m[0]!r} isn't closed")
        pieces.append(({"{": "print", "%": "tag", "#": "comment"}[m[1]], m[3].strip()))
        at, eat = m.end(), bool(m[4])
    rest = source[at:]
    pieces.append(("text", rest.lstrip() if eat else rest))
    place = [0]

    def block(*ends: str) -> tuple[Node, str, str]:
        out: list[Node] = []
        while place[0] < len(pieces):
            kind, body = pieces[place[0]]
            place[0] += 1
            if kind == "text":
                if body:
                    out.append(Node("text", (body,)))
            elif kind == "print":
                e = _Expression(body)
                out.append(Node("print", (e.whole(),)))
                e.done()
            elif kind == "tag":
                word, _, rest = body.partition(" ")
                if word in ends:
                    return Node("block", tuple(out)), word, rest
                out.append(tag(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return Node("block", tuple(out)), "", ""

    def expression(source: str) -> Node:
        e = _Expression(source)
        node = e.whole()
        e.done()
        return node

    def tag(word: str, rest: str) -> Node:
        if word == "if":
            arms, test = [], expression(rest)
            while True:
                body, end, after = block("elif", "else", "endif")
                arms.append((test, body))
                if end == "elif":
                    test = expression(after)
                elif end == "else":
                    other, _, _ = block("endif")
                    return Node("if", (tuple(arms), other))
                else:
                    return Node("if", (tuple(arms), Node("block", ())))
        if word == "for":
            e = _Expression(rest)
            name = e.name()
            e.need("in")
            items = e.whole()
            e.done()
            return Node("for", (name, items, block("endfor")[0]))
        if word == "set":
            e = _Expression(rest)
            name = e.name()
            e.need("=")
            value = e.whole()
            e.done()
            return Node("set", (name, value))
        if word == "generation":
            return Node("generation", (block("endgeneration")[0],))
        raise TemplateError(f"no tag {word!r}")

    return block()[0]


def _binary(sign: str, a: Any, b: Any) -> Any:
    if sign == "==":
        return a == b
    if sign == "!=":
        return a != b
    if sign == "~" or sign == "+" and (isinstance(a, (str, Undefined)) or isinstance(b, (str, Undefined)) or a is None or b is None):
        return _text(a) + _text(b)
    if sign == "in":
        return _text(a) in b if isinstance(b, str) else isinstance(b, (list, dict)) and a in b
    numbers = all(isinstance(x, (int, float)) for x in (a, b))
    if sign in ("<", ">", "<=", ">=") and (numbers or isinstance(a, str) and isinstance(b, str)):
        return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[sign]
    if not numbers:
        raise TemplateError(f"{sign!r} can't take these values")
    if sign == "%" and b == 0:
        raise TemplateError("modulo by zero")
    return a + b if sign == "+" else a - b if sign == "-" else a * b if sign == "*" else a % b


def _item(a: Any, k: Any) -> Any:
    if isinstance(a, dict):
        return a.get(k, UNDEFINED)
    if isinstance(a, (list, str)) and isinstance(k, int) and -len(a) <= k < len(a):
        return a[k]
    return UNDEFINED


def fold(node: Node) -> Node:
    """The tree with constant expressions computed, choices on constants made, and neighbouring texts joined.

    What fails on its constants is left as it is, to raise where, and if, it is reached.
    """
    try:
        return _fold(node)
    except (TemplateError, TypeError, ValueError, ArithmeticError, AttributeError):
        return node


def _fold(node: Node) -> Node:
    constant = lambda *n: all(x.kind == "value" for x in n)
    k, a = node.kind, node.args
    if k == "binary":
        left, right = fold(a[1]), fold(a[2])
        if constant(left, right):
            return Node("value", (_binary(a[0], left.args[0], right.args[0]),))
        return Node(k, (a[0], left, right))
    if k in ("and", "or"):
        left, right = fold(a[0]), fold(a[1])
        if constant(left):
            return right if bool(left.args[0]) == (k == "and") else left
        return Node(k, (left, right))
    if k == "not":
        x = fold(a[0])
        return Node("value", (not x.args[0],)) if constant(x) else Node(k, (x,))
    if k == "choose":
        test, yes, no = map(fold, a)
        return (yes if test.args[0] else no) if constant(test) else Node(k, (test, yes, no))
    if k == "filter":
        x, rest = fold(a[1]), tuple(map(fold, a[2]))
        return Node("value", (FILTERS[a[0]](x.args[0], *[r.args[0] for r in rest]),)) if constant(x, *rest) else Node(k, (a[0], x, rest))
    if k == "test":
        x = fold(a[1])
        return Node("value", (TESTS[a[0]](x.args[0]),)) if constant(x) else Node(k, (a[0], x))
    if k == "item":
        x, y = fold(a[0]), fold(a[1])
        return Node("value", (_item(x.args[0], y.args[0]),)) if constant(x, y) else Node(k, (x, y))
    if k == "print":
        x = fold(a[0])
        return Node("text", (_text(x.args[0]),)) if constant(x) else Node(k, (x,))
    if k == "if":
        arms = []
        for test, body in a[0]:
            test = fold(test)
            if not constant(test):
                arms.append((test, fold(body)))
            elif test.args[0]:
                return Node(k, (tuple(arms), fold(body))) if arms else fold(body)
        return Node(k, (tuple(arms), fold(a[1]))) if arms else fold(a[1])
    if k == "for":
        return Node(k, (a[0], fold(a[1]), fold(a[2])))
    if k == "set":
        return Node(k, (a[0], fold(a[1])))
    if k in ("generation", "raise"):
        return Node(k, (fold(a[0]),))
    if k == "block":
        out: list[Node] = []
        for x in map(fold, a):
            for y in x.args if x.kind == "block" else (x,):
                if y.kind == "text" and out and out[-1].kind == "text":
                    out[-1] = Node("text", (out[-1].args[0] + y.args[0],))
                elif y.kind != "text" or y.args[0]:
                    out.append(y)
        return Node(k, tuple(out))
    return node


def _value(node: Node) -> Callable[[dict], Any]:
    k, a = node.kind, node.args
    if k == "value":
        v = a[0]
        return lambda c: v
    if k == "name":
        n = a[0]
        return lambda c: c.get(n, UNDEFINED)
    if k == "item":
        x, y = _value(a[0]), _value(a[1])
        return lambda c: _item(x(c), y(c))
    if k == "binary":
        s, x, y = a[0], _value(a[1]), _value(a[2])
        return lambda c: _binary(s, x(c), y(c))
    if k == "and":
        x, y = map(_value, a)
        return lambda c: x(c) and y(c)
    if k == "or":
        x, y = map(_value, a)
        return lambda c: x(c) or y(c)
    if k == "not":
        x = _value(a[0])
        return lambda c: not x(c)
    if k == "choose":
        t, x, y = map(_value, a)
        return lambda c: x(c) if t(c) else y(c)
    if k == "filter":
        f, x, rest = FILTERS[a[0]], _value(a[1]), [_value(r) for r in a[2]]
        return lambda c: f(x(c), *[r(c) for r in rest])
    if k == "test":
        f, x = TESTS[a[0]], _value(a[1])
        return lambda c: f(x(c))
    if k == "raise":
        x = _value(a[0])

        def stop(c):
            raise TemplateError(_text(x(c)))

        return stop
    raise TemplateError(f"{k} isn't an expression")


class _Out:
    def __init__(self):
        self.pieces, self.length, self.spans = [], 0, []

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


def _action(node: Node) -> Callable[[dict, _Out], None]:
    k, a = node.kind, node.args
    if k == "text":
        t = a[0]
        return lambda c, o: o.write(t)
    if k == "print":
        x = _value(a[0])
        return lambda c, o: o.write(_text(x(c)))
    if k == "block":
        steps = [_action(x) for x in a]
        if len(steps) == 1:
            return steps[0]

        def run(c, o):
            for s in steps:
                s(c, o)

        return run
    if k == "if":
        arms, other = [(_value(t), _action(b)) for t, b in a[0]], _action(a[1])

        def choose(c, o):
            for t, b in arms:
                if t(c):
                    return b(c, o)
            return other(c, o)

        return choose
    if k == "for":
        name, items, body = a[0], _value(a[1]), _action(a[2])

        def loop(c, o):
            xs = items(c)
            xs = xs if isinstance(xs, list) else []
            for i, x in enumerate(xs):
                # names set inside a loop end with its round
                body({**c, name: x, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(xs) - 1, "length": len(xs)}}, o)

        return loop
    if k == "set":
        name, x = a[0], _value(a[1])

        def put(c, o):
            c[name] = x(c)

        return put
    if k == "generation":
        body = _action(a[0])

        def mark(c, o):
            start = o.length
            body(c, o)
            o.spans.append((start, o.length))

        return mark
    raise TemplateError(f"{k} can't be run")


def compiled(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function of the names' values: the text and the character spans of its generation blocks."""
    run = _action(fold(parse(source)))

    def render(names: dict) -> tuple[str, list[tuple[int, int]]]:
        o = _Out()
        run(dict(names), o)
        return "".join(o.pieces), o.spans

    return render


RENDERED = "conv_id long, n_turns long, text string, n_generated long, generated string, error string"


def _render(source: str, names: dict):
    def run(batches):
        render = compiled(source)
        for b in batches:
            texts, spans, errors = [], [], []
            for ms in b.column("m").to_pylist():
                try:
                    t, s = render({**names, "messages": [{"role": m["role"], "content": m["content"]} for m in ms]})
                    texts.append(t), spans.append(s), errors.append(None)
                except Exception as e:  # whatever evaluating this conversation raises is its row's error, not the job's
                    texts.append(None), spans.append([]), errors.append(str(e) if isinstance(e, TemplateError) else f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("n_turns"), pa.array(texts, pa.string()), pa.array([sum(z - a for a, z in s) for s in spans], pa.int64()), pa.array([",".join(f"{a}-{z}" for a, z in s) for s in spans], pa.string()), pa.array(errors, pa.string())],
                [f.split()[0] for f in RENDERED.split(", ")],
            )

    return run


def rendered(turns: DataFrame, source: str = CHATML, names: dict | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv_id, n_turns, text, n_generated (characters), generated (spans "start-end" in characters,
    by commas), error (text is null then: evaluating the template failed on this conversation; the others are unharmed).

    Turns are ordered by turn, then role and text, so ties come out alike on every run; a null turn comes first.
    Repeated rows are repeated turns. Null roles and texts print as nothing. Rows with a null conv_id are left out.
    Very long texts are rendered whole. An empty table gives an empty one. Other columns are not read.
    """
    parse(source)  # fails here rather than on executors
    t = turns.select(record_key(turns, conv).alias("conv_id"), turns[turn].alias("turn"), turns[role].cast("string").alias("role"), turns[text].alias("content")).filter("conv_id is not null")
    t = t.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
    return t.mapInArrow(_render(source, names or {}), RENDERED)


def sql(source: str = "conversations") -> str:
    """What CHATML renders, in DuckDB's SQL."""
    return f"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t, role, text FROM {source} WHERE conv_id IS NOT NULL),
b AS (SELECT *, '<|im_start|>' || r || chr(10) AS head, t || '<|im_end|>' AS body FROM a),
c AS (SELECT *, row_number() OVER w AS rn, coalesce(sum(length(head) + length(body) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS s
      FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST))
SELECT conv_id, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY rn) AS text,
  coalesce(sum(length(body)) FILTER (r = 'assistant'), 0)::BIGINT AS n_generated,
  coalesce(string_agg(s::BIGINT || '-' || (s + length(body))::BIGINT, ',' ORDER BY rn) FILTER (r = 'assistant'), '') AS generated, NULL::VARCHAR AS error
FROM c GROUP BY conv_id"""
