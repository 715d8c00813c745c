"""Chat formatting by compiled templates.

The template language has text, {{ expressions }}, {% if %}/{% elif %}/{% else %}, {% for x in y %} (with loop.first, loop.last,
loop.index and loop.index0), {% set %}, {% generation %} ... {% endgeneration %} around what a model is trained on, and
{# comments #}; a minus sign inside a tag trims the space beside it. Expressions have literals, names, attributes and items,
+, ~, comparisons, in, and/or/not, conditional expressions and the filters listed in FILTERS. Nothing else can be called and
no attribute but a mapping's key is reached, so a template can't leave its sandbox.

A template is parsed into a syntax tree, constant parts are folded, and the tree becomes nested Python closures; rendering
gives the text and the spans (in code points) of its generation blocks.

Control strings inside texts are escaped reversibly: one backslash more is put after their first character, whatever number of
backslashes stands there already; unescaping takes one away.

Defined results: a null text or role is empty; turns go by turn number (null first), then role, then text, so repeated rows are
repeated turns; a null conv_id is a conversation of its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
TEMPLATE = """
{%- for m in messages -%}
<s>[ROLE]{{ m.role | escape }}[/ROLE]
{%- if m.role == 'assistant' -%}
{% generation %}{{ m.text | escape }}{% endgeneration %}
{%- else -%}
[INST]{{ m.text | escape }}[/INST]
{%- endif -%}
</s>
{%- endfor -%}
"""


def _patterns(controls: tuple[str, ...]) -> tuple[re.Pattern, re.Pattern]:
    bare = "|".join(f"{re.escape(c[0])}\\\\*(?={re.escape(c[1:])})" for c in controls)
    more = "|".join(f"{re.escape(c[0])}\\\\+(?={re.escape(c[1:])})" for c in controls)
    return re.compile(bare), re.compile(more)


_ESCAPE, _UNESCAPE = _patterns(CONTROLS)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][:-1], text)


class TemplateError(ValueError):
    pass


_LEX = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~|.,()\[\]<>=%*]))")
_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}

FILTERS: dict[str, Callable] = {"escape": lambda x: escape(_text(x)), "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": len, "title": lambda x: _text(x).title(), "first": lambda x: x[0] if x else "", "last": lambda x: x[-1] if x else "", "string": lambda x: _text(x)}


def _text(x) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def _item(x, key):
    """A mapping's value, a list's item, or None."""
    if isinstance(x, dict):
        return x.get(key)
    if isinstance(x, (list, str)) and isinstance(key, int) and -len(x) <= key < len(x):
        return x[key]
    return None


# A node of an expression is ("const", value), or a name and its parts.
class _Expressions:
    """A parser by precedence; operators of constants are folded as they are built."""

    LEVELS = (("or",), ("and",))
    COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in (b or ())}

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        found = self.peek(*values)
        self.at += found
        return found

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return value

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} isn't expected")

    def whole(self) -> tuple:
        node = self.conditional()
        self.end()
        return node

    def conditional(self) -> tuple:
        node = self.binary(0)
        if self.take("if"):
            test = self.binary(0)
            other = self.conditional() if self.take("else") else ("const", "")
            return (node if test[1] else other) if test[0] == "const" else ("cond", test, node, other)
        return node

    def binary(self, level: int) -> tuple:
        if level == 2:
            return self.negation()
        node = self.binary(level + 1)
        while self.take(*self.LEVELS[level]):
            node = fold((self.LEVELS[level][0], node, self.binary(level + 1)))
        return node

    def negation(self) -> tuple:
        if self.take("not"):
            return fold(("not", self.negation()))
        node = self.sum()
        while self.peek(*self.COMPARE) or self.peek("not"):
            negated = self.take("not")
            op = self.tokens[self.at][1]
            self.at += 1
            if negated and op != "in":
                raise TemplateError("'not' without 'in'")
            node = fold(("compare", op, node, self.sum()))
            node = fold(("not", node)) if negated else node
        return node

    def sum(self) -> tuple:
        node = self.filtered()
        while self.peek("+", "~"):
            op = self.tokens[self.at][1]
            self.at += 1
            node = fold(("add" if op == "+" else "concat", node, self.filtered()))
        return node

    def filtered(self) -> tuple:
        node = self.primary()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"there is no filter {name!r}")
            node = fold(("filter", name, node))
        return node

    def primary(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            node = ("const", float(value) if "." in value else int(value))
        elif kind == "string":
            node = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1]))
        elif kind == "name":
            node = ("const", {"true": True, "false": False, "none": None}[value.lower()]) if value.lower() in ("true", "false", "none") else ("name", value)
        elif value == "(":
            node = self.conditional()
            self.need(")")
        elif value == "-":
            node = fold(("negative", self.primary()))
        else:
            raise TemplateError(f"{value!r} isn't expected")
        while self.peek(".", "["):
            if self.take("."):
                node = fold(("item", node, ("const", self.name())))
            else:
                self.need("[")
                node = fold(("item", node, self.conditional()))
                self.need("]")
        return node


def fold(node: tuple) -> tuple:
    """A constant, where all parts are constants."""
    parts = [x for x in node[1:] if isinstance(x, tuple)]
    return ("const", evaluator(node)({})) if parts and all(p[0] == "const" for p in parts) else node


def evaluator(node: tuple) -> Callable[[dict], object]:
    """A closure that gives the node's value for a mapping of names."""
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name)
    if kind == "filter":
        f, of = FILTERS[node[1]], evaluator(node[2])
        return lambda env: f(of(env))
    if kind == "compare":
        op, a, b = _Expressions.COMPARE[node[1]], evaluator(node[2]), evaluator(node[3])
        return lambda env: op(a(env), b(env))
    parts = [evaluator(x) for x in node[1:]]
    if kind == "item":
        return lambda env: _item(parts[0](env), parts[1](env))
    if kind == "cond":
        return lambda env: parts[1](env) if parts[0](env) else parts[2](env)
    if kind == "and":
        return lambda env: parts[0](env) and parts[1](env)
    if kind == "or":
        return lambda env: parts[0](env) or parts[1](env)
    if kind == "not":
        return lambda env: not parts[0](env)
    if kind == "negative":
        return lambda env: -parts[0](env)
    if kind == "add":
        return lambda env: parts[0](env) + parts[1](env)
    return lambda env: _text(parts[0](env)) + _text(parts[1](env))


def parse(source: str) -> list[tuple]:
    """The template's tree: ("text", s), ("out", e), ("if", [(e, body)], else), ("for", name, e, body), ("set", name, e), ("generation", body)."""
    pieces: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        tag = m[0]
        text = text.rstrip() if tag[2] == "-" else text
        if text:
            pieces.append(("text", text))
        if m[1] is not None:
            pieces.append(("out", m[1]))
        elif m[2] is not None:
            pieces.append(("tag", m[2].strip()))
        trim, at = tag[-3] == "-" and not tag.startswith("{#"), m.end()
    rest = source[at:].lstrip() if trim else source[at:]
    if rest:
        pieces.append(("text", rest))
    place = 0

    def body(ends: tuple[str, ...]) -> tuple[list[tuple], str]:
        nonlocal place
        out: list[tuple] = []
        while place < len(pieces):
            kind, value = pieces[place]
            place += 1
            if kind == "text":
                out.append(("text", value))
            elif kind == "out":
                out.append(("out", _Expressions(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return out, value
                if word == "for":
                    e = _Expressions(rest)
                    name = e.name()
                    e.need("in")
                    over = e.whole()
                    inner, _ = body(("endfor",))
                    out.append(("for", name, over, inner))
                elif word == "if":
                    cases, other, test = [], [], rest
                    while True:
                        inner, stop = body(("elif", "else", "endif"))
                        cases.append((_Expressions(test).whole(), inner))
                        if stop.startswith("elif"):
                            test = stop.partition(" ")[2]
                            continue
                        if stop == "else":
                            other, _ = body(("endif",))
                        break
                    out.append(("if", cases, other))
                elif word == "set":
                    e = _Expressions(rest)
                    name = e.name()
                    e.need("=")
                    out.append(("set", name, e.whole()))
                elif word == "generation":
                    inner, _ = body(("endgeneration",))
                    out.append(("generation", inner))
                else:
                    raise TemplateError(f"there is no tag {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return out, ""

    return simplified(body(())[0])


def simplified(tree: list[tuple]) -> list[tuple]:
    """Constant output becomes text, neighbouring texts one, and branches whose test is constant go."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in tree:
        if node[0] == "out" and node[1][0] == "const":
            add(("text", _text(node[1][1])))
        elif node[0] == "if":
            cases, other = [], node[2]
            for test, inner in node[1]:
                if test[0] == "const" and not test[1]:
                    continue
                if test[0] == "const":
                    other = inner
                    break
                cases.append((test, simplified(inner)))
            other = simplified(other)
            if cases:
                add(("if", cases, other))
            else:
                for x in other:
                    add(x)
        elif node[0] == "for":
            add(("for", node[1], node[2], simplified(node[3])))
        elif node[0] == "generation":
            add(("generation", simplified(node[1])))
        else:
            add(node)
    return out


class _Output:
    __slots__ = ("parts", "length", "spans")

    def __init__(self):
        self.parts, self.length, self.spans = [], 0, []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def closure(tree: list[tuple]) -> Callable[[dict, _Output], None]:
    steps = [_step(node) for node in tree]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, out: _Output) -> None:
        for step in steps:
            step(env, out)

    return run


def _step(node: tuple) -> Callable[[dict, _Output], None]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda env, out: out.add(text)
    if kind == "out":
        value = evaluator(node[1])
        return lambda env, out: out.add(_text(value(env)))
    if kind == "set":
        name, value = node[1], evaluator(node[2])
        return lambda env, out: env.__setitem__(name, value(env))
    if kind == "generation":
        inner = closure(node[1])

        def generation(env: dict, out: _Output) -> None:
            start = out.length
            inner(env, out)
            out.spans.append((start, out.length))

        return generation
    if kind == "if":
        cases, other = [(evaluator(t), closure(b)) for t, b in node[1]], closure(node[2])

        def branch(env: dict, out: _Output) -> None:
            for test, inner in cases:
                if test(env):
                    return inner(env, out)
            return other(env, out)

        return branch
    name, over, inner = node[1], evaluator(node[2]), closure(node[3])

    def loop(env: dict, out: _Output) -> None:
        items = list(over(env) or ())
        own = dict(env)
        for i, x in enumerate(items):
            own[name] = x
            own["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1}
            inner(own, out)

    return loop


def compile_template(source: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of the template's names that gives the text and its generation spans."""
    run = closure(parse(source))

    def render(**names) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        run(dict(names), out)
        return "".join(out.parts), out.spans

    return render


def format_conversations(rows: DataFrame, *, template: str = TEMPLATE) -> DataFrame:
    """rows: conv_id, turn, role, text. One row for each conversation: conv_id, formatted, spans (of the loss mask)."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compile_template(template)
        for b in slices(batches):
            got = [run(messages=turns) for turns in b.column(1).to_pylist()]
            spans = pa.array([[{"begin": x, "end": y} for x, y in s] for _, s in got], type=pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in got], type=pa.string()), spans], names=["conv_id", "formatted", "spans"])

    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))  # what one output text holds
    return turns.mapInArrow(render, "conv_id long, formatted string, spans array<struct<begin: long, end: long>>")


_TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](\[INST\])?(.*?)(?(2)\[/INST\])</s>", re.S)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn, from the output of TEMPLATE."""
    return [(unescape(m[1]), unescape(m[3])) for m in _TURN.finditer(formatted)]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the outputs of TEMPLATE hold."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = turns_of(text)
                loss = "".join(unescape(text[s["begin"] : s["end"]]) for s in spans)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)]], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1_chat(spark, sf_dir: str) -> DataFrame:
    """Formats all conversations, and one that says control strings; reads the outputs back."""
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_back(format_conversations(rows.unionByName(more)))


#: Formatted lengths are those of TEMPLATE; a control string within a text or role takes one more character.
OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(role || text) + len(regexp_extract_all(role, '</?s>|\[/?(?:INST|ROLE)\]')) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?(?:INST|ROLE)\]')) + length('<s>[ROLE][/ROLE]</s>') + CASE WHEN role = 'assistant' THEN 0 ELSE length('[INST][/INST]') END AS own_chars FROM c
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(own_chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
