"""Patches: C statements with variables, each line kept, removed, added or marked, as patterns over flow graphs.

    patch       := "@@" declaration* "@@" line*
    declaration := kind name ("," name)* ";"      kind: expression, identifier, constant, type, statement
    line        := ("-" | "+" | "*")? text        removed, added, marked, else kept
    text        := statements of the C front end's subset; "..." ("when" ("!=" expression | "any" | "exists" | "forall" | "strict"))*
                   for the way between two of them; dots as arguments, parameters or parts of a loop's head; S for a statement variable;
                   an expression without a semicolon for any place it stands at; "while (...)" for any loop but do

Compilation gives points, one for each thing that a node must match, and links: a step (to all successors, or to some with exists=True), an
existing successor (branches, what comes after a branch), or a gap (until over all paths, or over some). Relations of points are evaluated
from the last to the first. The places of all points of a match are then found by one pass forward: a place of a linked point is one that a
place of the point before leads to, with the same values of the variables. So matches need no list of witnesses a row.

"return;" also fits the last brace of a function that may be left there without a return. What is added to the return goes before that brace;
marked, the brace is; removed, it stays.

Added lines go after what stands on the line before, or before what follows them where that is a gap or nothing. Removed statements that
fill lines take their lines with them. A rule for all paths means all: ways out by an error's return count too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import paths as P
from ..operators import terms as M
from ..operators import triples as T
from ..operators.relation import Graph, Relation, cut
from ..sources.csource import Builder, Program, SyntaxProblem, Term, lex
from .rewrites import STANDARD, expanded

#: Kinds of terms that a variable of a kind stands for; () is any.
KINDS = {"expression": (), "identifier": ("ident",), "constant": ("constant", "string"), "type": ("type",)}
STATEMENTS = ("expr", "decl", "empty", "if", "while", "do", "for", "switch", "break", "continue", "return", "goto", "open")
ENDS = ("exit", "errorexit")
RETURN = "return;"
#: Nodes of flow graphs that come after a statement's parts.
JOINTS = ("close", "after", "dowhile", "loopfall")


@dataclass
class Item:
    """A thing to match at one node: kinds of nodes, and the term it must have. whole: the node's whole term, else any part of it."""

    kinds: tuple[str, ...]
    term: Term | None = None
    whole: bool = True
    binds: tuple[tuple[str, str], ...] = ()
    lines: tuple[int, int] = (0, 0)
    text: str = ""
    mark: str = " "
    before: list[str] = field(default_factory=list)
    after: list[str] = field(default_factory=list)
    parts: dict[str, list] = field(default_factory=dict)


@dataclass
class Gap:
    forbid: list[Term] = field(default_factory=list)
    any: bool = False
    every: bool | None = None
    lines: tuple[int, int] = (0, 0)


@dataclass
class Link:
    via: str  # step, some or gap
    to: Point
    gap: Gap | None = None
    before: Item | None = None  # what stands before the gap


@dataclass
class Point:
    item: Item
    links: list[Link] = field(default_factory=list)


class _Reader(Builder):
    """Statements of a pattern. Items are noted in the order of the text."""

    def __init__(self, tokens: list, variables: dict[str, str]):
        super().__init__(tokens, 0)
        self.variables, self.order = variables, []

    def unary(self) -> Term:
        if self.peek() == "...":
            self.take()
            return Term("dots", "...")
        return super().unary()

    def noted(self, at: int, kinds: Sequence[str], term: Term | None = None, **more) -> Item:
        own = self.tokens[at : self.at]
        out = Item(tuple(kinds), None if term is not None and term.kind == "dots" else term, lines=(own[0].line, own[-1].line), **more)
        self.order.append(out)
        return out

    def items(self, stops: Sequence[str] = ()) -> list:
        out = []
        while self.at < len(self.tokens) and self.peek() not in stops:
            out += self.item()
        return out

    def whens(self) -> Gap:
        at = self.at
        self.take("...")
        gap = Gap()
        while self.peek() == "when":
            self.take()
            kind = self.take().text
            if kind == "!=":
                gap.forbid.append(self.assignment())
            elif kind == "any":
                gap.any = True
            elif kind in ("exists", "forall"):
                gap.every = kind == "forall"
            elif kind != "strict":
                raise SyntaxProblem(f"when {kind}")
        gap.lines = (self.tokens[at].line, self.tokens[self.at - 1].line)
        self.order.append(gap)
        return gap

    def braced(self) -> list:
        name = f"_brace{self.at}"
        at = self.at
        self.take("{")
        own = (name, "cast(brace as string)")
        open_ = self.noted(at, ("open",), binds=(own,))
        inner = self.items("}")
        at = self.at
        self.take("}")
        return [open_, *inner, self.noted(at, ("close",), binds=(own,))]

    def header(self) -> bool:
        """Does a function's head begin here?"""
        k = self.at
        while k < len(self.tokens) and (self.tokens[k].kind == "name" or self.tokens[k].text == "*"):
            k += 1
        if k == self.at or k >= len(self.tokens) or self.tokens[k].text != "(":
            return False
        depth = 0
        while k < len(self.tokens):
            depth += {"(": 1, ")": -1}.get(self.tokens[k].text, 0)
            k += 1
            if not depth:
                break
        return k < len(self.tokens) and self.tokens[k].text == "{"

    def function_item(self) -> list:
        at = self.at
        while self.peek() != "(":
            name = self.take().text
        self.take("(")
        params, depth, one = [], 0, []
        while depth or self.peek() != ")":
            t = self.take().text
            depth += {"(": 1, ")": -1}.get(t, 0)
            if t == "," and not depth:
                params.append(" ".join(one))
                one = []
            else:
                one.append(t)
        self.take(")")
        params += [" ".join(one)] if one else []
        parts = [Term("dots", "...") if p == "..." else Term("param", p) for p in params]
        head = self.noted(at, ("header",), Term("header", name, [Term("ident", name), *parts]))
        open_, *inner, close = self.braced()
        if inner and isinstance(inner[-1], Gap):  # paths end at the exit, whether or not by the last brace
            self.order.remove(close)
            if not inner[-1].forbid:
                self.order.remove(inner.pop())
            return [head, open_, *inner]
        return [head, open_, *inner, close]

    def item(self) -> list:
        t, at = self.peek(), self.at
        if t == "...":
            return [self.whens()]
        if t == "{":
            return self.braced()
        if t == ";":
            self.take()
            return [self.noted(at, ("empty",))]
        if t in ("if", "while", "for"):
            self.take()
            if t == "for" and self.peek(1) != "..." or t == "for" and self.peek(2) == ";":
                self.take("(")
                parts = []
                for stop in (";", ";", ")"):
                    parts.append(Term("none", "") if self.peek() == stop else self.expression())
                    self.take(stop)
                e = Term("for", "", parts)
            else:
                e = self.condition()
            kinds = ("while", "for") if t == "while" and e.kind == "dots" else (t,)
            out = self.noted(at, kinds, e)
            out.parts["body"] = self.item()
            if t == "if" and self.peek() == "else":
                at = self.at
                self.take()
                out.parts["else"] = [self.noted(at, ("false",)), *self.item()]
            return [out]
        if t == "do":
            self.take()
            out = self.noted(at, ("do",))
            out.parts["body"] = self.item()
            at = self.at
            self.take("while")
            e = self.condition()
            self.take(";")
            out.parts["test"] = [self.noted(at, ("dowhile",), e)]
            return [out]
        if t == "switch":
            self.take()
            out = self.noted(at, ("switch",), self.condition())
            at = self.at
            self.take("{")
            out.parts["open"] = [self.noted(at, ("open",))]
            while self.peek() != "}":
                at = self.at
                if self.peek() == "default":
                    self.take()
                    self.take(":")
                    case = self.noted(at, ("default",))
                else:
                    self.take("case")
                    e = self.conditional()
                    self.take(":")
                    case = self.noted(at, ("case",), e)
                case.parts["body"] = self.items(("case", "default", "}"))
                out.parts.setdefault("cases", []).append(case)
            self.take("}")
            return [out]
        if t in ("break", "continue"):
            self.take()
            self.take(";")
            return [self.noted(at, (t,))]
        if t == "return":
            self.take()
            e = None if self.peek() == ";" else self.expression()
            self.take(";")
            return [self.noted(at, ("return",), e, text="" if e else RETURN)]
        if t == "goto":
            self.take()
            label = self.take().text
            self.take(";")
            return [self.noted(at, ("goto",), text=f"goto {label};")]
        if self.variables.get(t) == "statement":
            self.take()
            return [self.noted(at, STATEMENTS, binds=((t, "text"),))]
        if self.header():
            return self.function_item()
        named = self.tokens[at].kind == "name" and self.at + 1 < len(self.tokens)
        if named and self.peek(1) == ":":
            self.take()
            self.take(":")
            return [self.noted(at, ("label",), text=f"{t}:")]
        if named and (t in ("int", "char", "long", "short", "unsigned", "struct", "const", "static", "float", "double", "void") or self.tokens[at + 1].kind == "name" and self.peek(1) != "when" or self.variables.get(t) == "type"):
            self.declaration([])
            whole = self.nodes.pop().term
            if len(whole.parts) > 1:
                raise SyntaxProblem("a pattern declares one name")
            return [self.noted(at, ("decl",), whole.parts[0], whole=False)]
        e = self.expression()
        if self.peek() == ";":
            self.take()
            return [self.noted(at, ("expr",), e)]
        return [self.noted(at, (), e, whole=False)]


@dataclass
class Patch:
    variables: dict[str, str]
    items: list
    order: list
    root: Point | None = None

    @property
    def names(self) -> list[str]:
        return [v for v, k in self.variables.items() if k != "statement"]


_JUMPS = {"return", "break", "continue", "goto"}


def _points(items: list, tail: Link | None) -> Link | None:
    if not items:
        return tail
    head, rest = items[0], _points(items[1:], tail)
    if not isinstance(head, Gap) and rest is not None:
        if rest.via == "gap":
            rest.before = head
        if set(head.kinds) & _JUMPS and rest.to.item.kinds == ("close",):
            rest = None  # the brace after a jump isn't reached
    if isinstance(head, Gap):
        if rest is None:
            rest = Link("step", Point(Item(ENDS)))
        if rest.via != "step":
            raise SyntaxProblem("a gap follows a gap")
        return Link("gap", rest.to, head)
    p = Point(head)
    kind = head.kinds[0] if len(head.kinds) == 1 else ""
    some = lambda kinds, *links: Link("some", Point(Item(kinds), [x for x in links if x]))
    after = some(("after",), rest) if rest else None
    if kind == "if":
        no = head.parts.get("else")
        p.links = [some(("true",), _inner(head.parts["body"], some(("after",))))]
        p.links += [Link("some", Point(no[0], [x for x in (_inner(no[1:], some(("after",))),) if x]))] if no else [some(("fall",))]
    elif head.kinds and set(head.kinds) <= {"while", "for"}:
        p.links = [some(("inloop",), _inner(head.parts["body"], None))]
    elif kind == "do":
        p.links = [some(("inloop",), _inner(head.parts["body"], _points(head.parts["test"], None)))]
    elif kind == "switch":
        cases = [Link("some", Point(c, [x for x in (_points(c.parts["body"], None),) if x])) for c in head.parts.get("cases", [])]
        p.links = [Link("some", Point(head.parts["open"][0], cases))]
    else:
        p.links = [rest] if rest else []
        return Link("step", p)
    p.links += [after] if after else []
    return Link("step", p)


def _inner(body: list, tail: Link | None) -> Link | None:
    """A branch's body. Only a plain statement is held to be the whole branch: jumps and statement variables lead elsewhere."""
    last = body[-1]
    loose = isinstance(last, Gap) or set(last.kinds) & _JUMPS
    return _points(body, None if loose else tail)


def read(text: str) -> Patch:
    _, declared, body = text.split("@@", 2)
    variables = {}
    for one in declared.split(";"):
        words = one.replace(",", " ").split()
        if words:
            if words[0] not in (*KINDS, "statement"):
                raise SyntaxProblem(f"{words[0]} isn't a kind of variable")
            variables |= {v: words[0] for v in words[1:]}
    tokens, marks, added = [], {}, []
    for n, line in enumerate(body.split("\n")):
        mark = line[:1] if line[:1] in ("-", "+", "*") else " "
        content = line[1:] if mark != " " else line
        if mark == "+":
            added.append((n, content.strip()))
            continue
        marks[n] = mark
        for t in lex(content):
            t.line = n
            tokens.append(t)
    r = _Reader(tokens, variables)
    items = r.items()
    for x in r.order:
        if isinstance(x, Item):
            own = {marks[n] for n in range(x.lines[0], x.lines[1] + 1) if n in marks and any(t.line == n for t in tokens)}
            if len(own) > 1:
                raise SyntaxProblem("what one node matches has lines of several kinds")
            x.mark = own.pop()
    for n, content in added:
        prior = [x for x in r.order if x.lines[1] < n]
        later = [x for x in r.order if x.lines[0] > n and isinstance(x, Item)]
        if prior and isinstance(prior[-1], Item):
            prior[-1].after.append(content)
        elif later:
            later[0].before.append(content)
        else:
            raise SyntaxProblem("nothing to add to")
    out = Patch(variables, items, r.order)
    first = _points(items, None)
    if first is None or first.via != "step":
        raise SyntaxProblem("a patch begins with a statement")
    out.root = first.to
    return out


class _Ways:
    """A graph for each binding that a gap's ends may have: there, what the gap must not meet is a set of states. rows: the bindings of names,
    by graph_id; all of them have values."""

    def __init__(self, graph: Graph, rows: DataFrame, names: Sequence[str]):
        self.names = tuple(names)
        own = rows.select("graph_id", *names).distinct()
        self.bindings = cut(own.withColumn("_way", F.concat_ws("\1", "graph_id", *names)))
        ids = self.bindings.select("graph_id", "_way")
        self.graph = Graph(cut(self._at(graph.nodes.select("graph_id", "node_id", "is_loop").join(ids, "graph_id"))), cut(self._at(graph.edges.join(ids, "graph_id"))))

    @staticmethod
    def _at(df: DataFrame) -> DataFrame:
        return df.drop("graph_id").withColumnRenamed("_way", "graph_id")

    def ground(self, a: Relation) -> Relation:
        shared = ["graph_id", *[v for v in a.bound if v in self.names]]
        return Relation(self._at(a.df.join(self.bindings.select(*shared, "_way").distinct(), shared).select("graph_id", "_way", "state")).distinct())

    def without(self, barred: Sequence[Relation]) -> Relation:
        states = self.graph.states()
        for b in barred:
            states = states.join(self.ground(b).df, ["graph_id", "state"], "left_anti")
        return Relation(cut(states))

    def back(self, a: Relation) -> Relation:
        rows = a.df.withColumnRenamed("graph_id", "_way").join(self.bindings, "_way")
        return Relation(rows.select("graph_id", "state", *self.names), self.names).distinct()


class Matches:
    """The places of a patch's items in a program. using: names of the rewrites under which expressions are read."""

    def __init__(self, program: Program, patch: Patch, exists: bool = False, using: Sequence[str] = ()):
        self.patch, self.exists, self.using = patch, exists, using
        self.whole = program
        self.program = program = program if self._names(patch) else program.once
        needed = self._required(patch.root)
        keep = program.graph.nodes.groupBy("graph_id").agg(*[F.max(F.col("kind").isin(*k).cast("int")).alias(f"k{i}") for i, k in enumerate(needed)]) if needed else None
        graph, self.terms = program.graph, program.terms
        if keep is not None:
            keep = keep.where(" and ".join(f"k{i} = 1" for i in range(len(needed)))).select("graph_id")
            graph = Graph(graph.nodes.join(keep, "graph_id", "left_semi"), graph.edges.join(keep, "graph_id", "left_semi"))
            self.terms = self.terms.join(keep, "graph_id", "left_semi")
        self.graph = graph
        self.kept: dict[int, Relation] = {}
        self.barred: dict[int, list[Relation]] = {}
        self.locals: dict[int, Relation] = {}
        self.places: dict[int, DataFrame] = {}
        self.ends: Relation | None = None
        self.of(patch.root)
        self._forward(patch.root, self.kept[id(patch.root)])

    @staticmethod
    def _names(patch: Patch) -> bool:
        """May something fit a function's head? If not, functions that are alike but for their names are looked at once."""
        terms = [t for x in patch.order for t in ([(x.whole, x.term)] if isinstance(x, Item) and not x.kinds else [(False, f) for f in x.forbid] if isinstance(x, Gap) else [])]
        return any(isinstance(x, Item) and "header" in x.kinds for x in patch.order) or any(t is None or not whole and t.kind in ("ident", "header", "param") for whole, t in terms)

    def _required(self, p: Point) -> list[tuple[str, ...]]:
        """Kinds of nodes without which a function can't match."""
        if p.item.text == RETURN:
            return []
        own = [tuple(sorted(p.item.kinds))] if p.item.kinds else []
        return list(dict.fromkeys(own + [k for link in p.links for k in self._required(link.to)]))

    def fits(self, item: Item) -> DataFrame:
        """graph_id, node_id, term_id and variables of the terms that an item's pattern fits."""
        kinds = {v: KINDS[k] for v, k in self.patch.variables.items() if k in KINDS}
        rules = [r for r in STANDARD if r.name in self.using]
        forms = expanded(item.term, rules) if rules else [item.term]
        return M.any_of(*[M.match(self.terms, t, self.patch.names, kinds, item.whole) for t in forms])

    def local(self, item: Item) -> Relation:
        if id(item) not in self.locals:
            found = self._local(item)
            self.locals[id(item)] = found.with_df(cut(found.df)) if item.term is not None else found
        return self.locals[id(item)]

    def _local(self, item: Item) -> Relation:
        g = self.graph
        out = None
        if item.kinds:
            where = F.col("kind").isin(*item.kinds)
            where = where & (F.col("text") == item.text) if item.text else where
            out = T.label_scan(g, where, {v: F.expr(e) for v, e in item.binds})
        if item.term is None:
            return out
        found = self.fits(item)
        own = M.relation(found, [v for v in self.patch.names if v in found.columns])
        return own if out is None else T.conj_join(out, own)

    def of(self, p: Point) -> Relation:
        out = self.local(p.item)
        for link in p.links:
            a = self.of(link.to)
            if link.via == "gap":
                a = self._gap(link, a)
            step = P.ex if self.exists or link.via == "some" else P.ax
            out = T.conj_join(out, step(self.graph, a))
        if p.item.text == RETURN:  # what follows a return isn't looked for after the brace
            out = T.union_plain(out, self.last_braces())
        out = out.with_df(cut(out.df))
        self.kept[id(p)] = out
        return out

    def last_braces(self) -> Relation:
        """Braces from which only braces lead to the exit and before which there is no return on any way: a final return is absent there.

        A brace or a joint that only jumps would lead to isn't there. What else has no predecessor, as the top or dead code, is its own one."""
        if self.ends is None:
            kind = lambda g, *kinds: T.label_scan(g, F.col("kind").isin(*kinds))
            direct = cut(self.graph.edges.where("edge_kind = 'Direct'").select("graph_id", "src", "dst", "edge_kind").distinct())
            back = direct.select("graph_id", F.col("dst").alias("here"), F.col("src").alias("there"))
            joints = kind(self.graph, *JOINTS)
            gone = P.led_only_to(back, joints.df, T.not_exists(joints.df, Relation(back.withColumnRenamed("here", "state"))).df)
            gone = cut(gone.select("graph_id", F.col("state").alias("src")))
            edges = direct.join(gone, ["graph_id", "src"], "left_anti")
            nodes = cut(self.graph.nodes.join(gone.withColumnRenamed("src", "node_id"), ["graph_id", "node_id"], "left_anti"))
            first = nodes.select("graph_id", F.col("node_id").alias("dst")).join(edges, ["graph_id", "dst"], "left_anti")
            g = Graph(nodes, cut(edges.unionByName(first.select("graph_id", F.col("dst").alias("src"), "dst", F.lit("Direct").alias("edge_kind")))))
            last = T.conj_join(kind(g, "close"), P.au(g, kind(g, "close"), kind(g, "exit")))
            last = T.conj_join(last, P.ag(g, T.not_exists(g.states(), kind(g, "return")), "backward"))
            self.ends = last.with_df(cut(last.df))
        return self.ends

    def _every(self, gap: Gap) -> bool:
        return (not self.exists) if gap.every is None else gap.every

    def _gap(self, link: Link, goal: Relation) -> Relation:
        """Between two items neither occurs, unless `any`; what is forbidden doesn't either. Braces and statement variables may occur."""
        barred = [self._barred(f) for f in link.gap.forbid]
        around = [x for x in (link.before, link.to.item) if x is not None and (x.term is not None or x.text)]
        ends = [self.local(x) for x in around] + [self.last_braces() for x in around if x.text == RETURN]
        self.barred[id(link)] = barred if link.gap.any else barred + ends
        rows, names = goal.df, goal.bound
        if link.before is not None and link.before.term is not None:  # only bindings that the item before the gap may have, too
            first = self.local(link.before)
            rows = rows.join(first.df.drop("state").distinct(), ["graph_id", *[v for v in first.bound if v in names]])
            names = tuple(dict.fromkeys([*names, *first.bound]))
        ways = _Ways(self.graph, rows, names)
        until = P.au if self._every(link.gap) else P.eu
        return ways.back(until(ways.graph, ways.without(self.barred[id(link)]), ways.ground(goal)))

    def _barred(self, term: Term) -> Relation:
        found = self.fits(Item((), term, whole=False))
        return M.relation(found, [v for v in self.patch.names if v in found.columns])

    def _forward(self, p: Point, places: Relation) -> None:
        self.places[id(p.item)] = places.df
        for link in p.links:
            if not any(self._edited(x) for x in self._below(link.to)):
                continue
            a = places
            if link.via == "gap":
                ways = _Ways(self.graph, places.df, places.bound)
                a = ways.back(P.eu(ways.graph, ways.without(self.barred[id(link)]), ways.ground(places), "backward"))
            there = T.conj_join(self.kept[id(link.to)], P.ex(self.graph, a, "backward"))
            self._forward(link.to, there.with_df(cut(there.df)))

    def _below(self, p: Point) -> Iterator[Item]:
        yield p.item
        for link in p.links:
            yield from self._below(link.to)

    @staticmethod
    def _edited(item: Item) -> bool:
        return item.mark != " " or bool(item.before or item.after)

    def bindings(self) -> DataFrame:
        """graph_id, the first item's node and the variables of each match."""
        df = self.kept[id(self.patch.root)].df
        return self.everywhere(df.select("graph_id", F.col("state").alias("node_id"), *[v for v in self.patch.variables if v in df.columns]).distinct())

    def functions(self) -> DataFrame:
        """graph_id of each function with a match."""
        return self.everywhere(self.kept[id(self.patch.root)].df.select("graph_id").distinct())

    def everywhere(self, df: DataFrame) -> DataFrame:
        """df: rows of the program that was searched. Those of the whole one."""
        return self.whole.everywhere(df) if self.program is not self.whole else df

    def _spans(self, item: Item) -> DataFrame:
        """Places in the text of an item: start, stop and line, with the variables of its match."""
        return self.everywhere(self._local_spans(item))

    def _local_spans(self, item: Item) -> DataFrame:
        at = self.places[id(item)]
        nodes = self.graph.nodes.select("graph_id", F.col("node_id").alias("state"), "start", "stop", "line", (F.col("kind") == "close").alias("_brace"))
        if item.whole or item.term is None or item.kinds == ("decl",):
            return at.join(nodes, ["graph_id", "state"])
        found = self.fits(item).withColumnRenamed("node_id", "state").join(self.terms.select("graph_id", F.col("node_id").alias("state"), "term_id", "start", "stop"), ["graph_id", "state", "term_id"])
        shared = [c for c in at.columns if c in found.columns]
        return at.join(found, shared).join(nodes.drop("start", "stop"), ["graph_id", "state"])

    def _filled(self, lines: list[str], have: Sequence[str]) -> Column:
        parts = []
        for piece in re.split(r"(\w+)", "\n".join(lines)):
            if piece in self.patch.variables:
                if piece not in have:
                    raise SyntaxProblem(f"{piece} has no value here")
                parts.append(F.col(piece))
            elif piece:
                parts.append(F.lit(piece))
        return F.concat(*parts) if parts else F.lit("")

    def marked(self) -> DataFrame:
        """graph_id and line of what is marked."""
        rows = [self._spans(x).select("graph_id", "line") for x in self.patch.order if isinstance(x, Item) and x.mark == "*" and id(x) in self.places]
        out = rows[0]
        for r in rows[1:]:
            out = out.union(r)
        return out.distinct()

    def edits(self, texts: DataFrame) -> DataFrame:
        """texts: file, text; a graph's id begins with its file's name and #. Edits file, offset, length and new, each once."""
        out = None
        for x in self.patch.order:
            if not isinstance(x, Item) or not self._edited(x) or x.mark == "*" and not (x.before or x.after):
                continue
            rows = self._spans(x).where("start is not null").withColumn("file", F.substring_index("graph_id", "#", 1)).join(texts, "file")
            lead = F.regexp_extract(F.expr("substring(text, 1, start)"), r"(?:^|\n)([ \t]*)[^\n]*\z", 1)
            rest = F.regexp_extract(F.expr("substring(text, stop + 1)"), r"^[ \t]*(?:\n|$)", 0)
            rows = rows.withColumn("_lead", lead).withColumn("_rest", rest)
            have = rows.columns
            indented = lambda lines: F.replace(self._filled(lines, have), F.lit("\n"), F.concat(F.lit("\n"), F.col("_lead")))
            kinds = []
            if x.text == RETURN:  # a return's brace stays
                ends, rows = rows.where("_brace"), rows.where("not _brace")
                if x.before or x.after:
                    one = ends.select("file", F.col("start").cast("long").alias("offset"), F.lit(0).cast("long").alias("length"), F.concat(indented(x.before + x.after), F.lit("\n"), F.col("_lead")).alias("new"))
                    out = one if out is None else out.union(one)
            if x.before:
                kinds.append((F.col("start"), F.lit(0), F.concat(indented(x.before), F.lit("\n"), F.col("_lead"))))
            if x.mark == "-" and x.after:
                kinds.append((F.col("start"), F.col("stop") - F.col("start"), indented(x.after)))
            elif x.mark == "-":
                alone = F.expr("_rest <> '' and substring(text, 1, start) rlike '(^|\\\\n)[ \\\\t]*$'") & F.lit(x.whole)
                kinds.append((F.when(alone, F.col("start") - F.length("_lead")).otherwise(F.col("start")), F.col("stop") - F.col("start") + F.when(alone, F.length("_lead") + F.length("_rest")).otherwise(0), F.lit("")))
            elif x.after:
                kinds.append((F.col("stop"), F.lit(0), F.concat(F.lit("\n"), F.col("_lead"), indented(x.after))))
            for offset, length, new in kinds:
                one = rows.select("file", offset.cast("long").alias("offset"), length.cast("long").alias("length"), new.alias("new"))
                out = one if out is None else out.union(one)
        return out.distinct()


def matches(program: Program, text: str, exists: bool = False, using: Sequence[str] = ()) -> Matches:
    return Matches(program, read(text), exists, using)
