"""Formulas: a small tree that is rewritten before it is lowered to relations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields, replace

from pyspark.sql import functions as F

from ..operators import paths as P
from ..operators import triples as T
from ..operators.relation import Graph, Relation, cut


@dataclass(frozen=True)
class Formula:
    def parts(self) -> Iterator[Formula]:
        for f in fields(self):
            x = getattr(self, f.name)
            if isinstance(x, Formula):
                yield x


@dataclass(frozen=True)
class Yes(Formula):
    pass


@dataclass(frozen=True)
class No(Formula):
    pass


@dataclass(frozen=True)
class Pred(Formula):
    """Nodes where a SQL condition holds; binds: (variable, SQL expression)."""

    where: str
    binds: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Not(Formula):
    a: Formula


@dataclass(frozen=True)
class And(Formula):
    a: Formula
    b: Formula


@dataclass(frozen=True)
class Or(Formula):
    a: Formula
    b: Formula


@dataclass(frozen=True)
class SeqOr(Formula):
    a: Formula
    b: Formula


@dataclass(frozen=True)
class Some(Formula):
    """There is a value of v."""

    v: str
    a: Formula
    keep: bool = False


@dataclass(frozen=True)
class Next(Formula):
    """EX, or AX for every."""

    a: Formula
    every: bool = False
    direction: str = "forward"


@dataclass(frozen=True)
class Until(Formula):
    """E[a U b], or A[a U b] for every; weak: a may hold for ever."""

    a: Formula
    b: Formula
    every: bool = False
    weak: bool = False
    direction: str = "forward"


@dataclass(frozen=True)
class Always(Formula):
    a: Formula
    every: bool = False
    direction: str = "forward"


@dataclass(frozen=True)
class Let(Formula):
    name: str
    a: Formula
    b: Formula


@dataclass(frozen=True)
class Ref(Formula):
    name: str


def finally_(a: Formula, every: bool = False, direction: str = "forward") -> Formula:
    return Until(Yes(), a, every, False, direction)


def simplified(x: Formula) -> Formula:
    """Constants folded, double negations and x or not x removed; a step over a shared definition goes below it."""
    changed = {f.name: simplified(getattr(x, f.name)) for f in fields(x) if isinstance(getattr(x, f.name), Formula)}
    x = replace(x, **changed) if changed else x
    if isinstance(x, Not):
        if isinstance(x.a, Not):
            return x.a.a
        return No() if isinstance(x.a, Yes) else Yes() if isinstance(x.a, No) else x
    if isinstance(x, And):
        if No() in (x.a, x.b):
            return No()
        return x.b if x.a in (Yes(), x.b) else x.a if x.b == Yes() else x
    if isinstance(x, (Or, SeqOr)):
        if Yes() in (x.a, x.b) or Not(x.a) == x.b or x.a == Not(x.b):
            return Yes()
        return x.b if x.a in (No(), x.b) else x.a if x.b == No() else x
    if isinstance(x, Until) and (x.b in (Yes(), No()) and not x.weak):
        return x.b
    if isinstance(x, Next):
        if isinstance(x.a, Let):
            return Let(x.a.name, x.a.a, simplified(replace(x, a=x.a.b)))
        return x.a if x.a in (Yes(), No()) else x
    return x


def needed(x: Formula) -> list[list[Pred]]:
    """Alternatives of predicates that must all occur in a graph for x to hold somewhere; an empty alternative needs nothing."""
    if isinstance(x, Pred):
        return [[x]]
    if isinstance(x, And):
        return [[*a, *b] for a in needed(x.a) for b in needed(x.b)]
    if isinstance(x, (Or, SeqOr)):
        return needed(x.a) + needed(x.b)
    if isinstance(x, (Some, Next)):
        return needed(x.a)
    if isinstance(x, Until):
        return needed(x.b) if not x.weak else [[]]
    if isinstance(x, Always):
        return needed(x.a)
    if isinstance(x, Let):
        return needed(x.b)
    return [[]]


class Evaluator:
    """Lowers formulas over one graph. Predicates are scanned once each; graphs without what a formula needs are left out first."""

    def __init__(self, graph: Graph, prefilter: bool = True, required: bool = True):
        self.graph, self.prefilter, self.required = graph, prefilter, required
        self.scans: dict[Pred, Relation] = {}

    def run(self, x: Formula) -> Relation:
        x = simplified(x)
        graph, self.scans = self.graph, {}  # scans are those of the graphs that this formula's prefilter leaves
        alternatives = needed(x)
        if self.prefilter and alternatives and all(alternatives):
            keep = None
            for preds in alternatives:
                ids = graph.nodes.groupBy("graph_id").agg(*[F.max(F.expr(f"cast(({p.where}) as int)")).alias(f"p{i}") for i, p in enumerate(dict.fromkeys(preds))])
                ids = ids.where(" and ".join(f"p{i} = 1" for i in range(len(dict.fromkeys(preds))))).select("graph_id")
                keep = ids if keep is None else keep.union(ids).distinct()
            graph = Graph(graph.nodes.join(keep, "graph_id", "left_semi"), graph.edges.join(keep, "graph_id", "left_semi"), graph.linear)
        return self._of(x, graph, {})

    def _scan(self, x: Pred, graph: Graph) -> Relation:
        if x not in self.scans:
            self.scans[x] = T.label_scan(graph, F.expr(x.where), {v: F.expr(e) for v, e in x.binds})
        return self.scans[x]

    def _of(self, x: Formula, g: Graph, names: dict[str, Relation]) -> Relation:
        own = lambda y: self._of(y, g, names)
        if isinstance(x, Yes):
            return T.top(g)
        if isinstance(x, No):
            return T.bottom(g)
        if isinstance(x, Pred):
            return self._scan(x, g)
        if isinstance(x, Ref):
            return names[x.name]
        if isinstance(x, Let):
            a = own(x.a)
            return self._of(x.b, g, names | {x.name: a.with_df(cut(a.df))})
        if isinstance(x, Not):
            return T.complement(g.states(), own(x.a))
        if isinstance(x, And):
            a = own(x.a)
            if self.required and isinstance(x.b, Next) and not x.b.every and x.b.direction == "forward":
                # Only successors of a's states are looked at on the right: a filter that can't pass through a loop by itself.
                inner = own(x.b.a)
                b = P.ex(g, T.required_states(inner, P.children(g, a)))
            else:
                b = own(x.b)
            return T.conj_join(a, b)
        if isinstance(x, Or):
            return T.union(own(x.a), own(x.b))
        if isinstance(x, SeqOr):
            return T.seq_or(g.states(), own(x.a), own(x.b))
        if isinstance(x, Some):
            return T.exists(x.v, own(x.a), x.keep)
        if isinstance(x, Next):
            return (P.ax if x.every else P.ex)(g, own(x.a), x.direction)
        if isinstance(x, Until):
            a = own(x.a)
            if x.weak:
                return P.aw(g, a, own(x.b), x.direction)
            return (P.au if x.every else P.eu)(g, a, own(x.b), x.direction)
        if isinstance(x, Always):
            return (P.ag if x.every else P.eg)(g, own(x.a), x.direction)
        raise TypeError(x)
