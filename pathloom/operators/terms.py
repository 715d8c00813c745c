"""Matching of expression patterns against terms: a pattern is a term itself, some of whose names are variables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.csource import Parser, SyntaxProblem, Term, lex
from .relation import Relation


#: Terms whose parts are lists: all parts must be there.
LISTS = ("call", "header", "declarator")


def pattern(text: str) -> Term:
    p = Parser(lex(text))
    e = p.expression()
    if p.at < len(p.tokens):
        raise SyntaxProblem(f"{p.peek()!r} isn't expected")
    return e


def head(name: str, *params: str) -> Term:
    """A function's head; "..." stands for any parameters."""
    return Term("header", name, [Term("ident", name), *[Term("dots", p) if p == "..." else Term("param", p) for p in params]])


def match(terms: DataFrame, what: Term, variables: Sequence[str], kinds: dict[str, Sequence[str]] | None = None, root: bool = False) -> DataFrame:
    """graph_id, node_id, term_id and the variables' texts for each term that fits. Parts are joined to their parents by place; a
    variable that occurs twice must have the same text. kinds: of the terms that a variable may stand for. root: only a node's whole
    term. Dots among arguments stand for any number of these, elsewhere for any term."""
    keys = ["graph_id", "node_id"]
    kinds = kinds or {}

    def rows(t: Term) -> DataFrame:
        if t.kind in ("ident", "type", "param") and t.text in variables:
            own = kinds.get(t.text, () if t.kind == "ident" else (t.kind,))
            return (terms.where(F.col("kind").isin(*own)) if own else terms).select(*keys, "term_id", "parent_id", "ord", F.col("text").alias(t.text))
        fit = F.col("kind") == t.kind
        if t.op:
            fit = fit & (F.col("op") == t.op)
        if not t.parts:
            fit = fit & (F.col("text") == t.text)
        found = terms.where(fit).select(*keys, "term_id", "parent_id", "ord")
        dots = [k for k, p in enumerate(t.parts) if p.kind == "dots"] if t.kind in LISTS else []
        if len(dots) > 2 or len(dots) == 2 and dots[1] - dots[0] > 2:
            raise SyntaxProblem("one argument may stand between dots")
        if t.kind in LISTS:
            sizes = terms.where("parent_id is not null").groupBy(*keys, F.col("parent_id").alias("term_id")).agg(F.count(F.lit(1)).alias("_n"))
            found = found.join(sizes, [*keys, "term_id"]).where(F.col("_n") >= len(t.parts) - len(dots) if dots else F.col("_n") == len(t.parts))
        for k, part in enumerate(t.parts):
            if part.kind == "dots":
                continue
            place = F.col("_at") == k
            if dots and k > dots[-1]:
                place = F.col("_at") == F.col("_n") - (len(t.parts) - k)
            elif dots and k > dots[0]:
                place = (F.col("_at") >= dots[0]) & (F.col("_at") < F.col("_n") - (len(t.parts) - 1 - dots[-1]))
            below = rows(part).drop("term_id").withColumnsRenamed({"parent_id": "term_id", "ord": "_at"})
            shared = [v for v in variables if v in found.columns and v in below.columns]
            found = found.join(below, [*keys, "term_id", *shared]).where(place).drop("_at")
        return found.drop("_n")

    found = rows(what)
    return (found.where("parent_id is null") if root else found).drop("parent_id", "ord")


def any_of(*found: DataFrame) -> DataFrame:
    """Alternatives in order: a node's later alternative counts only where no earlier one fits there."""
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more.join(out.select("graph_id", "node_id").distinct(), ["graph_id", "node_id"], "left_anti"), allowMissingColumns=True)
    return out


def all_of(*found: DataFrame) -> DataFrame:
    out = found[0].drop("term_id")
    for more in found[1:]:
        shared = [c for c in out.columns if c in more.columns and c != "term_id"]
        out = out.join(more.drop("term_id"), shared)
    return out.distinct()


def below(terms: DataFrame, found: DataFrame) -> DataFrame:
    """found: graph_id, node_id, term_id. All its subterms, itself among them, level by level within each node."""
    links = terms.select("graph_id", "node_id", F.col("parent_id").alias("term_id"), F.col("term_id").alias("child"))
    out = level = found.select("graph_id", "node_id", F.col("term_id").alias("root"), "term_id").distinct()
    while True:
        level = level.join(links, ["graph_id", "node_id", "term_id"]).select("graph_id", "node_id", "root", F.col("child").alias("term_id"))
        if level.isEmpty():
            return out
        out = out.union(level)


def holding(terms: DataFrame, found: DataFrame, part: int, what: Term, variables: Sequence[str] = ()) -> DataFrame:
    """found: graph_id, node_id, term_id and more. Those terms whose part of that place has what somewhere in it, with its variables."""
    keys = ["graph_id", "node_id", "term_id"]
    parts = terms.where(F.col("ord") == part).select("graph_id", "node_id", F.col("parent_id").alias("term_id"), F.col("term_id").alias("root"))
    roots = found.select(*keys).distinct().join(parts, keys)
    inner = match(terms, what, variables)
    within = below(terms, roots.select("graph_id", "node_id", F.col("root").alias("term_id"))).join(inner, keys).drop("term_id").distinct()
    shared = [v for v in variables if v in found.columns]
    return found.join(roots.join(within, ["graph_id", "node_id", "root"]).drop("root").distinct(), [*keys, *shared])


def chain(terms: DataFrame, found: DataFrame, op: str) -> DataFrame:
    """The operands of a chain of one associative operator, at any depth."""
    inner = below(terms.where((F.col("kind") == "binary") & (F.col("op") == op)), found)
    operands = terms.where(~((F.col("kind") == "binary") & (F.col("op") == op))).select("graph_id", "node_id", F.col("parent_id").alias("term_id"), F.col("text").alias("operand"))
    return inner.join(operands, ["graph_id", "node_id", "term_id"]).select("graph_id", "node_id", "root", "operand")


def arguments(terms: DataFrame, function: str) -> DataFrame:
    """Calls of a function with the array of their arguments' texts."""
    call = terms.where("kind = 'call'").select("graph_id", "node_id", "term_id")
    name = terms.where((F.col("ord") == 0) & (F.col("text") == function)).select("graph_id", "node_id", F.col("parent_id").alias("term_id"))
    args = terms.where("ord > 0").select("graph_id", "node_id", F.col("parent_id").alias("term_id"), F.struct("ord", "text").alias("a"))
    rows = call.join(name, ["graph_id", "node_id", "term_id"]).join(args, ["graph_id", "node_id", "term_id"], "left")
    grouped = rows.groupBy("graph_id", "node_id", "term_id").agg(F.array_sort(F.collect_list("a")).alias("a"))
    return grouped.select("graph_id", "node_id", "term_id", F.transform("a", lambda x: x["text"]).alias("args"))


def starts_with(args: Column, *texts: str) -> Column:
    """A list pattern `texts, ...`."""
    return F.slice(args, 1, len(texts)) == F.array(*[F.lit(t) for t in texts])


def relation(found: DataFrame, variables: Sequence[str] = ()) -> Relation:
    rows = found.select("graph_id", F.col("node_id").alias("state"), *variables)
    return Relation(rows, tuple(variables)).distinct()


def types_of(terms: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, node_id, name, type of each identifier used: its declaration in the innermost block that encloses the use, else the
    function's parameter."""
    decl = terms.where("kind = 'declarator'").select("graph_id", "node_id", F.col("term_id").alias("parent_id"), F.col("text").alias("name"))
    kind = terms.where("kind = 'type'").select("graph_id", "node_id", "parent_id", F.col("text").alias("type"))
    at = nodes.select("graph_id", "node_id", "labels")
    local = decl.join(kind, ["graph_id", "node_id", "parent_id"]).join(at, ["graph_id", "node_id"])
    local = local.select("graph_id", "name", "type", F.slice("labels", 1, F.size("labels") - 1).alias("scope"), F.col("node_id").alias("d"))
    param = terms.where("kind = 'param'").select("graph_id", F.regexp_extract("text", r"(\w+)$", 1).alias("name"), F.trim(F.regexp_replace(F.regexp_replace("text", r"\w+$", ""), r" ?\* ?", "*")).alias("type"), F.expr("cast(array() as array<int>)").alias("scope"), F.lit(-1).alias("d"))
    uses = terms.where("kind = 'ident'").join(nodes.where("kind <> 'header'").select("graph_id", "node_id", "labels"), ["graph_id", "node_id"]).select("graph_id", "node_id", F.col("text").alias("name"), "labels").distinct()
    met = uses.join(local.unionByName(param), ["graph_id", "name"]).where((F.slice("labels", F.lit(1), F.size("scope")) == F.col("scope")) & (F.col("d") <= F.col("node_id")))
    return met.groupBy("graph_id", "node_id", "name").agg(F.max_by("type", F.struct(F.size("scope"), "d")).alias("type"))
