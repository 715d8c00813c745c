"""Path operators. dir: "forward" or "backward". Existential steps use all edges, universal ones the Direct edges only.

On graphs whose nodes each have one successor (Graph.linear), forward until-operators without variables are one running window; on
others they are semi-naive loops whose steps are tables in the shared folder: a step looks at the rows that the one before found.
Universal until counts down the successors of a state that aren't found yet; weak until and always spread what fails. Only
universal operators over rows with variables step over whole relations.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relation import KEYS, Graph, Relation, cut
from .triples import complement, conj_join, difference, not_exists, required_states, top, union_plain

#: After so many steps, the tables of a growing relation become one.
COMPACT = 16


def _edges(graph: Graph, direction: str, direct: bool = False) -> DataFrame:
    """here, there: one step looks from here to there."""
    e = graph.edges.where("edge_kind = 'Direct'") if direct else graph.edges
    here, there = ("src", "dst") if direction == "forward" else ("dst", "src")
    return e.select("graph_id", F.col(here).alias("here"), F.col(there).alias("there"))


def ex(graph: Graph, a: Relation, direction: str = "forward", direct: bool = False) -> Relation:
    rows = a.df.withColumnRenamed("state", "there").join(_edges(graph, direction, direct), ["graph_id", "there"])
    return a.with_df(rows.drop("there").withColumnRenamed("here", "state").select(*a.columns)).distinct()


def ax(graph: Graph, a: Relation, direction: str = "forward") -> Relation:
    """All neighbours over Direct edges: as many neighbours fit (with one binding of the variables) as there are. Where variables may be
    unbound, a join for each neighbour's number in turn."""
    e = _edges(graph, direction, True).distinct()
    if a.ground:
        hit = e.join(a.df.select("graph_id", F.col("state").alias("there"), F.lit(1).alias("one")).distinct(), ["graph_id", "there"], "left")
        full = hit.groupBy("graph_id", F.col("here").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.count("one").alias("m")).where("n = m")
        return Relation(full.select(*KEYS))
    if not a.maybe:
        degrees = e.groupBy("graph_id", "here").agg(F.count(F.lit(1)).alias("degree"))
        rows = a.df.select(*KEYS, *a.bound).withColumnRenamed("state", "there").distinct().join(e, ["graph_id", "there"])
        met = rows.groupBy("graph_id", "here", *a.bound).agg(F.count(F.lit(1)).alias("met")).join(degrees, ["graph_id", "here"]).where("met = degree")
        return Relation(met.withColumnRenamed("here", "state").select(*KEYS, *a.bound), a.bound)
    w = Window.partitionBy("graph_id", "here").orderBy("there")
    ranked = cut(e.withColumn("nth", F.row_number().over(w)).withColumn("degree", F.count(F.lit(1)).over(Window.partitionBy("graph_id", "here"))))
    most = ranked.agg(F.max("degree")).first()[0] or 0
    done = None
    for k in range(1, most + 1):
        step = ranked.where(F.col("nth") == k).drop("nth", "degree")
        part = a.with_df(a.df.withColumnRenamed("state", "there").join(step, ["graph_id", "there"]).withColumnRenamed("here", "state").select(*a.columns)).distinct()
        if done is None:
            done = part
            continue
        enough = ranked.where((F.col("nth") == 1) & (F.col("degree") < k)).select("graph_id", F.col("here").alias("state"))
        done = union_plain(done.with_df(done.df.join(enough, list(KEYS), "left_semi")), conj_join(done, part))
    return done if done is not None else a


def _linear_until(graph: Graph, a: Relation, b: Relation, weak: bool) -> Relation:
    """The first position from here on where b holds or a doesn't decides. It is carried backward along the trace, so each row is looked at once."""
    marks = graph.nodes.select("graph_id", F.col("node_id").alias("state"), F.col(graph.linear).alias("_pos"))
    marks = marks.join(a.df.select(*KEYS, F.lit(True).alias("_a")).distinct(), list(KEYS), "left").join(b.df.select(*KEYS, F.lit(True).alias("_b")).distinct(), list(KEYS), "left")
    goal = F.coalesce("_b", F.lit(False))
    ends = F.when(goal | F.col("_a").isNull(), goal)
    w = Window.partitionBy("graph_id").orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return Relation(marks.withColumn("_end", F.last(ends, ignorenulls=True).over(w)).where(F.coalesce("_end", F.lit(weak))).select(*KEYS))


def _linear(graph: Graph, direction: str, *relations: Relation) -> bool:
    return graph.linear is not None and direction == "forward" and all(r.ground for r in relations)


def eu(graph: Graph, a: Relation | None, b: Relation, direction: str = "forward", direct: bool = False) -> Relation:
    """E[a U b]; a None is True. Each step looks at new rows only."""
    if _linear(graph, direction, b, *([a] if a else [])):
        return _linear_until(graph, a or top(graph), b, False)
    graph = Graph(graph.nodes, cut(graph.edges))
    seen = delta = b.distinct()
    seen = delta = seen.with_df(cut(seen.df))
    for n in itertools.count(1):
        step = ex(graph, delta, direction, direct)
        step = conj_join(step, a) if a is not None else step
        if set(step.variables) != set(seen.variables) or step.maybe != seen.maybe:
            loose = tuple(v for v in dict.fromkeys([*seen.variables, *step.variables]) if v not in seen.bound or v not in step.bound)
            seen, step = seen.loosened(loose), step.loosened(loose)
        fresh = difference(step, seen)
        delta = fresh.with_df(cut(fresh.df))
        if delta.df.isEmpty():
            return seen
        seen = seen.with_df(seen.df.select(*seen.columns).unionByName(delta.df.select(*seen.columns)))
        if n % COMPACT == 0:
            seen = seen.with_df(cut(seen.df))
    return seen


def ef(graph: Graph, b: Relation, direction: str = "forward") -> Relation:
    return eu(graph, None, b, direction)


def least(step: Callable[[Relation], Relation], start: Relation) -> Relation:
    """The fixpoint of a growing, or of a shrinking, step from start: there the number of rows stays."""
    now, before = start.with_df(cut(start.df)), -1
    while (n := now.df.count()) != before:
        now, before = step(now), n
        now = now.with_df(cut(now.df))
    return now


greatest = least


def led_only_to(edges: DataFrame, candidates: DataFrame, start: DataFrame) -> DataFrame:
    """edges: graph_id, here, there, stored and distinct; candidates, start: graph_id, state. start, and the candidates all of whose edges
    lead to what is found: of each candidate the edges that lead elsewhere are counted down by the states found in the step before."""
    degrees = edges.groupBy("graph_id", F.col("here").alias("state")).agg(F.count(F.lit(1)).alias("left"))
    delta = cut(start.select(*KEYS).distinct())
    waiting = cut(candidates.select(*KEYS).distinct().join(delta, list(KEYS), "left_anti").join(degrees, list(KEYS)))
    found = delta
    for n in itertools.count(1):
        met = delta.withColumnRenamed("state", "there").join(edges, ["graph_id", "there"]).groupBy("graph_id", F.col("here").alias("state")).agg(F.count(F.lit(1)).alias("met"))
        counted = cut(waiting.join(met, list(KEYS), "left").select(*KEYS, (F.col("left") - F.coalesce("met", F.lit(0))).alias("left")))
        delta = counted.where("left = 0").select(*KEYS)
        if delta.isEmpty():
            return found
        waiting, found = counted.where("left > 0"), found.union(delta)
        found = cut(found) if n % COMPACT == 0 else found
    return found


def _without_edges(edges: DataFrame, states: DataFrame) -> DataFrame:
    return states.select(*KEYS).join(edges.select("graph_id", F.col("here").alias("state")).distinct(), list(KEYS), "left_anti")


def meets_loop(graph: Graph, found: Relation) -> DataFrame:
    """Graphs where one of the states found is a loop's entry."""
    loops = graph.nodes.where("is_loop").select("graph_id", F.col("node_id").alias("state"))
    return found.df.select(*KEYS).join(loops, list(KEYS), "left_semi").select("graph_id").distinct()


def _part(graph: Graph, graphs: DataFrame, inside: bool) -> Graph:
    how = "left_semi" if inside else "left_anti"
    return Graph(graph.nodes.join(graphs, "graph_id", how), graph.edges.join(graphs, "graph_id", how), graph.linear)


def au(graph: Graph, a: Relation, b: Relation, direction: str = "forward") -> Relation:
    """A[a U b]. In graphs where E[a U b] meets a loop's entry it is A[(E[a U b] and a) W b]: a path may stay in the loop."""
    if _linear(graph, direction, a, b):
        return _linear_until(graph, a, b, False)
    looping = "is_loop" in graph.nodes.columns
    if looping:
        possible = eu(graph, a, b, direction)
        graphs = cut(meets_loop(graph, possible))
        looping = not graphs.isEmpty()
    strict = _part(graph, graphs, False) if looping else graph
    keep = lambda r, inside: r.with_df(r.df.join(graphs, "graph_id", "left_semi" if inside else "left_anti"))
    a1, b1 = (keep(a, False), keep(b, False)) if looping else (a, b)
    if a1.ground and b1.ground:
        out = Relation(led_only_to(cut(_edges(strict, direction, True).distinct()), a1.df, b1.df))
    else:
        out = least(lambda y: union_plain(b1, conj_join(a1, ax(strict, y, direction))), b1)
    if looping:
        weak = aw(_part(graph, graphs, True), keep(conj_join(possible, a), True), keep(b, True), direction)
        out = union_plain(out, weak)
    return out


def aw(graph: Graph, a: Relation, b: Relation, direction: str = "forward") -> Relation:
    """A[a W b]: as until, but a may also hold for ever; a greatest fixpoint. Without variables: all but the states from which a path over
    states of a leads to one of neither."""
    if _linear(graph, direction, a, b):
        return _linear_until(graph, a, b, True)
    if a.ground and b.ground:
        edges = cut(_edges(graph, direction, True).distinct())
        either = cut(a.df.select(*KEYS).union(b.df.select(*KEYS)).distinct())
        only_a = cut(a.df.select(*KEYS).distinct().join(b.df.select(*KEYS), list(KEYS), "left_anti"))
        fails = graph.states().join(either, list(KEYS), "left_anti").union(_without_edges(edges, only_a)).distinct()
        open_ = Graph(graph.nodes, edges.select("graph_id", F.col("here").alias("src"), F.col("there").alias("dst"), F.lit("Direct").alias("edge_kind")))
        bad = eu(open_, Relation(only_a), Relation(fails))
        return Relation(either.join(bad.df.select(*KEYS), list(KEYS), "left_anti"))
    return greatest(lambda y: union_plain(b, conj_join(a, ax(graph, y, direction))), union_plain(a, b))


def af(graph: Graph, b: Relation, direction: str = "forward") -> Relation:
    return au(graph, top(graph), b, direction)


def ag(graph: Graph, a: Relation, direction: str = "forward") -> Relation:
    if _linear(graph, direction, a):
        return _linear_until(graph, a, Relation(a.df.where(F.lit(False))), True)
    if a.ground:
        return aw(graph, a, Relation(a.df.where(F.lit(False))), direction)
    return greatest(lambda y: conj_join(a, ax(graph, y, direction)), a.distinct())


def eg(graph: Graph, a: Relation, direction: str = "forward") -> Relation:
    if _linear(graph, direction, a):
        return _linear_until(graph, a, Relation(a.df.where(F.lit(False))), True)
    if a.ground:
        edges, own = cut(_edges(graph, direction).distinct()), cut(a.df.select(*KEYS).distinct())
        fails = graph.states().join(own, list(KEYS), "left_anti").union(_without_edges(edges, own)).distinct()
        return Relation(own.join(led_only_to(edges, own, fails), list(KEYS), "left_anti"))
    return greatest(lambda y: conj_join(a, ex(graph, y, direction)), a.distinct())


def children(graph: Graph, a: Relation, direction: str = "forward") -> Relation:
    """The states one step ahead."""
    rows = a.df.select("graph_id", F.col("state").alias("here")).distinct().join(_edges(graph, direction), ["graph_id", "here"])
    return Relation(rows.select("graph_id", F.col("there").alias("state")).distinct())


def reachable(graph: Graph, a: Relation, direction: str = "forward") -> Relation:
    """The states on paths from a's states, with these."""
    back = "backward" if direction == "forward" else "forward"
    return ef(graph, Relation(a.df.select(*KEYS).distinct()), back)


def reach_pairs(graph: Graph, a: Relation, direction: str = "forward") -> DataFrame:
    """graph_id, state (of a) and each state reached from it."""
    edges = cut(_edges(graph, direction))
    seen = delta = cut(a.df.select("graph_id", "state", F.col("state").alias("reached")).distinct())
    for n in itertools.count(1):
        step = delta.withColumnRenamed("reached", "here").join(edges, ["graph_id", "here"])
        step = step.select("graph_id", "state", F.col("there").alias("reached")).distinct()
        delta = cut(step.join(seen, ["graph_id", "state", "reached"], "left_anti"))
        if delta.isEmpty():
            return seen
        seen = cut(seen.union(delta)) if n % COMPACT == 0 else seen.union(delta)
    return seen


def strict(universal: Relation, existential: Relation) -> Relation:
    """In partial mode a universal step also gives what only some path gives, marked by `full`."""
    rest = existential.with_df(existential.df.join(universal.df.select(*KEYS).distinct(), list(KEYS), "left_anti"))
    return Relation(universal.df.select(*KEYS, F.lit(True).alias("full")).union(rest.df.select(*KEYS, F.lit(False).alias("full"))).distinct())


def unreached(graph: Graph, modified: Relation, roots: Relation) -> Relation:
    """Modified states some backward path of which meets no root."""
    return difference(modified, conj_join(modified, af(graph, roots, "backward")))


def revisited(graph: Graph, modified: Relation, roots: Relation) -> Relation:
    """Modified states that a path without a root comes back to."""
    free = not_exists(graph.states(), roots)
    return conj_join(modified, ex(graph, eu(graph, free, modified)))


def only_in_graphs_of(graph: Graph, *needed: Relation) -> DataFrame:
    """Graphs that hold a row of each relation: a match needs them all, so the others can be left out from the start."""
    ids = needed[0].df.select("graph_id").distinct()
    for r in needed[1:]:
        ids = ids.join(r.df.select("graph_id").distinct(), "graph_id", "left_semi")
    return ids


def negation(graph: Graph, a: Relation) -> Relation:
    return complement(graph.states(), a)
