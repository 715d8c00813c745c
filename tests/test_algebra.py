"""Path operators and set operations against plain evaluators on random graphs of up to eight nodes."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import paths as P
from pathloom.operators import triples as T
from pathloom.operators.relation import Graph, Relation
from pathloom.plans.formula import Always, And, Evaluator, Next, No, Not, Or, Pred, Until, Yes, simplified
from pathloom.sources.scans import closed, loop_entries, orphans


class Naive:
    def __init__(self, nodes, edges):
        self.nodes, self.succ = set(nodes), {n: {b for a, b in edges if a == n} for n in nodes}

    def back(self):
        other = Naive(self.nodes, [])
        other.succ = {n: {a for a in self.nodes if n in self.succ[a]} for n in self.nodes}
        return other

    def ex(self, x):
        return {n for n in self.nodes if self.succ[n] & x}

    def ax(self, x):
        return {n for n in self.nodes if self.succ[n] <= x}

    def grow(self, step, start):
        while (new := start | step(start)) != start:
            start = new
        return start

    def shrink(self, step, start):
        while (new := start & step(start)) != start:
            start = new
        return start

    def eu(self, a, b):
        return self.grow(lambda y: a & self.ex(y), set(b))

    def au(self, a, b):
        return self.grow(lambda y: a & self.ax(y), set(b))

    def aw(self, a, b):
        return self.shrink(lambda y: b | (a & self.ax(y)), a | b)

    def eg(self, a):
        return self.shrink(self.ex, set(a))

    def ag(self, a):
        return self.shrink(self.ax, set(a))


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(5)
    graphs = {}
    for g in range(60):
        n = rng.randint(2, 8)
        edges = {(a, rng.randrange(n)) for a in range(n) for _ in range(rng.randint(1, 3))}
        labels = {k: (rng.random() < 0.6, rng.random() < 0.4) for k in range(n)}
        graphs[g] = (range(n), edges, labels)
    nodes = spark.createDataFrame([(g, k, *labels[k]) for g, (_, _, labels) in graphs.items() for k in labels], "graph_id long, node_id long, p boolean, q boolean").persist()
    edges = spark.createDataFrame([(g, a, b, "Direct") for g, (_, es, _) in graphs.items() for a, b in es], "graph_id long, src long, dst long, edge_kind string").persist()
    return graphs, Graph(nodes, edges)


def _p(g):
    return T.label_scan(g, F.col("p"))


def _q(g):
    return T.label_scan(g, F.col("q"))


OPERATORS = {
    "ex": (lambda g: P.ex(g, _p(g)), lambda n, p, q: n.ex(p)),
    "ex_back": (lambda g: P.ex(g, _p(g), "backward"), lambda n, p, q: n.back().ex(p)),
    "ax": (lambda g: P.ax(g, _p(g)), lambda n, p, q: n.ax(p)),
    "eu": (lambda g: P.eu(g, _p(g), _q(g)), lambda n, p, q: n.eu(p, q)),
    "eu_back": (lambda g: P.eu(g, _p(g), _q(g), "backward"), lambda n, p, q: n.back().eu(p, q)),
    "au": (lambda g: P.au(g, _p(g), _q(g)), lambda n, p, q: n.au(p, q)),
    "aw": (lambda g: P.aw(g, _p(g), _q(g)), lambda n, p, q: n.aw(p, q)),
    "ef": (lambda g: P.ef(g, _q(g)), lambda n, p, q: n.eu(n.nodes, q)),
    "af": (lambda g: P.af(g, _q(g)), lambda n, p, q: n.au(n.nodes, q)),
    "eg": (lambda g: P.eg(g, _p(g)), lambda n, p, q: n.eg(p)),
    "ag": (lambda g: P.ag(g, _p(g)), lambda n, p, q: n.ag(p)),
    "ag_is_not_ef_not": (lambda g: T.complement(g.states(), P.ef(g, T.complement(g.states(), _p(g)))), lambda n, p, q: n.ag(p)),
    "af_is_not_eg_not": (lambda g: T.complement(g.states(), P.eg(g, T.complement(g.states(), _q(g)))), lambda n, p, q: n.au(n.nodes, q)),
    "reachable": (lambda g: P.reachable(g, _q(g)), lambda n, p, q: n.back().eu(n.nodes, q)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(world, name):
    graphs, graph = world
    build, plain = OPERATORS[name]
    found = {(r.graph_id, r.state) for r in build(graph).df.collect()}
    wanted = set()
    for g, (nodes, edges, labels) in graphs.items():
        p, q = ({k for k, v in labels.items() if v[i]} for i in (0, 1))
        wanted |= {(g, n) for n in plain(Naive(nodes, edges), p, q)}
    assert found == wanted


def test_rewrites_and_ablation_agree(world):
    """Prefilter and required states change nothing, nor does folding constants."""
    _, graph = world
    p, q = Pred("p"), Pred("q")
    formula = And(p, Next(Until(Not(And(q, Not(p))), q)))
    whole = [Evaluator(graph, a, b).run(formula) for a, b in itertools.product((True, False), repeat=2)]
    sets = [{tuple(r) for r in w.df.select("graph_id", "state").collect()} for w in whole]
    assert sets[0] == sets[1] == sets[2] == sets[3] and sets[0]
    assert simplified(Or(p, Not(p))) == Yes() and simplified(And(p, No())) == No() and simplified(Not(Not(p))) == p
    assert simplified(Always(And(p, Yes()))) == Always(p)


def test_loops_weaken_until(spark):
    """On a cycle A[p U q] holds by staying in the cycle, if its entry is marked; without marks it doesn't."""
    nodes = spark.createDataFrame([(1, k, k != 3, k == 3, k == 1) for k in (1, 2, 3)], "graph_id long, node_id long, p boolean, q boolean, is_loop boolean")
    edges = spark.createDataFrame([(1, 1, 2, "Direct"), (1, 2, 1, "Direct"), (1, 2, 3, "Direct"), (1, 3, 3, "Direct")], "graph_id long, src long, dst long, edge_kind string")
    weak, strict = Graph(nodes, edges), Graph(nodes.drop("is_loop"), edges)
    assert {r.state for r in P.au(weak, _p(weak), _q(weak)).df.collect()} == {1, 2, 3}
    assert {r.state for r in P.au(strict, _p(strict), _q(strict)).df.collect()} == {3}


def _allowed(row, env):
    return all((row[v] is None or row[v] == x) and x not in (row[f"{v}__not"] or []) for v, x in env.items())


def test_complement_of_two_variables(spark):
    """The complement holds exactly for the values that no row of the state allows."""
    rng = random.Random(3)
    values = ["a", "b", "c"]
    rows = [(1, s, rng.choice(values), rng.choice(values)) for s in range(6) for _ in range(s)]
    states = spark.createDataFrame([(1, s) for s in range(6)], "graph_id long, state long")
    r = Relation(spark.createDataFrame(rows, "graph_id long, state long, x string, y string"), ("x", "y")).distinct()
    found = T.complement(states, r).df.collect()
    for s in range(6):
        for x, y in itertools.product([*values, "d"], repeat=2):
            inside = any(t[1] == s and t[2:] == (x, y) for t in rows)
            assert any(f.state == s and _allowed(f.asDict(), {"x": x, "y": y}) for f in found) != inside


def test_union_drops_what_is_less_general(spark):
    a = Relation(spark.createDataFrame([(1, 1, "u"), (1, 2, "u")], "graph_id long, state long, x string"), ("x",))
    b = Relation(spark.createDataFrame([(1, 1)], "graph_id long, state long"))
    assert {(r.state, r.x) for r in T.union(a, b).df.collect()} == {(1, None), (2, "u")}


def test_exists_drops_mere_exclusions(spark):
    states = spark.createDataFrame([(1, 1), (1, 2)], "graph_id long, state long")
    a = Relation(spark.createDataFrame([(1, 1, "u")], "graph_id long, state long, x string"), ("x",))
    left = T.exists("x", T.complement(states, a))
    assert {r.state for r in left.df.collect()} == {2}


def test_and_any_refuses_several_states(spark, world):
    _, graph = world
    with pytest.raises(ValueError):
        T.and_any(graph, _p(graph), _q(graph), lambda a: P.reach_pairs(graph, a))


def test_graph_repairs(spark):
    nodes = spark.createDataFrame([(1, k) for k in (1, 2, 3, 4)], "graph_id long, node_id long")
    edges = spark.createDataFrame([(1, 1, 2, "Direct"), (1, 2, 3, "Direct"), (1, 3, 2, "Direct")], "graph_id long, src long, dst long, edge_kind string")
    g = Graph(nodes, edges)
    assert {(r.src, r.dst) for r in closed(g).edges.collect()} == {(1, 2), (2, 3), (3, 2), (4, 4)}
    assert {r.node_id for r in orphans(g, F.col("node_id") == 1).collect()} == {4}
    assert {r.node_id for r in loop_entries(g, F.col("node_id") == 1).collect()} == {"2"}
