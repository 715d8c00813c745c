"""Queries of the algebra over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bindings as B
from ..operators import paths as P
from ..operators import triples as T
from ..operators.relation import Graph, Relation
from ..sources import graphs as G

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Event traces: each event's type, its place and its successor.
EVENTS = """WITH ev AS (
  SELECT user_id AS g, event_id AS s, event_type AS label, value, json_extract_string(props, '$.k') AS k,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
    coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), event_id) AS nxt
  FROM events
)"""
#: The key hierarchy: nodes with parent, level, status and flag, and for each level whether all or some line below is returned.
TREE = """WITH RECURSIVE tn AS (
  SELECT CAST(r_regionkey AS BIGINT) AS g, 'R' || r_regionkey AS s, CAST(NULL AS VARCHAR) AS parent, 'region' AS label, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS flag FROM region
  UNION ALL SELECT n_regionkey, 'N' || n_nationkey, 'R' || n_regionkey, 'nation', NULL, NULL FROM nation
  UNION ALL SELECT n_regionkey, 'C' || c_custkey, 'N' || c_nationkey, 'customer', NULL, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, 'O' || o_orderkey, 'C' || o_custkey, 'order', o_orderstatus, NULL FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT n_regionkey, 'L' || l_orderkey || '|' || l_returnflag || '|' || l_linestatus, 'O' || l_orderkey, 'line', l_linestatus, l_returnflag
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), te AS (
  SELECT g, parent AS src, s AS dst FROM tn WHERE parent IS NOT NULL
  UNION ALL SELECT g, s, s FROM tn WHERE s NOT IN (SELECT parent FROM tn WHERE parent IS NOT NULL)
)"""
#: Users' state machines, and which type reaches which in one step or more.
MACHINE = """WITH RECURSIVE mp AS (
  SELECT DISTINCT user_id AS g, event_type AS src, nxt AS dst FROM (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL
), mn AS (
  SELECT DISTINCT user_id AS g, event_type AS s FROM events
), me AS (
  SELECT * FROM mp UNION ALL SELECT g, s, s FROM mn WHERE NOT EXISTS (SELECT 1 FROM mp WHERE mp.g = mn.g AND mp.src = mn.s)
), ml AS (
  SELECT g, src AS s FROM mp WHERE src = dst
)"""


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__.rstrip("_")
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def out(r: Relation) -> DataFrame:
    """Flat columns: states as they are, exclusions as text."""
    columns = [F.col("graph_id").cast("long").alias("graph_id"), F.col("state")]
    columns += [F.col(v) for v in r.variables] + [F.array_join(F.array_sort(B.excluded(v)), ",").alias(B.excluded(v)) for v in r.maybe]
    return r.df.select(*columns)


def typed(g: Graph, *labels: str, **binds: str) -> Relation:
    return T.label_scan(g, F.col("label").isin(*labels), binds)


def flagged(g: Graph, flag: str) -> Relation:
    return T.label_scan(g, (F.col("label") == "line") & (F.col("flag") == flag))


# The flagship: an error, after which, before another error and with no signup between, a purchase comes.
@query(EVENTS + """
SELECT g AS graph_id, s AS state FROM ev a WHERE label = 'error' AND EXISTS (
  SELECT 1 FROM ev b WHERE b.g = a.g AND b.pos > a.pos AND b.label = 'purchase' AND NOT EXISTS (SELECT 1 FROM ev c WHERE c.g = a.g AND c.pos > a.pos AND c.pos < b.pos AND c.label IN ('error', 'signup')))""")
def flagship(spark, d):
    g = G.events(spark, d)
    neither = T.complement(g.states(), typed(g, "error", "signup"))
    return out(T.conj_join(typed(g, "error"), P.ex(g, P.eu(g, neither, typed(g, "purchase")))))


# Bindings
_PAIRS = "(SELECT s, CASE WHEN pos % 3 = 0 THEN label END AS a, CASE WHEN pos % 4 = 0 THEN label WHEN pos % 4 = 1 THEN 'view' END AS b FROM ev)"


def _two_sides(spark, d) -> DataFrame:
    """Two bindings of one variable for each event: values on some, exclusions on others."""
    e = G.events(spark, d).nodes
    left, right = F.when(F.col("pos") % 3 == 0, F.col("label")), F.when(F.col("pos") % 4 == 0, F.col("label")).when(F.col("pos") % 4 == 1, F.lit("view"))
    bars = lambda value, *x: F.when(value.isNull(), F.array(*[F.lit(y) for y in x])).otherwise(B.none())
    return e.select("graph_id", F.col("node_id").alias("state"), left.alias("l_v"), bars(left, "click", "view").alias("l_v__not"), right.alias("r_v"), bars(right, "error").alias("r_v__not"))


_MERGED = EVENTS + f""", p AS {_PAIRS}
SELECT s AS state, coalesce(a, b) AS v, CASE WHEN a IS NULL AND b IS NULL THEN 'click,error,view' ELSE '' END AS v__not
FROM p WHERE (a IS NULL OR b IS NULL OR a = b) AND NOT (a IS NULL AND coalesce(b, '') IN ('click', 'view')) AND NOT (b IS NULL AND coalesce(a, '') = 'error')"""


@query(_MERGED)
def sub_merge(spark, d):
    return B.merge(_two_sides(spark, d), "v", "l_", "r_").select("state", "v", F.array_join("v__not", ",").alias("v__not"))


@query(EVENTS + """
SELECT s AS state, CASE WHEN pos % 3 = 0 THEN label END AS v, CASE WHEN pos % 3 = 0 THEN '' ELSE 'click,view' END AS v__not FROM ev""")
def sub_clean(spark, d):
    rows = _two_sides(spark, d).select("state", F.col("l_v").alias("v"), F.array(F.lit("view"), F.lit("click"), F.lit("view")).alias("v__not"))
    value, barred = B.cleaned("v")
    return rows.select("state", value.alias("v"), F.array_join(barred, ",").alias("v__not"))


def _sides(spark, d):
    rows = _two_sides(spark, d)
    return [rows.select("graph_id", "state", F.col(f"{x}_v").alias("v"), F.col(f"{x}_v__not").alias("v__not")) for x in "lr"]


@query(_MERGED)
def sub_conj(spark, d):
    l, r = (Relation(x, (), ("v",)) for x in _sides(spark, d))
    return out(T.conj_join(l, r)).drop("graph_id")


@query(_MERGED + " AND (b IS NULL OR a IS NOT NULL)")
def sub_conj_subset(spark, d):
    l, r = _sides(spark, d)
    on = (F.col("l.state") == F.col("r.state")) & B.compatible("v", "l", "r") & B.within("v", "l", "r")
    value, barred = B.merged("v", "l", "r")
    return l.alias("l").join(r.alias("r"), on).select(F.col("l.state").alias("state"), value.alias("v"), F.array_join(barred, ",").alias("v__not"))


@query(EVENTS + f""", p AS {_PAIRS}
SELECT s AS state, 'v' AS var, CAST(NULL AS VARCHAR) AS value, a AS excluded FROM p WHERE a IS NOT NULL
UNION ALL SELECT s, 'v', x, NULL FROM p, (SELECT unnest(['click', 'view']) AS x) WHERE a IS NULL""")
def sub_negate(spark, d):
    return B.negated(_sides(spark, d)[0], ["v"]).select("state", "var", "value", "excluded")


@query(EVENTS + f", p AS {_PAIRS} SELECT s AS state, a AS v, CASE WHEN a IS NULL THEN 'click,view' ELSE '' END AS v__not FROM p")
def sub_split(spark, d):
    own, _ = B.split(_sides(spark, d)[0].withColumn("w", F.lit("x")), "v")
    return own.select("state", "v", F.array_join("v__not", ",").alias("v__not"))


@query(EVENTS + f", p AS {_PAIRS} SELECT s AS state, a IS NOT NULL AND b IS NOT NULL AND a = b AS same FROM p")
def sub_eq(spark, d):
    l, r = _sides(spark, d)
    return l.alias("l").join(r.alias("r"), "state").select("state", B.same("v", "l", "r").alias("same"))


# Filters, joins, sets
@query(EVENTS + " SELECT g AS graph_id, s AS state FROM ev")
def top(spark, d):
    return out(T.top(G.events(spark, d)))


@query(EVENTS + " SELECT g AS graph_id, s AS state FROM ev WHERE false")
def bottom(spark, d):
    return out(T.bottom(G.events(spark, d)))


@query(EVENTS + " SELECT g AS graph_id, s AS state, k AS x FROM ev WHERE label = 'purchase' AND k IS NOT NULL")
def label_scan(spark, d):
    return out(typed(G.events(spark, d), "purchase", x="k"))


@query(TREE + " SELECT g AS graph_id, s AS state, status AS x, flag AS f FROM tn WHERE label = 'line' AND status = 'F'")
def conj_join(spark, d):
    g = G.hierarchy(spark, d)
    return out(T.conj_join(typed(g, "line", x="status"), T.label_scan(g, F.col("status") == "F", {"x": "status", "f": "flag"})))




@query(EVENTS + " SELECT g AS graph_id, s AS state, k AS x FROM ev WHERE label IN ('error', 'view', 'click')")
def conj_strict(spark, d):
    g = G.events(spark, d)
    return out(T.conj_strict(typed(g, "error", "view", x="k"), typed(g, "view", "click", x="k")))


@query(EVENTS + """
SELECT DISTINCT a.g AS graph_id, a.s AS state, a.k AS x FROM ev a JOIN ev b ON a.g = b.g AND a.k = b.k WHERE a.label = 'error' AND b.label = 'purchase'""")
def conj_none(spark, d):
    g = G.events(spark, d)
    return out(T.conj_none(typed(g, "error", x="k"), typed(g, "purchase", x="k")))


@query(EVENTS + " SELECT g AS graph_id, s AS state, k AS x FROM ev WHERE label = 'view'")
def conj_aw(spark, d):
    g = G.events(spark, d)
    return out(T.conj_aw(typed(g, "error", "view", x="k"), typed(g, "view", "click", x="k")))


@query(TREE + """
SELECT n.g AS graph_id, n.s AS state, CAST(NULL AS VARCHAR) AS f, coalesce((SELECT string_agg(DISTINCT c.flag, ',' ORDER BY c.flag) FROM tn c WHERE c.parent = n.s), '') AS f__not FROM tn n WHERE n.label = 'order'""")
def complement(spark, d):
    g = G.hierarchy(spark, d)
    below = P.ex(g, typed(g, "line", f="flag"))
    return out(T.conj_join(typed(g, "order"), T.complement(g.states(), below)))


@query(EVENTS + " SELECT g AS graph_id, s AS state FROM ev WHERE label NOT IN ('error', 'view')")
def not_exists(spark, d):
    g = G.events(spark, d)
    return out(T.not_exists(g.states(), typed(g, "error", "view")))


@query(EVENTS + """
SELECT g AS graph_id, s AS state, CASE WHEN label = 'view' OR pos % 2 = 0 THEN NULL ELSE k END AS x, '' AS x__not FROM ev WHERE label IN ('error', 'view') OR pos % 2 = 0""")
def union(spark, d):
    """Rows that bind x where another row of the state leaves it free are superfluous."""
    g = G.events(spark, d)
    return out(T.union(typed(g, "error", "view", x="k"), T.label_scan(g, (F.col("label") == "view") | (F.col("pos") % 2 == 0))))


@query(EVENTS + """
SELECT g AS graph_id, s AS state, k AS x, '' AS x__not FROM ev WHERE label IN ('error', 'view') UNION SELECT g, s, NULL, '' FROM ev WHERE label IN ('view', 'click')""")
def union_plain(spark, d):
    g = G.events(spark, d)
    return out(T.union_plain(typed(g, "error", "view", x="k"), typed(g, "view", "click")))


@query(EVENTS + " SELECT g AS graph_id, s AS state FROM ev WHERE label IN ('error', 'view', 'click')")
def seq_or(spark, d):
    g = G.events(spark, d)
    return out(T.seq_or(g.states(), typed(g, "error", "view"), typed(g, "view", "click")))


@query(EVENTS + " SELECT g AS graph_id, s AS state FROM ev WHERE label <> 'view' OR value > 50")
def implies(spark, d):
    g = G.events(spark, d)
    return out(T.implies(g.states(), typed(g, "view"), T.label_scan(g, F.col("value") > 50)))


@query(TREE + " SELECT DISTINCT g AS graph_id, parent AS state, status AS x FROM tn WHERE label = 'line'")
def exists(spark, d):
    g = G.hierarchy(spark, d)
    return out(T.exists("f", T.conj_join(P.ex(g, typed(g, "line", x="status", f="flag")), typed(g, "order"))))


@query(EVENTS + " SELECT g AS graph_id, s AS state, 1 AS leaves, k AS value FROM ev WHERE label = 'purchase' AND k IS NOT NULL", "exists_kept")
def exists_kept(spark, d):
    g = G.events(spark, d)
    r = T.exists("x", T.label_scan(g, F.col("label") == "purchase", {"x": "k"}, wit=True), keep=True)
    return r.df.select("graph_id", "state", F.size("wit").alias("leaves"), F.col("wit")[0]["value"].alias("value"))


@query(EVENTS + " SELECT g AS graph_id, s AS state, k AS x FROM ev WHERE label = 'click' AND k IS NOT NULL")
def uncheck(spark, d):
    return out(T.unchecked(T.label_scan(G.events(spark, d), F.col("label") == "click", {"x": "k"}, wit=True)))


_FIRST = ", f AS (SELECT g, s, pos FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY pos) AS nth FROM ev WHERE label = 'error') WHERE nth = 1)"


@query(EVENTS + _FIRST + """
SELECT DISTINCT f.g AS graph_id, f.s AS state, e.k AS x, '' AS x__not FROM f LEFT JOIN ev e ON e.g = f.g AND e.pos >= f.pos AND e.label = 'purchase' AND e.k IS NOT NULL""")
def and_any(spark, d):
    """A user's first error, with the k of any purchase from there on."""
    g = G.events(spark, d)
    firsts = T.first_by(g.nodes.where("label = 'error'"), ["graph_id"], ["pos"])
    a = Relation(firsts.select("graph_id", F.col("node_id").alias("state")))
    places = g.nodes.select("graph_id", F.col("node_id").alias("reached"), F.col("pos").alias("p"))
    starts = firsts.select("graph_id", F.col("node_id").alias("state"), F.col("pos").alias("q"))
    reach = lambda _: starts.join(places, "graph_id").where("p >= q").select("graph_id", "state", "reached")  # noqa: E731  linear: a range
    return out(T.and_any(g, a, typed(g, "purchase", x="k"), reach).loosened(("x",)))


@query(TREE + """
SELECT DISTINCT c.g AS graph_id, c.s AS state, o.status AS x FROM tn c JOIN tn o ON o.parent = c.s WHERE c.label = 'customer' AND o.label = 'order'""")
def hack_for_stmt(spark, d):
    """Customers with the status of an order, met again at a node below them."""
    g = G.hierarchy(spark, d)
    a = T.conj_join(P.ex(g, typed(g, "order", x="status")), typed(g, "customer"))
    b = typed(g, "order", x="status")
    return out(T.any_of_several(a, b, lambda r: P.reach_pairs(g, Relation(r.df.select("graph_id", "state").distinct()))))


@query(EVENTS + " SELECT g AS graph_id, s AS state, k AS x FROM ev WHERE label = 'error' AND value > 50 AND k IS NOT NULL")
def inner_and(spark, d):
    """A conjunction inside another: states of one row stay as they are."""
    g = G.events(spark, d)
    inner = T.conj_join(typed(g, "error", x="k"), T.label_scan(g, F.col("value") > 50))
    return out(T.conj_join(inner, T.top(g)))


@query(EVENTS + " SELECT a.g AS graph_id, a.s AS state FROM ev a JOIN ev b ON a.g = b.g AND a.nxt = b.s WHERE a.label = 'view' AND b.label = 'view'")
def let(spark, d):
    g = G.events(spark, d)
    return out(T.let(typed(g, "view"), lambda v: T.conj_join(v, P.ex(g, v))))


@query(EVENTS + " SELECT a.g AS graph_id, a.s AS state FROM ev a JOIN ev b ON a.g = b.g AND a.nxt = b.s WHERE a.label = 'view' AND b.label = 'view'")
def let_r(spark, d):
    g = G.events(spark, d)
    near = P.children(g, typed(g, "view"))
    return out(T.let_reachable(g, lambda states: T.required_states(typed(g, "view"), Relation(states)), near.df, lambda v: T.conj_join(typed(g, "view"), P.ex(g, v))))


@query(EVENTS + " SELECT g AS graph_id, s AS state FROM ev WHERE label IN ('error', 'click') AND k IS NOT NULL AND value <= 50")
def unwitify(spark, d):
    """Witnesses of values above 50 are made negative."""
    return out(T.exists("x", T.unwitified(_witnessed(spark, d))))


def _witnessed(spark, d) -> Relation:
    g = G.events(spark, d)
    r = T.label_scan(g, F.col("label").isin("error", "click"), {"x": "k"}, wit=True)
    high = g.nodes.select("graph_id", F.col("node_id").alias("state"), (F.col("value") > 50).alias("high"))
    leaf = lambda neg: F.array(F.struct(F.col("state").cast("string").alias("state"), F.lit("x").alias("var"), F.col("x").alias("value"), neg.alias("negative")))
    rows = r.df.join(high, ["graph_id", "state"]).withColumn("wit", leaf(F.coalesce("high", F.lit(False))))
    return r.with_df(rows.drop("high"))


@query(EVENTS + " SELECT g AS graph_id, s AS state, k AS x, value IS NULL OR value <= 50 AS kept FROM ev WHERE label IN ('error', 'click') AND k IS NOT NULL")
def partial_filter(spark, d):
    good, bad = T.partial_filter(_witnessed(spark, d))
    return good.df.select("graph_id", "state", "x", F.lit(True).alias("kept")).union(bad.select("graph_id", "state", "x", F.lit(False)))


@query(EVENTS + " SELECT g AS graph_id, s AS state, CASE WHEN value > 50 THEN 1 ELSE 2 END AS leaves FROM ev WHERE label IN ('error', 'click') AND k IS NOT NULL")
def wit_union(spark, d):
    """A negative leaf drops the positive ones."""
    r = _witnessed(spark, d).df
    other = F.array(F.struct(F.lit("0").alias("state"), F.lit("y").alias("var"), F.lit("z").alias("value"), F.lit(False).alias("negative")))
    return r.select("graph_id", "state", F.size(T.wit_union(F.col("wit"), other)).alias("leaves"))


@query(EVENTS + " SELECT g AS graph_id, s AS state FROM ev WHERE label = 'click'")
def filter_conj(spark, d):
    g = G.events(spark, d)
    return out(T.filter_conj(g.states(), typed(g, "error", "view"), typed(g, "view", "click")))


@query(EVENTS + " SELECT DISTINCT g AS graph_id, label FROM ev")
def distinct(spark, d):
    return G.events(spark, d).nodes.select("graph_id", "label").dropDuplicates()


@query(EVENTS + " SELECT g AS graph_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM ev GROUP BY g")
def group_by(spark, d):
    g = G.events(spark, d)
    r = T.label_scan(g, F.lit(True), {"l": "label"})
    return T.grouped(r, ["graph_id"], "l").select("graph_id", F.array_join("l", ",").alias("labels"))


@query(EVENTS + " SELECT g AS graph_id, s AS state FROM ev WHERE label = 'error'", "except")
def except_(spark, d):
    g = G.events(spark, d)
    return out(T.difference(typed(g, "error", "view"), typed(g, "view", "click")))


@query("SELECT true AS inside, false AS outside")
def subset_test(spark, d):
    g = G.events(spark, d)
    a, b = typed(g, "view"), typed(g, "view", "click")
    return spark.createDataFrame([(T.is_subset(a, b), T.is_subset(b, a))], "inside boolean, outside boolean")


@query(EVENTS + " SELECT b.g AS graph_id, b.s AS state, b.k AS x FROM ev b WHERE label = 'view' AND k IS NOT NULL AND EXISTS (SELECT 1 FROM ev a WHERE a.g = b.g AND a.nxt = b.s AND a.label = 'error')")
def required_states_filter(spark, d):
    g = G.events(spark, d)
    return out(T.label_scan(g, F.col("label") == "view", {"x": "k"}, required=P.children(g, typed(g, "error"))))


@query(EVENTS + " SELECT g AS graph_id, s AS state, k AS x FROM ev WHERE label = 'signup' AND k IS NOT NULL")
def final_sort(spark, d):
    return T.final_sort(typed(G.events(spark, d), "signup", x="k")).withColumn("graph_id", F.col("graph_id").cast("long"))


# Paths
@query(TREE + " SELECT DISTINCT te.g AS graph_id, src AS state FROM te JOIN tn ON te.dst = tn.s WHERE flag = 'R'")
def ex(spark, d):
    g = G.hierarchy(spark, d)
    return out(P.ex(g, flagged(g, "R")))


@query(TREE + " SELECT te.g AS graph_id, src AS state FROM te JOIN tn ON te.dst = tn.s GROUP BY te.g, src HAVING bool_or(label = 'line' AND src <> dst)")
def ex_direct(spark, d):
    """A line's own loop counts as a Control edge here."""
    g = G.hierarchy(spark, d)
    g = Graph(g.nodes, g.edges.withColumn("edge_kind", F.when(F.col("src") == F.col("dst"), "Control").otherwise("Direct")))
    return out(P.ex(g, typed(g, "line"), direct=True))


@query(TREE + " SELECT te.g AS graph_id, src AS state FROM te JOIN tn ON te.dst = tn.s GROUP BY te.g, src HAVING bool_and(coalesce(flag = 'R', false))")
def ax(spark, d):
    g = G.hierarchy(spark, d)
    return out(P.ax(g, flagged(g, "R")))


@query(TREE + " SELECT te.g AS graph_id, src AS state, min(flag) AS f FROM te JOIN tn ON te.dst = tn.s GROUP BY te.g, src HAVING count(*) = count(flag) AND count(DISTINCT flag) = 1")
def ax_bindings(spark, d):
    """Nodes all of whose successors are lines of one flag; that flag is bound."""
    g = G.hierarchy(spark, d)
    return out(P.ax(g, typed(g, "line", f="flag")))


#: For a goal on the hierarchy's lines: what holds at a node by its children, from the leaves up.
def _up(goal: str, inner: str, how: str, leaf_without: str = "false") -> str:
    """A node holds if `goal` does, or if `inner` does and `how` (bool_or, bool_and) of its children hold."""
    levels = [("line", "x0"), ("order", "x1"), ("customer", "x2"), ("nation", "x3"), ("region", "x4")]
    parts = [f", x0 AS (SELECT g, s, parent, ({goal}) OR (({inner}) AND {leaf_without}) AS h FROM tn WHERE label = 'line')"]
    for (label, now), (_, before) in zip(levels[1:], levels):
        parts.append(f", {now} AS (SELECT n.g, n.s, any_value(n.parent) AS parent, bool_or({goal}) OR (bool_or({inner}) AND coalesce({how}(c.h), {leaf_without})) AS h FROM tn n LEFT JOIN {before} c ON c.parent = n.s WHERE label = '{label}' GROUP BY n.g, n.s)")
    return TREE + "".join(parts) + " SELECT g AS graph_id, s AS state FROM (" + " UNION ALL ".join(f"SELECT g, s, h FROM x{i}" for i in range(5)) + ") WHERE h"


_R = "coalesce(flag = 'R', false)"


@query(_up(_R, "true", "bool_or"))
def ef(spark, d):
    g = G.hierarchy(spark, d)
    return out(P.ef(g, flagged(g, "R")))


@query(_up(_R, "label IN ('customer', 'order')", "bool_or"))
def eu(spark, d):
    g = G.hierarchy(spark, d)
    return out(P.eu(g, typed(g, "customer", "order"), flagged(g, "R")))


@query(TREE + """, r AS (SELECT g, s, flag AS f FROM tn WHERE label = 'line' UNION SELECT tn.g, tn.parent, f FROM r JOIN tn USING (s) WHERE tn.parent IS NOT NULL)
SELECT DISTINCT r.g AS graph_id, s AS state, f FROM r JOIN tn USING (s) WHERE label IN ('line', 'order', 'customer')""")
def eu_bindings(spark, d):
    g = G.hierarchy(spark, d)
    return out(P.eu(g, typed(g, "customer", "order"), typed(g, "line", f="flag")))


@query(MACHINE + """, e AS (SELECT g, s FROM mn WHERE s = 'purchase' UNION SELECT me.g, me.src FROM e JOIN me ON me.g = e.g AND me.dst = e.s WHERE me.src <> 'error')
SELECT DISTINCT e.g AS graph_id FROM e JOIN ml USING (g, s)""")
def eu_direct(spark, d):
    """Users for whom E[not error U purchase] meets a loop."""
    g = G.machines(spark, d)
    found = P.eu(g, T.not_exists(g.states(), typed(g, "error")), typed(g, "purchase"), direct=True)
    return P.meets_loop(g, found)


@query(_up(_R, "true", "bool_and"))
def af(spark, d):
    g = G.hierarchy(spark, d)
    return out(P.af(g, flagged(g, "R")))


@query(_up(_R, "label = 'order'", "bool_and"))
def au(spark, d):
    g = G.hierarchy(spark, d)
    return out(P.au(g, typed(g, "order"), flagged(g, "R")))


_STUCK = """, good AS (SELECT g, s FROM mn WHERE s = 'purchase'), e AS (
  SELECT g, s FROM good UNION SELECT me.g, me.src FROM e JOIN me ON me.g = e.g AND me.dst = e.s WHERE me.src <> 'error'
), weak AS (SELECT DISTINCT e.g FROM e JOIN ml USING (g, s))
, phi AS (SELECT g, s FROM mn WHERE s <> 'error' AND (g NOT IN (SELECT g FROM weak) OR (g, s) IN (SELECT g, s FROM e)))
, bad AS (SELECT g, s FROM mn WHERE (g, s) NOT IN (SELECT g, s FROM phi) AND s <> 'purchase'
  UNION SELECT me.g, me.src FROM bad JOIN me ON me.g = bad.g AND me.dst = bad.s WHERE me.src <> 'purchase')
, pairs AS (SELECT g, src AS a, dst AS b FROM me WHERE src NOT IN ('purchase', 'error') AND dst NOT IN ('purchase', 'error') UNION SELECT p.g, p.a, me.dst FROM pairs p JOIN me ON me.g = p.g AND me.src = p.b WHERE me.dst NOT IN ('purchase', 'error'))
, stays AS (SELECT g, a AS s FROM pairs WHERE a = b UNION SELECT p.g, p.a FROM pairs p JOIN pairs q ON p.g = q.g AND p.b = q.a AND q.a = q.b)
"""


@query(MACHINE + _STUCK + """SELECT g AS graph_id, s AS state FROM mn WHERE (g, s) NOT IN (SELECT g, s FROM bad) AND (g IN (SELECT g FROM weak) OR (g, s) NOT IN (SELECT g, s FROM stays))""")
def au_loops(spark, d):
    """A[not error U purchase] on users' machines: weak where a loop may be gone round for ever."""
    g = G.machines(spark, d)
    return out(P.au(g, T.not_exists(g.states(), typed(g, "error")), typed(g, "purchase")))


@query(MACHINE + """, bad AS (SELECT g, s FROM mn WHERE s = 'error' UNION SELECT me.g, me.src FROM bad JOIN me ON me.g = bad.g AND me.dst = bad.s WHERE me.src <> 'purchase')
SELECT g AS graph_id, s AS state FROM mn WHERE (g, s) NOT IN (SELECT g, s FROM bad)""")
def aw(spark, d):
    g = G.machines(spark, d)
    return out(P.aw(g, T.not_exists(g.states(), typed(g, "error")), typed(g, "purchase")))


@query(_up(_R, "true", "bool_or").replace(") WHERE h", ") WHERE NOT h"))
def ag(spark, d):
    """Nodes below which, themselves among them, no line was returned."""
    g = G.hierarchy(spark, d)
    return out(P.ag(g, T.not_exists(g.states(), flagged(g, "R"))))


@query(MACHINE + """, pairs AS (SELECT g, src AS a, dst AS b FROM me WHERE src IN ('error', 'view') AND dst IN ('error', 'view') UNION SELECT p.g, p.a, me.dst FROM pairs p JOIN me ON me.g = p.g AND me.src = p.b WHERE me.dst IN ('error', 'view'))
SELECT g AS graph_id, a AS state FROM pairs WHERE a = b UNION SELECT p.g, p.a FROM pairs p JOIN pairs q ON p.g = q.g AND p.b = q.a WHERE q.a = q.b""")
def eg(spark, d):
    g = G.machines(spark, d)
    return out(P.eg(g, typed(g, "error", "view")))


@query(TREE + """, r AS (SELECT g, s FROM tn WHERE label = 'customer' UNION SELECT te.g, te.dst FROM r JOIN te ON te.src = r.s)
SELECT g AS graph_id, s AS state FROM r""")
def reachable(spark, d):
    g = G.hierarchy(spark, d)
    return out(P.reachable(g, typed(g, "customer")))


@query(TREE + " SELECT DISTINCT te.g AS graph_id, dst AS state FROM te JOIN tn ON te.src = tn.s WHERE label = 'nation'")
def children(spark, d):
    g = G.hierarchy(spark, d)
    return out(P.children(g, typed(g, "nation")))


@query(TREE + """ SELECT te.g AS graph_id, src AS state, bool_and(coalesce(flag = 'R', false)) AS "full" FROM te JOIN tn ON te.dst = tn.s GROUP BY te.g, src HAVING bool_or(coalesce(flag = 'R', false))""", "strict_a1")
def strict_a1(spark, d):
    g = G.hierarchy(spark, d)
    r = flagged(g, "R")
    return P.strict(P.ax(g, r), P.ex(g, r)).df


@query(MACHINE + """, good AS (SELECT g, s FROM mn WHERE s = 'purchase'), bad AS (SELECT g, s FROM mn WHERE s = 'error' UNION SELECT me.g, me.src FROM bad JOIN me ON me.g = bad.g AND me.dst = bad.s WHERE me.src <> 'purchase')
, e AS (SELECT g, s FROM good UNION SELECT me.g, me.src FROM e JOIN me ON me.g = e.g AND me.dst = e.s WHERE me.src <> 'error')
SELECT g AS graph_id, s AS state, (g, s) NOT IN (SELECT g, s FROM bad) AS "full" FROM mn WHERE (g, s) NOT IN (SELECT g, s FROM bad) OR (g, s) IN (SELECT g, s FROM e)""", "strict_a2")
def strict_a2(spark, d):
    g = G.machines(spark, d)
    a, b = T.not_exists(g.states(), typed(g, "error")), typed(g, "purchase")
    return P.strict(P.aw(g, a, b), P.eu(g, a, b)).df


@query(_up(_R, "label = 'order'", "bool_and").replace("SELECT g AS graph_id, s AS state FROM (", "SELECT t.g AS graph_id, t.s AS state, h AS \"full\" FROM (SELECT g, s, h FROM (").replace(") WHERE h", ")) t LEFT JOIN (SELECT DISTINCT parent AS above FROM tn WHERE flag = 'R') p ON t.s = p.above WHERE h OR above IS NOT NULL"), "strict_a2au")
def strict_a2au(spark, d):
    g = G.hierarchy(spark, d)
    a, b = typed(g, "order"), flagged(g, "R")
    return P.strict(P.au(g, a, b), P.eu(g, a, b)).df


@query(MACHINE + """, r AS (SELECT g, s FROM mn WHERE s = 'purchase' UNION SELECT me.g, me.src FROM r JOIN me ON me.g = r.g AND me.dst = r.s) SELECT g AS graph_id, s AS state FROM r""")
def fixpoint(spark, d):
    g = G.machines(spark, d)
    start = typed(g, "purchase")
    return out(P.least(lambda y: T.union_plain(start, P.ex(g, y)), start))


@query(TREE + """, c AS (SELECT s FROM tn WHERE label = 'customer' AND CAST(substr(s, 2) AS BIGINT) % 2 = 0), m AS (SELECT g, s, parent FROM tn WHERE label = 'order' AND status = 'F')
SELECT g AS graph_id, s AS state FROM m WHERE parent NOT IN (SELECT s FROM c)""")
def check_reach(spark, d):
    """Orders of status F that no even customer (the roots) leads to. The root of a tree is its own predecessor here."""
    g = G.hierarchy(spark, d)
    tops = g.nodes.where("label = 'region'").select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit("Direct").alias("edge_kind"))
    up = Graph(g.nodes.drop("is_loop"), g.edges.where("src <> dst").union(tops))
    modified = T.label_scan(g, (F.col("label") == "order") & (F.col("status") == "F"))
    roots = T.label_scan(g, (F.col("label") == "customer") & (F.substring("node_id", 2, 20).cast("long") % 2 == 0))
    return out(P.unreached(up, modified, roots))


@query(MACHINE + """, r AS (SELECT me.g, me.src, me.dst FROM me WHERE me.src <> 'view' AND me.dst <> 'view'), w AS (SELECT g, src AS a, dst AS b FROM r UNION SELECT w.g, w.a, r.dst FROM w JOIN r ON w.g = r.g AND w.b = r.src)
SELECT DISTINCT g AS graph_id, a AS state FROM w WHERE a = 'error' AND b = 'error'""")
def check_revisit(spark, d):
    """Errors that a path without a view comes back to."""
    g = G.machines(spark, d)
    return out(P.revisited(g, typed(g, "error"), typed(g, "view")))
