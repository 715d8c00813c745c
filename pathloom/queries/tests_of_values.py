"""Queries of predicates, constraints and outside facts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constraints as C
from ..functions import facts as A
from ..sources import graphs as G

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__.rstrip("_")
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def _constraint(name: str, condition, where: str) -> None:
    """One on orders and their parts: o is the order's key as a constant's text, with a suffix."""

    def run(spark, d):
        return _values(spark, d).where(condition()).select("o_orderkey")

    query(f"WITH v AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, (o_orderkey % 90) || CASE WHEN o_orderkey % 3 = 0 THEN 'UL' ELSE '' END AS c, o_orderkey AS k FROM orders) SELECT o_orderkey FROM v WHERE {where}", name)(run)


def _values(spark, d) -> DataFrame:
    o = G.table(spark, d, "orders")
    suffix = F.when(F.col("o_orderkey") % 3 == 0, "UL").otherwise("")
    return o.select("o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), F.concat((F.col("o_orderkey") % 90).cast("string"), suffix).alias("c"))


def _even_digit_sum(p):
    return p.astype(str).map(lambda x: sum(map(int, filter(str.isdigit, x))) % 2 == 0)


_NUMBER = "CAST(regexp_extract(c, '^[0-9]+') AS BIGINT)"
_constraint("c_true", C.always, "true")
_constraint("c_false", C.never, "false")
_constraint("c_and", lambda: C.all_of(C.text_is(F.col("s"), "F"), C.int_at_most(F.col("c"), 40)), f"s = 'F' AND {_NUMBER} <= 40")
_constraint("c_or", lambda: C.any_of(C.text_is(F.col("s"), "F"), C.int_at_most(F.col("c"), 40)), f"s = 'F' OR {_NUMBER} <= 40")
_constraint("c_not", lambda: C.none_of(C.text_is(F.col("s"), "F")), "s <> 'F'")
_constraint("c_str", lambda: C.text_is(F.col("s"), "O"), "s = 'O'")
_constraint("c_int_eq", lambda: C.int_equals(F.col("c"), "14"), "c = '14'")
_constraint("c_int_leq", lambda: C.int_at_most(F.col("c"), 15), f"{_NUMBER} <= 15")
_constraint("c_int_geq", lambda: C.int_at_least(F.col("c"), 80), f"{_NUMBER} >= 80")
_constraint("c_op", lambda: C.operator_in(F.substring("p", 1, 1), ["1", "3"]), "substr(p, 1, 1) IN ('1', '3')")
_constraint("c_metaname", lambda: C.equals_inherited(F.substring("p", 1, 1), F.substring("c", 1, 1)), "substr(p, 1, 1) = substr(c, 1, 1)")
_constraint("c_regex", lambda: C.matches(F.col("c"), "^[13].*U"), "regexp_matches(c, '^[13].*U')")
_constraint("c_script", lambda: C.script(_even_digit_sum, F.col("c")), "list_sum(list_transform(regexp_extract_all(c, '[0-9]'), lambda x: CAST(x AS BIGINT))) % 2 = 0")
_constraint("c_expr", lambda: C.matches(F.col("p"), "^[0-9]-[A-Z]+$"), "regexp_matches(p, '^[0-9]-[A-Z]+$')")
_constraint("c_sub", lambda: C.subterm_of(F.substring("p", 3, 3), F.array(F.lit("URG"), F.lit("LOW"))), "substr(p, 3, 3) IN ('URG', 'LOW')")
_constraint("c_type", lambda: C.type_is(F.concat(F.lit("struct  "), F.lower("s"), F.lit(" * ")), "struct f*"), "s = 'F'")
_constraint("c_pos", lambda: C.position_is(F.struct((F.col("o_orderkey") % 10).alias("lo"), F.lit(9).alias("hi")), F.struct(F.lit(4).alias("lo"), (F.col("o_orderkey") % 7 + 4).alias("hi"))), "(k % 10 <= 4 AND 9 >= k % 7 + 4) OR (4 <= k % 10 AND k % 7 + 4 >= 9)")
_constraint("c_form", lambda: C.form_is(F.when(F.col("o_orderkey") % 2 == 0, F.col("c")).otherwise(F.lower("s")), "constant"), "k % 2 = 0")


# Atomic predicates: kinds of nodes
def _predicate(name: str, where: str, columns: str = "graph_id, node_id") -> None:
    def run(spark, d):
        return _cfg(spark, d).where(where).selectExpr(*columns.split(", "))

    query(_CFG_SQL + f" SELECT {columns} FROM c WHERE {where}", name)(run)


#: Conversations read as flow: system turns stand for headers, first and last turns for entry and exit, user turns for tests.
_CFG_SQL = """WITH c AS (
  SELECT conv_id AS graph_id, turn AS node_id, turn AS brace_id, CASE WHEN turn = 0 THEN 'Top' WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 'Exit' WHEN role = 'system' THEN 'FunHeader' WHEN role = 'assistant' AND turn % 4 = 1 THEN 'TrueNode' WHEN role = 'assistant' THEN 'FalseNode' WHEN turn % 4 = 2 THEN 'InLoopNode' ELSE 'AfterNode' END AS kind, role AS label FROM conversations
)"""


def _cfg(spark, d) -> DataFrame:
    from pyspark.sql import Window

    c = G.table(spark, d, "conversations")
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    kind = F.when(F.col("turn") == 0, "Top").when(F.col("turn") == last, "Exit").when(F.col("role") == "system", "FunHeader")
    kind = kind.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), "TrueNode").when(F.col("role") == "assistant", "FalseNode").when(F.col("turn") % 4 == 2, "InLoopNode").otherwise("AfterNode")
    return c.select(F.col("conv_id").alias("graph_id"), F.col("turn").alias("node_id"), F.col("turn").alias("brace_id"), kind.alias("kind"), F.col("role").alias("label"))


_predicate("p_match", "label = 'user'")
_predicate("p_paren", "kind in ('Top', 'Exit')", "graph_id, node_id, brace_id")
_predicate("p_top", "kind = 'Top'")
_predicate("p_exit", "kind in ('Exit', 'EndNode')")
_predicate("p_funheader", "kind = 'FunHeader'")
_predicate("p_true", "kind = 'TrueNode'")
_predicate("p_false", "kind = 'FalseNode'")
_predicate("p_inloop", "kind = 'InLoopNode'")
_predicate("p_after", "kind = 'AfterNode'")


@query(_CFG_SQL + " SELECT graph_id, node_id, 'bad' AS mark FROM c WHERE kind = 'TrueNode' UNION ALL SELECT graph_id, node_id, 'good' FROM c WHERE kind = 'FalseNode'")
def p_bindgood(spark, d):
    c = _cfg(spark, d)
    good, bad = c.where("kind = 'FalseNode'").withColumn("mark", F.lit("good")), c.where("kind = 'TrueNode'").withColumn("mark", F.lit("bad"))
    return good.union(bad).select("graph_id", "node_id", "mark")


@query("""WITH n AS (SELECT event_id, user_id, [CAST(user_id % 3 AS BIGINT), CAST(event_id % 4 AS BIGINT), CAST(event_id % 2 AS BIGINT)][1:CAST(1 + event_id % 3 AS BIGINT)] AS path FROM events)
SELECT event_id FROM n WHERE path[1] = 1 AND len(path) >= 2 AND path[2] = 2""")
def p_prefix(spark, d):
    """Label paths that begin with 1, 2."""
    e = G.table(spark, d, "events")
    path = F.slice(F.array(F.col("user_id") % 3, F.col("event_id") % 4, F.col("event_id") % 2), F.lit(1), (1 + F.col("event_id") % 3).cast("int"))
    return e.select("event_id", path.alias("path")).where(F.slice("path", 1, 2) == F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).select("event_id")


# Facts: orders are places asked about, lines of the same customer segment give facts.
_FACTS = """WITH f AS (
  SELECT DISTINCT c_mktsegment AS file, o_orderkey AS "begin", o_orderkey + 3 + o_orderkey % 5 AS "end", CASE o_orderkey % 3 WHEN 0 THEN 'ints' WHEN 1 THEN 'bounds' ELSE 'other' END AS kind,
    CASE WHEN o_orderkey % 3 = 0 THEN [o_orderkey % 4, o_orderkey % 4 + 2] END AS ints, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey % 5 END AS lo, CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 1 THEN o_orderkey % 5 + 3 END AS hi
  FROM orders JOIN customer ON o_custkey = c_custkey
), a AS (
  SELECT o_orderkey AS id, c_mktsegment AS file, o_orderkey + 1 AS p, o_orderkey + 2 + o_orderkey % 4 AS q FROM orders JOIN customer ON o_custkey = c_custkey
), b AS (
  SELECT id, a.file, q, max("begin") AS "begin" FROM a JOIN f ON a.file = f.file AND f."begin" <= p AND f."begin" >= p - 1000 GROUP BY id, a.file, q
), e AS (
  SELECT id, b.file, b."begin", min(f."end") AS "end" FROM b JOIN f ON b.file = f.file AND b."begin" = f."begin" AND f."end" >= q GROUP BY id, b.file, b."begin"
), r AS (
  SELECT e.id, f.* FROM e JOIN f ON e.file = f.file AND e."begin" = f."begin" AND e."end" = f."end"
)"""


def _facts(spark, d) -> tuple[DataFrame, DataFrame]:
    """Facts written as lines and scanned, and the places asked about."""
    o = G.table(spark, d, "orders").join(G.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    content = F.when(k % 3 == 0, F.concat_ws("|ints|", F.lit(""), F.concat_ws(",", text(k % 4), text(k % 4 + 2)))).when(k % 3 == 1, F.concat(F.lit("|bounds|"), text(k % 5), F.lit(".."), F.when(k % 2 == 1, text(k % 5 + 3)).otherwise(""))).otherwise(F.lit("|other|x"))
    line = F.concat_ws(";", "c_mktsegment", text(k), text(k + 3 + k % 5), F.regexp_replace(F.substring(content, 2, 100), r"\|", ";"))
    asked = o.select(k.alias("id"), F.col("c_mktsegment").alias("file"), (k + 1).alias("p"), (k + 2 + k % 4).alias("q"))
    return A.scan(o.select(line.alias("value")).distinct()), asked


@query(_FACTS + """ SELECT file, "begin", "end", kind, coalesce(array_to_string(ints, ','), '') AS ints, lo, hi FROM f""")
def scan_facts(spark, d):
    f, _ = _facts(spark, d)
    return f.select("file", "begin", "end", "kind", F.coalesce(F.array_join(F.col("ints").cast("array<string>"), ","), F.lit("")).alias("ints"), "lo", "hi")


@query(_FACTS + """ SELECT id, "begin", "end", kind FROM r""")
def fact_find(spark, d):
    f, asked = _facts(spark, d)
    return A.find(asked, f).select("id", "begin", "end", "kind")


@query(_FACTS + """ SELECT file, "begin", coalesce(2 >= lo, true) AND coalesce(2 <= hi, true) AS inside FROM f WHERE kind = 'bounds'""")
def fact_within(spark, d):
    f, _ = _facts(spark, d)
    return f.where("kind = 'bounds'").select("file", "begin", A.in_bounds(F.lit(2), F.col("lo"), F.col("hi")).alias("inside"))


@query(_FACTS + """ SELECT file, "begin", lo <= 2 AND (hi IS NULL OR hi >= 5) AS inside FROM f WHERE kind = 'bounds'""")
def fact_contains(spark, d):
    f, _ = _facts(spark, d)
    return f.where("kind = 'bounds'").select("file", "begin", A.bounds_contain(F.col("lo"), F.col("hi"), F.lit(2), F.lit(5)).alias("inside"))


@query(_FACTS + """, m AS (SELECT f.file, f."begin", f.kind AS k1, f.ints AS i1, f.lo AS l1, f.hi AS h1, g.kind AS k2, g.ints AS i2, g.lo AS l2, g.hi AS h2 FROM f JOIN f g ON f.file = g.file AND g."begin" = f."end" + 1)
, n AS (SELECT *, (l1 IS NULL OR coalesce(l2 >= l1, false)) AND (h1 IS NULL OR coalesce(h2 <= h1, false)) AS in1, (l2 IS NULL OR coalesce(l1 >= l2, false)) AND (h2 IS NULL OR coalesce(h1 <= h2, false)) AS in2,
  list_sort(list_intersect(i1, i2)) AS common, len(list_filter(i1, lambda x: coalesce(x < l2, false) OR coalesce(x > h2, false))) = 0 AS all1, len(list_filter(i2, lambda x: coalesce(x < l1, false) OR coalesce(x > h1, false))) = 0 AS all2 FROM m)
SELECT file, "begin", CASE WHEN k1 = 'ints' AND k2 = 'ints' THEN CASE WHEN len(common) > 0 THEN 'ints' END WHEN k1 = 'ints' AND k2 = 'bounds' THEN CASE WHEN all1 THEN 'bounds' END WHEN k1 = 'bounds' AND k2 = 'ints' THEN CASE WHEN all2 THEN 'bounds' END WHEN k1 = 'bounds' AND k2 = 'bounds' THEN CASE WHEN in1 OR in2 THEN 'bounds' END END AS kind,
  CASE WHEN k1 = 'ints' AND k2 = 'ints' AND len(common) > 0 THEN array_to_string(common, ',') ELSE '' END AS ints FROM n""")
def fact_intersect(spark, d):
    f, _ = _facts(spark, d)
    one = F.struct("kind", "ints", "lo", "hi")
    a, b = f.select("file", "begin", "end", one.alias("x")), f.select("file", (F.col("begin") - 1).alias("end"), one.alias("y"))
    m = a.join(b, ["file", "end"]).withColumn("z", A.intersection("x", "y"))
    return m.select("file", "begin", F.col("z.kind").alias("kind"), F.coalesce(F.array_join(F.col("z.ints").cast("array<string>"), ","), F.lit("")).alias("ints"))


_HOLDS = "(coalesce(list_contains(ints, 2), false) OR (kind = 'bounds' AND coalesce(2 >= lo, true) AND coalesce(2 <= hi, true)))"


@query(_FACTS + f""", s AS (SELECT id, count(*) AS n, count(*) FILTER ({_HOLDS}) AS m FROM r GROUP BY id)
SELECT a.id, coalesce(n, 0) > 0 AS has_any, coalesce(m, 0) > 0 AS "exists", coalesce(m, 0) = coalesce(n, 0) AS for_all, coalesce(n, 0) > 0 AND m = n AS for_all1 FROM a LEFT JOIN s ON a.id = s.id""")
def fact_satisfy(spark, d):
    f, asked = _facts(spark, d)
    return A.satisfy(A.find(asked, f), asked, lambda _: A.contains_int(2))


@query(_FACTS + f""" SELECT file, "begin", coalesce(len(ints) = 1 AND ints[1] = 2, false) OR coalesce(lo = 2 AND hi = 2, false) AS single, {_HOLDS} AS contains,
  coalesce(list_contains(ints, 0), false) OR (kind = 'bounds' AND coalesce(0 >= lo, true) AND coalesce(0 <= hi, true)) AS also_nul,
  coalesce(len(ints) = 1 AND ints[1] = 0, false) OR coalesce(lo = 0 AND hi = 0, false) AS only_nul, {_HOLDS} AND NOT (coalesce(len(ints) = 1 AND ints[1] = 2, false) OR coalesce(lo = 2 AND hi = 2, false)) AS also_int FROM f""")
def fact_single_int(spark, d):
    f, _ = _facts(spark, d)
    return f.select("file", "begin", A.single_int(2).alias("single"), A.contains_int(2).alias("contains"), A.also_nul().alias("also_nul"), A.only_nul().alias("only_nul"), A.also_int(2).alias("also_int"))
