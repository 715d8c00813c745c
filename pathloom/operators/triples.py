"""Filters, projections, joins and set operations on relations of triples."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bindings import compatible, excluded, merged, none, within
from .relation import KEYS, Graph, Relation, cut

LEAF = "array<struct<state:string,var:string,value:string,negative:boolean>>"


def top(graph: Graph) -> Relation:
    return Relation(graph.states())


def bottom(graph: Graph) -> Relation:
    return Relation(graph.states().where(F.lit(False)))


def label_scan(graph: Graph, where: Column, binds: dict[str, Column | str] | None = None, required: Relation | None = None, wit: bool = False) -> Relation:
    """Nodes that a predicate holds at, with the variables it binds; only for states of `required`, if given."""
    binds = binds or {}
    columns = [F.col(c) if isinstance(c, str) else c for c in binds.values()]
    leaf = [F.expr(f"cast(array() as {LEAF})").alias("wit")] if wit else []
    rows = graph.nodes.where(where).select("graph_id", F.col("node_id").alias("state"), *[c.cast("string").alias(v) for v, c in zip(binds, columns)], *leaf)
    out = Relation(rows, tuple(binds), wit=wit)
    out = required_states(out, required) if required is not None else out
    for v in binds:
        out = out.with_df(out.df.where(F.col(v).isNotNull()))
    return out if wit else out.distinct()


def _joined(a: Relation, b: Relation, on_state: bool, more: Callable[[str], Column] | None = None) -> Relation:
    shared = [v for v in a.variables if v in b.variables]
    sure = [v for v in shared if v in a.bound and v in b.bound]
    theta = [v for v in shared if v not in sure]
    a, b = a.loosened(tuple(theta)) if theta else a, b.loosened(tuple(theta)) if theta else b
    l, r = a.df.alias("l"), b.df.alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("graph_id", *(("state",) if on_state else ()), *sure)]
    on += [compatible(v, "l", "r") for v in theta]
    if more:
        on += [more(v) for v in shared]
    rows = l.join(r, on)
    bound = tuple(dict.fromkeys([*a.bound, *b.bound]))
    maybe = tuple(v for v in dict.fromkeys([*a.maybe, *b.maybe]) if v not in bound)
    columns = [F.col("l.graph_id"), F.col("l.state")]
    columns += [F.col(f"l.{v}" if v in a.bound else f"r.{v}") for v in bound]
    for v in maybe:
        if v in theta:
            value, barred = merged(v, "l", "r")
        else:
            side = "l" if v in a.maybe else "r"
            value, barred = F.col(f"{side}.{v}"), F.col(f"{side}.{excluded(v)}")
        columns += [value.alias(v), barred.alias(excluded(v))]
    wit = a.wit or b.wit
    if wit:
        columns.append((wit_union("l.wit", "r.wit") if a.wit and b.wit else F.col("l.wit" if a.wit else "r.wit")).alias("wit"))
    return Relation(rows.select(*columns), bound, maybe, wit)


def conj_join(a: Relation, b: Relation) -> Relation:
    """Natural join on state and shared variables: equality where both are surely bound, else the null-tolerant condition."""
    return _joined(a, b, True).distinct()


def conj_none(a: Relation, b: Relation) -> Relation:
    """Join that ignores b's state; b may bind no variable that a's row leaves unbound. Keeps a's state."""
    return _joined(a, b, False, lambda v: within(v, "l", "r") if v in a.maybe or v in b.maybe else F.lit(True)).distinct()


def conj_strict(a: Relation, b: Relation) -> Relation:
    """Join that also keeps each side's rows whose state has no row of the other."""
    both = conj_join(a, b)
    left = a.with_df(a.df.join(b.df.select(*KEYS).distinct(), list(KEYS), "left_anti"))
    right = b.with_df(b.df.join(a.df.select(*KEYS).distinct(), list(KEYS), "left_anti"))
    return union_plain(union_plain(both, left), right)


def conj_aw(a: Relation, b: Relation) -> Relation:
    """Join that refuses rows of one state whose bindings conflict."""
    out = conj_join(a, b)
    out = out.with_df(cut(out.df))
    states = a.df.select(*KEYS).intersect(b.df.select(*KEYS)).count()
    if states != out.df.select(*KEYS).distinct().count():
        raise ValueError("rows of the same state conflict")
    return out


def wit_union(a: Column | str, b: Column | str) -> Column:
    """Leaves of both; if any is negative, only the negative ones."""
    both = F.array_union(a, b)
    return F.when(F.exists(both, lambda x: x["negative"]), F.filter(both, lambda x: x["negative"])).otherwise(both)


def not_exists(states: DataFrame, a: Relation) -> Relation:
    return Relation(states.join(a.df.select(*KEYS).distinct(), list(KEYS), "left_anti"))


def complement(states: DataFrame, a: Relation) -> Relation:
    """Constructive negation. States without a row stay unrestricted; a state with rows must differ from each of them in some variable.

    Without variables that is an anti join, with one sure variable a set of excluded values. Otherwise each state's
    distinct rows are multiplied out, and bindings that another one covers go after each row.
    """
    if a.ground:
        return not_exists(states, a)
    if len(a.bound) == 1 and not a.maybe:
        v = a.bound[0]
        barred = a.df.groupBy(*KEYS).agg(F.array_sort(F.collect_set(v)).alias(excluded(v)))
        rows = states.join(barred, list(KEYS), "left").select(*KEYS, F.lit(None).cast("string").alias(v), F.coalesce(F.col(excluded(v)), none()).alias(excluded(v)))
        return Relation(rows, (), (v,))
    loose = a.loosened(a.variables)
    names = loose.maybe
    schema = states.schema
    fields = ", ".join(f"`{v}` string, `{excluded(v)}` array<string>" for v in names)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields if f.name in KEYS)

    def covers(general, special) -> bool:
        """Does a binding hold for all that the other holds for?"""
        if general[0] is not None:
            return general[0] == special[0]
        return special[0] not in general[1] if special[0] is not None else set(general[1]) <= set(special[1])

    def fold(pdf):
        import pandas as pd

        done: list[dict] = [{v: (None, ()) for v in names}]
        for row in pdf[[c for v in names for c in (v, excluded(v))]].itertuples(index=False):
            literals = []
            for i, v in enumerate(names):
                value, barred = row[2 * i], row[2 * i + 1]
                if value is not None:
                    literals.append((v, None, value))
                literals += [(v, x, None) for x in (barred if barred is not None else ())]
            new = []
            for env, (v, value, barred) in itertools.product(done, literals):
                has, not_in = env[v]
                if value is not None and (has not in (None, value) or value in not_in) or barred is not None and has == barred:
                    continue
                own = (value if value is not None else has, tuple(sorted({*not_in, barred} - {None})))
                new.append(env | {v: (own[0], () if own[0] is not None else own[1])})
            found = [dict(x) for x in dict.fromkeys(tuple(sorted(e.items())) for e in new)]
            done = [x for x in found if not any(y is not x and all(covers(y[v], x[v]) for v in names) for y in found)]
        keys = pdf.iloc[0][list(KEYS)]
        return pd.DataFrame([[*keys, *[x for v in names for x in (e[v][0], list(e[v][1]))]] for e in done], columns=[*KEYS, *[c for v in names for c in (v, excluded(v))]])

    covered = loose.df.select(*loose.columns[: 2 + 2 * len(names)]).groupBy(*KEYS).applyInPandas(fold, f"{kinds}, {fields}")
    free = not_exists(states, a).loosened(names)
    return Relation(covered.unionByName(free.df), (), names).distinct()


def union_plain(a: Relation, b: Relation) -> Relation:
    """Set union; a variable that one side lacks is unbound there."""
    if set(a.bound) != set(b.bound) or a.maybe or b.maybe:
        loose = tuple(v for v in dict.fromkeys([*a.variables, *b.variables]) if not (v in a.bound and v in b.bound))
        a, b = a.loosened(loose), b.loosened(loose)
    wit = a.wit and b.wit
    order = a.columns if wit else [c for c in a.columns if c != "wit"]
    return Relation(a.df.select(*order).unionByName(b.df.select(*order)), a.bound, a.maybe, wit).distinct()


def subsumed(v: str, general: str, special: str) -> Column:
    """Does the general side's binding of v hold for all that the special side's holds for?"""
    g, s, g_not, s_not = F.col(f"{general}.{v}"), F.col(f"{special}.{v}"), F.col(f"{general}.{excluded(v)}"), F.col(f"{special}.{excluded(v)}")
    value = s.isNotNull() & ~F.coalesce(F.array_contains(g_not, s), F.lit(False))
    return F.when(g.isNotNull(), g.eqNullSafe(s)).otherwise(value | (s.isNull() & (F.size(F.array_except(g_not, s_not)) == 0)))


def union(a: Relation, b: Relation) -> Relation:
    """Union without rows that another row of the same state makes superfluous, being at least as general."""
    both = union_plain(a, b)
    if not both.maybe:
        return both
    rows = cut(both.df)
    g, s = rows.alias("g"), rows.alias("s")
    same = F.lit(True)
    for v in both.maybe:
        same = same & F.col(f"g.{v}").eqNullSafe(F.col(f"s.{v}")) & F.col(f"g.{excluded(v)}").eqNullSafe(F.col(f"s.{excluded(v)}"))
    on = [F.col(f"g.{k}") == F.col(f"s.{k}") for k in (*KEYS, *both.bound)] + [subsumed(v, "g", "s") for v in both.maybe] + [~same]
    return both.with_df(s.join(g, on, "left_anti").select(*[F.col(f"s.{c}").alias(c) for c in both.columns]))


def seq_or(states: DataFrame, a: Relation, b: Relation) -> Relation:
    """a, and those rows of b that don't agree with a."""
    plain = unwitified(a) if a.wit else a
    return union(a, conj_join(b, complement(states, plain)))


def implies(states: DataFrame, a: Relation, b: Relation) -> Relation:
    return union(complement(states, a), b)


def exists(v: str, a: Relation, keep: bool = False) -> Relation:
    """Projects v out. Rows that only exclude values of v go; with keep, a leaf says what v was and takes the leaves there were."""
    if v not in a.variables:
        return a
    df = a.df
    if v in a.maybe:
        df = df.where(F.col(v).isNotNull() | (F.size(excluded(v)) == 0))
    if a.wit and keep:
        leaf = F.struct(F.col("state").cast("string").alias("state"), F.lit(v).alias("var"), F.col(v).alias("value"), F.lit(False).alias("negative"))
        df = df.withColumn("wit", F.when(F.col(v).isNotNull(), F.array_union("wit", F.array(leaf))).otherwise(F.col("wit")))
    out = Relation(df, tuple(x for x in a.bound if x != v), tuple(x for x in a.maybe if x != v), a.wit)
    return out.distinct()


def unchecked(a: Relation) -> Relation:
    """Without the witness column, which column pruning then leaves out of all that feeds it."""
    return Relation(a.df.drop("wit"), a.bound, a.maybe).distinct() if a.wit else a


def unwitified(a: Relation) -> Relation:
    """Drops rows with negative leaves, and the leaves."""
    return unchecked(a.with_df(a.df.where(~F.exists("wit", lambda x: x["negative"])))) if a.wit else a


def partial_filter(a: Relation) -> tuple[Relation, DataFrame]:
    """Rows without negative leaves, and the others as a report."""
    bad = F.exists("wit", lambda x: x["negative"])
    return a.with_df(a.df.where(~bad)), a.df.where(bad)


def filter_conj(states: DataFrame, a: Relation, b: Relation) -> Relation:
    """Rows of b that a excludes, without the full matches."""
    outside = conj_join(b, complement(states, a))
    full = conj_join(a, b)
    return outside.with_df(outside.df.join(full.df.select(*KEYS).distinct(), list(KEYS), "left_anti"))


def required_states(a: Relation, required: Relation) -> Relation:
    return a.with_df(a.df.join(required.df.select(*KEYS).distinct(), list(KEYS), "left_semi"))


def let(a: Relation, body: Callable[[Relation], Relation]) -> Relation:
    """Evaluates a once; body may use it as often as it likes."""
    return body(a.with_df(cut(a.df)))


def let_reachable(graph: Graph, a: Callable[[DataFrame], Relation], within_states: DataFrame, body: Callable[[Relation], Relation]) -> Relation:
    """let, with a evaluated against given states only."""
    return let(a(within_states), body)


def difference(a: Relation, b: Relation) -> Relation:
    return a.with_df(a.df.join(b.df.select(*a.columns), list(a.columns), "left_anti")) if not a.maybe else a.with_df(a.df.select(*a.columns).exceptAll(b.df.select(*a.columns)).distinct())


def is_subset(a: Relation, b: Relation) -> bool:
    return difference(a, b).df.isEmpty()


def grouped(a: Relation, by: Sequence[str], collect: str) -> DataFrame:
    return a.df.groupBy(*by).agg(F.array_sort(F.collect_set(collect)).alias(collect))


def final_sort(a: Relation) -> DataFrame:
    return a.df.orderBy(*a.columns)


def and_any(graph: Graph, a: Relation, b: Relation, reach: Callable[[Relation], DataFrame]) -> Relation:
    """The only row of a in each graph, joined with b's rows at any state reachable from it; kept as it is if there are none.

    reach: pairs (graph_id, state, reached) for a's states.
    """
    several = a.df.groupBy("graph_id").agg(F.countDistinct("state").alias("n")).where("n > 1")
    if not several.isEmpty():
        raise ValueError("more than one state on the left in a graph")
    pairs = reach(a)
    moved = b.with_df(b.df.withColumnRenamed("state", "reached").join(pairs, ["graph_id", "reached"]).select("graph_id", "state", *b.columns[2:]))
    both = conj_join(a, moved)
    alone = a.with_df(a.df.join(both.df.select(*KEYS).distinct(), list(KEYS), "left_anti"))
    return union_plain(both, alone)


def any_of_several(a: Relation, b: Relation, reach: Callable[[Relation], DataFrame]) -> Relation:
    """As and_any for several states on the left; b's bindings must be among those of a's row."""
    pairs = reach(a)
    moved = b.with_df(b.df.withColumnRenamed("state", "reached").join(pairs, ["graph_id", "reached"]).select("graph_id", "state", *b.columns[2:]))
    new = [v for v in b.variables if v not in a.variables]
    for v in new:
        moved = moved.with_df(moved.df.where(F.lit(False)))
    both = conj_join(a, moved)
    alone = a.with_df(a.df.join(both.df.select(*KEYS).distinct(), list(KEYS), "left_anti"))
    return union_plain(both, alone)


def first_by(df: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
