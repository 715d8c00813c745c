"""Rules in sequence: environments of bindings, what a rule's matches add to them, and what later rules see.

An environment is a row: a string column for each variable, arrays of positions for position variables, and `matched`, the
names of the rules that matched on the way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relation import ranked


def initial(spark) -> DataFrame:
    return spark.createDataFrame([([],)], "matched array<string>")


def relevant(env: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Each combination of the variables that a rule reads, once: a rule is evaluated for these only."""
    return env.select(*variables).distinct()


def project(env: DataFrame, used_after: Sequence[str]) -> DataFrame:
    return env.select(*[v for v in used_after if v in env.columns], "matched")


def deduplicated(env: DataFrame) -> DataFrame:
    """Equal environments become one, with all the rules that matched on the way to any of them."""
    return united(env, [c for c in env.columns if c != "matched"], ["matched"])


def united(rows: DataFrame, by: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """One row for each value of `by`, with the sorted distinct elements of all its arrays. Elements meet as rows, each once, so a
    common value doesn't gather the arrays of all its rows."""
    parts = None
    for a in arrays:
        kinds = {c: rows.schema[c].dataType.elementType for c in arrays}
        one = rows.select(*by, F.explode_outer(a).alias("_x")).distinct()
        one = one.select(*by, *[(F.col("_x") if c == a else F.lit(None).cast(kinds[c])).alias(c) for c in arrays])
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(*by).agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in arrays])


def apply(env: DataFrame, matches: DataFrame, rule: str, used_after: Sequence[str]) -> DataFrame:
    """matches: the bindings of a rule's matches, among them those of the variables it inherits. An environment gives one for each
    match that agrees with it; without a match it stays as it was. New variables are null there."""
    shared = [c for c in matches.columns if c in env.columns]
    found = matches.distinct().withColumn("_hit", F.lit(True))
    rows = env.join(found, shared, "left") if shared else _without_shared(env, found)
    rows = rows.withColumn("matched", F.when(F.col("_hit"), F.array_union("matched", F.array(F.lit(rule)))).otherwise(F.col("matched")))
    return deduplicated(project(rows.drop("_hit"), used_after))


def _without_shared(env: DataFrame, found: DataFrame) -> DataFrame:
    """A rule that inherits nothing: every environment meets every match, as the rule asks for. Environments are dealt over salts and matches
    repeated for each, so no task holds both sides; mostly there is one environment only."""
    salts = int(env.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = env.withColumn("_salt", F.pmod(F.xxhash64(*env.columns), F.lit(salts)))
    many = found.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(many, "_salt", "left").drop("_salt")


def regrouped(env: DataFrame, positions: Sequence[str]) -> DataFrame:
    """Environments equal in all but positions see the union of these."""
    others = [c for c in env.columns if c not in positions and c != "matched"]
    return united(env, others, [*positions, "matched"])


def consistent(env: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Without environments where two inherited position variables that must agree share no position."""
    for a, b in pairs:
        env = env.where(F.arrays_overlap(a, b))
    return env


def possible(env: DataFrame, elements: DataFrame, position: str) -> DataFrame:
    """env and element for elements (element, lo, hi) that hold one of the inherited positions; others can't match."""
    exploded = env.withColumn("_p", F.explode(position))
    return exploded.join(elements, (F.col("_p") >= F.col("lo")) & (F.col("_p") <= F.col("hi"))).drop("_p", "lo", "hi").distinct()


# Dependencies
@dataclass(frozen=True)
class Dep:
    kind: str
    rule: str = ""
    parts: tuple[Dep, ...] = ()

    def column(self, matched: Column, ever: Sequence[str]) -> Column:
        """here: the rule matched on this way; ever: it matched anywhere."""
        if self.kind == "here":
            return F.array_contains(matched, self.rule)
        if self.kind == "not":
            return ~F.array_contains(matched, self.rule)
        if self.kind == "ever":
            return F.lit(self.rule in ever)
        if self.kind == "never":
            return F.lit(self.rule not in ever)
        columns = [p.column(matched, ever) for p in self.parts]
        out = columns[0]
        for c in columns[1:]:
            out = out & c if self.kind == "and" else out | c
        return out


def depends(env: DataFrame, dep: Dep, ever: Sequence[str]) -> DataFrame:
    return env.where(dep.column(F.col("matched"), ever))


def rules_matched(env: DataFrame, rules: Sequence[str]) -> list[str]:
    """Those of the given rules that matched anywhere: one row of flags reaches the driver."""
    row = env.agg(*[F.max(F.array_contains("matched", r).cast("int")).alias(f"r{i}") for i, r in enumerate(rules)]).first()
    return [r for i, r in enumerate(rules) if row[f"r{i}"]]


# Fresh names, numbers, leaves
def fresh_concat(env: DataFrame, name: str, *parts: Column) -> DataFrame:
    return env.withColumn(name, F.concat(*parts))


def fresh_counted(env: DataFrame, name: str, seed: str, by: Sequence[str]) -> DataFrame:
    """seed and a number that counts within each group: equal relevant bindings get equal names."""
    distinct = env.select(*by).distinct()
    if len(by) > 1:
        numbered = distinct.withColumn("_n", F.row_number().over(Window.partitionBy(by[0]).orderBy(*by[1:])))
    else:
        numbered = ranked(distinct, by, "_n")
    return env.join(numbered.select(*by, F.concat(F.lit(seed), F.col("_n").cast("string")).alias(name)), list(by))


def numbered_leaves(leaves: DataFrame, tree: str, leaf: Sequence[str]) -> DataFrame:
    """Equal leaves of several trees become one, with the sorted numbers of these trees."""
    return leaves.groupBy(*leaf).agg(F.array_sort(F.collect_set(tree)).alias("trees"))


def unwrapped(df: DataFrame) -> DataFrame:
    """A row for each witness leaf."""
    keep = [c for c in df.columns if c != "wit"]
    return df.select(*keep, F.explode("wit").alias("_w")).select(*keep, "_w.*")


def used_after(leaves: DataFrame, tree: str) -> DataFrame:
    """For each tree and variable, all its values."""
    return leaves.groupBy(tree, "var").agg(F.array_sort(F.collect_set("value")).alias("values"))


def coalesced(rows: DataFrame, by: Sequence[str], positions: str) -> DataFrame:
    return united(rows.select(*by, positions), by, [positions])


def stripped(value: Column) -> Column:
    """The form in which later rules compare a value: comments gone, space runs one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"/\*.*?\*/", " "), r"\s+", " "))


# Edits
def conflicts(edits: DataFrame) -> DataFrame:
    """edits: file, offset, length, new. Places that two different edits touch."""
    w = Window.partitionBy("file").orderBy("offset", "length", "new").rowsBetween(Window.unboundedPreceding, -1)
    rows = edits.distinct().withColumn("_end", F.max(F.col("offset") + F.col("length")).over(w))
    return rows.where(F.col("_end") > F.col("offset")).drop("_end")


def applied(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """texts: file, text. Texts after their edits (0-based offsets in characters), all of a file in one pass over the text."""
    one = F.struct("offset", "length", "new")
    grouped = edits.distinct().groupBy("file").agg(F.array_sort(F.collect_list(one)).alias("_e"))  # a file's own edits
    rows = texts.join(grouped, "file", "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    step = lambda s, e: F.struct((e["offset"] + e["length"]).cast("int").alias("at"), F.concat(s["done"], F.substring(F.col("text"), s["at"] + 1, (e["offset"] - s["at"]).cast("int")), e["new"]).alias("done"))
    end = lambda s: F.concat(s["done"], F.substring(F.col("text"), s["at"] + 1, F.length("text")))
    new = F.aggregate("_e", start, step, end)
    return rows.select("file", F.coalesce(new, F.col("text")).alias("text"))


# Scripts
def script(env: DataFrame, inputs: Sequence[str], outputs: Sequence[str], f: Callable[..., dict | None], defaults: dict[str, str] | None = None, dep: Dep | None = None, ever: Sequence[str] = ()) -> DataFrame:
    """Runs f once for each distinct binding of the inputs, where the dependencies hold and all inputs without a default are bound. f
    gives values of the outputs, or None to reject. If nothing remains, the environment is the initial one again."""
    defaults = defaults or {}
    named = env.withColumns({v: F.coalesce(F.col(v), F.lit(x)) for v, x in defaults.items()})
    ready = F.lit(True)
    for v in inputs:
        ready = ready & F.col(v).isNotNull()
    if dep is not None:
        ready = ready & dep.column(F.col("matched"), ever)
    run, rest = named.where(ready), named.where(~ready)
    schema = ", ".join(f"`{v}` string" for v in (*inputs, *outputs))

    def call(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for values in pdf[list(inputs)].itertuples(index=False, name=None):
                got = f(*values)
                if got is not None:
                    rows.append([*values, *[got.get(o) for o in outputs]])
            yield pd.DataFrame(rows, columns=[*inputs, *outputs])

    results = relevant(run, inputs).mapInPandas(call, schema)
    kept = run.join(results, list(inputs))
    for o in outputs:
        rest = rest.withColumn(o, F.lit(None).cast("string"))
    out = kept.unionByName(rest)
    return out if not out.isEmpty() else initial(env.sparkSession)


def merge(partials: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """A worker's value for each variable name; the final script receives the list of all values."""
    return partials.groupBy(*by).agg(F.array_sort(F.collect_list(name)).alias(name))


def iterate(start: Sequence[tuple], step: Callable[[tuple], tuple[DataFrame, Sequence[tuple]]]) -> list[DataFrame]:
    """A queue of runs (files, virtual rules, virtual identifiers): a run gives its results and further runs. Runs on files go first."""
    queue, results = list(start), []
    while queue:
        k = next((i for i, r in enumerate(queue) if r[0]), 0)
        found, more = step(queue.pop(k))
        results.append(found)
        queue += list(more)
    return results


def hooks(first: Callable[[], dict], runs: Sequence, step: Callable[[dict, object], dict], last: Callable[[dict], dict] | None = None) -> dict:
    """What `first` makes before any run goes through all runs, one after the other, and through `last` after them."""
    state = first()
    for run in runs:
        state = step(state, run)
    return last(state) if last else state
