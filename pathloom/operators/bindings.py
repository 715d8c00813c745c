"""Bindings as columns: a variable v has a column v (its value, or null) and, where it may be unbound, v__not (values it mustn't have)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def excluded(v: str) -> str:
    return f"{v}__not"


def none() -> Column:
    return F.expr("cast(array() as array<string>)")


def _col(side: str, name: str) -> Column:
    return F.col(f"{side}.{name}") if side else F.col(name)


def compatible(v: str, left: str, right: str) -> Column:
    """May one variable have the bindings of both sides? Null-tolerant: unbound agrees with all that it doesn't exclude."""
    a, b = _col(left, v), _col(right, v)
    a_not, b_not = _col(left, excluded(v)), _col(right, excluded(v))
    barred = F.coalesce(F.array_contains(a_not, b), F.lit(False)) | F.coalesce(F.array_contains(b_not, a), F.lit(False))
    return (a.isNull() | b.isNull() | (a == b)) & ~barred


def merged(v: str, left: str, right: str) -> tuple[Column, Column]:
    """The merged binding: value, and exclusions where there is no value."""
    value = F.coalesce(_col(left, v), _col(right, v))
    both = F.array_sort(F.array_union(_col(left, excluded(v)), _col(right, excluded(v))))
    return value, F.when(value.isNull(), both).otherwise(none())


def cleaned(v: str, side: str = "") -> tuple[Column, Column]:
    """Sorted and distinct exclusions; a value absorbs them."""
    value = _col(side, v)
    return value, F.when(value.isNull(), F.array_sort(F.array_distinct(F.coalesce(_col(side, excluded(v)), none())))).otherwise(none())


def same(v: str, left: str, right: str) -> Column:
    exclusions = F.array_sort(_col(left, excluded(v))).eqNullSafe(F.array_sort(_col(right, excluded(v))))
    return _col(left, v).eqNullSafe(_col(right, v)) & exclusions


def within(v: str, left: str, right: str) -> Column:
    """Is the right side's domain in the left's?"""
    return _col(right, v).isNull() | _col(left, v).isNotNull()


def merge(df: DataFrame, v: str, left: str, right: str) -> DataFrame:
    """df has a column pair for each side (left_v, left_v__not, ...): adds v and v__not where compatible, drops other rows."""
    a, b = F.col(f"{left}{v}"), F.col(f"{right}{v}")
    a_not, b_not = F.col(f"{left}{excluded(v)}"), F.col(f"{right}{excluded(v)}")
    barred = F.coalesce(F.array_contains(a_not, b), F.lit(False)) | F.coalesce(F.array_contains(b_not, a), F.lit(False))
    value = F.coalesce(a, b)
    rows = df.where((a.isNull() | b.isNull() | (a == b)) & ~barred)
    return rows.withColumns({v: value, excluded(v): F.when(value.isNull(), F.array_sort(F.array_union(a_not, b_not))).otherwise(none())})


def _literal(v: str):
    return lambda x: F.struct(F.lit(v).alias("var"), x.cast("string").alias("value"), F.lit(None).cast("string").alias("excluded"))


def negated(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """A conjunction of literals becomes a row for each negated literal: var, value (of a negated exclusion), excluded (of a negated value)."""
    parts = []
    for v in variables:
        parts.append(F.array(F.struct(F.lit(v).alias("var"), F.lit(None).cast("string").alias("value"), F.col(v).cast("string").alias("excluded"))))
        parts.append(F.transform(excluded(v), _literal(v)))
    literals = F.filter(F.concat(*parts), lambda x: x["value"].isNotNull() | x["excluded"].isNotNull())
    kept = [c for c in df.columns if c not in variables and c not in map(excluded, variables)]
    return df.select(*kept, F.explode(literals).alias("_l")).select(*kept, "_l.var", "_l.value", "_l.excluded")


def split(df: DataFrame, v: str) -> tuple[DataFrame, DataFrame]:
    """The environment of one variable, and that of all others."""
    own = [v, excluded(v)]
    return df.select("graph_id", "state", *[c for c in own if c in df.columns]), df.drop(*own)
