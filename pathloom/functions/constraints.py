"""Constraints on a variable's value, as boolean columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

def always() -> Column:
    return F.lit(True)


def never() -> Column:
    return F.lit(False)


def all_of(*parts: Column) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def any_of(*parts: Column) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def none_of(part: Column) -> Column:
    return ~F.coalesce(part, F.lit(False))


def text_is(value: Column, text: str) -> Column:
    return value == text


def integer(value: Column) -> Column:
    """An integer constant's number: sign, digits, and a suffix of u and l that is left out; null for other texts."""
    return F.regexp_extract(value.cast("string"), r"^\s*([+-]?\d+)[uUlL]*\s*$", 1).try_cast("long")


def int_equals(value: Column, text: str) -> Column:
    """Equality is that of the texts."""
    return value == text


def int_at_most(value: Column, bound: int) -> Column:
    return F.coalesce(integer(value) <= bound, F.lit(False))


def int_at_least(value: Column, bound: int) -> Column:
    return F.coalesce(integer(value) >= bound, F.lit(False))


def operator_in(value: Column, operators: Sequence[str]) -> Column:
    return value.isin(*operators)


def equals_inherited(value: Column, inherited: Column) -> Column:
    return value == inherited


def matches(value: Column, pattern: str) -> Column:
    """A regular expression that is searched for."""
    return value.rlike(pattern)


def script(f: Callable, *values: Column) -> Column:
    """A user's boolean function of a batch of values; null counts as false."""
    return F.coalesce(F.pandas_udf(f, "boolean")(*values), F.lit(False))


def subterm_of(value: Column, terms: Column) -> Column:
    """Among the subterms of inherited variables (an array of canonical texts)."""
    return F.coalesce(F.array_contains(terms, value), F.lit(False))


def type_is(value: Column, name: str) -> Column:
    """Equality of canonical type texts: space runs are one space, and a star has none before it."""
    canonical = F.trim(F.regexp_replace(F.regexp_replace(value, r"\s+", " "), r" ?\* ?", "*"))
    return canonical == name


def position_is(a: Column, b: Column) -> Column:
    """Positions (lo, hi) are equal if one contains the other."""
    holds = lambda x, y: (x["lo"] <= y["lo"]) & (x["hi"] >= y["hi"])
    return holds(a, b) | holds(b, a)


IDENTIFIER = r"^[A-Za-z_]\w*$"


def form_is(value: Column, form: str) -> Column:
    """identifier, constant (a number, a character, a string or a name in capitals), or any."""
    if form == "identifier":
        return value.rlike(IDENTIFIER)
    if form == "constant":
        return value.rlike(r"""^([+-]?\d[\w.]*|'.*'|".*"|[A-Z_][A-Z0-9_]*)$""")
    return F.lit(True)
