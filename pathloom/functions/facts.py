"""Facts of an outside analysis: places of a file with a set of integers, bounds, or something else."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(lines: DataFrame) -> DataFrame:
    """lines: value. Lines `file;begin;end;kind;content` where kind is ints (comma-separated), bounds (`lo..hi`, either may be missing) or other.
    Lines that aren't such are left out."""
    f = F.split("value", ";")
    rows = lines.where(F.size(f) == 5).select(F.trim(f[0]).alias("file"), f[1].try_cast("long").alias("begin"), f[2].try_cast("long").alias("end"), F.trim(f[3]).alias("kind"), F.trim(f[4]).alias("content"))
    rows = rows.where("begin is not null and end is not null and begin <= end and kind in ('ints', 'bounds', 'other')")
    ints = F.when(F.col("kind") == "ints", F.array_sort(F.array_distinct(F.filter(F.transform(F.split("content", ","), lambda x: F.trim(x).try_cast("long")), lambda x: x.isNotNull()))))
    bound = lambda k: F.when(F.col("kind") == "bounds", F.regexp_extract("content", r"^\s*(-?\d*)\s*\.\.\s*(-?\d*)\s*$", k).try_cast("long"))
    good = (F.col("kind") != "bounds") | F.col("content").rlike(r"^\s*(-?\d+)?\s*\.\.\s*(-?\d+)?\s*$")
    return rows.where(good).select("file", "begin", "end", ints.alias("ints"), bound(1).alias("lo"), bound(2).alias("hi"), F.when(F.col("kind") == "other", F.col("content")).alias("other"), "kind")


def find(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """asked: id, file, p, q. For each, all facts of one interval: the latest begin at or before p, and for that begin only the
    earliest end at or after q; no earlier begin is tried instead.

    Begins are looked up by carrying the last one forward along each file, and ends are ranked within one begin: no row meets
    all facts of a file.
    """
    begins = facts.select("file", F.col("begin").alias("at")).distinct().select("file", "at", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("q"))
    rows = begins.union(asked.select("file", F.col("p").alias("at"), F.lit(1), F.col("id").cast("long"), F.col("q").cast("long")))
    w = Window.partitionBy("file").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = rows.withColumn("begin", F.last(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(w)).where("kind = 1 and begin is not null").select("id", "file", "begin", "q")
    ends = carried.join(facts.select("file", "begin", "end").distinct(), ["file", "begin"]).where("end >= q").groupBy("id", "file", "begin").agg(F.min("end").alias("end"))
    return ends.join(facts, ["file", "begin", "end"])


def in_bounds(value: Column, lo: Column, hi: Column) -> Column:
    """A missing bound is open."""
    return F.coalesce(value >= lo, F.lit(True)) & F.coalesce(value <= hi, F.lit(True))


def bounds_contain(lo: Column, hi: Column, in_lo: Column, in_hi: Column) -> Column:
    """Are the second bounds within the first?"""
    low = lo.isNull() | F.coalesce(in_lo >= lo, F.lit(False))
    high = hi.isNull() | F.coalesce(in_hi <= hi, F.lit(False))
    return low & high


def intersection(a: str, b: str) -> Column:
    """Of two fact columns (structs kind, ints, lo, hi): a struct, or null if they don't meet. Sets give their common integers,
    a set and bounds give the bounds if all the integers lie in them, bounds and bounds the first if one contains the other, others none."""
    x, y = F.col(a), F.col(b)
    kind = lambda f, k: f["kind"] == k
    make = lambda k, ints, lo, hi: F.struct(F.lit(k).alias("kind"), ints.alias("ints"), lo.alias("lo"), hi.alias("hi"))
    no_ints, no = F.lit(None).cast("array<bigint>"), F.lit(None).cast("bigint")
    common = F.array_sort(F.array_intersect(x["ints"], y["ints"]))
    inside = lambda s, t: F.forall(s["ints"], lambda v: in_bounds(v, t["lo"], t["hi"]))
    return (
        F.when(kind(x, "ints") & kind(y, "ints"), F.when(F.size(common) > 0, make("ints", common, no, no)))
        .when(kind(x, "ints") & kind(y, "bounds"), F.when(inside(x, y), make("bounds", no_ints, y["lo"], y["hi"])))
        .when(kind(x, "bounds") & kind(y, "ints"), F.when(inside(y, x), make("bounds", no_ints, x["lo"], x["hi"])))
        .when(kind(x, "bounds") & kind(y, "bounds"), F.when(bounds_contain(x["lo"], x["hi"], y["lo"], y["hi"]) | bounds_contain(y["lo"], y["hi"], x["lo"], x["hi"]), make("bounds", no_ints, x["lo"], x["hi"])))
    )


def satisfy(found: DataFrame, asked: DataFrame, holds: Callable[[DataFrame], Column]) -> DataFrame:
    """For each position asked: has_any, exists, for_all (also true without facts), for_all1 (false without)."""
    sums = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(holds(found), 1)).alias("m"))
    rows = asked.select("id").join(sums, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    return rows.select("id", (F.col("n") > 0).alias("has_any"), (F.col("m") > 0).alias("exists"), (F.col("m") == F.col("n")).alias("for_all"), ((F.col("n") > 0) & (F.col("m") == F.col("n"))).alias("for_all1"))


def single_int(n: int) -> Column:
    return F.coalesce((F.size("ints") == 1) & (F.col("ints")[0] == n), F.lit(False)) | F.coalesce((F.col("lo") == n) & (F.col("hi") == n), F.lit(False))


def contains_int(n: int) -> Column:
    return F.coalesce(F.array_contains("ints", F.lit(n).cast("long")), F.lit(False)) | ((F.col("kind") == "bounds") & in_bounds(F.lit(n), F.col("lo"), F.col("hi")))


def only_nul() -> Column:
    return single_int(0)


def also_nul() -> Column:
    return contains_int(0)


def also_int(n: int) -> Column:
    return contains_int(n) & ~single_int(n)
