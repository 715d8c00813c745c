"""What the operators of this subpackage share: the shared scratch folder, tables that cut lineage, ranks without a hot task."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship  # noqa: F401

#: A word of a text, as the job defines it.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir). Where none is set, a session in one process gets a
    temporary one, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not there:
        if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="pathloom-")
        sc.setCheckpointDir(there)
    return there.rstrip("/")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, with underscores added where df (or a wanted name before) has such a column, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the shared folder."""
    return f"{shared_dir(spark)}/pathloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `stored` gave and nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def collect_garbage(spark: SparkSession) -> None:
    """Shuffle files go when the driver collects what read them, which may be long after; loops of many small steps pile them up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, order: Sequence[str], group: Sequence[str] = (), rank: str = "rank", sums: dict[str, str] | None = None, name: str = "numbered") -> DataFrame:
    """Adds rank (from 0, within group, by order) and, for each {new: column} of sums, the sum of column over all rows before it
    in (group, order).

    Rows are dealt by range of (group, order), so a group that holds most rows spreads over many tasks; only one row for each
    task and group is added up to get the offsets. group columns must not be null.
    """
    sums, keys = sums or {}, [*group, *order]
    dealt = stored(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), name)
    own = Window.partitionBy("_part", *group).orderBy(*order)
    out = dealt.withColumn("_own", F.row_number().over(own) - 1)
    whole = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    for new, column in sums.items():
        out = out.withColumn(new, F.coalesce(F.sum(column).over(whole), F.lit(0)))
    counts = dealt.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", *group, F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_off"))
    out = out.join(offsets, ["_part", *group])
    if sums:
        totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{new}") for new, c in sums.items()])
        run = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
        totals = totals.select("_part", *[F.coalesce(F.sum(f"_s_{new}").over(run), F.lit(0)).alias(f"_t_{new}") for new in sums])
        out = out.join(totals, "_part")
        for new in sums:
            out = out.withColumn(new, F.col(new) + F.col(f"_t_{new}"))
    return out.withColumn(rank, (F.col("_own") + F.col("_off")).cast("long")).drop("_own", "_off", "_part", "_n", *[f"_t_{n}" for n in sums])


def trimming(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f for mapInArrow; when its rows are out, memory that is free goes back to the system. Workers outlive their tasks, and what
    they keep is missing for the stages that follow on the same executor."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # only some systems' C libraries have it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches (of about `size` bytes at most), so that what is made from one stays small."""
    for b in batches:
        n = max(1, min(rows, size * b.num_rows // max(1, b.nbytes)))
        for a in range(0, b.num_rows, n):
            yield b.slice(a, n)
