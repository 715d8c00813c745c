"""Relations of triples, graphs, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bindings import excluded, none

KEYS = ("graph_id", "state")


@dataclass(frozen=True)
class Relation:
    """Rows (graph_id, state, variables). bound variables have a value in every row; those in maybe have a value column, null where
    unbound, and an exclusion column. wit: a column of the witness leaves (state, var, value, negative)."""

    df: DataFrame
    bound: tuple[str, ...] = ()
    maybe: tuple[str, ...] = ()
    wit: bool = False

    @property
    def variables(self) -> tuple[str, ...]:
        return self.bound + self.maybe

    @property
    def columns(self) -> list[str]:
        return [*KEYS, *self.bound, *[c for v in self.maybe for c in (v, excluded(v))], *["wit"] * self.wit]

    @property
    def ground(self) -> bool:
        return not self.variables

    def with_df(self, df: DataFrame) -> Relation:
        return replace(self, df=df)

    def distinct(self) -> Relation:
        return self.with_df(self.df.select(*self.columns).dropDuplicates())

    def loosened(self, variables: tuple[str, ...]) -> Relation:
        """The same rows with each of the given variables as one that may be unbound."""
        have = set(self.variables)
        columns: dict[str, Column] = {}
        for v in variables:
            if v not in have:
                columns[v] = F.lit(None).cast("string")
            if v not in self.maybe:
                columns[excluded(v)] = none()
        df = self.df.withColumns(columns) if columns else self.df
        out = Relation(df, tuple(v for v in self.bound if v not in variables), tuple(dict.fromkeys((*self.maybe, *variables))), self.wit)
        return out.with_df(df.select(*out.columns))


@dataclass(frozen=True)
class Graph:
    """nodes: graph_id, node_id, label and more; edges: graph_id, src, dst, edge_kind. Every node has a successor.

    linear: a column of positions, if each node's only successor is the next one (the last one's is itself).
    """

    nodes: DataFrame
    edges: DataFrame
    linear: str | None = None

    def states(self) -> DataFrame:
        return self.nodes.select("graph_id", F.col("node_id").alias("state"))


def shared_folder(spark: SparkSession) -> str:
    """Where the driver and all executors see files. Where none is set, a session in one process gets a temporary folder, as in tests; on a
    cluster that is an error."""
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not there:
        if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="pathloom-")
        sc.setCheckpointDir(there)
    return there.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/pathloom/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with its rank (from 1) by order. Rows are dealt by range, so no task ranks them all."""
    dealt = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    parts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(parts, "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")
