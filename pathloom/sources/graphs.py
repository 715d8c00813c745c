"""Flow graphs from tables: event traces, conversations, the key hierarchy, users' state machines, lines of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relation import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chain(nodes: DataFrame) -> DataFrame:
    """Edges from each node to the next by pos; the last one's leads to itself."""
    w = Window.partitionBy("graph_id").orderBy("pos")
    return nodes.select("graph_id", F.col("node_id").alias("src"), F.coalesce(F.lead("node_id").over(w), F.col("node_id")).alias("dst"), F.lit("Direct").alias("edge_kind"))


def events(spark: SparkSession, sf_dir: str) -> Graph:
    """G1: a trace for each user; an event leads to the user's next one by (ts, event_id)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts", "value", "props")
    nodes = e.select(
        F.col("user_id").alias("graph_id"), F.col("event_id").alias("node_id"), F.col("event_type").alias("label"), F.row_number().over(w).cast("long").alias("pos"),
        "value", F.get_json_object("props", "$.k").alias("k"), F.lit(False).alias("is_loop"),
    )
    return Graph(nodes, _chain(nodes), "pos")


def conversations(spark: SparkSession, sf_dir: str) -> Graph:
    """G2: the turns of each conversation, labelled by role."""
    c = table(spark, sf_dir, "conversations")
    nodes = c.select(F.col("conv_id").alias("graph_id"), F.col("turn").alias("node_id"), F.col("role").alias("label"), F.col("turn").alias("pos"), "text", F.lit(False).alias("is_loop"))
    return Graph(nodes, _chain(nodes), "pos")


def hierarchy(spark: SparkSession, sf_dir: str) -> Graph:
    """G3: regions, nations, customers, orders and classes of lines (order, return flag, line status); one tree for each region.

    Lines are joined in once; childless nodes lead to themselves.
    """
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = lambda letter, *c: F.concat_ws("|", F.concat(F.lit(letter), F.col(c[0]).cast("string")), *c[1:])
    n = nation.select("n_nationkey", F.col("n_regionkey").cast("long").alias("graph_id"))
    c = customer.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("graph_id", "c_custkey", "c_nationkey", "c_mktsegment")  # 25 nations
    o = orders.join(c.select("graph_id", "c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select("graph_id", "o_orderkey", "o_custkey", "o_orderstatus")
    l = lines.select("l_orderkey", "l_returnflag", "l_linestatus").distinct().join(o.select("graph_id", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))

    def part(df, node, parent, label, status=None, flag=None, segment=None):
        text = lambda x: F.lit(None).cast("string") if x is None else F.col(x)
        return df.select("graph_id", node.alias("node_id"), parent.alias("parent"), F.lit(label).alias("label"), text(status).alias("status"), text(flag).alias("flag"), text(segment).alias("segment"))

    nodes = part(region.withColumn("graph_id", F.col("r_regionkey").cast("long")), key("R", "r_regionkey"), F.lit(None).cast("string"), "region")
    nodes = nodes.union(part(n, key("N", "n_nationkey"), key("R", "graph_id"), "nation"))
    nodes = nodes.union(part(c, key("C", "c_custkey"), key("N", "c_nationkey"), "customer", segment="c_mktsegment"))
    nodes = nodes.union(part(o, key("O", "o_orderkey"), key("C", "o_custkey"), "order", status="o_orderstatus"))
    nodes = nodes.union(part(l, key("L", "l_orderkey", "l_returnflag", "l_linestatus"), key("O", "l_orderkey"), "line", status="l_linestatus", flag="l_returnflag"))
    down = nodes.where("parent is not null").select("graph_id", F.col("parent").alias("src"), F.col("node_id").alias("dst"))
    leaves = nodes.select("graph_id", F.col("node_id").alias("src")).join(down.select("graph_id", "src").distinct(), ["graph_id", "src"], "left_anti")
    edges = down.union(leaves.select("graph_id", "src", F.col("src").alias("dst"))).withColumn("edge_kind", F.lit("Direct"))
    return Graph(nodes.drop("parent").withColumn("is_loop", F.lit(False)), edges)


def machines(spark: SparkSession, sf_dir: str) -> Graph:
    """G4: for each user the event types seen, with an edge for each pair of consecutive types; types without a successor lead to
    themselves. is_loop: the type follows itself directly."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.lead("event_type").over(w).alias("next"))
    pairs = e.where("next is not null").select(F.col("user_id").alias("graph_id"), F.col("event_type").alias("src"), F.col("next").alias("dst")).distinct()
    nodes = e.select(F.col("user_id").alias("graph_id"), F.col("event_type").alias("node_id")).distinct()
    ends = nodes.select("graph_id", F.col("node_id").alias("src")).join(pairs.select("graph_id", "src").distinct(), ["graph_id", "src"], "left_anti")
    loops = pairs.where("src = dst").select("graph_id", F.col("src").alias("node_id"), F.lit(True).alias("is_loop"))
    nodes = nodes.join(loops, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.col("node_id").alias("label"), F.coalesce("is_loop", F.lit(False)).alias("is_loop"))
    return Graph(nodes, pairs.union(ends.select("graph_id", "src", F.col("src").alias("dst"))).withColumn("edge_kind", F.lit("Direct")))


def text_lines(spark: SparkSession, sf_dir: str) -> Graph:
    """G5: the lines of each document, labelled by what they begin with."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    nodes = d.select(F.col("doc_id").alias("graph_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    label = F.when(F.col("line").rlike(r"^\s*$"), "blank").when(F.col("line").rlike("^[0-9]"), "number").when(F.col("line").rlike("^[A-Z]"), "capital").otherwise("other")
    nodes = nodes.select("graph_id", F.col("pos").cast("long").alias("node_id"), label.alias("label"), F.col("pos").cast("long").alias("pos"), "line", F.lit(False).alias("is_loop"))
    return Graph(nodes, _chain(nodes), "pos")
