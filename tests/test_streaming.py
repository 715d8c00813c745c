"""Sequences over a stream against the batch query."""

from helpers import DATA
from pyspark.sql import functions as F

from pathloom.sources import graphs as G
from pathloom.streaming.sequences import follow, sequences


def test_follow_carries_the_wait():
    waiting, found = follow(None, [(1, "a"), (2, "x"), (3, "a")], "a", "b", ["c"])
    assert (waiting, found) == (3, [])
    assert follow(waiting, [(4, "b"), (5, "b"), (6, "a"), (7, "c"), (8, "b")], "a", "b", ["c"]) == (None, [(3, 4)])


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("user_id").alias("graph_id"), F.col("event_id").alias("node_id"), F.col("event_type").alias("label"), F.col("ts").cast("timestamp").alias("at"))
    third = e.approxQuantile("node_id", [0.5], 0)[0]
    for k, part in enumerate((e.where(F.col("node_id") < third), e.where(F.col("node_id") >= third))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/part{k}"))
    by_time = sorted(e.collect(), key=lambda r: (r.graph_id, r["at"], r.node_id))
    ordered = [r.node_id for r in by_time] == [r.node_id for r in sorted(e.collect(), key=lambda r: (r.graph_id, r.node_id))]
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1 if ordered else 2).parquet(str(tmp_path / "in/*"))
    q = sequences(source, "error", "purchase", ["signup"]).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    found = {(r.graph_id, r.begin) for r in spark.table("found").collect()}
    from pathloom.queries.algebra import flagship

    assert G and found == {(r.graph_id, r.state) for r in flagship(spark, DATA).collect()}
