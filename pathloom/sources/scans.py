"""Scans of files and groups, prefilters that decide which files are worth a look, and repairs of graphs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relation import Graph


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length: a walk through a folder. Contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select("path", "length")


def tables(spark: SparkSession, path: str, suffix: str = ".parquet") -> DataFrame:
    """name: of each table in a folder, be it one file or a folder of files. Files below are no tables of their own."""
    root = re.sub("/+", "/", re.sub(r"^\w[\w+.-]*:(//[^/]*)?", "", path) + "/")
    below = F.element_at(F.split("path", re.escape(root), 2), 2)
    return files(spark, path).select(F.substring_index(below, "/", 1).alias("name")).where(F.col("name").endswith(suffix)).distinct()


def texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def groups(lists: DataFrame) -> DataFrame:
    """lists: id, text. Blank lines part groups; a line is a file, with line ranges after a colon: `lo-hi`, a line alone, and a
    minus sign before those left out. One row for each range: id, grp, path, lo, hi, included (nulls where a file has none)."""
    parts = lists.select("id", F.posexplode(F.split(F.regexp_replace("text", r"\s+$", ""), r"\n[ \t]*\n\s*")).alias("grp", "block"))
    lines = parts.select("id", "grp", F.explode(F.split("block", "\n")).alias("line")).withColumn("line", F.trim("line")).where("line <> ''")
    named = lines.select("id", "grp", F.regexp_extract("line", r"^([^:]*)", 1).alias("path"), F.regexp_extract("line", r"^[^:]*:(.*)$", 1).alias("spec"))
    one = named.select("id", "grp", "path", F.explode_outer(F.when(F.col("spec") != "", F.split("spec", ","))).alias("r")).withColumn("r", F.trim("r"))
    bound = lambda k: F.regexp_extract("r", r"^-?(\d+)(?:-(\d+))?$", k).try_cast("int")
    return one.select("id", "grp", "path", bound(1).alias("lo"), F.coalesce(bound(2), bound(1)).alias("hi"), (~F.col("r").startswith("-")).alias("included"))


def built(paths: DataFrame, objects: DataFrame) -> DataFrame:
    """paths: path; objects: path, build (which object a file is built into). Each file with its group; null where it is its own."""
    return paths.join(objects, "path", "left")


def ignored(members: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """members: grp, path. Groups go only if all their files match one of the patterns."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("path").rlike(p)
    gone = members.groupBy("grp").agg(F.every(hit).alias("all")).where("all").select("grp")
    return members.join(gone, "grp", "left_anti")


def sharded(members: DataFrame, index: int, most: int, block: bool = False) -> DataFrame:
    """Groups (numbered from 0 by grp_no) of one of `most` parts: every most-th, or a block of neighbours."""
    if not block:
        return members.where(F.pmod("grp_no", F.lit(most)) == index)
    n = members.agg((F.max("grp_no") + 1).alias("n")).first()["n"] or 0
    size = -(-n // most)
    return members.where((F.col("grp_no") >= index * size) & (F.col("grp_no") < (index + 1) * size))


def any_word(text: Column, words: Sequence[str]) -> Column:
    """One of the words, with no ASCII letter, digit or underscore beside it."""
    return text.rlike("(?<![A-Za-z0-9_])(?:" + "|".join(map(re.escape, words)) + ")(?![A-Za-z0-9_])")


def all_clauses(text: Column, clauses: Sequence[Sequence[str]]) -> Column:
    """A conjunction of clauses, of each of which some word must occur."""
    out = F.lit(True)
    for c in clauses:
        out = out & any_word(text, c)
    return out


def token_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """token, key: the inverted index that And/Or formulas of words are looked up in."""
    return docs.select(key, F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"))).alias("token")).where("token <> ''")


def lookup(index: DataFrame, key: str, formula) -> DataFrame:
    """formula: a word, ("and", ...) or ("or", ...). Keys of the files that fit it."""
    if isinstance(formula, str):
        return index.where(F.col("token") == formula).select(key)
    kind, *parts = formula
    out = lookup(index, key, parts[0])
    for p in parts[1:]:
        other = lookup(index, key, p)
        out = out.join(other, key, "left_semi") if kind == "and" else out.union(other).distinct()
    return out


def touched(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """lines: file, line. Those that a diff's changed ranges (file, lo, hi) hold; overlapping ranges count once."""
    w = Window.partitionBy("file").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    merged = changes.withColumn("_before", F.max("hi").over(w)).where(F.col("_before").isNull() | (F.col("hi") > F.col("_before"))).withColumn("lo", F.greatest("lo", F.coalesce(F.col("_before") + 1, F.col("lo"))))
    return lines.alias("l").join(merged.alias("c"), (F.col("l.file") == F.col("c.file")) & (F.col("line") >= F.col("lo")) & (F.col("line") <= F.col("hi")), "left_semi")


# Graphs
def closed(graph: Graph) -> Graph:
    """Every node without a successor leads to itself."""
    ends = graph.nodes.select("graph_id", F.col("node_id").alias("src")).join(graph.edges.select("graph_id", "src").distinct(), ["graph_id", "src"], "left_anti")
    loops = ends.select("graph_id", "src", F.col("src").alias("dst"), F.lit("Direct").alias("edge_kind"))
    return Graph(graph.nodes, graph.edges.select("graph_id", "src", "dst", "edge_kind").union(loops), graph.linear)


def orphans(graph: Graph, entries: Column) -> DataFrame:
    """Nodes that no other node leads to, but for entries: dead code."""
    led = graph.edges.where("src <> dst").select("graph_id", F.col("dst").alias("node_id")).distinct()
    return graph.nodes.where(~entries).join(led, ["graph_id", "node_id"], "left_anti").select("graph_id", "node_id")


def loop_entries(graph: Graph, entry: Column) -> DataFrame:
    """graph_id, node_id of the targets of back edges in a depth-first walk from each graph's entries, successors in order. Mark before
    closing the graph, or every end counts as a loop. Graphs are walked whole, one by one."""
    starts = graph.nodes.where(entry).select("graph_id", F.col("node_id").cast("string").alias("src"), F.lit(None).cast("string").alias("dst"))
    rows = graph.edges.select("graph_id", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).union(starts)
    kind = graph.nodes.schema["graph_id"].dataType.simpleString()

    def walk(pdf):
        import pandas as pd

        follow: dict = {}
        for s, t in zip(pdf["src"], pdf["dst"]):
            if t is not None:
                follow.setdefault(s, []).append(t)
        for s in follow:
            follow[s].sort()
        found, done = set(), set()
        for start in sorted(pdf["src"][pdf["dst"].isna()]):
            if start in done:
                continue
            path, stack = {start}, [(start, iter(follow.get(start, ())))]
            while stack:
                node, rest = stack[-1]
                nxt = next(rest, None)
                if nxt is None:
                    stack.pop()
                    path.discard(node)
                    done.add(node)
                elif nxt in path:
                    found.add(nxt)
                elif nxt not in done:
                    path.add(nxt)
                    stack.append((nxt, iter(follow.get(nxt, ()))))
        return pd.DataFrame({"graph_id": [pdf["graph_id"].iloc[0]] * len(found), "node_id": sorted(found)})

    return rows.groupBy("graph_id").applyInPandas(walk, f"graph_id {kind}, node_id string")
