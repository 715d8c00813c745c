"""Results as text: reports, XML, diffs, matched lines, graphs in dot, files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report(file: Column, line: Column, column: Column, message: Column) -> Column:
    return F.format_string("%s:%d:%d: %s", file, line.cast("long"), column.cast("long"), message)


def org_link(file: Column, line: Column, column: Column, message: Column) -> Column:
    """A todo entry with a link that opens the place."""
    return F.format_string("* TODO [[view:%s::face=ovl-face1::linb=%d::colb=%d][%s]]", file, line.cast("long"), column.cast("long"), message)


def escaped(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def xml_issue(file: Column, line: Column, column: Column, message: Column) -> Column:
    return F.concat(F.lit('<issue><message>'), escaped(message), F.lit('</message><location><file given-path="'), escaped(file), F.lit('"/><point line="'), line.cast("string"), F.lit('" column="'), column.cast("string"), F.lit('"/></location></issue>'))


def dot(edges: DataFrame) -> DataFrame:
    """graph_id and the graph in dot, edges sorted."""
    one = F.format_string('"%s" -> "%s";', F.col("src").cast("string"), F.col("dst").cast("string"))
    return edges.groupBy("graph_id").agg(F.concat(F.lit("digraph {\n"), F.array_join(F.array_sort(F.collect_set(one)), "\n"), F.lit("\n}")).alias("dot"))


def diffs(pairs: DataFrame, prefix: str = "") -> DataFrame:
    """pairs: file, before, after. A unified diff for each file that changed."""

    def run(frames: Iterator) -> Iterator:
        import difflib

        import pandas as pd

        for pdf in frames:
            out = ["".join(difflib.unified_diff(b.splitlines(True), a.splitlines(True), f"a/{prefix}{f}", f"b/{prefix}{f}")) for f, b, a in zip(pdf["file"], pdf["before"], pdf["after"])]
            yield pd.DataFrame({"file": pdf["file"], "diff": out})

    return pairs.where("before <> after").select("file", "before", "after").mapInPandas(run, "file string, diff string")


def matched_lines(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """texts: file, text; spans: file, line (from 1). The matched lines with a minus sign."""
    lines = texts.select("file", F.posexplode(F.split("text", "\n")).alias("n", "value")).withColumn("line", F.col("n") + 1)
    return lines.join(spans.select("file", "line").distinct(), ["file", "line"]).select("file", "line", F.concat(F.lit("-"), F.col("value")).alias("text"))


def agreed(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """results: file, text. Files whose results are all equal, and the names of the others, which are dropped with a warning."""
    sums = results.groupBy("file").agg(F.countDistinct(F.xxhash64("text"), F.length("text")).alias("n"), F.min("text").alias("text"))
    return sums.where("n = 1").select("file", "text"), sums.where("n > 1").select("file")


def written(results: DataFrame, path: str) -> DataFrame:
    """Writes file and text below path as a table of texts, and reads it again."""
    results.select("file", "text").write.mode("overwrite").parquet(path)
    return results.sparkSession.read.parquet(path)
