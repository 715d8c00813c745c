"""Rules on documents and on their hosts.

A document fails the base rules if it has few words or if repeated five-word windows cover much of it. Failures are then
counted by host (the `source` column), each host's rate is shrunk by a beta prior fitted to all hosts by the method of
moments, and the verdict on the host is joined back: documents of a host whose shrunk rate is above the limit go.

Defined results: a null text has no words and fails; a null source is a host of its own; repeated rows count as often as they
occur; one host may hold most rows (counts are added up before they are shuffled); an empty table gives no rows; extra columns
are ignored by `judge` and kept by `accepted`; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, slices, stored, table, trimming

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    max_host_rate: float = 0.5


def measures(text: str, window: int = 5) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, and words in windows that occur twice or more."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at these six spaces exactly
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(data.count(c.encode()) for c in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeat = 0
    if n > window and len(set(words)) < n:
        windows = list(zip(*[words[k:] for k in range(window)]))
        if len(set(windows)) < len(windows):
            first: dict[tuple, int] = {}
            covered = bytearray(n)
            for i, w in enumerate(windows):
                j = first.setdefault(w, i)
                if j < i:
                    covered[j : j + window] = covered[i : i + window] = b"\1" * window
            repeat = sum(covered)
    return n, chars, symbols, len(lines) - len(set(lines)), repeat


def _failed(n, repeat, rules: Rules):
    return (n < rules.min_words) | (repeat * 100 > n * rules.max_repeat_percent)


def measured(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    window = rules.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [measures(t, window) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([r[k] for r in rows], type=pa.int64()) for k in range(5)]], names=["doc_id", "source", *NAMES])

    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return lean.mapInArrow(trimming(run), "doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def host_verdicts(hosts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """hosts: source, n, f (documents and failures). Adds rate and host_failed.

    The prior's mean is the share of all failures; its strength comes from the variance between hosts beyond what chance
    gives hosts of their size. Only five sums reach the driver.
    """
    p = F.col("f") / F.col("n")
    sums = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum(F.col("n") * p * p).alias("q")).first()
    k, n, f, q = sums["k"], sums["n"] or 0, sums["f"] or 0, sums["q"] or 0.0
    mean = f / n if n else 0.0
    chance = mean * (1 - mean)
    between = (q / n - mean * mean - chance * k / n) if n else 0.0
    strength = min(1e6, max(1.0, chance / between - 1)) if between > 0 else 1e6 if k > 1 else 1.0
    rate = (F.col("f") + mean * strength) / (F.col("n") + strength)
    return hosts.withColumn("rate", rate).withColumn("host_failed", F.col("rate") > rules.max_host_rate)


def _by_host(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f"))


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the five measures, base_failed, kept, host_docs, host_failures."""
    rows = measured(docs, rules)
    rows = stored(rows.withColumn("base_failed", _failed(F.col("n_words"), F.col("n_repeat_words"), rules)), "quality")
    hosts = host_verdicts(_by_host(rows), rules).select(F.col("source").alias("host"), "host_failed", F.col("n").alias("host_docs"), F.col("f").alias("host_failures"))
    joined = rows.join(hosts, F.col("source").eqNullSafe(F.col("host")))
    return joined.select("doc_id", *NAMES, "base_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), "host_docs", "host_failures")


def accepted(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that pass, with all their columns: rules are measured once for the hosts and once for the documents."""
    (host,) = free_names(docs, "_bad_host")
    rows = measured(docs, rules).select("source", _failed(F.col("n_words"), F.col("n_repeat_words"), rules).alias("base_failed"))
    bad = stored(host_verdicts(stored(_by_host(rows), "hosts"), rules).where("host_failed").select(F.col("source").alias(host)), "bad-hosts")
    window = rules.window

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at = b.schema.get_field_index("text")
            keep = []
            for t in b.column(at).to_pylist():
                n, _, _, _, repeat = measures(t or "", window)
                keep.append(not _failed(n, repeat, rules))
            yield b.filter(pa.array(keep, type=pa.bool_()))

    good = docs.mapInArrow(trimming(passes), docs.schema)
    return good.join(bad, good["source"].cast("string").eqNullSafe(bad[host]), "left_anti")


def op6_host_rules(spark, sf_dir: str) -> DataFrame:
    """Rules for all documents and hosts."""
    return judge(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), counted AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM counted WHERE c > 1) GROUP BY doc_id
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN dup USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b GROUP BY source
), s AS (
  SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS nn, sum(f) / sum(n) AS mean, sum(n * (f / n) * (f / n)) AS q FROM h
), v AS (
  SELECT k, nn, mean, mean * (1 - mean) AS chance, q / nn - mean * mean - mean * (1 - mean) * k / nn AS between_hosts FROM s
), p AS (
  SELECT mean, CASE WHEN between_hosts > 0 THEN least(1e6, greatest(1.0, chance / between_hosts - 1)) WHEN k > 1 THEN 1e6 ELSE 1.0 END AS strength FROM v
), r AS (
  SELECT source, n, f, (f + mean * strength) / (n + strength) > 0.5 AS host_failed FROM h, p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept,
  CAST(n AS BIGINT) AS host_docs, CAST(f AS BIGINT) AS host_failures
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""
