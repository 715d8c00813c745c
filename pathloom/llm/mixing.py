"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and max_times, as near to 1 as it can be (in relative entropy, each document counting
once), while each source's words meet the source's target. The constraints count words, so the dual, which is convex with one
multiplier for each source, gives rates exp(multiplier * size): documents are tilted exponentially by their size, and those at
max_times stay there. Newton steps on the dual run for all sources at once; gradient and curvature of each step are sums over
all documents, added up first for documents of one source and size. A step that leaves the bracket of the root found so far
is halved instead.

Rates become copies by systematic rounding along each source's documents ordered by size: at any point of that order the
copies differ from the summed rates by less than one document, so a source's words miss its target by less than the size of
its largest document.

Targets: sources weigh 1, 2, 3, 1, ... by code point (null last) and share all words by weight; none goes above max_times its
own words, and the excess is shared again by weight.

Defined results: a null text has size 0; documents without words take nothing; a null source is a source of its own, the last;
repeated rows are documents of their own; ties in size go by doc_id; texts of any length are counted whole; an empty table gives no
rows; extra columns are ignored by `mix` and kept by `mixed`, whose helper columns take names that the caller's leave free. Reruns
agree: sums are added up as decimals, so their order doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_names, numbered, stored, table

MAX_TIMES, STEPS = 3, 100
#: Where rounding begins; no sum of like rates comes out at a whole number plus this.
PHASE = 0.3819660112501051


def targets(sources: DataFrame, max_times: int = MAX_TIMES) -> DataFrame:
    """sources: weight, source_size. Adds target; each round adds up one row on the driver."""
    cap = F.col("source_size") * max_times
    level, frozen = None, -1
    total = sources.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    while True:
        above = F.lit(False) if level is None else F.lit(level) * F.col("weight") > cap
        r = sources.agg(F.sum(F.when(above, cap)).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("weights"), F.count(F.when(above, 1)).alias("n")).first()
        if r["n"] == frozen or not r["weights"]:
            break
        frozen, level = r["n"], (total - (r["held"] or 0)) / r["weights"]
    level = level or 0.0
    share = F.lit(float(level)) * F.col("weight")
    return sources.withColumn("target", F.when(share > cap, cap.cast("double")).otherwise(share))


def tilt(x: Column, z: Column, max_times: int) -> Column:
    """The rate of a document of relative size z."""
    return F.least(F.lit(float(max_times)), F.exp(F.least(x * z, F.lit(4.0))))


def multipliers(sizes: DataFrame, sources: DataFrame, max_times: int = MAX_TIMES, steps: int = STEPS) -> DataFrame:
    """sizes: source_no, size, n (documents of that size); sources: source_no, mean (size), target, source_size. source_no and x:
    rates exp(x * size / mean), at most max_times, make the source's words its target. Null where no finite x does: all is taken max_times, or nothing is there.
    """
    free = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * max_times)
    nowhere = F.lit(None).cast("double")
    now = sources.select("source_no", "mean", "target", F.when(free, F.lit(0.0)).alias("x"), nowhere.alias("low"), nowhere.alias("high"), (~free).alias("done"))
    now = stored(now, "newton")
    z = F.col("size") / F.col("mean")
    rate = tilt(F.col("x"), z, max_times)
    exact = lambda c: F.sum(F.round(c, 9).cast("decimal(38,9)")).cast("double")
    words = F.col("n") * F.col("size") * rate
    for _ in range(steps):
        open_ = now.where("not done")
        sums = sizes.select("source_no", "size", "n").join(open_.select("source_no", "mean", "x"), "source_no").groupBy("source_no").agg(exact(words).alias("taken"), exact(F.when(rate < max_times, words * z).otherwise(0.0)).alias("slope"))
        at = now.join(sums, "source_no", "left")
        low = F.when(F.col("taken") < F.col("target"), F.col("x")).otherwise(F.col("low"))
        high = F.when(F.col("taken") > F.col("target"), F.col("x")).otherwise(F.col("high"))
        at = at.select("source_no", "mean", "target", "x", low.alias("low"), high.alias("high"), "done", "taken", "slope")
        newton = F.when((F.col("slope") > 0) & (F.col("taken") > 0), F.col("x") - F.ln(F.col("taken") / F.col("target")) * F.col("taken") / F.col("slope"))
        inside = (newton > F.coalesce("low", F.lit(float("-inf")))) & (newton < F.coalesce("high", F.lit(float("inf"))))
        halved = F.when(F.col("low").isNull(), F.col("high") * 2 - 1 - F.abs("high")).when(F.col("high").isNull(), F.col("low") * 2 + 1 + F.abs("low")).otherwise((F.col("low") + F.col("high")) / 2)
        new = F.when(F.col("taken") == F.col("target"), F.col("x")).when(F.coalesce(inside, F.lit(False)), newton).otherwise(halved)
        still = F.col("done") | (F.abs(new - F.col("x")) <= F.lit(1e-12) * (F.abs("x") + 1))
        now = stored(at.select("source_no", "mean", "target", F.when(F.col("done"), F.col("x")).otherwise(new).alias("x"), "low", "high", still.alias("done")), "newton")
        if now.where("not done").isEmpty():
            break
    return now.select("source_no", "x")


def rates(sized: DataFrame, max_times: int = MAX_TIMES) -> DataFrame:
    """sized: source, size. One row for each source and size: source, source_no, size, n, source_size, target, rate and before (the rates of all smaller documents of the source)."""
    sizes = stored(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    sums = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs")).withColumn("last", F.col("source").isNull().cast("int"))
    ranked = numbered(sums, ["last", "source"], rank="source_no", name="sources").drop("last")
    sources = targets(stored(ranked.withColumn("weight", (F.col("source_no") % 3 + 1).cast("long")), "weights"), max_times)
    sources = stored(sources.withColumn("mean", F.col("source_size") / F.col("docs")).withColumnRenamed("source", "_source"), "targets")
    sizes = sizes.join(sources, sizes["source"].eqNullSafe(sources["_source"])).drop("_source", "docs", "weight")
    sizes = stored(sizes, "sizes-by-source")
    solved = multipliers(sizes, sources, max_times)
    limit = F.when(F.col("target") > 0, F.lit(float(max_times))).otherwise(F.lit(0.0))
    rate = F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.coalesce(tilt(F.col("x"), F.col("size") / F.col("mean"), max_times), limit))
    rated = sizes.join(solved, "source_no").withColumn("rate", rate)
    smaller = Window.partitionBy("source_no").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)  # a row for each size of a source
    return rated.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(smaller), F.lit(0.0))).select("source", "source_no", "size", "n", "source_size", "target", "rate", "before")


def copies(sized: DataFrame, max_times: int = MAX_TIMES) -> DataFrame:
    """sized: doc_id, k1, k2, source, size. Adds source_size, target and copies."""
    by = stored(rates(sized, max_times), "rates").withColumnRenamed("source", "_source").withColumnRenamed("size", "_size").drop("n")
    joined = sized.join(by, sized["source"].eqNullSafe(by["_source"]) & (sized["size"] == by["_size"])).drop("_source", "_size")
    rows = numbered(joined, ["doc_id", "k1", "k2"], ["source_no", "size"], name="mix-ranks")
    upto = lambda r: F.floor(F.col("before") + r * F.col("rate") + PHASE)
    return rows.withColumn("copies", F.least(F.lit(max_times), upto(F.col("rank") + 1) - upto(F.col("rank"))).cast("long"))


def doc_keys() -> list[Column]:
    doc, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    return [F.xxhash64(doc, text), F.xxhash64(F.lit(1), text, doc)]


def _sized(docs: DataFrame) -> DataFrame:
    k1, k2 = doc_keys()
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), k1.alias("k1"), k2.alias("k2"), size.alias("size"))


def mix(docs: DataFrame, max_times: int = MAX_TIMES) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies."""
    rows = copies(stored(_sized(docs), "sizes"), max_times)
    return rows.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def mixed(docs: DataFrame, max_times: int = MAX_TIMES) -> DataFrame:
    """The rows of docs as often as the mix takes them. Rows that are equal in doc_id, text and source share their copies one by one."""
    source, k1, k2, times, list_, nth, copy = free_names(docs, "_source", "_k1", "_k2", "_times", "_list", "_nth", "_copy")
    taken = copies(stored(_sized(docs), "sizes"), max_times)
    taken = taken.groupBy("source", "k1", "k2").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies"))
    taken = stored(taken.where("copies > 0").select(F.col("source").alias(source), F.col("k1").alias(k1), F.col("k2").alias(k2), "rows", "copies"), "taken")
    hashes = doc_keys()
    marked = docs.withColumns({source: F.col("source").cast("string"), k1: hashes[0], k2: hashes[1]})

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.select(F.col(source).alias(f"{source}r"), F.col(k1).alias(f"{k1}r"), F.col(k2).alias(f"{k2}r"), *[c for c in right.columns if c not in (source, k1, k2)])
        return left.join(right, (F.col(k1) == F.col(f"{k1}r")) & (F.col(k2) == F.col(f"{k2}r")) & F.col(source).eqNullSafe(F.col(f"{source}r")))

    out = joined(marked, taken.where("rows = 1").select(source, k1, k2, F.col("copies").alias(times)))
    several = taken.where("rows > 1")
    if not several.isEmpty():
        # The copies of rows that are alike are dealt to them in turn.
        among = Window.partitionBy(source, k1, k2).orderBy(k1)
        again = joined(marked, several.select(source, k1, k2, F.col("rows").alias(list_), F.col("copies").alias(times))).withColumn(nth, F.row_number().over(among) - 1)
        share = F.floor(F.col(times) / F.col(list_)) + (F.col(nth) < F.pmod(F.col(times), F.col(list_))).cast("long")
        again = again.withColumn(times, share.cast("long")).where(F.col(times) > 0).drop(list_, nth)
        out = out.unionByName(again)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*[F.col(f"`{n}`") for n in docs.columns])


def op10_mix(spark, sf_dir: str) -> DataFrame:
    """Mixes all documents."""
    return mix(table(spark, sf_dir, "documents"))


#: The multipliers are found by halving.
OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM d GROUP BY source
), o AS (
  SELECT *, 3 * source_size / weight AS ratio FROM s
), c AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(3 * source_size) OVER w, 0) AS held, coalesce(sum(weight) OVER w, 0) AS held_weights, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS k
  FROM o WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT coalesce(max(level), 0.0) AS level FROM (SELECT (total - held) / (weights - held_weights) AS level, ratio, k FROM c ORDER BY k) WHERE level <= ratio AND k = (SELECT min(k) FROM (SELECT (total - held) / (weights - held_weights) AS level, ratio, k FROM c) WHERE level <= ratio)
), t AS (
  SELECT source, source_size, CASE WHEN level * weight > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(level AS DOUBLE) * weight END AS target FROM s, l
), h AS (
  SELECT t.source, d.size, count(*) AS n, any_value(t.target) AS target, any_value(t.source_size) AS source_size
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY t.source, d.size
), m AS (
  SELECT source, any_value(target) AS target, any_value(source_size) AS source_size, any_value(source_size) / CAST(sum(n) AS BIGINT) AS mean FROM h GROUP BY source
), it AS (
  SELECT 0 AS step, source, target, mean, CAST(-4096 AS DOUBLE) AS low, CAST(4096 AS DOUBLE) AS high FROM m WHERE target > 0 AND target < 3 * source_size
  UNION ALL
  SELECT step + 1, source, target, mean, CASE WHEN taken < target THEN mid ELSE low END, CASE WHEN taken < target THEN high ELSE mid END FROM (
    SELECT step, it.source, it.target, mean, low, high, (low + high) / 2 AS mid, sum(n * size * least(3, exp(least((low + high) / 2 * (size / mean), 4)))) AS taken
    FROM it JOIN h ON h.source IS NOT DISTINCT FROM it.source WHERE step < 70 GROUP BY step, it.source, it.target, mean, low, high)
), x AS (
  SELECT source, (low + high) / 2 AS x FROM it WHERE step = 70
), q AS (
  SELECT h.source, h.size, n, h.target, h.source_size, CASE WHEN h.size = 0 THEN 0.0 WHEN x IS NULL THEN CASE WHEN h.target > 0 THEN 3.0 ELSE 0.0 END ELSE least(3, exp(least(x * (h.size / mean), 4))) END AS rate
  FROM h JOIN m ON h.source IS NOT DISTINCT FROM m.source LEFT JOIN x ON h.source IS NOT DISTINCT FROM x.source
), b AS (
  SELECT *, coalesce(sum(n * rate) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before FROM q
), r AS (
  SELECT doc_id, d.size, source_size, target, rate, before, row_number() OVER (PARTITION BY d.source, d.size ORDER BY doc_id) - 1 AS k
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source AND d.size = b.size
), n AS (
  SELECT *, CAST(least(3, floor(before + (k + 1) * rate + 0.3819660112501051) - floor(before + k * rate + 0.3819660112501051)) AS BIGINT) AS copies FROM r
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies FROM n
"""
