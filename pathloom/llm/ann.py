"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

Shards are searched in waves of 1, 4, 16, ... shards. A task builds its shard's tree once and reads the queries block by block
from the shared folder, each with the k-th best distance of the waves before as its bound; so only neighbours that may still
count leave a task, and the nearest so far are merged after each wave. At a node the distances of a block's queries to the
vantage point bound those to either side by the triangle inequality; a side is left out if its bound, times `factor`, is
above the query's k-th best distance so far. Factor 1 is exact; larger factors prune more.

Equal vectors of a shard are one point with the k + 1 least ids (more can't be among the k nearest). Distances are sums of squares
in the order of the components, in double precision, so that equal vectors have equal scores wherever they lie.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null
vec_id; vectors of different lengths are no neighbours of each other; rows that share the query's vec_id are its own; queries
equal in vec_id and vector are one, those of one vec_id and different vectors have a list each; rows of equal vec_id and
distance count once; ties go to the smaller vec_id; fewer candidates than k are all returned; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored, table
from .files import place

K, LEAF, BLOCK, WAVE = 10, 256, 4_096, 4
#: Vectors of a shard, at least and at most; small tables fall into some hundred shards.
LEAST, MOST = 4_096, 65_536


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each row of q to each row of x; squares are added in the order of the components."""
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        d = q[:, j, None] - x[None, :, j]
        out += d * d
    return np.sqrt(out)


class Tree:
    """Nodes: (vantage point, inner child, its least and greatest distance, outer child, its least and greatest distance), or leaves of rows."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 0):
        self.points, self.leaf = points, leaf
        self.rng = np.random.Generator(np.random.PCG64(seed))
        self.root = self._built(np.arange(len(points)))

    def _built(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        vantage = self.points[self.rng.choice(rows)]
        d = distances(vantage[None], self.points[rows])[0]
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        inner, outer = order[:half], order[half:]
        return (vantage, self._built(rows[inner]), d[inner[0]], d[inner[-1]], self._built(rows[outer]), d[outer[0]], d[outer[-1]])


class Search:
    """The k nearest of a block of queries among a tree's points, each of which stands for several ids."""

    def __init__(self, tree: Tree, ids: list[np.ndarray], queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float, bounds: np.ndarray | None = None):
        self.tree, self.queries, self.query_ids, self.k, self.factor = tree, queries, query_ids, k, factor
        self.id_of = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        self.best = np.full((len(queries), k), np.inf)
        self.near = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.bounds = np.full(len(queries), np.inf) if bounds is None else bounds
        self.seen = 0  # distances computed to points of leaves

    def run(self) -> None:
        if len(self.queries) and len(self.tree.points):
            self._visit(self.tree.root, np.arange(len(self.queries)))

    def _visit(self, node, qs: np.ndarray) -> None:
        if not len(qs):
            return
        if isinstance(node, np.ndarray):
            for a in range(0, len(qs), 1024):
                self._leaf(node, qs[a : a + 1024])
            return
        vantage, inner, low_in, high_in, outer, low_out, high_out = node
        d = distances(self.queries[qs], vantage[None])[:, 0]
        to_inner = np.maximum(np.maximum(d - high_in, low_in - d), 0)
        to_outer = np.maximum(np.maximum(d - high_out, low_out - d), 0)
        nearer = to_inner <= to_outer
        sides = ((inner, to_inner), (outer, to_outer))
        for first, (near, far) in ((nearer, sides), (~nearer, sides[::-1])):
            mine = np.flatnonzero(first)
            self._some(near, qs[mine], near[1][mine])
            self._some(far, qs[mine], far[1][mine])

    def _some(self, side: tuple, qs: np.ndarray, bounds: np.ndarray) -> None:
        slack = bounds * (1 - 1e-12)  # a bound is a difference of rounded distances
        self._visit(side[0], qs[slack * self.factor <= np.minimum(self.best[qs, -1], self.bounds[qs])])

    def _leaf(self, rows: np.ndarray, qs: np.ndarray) -> None:
        d = distances(self.queries[qs], self.tree.points[rows])
        self.seen += d.size
        counts = self.first[rows + 1] - self.first[rows]
        at = np.repeat(np.arange(len(rows)), counts)
        inside = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        ids = self.id_of[self.first[rows][at] + inside]
        all_d = np.concatenate([self.best[qs], d[:, at]], axis=1)
        all_ids = np.concatenate([self.near[qs], np.broadcast_to(ids, (len(qs), len(ids)))], axis=1)
        all_d[:, self.k :][ids[None, :] == self.query_ids[qs][:, None]] = np.inf
        order = np.lexsort((all_ids, all_d), axis=1)[:, : self.k]
        self.best[qs] = np.take_along_axis(all_d, order, axis=1)
        self.near[qs] = np.where(np.isinf(self.best[qs]), np.iinfo(np.int64).max, np.take_along_axis(all_ids, order, axis=1))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) and dim of the vectors that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows (shard, dim, vec_id, v) sorted by shard and dim: the vectors and ids of each shard and dim, equal rows once."""
    now, rows = None, {}
    for b in batches:
        values, at = b.column(3).values.to_numpy(), b.column(3).offsets.to_numpy()
        for key, i, low, high in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(2).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
            if key != now:
                if rows:
                    yield _arrays(rows)
                now, rows = key, {}
            v = values[low:high] + 0.0
            rows[(i, v.tobytes())] = v
    if rows:
        yield _arrays(rows)


def _arrays(rows: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.array(list(rows.values())), np.array([i for i, _ in rows], dtype=np.int64)


def blocks_of(path: str, block: int) -> Iterator[pa.RecordBatch]:
    """The rows of the parquet files below path, block by block."""
    fs, folder = place(path)
    for info in sorted(fs.get_file_info(pafs.FileSelector(folder)), key=lambda x: x.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(block)


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = K, factor: float = 1.0, leaf: int = LEAF, shard: int | None = None, block: int = BLOCK) -> DataFrame:
    """vectors, queries: vec_id, embedding. query_id, rank (from 1), vec_id, score of each query's k nearest vectors."""
    spark = vectors.sparkSession
    points = usable(vectors)
    asked = usable(queries).dropDuplicates(["vec_id", "v"]).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("qkey"), F.col("v").alias("q"))
    asked = stored(asked, "queries")
    n_points = vectors.count()
    shard = shard or min(MOST, max(LEAST, n_points // 256))
    shards, blocks = max(1, -(-n_points // shard)), max(1, -(-asked.count() // block))
    number = F.pmod(F.xxhash64(F.lit(11), "vec_id", "v"), F.lit(shards)).cast("int")
    dealt = points.select(number.alias("shard"), "dim", "vec_id", "v")
    row = "query_id long, qkey long, vec_id long, score double"
    best: DataFrame = spark.createDataFrame([], row)
    first, last = 0, 1
    while first < shards:
        bounds = best.groupBy("query_id", "qkey").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("bound")).where(F.col("n") == k).drop("n")
        path = scratch(spark, "query-blocks")
        asked.join(bounds, ["query_id", "qkey"], "left").select("query_id", "qkey", "q", F.coalesce("bound", F.lit(float("inf"))).alias("bound")).repartition(blocks).write.parquet(path)

        def search(batches: Iterator[pa.RecordBatch], path: str = path) -> Iterator[pa.RecordBatch]:
            for x, ids in shards_of(batches):
                order = np.lexsort((ids, *x.T[::-1]))
                x, ids = x[order], ids[order]
                new = np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])
                starts = np.flatnonzero(new)
                groups = [g[: k + 1] for g in map(np.unique, np.split(ids, starts[1:]))]
                tree = Tree(x[starts], leaf)
                for b in blocks_of(path, block):
                    own = np.flatnonzero(np.diff(b.column(2).offsets.to_numpy()) == x.shape[1])
                    if not len(own):
                        continue
                    b = b.take(pa.array(own))
                    q = b.column(2).flatten().to_numpy().reshape(len(own), -1) + 0.0
                    qids, qkeys, bound = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy()
                    s = Search(tree, groups, q, qids, k, factor, bound)
                    s.run()
                    found = np.isfinite(s.best) & (s.best <= bound[:, None])
                    n = found.sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(np.repeat(qkeys, n)), pa.array(s.near[found]), pa.array(s.best[found])], names=["query_id", "qkey", "vec_id", "score"])

        part = dealt.where((F.col("shard") >= first) & (F.col("shard") < last)).repartition(min(last, shards) - first, "shard").sortWithinPartitions("shard", "dim")
        order = Window.partitionBy("query_id", "qkey").orderBy("score", "vec_id")  # at most k rows of each shard of a wave
        both = part.mapInArrow(search, row).union(best).dropDuplicates(["query_id", "qkey", "vec_id", "score"])
        best = stored(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "nearest")
        first, last = last, last * (WAVE + 1)
    order = Window.partitionBy("query_id", "qkey").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")


def op4_vantage_points(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector, exactly (factor 1)."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


OP4_SQL = r"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), u AS (
  SELECT vec_id, v FROM v WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, q.v AS q, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
  FROM u q JOIN u c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id, q ORDER BY score, vec_id) AS INTEGER) AS rank FROM (SELECT DISTINCT * FROM p)
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
