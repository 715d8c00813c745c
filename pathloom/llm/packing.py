"""Packing documents into sequences of a fixed window, by non-negative least squares over the histogram of remainders.

Each document is cut into full windows, which are sequences of their own, and a remainder. For the remainders' histogram all
combinations of at most `depth` lengths that fill the window exactly are enumerated, their repeat counts are solved as a
non-negative least squares problem (accelerated projected gradient), rounded at random (to the whole number above with the
probability of the fraction; seeded, so that reruns agree) and clipped to what the histogram holds. That is repeated for what
is left while it places much. The residuals are packed greedily, longest first, each with the longest others that fill its
window exactly. Only lengths without such partners are cut: they follow each other as one stream that is cut at the window,
so only its last sequence is padded. Only the histogram (window - 1 counts) reaches the driver; each remainder finds its place
from its rank among the remainders of its length, which is numbered without a hot task, by a search in the sorted bounds of
the plan.

Sequences are padded to the window, except where their length is a power of two.

Defined results: a null text is empty and has the end id only; repeated rows and repeated doc_ids are packed as often as they
occur; an empty table gives no rows; extra columns are ignored; texts of any length are encoded whole, some megabytes at a time.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, slices, stored, table, trimming
from .encode import encoder, vocabulary_path

WINDOW, DEPTH = 1024, 3


def combinations(window: int, depth: int) -> np.ndarray:
    """Rows of `depth` lengths, descending and padded by 0, that add up to window: all with 2 to depth parts below the window."""
    found = []
    for parts in range(2, depth + 1):
        lead = np.array(list(itertools.combinations_with_replacement(range(1, window), parts - 2)), dtype=np.int64).reshape(-1, parts - 2) if parts > 2 else np.zeros((1, 0), dtype=np.int64)
        for row in lead:
            low = int(row[-1]) if len(row) else 1
            rest = window - int(row.sum())
            a = np.arange(low, rest // 2 + 1, dtype=np.int64)
            if len(a):
                full = np.zeros((len(a), depth), dtype=np.int64)
                full[:, 0], full[:, 1] = rest - a, a
                full[:, 2 : 2 + len(row)] = row[::-1]
                found.append(full)
    return np.concatenate(found) if found else np.zeros((0, depth), dtype=np.int64)


def solve(rows: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that makes |A x - histogram| small, where column s of A counts the lengths of rows[s]."""
    n = len(histogram)
    x = np.zeros(len(rows))
    if not len(rows) or not histogram.any():
        return x

    def times(v: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        for k in range(rows.shape[1]):
            out += np.bincount(rows[:, k], weights=v, minlength=n)
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return sum(r[rows[:, k]] for k in range(rows.shape[1]))

    v = np.ones(len(rows))
    for _ in range(12):  # the largest eigenvalue of A'A, for the step
        v = back(times(v))
        v /= np.linalg.norm(v) or 1
    step = 0.9 / max(1e-12, float(v @ back(times(v))))
    y, t = x.copy(), 1.0
    for _ in range(steps):
        r = times(y) - histogram
        new = np.maximum(0, y - step * back(r))
        ahead = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / ahead * (new - x)
        x, t = new, ahead
    return x


@dataclass
class Plan:
    """Of each placed run of remainders: its length, the ranks it holds (from low, below high), its first sequence and offset there."""

    window: int
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    solved: int = 0
    greedy: int = 0

    def use(self, parts: list[int], times: int, left: list[int], taken: list[int]) -> None:
        """Places `times` sequences of these lengths."""
        offset = 0
        for length in parts:
            self.runs.append((length, taken[length], taken[length] + times, self.sequences, offset))
            taken[length] += times
            left[length] -= times
            offset += length
        self.sequences += times


def most(parts: list[int], left: list[int]) -> int:
    """How often these lengths are all there."""
    return min(left[n] // parts.count(n) for n in parts)


def completion(gap: int, left: list[int], parts: int) -> list[int] | None:
    """At most `parts` lengths, the longest first, that fill the gap exactly."""
    if gap < len(left) and left[gap] > 0:
        return [gap]
    if parts < 2:
        return None
    tries = 0
    for length in range(min(gap, len(left)) - 1, 0, -1):
        if left[length] > 0 and (parts > 2 or length * 2 >= gap):
            left[length] -= 1
            rest = completion(gap - length, left, parts - 1)
            left[length] += 1
            if rest:
                return [length, *rest]
            tries += 1
            if parts > 2 and tries == 24:
                return None
    return None


def plan(histogram: np.ndarray, window: int = WINDOW, depth: int = DEPTH, rounds: int = 6) -> tuple[Plan, np.ndarray]:
    """How the remainders counted in histogram are placed, and how many of each length are left."""
    rows, rng = combinations(window, depth), np.random.Generator(np.random.PCG64(7))
    out, left, taken, total = Plan(window), histogram.astype(np.int64).tolist(), [0] * len(histogram), int(histogram.sum())
    for k in range(rounds):
        now = np.array(left)
        there = rows[((now[rows] > 0) | (rows == 0)).all(axis=1)]
        if not len(there):
            break
        x = solve(there, now, 400 if k == 0 else 120)
        want = np.floor(x + rng.random(len(x))).astype(np.int64)
        order = np.argsort(-x, kind="stable")
        before = out.solved
        for s in order[want[order] > 0].tolist():
            parts = [n for n in there[s].tolist() if n]
            times = min(int(want[s]), most(parts, left))
            if times > 0:
                out.use(parts, times, left, taken)
                out.solved += times * len(parts)
        if out.solved - before < total // 50:
            break
    for length in range(window - 1, 0, -1):
        while left[length] > 0:
            left[length] -= 1
            rest = completion(window - length, left, 3)
            left[length] += 1
            if not rest:
                break
            parts = [length, *rest]
            times = most(parts, left)
            out.use(parts, times, left, taken)
            out.greedy += times * len(parts)
    return out, np.array(left, dtype=np.int64)


def encoded(docs: DataFrame, *, window: int, vocabulary: str, end_id: int) -> DataFrame:
    """For each row: key, doc_id, doc_tokens, crcs of its full windows, rest (length of the remainder), rest_crc and rest_ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, enc = TaskContext.get().partitionId() << 40, encoder(vocabulary).encode_column
        end = np.array([end_id], dtype="<u4")
        for b in slices(batches, 4000):
            out = []
            for doc_id, ids in zip(b.column(0).to_pylist(), enc(b.column(1))):
                ids = np.concatenate([ids, end])
                full = len(ids) // window
                tail = ids[full * window :]
                narrow = tail.astype("<u2") if not (tail >> 16).any() else tail
                out.append((key, doc_id, len(ids), [zlib.crc32(ids[a * window : (a + 1) * window]) for a in range(full)], full, len(tail), zlib.crc32(tail), narrow.tobytes()))
                key += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], type=t) for k, t in enumerate(kinds)], names=["key", "doc_id", "doc_tokens", "crcs", "full", "rest", "rest_crc", "rest_ids"])

    lean = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return lean.mapInArrow(trimming(encode), "key long, doc_id long, doc_tokens long, crcs array<long>, full long, rest long, rest_crc long, rest_ids binary")


def pack(docs: DataFrame, *, window: int = WINDOW, depth: int = DEPTH, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded (length of its sequence with padding).

    The driver's work depends on window and depth only: depth 3 has window * window / 12 combinations.
    """
    spark = docs.sparkSession
    rows = stored(encoded(docs, window=window, vocabulary=vocabulary or vocabulary_path(), end_id=end_id), "packed-ids")
    lean = numbered(rows.select("key", "doc_id", "doc_tokens", "crcs", "full", "rest", "rest_crc"), ["doc_id", "key"], ["rest"], sums={"full_before": "full"}, name="packed-ranks")
    counts = rows.groupBy("rest").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")).collect()  # window rows at most
    histogram = np.zeros(window, dtype=np.int64)
    for r in counts:
        histogram[r["rest"]] = r["n"]
    histogram[0] = 0
    n_full = sum(r["full"] for r in counts)
    made, left = plan(histogram, window, depth)
    full = lean.where("full > 0").select("doc_id", "doc_tokens", "full_before", F.posexplode("crcs").alias("k", "ids_crc32")).select(
        "doc_id", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("full_before") + F.col("k")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(window).cast("long").alias("padded")
    )
    stream_at = np.zeros(window, dtype=np.int64)
    before = 0
    for length in range(window - 1, 0, -1):
        stream_at[length] = before
        before += int(left[length]) * length
    last = (before - 1) // window if before else -1
    tail = before - last * window
    padded_tail = tail if tail & (tail - 1) == 0 else window
    base = n_full + made.sequences
    runs = np.array(sorted(made.runs), dtype=np.int64).reshape(-1, 5)
    placed = histogram - left
    # At most a few times window * window / 4 rows of three numbers: bounded by the window, not by the data.
    spots = spark.sparkContext.broadcast((runs[:, 0] << 40 | runs[:, 1], runs[:, 3], runs[:, 4], placed, stream_at))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, first, offsets, placed, stream_at = spots.value
        for b in batches:
            rest, rank = b.column("rest").to_numpy(), b.column("rank").to_numpy()
            key = rest << 40 | rank
            at = np.searchsorted(bounds, key, "right") - 1
            fits = rank < placed[rest]
            seq, offset, cut = np.zeros(len(rest), dtype=np.int64), np.zeros(len(rest), dtype=np.int64), rest.copy()
            seq[fits] = n_full + first[at[fits]] + key[fits] - bounds[at[fits]]
            offset[fits] = offsets[at[fits]]
            over = ~fits
            where = stream_at[rest[over]] + (rank[over] - placed[rest[over]]) * rest[over]
            seq[over], offset[over] = base + where // window, where % window
            cut[over] = np.minimum(rest[over], window - where % window)
            keep = [b.column(n) for n in ("key", "doc_id", "doc_tokens", "full", "rest", "rest_crc")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(offset), pa.array(cut)], names=["key", "doc_id", "doc_tokens", "full", "rest", "rest_crc", "seq", "offset", "cut"])

    columns = "key long, doc_id long, doc_tokens long, full long, rest long, rest_crc long, seq long, offset long, cut long"
    rests = lean.where("rest > 0").select("key", "doc_id", "doc_tokens", "full", "rest", "rest_crc", "rank").mapInArrow(place, columns)
    rests = stored(rests, "packed-rests")

    def piece(df: DataFrame, crc, begin, length, seq, offset) -> DataFrame:
        return df.select("doc_id", (F.col("full") * window + begin).alias("start"), length.alias("length"), crc.alias("ids_crc32"), "doc_tokens", seq.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"), F.when(seq == base + last, F.lit(padded_tail)).otherwise(F.lit(window)).cast("long").alias("padded"))

    whole = piece(rests.where("cut = rest"), F.col("rest_crc"), F.lit(0), F.col("rest"), F.col("seq"), F.col("offset"))

    def crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            head, tail = [], []
            for ids, rest, cut in zip(*[b.column(b.schema.get_field_index(n)).to_pylist() for n in ("rest_ids", "rest", "cut")]):
                ids = np.frombuffer(ids, dtype="<u4" if len(ids) == 4 * rest else "<u2").astype("<u4")
                head.append(zlib.crc32(ids[:cut].tobytes()))
                tail.append(zlib.crc32(ids[cut:].tobytes()))
            keep = [n for n in b.schema.names if n != "rest_ids"]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(n)) for n in keep], pa.array(head, type=pa.int64()), pa.array(tail, type=pa.int64())], names=[*keep, "head_crc", "tail_crc"])

    split = rests.where("cut < rest").join(rows.select("key", "rest_ids"), "key")
    split = split.select("key", "doc_id", "doc_tokens", "full", "rest", "rest_crc", "seq", "offset", "cut", "rest_ids").mapInArrow(crcs, f"{columns}, head_crc long, tail_crc long")
    halves = split.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    second = F.col("half") == 1
    cut = piece(halves, F.when(second, F.col("tail_crc")).otherwise(F.col("head_crc")), F.when(second, F.col("cut")).otherwise(F.lit(0)), F.when(second, F.col("rest") - F.col("cut")).otherwise(F.col("cut")), F.col("seq") + F.col("half"), F.when(second, F.lit(0)).otherwise(F.col("offset")))
    return full.unionByName(whole).unionByName(cut)


def op7_pack(spark, sf_dir: str) -> DataFrame:
    """Packs all documents into windows of 1024 ids."""
    return pack(table(spark, sf_dir, "documents"))
