"""Near-duplicate documents: weighted MinHash of five-word shingles, banded, verified by weighted Jaccard similarity.

A shingle weighs its count in the text times its inverse document frequency, scaled to 1 for shingles in one of `share`
documents or less and to `floor` for one in all of them. Frequencies of the shingles that weigh less than 1 are exact: a first
pass counts documents in hashed cells, a second one counts the shingles of those cells that hold enough documents to have
such a shingle. At most (shingles of a mean document) * share of them exist, whatever the size of the corpus, so they can be
broadcast. The floor keeps a group of copies, which makes its own shingles frequent, above the threshold: a pair of plain
similarity s keeps at least s / (s + (1 - s) / floor), and all of s while its shingles are in one of `share` documents or less.

Texts that are equal are one node from the start. Nodes that share a band are compared. Buckets of up to SMALL nodes are
compared completely. In larger ones, all are first compared with the most central member (that of the largest buckets) and with
another one picked by hash for each band; then all pairs of them that are not in one class by now, in tiles of a bucket's blocks.
So any two nodes of a bucket are compared or in one class. Pairs whose samples agree too little to be of the threshold's similarity (by over four standard deviations) are not
read again; all others are verified on their whole texts. Linked nodes form classes (connected components).

Defined results: null texts and texts without words belong to no class but their own; rows with a null doc_id too; rows that
share a doc_id but not the text are nodes of their own; a class keeps one row, of the least doc_id, then of the least hash of the
text, and of rows that are equal in both the first; texts of any length are read whole; an empty table gives no rows; extra columns are
ignored by `near_duplicates` and kept by `distinct_documents`, whose helper columns take names that the caller's leave free.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, slices, stored, table, trimming
from .components import components
from .shingles import Shingler, WeightedSampler, mixed, weighted_jaccard


@dataclass(frozen=True)
class Settings:
    width: int = 5
    similarity: float = 0.8
    bands: int = 12
    rows: int = 4
    share: int = 256
    floor: float = 0.5
    cells: int = 1 << 20
    small: int = 16
    salt: int = 256

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def least_agreeing(self) -> int:
        p, n = self.similarity, self.samples
        return max(self.rows, int(n * p - 4.3 * (n * p * (1 - p)) ** 0.5))


def text_keys() -> list[Column]:
    """Two hashes of the text."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def _lean(docs: DataFrame) -> DataFrame:
    k1, k2 = text_keys()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.coalesce("text", F.lit("")).alias("text"))


def cell_of(h: np.ndarray, cells: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(cells)).astype(np.int64)


@dataclass(frozen=True)
class Weights:
    """Of shingles: 1, but for those in `keys` (ascending). cells: which hashed cells hold any of these."""

    cells: np.ndarray
    keys: np.ndarray
    values: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=np.float32)
        if len(self.keys):
            maybe = np.flatnonzero(self.cells[cell_of(h, len(self.cells))])
            at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            found = self.keys[at] == h[maybe]
            out[maybe[found]] = self.values[at[found]]
        return out


def document_counts(docs: DataFrame, s: Settings) -> tuple[np.ndarray, int]:
    """Documents that have a shingle in each cell, and the number of documents."""
    chunk = min(1024, s.cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, total, n = Shingler(s.width), np.zeros(s.cells, dtype=np.int64), 0
        for b in slices(batches, 4000):
            held, size = [], 0
            for h in shingler(b.column(0)):
                cells = np.unique(cell_of(h, s.cells))
                held.append(cells)
                size += len(cells)
                n += 1
                if size > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=s.cells)
                    held, size = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=s.cells)
        if n:
            parts = [total[a : a + chunk].tobytes() for a in range(0, s.cells, chunk)]
            yield pa.RecordBatch.from_pydict({"chunk": list(range(len(parts))), "counts": parts, "n": [n] * len(parts)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for k, data, n in zip(*[b.column(i).to_pylist() for i in range(3)]):
                x = sums.setdefault(k, [np.zeros(chunk, dtype=np.int64), 0])
                x[0] += np.frombuffer(data, dtype=np.int64)
                x[1] += n
        if sums:
            yield pa.RecordBatch.from_pydict({"chunk": list(sums), "counts": [x[0].tobytes() for x in sums.values()], "n": [x[1] for x in sums.values()]})

    schema = "chunk long, counts binary, n long"
    partial = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(trimming(count), schema)
    df, n = np.zeros(s.cells, dtype=np.int64), 0
    for r in partial.repartition("chunk").mapInArrow(add, schema).collect():  # `cells` numbers in all, whatever the corpus
        df[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = np.frombuffer(r["counts"], dtype=np.int64)
        n = max(n, r["n"])
    return df, n


def weights_of(docs: DataFrame, s: Settings) -> Weights:
    """The weights of the shingles that are in more than one of `share` documents."""
    counts, n = document_counts(docs, s)
    least = n // s.share + 1
    hot = counts >= least
    none = Weights(np.zeros(s.cells, dtype=bool), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.float32))
    if not hot.any():
        return none
    flags = docs.sparkSession.sparkContext.broadcast(np.packbits(hot))  # cells / 8 bytes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, wanted = Shingler(s.width), np.unpackbits(flags.value, count=s.cells).astype(bool)
        keys, times, held, size = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), [], 0

        def folded() -> tuple[np.ndarray, np.ndarray]:
            new, index = np.unique(np.concatenate([keys, *held]), return_inverse=True)
            weight = np.concatenate([times, np.ones(size, dtype=np.int64)])
            return new, np.bincount(index, weights=weight, minlength=len(new)).astype(np.int64)

        for b in slices(batches, 4000):
            for h in shingler(b.column(0)):
                own = np.unique(h[wanted[cell_of(h, s.cells)]])
                held.append(own)
                size += len(own)
            if size > 1 << 19:
                keys, times = folded()
                held, size = [], 0
                if len(keys) > 1 << 20:
                    yield pa.RecordBatch.from_pydict({"shingle": keys.view(np.int64), "n": times})
                    keys, times = keys[:0], times[:0]
        keys, times = folded()
        if len(keys):
            yield pa.RecordBatch.from_pydict({"shingle": keys.view(np.int64), "n": times})

    found = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(trimming(count), "shingle long, n long")
    # At most (shingles of a mean document) * share rows: their frequencies add up to the shingles of all documents.
    rows = found.groupBy("shingle").agg(F.sum("n").alias("df")).where(F.col("df") >= least).toArrow()
    keys, df = rows.column("shingle").to_numpy().astype(np.int64).view(np.uint64), rows.column("df").to_numpy()
    order = np.argsort(keys)
    keys, df = np.ascontiguousarray(keys[order]), df[order]
    scaled = np.clip(np.log(n / np.maximum(df, 1)) / np.log(s.share), 0, 1)
    cells = np.zeros(s.cells, dtype=bool)
    cells[cell_of(keys, s.cells)] = True
    return Weights(cells, keys, (s.floor + (1 - s.floor) * scaled).astype(np.float32))


def weighted(shingler: Shingler, texts: pa.Array, weights: Weights) -> list[tuple[np.ndarray, np.ndarray]]:
    """The shingles of each text, ascending, and their weights."""
    sets = shingler.counted(texts)
    if not sets:
        return []
    idf, at, out = weights.of(np.concatenate([h for h, _ in sets])), 0, []
    for h, n in sets:
        out.append((h, n * idf[at : at + len(h)]))
        at += len(h)
    return out


def signed(lean: DataFrame, weights, s: Settings) -> DataFrame:
    """Adds samples and bands to doc_id, k1 and k2; null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sampler, w = Shingler(s.width), WeightedSampler(s.samples), weights.value
        factor = np.array([0x9E3779B97F4A7C15 + 2 * k * 0x5851F42D4C957F2D & (1 << 64) - 1 for k in range(s.rows)], dtype=np.uint64)
        for b in slices(batches, 4000):
            sets = weighted(shingler, b.column(3), w)
            full = [i for i, x in enumerate(sets) if len(x[0])]
            samples: list = [None] * len(sets)
            bands: list = [None] * len(sets)
            if full:
                got = sampler([sets[i] for i in full])
                keys = mixed((got.reshape(len(full), s.bands, s.rows).astype(np.uint64) * factor).sum(axis=2, dtype=np.uint64))
                for i, x, y in zip(full, got.view(np.int32), keys.view(np.int64)):
                    samples[i], bands[i] = x, y
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(samples, type=pa.list_(pa.int32())), pa.array(bands, type=pa.list_(pa.int64()))], names=["doc_id", "k1", "k2", "samples", "bands"])

    return lean.mapInArrow(trimming(run), "doc_id long, k1 long, k2 long, samples array<int>, bands array<long>")


def shared_bands(nodes: DataFrame) -> DataFrame:
    """nodes: d, bands. d, band, key and c (its bucket's size), where that is above one."""
    keys = nodes.select("d", F.posexplode("bands").alias("band", "key"))
    sizes = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return stored(keys.join(sizes, ["band", "key"]), "bands")


def candidate_pairs(nodes: DataFrame, s: Settings, shared: DataFrame | None = None) -> DataFrame:
    """nodes: d, samples, bands; shared: their `shared_bands`. Pairs (a, b) to verify first: all of small buckets, those with two members of large ones."""
    shared = shared_bands(nodes) if shared is None else shared
    scores = shared.groupBy("d").agg(F.sum("c").alias("s"))
    scored = shared.join(scores, "d")
    centres = scored.groupBy("band", "key").agg(F.max(F.struct("s", -F.col("d"))).alias("m"), F.max(F.struct(F.xxhash64("d", "band").alias("h"), "d")).alias("o"))
    centres = centres.select("band", "key", (-F.col("m").getField("col2")).alias("centre"), F.col("o.d").alias("other"))
    met = shared.join(centres, ["band", "key"])
    stars = met.select(F.col("centre").alias("a"), F.col("d").alias("b"))
    others = met.where(F.col("c") > s.small).select(F.col("other").alias("a"), F.col("d").alias("b"))
    few = shared.where(F.col("c").between(3, s.small)).select("band", "key", "d")
    all_pairs = few.join(few.withColumnRenamed("d", "e"), ["band", "key"]).where("d < e").select(F.col("d").alias("a"), F.col("e").alias("b"))
    pairs = stars.union(others).union(all_pairs).where("a <> b")
    pairs = pairs.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")  # one of its orientations
    samples = nodes.select("d", "samples")
    both = pairs.join(samples.select(F.col("d").alias("a"), F.col("samples").alias("sa")), "a").join(samples.select(F.col("d").alias("b"), F.col("samples").alias("sb")), "b")
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda z: z))
    return both.where(agree >= s.least_agreeing).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, weights, s: Settings) -> DataFrame:
    """Those of pairs (a, b) whose texts (d, text) are similar enough. A hot centre's pairs are dealt over several groups."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / s.salt).alias("salts"))
    dealt = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    members = dealt.join(texts.withColumnRenamed("d", "b"), "b").select(F.col("a").alias("a"), F.col("salt").alias("salt"), F.col("b").alias("b"), F.col("text").alias("text"))
    centres = counts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("salt")).join(texts.withColumnRenamed("d", "a"), "a")
    centres = centres.select(F.col("a").alias("own_a"), F.col("salt").alias("own_salt"), F.col("text").alias("own_text"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        links: list[tuple] = []
        if left.num_rows and right.num_rows:
            shingler, w = Shingler(s.width), weights.value
            own = weighted(shingler, right.column("own_text").combine_chunks()[:1], w)[0]
            others = weighted(shingler, left.column("text").combine_chunks(), w)
            for a, b, other in zip(left.column("a").to_pylist(), left.column("b").to_pylist(), others):
                if weighted_jaccard(own, other) >= s.similarity:
                    links.append((a, b))
        return pa.table({"a": pa.array([x[0] for x in links], type=pa.int64()), "b": pa.array([x[1] for x in links], type=pa.int64())})

    return members.groupBy("a", "salt").cogroup(centres.groupBy("own_a", "own_salt")).applyInArrow(compare, "a long, b long")


def remaining_links(nodes: DataFrame, shared: DataFrame, links: DataFrame, texts_of: Callable[[DataFrame], DataFrame], weights, s: Settings) -> DataFrame | None:
    """The similar pairs (a, b) among those that share a large bucket and that `links` leaves in different classes; None where there are
    no such buckets. nodes: d, samples, bands; texts_of: gives d and text of nodes (d).

    A bucket's members are dealt over blocks, and each two blocks (but those of its largest class) meet in a tile of its own: first their samples, then the texts of
    those that agree enough with another. A pair belongs to the first band that it shares: where that is a small bucket, it was compared there.
    """
    large = shared.where(F.col("c") > s.small).select("band", "key", "d", "c")
    if large.isEmpty():
        return None
    classes = components(links).select(F.col("node").alias("d"), "component")
    members = large.join(classes, "d", "left").select("band", "key", "d", "c", F.coalesce("component", "d").alias("class"))
    sizes = members.groupBy("band", "key", "class").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("band", "key").agg(F.max(F.struct("n", "class")).alias("m"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    members = members.join(main.select("band", "key", F.col("m.n").alias("n"), F.col("m.class").alias("main")), ["band", "key"])
    members = stored(members.withColumn("in_main", F.col("class") == F.col("main")).drop("main"), "unsettled")
    if members.isEmpty():
        return None
    # The largest class has blocks of its own, from 0 on; they don't meet each other.
    blocks = lambda n: F.ceil(n / (s.salt // 2)).cast("long")
    placed = members.withColumn("first", blocks(F.col("n"))).withColumn("rest", blocks(F.col("c") - F.col("n")))
    hashed = F.xxhash64("d")
    placed = placed.withColumn("own", F.when(F.col("in_main"), F.pmod(hashed, "first")).otherwise(F.col("first") + F.pmod(hashed, "rest")))
    met = placed.withColumn("with", F.explode(F.sequence(F.when(F.col("in_main"), F.col("first")).otherwise(F.lit(0).cast("long")), F.col("first") + F.col("rest") - 1)))
    tiled = met.select("band", "key", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "d", "class", "own")
    tile = ["band", "key", "lo", "hi"]

    def partners(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """Each row and those rows after it that it's to be compared with."""
        n = t.num_rows
        samples = t.column("samples").combine_chunks().flatten().to_numpy().reshape(n, -1)
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(n, -1)
        kind, own, band = t.column("class").to_numpy(), t.column("own").to_numpy(), t.column("band")[0].as_py() if n else 0
        across = n and t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
        for i in range(n - 1):
            js = np.arange(i + 1, n)
            js = js[(kind[js] != kind[i]) & ((own[js] != own[i]) if across else True)]
            js = js[(samples[js] == samples[i]).sum(axis=1) >= s.least_agreeing]
            js = js[~(bands[js, :band] == bands[i, :band]).any(axis=1)]
            if len(js):
                yield i, js

    def agreeing(t: pa.Table) -> pa.Table:
        found = np.zeros(t.num_rows, dtype=bool)
        for i, js in partners(t):
            found[i] = found[js] = True
        return t.filter(pa.array(found)).select([*tile, "d", "class", "own"])

    def compare(t: pa.Table) -> pa.Table:
        links: list[tuple] = []
        sets, d = weighted(Shingler(s.width), t.column("text").combine_chunks(), weights.value), t.column("d").to_pylist()
        for i, js in partners(t):
            links += [(min(d[i], d[j]), max(d[i], d[j])) for j in js.tolist() if weighted_jaccard(sets[i], sets[j]) >= s.similarity]
        return pa.table({"a": pa.array([x[0] for x in links], type=pa.int64()), "b": pa.array([x[1] for x in links], type=pa.int64())})

    columns = "band int, key long, lo long, hi long, d long, class long, own long"
    signs = nodes.select("d", "samples", "bands")
    wanted = stored(tiled.join(signs, "d").groupBy(*tile).applyInArrow(agreeing, columns), "tiles")
    texts = texts_of(wanted.select("d").distinct())
    return wanted.join(signs, "d").join(texts, "d").groupBy(*tile).applyInArrow(compare, "a long, b long")


def verdicts(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """For each doc_id, k1 and k2 (hashes of the text): times (equal rows), class_id (least doc_id of its class), n_links (verified
    links of its text), one (is it a class of which one row is kept) and best (is that among these rows)."""
    s, sc = settings, docs.sparkSession.sparkContext
    lean = _lean(docs)
    weights = sc.broadcast(weights_of(docs, s))
    rows = stored(signed(lean, weights, s), "signatures")
    full = rows.where("bands is not null and doc_id is not null")
    nodes = full.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "samples", "bands")).alias("m"), F.count(F.lit(1)).alias("n"))
    # Numbers of nodes are those of the stored table.
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("d"), "k1", "k2", "n", F.col("m.doc_id").alias("first"), "m.samples", "m.bands"), "nodes")
    shared = shared_bands(nodes)
    pairs = stored(candidate_pairs(nodes, s, shared), "pairs")

    def texts_of(meant: DataFrame) -> DataFrame:
        wanted = nodes.join(meant, "d").select("d", "k1", "k2", F.col("first").alias("doc_id"))
        return stored(lean.join(wanted, ["doc_id", "k1", "k2"]).dropDuplicates(["doc_id", "k1", "k2"]).select("d", "text"), "texts")  # repeated rows

    texts = texts_of(pairs.select(F.col("a").alias("d")).union(pairs.select(F.col("b").alias("d"))).distinct())
    links = stored(verified(pairs, texts, weights, s), "links")
    more = remaining_links(nodes, shared, links, texts_of, weights, s)
    if more is not None:
        links = stored(links.union(more).distinct(), "all-links")
    classes = components(links)
    degree = links.select(F.col("a").alias("d")).union(links.select(F.col("b").alias("d"))).groupBy("d").agg(F.count(F.lit(1)).alias("n_links"))
    linked = nodes.select("k1", "k2", "d", "n", "first").join(classes.withColumnRenamed("node", "d"), "d", "left").join(degree, "d", "left").where("n > 1 or component is not null")
    linked = stored(linked.select("k1", "k2", "first", F.coalesce("component", "d").alias("class"), F.coalesce("n_links", F.lit(0)).alias("links")), "classes")
    best = linked.groupBy("class").agg(F.min(F.struct("first", "k1", "k2")).alias("best"))
    linked = stored(linked.join(best, "class").select("k1", "k2", "links", "best"), "class-members")
    out = rows.groupBy("doc_id", "k1", "k2", F.col("bands").isNotNull().alias("has_words")).agg(F.count(F.lit(1)).alias("times")).join(linked, ["k1", "k2"], "left")
    one = F.col("has_words") & F.col("doc_id").isNotNull()
    mine = F.when(one, F.coalesce("best.first", "doc_id")).otherwise(F.col("doc_id"))
    is_best = F.col("best").isNull() | ((F.col("doc_id") == F.col("best.first")) & (F.col("k1") == F.col("best.k1")) & (F.col("k2") == F.col("best.k2")))
    return out.select("doc_id", "k1", "k2", "times", mine.alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), one.alias("one"), (~one | is_best).alias("best"))


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row for each row of docs: doc_id, k1, k2 (hashes of the text), class_id (least doc_id of its class), n_links (verified links of its text), kept."""
    rows = verdicts(docs, settings).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return rows.select("doc_id", "k1", "k2", "class_id", "n_links", (F.col("best") & (~F.col("one") | (F.col("nth") == 1))).alias("kept"))


def distinct_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs, all columns, without those that a class has beside the one that it keeps."""
    doc, k1, k2 = free_names(docs, "_doc", "_k1", "_k2")
    found = stored(verdicts(docs, settings).where("one and (not best or times > 1)").select(F.col("doc_id").alias(doc), F.col("k1").alias(k1), F.col("k2").alias(k2), "best"), "superfluous")
    hashes = text_keys()
    marked, keys = docs.withColumns({doc: F.col("doc_id").cast("long"), k1: hashes[0], k2: hashes[1]}), [doc, k1, k2]
    out = marked.join(found.select(*keys), keys, "left_anti")
    repeated = found.where("best").select(*keys)
    if not repeated.isEmpty():
        out = out.unionByName(marked.join(repeated, keys, "left_semi").dropDuplicates(keys))
    return out.select(*[F.col(f"`{n}`") for n in docs.columns])


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """The class of each document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")
