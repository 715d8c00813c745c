"""Token ids in files of shuffled bit or byte planes.

A file holds the ids of consecutive documents, cut into blocks of a fixed number of ids. Each block is transposed into planes
(plane p holds bit p, or byte p, of every id), each plane is compressed by zstandard and planes of zeros only are left out.
The chunk index at the end gives each block's place, number of ids and plane lengths; the documents' ids and token counts
stand there too. The last 16 bytes are the place and length of that index.

Defined results: a null text counts as empty; rows are ordered by doc_id (nulls first), then by a hash of the text, then by text,
so rows that share a doc_id are dealt over files and repeated rows are repeated there; texts of any length are encoded whole,
some megabytes at a time; an empty table makes no files. Extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, slices, table, trimming
from .encode import encoder, vocabulary_path
from .files import created, opened

MAGIC = b"PLANES1\n"
BLOCK = 1 << 16


def shuffle(ids: np.ndarray, by: str = "byte") -> list[bytes]:
    """The planes of unsigned 32-bit ids, lowest first."""
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if by == "byte":
        return [octets[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def unshuffle(planes: list[bytes], n: int, by: str = "byte") -> np.ndarray:
    """planes: b"" for one of zeros only."""
    if by == "byte":
        octets = np.zeros((n, 4), dtype=np.uint8)
        for k, p in enumerate(planes):
            if p:
                octets[:, k] = np.frombuffer(p, dtype=np.uint8)
    else:
        bits = np.zeros((n, 32), dtype=np.uint8)
        for k, p in enumerate(planes):
            if p:
                bits[:, k] = np.unpackbits(np.frombuffer(p, dtype=np.uint8), bitorder="little", count=n)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return octets.reshape(-1).view("<u4")


class Writer:
    def __init__(self, out, by: str = "byte", block: int = BLOCK, level: int = 3):
        self.out, self.by, self.block = out, by, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held, self.at, self.n_ids = 0, len(MAGIC), 0
        self.blocks: list[list] = []
        self.docs: list[tuple[int | None, int]] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, dtype="<u4")
        whole = len(ids) if last else len(ids) // self.block * self.block
        for a in range(0, whole, self.block):
            part = ids[a : min(a + self.block, whole)]
            planes = [self.zstd.compress(p) if any(p) else b"" for p in shuffle(part, self.by)]
            self.out.write(b"".join(planes))
            self.blocks.append([self.at, len(part), [len(p) for p in planes]])
            self.at += sum(map(len, planes))
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        docs = np.array([[d is None, d or 0, n] for d, n in self.docs], dtype="<i8").reshape(-1, 3)
        index = self.zstd.compress(json.dumps({"by": self.by, "blocks": self.blocks}).encode())
        listed = self.zstd.compress(docs.tobytes())
        self.out.write(index + listed + struct.pack("<QII", self.at, len(index), len(listed)))


class Reader:
    """Reads one block at a time."""

    def __init__(self, file):
        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        file.seek(0)
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a file of id planes")
        size = file.size() if hasattr(file, "size") else file.seek(0, 2)
        file.seek(size - 16)
        at, n_index, n_docs = struct.unpack("<QII", file.read(16))
        file.seek(at)
        self.index = json.loads(self.zstd.decompress(file.read(n_index)))
        docs = np.frombuffer(self.zstd.decompress(file.read(n_docs)), dtype="<i8").reshape(-1, 3)
        self.docs = [(None if null else d, n) for null, d, n in docs.tolist()]

    def block(self, k: int) -> np.ndarray:
        at, n, lengths = self.index["blocks"][k]
        self.file.seek(at)
        data, planes, a = self.file.read(sum(lengths)), [], 0
        for x in lengths:
            planes.append(self.zstd.decompress(data[a : a + x]) if x else b"")
            a += x
        return unshuffle(planes, n, self.index["by"])

    def pieces(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """Each document and its ids, as they lie in one block or in several."""
        k, ids = 0, np.zeros(0, dtype="<u4")
        for doc_id, n in self.docs:
            got: list[np.ndarray] = []
            while n:
                if not len(ids):
                    ids, k = self.block(k), k + 1
                got.append(ids[:n])
                ids, n = ids[n:], n - len(got[-1])
            yield doc_id, got


def write_planes(docs: DataFrame, path: str, *, vocabulary: str | None = None, end_id: int = 0, by: str = "byte", block: int = BLOCK, level: int = 3) -> DataFrame:
    """Writes (doc_id, text) as files below path, each a range of doc_ids; returns their manifest: part, file, n_docs, n_ids, first_id."""
    spark, vocabulary = docs.sparkSession, vocabulary or vocabulary_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(vocabulary).encode_column
        uri, end = f"{path}/ids-{part:06d}.planes", np.array([end_id], dtype="<u4")
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with created(uri) as out:
            w = Writer(out, by, block, level)
            for b in slices((x for y in ([first], batches) for x in y), 4000):
                for doc_id, ids in zip(b.column(0).to_pylist(), encode(b.column(1))):
                    w.add(doc_id, np.concatenate([ids, end]))
            w.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [uri], "n_docs": [len(w.docs)], "n_ids": [w.n_ids]})

    lean = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = lean.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    manifest = dealt.mapInArrow(trimming(write), "part long, file string, n_docs long, n_ids long")
    manifest.write.parquet(f"{path}/manifest")
    rows = spark.read.parquet(f"{path}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return rows.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_planes(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files; a block at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows: list[tuple] = []
                with opened(uri) as f:
                    for doc_id, parts in Reader(f).pieces():
                        crc, n = 0, 0
                        for p in parts:
                            crc, n = zlib.crc32(p.tobytes(), crc), n + len(p)
                        rows.append((doc_id, start, n, crc))
                        start += n
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    spark = manifest.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("file", "first_id").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=pa.int64()) for k in range(4)], names=names)


def op2_bit_planes(spark, sf_dir: str) -> DataFrame:
    """Writes all documents' ids in byte planes and reads the files back."""
    manifest = write_planes(table(spark, sf_dir, "documents"), scratch(spark, "planes"))
    return read_planes(manifest)
