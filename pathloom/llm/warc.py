"""WARC archives, written with an index, and read back through it.

One record for each page, in gzip members of their own, so that each can be read alone. The index (file, offset, length, url,
digest, page_id, type) is a table beside the archives; readers take from it the records they want, sort them by place and
read neighbouring ranges at once.

Of pages with equal payloads of at least `min_revisit` bytes, the one with the least page_id is the response and the others are
revisits: their block holds the HTTP head only (with the payload's length), their headers its digest and the response's page.
Smaller payloads are always responses.

Defined results: null html is an empty payload; a null url is empty; a null page_id is the last among equals (a group of nulls
only has a null page as response); of rows equal in page_id and payload that are the least of their group, the first by url is the
response and the others revisit it; payloads of any length are written whole; an empty table makes no archives; extra columns
are ignored.

A task's archive has a name of its own, and only the index of the attempt that counts names it: where a task runs twice, the
other file is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, slices, table
from .files import created, opened

#: Bytes between two wanted records that are read rather than left out, and the most bytes read at once.
GAP, MOST = 1 << 16, 8 << 20
#: Bytes of archives for a task that reads.
TASK = 64 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, type string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return "urn:page:" + ("none" if page_id is None else str(page_id))


def page_of(urn: str) -> int | None:
    own = urn.strip("<>").rpartition(":")[2]
    return None if own == "none" else int(own)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A gzip member. refers_to: the response's urn, for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    clean = url.replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{page_urn(page_id)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """What a record says: page_id, url, type, digest, refers_to, payload_bytes, and payload (None for a revisit)."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != length or sha1_base32(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {"page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI", ""), "type": fields["WARC-Type"], "digest": digest, "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None, "payload_bytes": length, "payload": None if revisit else payload}


def written(df: DataFrame, path: str) -> str:
    df.write.option("compression", "zstd").parquet(path)
    return path


def write_archives(pages: DataFrame, path: str, *, min_revisit: int = 0) -> DataFrame:
    """pages: page_id, url, html. Writes archives and their index below path; returns the index."""
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    lean = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("bytes"))
    # Groups are added up before they are shuffled, and joined to rows without payloads; payloads are joined by page, so a common one doesn't meet in a task.
    slim = lean.drop("html")
    groups = slim.where(F.col("bytes") >= min_revisit).groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1")
    members = slim.join(groups.drop("n"), ["digest", "bytes"]).groupBy("page_id", "digest", "bytes").agg(F.any_value("first").alias("first"), F.count(F.lit(1)).alias("times"))
    members = members.select(F.col("page_id").alias("own"), F.col("digest").alias("d"), F.col("bytes").alias("b"), "first", "times")
    members = spark.read.schema(members.schema).parquet(written(members, f"{path}/groups"))
    met = F.col("page_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b"))
    least = F.col("page_id").eqNullSafe(F.col("first"))
    several = members.where(F.col("own").eqNullSafe(F.col("first")) & (F.col("times") > 1))
    revisits = F.col("d").isNotNull() & ~least
    names = ["page_id", "url", "html", "revisits", "first"]
    if several.isEmpty():
        rows = lean.join(members, met, "left").withColumn("revisits", revisits).select(*names)
    else:
        rows = lean.join(members, met, "left").withColumn("revisits", revisits)
        twice = least & (F.col("times") > 1) & F.col("d").isNotNull()
        nth = F.row_number().over(Window.partitionBy("page_id", "digest", "bytes").orderBy("url"))
        rows = rows.where(~F.coalesce(twice, F.lit(False))).select(*names).unionByName(rows.where(twice).withColumn("revisits", nth > 1).select(*names))
    rows = rows.withColumn("html", F.col("html").cast("binary"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        uri, at, index = f"{path}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, []
        with created(uri) as out:
            for b in slices((x for y in ([first], batches) for x in y), 500):
                for page_id, url, payload, revisit, response in zip(*[c.to_pylist() for c in b.columns]):
                    digest = sha1_base32(payload)
                    member = record(page_id, url, payload, digest, page_urn(response) if revisit else None)
                    out.write(member)
                    index.append((uri, at, len(member), url, digest, page_id, "revisit" if revisit else "response"))
                    at += len(member)
        for a in range(0, len(index), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in index[a : a + 10_000]], type=t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], names=["file", "offset", "length", "url", "digest", "page_id", "type"])

    rows.mapInArrow(write, INDEX).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def ranges(places: Iterable[tuple[str, int, int]], gap: int = GAP, most: int = MOST) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Of (file, offset, length) sorted by place: file, begin, end and members of each range to read."""
    file, begin, end, members = None, 0, 0, []
    for f, o, n in places:
        if members and (f != file or o - end > gap or o + n - begin > most):
            yield file, begin, end, members
            members = []
        if not members:
            file, begin, end = f, o, o
        members.append((o, n))
        end = max(end, o + n)
    if members:
        yield file, begin, end, members


def read_records(index: DataFrame, *, gap: int = GAP, most: int = MOST, payloads: bool = False) -> DataFrame:
    """The records that the given rows of an index name."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = ((f, o, n) for b in batches for f, o, n in zip(*[c.to_pylist() for c in b.columns]))
        name, stream, rows, held = None, None, [], 0
        for f, begin, end, members in ranges(places, gap, most):
            if f != name:
                if stream:
                    stream.close()
                name, stream = f, opened(f)
            stream.seek(begin)
            data = stream.read(end - begin)
            for o, n in members:
                r = parse(data[o - begin : o - begin + n])
                held += len(r["payload"] or b"") if payloads else 0
                rows.append(r)
                if len(rows) == 5000 or held > 32 << 20:
                    yield _records(rows, payloads)
                    rows, held = [], 0
        if stream:
            stream.close()
        if rows:
            yield _records(rows, payloads)

    places = index.select("file", "offset", "length")
    total = places.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK))
    by_file = places.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return by_file.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def _records(rows: list[dict], payloads: bool) -> pa.RecordBatch:
    kinds = {"page_id": ("page_id", pa.int64()), "url": ("url", pa.string()), "payload_bytes": ("payload_bytes", pa.int64()), "payload_digest": ("digest", pa.string()), "record_type": ("type", pa.string()), "refers_to": ("refers_to", pa.int64())}
    if payloads:
        kinds["payload"] = ("payload", pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in kinds.values()], names=list(kinds))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Writes all pages as WARC records and reads them back."""
    index = write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_records(index).drop("url")


#: The SHA-1 in base 32 is built from its hexadecimal form: 32 groups of five bits.
OP5_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), h AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p
), b AS (
  SELECT *, list_reduce(list_transform(range(1, 33), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
    (CAST('0x' || substr(hex || '00', CAST((i * 5 - 5) // 4 + 1 AS BIGINT), 3) AS BIGINT) >> (12 - 5 - ((i * 5 - 5) % 4))) & 31) AS BIGINT), 1)), lambda x, y: x || y) AS payload_digest
  FROM h
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM b
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM g
"""
