"""A deterministic, sharded WARC writer, and its reader.

Pages are ordered by their id (and a hash of url and payload among equal ids), and cut into shards wherever the bytes so
far pass another multiple of the shard size: ranges of equal bytes, however ids lie, that depend on the pages alone.
Each shard is sorted. A task writes each record as its own gzip
member with fresh headers and digests, and starts a new file when the compressed size passes a limit. Files
are written under temporary names and renamed to names that follow from shard and number, so a retried
or doubled task leaves the same file; the manifest, committed by Spark, lists the files that count, and
readers open only those.

Of records with equal payloads of at least `least` bytes, that with the smallest page_id is a response and the
others are revisits of it without payload; smaller ones are all responses. Null payloads count as empty. A
null page_id sorts first and is never revisited while other ids have its payload. Rows that repeat the
smallest page_id with its payload are all responses. A null url is left out; signs that can't stand in a
header are percent-encoded. Ids must be integers (others are refused). An empty table gives an empty manifest. Columns
other than these three are not looked at.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import new_dir, small_batches, stored

LEAST, MOST_SHARDS, BROADCAST_ROWS = 100, 50_000, 200_000
DATE = "2024-01-01T00:00:00Z"
NULL_ID = -(1 << 63)
MANIFEST = "file string, shard long, records long, raw_bytes long, file_bytes long, first_id long, last_id long"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='!#$%&()*+,/:;=?@[]~' + chr(39))}")
    head += [f"Page-Id: {'' if page_id is None else page_id}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


class _Files:
    """The files of a shard, one open at a time, under a temporary name until it's complete."""

    def __init__(self, uri: str, shard: int, roll: int):
        self.fs, self.dir = _open(uri)
        self.shard, self.roll, self.n, self.out = shard, roll, 0, None

    def add(self, raw: bytes, page_id: int | None) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.n:05d}.warc.gz"
            self.tmp = f"{self.dir}/.{self.name}.{uuid.uuid4().hex}"
            self.out, self.records, self.raw, self.size, self.first = self.fs.open_output_stream(self.tmp, compression=None), 0, 0, 0, page_id
        member = gzip.compress(raw, 6, mtime=0)
        self.out.write(member)
        self.records, self.raw, self.size, self.last = self.records + 1, self.raw + len(raw), self.size + len(member), page_id
        if self.size >= self.roll:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.tmp, f"{self.dir}/{self.name}")
            yield (self.name, self.shard, self.records, self.raw, self.size, self.first, self.last)
            self.out, self.n = None, self.n + 1


def prepared(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, payload (null for revisits), size, digest, refers_to. Payloads that occur more than once are
    broadcast as digests if they are at most broadcast_rows (some 100 bytes each); else payloads are joined by a shuffle."""
    if pages.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{key} is not an integer; number the pages first")
    payload = F.coalesce(F.col(html), F.lit(""))
    base = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"), F.sha2(payload, 256).alias("digest"), F.xxhash64(F.col(url), payload).alias("tie"))
    first = base.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    first = stored(first, "first-pages")
    out = base.join(F.broadcast(first) if first.count() <= broadcast_rows else first, "digest", "left").withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    return out.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers_to", "tie")


def _ordered(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Pairs of 64-bit numbers as bytes in the same order."""
    pair = np.stack([ids.astype(np.int64), ties.astype(np.int64)], 1).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(pair.astype(">u8")).view("S16").ravel()


def cuts(rows: DataFrame, shard_bytes: int) -> np.ndarray:
    """The first (page_id, tie) of each shard but the first one, as bytes. rows: page_id, tie, size. At most MOST_SHARDS come to the driver: beyond,
    shards get larger (a task streams its shard, so that costs time, not memory)."""
    spark = rows.sparkSession
    each = rows.groupBy(F.coalesce("page_id", F.lit(NULL_ID)).alias("page_id"), "tie").agg(F.sum(F.col("size") + 600).alias("bytes"))
    each = stored(each.repartitionByRange("page_id", "tie").withColumn("part", F.spark_partition_id()), "sizes")
    parts = sorted(each.groupBy("part").agg(F.sum("bytes")).collect())  # a row for each task
    if not parts:
        return np.zeros(0, "S16")
    before = [0, *accumulate(n for _, n in parts)]
    step = max(shard_bytes, -(-before[-1] // MOST_SHARDS))
    start = spark.createDataFrame([(k, n) for (k, _), n in zip(parts, before)], "part int, before long")
    so_far = F.sum("bytes").over(Window.partitionBy("part").orderBy("page_id", "tie")) - F.col("bytes")  # a part is what one task holds
    shard = F.floor((F.col("before") + so_far) / step).alias("shard")
    found = sorted(each.join(F.broadcast(start), "part").select("page_id", "tie", shard).groupBy("shard").agg(F.min(F.struct("page_id", "tie")).alias("first")).collect())
    return _ordered(np.array([r.first.page_id for r in found[1:]], np.int64), np.array([r.first.tie for r in found[1:]], np.int64))


def write(pages: DataFrame, uri: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, shard_bytes: int = 16 << 20, roll_bytes: int = 4 << 20, date: str = DATE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Writes archives under uri, which all machines share, and the manifest, which is returned."""
    spark = pages.sparkSession
    small_batches(spark)
    rows = prepared(pages, key, url, html, least, broadcast_rows)
    at = spark.sparkContext.broadcast(cuts(rows.select("page_id", "tie", "size"), shard_bytes))

    @F.pandas_udf("long")
    def place(ids: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at.value, _ordered(ids.to_numpy(), ties.to_numpy()), side="right"))

    n = len(at.value) + 1
    rows = rows.withColumn("shard", place(F.coalesce("page_id", F.lit(NULL_ID)), "tie"))
    path = f"{uri}/archives"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        pack = lambda done: pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in done], schema=pa.schema([("file", pa.string()), *((n, pa.int64()) for n in names[1:])]))
        files = None
        for b in batches:
            done = []
            for r in b.to_pylist():
                if files is None or files.shard != r["shard"]:
                    done += files.close() if files else []
                    files = _Files(path, r["shard"], roll_bytes)
                payload = None if r["payload"] is None else r["payload"].encode()
                done += files.add(record(r["page_id"], r["url"], payload, r["size"], r["digest"], r["refers_to"], date), r["page_id"])
            if done:
                yield pack(done)
        if files and (done := list(files.close())):
            yield pack(done)

    rows = rows.repartition(n, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "tie", "digest", "url").drop("tie")
    rows.mapInArrow(run, MANIFEST).write.parquet(f"{uri}/manifest")
    return spark.read.parquet(f"{uri}/manifest")


def records(file: pa.NativeFile, step: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of an open file, each decompressed."""
    rest, out, z = b"", [], zlib.decompressobj(31)
    while True:
        raw = rest or file.read(step)
        rest = b""
        if not raw:
            if out:
                raise ValueError("a record is cut off")
            return
        out.append(z.decompress(raw))
        if z.eof:
            yield b"".join(out)
            rest, out, z = z.unused_data, [], zlib.decompressobj(31)


def parsed(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    field = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(http.rsplit(b"Content-Length: ", 1)[1]), field["WARC-Payload-Digest"].removeprefix("sha256:")
    if field["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"a record is damaged: {field['WARC-Record-ID']}")
    if field["WARC-Type"] == "response":
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if f"sha256:{digest}" != field["WARC-Payload-Digest"]:
            raise ValueError(f"a payload is damaged: {field['WARC-Record-ID']}")
    number = lambda k: int(field[k]) if field.get(k) else None
    return {"page_id": number("Page-Id"), "url": field.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": field["WARC-Type"], "refers_to": number("Refers-To-Page-Id"), "payload": payload.decode() if field["WARC-Type"] == "response" else None}


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def read(spark: SparkSession, uri: str, payloads: bool = True) -> DataFrame:
    """All records of the files that the manifest lists, a file a row of work."""
    small_batches(spark)
    path = f"{uri}/archives"
    names = [c.split()[0] for c in READ.split(", ")][: None if payloads else -1]
    fields = [(n, pa.string() if f"{n} string" in READ else pa.int64()) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _open(path)
        for b in batches:
            for name in b.column(0).to_pylist():
                held, size = [], 0
                with system.open_input_stream(f"{folder}/{name}", compression=None) as file:
                    for raw in records(file):
                        r = parsed(raw)
                        held.append({n: r[n] for n in names})
                        size += 200 + (len(raw) if payloads else 0)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=pa.schema(fields))
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=pa.schema(fields))

    listed = spark.read.parquet(f"{uri}/manifest").select("file")
    return listed.repartition(max(1, listed.count()), "file").mapInArrow(run, ", ".join(READ.split(", ")[: len(names)]))


def round_trip(pages: DataFrame, **how) -> DataFrame:
    uri = new_dir(pages.sparkSession, "warc")
    write(pages, uri, **how)
    return read(pages.sparkSession, uri, payloads=False)
