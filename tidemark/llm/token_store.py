"""Token ids in ORC files.

Texts are dealt out by ranges of the document id and sorted, so each file holds a run of ids in
ascending order; its integer columns are run-length encoded, stripes carry row indexes and a Bloom
filter on doc_id. A file also holds, for each document, how many ids precede it in that file. Files
are read stripe by stripe in parallel, and a lookup by document id prunes files, stripes and row
groups by their statistics and Bloom filters. Files are committed by Spark's own protocol.

Null and empty texts give the end id alone. A null doc_id sorts first. Rows of equal doc_id stand in the
order of a hash of their texts; all rows are kept. An empty table gives files without rows. Columns other than doc_id and
text are not looked at. A task writes one file, whatever maxRecordsPerFile the session has: its offsets run through it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import new_dir, small_batches
from tidemark.llm.tokens import encoder

END = 0


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END, stripe_mb: int = 16, stride: int = 1000, pieces: bool = True) -> None:
    small_batches(docs.sparkSession, 4)
    kind = docs.schema[key].dataType.simpleString()
    base = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = encoder(tokenizer, pieces), 0
        for b in batches:
            ids, at = enc.column(b.column(1))
            at = at + np.arange(len(at))  # room for the end ids
            full = np.insert(ids, at[1:] - np.arange(1, len(at)), end).astype(np.int32)
            rows = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(full))
            size = np.diff(at)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(before + at[:-1], pa.int64()), pa.array(size, pa.int64()), rows], names=["doc_id", "offset", "n_tokens", "ids"])
            before += int(size.sum())

    (
        base.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
        .mapInArrow(run, f"doc_id {kind}, offset long, n_tokens long, ids array<int>")
        .write.option("maxRecordsPerFile", "0").option("compression", "zstd").option("orc.stripe.size", str(stripe_mb << 20)).option("orc.row.index.stride", str(stride))
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)
    )


def files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: its name, its number, its ids and the ids of all files before it. As long as the driver's own list of files."""
    found = (
        spark.read.orc(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.max(F.col("offset") + F.col("n_tokens")).alias("n"))
        .withColumn("nth", F.regexp_extract("file", r"part-(\d+)", 1).cast("long")).collect()
    )
    found.sort(key=lambda r: r.nth)
    before = [0, *accumulate(r.n for r in found)]
    return spark.createDataFrame([(r.file, r.nth, r.n, b) for r, b in zip(found, before)], "file string, nth long, n long, before long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids."""
    rows = spark.read.orc(path)
    return rows.withColumn("file", F.col("_metadata.file_name")).join(F.broadcast(files(spark, path)), "file").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; the filter reaches the ORC reader."""
    return spark.read.orc(path).filter(F.col("doc_id").isin(doc_ids))


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows as read() returns them."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def store(docs: DataFrame, tokenizer: str, **how) -> tuple[str, DataFrame]:
    """Writes docs to a new place in the shared folder; the place and its rows as read back."""
    path = new_dir(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, **how)
    return path, read(docs.sparkSession, path)
