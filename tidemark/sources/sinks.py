"""Writers. Row content and row order are deterministic; file bytes are not promised."""

from __future__ import annotations

import csv
import io
import json
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import write_bytes


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the folder that all machines share: the checkpoint folder, or the warehouse where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a stored table: what several later steps read is computed once, and their plans start from it (J2 on)."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", order: Sequence[str] = (), one_file: bool = False, partition_by: Sequence[str] = ()) -> str:
    """Parquet (zstd) or CSV (gzip), ordered on request (K1, K2, K3, O2). With one_file the table must be small."""
    if order:
        df = df.orderBy(*(F.col(c).asc_nulls_last() for c in order))
    if one_file:
        df = df.coalesce(1)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("compression", "gzip").csv(path)
    else:
        w.option("compression", "zstd").parquet(path)
    return path


def write_by_year(df: DataFrame, path: str, ts: str, order: Sequence[str], rows_per_file: int = 5_000_000) -> str:
    """A folder for each year of ts (one for unknown years), ordered inside (K4). An order is required."""
    if not order:
        raise ValueError("an order is required")
    y = df.withColumn("year", F.year(ts))
    y.repartition("year").sortWithinPartitions("year", *(F.col(c).asc_nulls_last() for c in order)).write.partitionBy("year").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return path


def append(df: DataFrame, path: str) -> str:
    """Adds rows to a CSV table (K6)."""
    return write_table(df, path, "csv", "append")


def sample_entities(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """All rows of n entities, drawn by a seeded hash (K8)."""
    ids = df.select(key).distinct().orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
    return df.join(ids, key, "left_semi")


def write_json(value: object, path: str) -> str:
    """A small summary, replaced as a whole (K7, K9)."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "w") as f:
        json.dump(value, f, indent=2, sort_keys=True, default=str)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)
    return path


def write_summary(spark: SparkSession, value: object, path: str) -> str:
    """A small summary wherever Hadoop's file systems reach, replaced as a whole (K7, K9)."""
    return _replaced(spark, path, (json.dumps(value, indent=2, sort_keys=True, default=str) + "\n").encode())


def _replaced(spark: SparkSession, path: str, data: bytes) -> str:
    tmp, jvm = f"{path}.{uuid.uuid4().hex}", spark._jvm
    write_bytes(spark, tmp, data)
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    to = jvm.org.apache.hadoop.fs.Path(path)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration()).rename(jvm.org.apache.hadoop.fs.Path(tmp), to, how)
    return path


def latex(df: DataFrame, most: int = 1000) -> str:
    """A small table as a LaTeX tabular (K10); larger ones are refused."""
    marks = {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"} | {c: "\\" + c for c in "&%$#_{}"}
    line = lambda cells: " & ".join("" if c is None else "".join(marks.get(x, x) for x in str(c)) for c in cells) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", line(df.columns), r"\hline", *map(line, _few(df, most)), r"\end{tabular}", ""])


def bundle(spark: SparkSession, df: DataFrame, folder: str, name: str) -> list[str]:
    """A small table as Markdown, CSV and LaTeX, under one name."""
    rows = _few(df, 1000)
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([df.columns, *(["" if c is None else c for c in r] for r in rows)])
    texts = {"md": markdown(df), "csv": out.getvalue(), "tex": latex(df)}
    return [_replaced(spark, f"{folder}/{name}.{kind}", t.encode()) for kind, t in texts.items()]


def _few(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are not a report")
    return rows


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown (K10); larger ones are refused."""
    rows = _few(df, most)
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), "|" + "---|" * len(df.columns), *map(line, rows)])
