"""Readers: format by suffix, columns by name and alias, types by declaration, missing tables as empty ones."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.dates import mixed_date

SEPARATORS = ("\t", "|", ",")


def filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    """A small file, wherever Hadoop's file systems reach."""
    fs, p = filesystem(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


def read_lines(spark: SparkSession, path: str, most: int = 20) -> list[str]:
    """The first lines of a text file."""
    return [r.value for r in spark.read.text(path).limit(most).collect()]


def sniff(lines: Sequence[str]) -> str:
    """The separator of a delimited text: tab, pipe or comma, whichever stands in every line of the sample first."""
    lines = [x for x in lines if x.strip()]
    return next((s for s in SEPARATORS if lines and all(s in x for x in lines)), next((s for s in SEPARATORS if any(s in x for x in lines)), ","))


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a delimited text."""
    lines = read_lines(spark, path)
    return [c.strip().strip('"') for c in lines[0].split(sniff(lines))] if lines else []


def read_csvs(spark: SparkSession, paths: Sequence[str], sep: str | None = None, infer: bool = False) -> DataFrame:
    """Delimited files as one table; columns are matched by name, and a file that lacks one gives nulls."""
    groups: dict[tuple, list[str]] = {}
    for p in paths:
        s = sep or sniff(read_lines(spark, p))
        groups.setdefault((s, tuple(header(spark, p))), []).append(p)
    out = None
    for (s, _), same in groups.items():
        df = spark.read.option("header", True).option("sep", s).option("mode", "PERMISSIVE").option("inferSchema", infer).option("quote", '"').option("escape", '"').csv(same)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


def read_any(spark: SparkSession, path: str, row_tag: str = "row") -> DataFrame:
    """A table by its suffix: parquet, csv, txt and idx (delimited, or by runs of blanks), json, xml, xlsx."""
    name = path.rstrip("/").lower().removesuffix(".gz")
    if name.endswith((".csv", ".tsv")):
        return read_csvs(spark, [path])
    if name.endswith((".txt", ".idx")):
        lines = read_lines(spark, path)
        if any(s in (lines[0] if lines else "") for s in SEPARATORS):
            return read_csvs(spark, [path])
        cols = [c for c in __import__("re").split(r"\s{2,}", lines[0].strip())]
        parts = F.split(F.trim("value"), r"\s{2,}")
        # the header is the file's first line; a later line that equals it is a row
        rows = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row")).filter(F.trim("value") != "")
        begin = rows.filter("at = 0").agg(F.min("row")).first()[0]
        return rows.filter(F.col("row") != begin).select(*(F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(cols)))
    if name.endswith(".json"):
        return spark.read.option("multiLine", True).json(path)
    if name.endswith((".jsonl", ".ndjson")):
        return spark.read.json(path)
    if name.endswith(".xml"):
        return spark.read.format("xml").option("rowTag", row_tag).load(path)
    if name.endswith(".xlsx"):
        return spark.createDataFrame(pd.read_excel(path, dtype=str).astype(object).where(lambda d: d.notna(), None))
    return spark.read.parquet(path)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, date_columns: Sequence[str] = ()) -> DataFrame:
    """Some columns of a table, with dates parsed; unknown dates become null (S2). The selection reaches the scan."""
    df = read_any(spark, path)
    if columns is not None:
        df = df.select(*columns)
    for c in date_columns:
        if c in df.columns and not isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            df = df.withColumn(c, mixed_date(c).cast("timestamp_ntz"))
    return df


def align(df: DataFrame, schema: str | T.StructType, aliases: Mapping[str, Sequence[str]] = {}) -> DataFrame:
    """df with the columns of a schema: found by name or alias in any case, cast without errors, null if they're missing (1.3, P3)."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    have = {c.lower(): c for c in reversed(df.columns)}
    out = []
    for f in schema.fields:
        names = [f.name, *aliases.get(f.name, ())]
        found = next((have[n.lower()] for n in names if n.lower() in have), None)
        out.append((F.col(f"`{found}`").cast("string").try_cast(f.dataType) if found and isinstance(df.schema[found].dataType, T.StringType) else F.col(f"`{found}`").try_cast(f.dataType) if found else F.lit(None).cast(f.dataType)).alias(f.name))
    return df.select(*out)


def source_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or an empty one of the declared types if it isn't there."""
    return align(read_any(spark, path), schema) if exists(spark, path) else spark.createDataFrame([], schema)


def preferred(spark: SparkSession, stem: str, suffixes: Sequence[str] = (".parquet", ".csv.gz", ".csv")) -> str:
    """The first of a table's possible files that is there."""
    return next((stem + s for s in suffixes if exists(spark, stem + s)), stem + suffixes[0])


def filter_links(links: DataFrame, contains: str | None = None, first_year: int | None = None, last_year: int | None = None, most: int | None = None) -> DataFrame:
    """Links whose address holds a text and whose year hint lies in a range, latest first."""
    from tidemark.functions.normalize import year_hint

    x = links.withColumn("year_hint", year_hint("url"))
    if contains:
        x = x.filter(F.lower("url").contains(contains.lower()))
    if first_year is not None:
        x = x.filter(F.col("year_hint") >= first_year)
    if last_year is not None:
        x = x.filter(F.col("year_hint") <= last_year)
    return x.orderBy(F.col("year_hint").desc_nulls_last(), "url").limit(most) if most is not None else x


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as it is, wherever Hadoop's file systems reach."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def read_config(path: str, spark: SparkSession | None = None) -> dict:
    """A YAML file (S21), on the driver's disk or, with a session, wherever Hadoop's file systems reach."""
    import yaml

    if spark is not None:
        return yaml.safe_load(read_text(spark, path)) or {}
    with open(path) as f:
        return yaml.safe_load(f) or {}
