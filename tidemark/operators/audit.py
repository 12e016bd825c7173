"""Checks that fail closed, and audits that report. Checks run one small job each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType


def conflicts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys with more than one value: rows, distinct values, least and largest (A5)."""
    return df.groupBy(*keys).agg(F.count("*").alias("fact_row_count"), F.countDistinct(value).alias("distinct_numeric_values"), F.min(value).alias("minimum_value"), F.max(value).alias("maximum_value")).filter("distinct_numeric_values > 1")


def key_conflicts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that different rows share."""
    return df.distinct().groupBy(*keys).count().filter("count > 1").drop("count")


def assert_none(bad: DataFrame, what: str) -> None:
    n = bad.limit(1_000_001).count()
    if n:
        raise ValueError(f"{what}: {n}{' or more' if n > 1_000_000 else ''}")


def assert_no_conflict(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    assert_none(key_conflicts(df, keys), f"keys {', '.join(keys)} with different rows")
    return df


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    assert_none(df.groupBy(*keys).count().filter("count > 1"), f"duplicate keys {', '.join(keys)}")
    return df


def assert_known(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = F.lit(False)
    for c in cols:
        missing = missing | F.col(c).isNull()
    assert_none(df.filter(missing), f"rows without {', '.join(cols)}")
    return df


def assert_not_negative(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    below = F.lit(False)
    for c in cols:
        below = below | (F.col(c) < 0)
    assert_none(df.filter(below), f"negative values in {', '.join(cols)}")
    return df


def only_row(df: DataFrame):
    """The row of a frame that must have exactly one (X11)."""
    got = df.limit(2).collect()
    if len(got) != 1:
        raise ValueError(f"one row was expected, {'none' if not got else 'more'} found")
    return got[0]


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows, repeated ones as often."""
    cols = sorted(a.columns)
    if cols != sorted(b.columns):
        return False
    a, b = a.select(*cols), b.select(*cols)
    return a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """column_name, missing_rate, and whether it varies, of all columns in one pass."""
    parts = [F.struct(F.lit(c).alias("column_name"), F.avg(F.col(c).isNull().cast("int")).alias("missing_rate"), F.coalesce(F.min(c) < F.max(c), F.lit(False)).alias("varies")) for c in cols]
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def usable_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns of a training frame that have values and vary."""
    return [r.column_name for r in profile(df, cols).filter("varies").collect()]


def long_table(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """One row of aggregates as (metric, value) rows."""
    return df.agg(F.array(*(F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in metrics.items())).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def distinct_profile(df: DataFrame, cols: Sequence[str], most: int = 50) -> DataFrame:
    """column_name, n_distinct and the first values in order, `most` of them: a report."""
    out = None
    for c in cols:
        v = df.select(F.col(c).cast("string").alias("v")).filter("v is not null").distinct()
        top = v.orderBy("v").limit(most).agg(F.array_sort(F.collect_list("v")).alias("first_values"))
        one = v.agg(F.count("*").alias("n_distinct")).crossJoin(top).select(F.lit(c).alias("column_name"), "n_distinct", "first_values")
        out = one if out is None else out.unionByName(one)
    return out


def verify_table(recomputed: DataFrame, published: DataFrame, keys: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """The cells in which a recomputed table and a published one differ: keys, column_name, recomputed, published, kind (X32). Fractions may differ by
    the tolerance times the published one (1 at least), whole numbers not at all: however large a count is, one more is another count. A row that one side lacks is one cell, named *. Both need unique keys and the same columns."""
    if set(recomputed.columns) != set(published.columns):
        raise ValueError(f"columns differ: {sorted(set(recomputed.columns) ^ set(published.columns))}")
    values = [c for c in published.columns if c not in keys]
    both = assert_unique(recomputed, keys).withColumn("_side", F.lit(0)).unionByName(assert_unique(published, keys).withColumn("_side", F.lit(1)))
    of = lambda side, c: F.max(F.when(F.col("_side") == side, F.struct(F.col(c).alias("v"))))["v"]
    g = both.groupBy(*keys).agg(*(of(k, c).alias(f"_{k}_{c}") for c in values for k in (0, 1)), F.bool_or(F.col("_side") == 0).alias("_has_0"), F.bool_or(F.col("_side") == 1).alias("_has_1"))

    def cell(c: str) -> Column:
        a, b = F.col(f"_0_{c}"), F.col(f"_1_{c}")
        same = a.eqNullSafe(b)
        if tolerance and isinstance(published.schema[c].dataType, NumericType) and not isinstance(published.schema[c].dataType, IntegralType):
            same = same | F.coalesce(F.abs(a - b) <= tolerance * F.greatest(F.abs(b), F.lit(1)), F.lit(False))
        return F.when(~same, F.struct(F.lit(c).alias("column_name"), a.cast("string").alias("recomputed"), b.cast("string").alias("published"), F.lit("different").alias("kind")))

    text = F.lit(None).cast("string")
    lacks = lambda kind: F.array(F.struct(F.lit("*").alias("column_name"), text.alias("recomputed"), text.alias("published"), F.lit(kind).alias("kind")))
    cells = F.when(~F.col("_has_0"), lacks("missing")).when(~F.col("_has_1"), lacks("extra")).otherwise(F.filter(F.array(*map(cell, values)), lambda x: x.isNotNull()))
    return g.select(*keys, F.explode(cells).alias("_x")).select(*keys, "_x.*")


def drop_identifiers(df: DataFrame, also: Sequence[str] = (), endings: Sequence[str] = ("key", "_id", "cik", "gvkey", "ticker")) -> DataFrame:
    """df without columns that name rows rather than describe them, and without others that are named."""
    return df.drop(*also, *(c for c in df.columns if c.lower().endswith(tuple(endings))))
