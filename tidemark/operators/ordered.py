"""Numbers and running sums in a total order over a whole table, without gathering its rows in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.sinks import kept


def running(df: DataFrame, order: Sequence[Column], sums: Mapping[str, str]) -> DataFrame:
    """df with inclusive running sums in an order: new name -> column. Rows are dealt out by ranges and stored; each range is summed by
    the task that holds it, and what stands before it is a row for each range. Rows that tie in the order get their sums in any order."""
    parts = kept(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    each = parts.groupBy("_range").agg(*(F.sum(c).alias(f"_all_{n}") for n, c in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    first = each.select("_range", *(F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums))
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumns({n: F.sum(c).over(w) for n, c in sums.items()}).join(F.broadcast(first), "_range")
    return out.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in sums}).drop("_range", *(f"_before_{n}" for n in sums))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with row_id, from 0 in a total order."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), [F.col(c) for c in order], {"row_id": "_one"}).withColumn("row_id", F.col("row_id") - 1).drop("_one")
