"""Point-in-time operators: as-of joins, look-back counts, look-ahead existence, sessions, cumulative counts.

As-of joins and look-back counts put both sides in one sorted pass by key, so their cost is linear in rows and no
pair of rows is ever formed. Rows without a key or time can match nothing; in that pass
they stand apart, spread by the task that they come from. An as-of join
sorts by key and quarter, and carries the last value of the quarters before, so a very active key is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.dates import day_diff


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


DAY = 86_400_000_000


def _apart(*cols: str) -> Column:
    """0 for rows that have these columns; others are spread over windows of their own."""
    known = F.lit(True)
    for c in cols:
        known = known & F.col(c).isNotNull()
    return F.when(known, 0).otherwise(F.spark_partition_id() + 1).alias("_z")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, values: Sequence[str], strict: bool = True, ties: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """left with the values of the last right row of the same key before its time (or at it, if not strict). Of right
    rows of one time, that with the least `ties` counts (J5, J6, J7). Rows without a match get nulls."""
    payload = F.struct(*(F.col(v) for v in values))
    kept = F.struct(*(F.col(c) for c in left.columns))
    nulls = right.select(payload.alias("v")).schema["v"].dataType
    keys = [f"_k{i}" for i in range(len(by))]
    r = right.dropna(subset=[*by, right_ts]).select(*(F.col(x).alias(k) for x, k in zip(by, keys)), F.col(right_ts).alias("_t"), payload.alias("_v"), *(F.col(t).alias(f"_o{i}") for i, t in enumerate(ties)))
    if ties:  # an aggregate, whose exchange both uses below share
        rank = F.struct(*(c.alias(f"c{i}_{k}") for i in range(len(ties)) for k, c in enumerate((F.col(f"_o{i}").isNull(), F.col(f"_o{i}")))))
        r = r.groupBy(*keys, "_t").agg(F.min_by("_v", rank).alias("_v"))
    a = left.select(_apart(*by, left_ts), *(F.col(b).alias(k) for b, k in zip(by, keys)), F.col(left_ts).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(nulls).alias("_v"), kept.alias("_l"))
    b = r.select(F.lit(0).alias("_z"), *keys, "_t", F.lit(1 if strict else 0).alias("_side"), "_v", F.lit(None).cast(a.schema["_l"].dataType).alias("_l"))
    quarter = F.date_trunc("quarter", F.col("_t").cast("timestamp")) if isinstance(a.schema["_t"].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.lit(0)
    w = Window.partitionBy(*keys, "_q", "_z").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    within = a.unionByName(b).withColumn("_q", quarter).withColumn("_m", F.last("_v", True).over(w)).filter(F.col("_l").isNotNull())
    # the last value of each quarter, brought to the quarters after it: a row for each key and quarter
    ends = b.withColumn("_q", quarter).groupBy(*keys, "_q").agg(F.max_by("_v", "_t").alias("_e"))
    asked = a.filter("_z = 0").withColumn("_q", quarter).select(*keys, "_q").distinct().withColumn("_e", F.lit(None).cast(nulls)).withColumn("_ask", F.lit(1))
    ends = ends.withColumn("_ask", F.lit(0)).unionByName(asked)
    before = Window.partitionBy(*keys).orderBy("_q", F.col("_ask").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a quarter's question stands before its own end
    carried = ends.withColumn("_c", F.last("_e", True).over(before)).filter("_ask = 1").select(*keys, "_q", F.lit(0).alias("_z"), "_c")
    out = within.join(carried, [*keys, "_q", "_z"], "left").withColumn("_m", F.coalesce("_m", "_c"))
    return out.select("_l.*", *(F.col(f"_m.{v}").alias(prefix + v) for v in values))


def window_counts(base: DataFrame, events: DataFrame, by: str, base_ts: str, event_ts: str, counts: Mapping[str, tuple[int, Column | None]]) -> DataFrame:
    """base with counts of the events of its key in [time - days, time): name -> (days, condition on events)."""
    marks = {n: F.when(cond if cond is not None else F.lit(True), 1).otherwise(0).cast("long") for n, (_, cond) in counts.items()}
    kept = F.struct(*(F.col(c) for c in base.columns))
    a = base.select(_apart(by, base_ts), F.col(by).alias("_k"), _micros(base_ts).alias("_t"), *(F.lit(0).cast("long").alias(f"_n_{n}") for n in counts), kept.alias("_l"))
    b = events.dropna(subset=[by, event_ts]).select(F.lit(0).alias("_z"), F.col(by).alias("_k"), _micros(event_ts).alias("_t"), *(m.alias(f"_n_{n}") for n, m in marks.items()), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"))
    out = a.unionByName(b)
    for n, (days, _) in counts.items():
        w = Window.partitionBy("_k", "_z").orderBy("_t").rangeBetween(-days * DAY, -1)
        out = out.withColumn(n, F.coalesce(F.sum(f"_n_{n}").over(w), F.lit(0).cast("long")))
    return out.filter(F.col("_l").isNotNull()).select("_l.*", *counts)


def exists_ahead(base: DataFrame, events: DataFrame, by: str, base_ts: str, event_ts: str, flags: Mapping[str, tuple[int, Column | None]]) -> DataFrame:
    """base with a 0/1 flag for events of its key in (time, time + days]: name -> (days, condition on events)."""
    marks = {n: F.when(cond if cond is not None else F.lit(True), 1).otherwise(0) for n, (_, cond) in flags.items()}
    kept = F.struct(*(F.col(c) for c in base.columns))
    a = base.select(_apart(by, base_ts), F.col(by).alias("_k"), _micros(base_ts).alias("_t"), *(F.lit(0).alias(f"_n_{n}") for n in flags), kept.alias("_l"))
    b = events.dropna(subset=[by, event_ts]).select(F.lit(0).alias("_z"), F.col(by).alias("_k"), _micros(event_ts).alias("_t"), *(m.alias(f"_n_{n}") for n, m in marks.items()), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"))
    out = a.unionByName(b)
    for n, (days, _) in flags.items():
        w = Window.partitionBy("_k", "_z").orderBy("_t").rangeBetween(1, days * DAY)
        out = out.withColumn(n, F.coalesce(F.max(f"_n_{n}").over(w), F.lit(0)))
    return out.filter(F.col("_l").isNotNull()).select("_l.*", *flags)


def sessions(events: DataFrame, by: str, ts: str, gap_days: int, ties: Sequence[str] = ()) -> DataFrame:
    """events with session_seq, which rises where more than gap_days passed since the one before."""
    w = Window.partitionBy(by).orderBy(F.col(ts), *(F.col(t) for t in ties))
    new = (F.coalesce(day_diff(F.col(ts), F.lag(ts).over(w)), F.lit(9999)) > gap_days).cast("int")
    return events.withColumn("_new", new).withColumn("session_seq", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def cumulative(df: DataFrame, by: Sequence[str], ts: str, sums: Mapping[str, str]) -> DataFrame:
    """df with running sums by key and time: new name -> column."""
    w = Window.partitionBy(*by).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def with_history(df: DataFrame, by: str, ts: str, tie: str) -> DataFrame:
    """df with the days since the entity's row before and the number of rows before."""
    w = Window.partitionBy(by).orderBy(ts, tie)
    return df.withColumn("days_since_previous", day_diff(F.col(ts), F.lag(ts).over(w))).withColumn("prior_count", F.row_number().over(w) - 1)
