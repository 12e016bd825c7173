"""Dates as Column expressions. Timestamps are naive; day differences count calendar boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.normalize import col

YEAR_DAYS, THREE_YEARS_DAYS = 365, 3 * 365


def sec_date(c: str | Column) -> Column:
    """A date from eight digits, which may come as a number with a trailing .0."""
    t = F.regexp_replace(F.trim(col(c).cast("string")), r"\.0+$", "")
    return F.try_to_timestamp(F.when(t.rlike("^[0-9]{8}$"), t), F.lit("yyyyMMdd")).cast("date")


def mixed_date(c: str | Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd", "MM/dd/yyyy")) -> Column:
    """The first of some formats that fits."""
    t = F.trim(col(c).cast("string"))
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in formats))


def day(c: str | Column) -> Column:
    return col(c).cast("date")


def day_diff(later: str | Column, earlier: str | Column) -> Column:
    """Calendar days between."""
    return F.datediff(day(later), day(earlier))


def plus_days(c: str | Column, n: int) -> Column:
    """A naive timestamp n days on."""
    return col(c) + F.expr(f"INTERVAL {int(n)} DAY")


def censored(origin: str | Column, as_of: Column, horizon: int = YEAR_DAYS) -> Column:
    """1 if the horizon after an origin isn't over at as_of."""
    return F.when(plus_days(origin, horizon) > as_of, 1).otherwise(0)


def window_meet(starts: list[Column], ends: list[Column]) -> tuple[Column, Column]:
    """The latest start and earliest end of some date windows, whose unknown edges don't count; null if that's empty."""
    start = F.greatest(*starts) if len(starts) > 1 else starts[0]
    end = F.least(*ends) if len(ends) > 1 else ends[0]
    whole = start <= end
    return F.when(whole, start), F.when(whole, end)


def years_between(start: Column, end: Column) -> Column:
    """The years from one date to another, as an array."""
    return F.when(start.isNotNull() & end.isNotNull(), F.sequence(F.year(start), F.year(end)))


def business_days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """day, quarter and path of the daily index file of each weekday."""
    d = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS day").filter(~F.dayofweek("day").isin(1, 7))
    path = F.format_string("%d/QTR%d/master.%s.idx", F.year("day"), F.quarter("day"), F.date_format("day", "yyyyMMdd"))
    return d.select("day", F.quarter("day").alias("quarter"), path.alias("path"))
