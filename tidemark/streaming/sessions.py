"""Streams of point events: sessions with a gap, look-ahead labels emitted once their horizon is over, first-wins
deduplication, and windowed counts. Event times are timestamps; naive ones are read as UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1, glob: str | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; files are taken once each, in batches."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (r.option("pathGlobFilter", glob) if glob else r).parquet(folder)


def timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def sessions(stream: DataFrame, by: str, ts: str, gap: str = "121 days", late: str = "1 day") -> DataFrame:
    """First and last time and events of each session. Spark closes a session after a gap of the duration or more, so a batch
    rule of more than 120 days is 121 days here."""
    return timed(stream, ts, late).groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n")).drop("w")


def first_wins(stream: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    return timed(stream, ts, late).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, by: str, ts: str, window: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return timed(stream, ts, late).groupBy(by, w.alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def look_ahead(base: DataFrame, events: DataFrame, by: str, base_ts: str, event_ts: str, days: int, late: str = "1 day", event_by: str | None = None, carried: list[str] | None = None) -> DataFrame:
    """Pairs of a base row and an event of its key within (time, time + days]; an outer join, so rows without one are emitted
    when the watermark has passed their horizon, which is what censoring is in batch."""
    a = timed(base, base_ts, late).alias("a")
    b = timed(events.select(F.col(event_by or by).alias("_by"), F.col(event_ts).alias("_ts"), *(carried or [])), "_ts", late).alias("b")
    return a.join(b, F.expr(f"a.{by} = b._by AND b._ts > a.{base_ts} AND b._ts <= a.{base_ts} + INTERVAL {int(days)} DAYS"), "leftOuter")


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything there is now, written once; a restart from the same checkpoint goes on where it ended."""
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return q
