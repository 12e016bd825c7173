"""Streams give what the batch operators give, once the watermark has passed."""

from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators.temporal import sessions as batch_sessions
from tidemark.streaming import sessions as S

ROWS = [(i, dt(2024, 1, 1 + d, h), u) for i, (u, d, h) in enumerate([(1, 0, 1), (1, 0, 5), (1, 4, 0), (2, 1, 0), (2, 2, 0), (1, 5, 0), (2, 9, 0), (2, 9, 0)])]
END = [(900 + u, dt(2025, 1, 1), u) for u in (8, 9)]  # late events that move the watermark on
SCHEMA = "event_id long, ts timestamp_ntz, user_id long"


@pytest.fixture
def folder(spark, tmp_path):
    for k, rows in enumerate((ROWS[:4], ROWS[4:] + ROWS[:2], END)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    return tmp_path


def stream(spark, folder):
    return S.read_stream(spark, f"{folder}/in/*", SCHEMA)


def test_first_wins_and_restart(spark, folder):
    out = S.first_wins(stream(spark, folder), ["event_id"], "ts", "30 days")
    for _ in range(2):  # the second run starts from the checkpoint and adds nothing
        S.drain(out, f"{folder}/out", f"{folder}/state")
    got = sorted(r.event_id for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == sorted({r[0] for r in ROWS + END})


def test_sessions_equal_batch(spark, folder):
    once = S.first_wins(stream(spark, folder), ["event_id"], "ts", "30 days").select("event_id", "ts", "user_id")
    S.drain(once, f"{folder}/clean", f"{folder}/s1")
    clean = spark.read.parquet(f"{folder}/clean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    clean.orderBy("ts").coalesce(1).write.parquet(f"{folder}/sorted/0")
    spark.createDataFrame(END, SCHEMA).withColumn("ts", F.col("ts") + F.expr("INTERVAL 365 DAYS")).coalesce(1).write.parquet(f"{folder}/sorted/1")
    S.drain(S.sessions(S.read_stream(spark, f"{folder}/sorted/*", SCHEMA), "user_id", "ts", "3 days", "1 day"), f"{folder}/sessions", f"{folder}/s2")
    got = sorted((r.user_id, r.n) for r in spark.read.parquet(f"{folder}/sessions").collect() if r.user_id < 8)
    b = batch_sessions(clean, "user_id", "ts", 2, ["event_id"]).groupBy("user_id", "session_seq").count()
    assert got == sorted((r.user_id, r["count"]) for r in b.collect() if r.user_id < 8)


def test_look_ahead_emits_after_its_horizon(spark, folder):
    a = S.read_stream(spark, f"{folder}/in/*", SCHEMA)
    b = S.read_stream(spark, f"{folder}/in/*", SCHEMA)
    S.drain(S.look_ahead(a, b, "user_id", "ts", "ts", 3).select("event_id", "_ts"), f"{folder}/ahead", f"{folder}/s3")
    got = spark.read.parquet(f"{folder}/ahead").groupBy("event_id").agg(F.count("_ts").alias("n")).collect()
    hit = {r.event_id for r in got if r.n}
    assert {0, 2, 3} <= hit and not {5, 6, 7} & hit
