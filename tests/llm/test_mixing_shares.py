from pyspark.sql import functions as F

from tidemark.llm import mixing as M


def test_shortfall_is_reported(spark):
    df = spark.createDataFrame([(i, "w " * 10, "a" if i < 90 else "b") for i in range(100)], "doc_id long, text string, source string")
    got = {r.value: (round(r.target, 6), round(r.expected, 6)) for r in M.shares(M.mix(df, [F.col("source")], (0.0,), keep=0.5), (0.0,)).collect()}
    assert got == {"a": (0.5, 0.8), "b": (0.5, 0.2)}
