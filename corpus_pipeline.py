"""From raw documents to token files, in five stages.

Each stage is a function of (spark, docs, sf_dir); its rows are written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. The first rejects by quality rules, the second keeps one
document of each group of near duplicates (five-word shingles, similarity 0.8), the third drops documents that hold
a passage of the benchmark, the fourth samples to the mixture's weights, and the last writes token files and returns
what it reads back from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard_join, mixing, quality_rules, token_store, tokens
from tidemark.llm.shared import stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, k=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_hit(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs, [F.col("source"), F.col("lang"), mixing.style("text")], (0.5, 0.7, 0.5), keep=0.5)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _, rows = token_store.store(docs, tokens.default_path())
    return token_store.checksums(rows)


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", write_tokens),
]

#: SQL has neither zstandard nor the tokenizer; tests/llm/test_pipeline.py holds a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k + 1}")
    return docs
