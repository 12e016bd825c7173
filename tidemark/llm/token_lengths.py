"""An exact histogram of encoded lengths, and what it answers for every context limit.

Documents are counted by their encoded length, so at most one row for each distinct length leaves a
task. Suffix sums over the histogram (within blocks of lengths, then over blocks) give, for each length
taken as a context limit: documents and ids up to and beyond it, the ids left if longer documents are
truncated, and the share of documents not longer, from which any quantile follows.

Null and empty texts have length 0 and count. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import small_batches, stored
from tidemark.llm.tokens import encoder


def lengths(docs: DataFrame, tokenizer: str, text: str = "text", pieces: bool = True) -> DataFrame:
    """length, n_docs: partial counts of each batch."""
    small_batches(docs.sparkSession, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, pieces)
        for b in batches:
            size, n = np.unique(np.diff(enc.column(b.column(0))[1]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), pa.array(n, pa.int64())], names=["length", "n_docs"])

    return docs.select(docs[text].alias("text")).mapInArrow(run, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def by_limit(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """For each length: n_docs of it, docs_from and tokens_from (that long or longer), docs_over, tokens_total, truncated_tokens, share_within."""
    h = stored(histogram, "lengths").withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / block))
    every = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).select(
        "block", *(F.coalesce(F.sum(c).over(every), F.lit(0)).alias(f"{c}_after") for c in "dt"), *(F.sum(c).over(whole).alias(f"{c}_all") for c in "dt")
    )
    inside = Window.partitionBy("block").orderBy("length").rowsBetween(0, Window.unboundedFollowing)
    x = h.select("length", "n_docs", "tokens", "block", F.sum("n_docs").over(inside).alias("d"), F.sum("tokens").over(inside).alias("t")).join(blocks, "block")
    docs_from, tokens_from = F.col("d") + F.col("d_after"), F.col("t") + F.col("t_after")
    return x.select(
        "length", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), (docs_from - F.col("n_docs")).alias("docs_over"), F.col("t_all").alias("tokens_total"),
        (F.col("t_all") - tokens_from + F.col("length") * docs_from).alias("truncated_tokens"),
        ((F.col("d_all") - docs_from + F.col("n_docs")) / F.col("d_all")).alias("share_within"),
    )


def quantile(limits: DataFrame, q: float) -> DataFrame:
    """The least length that a share q of all documents does not exceed."""
    return limits.filter(F.col("share_within") >= q).agg(F.min("length").alias("length"))


def truncated(limits: DataFrame, limit: int) -> DataFrame:
    """The ids left when documents are cut at any limit, also one that no document has as its length."""
    over = limits.filter(F.col("length") >= limit).agg(F.max("docs_from").alias("n"), F.max("tokens_from").alias("t"))
    return limits.agg(F.max("tokens_total").alias("all")).join(over).select((F.coalesce("all", F.lit(0)) - F.coalesce("t", F.lit(0)) + limit * F.coalesce("n", F.lit(0))).alias("truncated_tokens"))
