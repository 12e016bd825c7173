"""Connected components of a link table.

Distinct links are dealt out, and each task reduces its own to a spanning forest. If what is left is at most `at_once` links, one task
joins the forests (some 50 bytes a link); beyond that, alternating large and small stars run over all machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Scratch
from tidemark.llm.shared import stored as kept

AT_ONCE = 2_000_000


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links and the least node of each one's component."""
    node, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = np.arange(len(node))
    a, b = place[: len(a)], place[len(a) :]
    while len(a):
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        live = low < high
        a, b, low, high = a[live], b[live], low[live], high[live]
        np.minimum.at(up, high, low)
        while (up != up[up]).any():
            up = up[up]
    return node, node[up]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        x, y = _least(np.concatenate([a, *(h[0] for h in held)]), np.concatenate([b, *(h[1] for h in held)]))
        return x[x != y], y[x != y]

    for x in batches:
        held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
        if sum(len(h[0]) for h in held) > max(100_000, len(a)):
            a, b = reduced()
            held = []
    a, b = reduced()
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in _forest(batches):
        a, b = x.column(0).to_numpy(), x.column(1).to_numpy()
        root = np.unique(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, root])), pa.array(np.concatenate([b, root]))], names=["node", "label"])


def components(links: DataFrame, at_once: int = AT_ONCE, own: Scratch | None = None, rounds: int = 60) -> DataFrame:
    """node, label (the least node of its component) for all nodes of links(a, b). No link or label reaches the driver.
    own: where the tables go that are written, which then live as long as that."""
    stored = own.stored if own else kept
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().mapInArrow(_forest, "a long, b long"), "links")
    if edges.count() <= at_once:
        return stored(edges.repartition(1).mapInArrow(_labels, "node long, label long"), "labels")
    last = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = stored(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
