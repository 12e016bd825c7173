"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of `passage` words; only whole texts have labels. Each passage is encoded (shares of
kinds of signs, repetition, word lengths, hashed words; one tanh layer), gated attention gives each passage of a
text its weight, and the score is a logistic function of the weighted sum of the encodings. Encoder, attention
and output are learnt together from text labels by Adam on the log loss.

The model is fitted on the driver, on a bounded sample: of the labelled rows outside the held-out fold, those
`sample` with the least hash of doc_id; of a text with more than `bag` passages, `bag` evenly spaced ones train (features,
332 bytes a passage, are computed by the executors, so the driver gets sample * bag * 332 bytes at most, 127 MB by
default). Everything else is done for all rows and whole texts: a score looks at every passage. Scores use the text
alone. Null and empty texts are one empty passage and get a score too. Rows with a null label don't train;
repeated rows train and are scored each. An empty table gives an empty one; other columns are not looked at. Without labels of both kinds all scores are the share of label 1, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.shared import small_batches

PASSAGE, SAMPLE, BAG, BUCKETS, THRESHOLD = 128, 6000, 64, 64, 0.3

#: kinds of bytes: 0 other, then as listed
KINDS = np.zeros(256, np.uint8)
for _k, _signs in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t", b"\n", b".,;:", b"!?", b"#*$%&|<>", b"-_/\\=+~^@", b"\"'()[]{}`", range(0x80, 0xC0), range(0xC0, 0x100)), 1):
    KINDS[list(_signs)] = _k
N_KINDS = 13


def features(col, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and where each text's passages begin (n + 1)."""
    data, offs = W.buffers(col)
    words, at, begin, end = W.split(col, W.BLANK_LOWER)
    n, size = len(at) - 1, np.diff(at)
    bags = np.maximum(1, -(-size // passage))
    first = np.concatenate([[0], np.cumsum(bags)])
    own = W.owners(at)
    of = first[own] + (np.arange(len(own)) - at[own]) // passage
    m = int(first[-1])
    count = np.bincount(of, minlength=m)
    # a passage's bytes go from its first word to that of the next, and to the text's ends
    start = np.zeros(m, np.int64)
    lead = np.flatnonzero(np.diff(of, prepend=-1)) if len(of) else np.zeros(0, np.int64)
    start[of[lead]] = begin[lead]
    start[first[:-1]] = offs[:-1]
    length = np.diff(np.append(start, len(data)))
    kind, full = KINDS[data], np.flatnonzero(length > 0)
    out = np.zeros((m, N_KINDS + 6 + BUCKETS), np.float32)
    for k in range(N_KINDS if len(full) else 0):
        out[full, k] = np.add.reduceat((kind == k).view(np.uint8), start[full], dtype=np.int64) / length[full]
    if len(words):
        code, distinct = W.coded(words)
        pair, times = np.unique(of * len(distinct) + code, return_counts=True)
        at_pair = pair // len(distinct)
        kinds = np.bincount(at_pair, minlength=m)
        top = np.zeros(m, np.int64)
        np.maximum.at(top, at_pair, times)
        two = of[1:] == of[:-1]
        d = len(distinct)
        links = np.bincount(W.distinct((of[1:][two] * d + code[1:][two]) * d + code[:-1][two]) // (d * d), minlength=m)
        some = np.maximum(count, 1)
        out[:, N_KINDS] = kinds / some
        out[:, N_KINDS + 1] = top / some
        out[:, N_KINDS + 2] = links / some
        out[:, N_KINDS + 3] = np.bincount(of, weights=end - begin, minlength=m) / some / 16
        bucket = (W.hashed(distinct) % np.uint64(BUCKETS)).astype(np.int64)[code]
        out[:, N_KINDS + 6 :] = np.bincount(of * BUCKETS + bucket, minlength=m * BUCKETS).reshape(m, BUCKETS) / some[:, None]
    out[:, N_KINDS + 4] = np.log1p(count) / 5
    out[:, N_KINDS + 5] = np.log1p(length) / 7
    return out, first


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """x: scaled features of passages; first: where each bag begins."""
        w = self.w
        h = np.tanh(x @ w["enc"] + w["enc_b"])
        t, g = np.tanh(h @ w["att"] + w["att_b"]), 1 / (1 + np.exp(-(h @ w["gate"] + w["gate_b"])))
        e = (t * g) @ w["mix"]
        size = np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), size))
        a = e / np.repeat(np.add.reduceat(e, first[:-1]), size)
        z = np.add.reduceat(a[:, None] * h, first[:-1])
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out_b"], -30, 30)))}

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -5, 5)

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(first) - 1:
            return np.zeros(0)
        if not self.w:
            return np.full(len(first) - 1, self.mean[0])
        return self.forward(self.scaled(x), first)["p"]

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f, size = self.w, self.forward(x, first), np.diff(first)
        d = (f["p"] - y) / len(y)
        dz = np.outer(d, w["out"])
        dzr = np.repeat(dz, size, axis=0)
        da = (dzr * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first[:-1]), size))
        dt, dg = np.outer(de, w["mix"]) * f["g"], np.outer(de, w["mix"]) * f["t"]
        dt, dg = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dzr + dt @ w["att"].T + dg @ w["gate"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"enc": x.T @ dx, "enc_b": dx.sum(0), "att": f["h"].T @ dt, "att_b": dt.sum(0), "gate": f["h"].T @ dg, "gate_b": dg.sum(0), "mix": (f["t"] * f["g"]).T @ de, "out": f["z"].T @ d, "out_b": d.sum(keepdims=True)}


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, hidden: int = 32, gate: int = 16, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    if not len(y) or y.min() == y.max():
        return Model(np.array([y.mean() if len(y) else 0.5]), np.ones(1), {})
    r = np.random.default_rng(seed)
    d = x.shape[1]
    draw = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
    share = y.mean()
    model = Model(x.mean(0), x.std(0) + 1e-3, {"enc": draw(d, hidden), "enc_b": np.zeros(hidden), "att": draw(hidden, gate), "att_b": np.zeros(gate), "gate": draw(hidden, gate), "gate_b": np.zeros(gate), "mix": draw(gate), "out": draw(hidden), "out_b": np.array([np.log(share / (1 - share))])})
    x = model.scaled(x).astype(np.float64)
    m, v, step = {k: 0.0 for k in model.w}, {k: 0.0 for k in model.w}, 0
    for epoch in range(epochs):
        order = r.permutation(len(y))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in some])
            g = model.gradient(x[rows], np.concatenate([[0], np.cumsum(first[some + 1] - first[some])]), y[some])
            step += 1
            now = rate * (1 - epoch / epochs)
            for n in model.w:
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                v[n] = 0.999 * v[n] + 0.001 * g[n] ** 2
                model.w[n] = model.w[n] * (1 - now * decay) - now * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
    return model


def fold(key, folds: int):
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(folds))


def spaced(x: np.ndarray, most: int) -> np.ndarray:
    """All rows, or so many of them at even distances, the first and last among them."""
    return x if len(x) <= most else x[np.linspace(0, len(x) - 1, most).round().astype(np.int64)]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, sample: int = SAMPLE, bag: int = BAG, passage: int = PASSAGE) -> Model:
    small_batches(docs.sparkSession, 4)
    chosen = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(key, folds) != 0)).select(F.col(key).alias("key"), F.col(label).cast("double").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("key"), "key", "label").limit(sample)  # a bound that is a parameter
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, first = features(b.column(1), passage)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([spaced(x[i:j], bag).tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())], names=["label", "bag"])

    # sorted, so that the fit doesn't hang on the order in which tasks end
    got = sorted((r.label, bytes(r.bag)) for r in texts.mapInArrow(run, "label double, bag binary").toLocalIterator())
    bags = [np.frombuffer(raw, np.float32).reshape(-1, N_KINDS + 6 + BUCKETS) for _, raw in got]
    x = np.concatenate(bags) if bags else np.zeros((0, 1), np.float32)
    return fit(x, np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64), np.array([y for y, _ in got]))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", folds: int = 5, threshold: float = THRESHOLD, passage: int = PASSAGE) -> DataFrame:
    """key, held_out, score, predicted of every row."""
    spark = docs.sparkSession
    small_batches(spark, 4)
    sent = spark.sparkContext.broadcast(model)
    base = docs.select(F.col(key).alias("key"), (fold(key, folds) == 0).alias("held_out"), F.col(text).alias("text"))
    kind = base.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.score(*features(b.column(2), passage))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array(s >= threshold).cast(pa.int32())], names=["key", "held_out", "score", "predicted"])

    return base.mapInArrow(run, f"key {kind}, held_out boolean, score double, predicted int").withColumnRenamed("key", key)
