"""Quality rules by compression bands.

A text passes if its zstandard ratio (bytes in over bytes out) lies inside limits that depend on its
length, and if few of its bytes lie in fixed chunks whose own ratio is outside the limits for a
chunk. A high ratio means repetition, a low one noise such as encoded binary data. Beside this, plain
counts (symbols, repeated lines, repeated five-word windows) give a first verdict, which also rejects.

The lower limits lie between what was measured at zstd level 3 for random base64, printable ASCII and
CJK characters (cut by a blank or line end every 10 to 76 characters) and for label-1 texts in English,
German, French and Spanish. Below 128 bytes the two overlap, and there is no lower limit. Random hex has
the ratios of prose below 8,192 bytes, so it is rejected from there on only. Texts in scripts that were
not measured may need Bands of their own: fit_bands takes limits from the quantiles of texts that are known to be good.

Each row is judged by itself, so the operator neither shuffles nor gathers anything, and rows, order,
ties and copies need no care. Null and empty texts have zero words and are rejected; ratios are null.
An empty table gives an empty one. Columns other than the text are passed on (keep_good) or not looked at (judge).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.shared import small_batches


@dataclass(frozen=True)
class Bands:
    """(bytes below which it holds, lowest ratio, highest ratio), for whole texts by length."""

    whole: tuple[tuple[float, float, float], ...] = (
        (128, 0.0, 3.2), (160, 1.01, 3.2), (192, 1.045, 3.2), (256, 1.115, 3.2), (384, 1.19, 3.2), (512, 1.27, 3.2), (1024, 1.35, 3.5), (2048, 1.45, 3.5),
        (4096, 1.6, 4.0), (8192, 1.7, 4.0), (32768, 2.05, 4.5), (float("inf"), 2.05, 5.0),
    )
    chunk_bytes: int = 2048
    #: a last piece below this is judged with the whole text only
    least_chunk: int = 1024
    chunk: tuple[float, float] = (1.45, 4.5)
    #: the share of a text's bytes that may lie in chunks outside their band
    bad_share: float = 0.25
    level: int = 3
    min_words: int = 10
    repeat_percent: int = 20
    window: int = 5


SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SIGNALS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, whole_ratio double, bad_chunk_share double, kept boolean"


def _per_text(flag: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    at = np.flatnonzero(flag)
    return np.diff(np.searchsorted(at, offs))


def _dup_lines(data: np.ndarray, inside: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    feed = data == 10
    cut = W.distinct(np.concatenate([offs, np.flatnonzero(feed) + 1]))  # where lines begin; an empty last line has no word
    lines = _per_text(inside, cut) > 0
    begin, end = cut[:-1][lines], cut[1:][lines]
    if not len(begin):
        return np.zeros(n, np.int64)
    end = end - feed[end - 1]
    keep = np.zeros(len(data) + 1, np.int8)
    np.add.at(keep, begin, 1)
    np.add.at(keep, end, -1)
    at = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=at[1:])
    code, _ = W.coded(pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(data[np.cumsum(keep[:-1]).astype(bool)])]))
    text = np.searchsorted(offs, begin, side="right") - 1
    pair = W.distinct(text * (int(code.max()) + 1) + code)
    return np.bincount(text, minlength=n) - np.bincount(pair // (int(code.max()) + 1), minlength=n)


def _repeat_words(code: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Words that lie in k-word windows found twice or more in their text. Hashes only pick candidates; windows are compared word by word."""
    n, own = len(at) - 1, W.owners(at)
    m = len(code) - k + 1
    hit = np.zeros(len(code) + 1, np.int64)
    if m > 0:
        first = np.flatnonzero(own[:m] == own[k - 1 :])
        h = W.mix(own[first].astype(np.uint64) + np.uint64(1))
        for j in range(k):
            h = W.mix(h + code[first + j].astype(np.uint64))
        s = np.sort(h)
        twice = W.distinct(s[1:][s[1:] == s[:-1]])
        if len(twice):
            place = np.searchsorted(twice, h)
            first = first[twice[np.minimum(place, len(twice) - 1)] == h]
            cols = [own[first], *(code[first + j] for j in range(k))]
            order = np.lexsort(cols[::-1])
            same = np.ones(max(0, len(order) - 1), bool)
            for c in cols:
                same &= c[order][1:] == c[order][:-1]
            again = np.zeros(len(order), bool)
            again[1:] |= same
            again[:-1] |= same
            w = first[order[again]]
            np.add.at(hit, w, 1)
            np.add.at(hit, w + k, -1)
    return _per_text(np.cumsum(hit[:-1]) > 0, at) if len(code) else np.zeros(n, np.int64)


def _ratios(raw: bytes, bands: Bands, press: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    n = len(raw)
    whole = n / len(press.compress(raw))
    bad = 0
    for k in range(0, n, bands.chunk_bytes):
        piece = raw[k : k + bands.chunk_bytes]
        if len(piece) >= bands.least_chunk and not bands.chunk[0] <= len(piece) / len(press.compress(piece)) <= bands.chunk[1]:
            bad += len(piece)
    low, high = next((lo, hi) for below, lo, hi in bands.whole if n < below)
    return whole, bad / n, low <= whole <= high and bad <= bands.bad_share * n


def signals(col, bands: Bands = Bands()) -> dict[str, np.ndarray]:
    """All signals of a text column, by name, in the order of SIGNALS."""
    data, offs = W.buffers(col)
    words, at, _, _ = W.split(col, W.BLANK)
    _, inside = W.mask(data, W.BLANK)
    n = len(offs) - 1
    n_words, repeat = np.diff(at), _repeat_words(W.coded(words)[0].astype(np.int64), at, bands.window)
    failed = (n_words < bands.min_words) | (100 * repeat > bands.repeat_percent * n_words)
    press = zstandard.ZstdCompressor(level=bands.level)
    whole, share, kept = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, bool)
    for i in np.flatnonzero(np.diff(offs) > 0):
        whole[i], share[i], kept[i] = _ratios(data[offs[i] : offs[i + 1]].tobytes(), bands, press)
    return {
        "n_words": n_words, "word_chars": _per_text(inside & ((data & 0xC0) != 0x80), offs), "n_symbols": _per_text(SYMBOLS[data], offs),
        "n_dup_lines": _dup_lines(data, inside, offs), "n_repeat_words": repeat, "base_failed": failed, "whole_ratio": whole, "bad_chunk_share": share, "kept": kept & ~failed,
    }


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The key and all signals of every row."""
    small_batches(docs.sparkSession, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = signals(b.column(1), bands)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, from_pandas=v.dtype.kind == "f") for v in s.values())], names=["key", *s])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, {SIGNALS}").withColumnRenamed("key", key)


def fit_bands(docs: DataFrame, good: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 20_000, tail: float = 0.001, slack: float = 0.95, bands: Bands = Bands()) -> Bands:
    """Bands with the limits of `tail` and 1 - `tail` of good texts, widened by 1 / slack: by length of the whole text, and of chunks. good holds the keys of good
    texts; at most `sample` of them (those with the least hashes) are looked at. A length that fewer than 1 / tail of them have keeps the limits of `bands`."""
    small_batches(docs.sparkSession, 4)
    below = np.array([b for b, *_ in bands.whole])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=bands.level)
        for b in batches:
            data, offs = W.buffers(b.column(0))
            for i, j in zip(offs[:-1], offs[1:]):
                raw = data[i:j].tobytes()
                pieces = [x for k in range(0, len(raw), bands.chunk_bytes) if len(x := raw[k : k + bands.chunk_bytes]) >= bands.least_chunk]
                kind = [int(np.searchsorted(below, len(raw), side="right"))] + [-1] * len(pieces)
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int64()), pa.array([len(x) / len(press.compress(x)) for x in [raw, *pieces]], pa.float64())], names=["kind", "ratio"])

    chosen = good.select(F.col(key).alias("key")).dropna().distinct().orderBy(F.xxhash64("key"), "key").limit(sample)  # a bound that is a parameter
    some = docs.filter(F.octet_length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").select("text")
    at = F.percentile("ratio", F.array(F.lit(tail), F.lit(1 - tail)))
    found = {r.kind: (r.at[0] * slack, r.at[1] / slack) for r in some.mapInArrow(run, "kind long, ratio double").groupBy("kind").agg(at.alias("at"), F.count("*").alias("n")).filter(F.col("n") >= 1 / tail).collect()}
    return replace(bands, whole=tuple((b, *found.get(k, limits)) for k, (b, *limits) in enumerate(bands.whole)), chunk=found.get(-1, bands.chunk))


def keep_good(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of docs that pass, with all their columns as they are."""
    small_batches(docs.sparkSession, 4)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(signals(b.column(place), bands)["kept"]))

    return docs.mapInArrow(run, docs.schema)
