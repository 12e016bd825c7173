"""Benchmark decontamination by an FM-index for each training shard.

The words of a shard (some Arrow batches of one task, about `shard_words` words) become symbols; words
that occur in no test phrase are symbol 0. Every 0, and the end of every text, sorts as a sentinel of
its own, so suffixes are compared as far as the next 0 only. The Burrows-Wheeler transform is held as a
wavelet matrix of packed bits. All phrases of a block are searched backwards at once; occurrences are
located by walking to sampled suffix positions. A phrase is a window of `window` consecutive words of
an item, or all words of a shorter item. Spans of words inside occurrences are merged.

Test items come to the executors in blocks of at most `block_bytes` of text (one item at least), so
what is broadcast has a bound: some 15 times the text, as a window is ten 64-bit numbers. Each block is one pass over
the texts. Nothing else is gathered or shuffled with one block; with more, one row for each distinct text of an id and block is.

Null or empty texts have no words and no hits. Items without words have no window. Repeated rows are
treated alike (with more blocks, rows of equal key and text are counted and given out as often); repeated item ids count once for a text. A null item id is written as the empty string.
An empty table of texts gives an empty one, and without items nothing is hit. Other columns are passed on (drop_hit) or not
looked at (find), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.shared import small_batches

WINDOW, SHARD_WORDS, BLOCK_BYTES, SAMPLE = 10, 1_000_000, 4 << 20, 8


@dataclass
class Phrases:
    """Distinct windows of test items: symbols from 1, right-aligned in rows, and the items of each window."""

    vocabulary: pa.Array
    windows: np.ndarray
    lengths: np.ndarray
    items: list[str]
    item_at: np.ndarray
    item_of: np.ndarray


def phrases(items: list[tuple], window: int = WINDOW) -> Phrases | None:
    ids = ["" if i is None else str(i) for i, _ in items]
    words, at, _, _ = W.split(pa.array([t for _, t in items], pa.string()), W.ALNUM_LOWER)
    if not len(words):
        return None
    code, vocabulary = W.coded(words)
    sym, size = code.astype(np.int64) + 1, np.diff(at)
    rows, lengths, owner = [], [], []
    for i in np.flatnonzero(size):
        s, k = sym[at[i] : at[i + 1]], min(window, int(size[i]))
        w = np.lib.stride_tricks.sliding_window_view(s, k)
        rows.append(np.pad(w, ((0, 0), (window - k, 0))))
        lengths.append(np.full(len(w), k))
        owner.append(np.full(len(w), i))
    distinct, inverse = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    names = sorted(set(ids))
    place = {x: k for k, x in enumerate(names)}
    pairs = np.unique(np.stack([inverse.reshape(-1), np.array([place[ids[i]] for i in np.concatenate(owner)])], 1), axis=0)
    item_at = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
    return Phrases(vocabulary, distinct, (distinct > 0).sum(1), names, item_at, pairs[:, 1])


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """The suffix array of a text that ends with 0, where each 0 is a sentinel that sorts by position."""
    n = len(text)
    place = max(1, (n - 1).bit_length())
    step = max(1, (63 - place) // bits)
    key, alive = text.astype(np.int64), text != 0
    for j in range(1, step):
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - j)] = text[j:]
        key = (key << bits) | np.where(alive, ahead, 0)
        alive = alive & (ahead != 0)
    key = np.sort((key << place) | np.arange(n))
    order, key = key & ((1 << place) - 1), key >> place
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | ~alive[order[1:]]  # a suffix that has met a sentinel is told apart by position
    rank = np.empty(n, np.int64)
    while True:
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = head
        tied = ~new
        tied[:-1] |= tied[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            return order
        at = order[rows]
        second = rank[at + step]
        by = np.lexsort((at, second, head[rows]))
        order[rows] = at[by]
        h, s = head[rows], second[by]
        new[rows[1:]] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])  # equal ranks are those of tied suffixes, so no sentinel was met
        step *= 2


class Wavelet:
    """Ranks of symbols in a sequence: for each bit of the symbols, from the highest, a packed bit vector with counts."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.pad(packed, (0, 8 + -len(packed) % 8)).view(np.uint64)
            count = np.zeros(len(packed) + 1, np.int32)
            np.cumsum(np.bitwise_count(packed), out=count[1:])
            self.levels.append((level, packed, count, len(seq) - int(bit.sum())))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, packed, count, zeros in self.levels:
            word, rest = i >> 6, (i & 63).astype(np.uint64)
            ones = count[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << rest) - np.uint64(1)))
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return i


class Index:
    """An FM-index of a text of symbols that ends with 0."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        bits = max(1, int(symbols).bit_length())
        order = suffix_order(text, bits)
        before = np.concatenate([[0], text[:-1]])
        self.last = before[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.wavelet = Wavelet(self.last, bits)
        every = np.arange(symbols + 1)
        self.shift = self.first[:-1] - self.wavelet.place(every, np.zeros(symbols + 1, np.int64))
        kept = (order % sample == 0) | (self.last == 0)
        self.sampled, self.kept = order[kept], kept
        self.nth = np.cumsum(kept) - 1

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.shift[symbol] + self.wavelet.place(symbol, row)

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that occur, and their first and last-plus-one rows."""
        alive, c = np.arange(len(windows)), windows[:, -1]
        low, high = self.first[c], self.first[c + 1]
        for k in range(1, windows.shape[1] + 1):
            keep = high > low
            alive, low, high = alive[keep], low[keep], high[keep]
            if k == windows.shape[1] or not len(alive):
                break
            more = lengths[alive] > k
            c = windows[alive[more], -1 - k]
            low[more], high[more] = self.step(c, low[more]), self.step(c, high[more])
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row, by steps to the next sampled one."""
        out, todo, walked = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            hit = self.kept[rows]
            out[todo[hit]] = self.sampled[self.nth[rows[hit]]] + walked
            todo, rows = todo[~hit], rows[~hit]
            rows = self.step(self.last[rows], rows)
            walked += 1
        return out


def search_shard(col, p: Phrases, at_once: int = 1_000_000) -> list[dict]:
    """For each text of a column: words, hit words, items and the merged spans of words and bytes."""
    words, at, begin, end = W.split(col, W.ALNUM_LOWER)
    _, offs = W.buffers(col)
    n, size = len(at) - 1, np.diff(at)
    hit, pairs = np.zeros(len(words) + n + 1, np.int32), []
    if len(words) and p is not None:
        code, distinct = W.coded(words)
        found = pc.index_in(distinct, value_set=p.vocabulary.cast(distinct.type))
        symbol = np.where(np.asarray(found.is_valid()), np.asarray(pc.fill_null(found, 0)) + 1, 0)[code]
        text = np.zeros(len(words) + n, np.int64)
        text[np.arange(len(words)) + W.owners(at)] = symbol
        ends = np.cumsum(size + 1)
        index = Index(text, len(p.vocabulary))
        w, low, high = index.search(p.windows, p.lengths)
        upto = np.concatenate([[0], np.cumsum(high - low)])
        for a in range(0, int(upto[-1]), at_once):
            g = np.arange(a, min(a + at_once, int(upto[-1])))
            own = np.searchsorted(upto, g, side="right") - 1
            pos = index.locate(low[own] + g - upto[own])
            np.add.at(hit, pos, 1)
            np.add.at(hit, pos + p.lengths[w[own]], -1)
            pairs.append(np.unique(np.searchsorted(ends, pos, side="right") * len(p.windows) + w[own]))
    covered = np.cumsum(hit[:-1]) > 0
    items: list[set] = [set() for _ in range(n)]
    for pair in np.unique(np.concatenate(pairs)) if pairs else ():
        d, w = divmod(int(pair), len(p.windows))
        items[d].update(p.item_of[p.item_at[w] : p.item_at[w + 1]].tolist())
    out = []
    base = 0
    some = np.add.reduceat(np.append(covered, False).astype(np.int64), np.concatenate([[0], np.cumsum(size + 1)[:-1]])) if n else []
    for d in range(n):
        spans = []
        if some[d]:
            edge = np.diff(np.concatenate([[0], covered[base : base + size[d]].astype(np.int8), [0]]))
            for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                spans.append({"first_word": int(i), "end_word": int(j), "first_byte": int(begin[at[d] + i] - offs[d]), "end_byte": int(end[at[d] + j - 1] - offs[d])})
        out.append({"n_words": int(size[d]), "items": [p.items[k] for k in sorted(items[d])], "spans": spans})
        base += int(size[d]) + 1
    return out


FOUND = "n_words long, items array<string>, spans array<struct<first_word:long,end_word:long,first_byte:long,end_byte:long>>"


def _shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[pa.Table]:
    """Batches put together until they have about shard_words words (six bytes each)."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= 6 * shard_words:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def blocks(benchmark: DataFrame, key: str, text: str, window: int, block_bytes: int) -> Iterator[Phrases]:
    held, size = [], 0
    for r in benchmark.select(benchmark[key].cast("string").alias("k"), benchmark[text].alias("t")).toLocalIterator():
        held.append((r.k, r.t))
        size += len((r.t or "").encode())
        if size >= block_bytes:
            if p := phrases(held, window):
                yield p
            held, size = [], 0
    if held and (p := phrases(held, window)):
        yield p


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each row of docs: its key, n_words, the items found as sorted strings, and merged removal spans."""
    spark = docs.sparkSession
    small_batches(spark, 4)
    base = docs.select(docs[key].alias("key"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("th"))
    passes = []
    for p in blocks(benchmark, item_key, item_text, window, block_bytes):
        sent = spark.sparkContext.broadcast(p)
        passes.append(_one_pass(base, sent, shard_words))
    if not passes:
        passes = [_one_pass(base, None, shard_words)]
    if len(passes) == 1:
        return passes[0].drop("th").withColumnRenamed("key", key)
    # rows of equal key and text have equal results: one of them a pass, then all passes together, then as many as there were
    every = None
    for x in passes:
        x = x.groupBy("key", "th").agg(F.first("n_words").alias("n_words"), F.first("items").alias("items"), F.first("spans").alias("spans"), F.count("*").alias("rows"))
        every = x if every is None else every.unionByName(x)
    merged = every.groupBy("key", "th").agg(F.max("n_words").alias("n_words"), F.max("rows").alias("rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"))
    zero = F.array().cast("array<struct<first_word:long,end_word:long,first_byte:long,end_byte:long>>")

    def join(done, x):
        last = F.element_at(done, -1)
        wider = F.struct(last["first_word"].alias("first_word"), F.greatest(last["end_word"], x["end_word"]).alias("end_word"), last["first_byte"].alias("first_byte"), F.greatest(last["end_byte"], x["end_byte"]).alias("end_byte"))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end_word"] >= x["first_word"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(done, F.array(x)))

    out = merged.select(F.col("key").alias(key), "n_words", "items", F.aggregate("s", zero, join).alias("spans"), "rows")
    return out.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("rows")


def _one_pass(base: DataFrame, sent, shard_words: int) -> DataFrame:
    kind = base.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, schema = sent.value if sent else None, None
        for shard in _shards(batches, shard_words):
            found = search_shard(shard.column(1), p)
            schema = schema or pa.schema([("key", shard.schema.field(0).type), ("th", pa.int64()), ("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([(x, pa.int64()) for x in ("first_word", "end_word", "first_byte", "end_byte")])))])
            body = pa.Table.from_pylist(found, schema=pa.schema(list(schema)[2:]))
            yield from pa.Table.from_arrays([shard.column(0), shard.column(2), *body.columns], schema=schema).to_batches()

    return base.mapInArrow(run, f"key {kind}, th long, {FOUND}")


def n_hit(spans="spans"):
    return F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end_word"] - x["first_word"]), F.lit(0).cast("long"))


def drop_hit(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without any occurrence of a phrase, all columns as they are. One pass for each block of items over what the others left of a shard."""
    spark = docs.sparkSession
    small_batches(spark, 4)
    place = docs.columns.index(text)
    sent = [spark.sparkContext.broadcast(p) for p in blocks(benchmark, item_key, item_text, window, block_bytes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, shard_words):
            for block in sent:
                shard = shard.filter(pa.array([not x["items"] for x in search_shard(shard.column(place), block.value)], pa.bool_()))
                if len(sent) > 1:
                    vars(block).pop("_value", None)  # a worker holds one block at a time; it's read again from its own disk
            yield from shard.to_batches()

    return docs.mapInArrow(run, docs.schema) if sent else docs


def cut_spans(text: str, spans: list[dict]) -> str:
    """A text without its removal spans."""
    raw, out, at = text.encode(), b"", 0
    for s in spans:
        out += raw[at : s["first_byte"]]
        at = s["end_byte"]
    return (out + raw[at:]).decode()


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
