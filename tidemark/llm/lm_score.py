"""Language-model scoring by a weighted backoff automaton.

Texts are packed into blocks of about `block_bytes` (one longer text is a block), which are written once. A block counts its
own n-grams and sends them, as sorted hashes dealt into hash ranges, to shards; a shard adds up what all blocks sent and
answers each block with the totals of just the n-grams that this block holds. So a block learns the slice of the model
that its texts can meet, a common n-gram crosses the network once a block, and neither side holds more than a block or
a shard (a shard gets a message from each block that holds one of its n-grams). (Hashes stand for n-grams, 64 bits for words
and pairs and 56 for longer ones: among V of those, a share of V / 7.2e16 has the hash of another one, 1.4e-4 at 10^13,
which some 100 TB of text have.) The number of blocks and of shards grows with the input.

The slice becomes an automaton. States are the histories seen in training, arcs the n-grams seen, and a failure
arc leads from each history to the same without its first word. The smoothing is a Dirichlet prior: the
probability of w after h is (c(hw) + strength * p(w | shorter h)) / (c(h) + strength), and that of a word alone is
(c(w) + 0.1) / (N + 0.1 * (V + 1)), so an arc weighs log10 of the former and a failure arc log10 of
strength / (c(h) + strength). One left-to-right traversal of all texts of a block, abreast, carries the state of each
text and adds up log10 probabilities; it starts in the state for the start of a text and ends with an end token.

Null and empty texts are an end token alone. Rows whose crc32(key as text) mod `folds` is 0 are held out;
a null key counts as the empty text there. Repeated rows count and are scored each. If no row trains, all counts are 0.
An empty table gives an empty one. Columns other than key and text are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.shared import give_back, small_batches, stored

ORDER, STRENGTH, FLOOR = 3, 100.0, 0.1
BLOCK_BYTES, SHARD_GRAMS = 8 << 20, 1_000_000
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
COUNTS = "shard long, level long, block long, grams binary, counts binary"


class Places:
    """The places of some texts one after another: start, words, end of each. hashes[k]: of the n-gram of k + 1 tokens that ends
    at a place; `inside` tells how far a place is from its text's start, and so which n-grams there are."""

    def __init__(self, col, order: int):
        words, at, _, _ = W.split(col, W.BLANK_LOWER)
        size = np.diff(at) + 2
        self.n, self.begin = len(at) - 1, np.concatenate([[0], np.cumsum(size)])
        h = np.empty(self.begin[-1], np.uint64)
        h[self.begin[:-1]], h[self.begin[1:] - 1] = START, END
        if len(words):
            code, distinct = W.coded(words)
            h[np.arange(len(words)) + 2 * W.owners(at) + 1] = W.hashed(distinct)[code]
        self.inside = np.arange(len(h)) - np.repeat(self.begin[:-1], size)
        self.hashes = [W.mix(h)]
        for _ in range(1, order):
            self.hashes.append(np.concatenate([self.hashes[-1][:1], W.mix(self.hashes[-1][:-1] * np.uint64(31) + h[1:])]))
        self.hashes[2:] = [x & ~np.uint64(255) for x in self.hashes[2:]]  # the last byte then takes no room in messages

    def counted(self, train: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each level the sorted n-grams, and how often each occurs in the texts that train."""
        seen = np.repeat(train, np.diff(self.begin))
        for k, h in enumerate(self.hashes):
            there = self.inside >= k
            grams = W.distinct(h[there])
            some, n = np.unique(h[there & seen], return_counts=True)
            counts = np.zeros(len(grams), np.int64)
            counts[np.searchsorted(grams, some)] = n
            yield grams, counts


class Block(Places):
    """For level k, `code[k]` is the number of the n-gram that ends at each place (-1: none), `grams[k]` are the n-grams by
    number, which is the order of their hashes, and `first[k]` a place where each ends."""

    def __init__(self, col, order: int):
        super().__init__(col, order)
        self.code, self.grams, self.first = [], [], []
        for k, h in enumerate(self.hashes):
            there = np.flatnonzero(self.inside >= k)
            by = np.argsort(h[there])
            s = h[there][by]
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            code = np.full(len(h), -1, np.int64)
            code[there[by]] = np.cumsum(new) - 1
            self.code.append(code)
            self.grams.append(s[new])
            self.first.append(there[by[new]])


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of hashes, in their order."""
    return (((grams >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the first bytes of all first: high bytes are mostly 0 and take hardly any room."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _unplanes(x: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack(x: np.ndarray) -> bytes:
    return _planes(x.astype(np.uint32))


def _unpack(x: bytes) -> np.ndarray:
    return _unplanes(x, np.uint32).astype(np.int64)


def _pack_sorted(x: np.ndarray) -> bytes:
    return _planes(np.diff(x, prepend=np.zeros(1, np.uint64)))


def _unpack_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(x, np.uint64), dtype=np.uint64)


def _blob(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _unblob(x: bytes) -> pa.Table:
    return pa.ipc.open_stream(x).read_all()


class Automaton:
    """States are the root and the histories that training has seen; a history is known by its length and the place behind
    it. weight[k] holds the arcs that n-grams of k + 1 tokens are (0 or more: there is none), each to the state of its last
    tokens; fail[k] the failure arcs of histories of k tokens, to the same without the first one. The root has an arc for
    every token."""

    def __init__(self, block: Block, totals: list[np.ndarray], tokens: int, kinds: int, strength: float, floor: float):
        self.block, self.order = block, len(totals)
        p = (totals[0] + floor) / (tokens + floor * (kinds + 1))
        self.weight, self.fail = [np.log10(p)], [np.zeros(0)]
        for k in range(1, self.order):
            last = block.first[k]
            p = (totals[k] + strength * p[block.code[k - 1][last]]) / (totals[k - 1][block.code[k - 1][last - 1]] + strength)
            self.weight.append(np.where(totals[k] > 0, np.log10(p), 1.0))
            self.fail.append(np.log10(strength / (totals[k - 1] + strength)))
        self.known = totals[0] > 0

    def scores(self) -> np.ndarray:
        """log10 probabilities of all texts: all go one token further at each step, the longest first in line."""
        b, top = self.block, self.order - 1
        size = np.diff(b.begin) - 1  # tokens, with the end
        line = np.argsort(-size, kind="stable")
        place, left = b.begin[:-1][line], size[line]
        weight = [w[c] for w, c in zip(self.weight, b.code)]  # by place; what stands where there's no n-gram is never read
        fail = [f[b.code[k - 1]] if k else f for k, f in enumerate(self.fail)]
        known = self.known[b.code[0]]
        score, length = np.zeros(b.n), np.zeros(b.n, np.int64)  # the state of a text is the length of its history
        if top and b.n:
            length[:] = known[place]
        ends = np.searchsorted(-left, -np.arange(1, (left[0] if b.n else 0) + 1), side="right")
        for t, m in enumerate(ends.tolist()):
            at = place[:m] + t + 1
            for k in range(top, 0, -1):
                here = np.flatnonzero(length[:m] == k)
                if not len(here):
                    continue
                w = weight[k][at[here]]
                hit = w <= 0
                score[here[hit]] += w[hit]
                length[here[hit]] = -min(k + 1, top) - 1  # done with this token
                miss = here[~hit]
                score[miss] += fail[k][at[miss] - 1]
                length[miss] = k - 1
            here = np.flatnonzero(length[:m] == 0)
            score[here] += weight[0][at[here]]
            length[here] = -(known[at[here]] & (top > 0)).astype(np.int64) - 1
            length[:m] = -length[:m] - 1
        out = np.empty(b.n)
        out[line] = score
        return out


def held_out(key, folds: int):
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(folds)) == 0


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10, order: int = ORDER, strength: float = STRENGTH, floor: float = FLOOR, block_bytes: int = BLOCK_BYTES, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, learnt from the rows that aren't held out."""
    spark = docs.sparkSession
    small_batches(spark, 4)
    base = docs.select(docs[key].alias("key"), docs[text].alias("text"), held_out(key, folds).alias("held_out"))
    kind = base.schema["key"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """block, its rows, and how many bytes their texts have."""
        no, held, size = TaskContext.get().partitionId() << 32, [], 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), pa.array([_blob(pa.Table.from_batches(held))], pa.binary()), pa.array([size], pa.int64())], names=["block", "rows", "bytes"])

        for b in batches:
            upto = np.cumsum(np.diff(W.buffers(b.column(1))[1]) + 8)  # so that empty texts take room too
            i = 0
            while i < b.num_rows:
                before = int(upto[i - 1]) if i else 0
                j = max(i + 1, int(np.searchsorted(upto, before + block_bytes - size, side="right")))  # up to which the block has room
                if held and int(upto[j - 1]) - before + size > block_bytes:
                    yield packed()
                    no, held, size = no + 1, [], 0
                    continue
                held.append(b.slice(i, j - i))
                size += int(upto[j - 1]) - before
                i = j
        if held:
            yield packed()

    blocks = stored(base.mapInArrow(pack, "block long, rows binary, bytes long"), "blocks")
    size = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    shards = max(1, -(-size * order // (6 * shard_grams)))  # some six bytes a word

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, raw in zip(b.column(0).to_pylist(), b.column(1)):
                yield from asked(no, _unblob(raw.as_buffer()))
                give_back()

    def asked(no: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
        for level, (grams, counts) in enumerate(Places(t.column(1), order).counted(~t.column(2).to_numpy())):
            if not len(grams):
                continue
            shard = shard_of(grams, shards)
            cut = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(grams)]
            n = len(cut) - 1
            yield pa.RecordBatch.from_arrays([pa.array(shard[cut[:-1]]), pa.array([level] * n, pa.int64()), pa.array([no] * n, pa.int64()), pa.array([_pack_sorted(grams[i:j]) for i, j in zip(cut[:-1], cut[1:])], pa.binary()), pa.array([_pack(counts[i:j]) for i, j in zip(cut[:-1], cut[1:])], pa.binary())], names=["shard", "level", "block", "grams", "counts"])

    def answer(t: pa.Table) -> pa.Table:
        """The totals of a shard and level for each block, and (block -1) their sum and how many are above 0, without the start mark's."""
        grams = [_unpack_sorted(x) for x in t.column("grams").to_pylist()]
        counts = np.concatenate([_unpack(x) for x in t.column("counts").to_pylist()])
        every = W.distinct(np.concatenate(grams))
        total = np.zeros(len(every), np.int64)
        place = [np.searchsorted(every, g) for g in grams]
        np.add.at(total, np.concatenate(place), counts)
        own = total[every != W.mix(np.array([START]))[0]]
        shard, level, n = t.column("shard")[0].as_py(), t.column("level")[0].as_py(), len(grams)
        return pa.table({
            "block": pa.array([-1, *t.column("block").to_pylist()], pa.int64()), "level": pa.array([level] * (n + 1), pa.int64()), "shard": pa.array([shard] * (n + 1), pa.int64()),
            "totals": pa.array([None, *(_pack(total[p]) for p in place)], pa.binary()), "tokens": pa.array([int(own.sum())] + [None] * n, pa.int64()), "kinds": pa.array([int((own > 0).sum())] + [None] * n, pa.int64()),
        })

    asks = blocks.select("block", "rows").mapInArrow(ask, COUNTS)
    answers = stored(asks.groupBy("shard", "level").applyInArrow(answer, "block long, level long, shard long, totals binary, tokens long, kinds long"), "totals")
    tokens, kinds = answers.filter("block = -1 and level = 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _unblob(left.column("rows").combine_chunks()[0].as_buffer())
        x = Block(left.column(1), order)
        parts: list[list] = [[] for _ in range(order)]
        for level, shard, raw in sorted(zip(right.column("level").to_pylist(), right.column("shard").to_pylist(), right.column("totals").to_pylist())):
            parts[level].append(_unpack(raw))
        totals = [np.concatenate(p or [np.zeros(0, np.int64)]) for p in parts]
        if [len(p) for p in totals] != [len(g) for g in x.grams]:
            raise RuntimeError("a block did not get the totals of all its n-grams")
        tokens_at = np.ones(x.begin[-1], bool)
        tokens_at[x.begin[:-1]] = False
        c = totals[0][x.code[0]]
        log = np.where(tokens_at, np.log10((c + floor) / (tokens + floor * (kinds + 1))), 0.0)
        score = pa.array(Automaton(x, totals, tokens, kinds, strength, floor).scores())
        out = pa.table({
            "key": left.column(0), "held_out": left.column(2), "n_tokens": pa.array(np.diff(x.begin) - 1), "n_known": pa.array(np.add.reduceat(((c > 0) & tokens_at).astype(np.int64), x.begin[:-1])),
            "train_tokens": pa.array([tokens] * x.n, pa.int64()), "base_score": pa.array(np.add.reduceat(log, x.begin[:-1])), "score": score,
        })
        del x, totals, parts, c, log, score
        give_back()
        return out

    out = blocks.select("block", "rows").groupBy("block").cogroup(answers.filter("block >= 0").select("block", "level", "shard", "totals").groupBy("block")).applyInArrow(scored, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)
