"""Token ids of whole texts by a public tokenizer file of the tokenizers library.

A byte-level BPE splits a text by its pattern before it merges, and no piece of that pattern has a
blank after something else, nor a sign after a letter. So a text may be cut before a blank (space or line
feed) that follows an ASCII sign or a Latin-1 letter, and between a letter and an ASCII sign, and the pieces encode to the same ids as the whole. Pieces repeat, so
each distinct piece of a batch is encoded once, and a bounded store keeps the first ones for later
batches. For other kinds of tokenizers, set `pieces` to false: texts are then encoded one by one.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from tidemark.llm import words as W


_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


class Encoder:
    def __init__(self, path: str, pieces: bool = True, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.pieces, self.most = Tokenizer.from_file(path), pieces, most
        self.whole = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]  # strings that are one token wherever they stand
        self.slot: dict[bytes, int] = {}
        self.pool, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out, sizes = [], []
        for k in range(0, len(raw), 4000):
            got = [x.ids for x in self.tokenizer.encode_batch_fast([x.decode() for x in raw[k : k + 4000]], add_special_tokens=False)]
            sizes += map(len, got)
            out.append(np.fromiter((i for x in got for i in x), np.uint32))
        return np.concatenate(out or [np.zeros(0, np.uint32)]), np.array(sizes, np.int64)

    def _distinct(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct pieces: a pool of ids, and where each piece's ids begin in it and how many they are."""
        place = np.fromiter((self.slot.get(x, -1) for x in raw), np.int64, len(raw))
        new = np.flatnonzero(place < 0)
        ids, size = self._encode([raw[i] for i in new])
        begin = np.empty(len(raw), np.int64)
        length = np.empty(len(raw), np.int64)
        old = place >= 0
        begin[old], length[old] = self.begin[place[old]], self.size[place[old]]
        own = np.cumsum(size) - size
        begin[new], length[new] = own + len(self.pool), size
        pool = np.concatenate([self.pool, ids])
        room = min(len(new), self.most - len(self.slot))
        if room > 0:
            base = len(self.slot)
            self.slot.update((raw[i], base + k) for k, i in enumerate(new[:room]))
            self.begin = np.concatenate([self.begin, own[:room] + len(self.pool)])
            self.size = np.concatenate([self.size, size[:room]])
            self.pool = np.concatenate([self.pool, ids[: size[:room].sum()]])
        return pool, begin, length

    def column(self, col) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column one after another, and where each text's begin (n + 1). Null: none."""
        data, offs = W.buffers(col)
        if not self.pieces:
            ids, size = self._encode([data[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:])])
            return ids, np.concatenate([[0], np.cumsum(size)])
        safe = (data > 0x20) & (data < 0x7F)
        safe[1:] |= (data[1:] >= 0x80) & (data[:-1] == 0xC3)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = ((data[1:] == 0x20) | (data[1:] == 0x0A)) & safe[:-1]
        letter = _LETTER[data]
        letter[1:] |= safe[1:] & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut[1:-1] |= _SIGN[data[1:]] & letter[:-1]
        raw = data.tobytes() if self.whole else b""
        for word in self.whole:
            at = raw.find(word)
            while at >= 0:
                cut[at + 1 : at + len(word)] = False
                at = raw.find(word, at + 1)
        cut[offs] = True
        cut[-1] = False
        at = np.flatnonzero(cut)
        piece = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(data)])
        code, distinct = W.coded(piece)
        pool, begin, length = self._distinct(distinct.to_pylist())
        size = length[code]
        upto = np.concatenate([[0], np.cumsum(size)])
        at_pool = np.repeat(begin[code] - upto[:-1], size)
        at_pool += np.arange(upto[-1])
        ids = pool[at_pool]
        pa.default_memory_pool().release_unused()
        return ids, upto[np.searchsorted(at, offs)]


_KEPT: dict[tuple, Encoder] = {}


def encoder(path: str, pieces: bool = True) -> Encoder:
    """One encoder for a worker process and file."""
    if (path, pieces) not in _KEPT:
        _KEPT[path, pieces] = Encoder(path, pieces)
    return _KEPT[path, pieces]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
