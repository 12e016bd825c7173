"""Words of whole texts, over Arrow columns at once.

A text column is seen as one byte buffer. A table of 256 entries maps each byte to its lower-case
form, or to 0 if it separates words; words are the runs between zeros. As separators are ASCII, this
equals the same split over code points. No Python object is made for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def _table(separators: set[int], lower: bool) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    t[sorted(separators)] = 0
    return t


_BLANK = {0x20, *range(0x09, 0x0E)}
#: words [^\x20\x09-\x0D]+; a NUL byte belongs to a word there, so it can't stand for a separator
BLANK_LOWER, BLANK = _table(_BLANK, True), _table(_BLANK, False)
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM_LOWER = _table({*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}, True)


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def mask(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mapped bytes, and which of them belong to words."""
    mapped = table[data]
    inside = mapped != 0
    if table[0] == 0 and table is not ALNUM_LOWER:
        inside |= data == 0
    return mapped, inside


def split(col, table: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All words of a column as one binary array, where each text's words begin in it (n + 1), and
    the words' first and last-plus-one byte positions in the column's buffer."""
    data, offs = buffers(col)
    mapped, inside = mask(data, table)
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    edge = np.empty(len(data) + 1, bool)
    edge[0] = True
    edge[-1] = True
    np.logical_not(inside[:-1], out=edge[1:-1]) if len(data) else None
    begin = np.flatnonzero(inside & (edge[:-1] | cut[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        np.logical_not(inside[1:], out=after[:-1])
        after[-1] = True
    end = np.flatnonzero(inside & (after | cut[1:])) + 1
    at = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=at[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(mapped[inside])])
    return words, np.searchsorted(begin, offs), begin, end


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A code for each word, and the distinct words by code."""
    d = words.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def hashed(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words, alike on every machine."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(x) for x in distinct.to_pylist()), np.uint64, len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def owners(at: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by a sort (np.unique alone goes by a hash table, which takes many times longer)."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]
