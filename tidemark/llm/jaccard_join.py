"""Self-join of texts by the Jaccard similarity of their word shingles, exact for any threshold.

A set is held as sorted 64-bit hashes of its shingles; texts with equal sets form one class at once. Sets are put
into size bands (a set near the next band into that as well, so linked sets meet in one). Bands alone would leave all
pairs of a band to compare, so each band's sets are first brought together by pieces of their hashed signatures:

* Linked sets differ in at most d = (1 - t) / (1 + t) of their sizes' sum. All shingles of a set are dealt by hash into
  p parts of three pieces each. Two of a part's pieces are equal if at most one shingle of it differs, so of the 3 p
  pairs of pieces linked sets have at least 2 p - d in common, whatever differs; p is chosen so that this exceeds the
  pairs that are empty in both. A streaming pass over sorted pair hashes keeps those that sets share; sets that share
  fewer than a link needs are dropped, exactly. A small set with too many empty pairs is also entered by its
  smallest shingle hashes (of n, as many as a linked set can lack, and one).
* Components of what is left are clusters, outside of which no link can be. In a cluster, sets are compared in tiles
  of neighbouring size: hashed bitmaps bound the overlap of two sets from above by counting bits, and what the bound
  leaves is decided by intersecting sorted arrays. Only links that join something new are kept.
* Clusters above `tile` sets (or TILE_ELEMENTS shingles) are not held by one task. A few of their sets are tried
  against all of them, a few times; sets that are then still apart are compared in tiles (a size band, then a hash)
  of bitmaps, each pair of tiles in a task of its own; of what the bound leaves, one pair for each set and component is
  intersected first, and then the pairs that are still apart.

(Up to `broadcast_rows` candidates, their ids are broadcast to pick their texts; beyond that they are joined by a shuffle.)

Null and empty texts, and those without words, have empty sets and are linked with nothing. A text with
fewer words than a shingle has its whole sequence as its only one. Repeated rows, also of one doc_id, are
each returned; a null doc_id never becomes a component's id unless all its members have none. Texts are found
again by key and 64-bit hash, never by their place, so the input may be read in another order each time. Columns other
than key and text are not looked at, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.components import AT_ONCE, components
from tidemark.llm.shared import Scratch, fresh, small_batches, stored

SHINGLE, PERCENT, TILE, BROADCAST_ROWS, TILE_BITS = 3, 90, 512, 1_000_000, 63
TILE_ELEMENTS, LEAD_ROUNDS = 8 << 20, 3


def shingle_sets(col, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts one after another, and where each text's begin (n + 1)."""
    words, at, _, _ = W.split(col, W.BLANK_LOWER)
    n, size = len(at) - 1, np.diff(at)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    code, distinct = W.coded(words)
    h = W.hashed(distinct)[code]
    own = W.owners(at)
    m = np.maximum(size - k + 1, (size > 0).astype(np.int64))
    first = at[:-1].repeat(m) + np.arange(m.sum()) - (np.cumsum(m) - m).repeat(m)
    sh = W.mix(np.minimum(size, k).repeat(m).astype(np.uint64))
    for j in range(k):
        there = np.minimum(first + j, len(h) - 1)
        sh = np.where((first + j < len(h)) & (own[there] == own[first]), W.mix(sh * np.uint64(31) + h[there]), sh)
    doc = np.repeat(np.arange(n), m)
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    return sh[new], np.searchsorted(doc[new], np.arange(n + 1))


def common(parts: int, differ: int) -> int:
    """The least number of pairs of pieces that sets have in common which differ in so many elements: the first one in a part costs two
    of its three pairs, the second the last one."""
    return 3 * parts - 2 * differ if differ <= parts else 2 * parts - differ


def bands(percent: int, limit: int = 1 << 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least size of each band, the differences that linked sets of its tile may have, and the parts it is dealt into:
    so many that the pairs in common are more than those that stay empty in the smallest set, with a margin, or as near to it as can be."""
    low = [1]
    while low[-1] < limit:
        low.append(low[-1] + max(1, low[-1] // 2))
    low = np.array(low, np.int64)
    differ = (2 * (low[1:] - 1) * (100 - percent)) // (100 + percent)
    parts = []
    for k, d in zip((-(-percent * low[:-1] // 100)).tolist(), differ.tolist()):
        best, p = (-math.inf, 1), d // 2 + 1
        while p < 2 * d + 2:
            e = 3 * p * math.exp(-2 * k / (3 * p))
            margin = common(p, d) - 1 - e - 3 * math.sqrt(e)
            best = max(best, (margin, -p))
            if margin > 0:
                break
            p += max(1, p // 64)
        parts.append(abs(best[1]))
    return low, differ, np.array(parts)


def part_hashes(sh: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """For each set, hashes of its pairs of pieces in its own tile and, if it is near the next band, in that; with the set of each.
    Then, for each set and tile: the set, the tile, and how many of the hashes it shares at least with any linked set there."""
    low, differ, parts = bands(percent)
    size = np.diff(at)
    own = np.searchsorted(low, size, side="right") - 1
    up = (size > 0) & (100 * size >= percent * low[np.minimum(own + 1, len(low) - 1)])
    doc = np.concatenate([np.flatnonzero(size > 0), np.flatnonzero(up)])
    tile = np.concatenate([own[size > 0], own[up] + 1])
    keep = differ[tile] > 0  # else only equal sets are linked
    doc, tile = doc[keep], tile[keep]
    p, n = parts[tile], size[doc]
    base = 3 * (np.cumsum(p) - p)
    x = W.mix(sh[_places(at[doc], n)] + np.repeat(tile.astype(np.uint64), n))
    slot = np.repeat(base, n) + ((x >> np.uint64(32)) % np.repeat(3 * p, n).astype(np.uint64)).astype(np.int64)
    total = int(3 * p.sum())
    value, count = np.zeros(total, np.uint64), np.bincount(slot, minlength=total)
    np.add.at(value, slot, W.mix(x))
    piece = np.arange(total)
    nxt = np.where(piece % 3 == 2, piece - 2, piece + 1)  # the pairs of a part: 0 and 1, 1 and 2, 2 and 0
    line = np.repeat(np.arange(len(doc)), 3 * p)
    sig = W.mix(W.mix(value) * np.uint64(3) + W.mix(value[nxt]) + W.mix((tile[line] << 32).astype(np.uint64) + (piece - base[line] + 1).astype(np.uint64)))
    full = count + count[nxt] > 0
    empty = np.bincount(line, weights=~full, minlength=len(doc)).astype(np.int64)
    least = np.where(differ[tile] <= p, 3 * p - 2 * differ[tile], 2 * p - differ[tile])
    spare = least - empty  # a linked set shares at least so many pairs that aren't empty
    many = spare <= 0  # so many empty pairs that the common ones may be among them
    few = n[many] - -(-percent * n[many] // 100) + 1
    first = W.mix(W.mix(sh[_places(at[doc[many]], few)]) + np.repeat(tile[many].astype(np.uint64) + np.uint64(1 << 60), few))
    sig = np.concatenate([_tagged(sig[full], tile[line[full]]), _tagged(first, np.repeat(tile[many], few))])
    return sig, np.concatenate([doc[line[full]], np.repeat(doc[many], few)]), doc, tile, np.maximum(spare, 1)


def _places(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where the first n elements of sets lie that begin at these places."""
    return np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _tagged(sig: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Hashes whose lowest six bits are the tile."""
    return (sig & ~np.uint64(TILE_BITS)) | tile.astype(np.uint64)


def _identity(sh: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    out = []
    for salt in (1, 2):
        total = np.zeros(len(at), np.uint64)
        np.add.at(total, W.owners(at), W.mix(sh + np.uint64(salt)))
        out.append(W.mix(total[:-1] + np.diff(at).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def overlap_bound(nx: int, bx: np.ndarray, n: np.ndarray, b: np.ndarray) -> np.ndarray:
    """No overlap of set x with the others is larger: a bit that only one side has is an element that only that side has."""
    return np.minimum(nx - np.bitwise_count(bx & ~b).sum(1, dtype=np.int64), n - np.bitwise_count(b & ~bx).sum(1, dtype=np.int64))


def bitmap(s: np.ndarray, width: int) -> np.ndarray:
    bit = np.zeros(width, bool)
    bit[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bit).view(np.uint64)


def width_of(n: int, at_most: int = 1 << 15) -> int:
    return min(at_most, max(64, 1 << (2 * n - 1).bit_length()))


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    width = width_of(max(map(len, sets)))
    return np.stack([bitmap(s, width) for s in sets])


def folded(b: np.ndarray, words: int) -> np.ndarray:
    """A bitmap as it would be with fewer words: bits that then fall together are joined."""
    while len(b) > words:
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return b


def linked(x: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets are linked to x, by intersection of sorted arrays."""
    size = np.array([len(o) for o in others])
    every = np.concatenate(others)
    place = np.searchsorted(x, every)
    place[place == len(x)] = 0
    same = np.add.reduceat((x[place] == every).astype(np.int64), np.cumsum(size) - size)
    return 100 * same >= percent * (len(x) + size - same)


def tile_links(sets: list[np.ndarray], percent: int, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the components of these sets: each set that is reached looks for links among those not reached yet.
    group: sets known to be in one component, reached together."""
    n = np.array([len(s) for s in sets])
    bits = bitmaps(sets)
    group = np.arange(len(sets)) if group is None else group
    left = np.ones(len(sets), bool)
    members = {}
    for i in np.argsort(group, kind="stable"):
        members.setdefault(int(group[i]), []).append(int(i))
    out = []
    for seed in np.argsort(n, kind="stable"):
        if not left[seed]:
            continue
        todo = list(members[int(group[seed])])
        left[todo] = False
        while todo:
            x = todo.pop()
            rest = np.flatnonzero(left & (100 * n >= percent * n[x]) & (percent * n <= 100 * n[x]))
            rest = rest[(100 + percent) * overlap_bound(n[x], bits[x], n[rest], bits[rest]) >= percent * (n[x] + n[rest])]
            for k in range(0, len(rest), 256):
                few = rest[k : k + 256]
                for y in few[linked(sets[x], [sets[i] for i in few], percent)]:
                    out.append((int(x), int(y)))
                    if left[y]:
                        todo += members[int(group[y])]
                        left[members[int(group[y])]] = False
    return out


def _arrays(col) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in col.to_pylist()]


def sets_of(docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """key, th (a hash of the text), n, cid and chk (two hashes of the set; null if it is empty), and by tile how many part hashes it must share."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sh, at = shingle_sets(b.column(2), k)
            cid, chk = _identity(sh, at)
            size = np.diff(at)
            _, _, doc, tile, need = part_hashes(sh, at, percent)
            by = np.argsort(doc, kind="stable")
            upto = pa.array(np.searchsorted(doc[by], np.arange(len(size) + 1)), pa.int32())
            tiles = pa.ListArray.from_arrays(upto, pa.array((need[by] << 6) | tile[by], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(cid, mask=size == 0), pa.array(chk, mask=size == 0), tiles], names=["key", "th", "n", "cid", "chk", "tiles"])

    base = docs.select(docs[key].alias("key"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("text"))
    return base.mapInArrow(run, f"key {kind}, th long, n long, cid long, chk long, tiles array<long>")


def parts_of(docs: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """sig, cid: the part hashes of the first row of each set in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            sh, at = shingle_sets(b.column(0), k)
            cid, _ = _identity(sh, at)
            size, own = np.diff(at), []
            for i, c in enumerate(cid.tolist()):
                if size[i] and c not in seen:
                    seen.add(c)
                    own.append(i)
            own = np.array(own, np.int64)
            m = size[own]
            sig, doc, *_ = part_hashes(sh[_places(at[own], m)], np.concatenate([[0], np.cumsum(m)]), percent)
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(cid[own[doc]])], names=["sig", "cid"])

    return docs.select(text).mapInArrow(run, "sig long, cid long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (sig, cid) in order: the distinct rows of sigs that different sets share. Between batches only the last
    row's sig, that sig's first cid, whether it has been given out, and the last cid are held."""
    sig = lead = last = None
    out = False
    for b in batches:
        s, c = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(s):
            continue
        if s[0] == sig and not out:  # the first row of an open group may still be needed
            s, c = np.concatenate([[sig], s]), np.concatenate([[lead], c])
            fresh = True
        else:
            fresh = s[0] != sig
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        again = np.zeros(len(s), bool)
        again[1:] = ~new[1:] & (c[1:] == c[:-1])
        if not fresh:
            new[0] = False
            again[0] = c[0] == last
        group = np.cumsum(new) - (1 if new[0] else 0)
        differ = np.bincount(group, weights=~new & ~again) > 0  # a group that goes on from before has been found to be shared
        if not fresh:
            differ[0] = True
        keep = differ[group] & ~again
        sig, last, out = s[-1], c[-1], bool(differ[group[-1]])
        lead = c[np.flatnonzero(new)[-1]] if new.any() else lead
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(c[keep])], names=["sig", "cid"])


def _checked_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT, tile: int = TILE, broadcast_rows: int = BROADCAST_ROWS, at_once: int = AT_ONCE) -> DataFrame:
    """key, th (a hash of the text), n, cid of every row, its component (a class in it; null for empty sets) and that component's least key (component_key), for links of percent or more."""
    small_batches(docs.sparkSession, 4)
    rows = stored(sets_of(docs, key, text, k, percent), "sets")
    classes = rows.filter("cid is not null").groupBy("cid").agg(F.min(F.struct("key", "th")).alias("one"), F.first("n").alias("n"), F.count("*").alias("copies"), F.min("key").alias("least"), (F.min("chk") != F.max("chk")).alias("clash"))
    classes = stored(classes, "classes")
    if classes.filter("clash").limit(1).count():
        raise RuntimeError("two sets share a 64-bit hash; change the salt of _identity")
    with Scratch(docs.sparkSession) as own:
        label = stored(components(_links(docs, rows, classes, text, key, k, percent, tile, broadcast_rows, at_once, own), at_once, own), "labels")
    named = classes.join(label.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "least", F.coalesce("label", "cid").alias("component"))
    whole = named.groupBy("component").agg(F.min("least").alias("component_key"))
    by_class = named.join(whole, "component").select("cid", "component", "component_key")
    return rows.select("key", "th", "n", "cid").join(by_class, "cid", "left").withColumn("component_key", F.when(F.col("cid").isNull(), F.col("key")).otherwise(F.col("component_key")))


def _links(docs: DataFrame, rows: DataFrame, classes: DataFrame, text: str, key: str, k: int, percent: int, tile: int, broadcast_rows: int, at_once: int, own: Scratch) -> DataFrame:
    sig = parts_of(docs, text, k, percent)
    shared = own.stored(sig.repartition("sig").sortWithinPartitions("sig", "cid").mapInArrow(_shared, "sig long, cid long"), "shared")
    tile_of = F.col("sig").bitwiseAND(F.lit(TILE_BITS)).alias("tile")
    need = rows.filter("cid is not null").select("cid", F.explode("tiles").alias("t")).groupBy("cid", F.col("t").bitwiseAND(F.lit(TILE_BITS)).alias("tile")).agg(F.min(F.shiftright("t", 6)).alias("need"))
    # sets that share too few parts in a tile have no link there
    live = own.stored(shared.groupBy("cid", tile_of).agg(F.count("*").alias("have")).join(need, ["cid", "tile"]).filter("have >= need").select("cid", "tile"), "live")
    shared = shared.withColumn("tile", tile_of).join(_checked_broadcast(live, live.count(), broadcast_rows), ["cid", "tile"], "left_semi").select("sig", "cid")
    clusters = components(shared.groupBy("sig").agg(F.min("cid").alias("a")).join(shared, "sig").select("a", F.col("cid").alias("b")), at_once, own)
    size = clusters.join(classes.select(F.col("cid").alias("node"), "n"), "node").groupBy("label").agg(F.count("*").alias("size"), F.sum("n").alias("elements"))
    nodes = own.stored(clusters.withColumnRenamed("node", "cid").join(size, "label").join(classes, "cid").select("cid", "one", "copies", "label", "size", (F.col("size") <= tile).__and__(F.col("elements") <= TILE_ELEMENTS).alias("small")), "nodes")
    count, n_big = nodes.agg(F.count("*"), F.coalesce(F.sum((~F.col("small")).cast("long")), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            sh, at = shingle_sets(b.column(1), k)
            cid, _ = _identity(sh, at)
            raw = pa.Array.from_buffers(pa.large_binary(), len(cid), [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(sh))])
            keep = []
            for c, want in zip(cid.tolist(), b.column(0).to_pylist()):
                keep.append(c == want and c not in seen)
                seen.add(c)
            yield pa.RecordBatch.from_arrays([b.column(0), raw.cast(pa.binary())], names=["cid", "shingles"]).filter(pa.array(keep, pa.bool_()))

    base = docs.select(docs[key].alias("key"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("text"))

    def sets(of: DataFrame, rows_sent: int) -> DataFrame:
        """cid, shingles of some classes, read again from one text of each (repeated rows may give a set twice)."""
        of = _checked_broadcast(of.select("cid", "one"), rows_sent, broadcast_rows)
        same = base["th"].eqNullSafe(of["one.th"]) & base["key"].eqNullSafe(of["one.key"])
        return base.join(of, same).select("cid", "text").mapInArrow(run, "cid long, shingles binary")

    small = nodes.filter("small")

    def by_cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by cluster; one cluster is held at a time."""
        held: list[pa.Table] = []
        for b in batches:
            t = pa.Table.from_batches([b])
            label = b.column(1).to_numpy()
            cut = [0, *(np.flatnonzero(label[1:] != label[:-1]) + 1).tolist(), len(label)]
            for i, j in zip(cut[:-1], cut[1:]):
                if held and held[-1].column(1)[0] != t.column(1)[i]:
                    yield from cluster(held)
                    held = []
                held.append(t.slice(i, j - i))
        if held:
            yield from cluster(held)

    def cluster(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(held)
        c, first = np.unique(t.column(0).to_numpy(), return_index=True)
        if len(c) != t.column(2)[0].as_py():
            raise RuntimeError("rows of the input have changed between two reads; store it first")
        found = tile_links(_arrays(t.column(3).take(pa.array(first))), percent)
        if found:
            x, y = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(c[x]), pa.array(c[y])], names=["a", "b"])

    few = sets(small, count).join(_checked_broadcast(small.select("cid", "label", "size"), count, broadcast_rows), "cid").select("cid", "label", "size", "shingles")
    few = few.repartition("label").sortWithinPartitions("label")
    links = own.stored(few.mapInArrow(by_cluster, "a long, b long"), "tile-links")
    if n_big:
        big = nodes.filter("not small")
        whole = own.stored(sets(big, n_big).join(_checked_broadcast(big.select("cid", "label", "copies"), n_big, broadcast_rows), "cid"), "big-sets")
        if whole.count() != n_big:
            whole = own.stored(whole.dropDuplicates(["cid"]), "big-sets")
            if whole.count() != n_big:
                raise RuntimeError("rows of the input have changed between two reads; store it first")
        links = links.unionByName(_big_links(whole, percent, tile, broadcast_rows, at_once, own))
    return links


def _big_links(sets: DataFrame, percent: int, tile: int, broadcast_rows: int, at_once: int, own: Scratch, lead_bytes: int = 32 << 20) -> DataFrame:
    """Links within clusters above the size of a tile. sets: cid, shingles, label (the cluster), copies."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                bits = bitmaps([x, y])
                keep.append((100 + percent) * overlap_bound(len(x), bits[0], np.array([len(y)]), bits[1:])[0] >= percent * (len(x) + len(y)) and linked(x, [y], percent)[0])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    def parts(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """cid, label, copies, part of each set (its component so far), and of clusters in several parts the largest one."""
        label = components(links, at_once, own)
        state = sets.select("cid", "label", "copies").join(label.select(F.col("node").alias("cid"), F.col("label").alias("part")), "cid", "left").withColumn("part", F.coalesce("part", "cid"))
        state = own.stored(state, "state")
        part = state.groupBy("label", "part").agg(F.count("*").alias("m"))
        return state, own.stored(part.groupBy("label").agg(F.max(F.struct("m", "part")).alias("top"), F.count("*").alias("parts")).filter("parts > 1").select("label", F.col("top.part").alias("top")), "parts")

    # a few sets of each cluster, the most copied among them, are tried against all its sets; then a few of those still apart, and so on
    links, mixed = None, F.xxhash64("cid")
    state, top = sets.select("cid", "label", "copies").withColumn("part", F.col("cid")), None
    for _ in range(LEAD_ROUNDS):
        left = state if top is None else state.join(top, "label").filter("part <> top")
        lead = left.groupBy("label").agg(F.array(F.max_by("cid", F.struct("copies", "cid")), F.max_by("cid", mixed), F.min_by("cid", mixed)).alias("leads"))
        lead = lead.select("label", F.explode(F.array_distinct("leads")).alias("lead"))
        lead = own.stored(lead.join(sets.select(F.col("cid").alias("lead"), F.col("shingles").alias("lead_shingles")), "lead"), "leads")
        size = lead.agg(F.coalesce(F.sum(F.length("lead_shingles")), F.lit(0))).first()[0]
        tried = sets.join(_checked_broadcast(lead, size, lead_bytes), "label").filter("cid <> lead").select(F.col("lead").alias("a"), F.col("cid").alias("b"), "lead_shingles", "shingles")
        found = own.stored(tried.mapInArrow(pairs, "a long, b long"), "lead-links")
        links = found if links is None else links.unionByName(found)
        state, top = parts(links)
        if top.limit(1).count() == 0:
            return links
    # sets outside their cluster's largest part (side 0) meet each other and all sets of that part (side 1), in tiles: a size band, then
    # a hash, so that tiles hold about 4 * tile sets; only tiles of neighbouring bands can hold links
    bits = sets.select("cid", "shingles").mapInArrow(_bits, "cid long, n long, bits binary")
    band = F.floor(F.log(F.col("n")) / F.lit(math.log(100 / percent))).alias("band")
    sized = own.stored(state.join(top, "label").withColumn("side", (F.col("part") == F.col("top")).cast("int")).join(bits, "cid").select("cid", "label", "part", "side", band, "n", "bits"), "sized")
    many = sized.groupBy("label", "side", "band").agg(F.ceil(F.count("*") / (4 * tile)).alias("tiles"))
    blocks = own.stored(sized.join(many, ["label", "side", "band"]).withColumn("block", F.pmod(F.xxhash64("cid"), "tiles")).drop("tiles"), "blocks")
    span = blocks.groupBy("label", "side", "band", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    x, y = span.filter("side = 0"), span.select("label", *(F.col(c).alias(f"y_{c}") for c in ("side", "band", "block", "lo", "hi")))
    x = x.withColumn("y_band", F.explode(F.sequence(F.col("band") - 2, F.col("band") + 2)))  # a link's sizes are within one band of each other, but for rounding
    near = f"(y_side = 1 or y_band > band or y_band = band and y_block >= block) and 100 * y_hi >= {percent} * lo and 100 * hi >= {percent} * y_lo"
    met = x.join(y, ["label", "y_band"]).filter(near).withColumn("job", F.xxhash64("label", "band", "block", "y_side", "y_band", "y_block"))
    of = lambda own, side, *at: met.select("job", "label", F.lit(own).alias("own"), side.alias("side"), *(F.col(c).alias(n) for c, n in zip(at, ("band", "block"))))
    sides = of(1, F.lit(0), "band", "block").unionByName(of(0, F.col("y_side"), "y_band", "y_block"))
    work = sides.join(blocks, ["label", "side", "band", "block"]).select("job", "own", "cid", "part", "n", "bits")

    def compare(t: pa.Table) -> pa.Table:
        """Pairs across two tiles, of different components, whose bitmaps leave room for a link; with the component of the second and their bound."""
        c, part, n, mine = (t.column(i).to_numpy() for i in ("cid", "part", "n", "own"))
        raw = [np.frombuffer(v, np.uint64) for v in t.column("bits").to_pylist()]
        words = min(map(len, raw))
        b = np.stack([folded(v, words) for v in raw])
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        other = np.flatnonzero(mine == 0)
        for i in np.flatnonzero(mine == 1):
            rest = other[(part[other] != part[i]) & (100 * n[other] >= percent * n[i]) & (percent * n[other] <= 100 * n[i])]
            bound = overlap_bound(n[i], b[i], n[rest], b[rest])
            ok = (100 + percent) * bound >= percent * (n[i] + n[rest])
            for k, v in enumerate((np.full(ok.sum(), c[i]), c[rest[ok]], part[rest[ok]], bound[ok] * 200 // (n[i] + n[rest[ok]]))):
                out[k].append(v)
        return pa.table(dict(zip(("a", "b", "part", "bound"), map(np.concatenate, out))))

    some = own.stored(work.groupBy("job").applyInArrow(compare, "a long, b long, part long, bound long"), "pairs")

    def decided(of: DataFrame) -> DataFrame:
        one, two = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y"))
        return own.stored(of.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(pairs, "a long, b long"), "pair-links")

    first = some.groupBy("a", "part").agg(F.max_by("b", F.struct("bound", "b")).alias("b")).select("a", "b")
    links = links.unionByName(decided(first))
    state, top = parts(links)
    now = lambda c: state.select(F.col("cid").alias(c), F.col("part").alias(f"part_{c}"))
    apart = some.select("a", "b").join(first, ["a", "b"], "left_anti").join(now("a"), "a").join(now("b"), "b").filter("part_a <> part_b")
    return links.unionByName(decided(apart))


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = _arrays(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s, width_of(len(s))).tobytes() for s in sets], pa.binary())], names=["cid", "n", "bits"])


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS, **how) -> DataFrame:
    """One row of each component, all columns as they are, whatever their names: a row with its least key (of those, with the least hash of
    its text); rows without shingles all stay. Of repeated rows (key and text) one stays, with the other columns of any of them."""
    by = join(docs, key, text, broadcast_rows=broadcast_rows, **how).filter("cid is not null")
    rank = F.struct(F.col("key").isNull().alias("none"), "key", "th")
    least = by.groupBy("component").agg(F.min(rank).alias("own"), F.count("*").alias("rows")).filter("rows > 1")
    spare = by.join(least, "component").groupBy("key", "th").agg(F.first(rank == F.col("own")).alias("stays"), F.count("*").alias("rows"))
    spare = stored(spare.filter("not stays or rows > 1"), "spare")
    count, again = spare.agg(F.count("*"), F.coalesce(F.sum(F.col("stays").cast("long")), F.lit(0))).first()
    h = fresh(docs, "text_hash")
    marked = docs.withColumn(h, F.xxhash64(docs[text]))

    def rows_of(df: DataFrame, which: str, how: str) -> DataFrame:
        some = _checked_broadcast(spare.filter(which).select(F.col("key").alias(f"{h}_key"), F.col("th").alias(f"{h}_of")), count, broadcast_rows)
        return df.join(some, F.col(h).eqNullSafe(F.col(f"{h}_of")) & df[key].eqNullSafe(F.col(f"{h}_key")), how)

    kept = rows_of(marked, "true", "left_anti")
    if again:
        kept = kept.unionByName(rows_of(marked, "stays", "left_semi").dropDuplicates([key, h]))
    return kept.drop(h)
