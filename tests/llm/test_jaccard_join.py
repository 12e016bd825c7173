import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import jaccard_join as J
from tidemark.llm.components import components
from tidemark.llm.shared import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, percent=90, k=3):
    """(key, size, component) of each row."""
    s = [shingles(t, k) for _, t in rows]
    up = list(range(len(s)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(least.get(top(i), key), key)
    return [(key, len(s[i]), least.get(top(i)) if s[i] else key) for i, (key, _) in enumerate(rows)]


def corpus(seed, n=70):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdéfg") for _ in range(r.randint(1, 6)))
    out = []
    for _ in range(n // 7):
        base = [word() for _ in range(r.choice([1, 2, 3, 8, 12, 30, 60, 150, 400]))]
        for _ in range(7):
            x = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, len(x) // 12])):
                at = r.randrange(len(x))
                x[at : at + 1] = r.choice([[], [word()], [x[at], word()]])
                x = x or [word()]
            out.append(r.choice([" ", "  ", "\n"]).join(x) if r.random() < 0.8 else " ".join(x).upper())
    out += [None, "", " \n", "one", "ONE", "one two", "one two three", "the same words " * 30, "the same words " * 31]
    r.shuffle(out)
    return [(i if r.random() < 0.95 else r.choice([None, 3]), t) for i, t in enumerate(out)]


def test_shingles_and_identity():
    rows = corpus(1)
    sh, at = J.shingle_sets(pa.array([t for _, t in rows], pa.string()), 3)
    assert np.diff(at).tolist() == [len(shingles(t)) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            same = len(np.intersect1d(sh[at[i] : at[i + 1]], sh[at[j] : at[j + 1]]))
            assert same == len(shingles(rows[i][1]) & shingles(rows[j][1]))


@pytest.mark.parametrize("percent", [90, 75])
def test_linked_sets_share_a_part(percent):
    for seed in range(4):
        rows = corpus(seed, 140)
        s = [shingles(t) for _, t in rows]
        sh, at = J.shingle_sets(pa.array([t for _, t in rows], pa.string()), 3)
        sig, doc, *by_tile = J.part_hashes(sh, at, percent)
        have = [set(sig[doc == i].tolist()) for i in range(len(rows))]
        need = {(d, t): n for d, t, n in zip(*(x.tolist() for x in by_tile))}
        for i in range(len(rows)):
            for j in range(i):
                if s[i] and s[j] and s[i] != s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                    both = [x & 63 for x in have[i] & have[j]]
                    assert any(both.count(t) >= max(need[i, t], need[j, t]) for t in set(both))


def test_shared_rows_over_batches():
    r = np.random.default_rng(4)
    for step in (1, 2, 3, 7, 100):
        s, c = np.sort(r.integers(0, 12, 40)), r.integers(0, 3, 40)
        order = np.lexsort((c, s))
        s, c = s[order], c[order]
        batches = [pa.RecordBatch.from_arrays([pa.array(s[i : i + step]), pa.array(c[i : i + step])], names=["sig", "cid"]) for i in range(0, 40, step)]
        got = [tuple(x.values()) for b in J._shared(iter(batches)) for x in b.to_pylist()]
        pairs = set(zip(s.tolist(), c.tolist()))
        assert sorted(got) == sorted(p for p in pairs if sum(q[0] == p[0] for q in pairs) > 1)


def test_bound_is_never_below_the_overlap():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 2**63, r.integers(1, 300)).astype(np.uint64) % np.uint64(500)) for _ in range(30)]
    bits = J.bitmaps(sets)
    for i, x in enumerate(sets):
        bound = J.overlap_bound(len(x), bits[i], np.array([len(s) for s in sets]), bits)
        assert all(b >= len(np.intersect1d(x, y)) for b, y in zip(bound, sets))


def test_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    for at_once in (10**6, 0):
        got = [(x.node, x.label) for x in components(spark.createDataFrame(links, "a long, b long").repartition(3), at_once).collect()]
        assert sorted(got) == sorted((x, top(x)) for x in up)


@pytest.mark.parametrize("seed,tile,rows_sent,at_once", [(3, 512, 10**6, 10**6), (4, 4, 0, 10**6), (6, 6, 10**6, 0)])
def test_join_equals_brute_force(spark, seed, tile, rows_sent, at_once):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string")
    got = J.join(df, tile=tile, broadcast_rows=rows_sent, at_once=at_once).collect()
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.key, r.n, r.component_key) for r in got), key=order) == sorted(brute(rows), key=order)


@pytest.mark.parametrize("percent", [90, 60])
def test_links_of_big_clusters_join_what_brute_force_joins(spark, percent):
    r = random.Random(9)
    sets = {}
    for base in range(6):
        whole = [r.getrandbits(60) for _ in range(r.choice([9, 30, 31, 200]))]
        for i in range(20):
            own = [x if r.random() > i / 300 else r.getrandbits(60) for x in whole]
            sets[100 * base + i] = np.unique(np.array(own[: len(own) - i // 5], np.uint64))
    df = spark.createDataFrame([(c, s.tobytes(), c % 2, 1) for c, s in sets.items()], "cid long, shingles binary, label long, copies long")
    with Scratch(spark) as own:
        got = [(x.a, x.b) for x in J._big_links(df, percent, 1, 10**6, 10**6, own).collect()]
    linked = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))
    assert all(linked(a, b) for a, b in got)
    want = [(a, b) for a in sets for b in sets if a < b and a % 2 == b % 2 and linked(a, b)]
    assert len(want) > 100 and parts(sets, got) == parts(sets, want)


def parts(nodes, links):
    label = {x: x for x in nodes}
    for _ in nodes:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_small_sets_with_empty_pieces_are_not_one_cluster():
    r = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 10**6, r.integers(4, 14))) for _ in range(3000)]
    sh, at = J.shingle_sets(pa.array(texts), 1)
    sig, doc, *_ = J.part_hashes(sh, at, 80)
    assert max(np.unique(sig, return_counts=True)[1]) < 20


def test_one_of_repeated_rows_stays_and_columns_keep_their_names(spark):
    t = "one two three four five six seven"
    rows = [(1, t, 77, "a"), (1, t, 77, "a"), (1, t, 77, "a"), (2, t + " eight", 88, "b"), (3, t, 99, "c"), (4, "quite other words stand here", 5, "d"), (None, t, 6, "e"), (None, None, 7, "f"), (8, "", 8, None), (8, "", 8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row long, text_hash string")
    kept = J.keep_one(df, percent=80)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[5], *rows[7:]], key=str)
    for sent in (0, 10**6):
        same = J.keep_one(df.repartition(5), percent=80, broadcast_rows=sent)
        assert sorted(map(tuple, same.collect()), key=str) == sorted(map(tuple, kept.collect()), key=str)


def test_long_texts(spark):
    r = random.Random(8)
    long = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    other = [*long[:59_000], *(f"v{i}" for i in range(1000))]
    df = spark.createDataFrame([(5, " ".join(long)), (3, " ".join(other)), (4, " ".join(long[:50_000]))], "doc_id long, text string")
    assert sorted((x.key, x.component_key) for x in J.join(df).collect()) == [(3, 3), (4, 4), (5, 3)]


def test_keep_one_and_empty_tables(spark):
    rows = corpus(5)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string")
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    s = brute([(i, t) for i, (_, t) in enumerate(rows)])
    assert len(got) == len({c for _, n, c in s if n}) + sum(n == 0 for _, n, _ in s)
    assert J.join(df.limit(0)).count() == 0
