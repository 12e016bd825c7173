import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from tidemark.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, k):
    out = []
    for d in docs:
        w, hit, names = words(d), set(), set()
        for i, t in items:
            x = words(t)
            for j in range(max(1, len(x) - k + 1) if x else 0):
                y = x[j : j + k]
                for a in range(len(w) - len(y) + 1):
                    if w[a : a + len(y)] == y:
                        hit |= set(range(a, a + len(y)))
                        names.add("" if i is None else str(i))
        out.append((len(w), len(hit), sorted(names)))
    return out


def sample(seed, n=60, vocab="a b c É 9 日".split()):
    r = random.Random(seed)
    text = lambda m: "".join(r.choice(vocab) + r.choice([" ", "-", "\n", "\x00"]) for _ in range(r.randint(0, m)))
    items = [(i, text(9)) for i in range(8)] + [(None, "a b c a"), (8, None), (9, ""), (3, "b b"), (10, "B B c"), (10, "zz")]
    docs = [text(50) for _ in range(n)] + [None, "", "...", "a", "x " * 40, "a b " * 60, "a b " * 60]
    return docs, items


def test_suffix_order_is_sorted():
    r = np.random.default_rng(2)
    for bits in (2, 20, 40):
        t = r.integers(0, 4, 300)
        t[50:150] = t[150:250] = 1
        t[-1] = 0
        order = D.suffix_order(t, bits)
        unique = np.where(t == 0, np.arange(300) - 1000, t).tolist()
        assert order.tolist() == sorted(range(300), key=lambda i: unique[i:])


def test_search_equals_brute_force():
    for seed in range(6):
        docs, items = sample(seed)
        for k in (1, 3, 10):
            got = D.search_shard(pa.array(docs, pa.string()), D.phrases(items, k))
            assert [(x["n_words"], sum(s["end_word"] - s["first_word"] for s in x["spans"]), x["items"]) for x in got] == brute(docs, items, k)
            for d, x in zip(docs, got):
                if d and x["spans"]:
                    assert len(words(D.cut_spans(d, x["spans"]))) <= x["n_words"]


def test_small_pieces_and_large_alphabet():
    r = random.Random(5)
    docs = [" ".join(f"w{r.randint(0, 3000)}" for _ in range(400)) for _ in range(20)]
    items = [(i, " ".join(d.split()[i * 3 : i * 3 + 14])) for i, d in enumerate(docs)]
    got = D.search_shard(pa.array(docs), D.phrases(items), at_once=7)
    assert [(x["n_words"], sum(s["end_word"] - s["first_word"] for s in x["spans"]), x["items"]) for x in got] == brute(docs, items, 10)


def test_frames_in_one_and_more_blocks(spark):
    docs, items = sample(9)
    rows = [(i % 50, t, "x") for i, t in enumerate(docs)] + [(None, docs[3], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute([x[1] for x in rows], items, 3)
    expect = sorted((str(r[0]), *w[:2], w[2]) for r, w in zip(rows, want))
    for size in (1 << 20, 5):
        out = D.find(df, bench, window=3, shard_words=20, block_bytes=size).withColumn("hit", D.n_hit()).collect()
        assert sorted((str(r.doc_id), r.n_words, r.hit, r["items"]) for r in out) == expect
        kept = D.drop_hit(df, bench, window=3, block_bytes=size)
        assert kept.columns == df.columns
        assert sorted((str(a), b or "") for a, b, _ in kept.collect()) == sorted((str(r[0]), r[1] or "") for r, w in zip(rows, want) if not w[1])
    assert D.find(df.limit(0), bench).count() == 0
    assert {(tuple(r["items"]), len(r.spans)) for r in D.find(df, bench.limit(0)).collect()} == {((), 0)}


def test_digest():
    assert D.digest(["1", "12", "2"]) == hashlib.sha256(b"1,12,2").hexdigest()
