import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lm_score as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, order, strength, folds):
    tokens = [["<start>", *re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "<end>"] for _, t in rows]
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % folds == 0 for k, _ in rows]
    c = Counter()
    for t, h in zip(tokens, held):
        if not h:
            for k in range(1, order + 1):
                c.update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
    words = {g: n for g, n in c.items() if len(g) == 1 and g != ("<start>",)}
    n, v = sum(words.values()), len(words)

    def p(h, w):
        if not h:
            return (words.get((w,), 0) + 0.1) / (n + 0.1 * (v + 1))
        return (c[(*h, w)] + strength * p(h[1:], w)) / (c[h] + strength)

    out = []
    for (k, _), t, h in zip(rows, tokens, held):
        base = sum(math.log10(p((), w)) for w in t[1:])
        full = sum(math.log10(p(tuple(t[max(0, i - order + 1) : i]), t[i])) for i in range(1, len(t)))
        out.append((str(k), h, len(t) - 1, sum((w,) in words for w in t[1:]), n, round(base, 6), round(full, 6)))
    return sorted(out)


def corpus(n=120):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["the", "The", "a", "é", "of", "x", f"w{r.randint(0, 30)}"]) for _ in range(r.randint(0, 25)))) for i in range(n)]
    return rows + [(None, None), (None, "the of"), (7, ""), (7, "the a of the a of"), (7, "the a of the a of"), (500, "new words only"), (501, "the of " * 3000)]


@pytest.mark.parametrize("order,strength,block,shard", [(2, 10.0, 1 << 20, 10**6), (1, 5.0, 300, 20), (2, 1.0, 300, 30), (3, 2.5, 500, 25), (4, 7.0, 1 << 20, 100)])
def test_scores_equal_brute_force(spark, order, strength, block, shard):
    rows = corpus()
    df = spark.createDataFrame([(*x, "x") for x in rows], "doc_id long, text string, score string")
    got = L.score(df, order=order, strength=strength, block_bytes=block, shard_grams=shard, folds=3).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == brute(rows, order, strength, 3)


def test_edges(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert L.score(df.limit(0)).count() == 0
    none = L.score(df.filter("doc_id < 50"), folds=1).collect()
    assert len(none) == 53 and {(r.train_tokens, r.n_known, r.held_out) for r in none} == {(0, 0, True)}


def test_sorted_numbers_come_back():
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 1000):
        x = np.sort(r.integers(0, 2**64, n, dtype=np.uint64))
        assert (L._unpack_sorted(L._pack_sorted(x)) == x).all()


def test_a_long_text_and_many_blocks(spark):
    r = random.Random(4)
    rows = [(1, " ".join(f"w{r.randrange(900)}" for _ in range(20_000))), *((i, "w1 w2 w3") for i in range(2, 40)), (40, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = L.score(df, strength=10.0, block_bytes=400, shard_grams=3000, folds=3).collect()
    assert sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6), round(x.score, 6)) for x in got) == brute(rows, L.ORDER, 10.0, 3)
