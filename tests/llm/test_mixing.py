import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing as M

DIMS = ["source", "lang", "kind"]


def corpus(n=400):
    r = random.Random(7)
    out = [(i, " ".join(["w"] * r.randint(0, 40)), r.choice(["a", "a", "a", "b", "c"]), r.choice(["en", "en", None]), r.choice(["x", "y"]), "extra") for i in range(n)]
    return out + [(None, None, None, "en", "x", None), (5, "one two", "a", "en", "x", ""), (5, "one two", "a", "en", "x", "")]


def brute(rows, targets, keep, iterations=200, seed="mix"):
    tokens = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    cells = defaultdict(int)
    for r, n in zip(rows, tokens):
        cells[r[2:5]] += n
    total, w = sum(cells.values()), {c: float(n) for c, n in cells.items()}
    goals = []
    for d, t in enumerate(targets):
        by = defaultdict(float)
        for c, n in cells.items():
            by[c[d]] += n
        share = {v: (t.get(v, 0.0) if isinstance(t, dict) else (n**t if n else 0.0)) for v, n in by.items()}
        goals.append({v: total * s / sum(share.values()) for v, s in share.items()})
    for _ in range(iterations):
        for d in range(3):
            now = defaultdict(float)
            for c, x in w.items():
                now[c[d]] += x
            w = {c: x * goals[d][c[d]] / now[c[d]] if now[c[d]] > 0 else 0.0 for c, x in w.items()}
    low, high = 0.0, 1e9
    for _ in range(200):
        s = (low + high) / 2
        low, high = (s, high) if sum(min(cells[c], s * w[c]) for c in w) < keep * total else (low, s)
    p = {c: min(1.0, low * w[c] / cells[c]) if cells[c] and w[c] else 0.0 for c in w}
    u = lambda i: int(hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 16**13
    return [(str(r[0]), n, round(p[r[2:5]], 9), u(r[0]) < p[r[2:5]]) for r, n in zip(rows, tokens)], w, goals


@pytest.mark.parametrize("targets,keep", [((0.5, 0.7, 0.0), 0.5), (({"a": 0.2, "b": 0.5, "c": 0.3}, 0.5, 1.0), 0.6), ((0.0, 0.0, 0.0), 0.97)])
def test_mix_equals_brute_force(spark, targets, keep):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kind string, mix_tokens string")
    with pytest.raises(ValueError, match="mix_tokens"):
        M.mix(df, [F.col(d) for d in DIMS], targets, keep)
    for most in (100_000, 0):
        got = M.mix(df, [F.col(d) for d in DIMS], targets, keep, broadcast_cells=most, prefix="m").select("doc_id", "m_tokens", F.round("m_probability", 9), "m_sampled").collect()
        want, w, goals = brute(rows, targets, keep)
        assert sorted((str(a), b, c, d) for a, b, c, d in got) == sorted(want)
    for d in range(3):
        for v, goal in goals[d].items():
            assert abs(sum(x for c, x in w.items() if c[d] == v) - goal) <= 1e-9 * goal + 1e-6
    kept = M.sample(df, [F.col(d) for d in DIMS], targets, keep=keep)
    assert kept.columns == df.columns and kept.count() == sum(x[3] for x in want)


def test_edges(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, source string, lang string, kind string, x string")
    empty = df.filter("doc_id = -1")
    assert M.sample(empty, [F.col("source"), M.style("text")], (0.5, 0.5)).count() == 0
    blank = df.withColumn("text", F.lit(None).cast("string"))
    assert M.sample(blank, [F.col("source"), M.style("text")], (0.5, 0.5)).count() == 0
    assert M.sample(df, [F.col("source")], (1.0,), keep=1.0).count() >= df.filter("text <> ''").count()


def test_columns_stay_and_impossible_targets_are_told(spark):
    df = spark.createDataFrame([(1, "one two", "a", "kept", None, 5), (2, "three " * 50_000, "b", "kept", None, 6)], "doc_id long, text string, source string, mix_0 string, mix_sampled string, cell_mix_0 long")
    got = M.sample(df, [F.col("source")], (1.0,), keep=1.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    pair = spark.createDataFrame([(1, "w " * 10, "a", "x"), (2, "w " * 10, "b", "y")], "doc_id long, text string, s string, t string")
    with pytest.raises(RuntimeError, match="misses its target by 0.4"):
        M.mix(pair, [F.col("s"), F.col("t")], ({"a": 0.9, "b": 0.1}, {"x": 0.5, "y": 0.5}))
