import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash

from tidemark.llm import quality_mil as M

LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def test_passages_and_counts():
    texts = [None, "", " \n", "a " * 300, "Ab! 12\n" * 3, "é"]
    x, first = M.features(pa.array(texts, pa.string()), passage=128)
    assert np.diff(first).tolist() == [1, 1, 1, 3, 1, 1]
    assert not x[0].any() and not x[1].any()
    assert np.allclose(x[3:6, :M.N_KINDS].sum(1), 1) and np.isclose(x[6, 3], 2 / 7) and np.isclose(x[6, 5], 1 / 7)
    assert np.allclose(x[3:6, M.N_KINDS + 1], 1)  # one word all over
    for t in texts:  # a text's features don't hang on its neighbours
        alone, _ = M.features(pa.array([t], pa.string()))
        i = texts.index(t)
        assert np.allclose(alone, x[first[i] : first[i + 1]], atol=1e-6)


def test_gradient():
    r = np.random.default_rng(1)
    x, first, y = r.normal(size=(9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    m = M.fit(x, first, y, hidden=4, gate=3, epochs=2)
    g = m.gradient(x, first, y)
    loss = lambda: -np.mean(y * np.log(m.forward(x, first)["p"]) + (1 - y) * np.log(1 - m.forward(x, first)["p"]))
    for n, w in m.w.items():
        for i in range(min(w.size, 6)):
            old = w.flat[i]
            w.flat[i] = old + 1e-5
            up = loss()
            w.flat[i] = old - 1e-5
            assert abs((up - loss()) / 2e-5 - g[n].flat[i]) < 1e-6
            w.flat[i] = old


def corpus(n=700):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeilnorst") for _ in range(r.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        good = [" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(r.randint(1, 30))]
        if bad := r.random() < 0.3:  # one part of the text is junk
            k = r.randrange(len(good) + 1)
            good[k:k] = [r.choice(["BUY NOW!! ", "$$$ ### ", word() + " "]) * 90]
        rows.append((i, "\n".join(good), "x"))
        if i % 5 < 4:
            labels.append((i, int(not bad)))
    return rows, labels, {x[0]: "!!" not in x[1] and "$$$" not in x[1] for x in rows}


def test_held_out_accuracy_and_edges(spark):
    rows, labels, _ = corpus()
    df = spark.createDataFrame([*rows, (None, None, "x"), (10_001, "", "x"), (3, rows[3][1], "x")], "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1), (699, None)], "doc_id long, quality int")
    model = M.train(df, lab)
    out = M.score(df, model).collect()
    assert len(out) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    truth = dict(labels)
    held = [(r.predicted, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in out)
    assert np.mean([a == b for a, b in held]) >= 0.95
    again = {r.doc_id: r.score for r in M.score(df.repartition(3), M.train(df.repartition(5), lab.repartition(3))).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in out)
    assert M.score(df.limit(0), model).count() == 0
    assert {r.score for r in M.score(df.limit(4), M.train(df, lab.limit(0))).collect()} == {0.5}
    assert {r.score for r in M.score(df.limit(4), M.train(df, lab.filter("quality = 1"))).collect()} == {1.0}


def plain_features(text, passage):
    """The same features, word by word."""
    raw = (text or "").encode()
    spots = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    out = []
    for k in range(max(1, -(-len(spots) // passage))):
        some = spots[k * passage : (k + 1) * passage]
        begin = 0 if k == 0 else some[0][0]
        end = spots[(k + 1) * passage][0] if (k + 1) * passage < len(spots) else len(raw)
        piece, words = raw[begin:end], [raw[i:j].translate(LOWER) for i, j in some]
        row = np.zeros(M.N_KINDS + 6 + M.BUCKETS)
        for x in piece:
            row[M.KINDS[x]] += 1 / len(piece)
        n = max(1, len(words))
        row[M.N_KINDS : M.N_KINDS + 4] = len(set(words)) / n, max(map(words.count, words), default=0) / n, len(set(zip(words, words[1:]))) / n, sum(map(len, words)) / n / 16
        row[M.N_KINDS + 4 : M.N_KINDS + 6] = np.log1p(len(words)) / 5, np.log1p(len(piece)) / 7
        for w in words:
            row[M.N_KINDS + 6 + xxhash.xxh3_64_intdigest(w) % M.BUCKETS] += 1 / n
        out.append(row)
    return out


def plain_score(model, rows):
    """The attention-weighted passage, one passage at a time."""
    w, hs, es = model.w, [], []
    for row in rows:
        x = np.clip((row - model.mean) / model.spread, -5, 5)
        h = np.array([math.tanh(sum(x[i] * w["enc"][i, j] for i in range(len(x))) + w["enc_b"][j]) for j in range(len(w["enc_b"]))])
        gated = [math.tanh(h @ w["att"][:, j] + w["att_b"][j]) / (1 + math.exp(-(h @ w["gate"][:, j] + w["gate_b"][j]))) for j in range(len(w["att_b"]))]
        hs.append(h)
        es.append(math.exp(sum(g * m for g, m in zip(gated, w["mix"]))))
    z = sum(e / sum(es) * h for e, h in zip(es, hs))
    return 1 / (1 + math.exp(-(float(z @ w["out"]) + float(w["out_b"][0]))))


def test_scores_equal_a_plain_forward_pass(spark):
    rows, labels, _ = corpus(160)
    r = random.Random(5)
    rows += [(1000, None, "x"), (1001, " \t", "x"), (1002, " ".join(f"Wört{r.randrange(99)}" for _ in range(14_000)), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = M.train(df, spark.createDataFrame(labels, "doc_id long, quality int"), sample=100, bag=3)
    for x in M.score(df.filter("doc_id % 7 = 0 or doc_id >= 1000"), model).collect():
        text = dict((i, t) for i, t, _ in rows)[x.doc_id]
        assert abs(plain_score(model, plain_features(text, M.PASSAGE)) - x.score) < 1e-5


def test_long_texts_train_by_evenly_spaced_passages():
    x = np.arange(10)[:, None]
    assert M.spaced(x, 10) is x and M.spaced(x, 4).ravel().tolist() == [0, 3, 6, 9] and len(M.spaced(x, 1)) == 1
