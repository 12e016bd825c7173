import random
import re
import zlib

import numpy as np

import corpus_pipeline
from tidemark.llm import quality_rules, tokens
from test_quality_rules import plain_verdict
from tests_llm_brute import brute_components, brute_hits, brute_mix


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuv") for _ in range(r.randint(2, 8)))
    rows, bench = [], [(i, " ".join(word() for _ in range(25))) for i in range(4)]
    for i in range(90):
        body = [word() for _ in range(r.choice([5, 40, 120, 400]))]
        if i % 9 == 0:
            body[3:3] = bench[i % 4][1].split()[4:18]
        if i % 10 == 3:
            body = [body[0]] * 300
        if i % 6 == 5 and rows:
            body = (rows[-1][1] or "x").split()
            body[len(body) // 2] = word()
        rows.append((i, " ".join(body), r.choice(["en", "fr"]), r.choice(["s0", "s0", "s1"]), len(" ".join(body))))
    return rows + [(90, None, "en", "s0", 0), (91, "", None, None, 0), (92, rows[7][1], "en", "s1", 1)], bench


def test_stages_equal_brute_force(spark, tmp_path):
    rows, bench = corpus()
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, cols).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, now = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = now
        if k == 0:
            now = [x for x in now if plain_verdict(x[1], quality_rules.Bands())[-1]]
        elif k == 1:
            least = brute_components([(x[0], x[1]) for x in now], 80, 5)
            now = [x for x in now if least[x[0]] == x[0]]
        elif k == 2:
            hit = brute_hits([x[1] for x in now], bench, 10)
            now = [x for x, h in zip(now, hit) if not h]
        else:
            now = brute_mix(now)
        assert 0 < len(now) < len(before)
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert sorted(map(tuple, docs.collect())) == sorted(now)
    from tokenizers import Tokenizer

    t, start, want = Tokenizer.from_file(tokens.default_path()), 0, []
    for i, text, *_ in sorted(now):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in last.collect()) == want
    assert re.match("^[a-z0-9_]+$", last.columns[0])
