import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import token_lengths, token_store, tokens

PATH = tokens.default_path()


@pytest.fixture(scope="module")
def enc():
    return tokens.Encoder(PATH, most=50)


def plain(t):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids


ODD = st.lists(st.sampled_from(list(" \n\t\r\xa0\x85\u3000é×日a'sB9-.!\x1c\x00\ufeff<|>") + ["<|endoftext|>", "  ", "'ll", "ñ ", "×,", "a,b", "é.", "ab'd"]), max_size=40).map("".join)


@settings(max_examples=120, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=4))
def test_pieces_equal_whole_texts(texts):
    e = test_pieces_equal_whole_texts.__dict__.setdefault("e", tokens.Encoder(PATH, most=50))
    ids, at = e.column(pa.array(texts, pa.string()))
    whole = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == whole


def test_nulls_and_other_tokenizers(enc):
    ids, at = enc.column(pa.array([None, "", "a b", None]))
    assert at.tolist() == [0, 0, 0, 2, 2]
    whole = tokens.Encoder(PATH, pieces=False).column(pa.array([None, "", "a b"]))
    assert whole[1].tolist() == [0, 0, 0, 2] and whole[0].tolist() == ids.tolist()
    assert enc.column(pa.array([], pa.string()))[1].tolist() == [0]


def sample(spark, n=60):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["the", "Ondly", "été", "x.\n", "\n", "zz9"]) for _ in range(r.randint(0, 30))), "c") for i in range(n)]
    rows += [(7, None, "c"), (7, "again", "c"), (7, "again", "c"), (None, "no id", None), (n + 5, "", "c"), (n + 6, "long " * 20000, "c")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, offset string")


def test_store_round_trip(spark):
    rows, df = sample(spark)
    path, back = token_store.store(df.repartition(5), PATH)
    got = sorted(back.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert sorted((r.doc_id or -1, list(r.ids)) for r in got) == sorted((i or -1, [*plain(t), 0]) for i, t, _ in rows)
    for r, c in zip(got, sorted(token_store.checksums(back).collect(), key=lambda r: r.start)):
        assert (c.doc_id, c.start, c.n_tokens, c.ids_crc32) == (r.doc_id, r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
    found = token_store.lookup(spark, path, [3, 7])
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString() and found.count() == 5


def test_store_of_an_empty_table(spark):
    _, df = sample(spark)
    _, back = token_store.store(df.limit(0), PATH)
    assert token_store.checksums(back).count() == 0


def test_lengths(spark):
    rows, df = sample(spark)
    size = sorted(len(plain(t)) for _, t, _ in rows)
    limits = token_lengths.by_limit(token_lengths.lengths(df, PATH), block=7)
    got = {r.length: r for r in limits.collect()}
    assert sorted(got) == sorted(set(size))
    for n, r in got.items():
        assert (r.n_docs, r.docs_from, r.tokens_from, r.docs_over) == (size.count(n), sum(x >= n for x in size), sum(x for x in size if x >= n), sum(x > n for x in size))
        assert (r.tokens_total, r.truncated_tokens) == (sum(size), sum(min(x, n) for x in size))
        assert abs(r.share_within - sum(x <= n for x in size) / len(size)) < 1e-12
    assert token_lengths.quantile(limits, 0.5).first().length == size[(len(size) - 1) // 2]
    for n in (0, 13, 10**6):
        assert token_lengths.truncated(limits, n).first().truncated_tokens == sum(min(x, n) for x in size)
    assert token_lengths.by_limit(token_lengths.lengths(df.limit(0), PATH)).count() == 0
