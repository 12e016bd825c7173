"""Noise is rejected by the default limits, and no labelled text is lost to the lower ones."""

import base64
import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.llm import quality_rules as Q

SF = "/root/testdata/sf0.1"
R = random.Random(5)
NOISE = {
    "base64": lambda n: base64.b64encode(R.randbytes(n)).decode(),
    "printable": lambda n: "".join(chr(R.randint(33, 126)) for _ in range(n)),
    "cjk": lambda n: "".join(chr(R.randint(0x4E00, 0x9FFF)) for _ in range(n)),
    "hex": lambda n: R.randbytes(n).hex(),
}


def cut(text, step, size):
    text = "\n".join(text[i : i + step] for i in range(0, len(text), step))
    return text.encode()[:size].decode(errors="ignore")


@pytest.mark.parametrize("kind", NOISE)
def test_noise_is_rejected(kind):
    sizes = (8200, 20_000, 200_000) if kind == "hex" else (150, 180, 250, 300, 400, 700, 1500, 4000, 8200, 20_000, 200_000)
    s = Q.signals(pa.array([cut(NOISE[kind](n), step, n) for n in sizes for step in (10, 76)]))
    assert not s["base_failed"][-1] and not s["kept"].any()
    if kind != "hex":
        assert (s["bad_chunk_share"][-6:] > 0.9).all()


def test_noise_inside_prose_is_rejected():
    words = ["".join(R.choice("abcdefghijklmnoprstu") for _ in range(R.randint(2, 9))) for _ in range(600)]
    prose = lambda n: " ".join(R.choice(words) for _ in range(n))
    clean, mixed = prose(2400), prose(1200) + "\n" + cut(NOISE["base64"](8192), 76, 8192) + "\n" + prose(1200)
    low = Q.Bands(whole=((float("inf"), 1.0, 5.0),))
    s = Q.signals(pa.array([clean, mixed]), low)
    assert list(s["kept"]) == [True, False] and s["bad_chunk_share"][0] == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_labelled_texts_stay():
    good = {i for i, q in zip(*pq.read_table(f"{SF}/labels.parquet", columns=["doc_id", "quality"]).to_pydict().values()) if q == 1}
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "lang"])
    docs = docs.filter(pa.array([i in good for i in docs["doc_id"].to_pylist()]))
    text, every = docs["text"].combine_chunks(), Q.Bands()
    free = Q.Bands(whole=tuple((n, 0.0, hi) for n, _, hi in every.whole), chunk=(0.0, every.chunk[1]))
    kept, without = Q.signals(text)["kept"], Q.signals(text, free)["kept"]
    assert set(docs["lang"].to_pylist()) >= {"en", "de", "fr", "es"}
    assert np.array_equal(kept, without) and without.sum() > 1000
