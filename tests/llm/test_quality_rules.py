import random
import re
from collections import Counter

import pyarrow as pa
import pytest
import zstandard

from tidemark.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, hit = Counter(win), set()
    for i, x in enumerate(win):
        if n[x] > 1:
            hit |= set(range(i, i + 5))
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), failed]


def texts():
    r = random.Random(3)
    out = [None, "", " ", "\n\n", "a", "x\ny\nx", "x\n\nx\n", "é é é é é é é", "a b c d e " * 4, "word " * 5000]
    for _ in range(400):
        out.append("".join(r.choice(["a", "b", "é", " ", " ", "\n", "\t", "#", "日", "\x00", "\x85", "cd e\n"]) for _ in range(r.randint(0, 60))))
    return out


def test_signals_equal_brute_force():
    t = texts()
    s = Q.signals(pa.array(t, pa.string()))
    got = [[int(s[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")] for i in range(len(t))]
    assert got == [[int(x) for x in brute(x)] for x in t]


def test_bands():
    r = random.Random(1)
    prose = " ".join("".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(800))
    noise = " ".join("".join(chr(r.randint(0x100, 0xFFF)) for _ in range(12)) for _ in range(300))
    loop = " ".join(f"item {i % 40} value {i % 7} row" for i in range(3000))
    s = Q.signals(pa.array([prose, loop, prose + " " + "same " * 600, None, ""]))
    assert list(s["kept"]) == [True, False, False, False, False]
    assert not Q.signals(pa.array([noise]), Q.Bands(whole=((float("inf"), 1.9, 4),)))["kept"][0]


def plain_verdict(text, bands):
    """whole_ratio, bad_chunk_share, kept: by zstandard's one-call interface, a text at a time."""
    raw = (text or "").encode()
    if not raw:
        return None, None, False
    ratio = lambda x: len(x) / len(zstandard.compress(x, bands.level))
    bad = 0
    for k in range(0, len(raw), bands.chunk_bytes):
        x = raw[k : k + bands.chunk_bytes]
        if len(x) >= bands.least_chunk and (ratio(x) < bands.chunk[0] or ratio(x) > bands.chunk[1]):
            bad += len(x)
    for below, low, high in bands.whole:
        if len(raw) < below:
            break
    return ratio(raw), bad / len(raw), low <= ratio(raw) <= high and bad <= bands.bad_share * len(raw) and not brute(text)[-1]


def test_ratios_and_verdicts_equal_a_plain_version(spark):
    r = random.Random(6)
    prose = lambda n: " ".join("".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(n))
    noise = lambda n: "".join(chr(r.randint(33, 126)) for _ in range(n))
    t = [*texts()[:40], *(prose(n) for n in (20, 60, 200, 700, 3000)), *(noise(n) for n in (100, 900, 5000)), "".join([prose(2000), " ", noise(4000), " same" * 900])]
    t += [prose(r.randint(10, 500)) + (noise(r.randint(0, 2000)) if r.random() < 0.5 else "") for _ in range(60)]
    for bands in (Q.Bands(), Q.Bands(chunk_bytes=300, least_chunk=100, bad_share=0.1)):
        want = {i: plain_verdict(x, bands) for i, x in enumerate(t)}
        got = {x.doc_id: (x.whole_ratio, x.bad_chunk_share, x.kept) for x in Q.judge(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string"), bands=bands).collect()}
        assert got == want and {k for *_, k in want.values()} == {True, False}


def test_limits_from_quantiles(spark):
    r = random.Random(2)
    good = [" ".join("".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(r.choice([300, 900]))) for _ in range(300)] + ["", None]
    df = spark.createDataFrame(list(enumerate(good)), "doc_id long, text string")
    b = Q.fit_bands(df, df, tail=0.01)
    assert all(x for x in Q.signals(pa.array(good[:300]), b)["kept"]) and b.whole[0] == Q.Bands().whole[0] and b.whole != Q.Bands().whole
    assert not Q.signals(pa.array(["".join(chr(r.randint(33, 126)) for _ in range(3000))]), b)["kept"][0]
    assert Q.fit_bands(df, df.limit(0)) == Q.Bands() and Q.fit_bands(df.limit(0), df) == Q.Bands()


def test_frames(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "a b c d e f g h i j k", "y"), (1, "", None)], "doc_id long, text string, n_words string")
    rows = Q.judge(df).collect()
    assert len(rows) == 3 and {r.n_words for r in rows} == {0, 11} and [r.kept for r in rows if r.n_words] == [True]
    kept = Q.keep_good(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(None, "a b c d e f g h i j k", "y")]
    assert Q.judge(df.limit(0)).count() == 0


if __name__ == "__main__":
    pytest.main([__file__])
