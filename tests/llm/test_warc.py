import gzip
import hashlib
import os
import random

import numpy as np
import pytest

from tidemark.llm import warc


def pages(seed=1, n=120):
    r = random.Random(seed)
    common = "<p>" + "same é " * 30 + "</p>"
    out = [(i * 7, r.choice(["http://a.example/x y", "http://b.example/é\r\nX: 1", None]), r.choice([common, "short", None, "", f"<html>{i} é" + "z" * r.randint(0, 400) + "\r\n\r\n</html>"]), "x") for i in range(n)]
    return out + [(None, "u", common, "x"), (14, "dup", "d" * 200, ""), (14, "dup", "d" * 200, ""), (900, "long", "long " * 100_000, None)]


def expected(rows):
    first = {}
    for i, _, h, _ in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        f = first.get(h) if len(raw) >= 100 else None
        again = f is not None and f != i
        out.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,roll", [(1 << 24, 1 << 22), (3000, 600)])
def test_round_trip(spark, tmp_path, shard, roll):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    seen = []
    for k, x in enumerate((df, df.repartition(5).orderBy("digest"))):
        uri = f"file://{tmp_path}/{k}"
        manifest = warc.write(x, uri, shard_bytes=shard, roll_bytes=roll, broadcast_rows=k * 100).collect()
        assert sum(m.records for m in manifest) == len(rows)
        files = sorted(os.listdir(tmp_path / str(k) / "archives"))
        files = [f for f in files if not f.endswith(".crc")]
        assert files == sorted(m.file for m in manifest) and (len(files) > 5) == (roll < 1000)
        seen.append({f: (tmp_path / str(k) / "archives" / f).read_bytes() for f in files})
        got = warc.read(spark, uri).collect()
        assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
        texts = {r.page_id: r.payload for r in got if r.record_type == "response"}
        assert all(texts[i] == (h or "") for i, _, h, _ in rows if i in texts and i != 14)
    assert seen[0] == seen[1]
    assert b"WARC/1.1\r\nWARC-Type: response" in gzip.decompress(seen[0][files[0]])


def test_damage_is_found(spark, tmp_path):
    uri = f"file://{tmp_path}"
    (m,) = warc.write(spark.createDataFrame(pages()[:20], "page_id long, url string, html string, x string"), uri).collect()
    raw = gzip.decompress((tmp_path / "archives" / m.file).read_bytes()).replace(b"<html>", b"<HTML>", 1)
    (tmp_path / "archives" / m.file).write_bytes(gzip.compress(raw))
    with pytest.raises(Exception, match="damaged"):
        warc.read(spark, uri).collect()


def test_empty_table_and_strays(spark, tmp_path):
    uri = f"file://{tmp_path}"
    df = spark.createDataFrame(pages(), "page_id long, url string, html string, x string")
    assert warc.write(df.limit(0), uri).count() == 0
    (tmp_path / "archives" / "shard-000000-00000.warc.gz").write_bytes(b"stray")
    assert warc.read(spark, uri).count() == 0


def sizes(spark, uri, df, **how):
    return [m.raw_bytes for m in warc.write(df, uri, roll_bytes=1 << 40, **how).collect()]


def test_shards_are_of_equal_bytes_however_ids_lie(spark, tmp_path):
    page = lambda i: (i, None, f"{i} " + "y" * 2000)
    strays = [page(i) for i in (10**15, -(1 << 63), (1 << 63) - 1)]
    df = spark.createDataFrame([*(page(i) for i in range(900)), *strays, *[page(5)] * 3, *(page(7)[:2] + (f"{i}" + "z" * 2000,) for i in range(300)), (None, None, None)], "page_id long, url string, html string")
    got = sizes(spark, f"file://{tmp_path}/a", df, shard_bytes=100_000)
    assert len(got) > 25 and max(got) < 200_000
    assert warc.read(spark, f"file://{tmp_path}/a").count() == df.count()
    with pytest.raises(ValueError, match="integer"):
        warc.write(df.withColumn("page_id", df.page_id.cast("string")), f"file://{tmp_path}/b")


def test_cuts_of_many_records_in_one_range(spark):
    rows = spark.range(1_000_000).selectExpr("id as page_id", "hash(id) as tie", "400L as size").unionByName(spark.range(10**15, 10**15 + 1).selectExpr("id as page_id", "0 as tie", "400L as size"))
    at = warc.cuts(rows, 10_000_000)
    ids = np.frombuffer(at.tobytes().ljust(16 * len(at)), ">u8").reshape(-1, 2)[:, 0].astype(np.int64) ^ np.int64(-(1 << 63))
    assert len(at) == 100 and np.abs(np.diff(ids)[:-1] - 10_000).max() <= 1 and ids[-1] == 10**15
