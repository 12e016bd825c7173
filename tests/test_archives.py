"""Archives that executors write hold every row of their tables."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.plans import catalog, scans
from tidemark.sources import archives as A

N = 21_000


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Tables with more rows than the driver would write."""
    d = str(tmp_path_factory.mktemp("large"))
    one = spark.range(1, N + 1)
    day = F.lit("2001-02-03").cast("timestamp_ntz")
    one.select((F.col("id") * 20).alias("o_orderkey"), (F.col("id") % 7 + 1).alias("o_custkey"), day.alias("o_orderdate")).write.parquet(f"{d}/orders.parquet")
    one.select((F.floor(F.col("id") / 2) * 20).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") + 0.25).alias("l_extendedprice"), day.alias("l_shipdate")).write.parquet(f"{d}/lineitem.parquet")
    one.select(F.col("id").alias("s_suppkey")).write.parquet(f"{d}/supplier.parquet")
    return d


def test_no_row_is_lost(spark, sf):
    facts = {r.adsh: (r.n, Decimal(r.total)) for r in catalog.QUERIES["S11_fact_manifest"](spark, sf).collect()}
    want = {}
    for i in range(1, N + 1):
        n, total = want.get(str(i // 2 * 20), (0, Decimal(0)))
        want[str(i // 2 * 20)] = n + 1, total + Decimal(i) + Decimal("0.25")
    assert facts == want
    assert {r.adsh for r in catalog.QUERIES["S9_fact_archive"](spark, sf).collect()} == {str(20 * i) for i in range(1, N + 1)}
    assert {r.form_filing_id for r in catalog.QUERIES["S14_form_ap"](spark, sf).collect()} == {str(i) for i in range(1, N + 1)}


def test_the_driver_refuses_large_tables(spark):
    with pytest.raises(ValueError, match="rows"):
        scans._text(spark.range(scans.MOST + 1), ",")


def test_archives_of_several_members(spark, tmp_path):
    a, b = spark.createDataFrame([(i, None if i % 5 == 0 else f"v{i}") for i in range(250)], "k long, v string"), spark.createDataFrame([(1, "x")], "k long, w string")
    files = A.write_zips(A.member_lines(a, "d/sub.txt", "\t").unionByName(A.member_lines(b, "num.txt", "\t")), f"{tmp_path}/z", {"d/sub.txt": "k\tv", "num.txt": "k\tw"}, per_file=50)
    assert len(files) == 6
    got = A.zip_rows(spark, files, "sub").select(A.field("k").alias("k"), A.field("v").alias("v")).collect()
    assert sorted((int(r.k), r.v) for r in got) == sorted(map(tuple, a.collect()))
    assert [tuple(r) for r in A.zip_rows(spark, files, "num").select(A.field("k"), A.field("w")).collect()] == [("1", "x")]
    none = A.write_zips(A.member_lines(b.limit(0), "num.txt", "\t"), f"{tmp_path}/e", {"num.txt": "k\tw"})
    assert A.zip_rows(spark, none, "num").count() == 0
