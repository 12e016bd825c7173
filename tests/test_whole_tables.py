"""The queries over whole tables, against brute force on a small fixture whose keys lie outside the old subsets."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import overlap as V
from tidemark.plans import catalog


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    day = F.lit("2001-02-03").cast("timestamp_ntz")
    spark.createDataFrame([(i, f"C{i}", i % 3, "BUILDING" if i % 2 else "OTHER") for i in range(51, 131)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(i, i % 4) for i in range(21, 61)], "s_suppkey long, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([(i, 51 + i % 90) for i in range(1, 300)], "o_orderkey long, o_custkey long").withColumn("o_orderdate", day).write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(i // 3, i % 3, float(i)) for i in range(3, 900)], "l_orderkey long, l_linenumber int, l_extendedprice double").withColumn("l_shipdate", day).write.parquet(f"{d}/lineitem.parquet")
    return d


def test_archives(spark, sf):
    run = lambda n: catalog.QUERIES[n](spark, sf).collect()
    assert sorted((r.issuer_cik, r.entity_name, r.filings, r.forms) for r in run("S8_submissions")) == [(f"{i + 1:010d}", f"C{i}", 3, "10-K;8-K") for i in range(51, 131)]
    assert {(r.adsh, r.issuer_cik) for r in run("S9_fact_archive")} == {(str(i), f"{51 + i % 90:010d}") for i in range(1, 300)}
    got = {r.adsh: (r.n, float(r.total)) for r in run("S11_fact_manifest")}
    assert got == {str(k): (3, 9.0 * k + 3) for k in range(1, 300)}


def test_joins(spark, sf):
    got = {(r.t, r.id): (r.matches, r.least) for r in catalog.QUERIES["J14_typed_identifiers"](spark, sf).collect()}
    assert got == {("key", i): (1, i) for i in range(51, 61)} | {("segment", i): (40, 21) for i in range(51, 131, 2)}
    n = Counter(51 + i % 90 for i in range(1, 300))
    got = {r.s_suppkey: (r.customers, r.n) for r in catalog.QUERIES["J15_bridge_join"](spark, sf).collect()}
    of = lambda k: [i for i in range(51, 131) if i % 3 == k]
    assert got == {s: (len(of(s % 4)), sum(n[i] for i in of(s % 4))) for s in range(21, 61)}


@pytest.fixture(scope="module")
def from_zero(spark, tmp_path_factory):
    """Two nations whose keys count from 0, and copies with shifted keys."""
    d = str(tmp_path_factory.mktemp("zero"))
    spark.createDataFrame([(i, i // 10 % 2) for i in range(80)], "c_custkey long, c_nationkey int").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(i, i // 10 % 2) for i in range(120)], "s_suppkey long, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    orders = [(c, y, s) for c in range(0, 80, 3) for y in range(1992, 1998) for s in "FO" if (c + y) % 4 > (s == "F")]
    spark.createDataFrame([(i, c, s, f"{y}-05-06") for i, (c, y, s) in enumerate(orders)], "o_orderkey long, o_custkey long, o_orderstatus string, d string").selectExpr("o_orderkey", "o_custkey", "o_orderstatus", "cast(d as timestamp_ntz) as o_orderdate").write.parquet(f"{d}/orders.parquet")
    return d


def same_as_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("customer", "supplier", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = c.sql(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLE[name]})").fetchall()
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return [dict(zip(cols, r)) for r in got]


def test_annual_links_with_issuer_0(spark, from_zero):
    assert any(r["issuer_cik"] == "0" * 10 for r in same_as_sql(spark, from_zero, "Q12_annual_links"))


def test_overlap_with_issuer_0(spark, from_zero):
    assert same_as_sql(spark, from_zero, "Q14_public_overlap")[0]["public_links"] > 0


def test_overlap_panel_with_issuer_0(spark, from_zero):
    assert any("0" * 10 in (r["issuer_ciks"] or "") for r in same_as_sql(spark, from_zero, "Q16_overlap_panel"))


def without_pairs(monkeypatch):
    """Links between all suppliers and customers can't be had."""
    from tidemark.plans import composites

    def links(*_):
        raise AssertionError("pairs of suppliers and customers are formed")

    monkeypatch.setattr(composites, "links", links)


def test_tiers_without_pairs(spark, from_zero, monkeypatch):
    without_pairs(monkeypatch)
    assert len(same_as_sql(spark, from_zero, "Q16_overlap_tiers")) > 2


def test_class_tiers_equal_tiers_of_pairs(spark):
    """Firms and issuers of several classes, and issuers whose one public row decides the tier."""
    firms = [("1", "a"), ("2", "a"), ("2", "b"), ("3", "b"), ("4", "c"), ("6", "e")]
    issuers = [("x", "p"), ("x", "q"), ("y", "q"), ("z", "r"), ("v", "s")]
    annual = [("a", 1, "p"), ("a", 1, "q"), ("b", 1, "r"), ("b", 2, "q"), ("a", 2, "p"), ("c", 1, "s"), ("e", 2, "r")]
    raw = [(f"{f}-{y}", f, y) for f in "123456" for y in (1, 2)]
    public = [("x", 2, 1), ("y", 1, 2), ("z", 1, 1), ("v", 2, 3), ("z", 2, 4)]
    raw = spark.createDataFrame(raw, "raw_row_id string, gvkey string, data_year int")
    public = spark.createDataFrame(public, "issuer_cik string, data_year int, annual_public_row_count long")
    pairs = spark.createDataFrame(sorted({(f, y, i) for g, y, c in annual for f, k in firms if k == g for i, j in issuers if j == c}), "gvkey string, data_year int, issuer_cik string")
    want = V.tiers(V.bridge(raw, pairs, public, []))
    got = V.class_tiers(raw, spark.createDataFrame(annual, "gvkey string, data_year int, issuer_cik string"), spark.createDataFrame(firms, "gvkey string, class string"), spark.createDataFrame(issuers, "issuer_cik string, class string"), public)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.select("reason_code").distinct().count() == 5


def test_evidence_without_pairs(spark, from_zero, monkeypatch):
    without_pairs(monkeypatch)
    assert same_as_sql(spark, from_zero, "Q20_evidence")[0]["unknown"] == "B"


def test_annual_links_without_pairs(spark, from_zero, monkeypatch):
    without_pairs(monkeypatch)
    assert len({r["source"] for r in same_as_sql(spark, from_zero, "Q12_annual_links")}) == 2


#: Firms and issuers, some of several classes, and the annual links between classes
FIRMS = [("1", "a"), ("2", "a"), ("2", "b"), ("3", "b"), ("4", "c"), ("5", "a"), ("6", "e"), ("7", "f"), (None, "a"), ("8", None)]
ISSUERS = [("x", "p"), ("x", "q"), ("y", "q"), ("z", "r"), ("v", "s"), ("t", "o"), *((f"w{n}", "p") for n in range(30))]
ANNUAL = [("a", 1, "p", "A;C"), ("a", 1, "q", "B"), ("b", 1, "q", "D"), ("b", 1, "r", ""), ("b", 2, "q", "B"), ("a", 2, "p", "C"), ("c", 1, "s", ""), ("e", 2, "r", "A")]


def pairs():
    """Sources of the links of firms and issuers, by brute force."""
    out = {}
    for g, y, c, source in ANNUAL:
        for f in (f for f, k in FIRMS if k == g and f):
            for i in (i for i, k in ISSUERS if k == c):
                out.setdefault((f, y, i), set()).update(filter(None, source.split(";")))
    return out


def class_tables(spark):
    annual = spark.createDataFrame(ANNUAL, "gvkey string, data_year int, issuer_cik string, source string")
    firms = spark.createDataFrame(FIRMS, "gvkey string, class string").filter("gvkey is not null")
    return annual, firms, spark.createDataFrame(ISSUERS, "issuer_cik string, class string")


def test_class_links_equal_pairs(spark):
    """A link that several classes give is one row with all its sources."""
    got = [tuple(r) for r in V.class_links(*class_tables(spark), ["source"]).collect()]
    assert sorted(got) == sorted((*k, ";".join(sorted(v))) for k, v in pairs().items()) and ("2", 1, "x", "A;B;C;D") in got


def test_overlap_without_pairs(spark, from_zero, monkeypatch):
    without_pairs(monkeypatch)
    assert same_as_sql(spark, from_zero, "Q14_public_overlap")[0]["links"] > 0


#: Public rows of issuers by year; one issuer is in no class, and one year has no links
PUBLIC = [("x", 1, 2, 1, 5, 0), ("y", 1, 3, 2, 2, 1), ("z", 2, 1, 4, 4, 0), ("w3", 2, 1, 3, 3, None), ("v", 3, 1, 1, 1, 1), ("u", 1, 9, 0, 9, 1)]


def public_table(spark):
    return spark.createDataFrame(PUBLIC, "issuer_cik string, data_year int, annual_public_row_count long, origin_date_min long, origin_date_max long, label int")


def test_class_overlap_equals_pairs(spark):
    of, public = pairs(), {p[:2] for p in PUBLIC}
    hit = [k for k in of if (k[2], k[1]) in public]
    got = V.class_overlap(*class_tables(spark), public_table(spark)).first()
    assert tuple(got) == (len(of), len(hit), len({k[0] for k in of}), len({k[0] for k in hit})) and got.firms > got.public_firms > 0
    none = V.class_overlap(*class_tables(spark), public_table(spark).filter("data_year = 3")).first()
    assert tuple(none) == (len(of), 0, got.firms, 0)
    annual, firms, issuers = class_tables(spark)
    assert tuple(V.class_overlap(annual.filter("false"), firms, issuers, public_table(spark)).first()) == (0, 0, 0, 0)


def test_overlap_panel_without_pairs(spark, from_zero, monkeypatch):
    without_pairs(monkeypatch)
    assert len({r["bridge_tier"] for r in same_as_sql(spark, from_zero, "Q16_overlap_panel")}) > 1


def test_class_panel_equals_panel_of_pairs(spark):
    """Also rows that are there twice, and firms without a class or an issuer."""
    raw = [(f"{f}-{y}", f, y, int(f) % 2) for f in "123456789" for y in (1, 2, 3)]
    raw = spark.createDataFrame(raw + raw[3:5], "raw_row_id string, gvkey string, data_year int, benchmark_label int")
    links = spark.createDataFrame(sorted(pairs()), "gvkey string, data_year int, issuer_cik string")
    j = V.bridge(raw, links, public_table(spark), ["label"])
    want = V.overlap_panel(j, V.tiers(j), ["label"], ["benchmark_label"])
    got = V.class_panel(raw, *class_tables(spark), public_table(spark), ["label"], ["benchmark_label"])
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.select("bridge_tier").distinct().count() == 3


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Issuers of more than ten digits, of which SQL keeps ten, rows that are there twice, keys of two nations, and nations below 0 or unknown."""
    d = str(tmp_path_factory.mktemp("odd"))
    keys = [*range(0, 40), *(10**10 + i for i in range(40)), *(10**11 + 7 * i for i in range(20))]
    nation = lambda i: (None, -1, 0, 1, 2)[i // 10 % 5]
    spark.createDataFrame([(k, nation(k + n)) for n in (0, 0, 20) for k in keys], "c_custkey long, c_nationkey int").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(k, nation(k + n)) for n in (0, 0, 10) for k in (*range(60), 10**10 + 1, 10**10 + 31)], "s_suppkey long, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    orders = [(k, y) for k in keys[::3] for y in range(1993, 1997) if (k + y) % 3]
    spark.createDataFrame([(i, k, "FO"[i % 2], f"{y}-05-06") for i, (k, y) in enumerate(orders)], "o_orderkey long, o_custkey long, o_orderstatus string, d string").selectExpr("o_orderkey", "o_custkey", "o_orderstatus", "cast(d as timestamp_ntz) as o_orderdate").write.parquet(f"{d}/orders.parquet")
    return d


@pytest.mark.parametrize("name", ["Q12_annual_links", "Q14_public_overlap", "Q16_overlap_tiers", "Q16_overlap_panel", "Q20_evidence"])
def test_links_of_odd_keys(spark, odd, name):
    assert same_as_sql(spark, odd, name)
