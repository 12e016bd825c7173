"""Sources and sinks (S, K), each as a query with its oracle. Files are made from small tables, in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import normalize as N
from tidemark.plans.lake import query, read
from tidemark.sources import archives as A
from tidemark.sources import sinks as K
from tidemark.sources import tables as T


MOST = 20_000


def _text(df, sep: str, cols=None) -> str:
    """A small table as delimited text; larger ones are refused."""
    rows = [df.columns if cols is None else cols, *df.limit(MOST + 1).collect()]
    if len(rows) > MOST + 1:
        raise ValueError(f"more than {MOST} rows are not written by the driver")
    return "\n".join(sep.join("" if v is None else str(v) for v in r) for r in rows) + "\n"


def _nation(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query("S1_parquet_scan", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem")
def s1(spark, sf):
    return T.read_any(spark, f"{sf}/lineitem.parquet").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"))


@query("S2_projected_read", "SELECT o_orderkey, o_orderdate FROM orders")
def s2(spark, sf):
    return T.read_table(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_orderdate"], ["o_orderdate"])


@query("S3_union_by_name", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(NULL AS VARCHAR) AS r_name FROM nation UNION ALL SELECT NULL, NULL, r_name FROM region")
def s3(spark, sf):
    d = K.scratch(spark, "s3")
    a = T.write_bytes(spark, f"{d}/a.csv", _text(_nation(spark, sf).select("n_nationkey", "n_name"), ",").encode())
    b = T.write_bytes(spark, f"{d}/b.csv", _text(read(spark, sf, "region").select("r_name"), ",").encode())
    return T.read_csvs(spark, [a, b], sep=",")


@query("S4_permissive_csv", "SELECT CAST(r_regionkey AS VARCHAR) AS k, r_name AS v FROM region UNION ALL SELECT 'x', NULL")
def s4(spark, sf):
    text = _text(read(spark, sf, "region").select("r_regionkey", "r_name"), ",", ["k", "v"]) + "x\n"
    return T.read_csvs(spark, [T.write_bytes(spark, f"{K.scratch(spark, 's4')}/r.csv", text.encode())])


@query("S5_by_suffix", " UNION ALL ".join(f"SELECT '{f}' AS kind, count(*) AS n FROM {t}" for f, t in (("idx", "nation"), ("json", "region"), ("blanks", "region"))))
def s5(spark, sf):
    d = K.scratch(spark, "s5")
    T.write_bytes(spark, f"{d}/n.idx", _text(_nation(spark, sf), "|").encode())
    T.write_bytes(spark, f"{d}/r.json", A.to_json([r.asDict() for r in read(spark, sf, "region").collect()]).encode())
    T.write_bytes(spark, f"{d}/b.txt", _text(read(spark, sf, "region").select("r_regionkey", "r_name"), "   ").encode())
    one = lambda f, p: T.read_any(spark, p).agg(F.count("*").alias("n")).select(F.lit(f).alias("kind"), "n")
    return one("idx", f"{d}/n.idx").unionByName(one("json", f"{d}/r.json")).unionByName(one("blanks", f"{d}/b.txt"))


@query("S6_sniffed", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def s6(spark, sf):
    return T.read_csvs(spark, [T.write_bytes(spark, f"{K.scratch(spark, 's6')}/n.txt", _text(_nation(spark, sf), "\t").encode())])


def _zipped(spark, name: str, members: dict[str, str]) -> list[str]:
    return [T.write_bytes(spark, f"{K.scratch(spark, name)}/{name}.zip", A.make_zip(members))]


def _archives(spark, name: str, sep: str, members: dict) -> list[str]:
    """Tables of any size as members of archives that executors write."""
    lines = None
    for m, df in members.items():
        one = A.member_lines(df, m, sep)
        lines = one if lines is None else lines.unionByName(one)
    return A.write_zips(lines, K.scratch(spark, name), {m: sep.join(df.columns) for m, df in members.items()})


@query("S7_zip_member", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name FROM nation")
def s7(spark, sf):
    z = _zipped(spark, "s7", {"readme.htm": "x", "d/sub.txt": _text(_nation(spark, sf), "\t"), "d/z.txt": "a\n"})
    return A.zip_rows(spark, z, "sub").select(A.field("n_nationkey").alias("k"), A.field("n_name").alias("name"))


@query("S8_submissions", "SELECT lpad(CAST(c_custkey + 1 AS VARCHAR), 10, '0') AS issuer_cik, c_name AS entity_name, CAST(3 AS BIGINT) AS filings, '10-K;8-K' AS forms FROM customer")
def s8(spark, sf):
    k = (F.col("c_custkey") + 1).cast("string")
    texts = lambda *v: F.array(*(F.lit(x) for x in v))
    numbers = F.array(*(F.concat(F.col("c_custkey").cast("string"), F.lit(f"-{i}")) for i in (1, 2, 3)))
    recent = F.struct(numbers.alias("accessionNumber"), texts("2020-01-01", "2020-05-01", "bad").alias("filingDate"), texts("10-K", "8-K", "8-K").alias("form"), texts("", "4.02", None).alias("items"))
    one = F.to_json(F.struct(k.alias("cik"), F.col("c_name").alias("name"), F.struct(recent.alias("recent")).alias("filings")))
    lines = read(spark, sf, "customer").select(F.concat(F.lit("CIK"), F.lpad(k, 10, "0"), F.lit(".json")).alias("member"), one.alias("line"))
    issuer, filing = A.submissions(A.zip_texts(spark, A.write_zips(lines, K.scratch(spark, "s8"), per_file=5000)))
    f = filing.groupBy("issuer_cik").agg(F.count("*").alias("filings"), F.array_join(F.array_sort(F.collect_set("form")), ";").alias("forms"))
    return issuer.select("issuer_cik", "entity_name").join(f, "issuer_cik")


def _facts(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("adsh"), F.col("o_custkey").alias("cik"), F.date_format("o_orderdate", "yyyyMMdd").alias("period"))
    l = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("adsh"), F.lit("Assets").alias("tag"), F.date_format("l_shipdate", "yyyyMMdd").alias("ddate"), F.col("l_linenumber").alias("qtrs"), F.lit("USD").alias("uom"), F.round("l_extendedprice", 2).cast("decimal(20,2)").alias("value"))
    return _archives(spark, "facts", "\t", {"sub.txt": o, "num.txt": l})


@query("S9_fact_archive", "SELECT CAST(o_orderkey AS VARCHAR) AS adsh, CASE WHEN o_custkey > 0 THEN lpad(CAST(o_custkey AS VARCHAR), 10, '0') END AS issuer_cik, CAST(o_orderdate AS DATE) AS fiscal_period_end FROM orders")
def s9(spark, sf):
    return _filings(spark, _facts(spark, sf))


def _filings(spark, archives):
    return A.fact_filings(A.zip_rows(spark, archives, "sub")).select("adsh", "issuer_cik", "fiscal_period_end")


@query("S10_notes_archive", "SELECT CAST(r_regionkey AS VARCHAR) AS adsh, 2 AS note_text_count, CAST(2 * length(r_name) AS BIGINT) AS note_text_char_count FROM region")
def s10(spark, sf):
    r = read(spark, sf, "region").select(F.col("r_regionkey").alias("adsh"), F.lit("T").alias("tag"), "r_name")
    z = _zipped(spark, "n1", {"txt.txt": _text(r, "\t", ["adsh", "tag", "txt"])}) + _zipped(spark, "n2", {"txt.txt": _text(r, "\t", ["adsh", "tag", "text"])})
    return A.note_summary(A.notes(A.zip_rows(spark, z, "txt"))).withColumn("note_text_count", F.col("note_text_count").cast("int"))


@query("S11_fact_manifest", "SELECT CAST(l_orderkey AS VARCHAR) AS adsh, count(*) AS n, CAST(sum(CAST(round(l_extendedprice, 2) AS DECIMAL(28,4))) AS VARCHAR) AS total FROM lineitem GROUP BY 1")
def s11(spark, sf):
    return _totals(spark, _facts(spark, sf))


def _totals(spark, archives):
    f = A.core_facts(A.zip_rows(spark, archives, "num"), ["Assets"])
    return f.groupBy("adsh").agg(F.count("*").alias("n"), F.sum("value").cast("string").alias("total"))


@query("S12_notes_modes", "SELECT 'raw' AS mode, count(*) AS n FROM region UNION ALL SELECT 'summary', count(*) FROM region UNION ALL SELECT 'skip', 0")
def s12(spark, sf):
    r = read(spark, sf, "region").select(F.col("r_regionkey").alias("adsh"), F.lit("T").alias("tag"), F.col("r_name").alias("txt"))
    n = A.notes(A.zip_rows(spark, _zipped(spark, "n", {"txt.txt": _text(r, "\t")}), "txt"))
    by = {"raw": n, "summary": A.note_summary(n), "skip": n.limit(0)}
    out = None
    for m, df in by.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(m).alias("mode"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("S13_many_archives", "SELECT count(*) * 2 AS n FROM nation")
def s13(spark, sf):
    t = _text(_nation(spark, sf), "\t")
    return A.zip_rows(spark, _zipped(spark, "m1", {"sub.txt": t}) + _zipped(spark, "m2", {"sub.txt": t}), "sub").agg(F.count("*").alias("n"))


@query("S14_form_ap", "SELECT CAST(s_suppkey AS VARCHAR) AS form_filing_id, CASE WHEN s_suppkey > 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 10, '0') END AS issuer_cik, TIMESTAMP '2020-03-01' AS filing_date FROM supplier")
def s14(spark, sf):
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("Form Filing ID"), F.col("s_suppkey").alias("Issuer CIK"), F.lit("03/01/2020").alias("Filing Date"))
    z = _archives(spark, "ap", ",", {"FirmFilings.csv": s})
    return A.form_ap(A.zip_rows(spark, z, "FirmFilings")).select("form_filing_id", "issuer_cik", "filing_date")


@query("S15_header_aliases", "SELECT CAST(r_regionkey AS VARCHAR) AS pcaob_firm_id, r_name AS firm_name, CAST(2000 + r_regionkey AS INTEGER) AS inspection_year, CAST(NULL AS VARCHAR) AS source_file FROM region")
def s15(spark, sf):
    r = read(spark, sf, "region").select("r_regionkey", "r_name", (2000 + F.col("r_regionkey")).cast("string").alias("y"))
    raw = r.withColumnsRenamed({"r_regionkey": "Firm ID", "r_name": "FIRM NAME", "y": "Year"})
    return T.align(raw, "pcaob_firm_id string, firm_name string, inspection_year int, source_file string", {"pcaob_firm_id": ["firm id"], "firm_name": ["Firm Name"], "inspection_year": ["year"]})


@query("S16_raw_dataset", "SELECT CAST(n_nationkey AS VARCHAR) AS k FROM nation")
def s16(spark, sf):
    members = {"notes.md": "x", "data.csv": _text(_nation(spark, sf), ",")}
    z = _zipped(spark, "raw", members)
    path = K.scratch(spark, "dataset")
    K.write_table(A.zip_rows(spark, z, A.only_member(list(members), ".csv")).select(A.field("n_nationkey").alias("k")), path)
    return spark.read.parquet(path)


@query("S17_link_filter", "SELECT url, try_cast(nullif(regexp_extract(url, '((?:20|19)[0-9]{2})', 1), '') AS INTEGER) AS year_hint FROM pages WHERE contains(lower(url), 'example') AND try_cast(nullif(regexp_extract(url, '((?:20|19)[0-9]{2})', 1), '') AS INTEGER) >= 1900")
def s17(spark, sf):
    return T.filter_links(read(spark, sf, "pages").select("url"), "EXAMPLE", 1900)


@query("S18_business_days", "SELECT CAST(d AS DATE) AS day, CAST(quarter(d) AS INTEGER) AS quarter, concat(CAST(year(d) AS VARCHAR), '/QTR', CAST(quarter(d) AS VARCHAR), '/master.', strftime(d, '%Y%m%d'), '.idx') AS path FROM (SELECT unnest(generate_series(TIMESTAMP '2023-11-20', TIMESTAMP '2024-04-10', INTERVAL 1 DAY)) AS d) WHERE dayofweek(d) NOT IN (0, 6)")
def s18(spark, sf):
    return D.business_days(spark, "2023-11-20", "2024-04-10")


@query("S19_empty_source", "SELECT CAST(0 AS BIGINT) AS n, 'k:bigint,v:string' AS kinds")
def s19(spark, sf):
    e = T.source_or_empty(spark, f"{sf}/absent.parquet", "k long, v string")
    return e.agg(F.count("*").alias("n")).withColumn("kinds", F.lit(",".join(f"{a}:{b}" for a, b in e.dtypes)))


@query("S20_preferred_path", "SELECT 'orders.parquet' AS name")
def s20(spark, sf):
    return spark.createDataFrame([(T.preferred(spark, f"{sf}/orders").rsplit("/", 1)[-1],)], "name string")


@query("S21_config", "SELECT r_name AS k, (SELECT string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS v FROM region")
def s21(spark, sf):
    of = read(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_nationkey")), ", ").alias("k"))
    lines = [f"{r.r_name}: [{r.k}]" for r in read(spark, sf, "region").join(of, F.col("r_regionkey") == F.col("n_regionkey")).collect()]
    c = T.read_config(T.write_bytes(spark, f"{K.scratch(spark, 's21')}/c.yaml", "\n".join(lines).encode()), spark)
    return spark.createDataFrame([(k, ",".join(map(str, v))) for k, v in c.items()], "k string, v string")


@query("S22_ticker_lists", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'AB,C-D' WHEN 1 THEN 'X,Y,Z' ELSE '' END AS t FROM supplier")
def s22(spark, sf):
    k = F.col("s_suppkey") % 3
    raw = F.when(k == 0, '["ab", "c.d", null]').when(k == 1, "x; y,z").otherwise("[]")
    return read(spark, sf, "supplier").select("s_suppkey", F.array_join(N.tickers(raw), ",").alias("t"))


def _written(spark, sf, name: str, source: str, **how):
    path = K.scratch(spark, name)
    K.write_table(read(spark, sf, source), path, **how)
    return path


@query("K1_write_table", "SELECT * FROM nation")
def k1(spark, sf):
    return spark.read.parquet(_written(spark, sf, "k1", "nation", one_file=True, order=["n_nationkey"]))


@query("K2_partitioned_write", "SELECT o_orderkey, o_orderstatus FROM orders")
def k2(spark, sf):
    path = K.scratch(spark, "k2")
    K.write_table(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), path, partition_by=["o_orderstatus"])
    return spark.read.parquet(path)


@query("K3_csv_write", "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def k3(spark, sf):
    return spark.read.option("header", True).csv(_written(spark, sf, "k3", "region", fmt="csv")).select("r_regionkey", "r_name")


@query("K4_year_shards", "SELECT CAST(year(d) AS INTEGER) AS year, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderdate END AS d FROM orders) GROUP BY 1")
def k4(spark, sf):
    path = K.scratch(spark, "k4")
    K.write_by_year(read(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate")).alias("d")), path, "d", ["d", "o_orderkey"])
    return spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"))


@query("K5_parts_to_final", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1")
def k5(spark, sf):
    path = K.scratch(spark, "k5")
    read(spark, sf, "lineitem").withColumn("part_batch", F.col("l_orderkey") % 3).write.partitionBy("part_batch").parquet(path)
    return spark.read.parquet(path).drop("part_batch").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("K6_append", "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, count(*) AS n FROM (SELECT * FROM region UNION ALL SELECT * FROM region) GROUP BY 1")
def k6(spark, sf):
    path = K.scratch(spark, "k6")
    for _ in range(2):
        K.append(read(spark, sf, "region"), path)
    return spark.read.option("header", True).csv(path).groupBy("r_regionkey").agg(F.count("*").alias("n"))


@query("K7_summary", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def k7(spark, sf):
    n = {r.o_orderstatus: r["count"] for r in read(spark, sf, "orders").groupBy("o_orderstatus").count().collect()}
    back = T.read_json(spark, K.write_summary(spark, n, f"{K.scratch(spark, 'k7')}/s.json"))
    return spark.createDataFrame(list(back.items()), "status string, n long")


@query("K8_entity_sample", "SELECT 100 AS entities, true AS whole")
def k8(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    s = K.sample_entities(o, "o_custkey", 100)
    whole = o.join(s.select("o_custkey").distinct(), "o_custkey", "left_semi").count() == s.count()
    return s.agg(F.countDistinct("o_custkey").cast("int").alias("entities")).withColumn("whole", F.lit(whole))


@query("K9_atomic_write", "SELECT max(r_name) AS name, 1 AS files FROM region")
def k9(spark, sf):
    d = K.scratch(spark, "k9")
    for r in read(spark, sf, "region").orderBy("r_name").collect():  # each version replaces the one before
        K.write_summary(spark, {"name": r.r_name}, f"{d}/s.json")
    fs, p = T.filesystem(spark, d)
    return spark.createDataFrame([(T.read_json(spark, f"{d}/s.json")["name"], len([x for x in fs.listStatus(p) if not x.getPath().getName().endswith(".crc")]))], "name string, files int")


_ROWS = "(SELECT * FROM region ORDER BY r_regionkey)"


@query("K10_report_table", f"SELECT 'report.md' AS file, '| r_regionkey | r_name |' || chr(10) || '|---|---|' || chr(10) || string_agg(concat('| ', r_regionkey, ' | ', r_name, ' |'), chr(10)) AS text FROM {_ROWS} UNION ALL SELECT 'report.csv', 'r_regionkey,r_name' || chr(10) || string_agg(concat(r_regionkey, ',', r_name), chr(10)) || chr(10) FROM {_ROWS} UNION ALL SELECT 'report.tex', concat(chr(92), 'begin{{tabular}}{{ll}}', chr(10), 'r', chr(92), '_regionkey & r', chr(92), '_name ', chr(92), chr(92), chr(10), chr(92), 'hline', chr(10)) || string_agg(concat(r_regionkey, ' & ', r_name, ' ', chr(92), chr(92)), chr(10)) || concat(chr(10), chr(92), 'end{{tabular}}', chr(10)) FROM {_ROWS}")
def k10(spark, sf):
    d = K.scratch(spark, "k10")
    files = K.bundle(spark, read(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), d, "report")
    return spark.createDataFrame([(f.rsplit("/", 1)[-1], T.read_text(spark, f)) for f in files], "file string, text string")
