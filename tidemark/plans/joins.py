"""Joins (J), each as a query with its oracle. No plan here holds a nested-loop join or a Cartesian product."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.normalize import form_key
from tidemark.operators import events as E
from tidemark.operators import facts as X
from tidemark.operators import overlap as V
from tidemark.operators import panel as P
from tidemark.operators.audit import assert_unique
from tidemark.operators.reports import event_time
from tidemark.operators.temporal import asof_join, exists_ahead, window_counts
from tidemark.plans.lake import duck, query, read, view


@query("J1_validated_left", f"WITH {duck('filing', 'period')} SELECT f.accession, fsds_fiscal_period_end AS period_end FROM filing f LEFT JOIN period p ON nullif(trim(f.accession), '') = p.accession")
def j1(spark, sf):
    p = assert_unique(view(spark, sf, "period").withColumnRenamed("accession", "_a"), ["_a"])
    return view(spark, sf, "filing").join(p, F.nullif(F.trim("accession"), F.lit("")) == F.col("_a"), "left").select("accession", F.col("fsds_fiscal_period_end").alias("period_end"))


@query("J2_left_chain", "SELECT o_orderkey, n, c_name, n_name FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1) USING (o_orderkey) LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def j2(spark, sf):
    n = read(spark, sf, "lineitem").filter("l_quantity > 25").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    c, a = read(spark, sf, "customer"), read(spark, sf, "nation")
    return read(spark, sf, "orders").join(n, "o_orderkey", "left").join(c, F.col("o_custkey") == c["c_custkey"], "left").join(a, c["c_nationkey"] == a["n_nationkey"], "left").select("o_orderkey", "n", "c_name", "n_name")


_NS = "SELECT CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS source, doc_id FROM documents"


@query("J3_null_safe", f"WITH a AS ({_NS}), b AS (SELECT lang, source, count(*) AS n FROM a GROUP BY ALL) SELECT doc_id, n FROM a JOIN b ON a.lang IS NOT DISTINCT FROM b.lang AND a.source IS NOT DISTINCT FROM b.source")
def j3(spark, sf):
    d = read(spark, sf, "documents")
    a = d.select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source"))
    b = a.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.count("*").alias("n"))
    return a.join(b, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "n")


_ANNUAL = "f AS (SELECT *, CAST(year(report_date) AS INTEGER) AS fiscal_year FROM filing WHERE upper(trim(form)) IN ('10-K', '10-K/A'))"


@query("J4_equi_and_before", f"WITH {duck('filing', 'form_ap')}, {_ANNUAL} SELECT f.accession, f.issuer_cik, count(DISTINCT form_filing_id) AS form_ap_filing_count, count(DISTINCT engagement_partner_id) AS form_ap_unique_partners, round(avg(number_of_participants), 6) AS form_ap_avg_participants FROM f JOIN form_ap e ON e.issuer_cik = f.issuer_cik AND year(e.fiscal_period_end) = f.fiscal_year AND e.filing_date < f.filing_date GROUP BY ALL")
def j4(spark, sf):
    f = view(spark, sf, "filing").filter(form_key("form").isin("10-K", "10-K/A")).withColumns({"fiscal_year": F.year("report_date"), "origin_date": F.col("filing_date")})
    return P.form_ap_summary(f, view(spark, sf, "form_ap")).withColumn("form_ap_avg_participants", F.round("form_ap_avg_participants", 6))


ENGAGED = "e AS (SELECT DISTINCT issuer_cik, fiscal_period_end, filing_date AS d, form_filing_id, trim(engagement_partner_id) AS partner FROM form_ap WHERE trim(engagement_partner_id) <> '')"


@query("J5_asof_strict", f"WITH {duck('filing', 'form_ap')}, {ENGAGED}, r AS (SELECT f.accession, e.partner, row_number() OVER (PARTITION BY f.accession ORDER BY e.d DESC, e.partner) AS rn FROM filing f JOIN e ON e.issuer_cik = f.issuer_cik AND e.d < f.filing_date) SELECT f.accession, r.partner AS engagement_partner_id FROM filing f LEFT JOIN r ON r.accession = f.accession AND rn = 1")
def j5(spark, sf):
    e = E.engagements(view(spark, sf, "form_ap"))
    return asof_join(view(spark, sf, "filing").select("issuer_cik", "accession", "filing_date"), e, ["issuer_cik"], "filing_date", "form_ap_public_date", ["engagement_partner_id"], ties=["engagement_partner_id"]).select("accession", "engagement_partner_id")


@query("J6_event_to_engaged", f"WITH {duck('filing', 'form_ap')}, {ENGAGED}, v AS (SELECT accession, issuer_cik, filing_date AS d FROM filing WHERE form = '10-K/A'), r AS (SELECT v.accession, e.partner, row_number() OVER (PARTITION BY v.accession ORDER BY e.d DESC, e.partner) AS rn FROM v JOIN e ON e.issuer_cik = v.issuer_cik AND e.d < v.d) SELECT partner, count(*) AS n FROM r WHERE rn = 1 GROUP BY partner")
def j6(spark, sf):
    v = view(spark, sf, "filing").filter("form = '10-K/A'").select("accession", "issuer_cik", "filing_date")
    got = asof_join(v, E.engagements(view(spark, sf, "form_ap")), ["issuer_cik"], "filing_date", "form_ap_public_date", ["engagement_partner_id"], ties=["engagement_partner_id"])
    return got.filter("engagement_partner_id is not null").groupBy(F.col("engagement_partner_id").alias("partner")).agg(F.count("*").alias("n"))


@query("J7_asof_two_keys", "WITH h AS (SELECT user_id, event_type, ts, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM events) SELECT e.event_id, coalesce((SELECT max(h.n) FROM h WHERE h.user_id = e.user_id AND h.event_type = 'purchase' AND h.ts < e.ts), 0) AS before FROM events e")
def j7(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    h = e.withColumn("n", F.count("*").over(w)).select("user_id", "event_type", F.col("ts").alias("ht"), "n").distinct()
    got = asof_join(e.withColumn("event_type", F.lit("purchase")), h, ["user_id", "event_type"], "ts", "ht", ["n"])
    return got.select("event_id", F.coalesce("n", F.lit(0)).alias("before"))


@query("J8_exists_ahead", "SELECT o.o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM orders e WHERE e.o_custkey = o.o_custkey AND e.o_orderstatus = 'F' AND e.o_orderdate > o.o_orderdate AND e.o_orderdate <= o.o_orderdate + INTERVAL 365 DAY) THEN 1 ELSE 0 END AS label FROM orders o")
def j8(spark, sf):
    o = read(spark, sf, "orders")
    return exists_ahead(o.select("o_orderkey", "o_custkey", "o_orderdate"), o, "o_custkey", "o_orderdate", "o_orderdate", {"label": (365, F.col("o_orderstatus") == "F")}).select("o_orderkey", "label")


@query("J9_count_before", "SELECT o.o_orderkey, count(e.o_orderkey) FILTER (e.o_orderdate >= o.o_orderdate - INTERVAL 365 DAY) AS y1, count(e.o_orderkey) AS y3, count(e.o_orderkey) FILTER (e.o_orderstatus = 'F') AS f3 FROM orders o LEFT JOIN orders e ON e.o_custkey = o.o_custkey AND e.o_orderdate >= o.o_orderdate - INTERVAL 1095 DAY AND e.o_orderdate < o.o_orderdate GROUP BY 1")
def j9(spark, sf):
    o = read(spark, sf, "orders")
    return window_counts(o.select("o_orderkey", "o_custkey", "o_orderdate"), o, "o_custkey", "o_orderdate", "o_orderdate", {"y1": (365, None), "y3": (1095, None), "f3": (1095, F.col("o_orderstatus") == "F")}).select("o_orderkey", "y1", "y3", "f3")


@query("J10_late_notice", f"WITH {duck('filing')}, nt AS (SELECT * FROM filing WHERE form IN ('NT 10-K', 'NT 10-Q')) SELECT f.accession, CASE WHEN f.form LIKE 'NT %' THEN 1 ELSE 0 END AS is_nt, CASE WHEN max(nt.filing_date) IS NOT NULL THEN 1 ELSE 0 END AS pre_origin, CAST(date_diff('day', max(nt.filing_date), f.filing_date) AS INTEGER) AS delay FROM filing f LEFT JOIN nt ON nt.issuer_cik = f.issuer_cik AND nt.report_date = f.report_date AND nt.filing_date <= f.filing_date GROUP BY f.accession, f.form, f.filing_date")
def j10(spark, sf):
    f = view(spark, sf, "filing").withColumn("origin_date", F.col("filing_date"))
    out = P.late_notices(f, f)
    return out.select("accession", F.col("filing_friction_is_nt").alias("is_nt"), F.col("filing_friction_nt_pre_origin").alias("pre_origin"), F.col("filing_friction_nt_delay_days").alias("delay"))


@query("J11_supplement", "SELECT o_orderkey AS k, 'raw' AS origin FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT l_orderkey, 'external' FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def j11(spark, sf):
    raw = read(spark, sf, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), F.lit("raw").alias("origin"))
    ext = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit("external").alias("origin")).distinct()
    return V.supplement(raw, ext, ["k"])


@query("J12_disjoint_sets", "WITH a AS (SELECT l_partkey AS k, list(DISTINCT l_suppkey % 7) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS k, list(DISTINCT l_suppkey % 7) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT k, CAST(len(a.s) AS INTEGER) AS n_a, CAST(len(b.s) AS INTEGER) AS n_b FROM a JOIN b USING (k) WHERE NOT list_has_any(a.s, b.s)")
def j12(spark, sf):
    x = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_suppkey") % 7).alias("v"), "l_returnflag")
    d = V.disagreements(x.filter("l_returnflag = 'A'"), x.filter("l_returnflag = 'R'"), ["k"], "v")
    return d.select("k", F.size("first_values").alias("n_a"), F.size("second_values").alias("n_b"))


@query("J13_crosswalk", "SELECT l_partkey AS firm, year(o_orderdate) AS y, count(DISTINCT o_custkey) AS issuers FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def j13(spark, sf):
    x = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.groupBy(F.col("l_partkey").alias("firm"), F.year("o_orderdate").cast("long").alias("y")).agg(F.countDistinct("o_custkey").alias("issuers"))


@query("J14_typed_identifiers", "WITH c AS (SELECT 'key' AS t, CAST(c_custkey AS VARCHAR) AS v, c_custkey AS id FROM customer UNION ALL SELECT 'segment', c_mktsegment, c_custkey FROM customer), s AS (SELECT 'key' AS t, CAST(s_suppkey AS VARCHAR) AS v, s_suppkey AS sid FROM supplier UNION ALL SELECT 'segment', 'BUILDING', s_suppkey FROM supplier) SELECT t, id, count(DISTINCT sid) AS matches, min(sid) AS least FROM c JOIN s USING (t, v) GROUP BY t, id")
def j14(spark, sf):
    """All identifiers; one side is counted by identifier before the join, so the result has a row for each id and type."""
    c, s = read(spark, sf, "customer"), read(spark, sf, "supplier")
    left = c.select(F.explode(F.array(F.struct(F.lit("key").alias("t"), F.col("c_custkey").cast("string").alias("v")), F.struct(F.lit("segment").alias("t"), F.col("c_mktsegment").alias("v")))).alias("i"), F.col("c_custkey").alias("id")).select("i.t", "i.v", "id")
    right = s.select(F.explode(F.array(F.struct(F.lit("key").alias("t"), F.col("s_suppkey").cast("string").alias("v")), F.struct(F.lit("segment").alias("t"), F.lit("BUILDING").alias("v")))).alias("i"), F.col("s_suppkey").alias("sid")).select("i.t", "i.v", "sid")
    by = right.dropDuplicates().groupBy("t", "v").agg(F.count("sid").alias("matches"), F.min("sid").alias("least"))
    return left.dropDuplicates().join(by, ["t", "v"]).select("t", "id", "matches", "least")


@query("J15_bridge_join", "SELECT s_suppkey, count(c_custkey) AS customers, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM supplier LEFT JOIN customer ON s_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey GROUP BY 1")
def j15(spark, sf):
    """The whole crosswalk; customers are summed by nation before the join, so the result has a row for each supplier."""
    o = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = read(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("n").alias("n"))
    j = read(spark, sf, "supplier").join(c, F.col("s_nationkey") == F.col("c_nationkey"), "left")
    return j.select("s_suppkey", *(F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("customers", "n")))


@query("J16_four_way", "SELECT n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def j16(spark, sf):
    l, o, c, n = (read(spark, sf, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


_YEARLY = "p AS (SELECT o_custkey AS k, year(o_orderdate) AS y, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS v FROM orders GROUP BY ALL)"


def yearly(spark, sf):
    return read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.max(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("v"))


@query("J17_shifted_years", f"WITH {_YEARLY}, j AS (SELECT a.k, a.y AS y0, r AS rel, b.v FROM p a, range(-1, 2) t(r) JOIN p b ON b.k = a.k AND b.y = a.y + r), f AS (SELECT k, y0 FROM j GROUP BY ALL HAVING count(DISTINCT rel) = 3) SELECT CAST(rel AS INTEGER) AS rel, count(*) AS n, round(avg(v), 6) AS rate FROM j JOIN f USING (k, y0) GROUP BY rel".replace("FROM p a, range(-1, 2) t(r) JOIN p b", "FROM p a CROSS JOIN range(-1, 2) t(r) JOIN p b"))
def j17(spark, sf):
    p = yearly(spark, sf)
    return event_time(p, p, "k", "y", "v", 1).withColumn("rate", F.round("rate", 6))


@query("J18_foreign_flag", f"WITH {duck('filing')}, x AS (SELECT DISTINCT issuer_cik, year(report_date) AS y FROM filing WHERE form = '20-F' AND report_date IS NOT NULL) SELECT f.accession, CASE WHEN x.y IS NULL THEN 0 ELSE 1 END AS foreign_year FROM filing f LEFT JOIN x ON x.issuer_cik = f.issuer_cik AND x.y = year(f.report_date)")
def j18(spark, sf):
    f = view(spark, sf, "filing").withColumn("fiscal_year", F.year("report_date"))
    x = P.foreign_years(f).select("issuer_cik", F.col("fpi_year").alias("fiscal_year"), F.lit(1).alias("foreign_year"))
    return f.join(x, ["issuer_cik", "fiscal_year"], "left").select("accession", F.coalesce("foreign_year", F.lit(0)).alias("foreign_year"))


@query("J19_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS n_a, b.n AS n_b FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b ON a.k = b.k")
def j19(spark, sf):
    one = lambda s, n: read(spark, sf, "orders").filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(n))
    return one("F", "n_a").join(one("P", "n_b"), "k", "outer")


@query("J20_coverage", "SELECT count(*) AS n, count(*) FILTER (o_custkey IS NOT NULL) AS matched FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey")
def j20(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("hit")).distinct()
    return read(spark, sf, "customer").join(o, "c_custkey", "left").agg(F.count("*").alias("n"), F.count("hit").alias("matched"))


def ownership(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key and where it is found (both, left_only, right_only); both sides must be unique."""
    a = assert_unique(left.select(key), [key]).withColumn("_l", F.lit(True))
    b = assert_unique(right.select(key), [key]).withColumn("_r", F.lit(True))
    side = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "both").when(F.col("_l").isNotNull(), "left_only").otherwise("right_only")
    return a.join(b, key, "outer").select(key, side.alias("side"))


@query("J21_ownership", "SELECT doc_id, CASE WHEN a AND b THEN 'both' WHEN a THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT doc_id, true AS a FROM documents WHERE doc_id % 2 = 0) FULL JOIN (SELECT doc_id, true AS b FROM labels) USING (doc_id)")
def j21(spark, sf):
    return ownership(read(spark, sf, "documents").filter("doc_id % 2 = 0"), read(spark, sf, "labels"), "doc_id")


@query("J22_overwrite", "SELECT o_orderkey, coalesce(x.y, year(o_orderdate)) AS y, CASE WHEN x.y IS NULL THEN 'own' ELSE 'external' END AS source FROM orders LEFT JOIN (SELECT l_orderkey, max(year(l_shipdate)) + 1 AS y FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) x ON o_orderkey = l_orderkey")
def j22(spark, sf):
    x = read(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.max(F.year("l_shipdate")) + 1).alias("y"))
    return read(spark, sf, "orders").join(x, "o_orderkey", "left").select("o_orderkey", F.coalesce("y", F.year("o_orderdate")).cast("long").alias("y"), F.when(F.col("y").isNull(), "own").otherwise("external").alias("source"))


_TAGS = ", ".join(f"('{c}', '{t.lower()}', {k})" for c, x in X.CONCEPTS.items() for k, t in enumerate(x))


@query("J23_tag_lookup", f"WITH {duck('fact')}, m(concept, tag_key, p) AS (VALUES {_TAGS}) SELECT concept, count(*) AS n FROM fact JOIN m ON lower(tag) = tag_key GROUP BY concept")
def j23(spark, sf):
    return view(spark, sf, "fact").withColumn("tag_key", F.lower("tag")).join(F.broadcast(X.tag_map(spark)), "tag_key").groupBy("concept").agg(F.count("*").alias("n"))


@query("J24_balanced", f"WITH {_YEARLY}, j AS (SELECT a.k, a.y AS y0, r AS rel FROM p a CROSS JOIN range(-2, 3) t(r) JOIN p b ON b.k = a.k AND b.y = a.y + r) SELECT k, y0 FROM j GROUP BY ALL HAVING count(DISTINCT rel) = 5")
def j24(spark, sf):
    p = yearly(spark, sf)
    a = p.select("k", F.col("y").cast("long").alias("y0"), F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("rel"))
    j = a.join(p.select("k", F.col("y").cast("long").alias("y")), (a["k"] == p["k"]) & (F.col("y0") + F.col("rel") == F.col("y"))).select(a["k"], "y0", "rel")
    return j.groupBy("k", "y0").agg(F.countDistinct("rel").alias("c")).filter("c = 5").select("k", "y0")
