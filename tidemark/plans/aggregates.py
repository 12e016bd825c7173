"""Aggregations (A), each as a query with its oracle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio
from tidemark.operators import facts as X
from tidemark.operators.audit import assert_no_conflict, assert_not_negative, assert_unique, conflicts, long_table, profile
from tidemark.operators.overlap import sorted_set
from tidemark.operators.reports import dispersion, ladder, tier_lift
from tidemark.plans.lake import duck, query, read, view
from tidemark.plans.windows import CTX

#: two-sided 95 % quantiles of Student's t by degrees of freedom


@query("A1_distinct_counts", f"WITH {duck('fact')} SELECT adsh, count(*) AS xbrl_fact_count, count(DISTINCT tag) AS xbrl_unique_tags, count(DISTINCT unit) AS xbrl_unique_units FROM (SELECT DISTINCT * FROM fact) GROUP BY adsh")
def a1(spark, sf):
    return X.summary(view(spark, sf, "fact"))


@query("A2_text_length", "SELECT source, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM documents GROUP BY source")
def a2(spark, sf):
    return read(spark, sf, "documents").groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


@query("A3_partial_sums", "SELECT l_suppkey, CAST(sum(n) AS BIGINT) AS n, round(sum(s), 2) AS s FROM (SELECT l_suppkey, l_linenumber, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY ALL) GROUP BY 1")
def a3(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("s"))


@query("A4_distinct_then_count", "SELECT l_suppkey, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem) GROUP BY 1")
def a4(spark, sf):
    return read(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag").distinct().groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("A5_conflicts", "SELECT l_partkey, l_suppkey, count(*) AS fact_row_count, count(DISTINCT l_quantity) AS distinct_numeric_values, min(l_quantity) AS minimum_value, max(l_quantity) AS maximum_value FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_quantity) > 1")
def a5(spark, sf):
    return conflicts(read(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"], "l_quantity")


@query("A6_conflict_count", f"WITH {duck('fact')} SELECT count(*) AS n FROM (SELECT 1 FROM fact GROUP BY {CTX} HAVING count(DISTINCT value) > 1)")
def a6(spark, sf):
    return conflicts(view(spark, sf, "fact"), X.CONTEXT, "value").agg(F.count("*").alias("n"))


@query("A7_no_conflict", "SELECT count(*) AS n FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders)")
def a7(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return assert_no_conflict(o, ["o_orderkey"]).distinct().agg(F.count("*").alias("n"))


@query("A8_checked_keys", "SELECT count(*) AS n FROM orders")
def a8(spark, sf):
    return assert_not_negative(assert_unique(read(spark, sf, "orders"), ["o_orderkey"]), ["o_totalprice"]).agg(F.count("*").alias("n"))


@query("A9_pivot_max", "SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_extendedprice END) AS v1, max(CASE WHEN l_linenumber = 2 THEN l_extendedprice END) AS v2, max(CASE WHEN l_linenumber = 3 THEN l_extendedprice END) AS v3 FROM lineitem GROUP BY 1")
def a9(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_orderkey").pivot("l_linenumber", [1, 2, 3]).agg(F.max("l_extendedprice")).withColumnsRenamed({"1": "v1", "2": "v2", "3": "v3"})


@query("A10_pivot_sum_zero", "SELECT user_id, CAST(coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS DOUBLE) > 0 AS bought, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY 1")
def a10(spark, sf):
    k = lambda e: F.col("event_type") == e
    return read(spark, sf, "events").groupBy("user_id").agg((F.coalesce(F.sum(F.when(k("purchase"), F.col("value"))), F.lit(0.0)) > 0).alias("bought"), F.count_if(k("click")).alias("clicks"), F.count_if(k("purchase")).alias("purchases"))


@query("A11_conditional_counts", f"WITH {duck('filing')} SELECT issuer_cik, count(*) FILTER (form = 'UPLOAD') AS uploads, count(*) FILTER (form = 'CORRESP') AS answers, count(DISTINCT accession) AS n, min(filing_date) AS first, max(filing_date) AS last FROM filing WHERE form IN ('UPLOAD', 'CORRESP') GROUP BY 1")
def a11(spark, sf):
    f = view(spark, sf, "filing").filter(F.col("form").isin("UPLOAD", "CORRESP"))
    return f.groupBy("issuer_cik").agg(F.count_if(F.col("form") == "UPLOAD").alias("uploads"), F.count_if(F.col("form") == "CORRESP").alias("answers"), F.countDistinct("accession").alias("n"), F.min("filing_date").alias("first"), F.max("filing_date").alias("last"))


@query("A12_avg_of_casts", "SELECT event_type, round(avg(try_cast(CASE WHEN event_id % 7 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE)), 6) AS a FROM events GROUP BY 1")
def a12(spark, sf):
    text = F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.col("event_id").cast("string"))
    return read(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg(text.try_cast("double")), 6).alias("a"))


@query("A13_filtered_distinct", "SELECT l_orderkey, count(DISTINCT l_suppkey) FILTER (l_returnflag <> 'N') AS n, CASE WHEN count(DISTINCT l_suppkey) FILTER (l_returnflag <> 'N') = 0 THEN 'dropped' WHEN count(DISTINCT l_suppkey) FILTER (l_returnflag <> 'N') = 1 THEN 'high_confidence' ELSE 'ambiguous' END AS tier FROM lineitem GROUP BY 1")
def a13(spark, sf):
    n = F.countDistinct(F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")))
    d = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(n.alias("n"))
    return d.withColumn("tier", F.when(F.col("n") == 0, "dropped").when(F.col("n") == 1, "high_confidence").otherwise("ambiguous"))


@query("A14_string_agg", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS p FROM orders GROUP BY 1")
def a14(spark, sf):
    return read(spark, sf, "orders").groupBy("o_custkey").agg(sorted_set("o_orderpriority").alias("p"))


@query("A15_any_value", "SELECT l_orderkey, min(l_shipdate) AS d FROM lineitem GROUP BY 1")
def a15(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("d"))  # the least, so that it's the same each time


@query("A16_label_max", "SELECT o_custkey, year(o_orderdate) AS y, min(o_orderdate) AS first, max(o_orderdate) AS last, count(*) AS n, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS label FROM orders GROUP BY ALL")
def a16(spark, sf):
    return read(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("y")).agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.count("*").alias("n"), F.max(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("label"))


@query("A17_score_summary", "SELECT c_nationkey, round(avg(c_acctbal), 6) AS a, round(median(c_acctbal), 6) AS m, max(c_acctbal) AS x FROM customer GROUP BY 1")
def a17(spark, sf):
    return read(spark, sf, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 6).alias("a"), F.round(F.median("c_acctbal"), 6).alias("m"), F.max("c_acctbal").alias("x"))


@query("A18_yearly", "SELECT year(o_orderdate) AS y, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS pos, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) AS rate FROM orders GROUP BY 1")
def a18(spark, sf):
    y = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    return read(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.sum(y).alias("pos"), F.count("*").alias("n"), F.round(F.avg(y), 6).alias("rate"))


def crosstab(df: DataFrame, target: str, flags: Sequence[str]) -> DataFrame:
    """flag, flag_value, target_value, n for all combinations of 0 and 1, with zeros (A19). One pass."""
    cells = [(f, a, b) for f in flags for a in (0, 1) for b in (0, 1)]
    parts = [F.struct(F.lit(f).alias("flag"), F.lit(a).alias("flag_value"), F.lit(b).alias("target_value"), F.count_if((F.col(f) == a) & (F.col(target) == b)).alias("n")) for f, a, b in cells]
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@query("A19_crosstab", "SELECT 'toxic' AS flag, CAST(t AS INTEGER) AS flag_value, CAST(q AS INTEGER) AS target_value, (SELECT count(*) FROM labels WHERE toxic = t AND quality = q) AS n FROM range(2) a(t), range(2) b(q)")
def a19(spark, sf):
    return crosstab(read(spark, sf, "labels"), "quality", ["toxic"])


@query("A20_kpis", "SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM labels UNION ALL SELECT 'good', CAST(count(*) AS DOUBLE) FROM labels WHERE quality = 1 UNION ALL SELECT 'toxic_rate', round(avg(toxic), 9) FROM labels")
def a20(spark, sf):
    return long_table(read(spark, sf, "labels"), {"rows": F.count("*"), "good": F.count_if(F.col("quality") == 1), "toxic_rate": F.round(F.avg("toxic"), 9)})


@query("A21_tier_lift", "WITH t AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'dropped' WHEN doc_id % 5 < 3 THEN 'high' ELSE 'ambiguous' END AS tier, toxic AS f, quality AS y FROM labels), u AS (SELECT * FROM t UNION ALL SELECT 'all_matched', f, y FROM t WHERE tier <> 'dropped') SELECT tier, count(*) AS n, count(*) FILTER (f = 1 AND y = 1) AS n11, round(avg(y), 6) AS prevalence, round(avg(y) FILTER (f = 1), 6) AS rate, round((avg(y) FILTER (f = 1)) / nullif(avg(y), 0), 6) AS lift FROM u GROUP BY tier")
def a21(spark, sf):
    k = F.col("doc_id") % 5
    t = read(spark, sf, "labels").withColumn("tier", F.when(k == 0, "dropped").when(k < 3, "high").otherwise("ambiguous"))
    return tier_lift(t, "tier", "toxic", "quality").select("tier", "n", "n11", *(F.round(c, 6).alias(c) for c in ("prevalence", "rate", "lift")))


@query("A22_patterns", "SELECT pattern, n, round(n / sum(n) OVER (), 6) AS share, CASE WHEN n < 5 THEN NULL ELSE n END AS shown FROM (SELECT concat_ws('+', CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END) AS pattern, count(*) AS n FROM labels GROUP BY 1)")
def a22(spark, sf):
    from pyspark.sql import Window

    p = read(spark, sf, "labels").groupBy(F.concat_ws("+", *(F.when(F.col(c) == 1, c) for c in ("quality", "toxic"))).alias("pattern")).agg(F.count("*").alias("n"))
    return p.select("pattern", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"), F.when(F.col("n") >= 5, F.col("n")).alias("shown"))


@query("A23_totals", "SELECT coalesce(lang, 'total') AS lang, count(*) AS n FROM documents GROUP BY ROLLUP (lang)")
def a23(spark, sf):
    return read(spark, sf, "documents").rollup("lang").agg(F.count("*").alias("n")).select(F.coalesce("lang", F.lit("total")).alias("lang"), "n")


@query("A24_row_and_entity_rates", "WITH r AS (SELECT o_orderpriority AS p, avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS a FROM orders GROUP BY 1), e AS (SELECT p, avg(m) AS b FROM (SELECT o_orderpriority AS p, o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS m FROM orders GROUP BY ALL) GROUP BY 1) SELECT p, round(a, 6) AS row_rate, round(b, 6) AS entity_rate FROM r FULL JOIN e USING (p)")
def a24(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("p"), "o_custkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"))
    e = o.groupBy("p", "o_custkey").agg(F.max("y").alias("m")).groupBy("p").agg(F.round(F.avg("m"), 6).alias("entity_rate"))
    return o.groupBy("p").agg(F.round(F.avg("y"), 6).alias("row_rate")).join(e, "p", "outer")


def multiplicity(df: DataFrame, grains: dict[str, tuple[Sequence[str], str]]) -> DataFrame:
    """grain, keys, keys with more than one partner, most partners: name -> (key columns, partner column)."""
    out = None
    for name, (keys, partner) in grains.items():
        one = df.groupBy(*keys).agg(F.countDistinct(partner).alias("c")).agg(F.count("*").alias("keys"), F.count_if(F.col("c") > 1).alias("multiple"), F.max("c").alias("most")).select(F.lit(name).alias("grain"), "keys", "multiple", "most")
        out = one if out is None else out.unionByName(one)
    return out


def _mult(name: str, keys: str, partner: str) -> str:
    return f"SELECT '{name}' AS grain, count(*) AS keys, count(*) FILTER (c > 1) AS multiple, max(c) AS most FROM (SELECT count(DISTINCT {partner}) AS c FROM lineitem GROUP BY {keys})"


@query("A25_multiplicity", " UNION ALL ".join([_mult("order_to_supplier", "l_orderkey", "l_suppkey"), _mult("supplier_to_part", "l_suppkey", "l_partkey"), _mult("part_flag_to_order", "l_partkey, l_returnflag", "l_orderkey")]))
def a25(spark, sf):
    return multiplicity(read(spark, sf, "lineitem"), {"order_to_supplier": (["l_orderkey"], "l_suppkey"), "supplier_to_part": (["l_suppkey"], "l_partkey"), "part_flag_to_order": (["l_partkey", "l_returnflag"], "l_orderkey")})


@query("A26_unmatched_by_year", "SELECT year(o_orderdate) AS y, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) AS rate FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def a26(spark, sf):
    r = read(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf, "orders").join(r, "o_orderkey", "left_anti").groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)), 6).alias("rate"))


@query("A27_sorted_set_join", "SELECT doc, string_agg(DISTINCT v, ';' ORDER BY v) AS s FROM (SELECT l_orderkey AS doc, nullif(trim(CASE WHEN l_returnflag = 'N' THEN ' ' ELSE concat(' ', l_returnflag, l_linestatus) END), '') AS v FROM lineitem) GROUP BY doc")
def a27(spark, sf):
    v = F.when(F.col("l_returnflag") == "N", " ").otherwise(F.concat(F.lit(" "), "l_returnflag", "l_linestatus"))
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), v.alias("v")).groupBy("doc").agg(F.nullif(sorted_set("v"), F.lit("")).alias("s"))


@query("A28_coverage", "SELECT count(*) AS n, count(l.doc_id) AS labelled, round(count(l.doc_id) / count(*), 6) AS rate FROM documents d LEFT JOIN labels l USING (doc_id)")
def a28(spark, sf):
    l = read(spark, sf, "labels").select("doc_id", F.lit(1).alias("hit"))
    return read(spark, sf, "documents").select("doc_id").join(l, "doc_id", "left").agg(F.count("*").alias("n"), F.count("hit").alias("labelled"), F.round(F.count("hit") / F.count("*"), 6).alias("rate"))


@query("A29_mean_of_means", "SELECT o_orderpriority, round(avg(m), 4) AS m FROM (SELECT o_orderpriority, year(o_orderdate) AS y, avg(o_totalprice) AS m FROM orders GROUP BY ALL) GROUP BY 1")
def a29(spark, sf):
    return read(spark, sf, "orders").groupBy("o_orderpriority", F.year("o_orderdate")).agg(F.avg("o_totalprice").alias("m")).groupBy("o_orderpriority").agg(F.round(F.avg("m"), 4).alias("m"))


@query("A30_shares", "SELECT p_brand, round(sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part), 6) AS share FROM part GROUP BY 1")
def a30(spark, sf):
    from pyspark.sql import Window

    s = read(spark, sf, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("s"))
    return s.select("p_brand", F.round(F.col("s") / F.sum("s").over(Window.partitionBy()), 6).alias("share"))


@query("A31_value_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def a31(spark, sf):
    return read(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


_T = "CASE n WHEN 5 THEN 2.776 WHEN 6 THEN 2.571 WHEN 7 THEN 2.447 WHEN 8 THEN 2.365 ELSE 1.96 END"


@query("A32_fold_dispersion", f"WITH f AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, avg(o_totalprice) AS v, count(*) FILTER (o_orderstatus = 'F') AS pos FROM orders GROUP BY ALL), d AS (SELECT p, avg(v) AS m, stddev_samp(v) AS sd, count(*) AS n, min(v) AS a, max(v) AS b FROM f WHERE pos >= 10 GROUP BY p HAVING count(*) >= 5) SELECT p, n AS folds, round(m, 3) AS mean, round(sd, 3) AS sd, round(sd / sqrt(n), 3) AS se, round(m - {_T} * sd / sqrt(n), 3) AS low, round(m + {_T} * sd / sqrt(n), 3) AS high, round(a, 3) AS least, round(b, 3) AS most FROM d")
def a32(spark, sf):
    f = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.year("o_orderdate")).agg(F.avg("o_totalprice").alias("v"), F.count_if(F.col("o_orderstatus") == "F").alias("pos"))
    return dispersion(f, ["p"], "v", "pos").select("p", "folds", *(F.round(c, 3).alias(c) for c in ("mean", "sd", "se", "low", "high", "least", "most")))


@query("A33_fold_support", "SELECT p, max(n) AS most_rows, max(pos) AS most_positives, count(*) AS configs FROM (SELECT o_orderpriority AS p, year(o_orderdate) AS y, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS pos FROM orders GROUP BY ALL) GROUP BY p")
def a33(spark, sf):
    f = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.year("o_orderdate")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("pos"))
    return f.groupBy("p").agg(F.max("n").alias("most_rows"), F.max("pos").alias("most_positives"), F.count("*").alias("configs"))


@query("A34_median_strata", "WITH m AS (SELECT median(o_totalprice) AS m FROM orders) SELECT stratum, count(*) AS n, round(avg(y), 6) AS rate FROM (SELECT CASE WHEN o_totalprice >= m THEN 'high' ELSE 'low' END AS stratum, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders, m UNION ALL SELECT 'all', CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END FROM orders) GROUP BY 1")
def a34(spark, sf):
    o = read(spark, sf, "orders")
    m = o.agg(F.median("o_totalprice")).first()[0]  # one number
    s = F.explode(F.array(F.when(F.col("o_totalprice") >= m, "high").otherwise("low"), F.lit("all"))) if m is not None else F.lit("all")
    return o.select(s.alias("stratum"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y")).groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("rate"))


@query("A35_attrition", "SELECT 'all' AS metric, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'years', CAST(count(*) AS DOUBLE) FROM orders WHERE year(o_orderdate) >= 1998 UNION ALL SELECT 'open', CAST(count(*) AS DOUBLE) FROM orders WHERE year(o_orderdate) >= 1998 AND o_orderstatus <> 'F'")
def a35(spark, sf):
    return ladder(read(spark, sf, "orders"), {"years": F.year("o_orderdate") >= 1998, "open": F.col("o_orderstatus") != "F"})


@query("A36_missing_rates", "SELECT 'quality' AS column_name, round(avg(CASE WHEN quality IS NULL THEN 1 ELSE 0 END), 6) AS missing_rate FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'lang', round(avg(CASE WHEN lang IS NULL THEN 1 ELSE 0 END), 6) FROM documents")
def a36(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    return profile(d, ["quality", "lang"]).select("column_name", F.round("missing_rate", 6).alias("missing_rate"))


@query("A37_row_sums", "SELECT doc_id, CAST((quality IS NULL) AS INTEGER) + CAST((toxic IS NULL) AS INTEGER) AS missing, (CAST((quality IS NULL) AS INTEGER) + CAST((toxic IS NULL) AS INTEGER)) / 2 AS density FROM documents LEFT JOIN labels USING (doc_id)")
def a37(spark, sf):
    n = sum((F.col(c).isNull().cast("int") for c in ("quality", "toxic")), F.lit(0))
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left").select("doc_id", n.alias("missing"), (n / 2).alias("density"))


@query("A38_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("orders", "lineitem", "customer")))
def a38(spark, sf):
    out = None
    for t in ("orders", "lineitem", "customer"):
        one = read(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("A39_mapping_quality", "SELECT o_custkey, round(avg(CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END), 6) AS coverage, CASE WHEN avg(CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END) >= 1 THEN 'full' WHEN avg(CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END) >= 0.5 THEN 'partial' ELSE 'insufficient' END AS quality FROM orders GROUP BY 1")
def a39(spark, sf):
    c = read(spark, sf, "orders").groupBy("o_custkey").agg(F.avg((F.col("o_orderkey") % 3 != 0).cast("int")).alias("c"))
    return c.select("o_custkey", F.round("c", 6).alias("coverage"), F.when(F.col("c") >= 1, "full").when(F.col("c") >= 0.5, "partial").otherwise("insufficient").alias("quality"))
