"""Window functions, sorts, limits, top-k and set operations (W, O), each as a query with its oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import uniform_bin
from tidemark.operators import facts as X
from tidemark.operators.ordered import numbered
from tidemark.operators.temporal import cumulative, first_by, sessions, with_history
from tidemark.plans.lake import duck, query, read, view

CTX = ", ".join(X.CONTEXT)


@query("W1_days_since_previous", "SELECT o_orderkey, date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS days FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def w1(spark, sf):
    return with_history(read(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", F.col("days_since_previous").cast("long").alias("days"))


@query("W2_prior_count", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders")
def w2(spark, sf):
    return with_history(read(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", F.col("prior_count").cast("long").alias("n"))


@query("W3_context_range", f"WITH {duck('fact')} SELECT adsh, tag, value_text, CAST(min(value) OVER w AS VARCHAR) AS lo, CAST(max(value) OVER w AS VARCHAR) AS hi FROM fact WINDOW w AS (PARTITION BY {CTX})")
def w3(spark, sf):
    return X.marked(view(spark, sf, "fact")).select("adsh", "tag", "value_text", F.col("context_minimum").cast("string").alias("lo"), F.col("context_maximum").cast("string").alias("hi"))


SETTLED = f"m AS (SELECT *, min(value) OVER (PARTITION BY {CTX}) AS lo, max(value) OVER (PARTITION BY {CTX}) AS hi, row_number() OVER (PARTITION BY {CTX}, value ORDER BY value_text NULLS LAST) AS rn FROM fact WHERE value IS NOT NULL), settled AS (SELECT * FROM m WHERE lo = hi AND rn = 1)"


@query("W4_dedupe_facts", f"WITH {duck('fact')}, {SETTLED} SELECT adsh, tag, value_text FROM settled")
def w4(spark, sf):
    return X.settled(view(spark, sf, "fact")).select("adsh", "tag", "value_text")


_TAGS = ", ".join(f"('{c}', '{t.lower()}', {k})" for c, x in X.CONCEPTS.items() for k, t in enumerate(x))
BEST = f"tags(concept, tag_key, tag_priority) AS (VALUES {_TAGS}), ranked AS (SELECT s.*, concept, row_number() OVER (PARTITION BY adsh, concept ORDER BY tag_priority, quarters DESC NULLS LAST, fact_date DESC NULLS LAST, CASE WHEN unit = 'USD' THEN 0 ELSE 1 END, taxonomy_version DESC NULLS LAST, lower(tag), tag, value_text NULLS LAST) AS best FROM settled s JOIN tags ON lower(tag) = tag_key WHERE (unit IS NULL OR unit = 'USD') AND segments IS NULL AND coreg IS NULL)"


@query("W5_best_fact", f"WITH {duck('fact')}, {SETTLED}, {BEST} SELECT adsh, concept, value_text FROM ranked WHERE best = 1")
def w5(spark, sf):
    return X.best(X.settled(view(spark, sf, "fact")), X.tag_map(spark)).select("adsh", "concept", "value_text")


ANNUAL_ORDER = "CASE upper(trim(form)) WHEN '10-K' THEN 0 WHEN '10-K/A' THEN 1 ELSE 99 END, filing_date NULLS LAST, acceptance_datetime NULLS LAST, upper(trim(form)), accession"


@query("W6_annual_pick", f"WITH {duck('filing')}, r AS (SELECT *, row_number() OVER (PARTITION BY issuer_cik, year(report_date) ORDER BY {ANNUAL_ORDER}) AS rn FROM filing WHERE upper(trim(form)) IN ('10-K', '10-K/A') AND report_date IS NOT NULL) SELECT issuer_cik, CAST(year(report_date) AS INTEGER) AS fiscal_year, accession FROM r WHERE rn = 1")
def w6(spark, sf):
    f = view(spark, sf, "filing").withColumns({"fiscal_year": F.year("report_date"), "origin_date": F.col("filing_date")})
    return X.annual_pick(f).select("issuer_cik", "fiscal_year", "accession")


@query("W7_year_over_year", "WITH y AS (SELECT o_custkey AS k, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY ALL), l AS (SELECT *, lag(y) OVER w AS py, lag(v) OVER w AS pv FROM y WINDOW w AS (PARTITION BY k ORDER BY y)) SELECT k, y, CASE WHEN py = y - 1 THEN round((v - pv) / abs(pv), 6) END AS change FROM l")
def w7(spark, sf):
    y = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").cast("long").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    w = Window.partitionBy("k").orderBy("y")
    prev = F.when(F.lag("y").over(w) == F.col("y") - 1, F.lag("v").over(w))
    from tidemark.functions.numeric import change

    return y.withColumn("p", prev).select("k", "y", F.round(change("v", "p"), 6).alias("change"))


@query("W8_sessions", "WITH g AS (SELECT *, CASE WHEN coalesce(date_diff('day', lag(ts) OVER w, ts), 9999) > 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seq FROM g) SELECT user_id, CAST(seq AS BIGINT) AS seq, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY ALL")
def w8(spark, sf):
    s = sessions(read(spark, sf, "events"), "user_id", "ts", 1, ["event_id"])
    return s.groupBy("user_id", F.col("session_seq").alias("seq")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query("W9_running_sums", "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS b FROM events GROUP BY ALL) SELECT user_id, d, CAST(sum(n) OVER w AS BIGINT) AS n, CAST(sum(b) OVER w AS BIGINT) AS b FROM d WINDOW w AS (PARTITION BY user_id ORDER BY d ROWS UNBOUNDED PRECEDING)")
def w9(spark, sf):
    d = read(spark, sf, "events").groupBy("user_id", F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("x"), F.count_if(F.col("event_type") == "purchase").alias("z"))
    return cumulative(d, ["user_id"], "d", {"n": "x", "b": "z"}).drop("x", "z")


@query("W10_surrogate_id", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders")
def w10(spark, sf):
    return numbered(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("W11_stable_rank", "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY round(c_acctbal, -2) DESC, c_custkey) AS r FROM customer")
def w11(spark, sf):
    w = Window.partitionBy("c_mktsegment").orderBy(F.round("c_acctbal", -2).desc(), "c_custkey")
    return read(spark, sf, "customer").select("c_custkey", F.row_number().over(w).cast("long").alias("r"))


@query("W12_equal_bins", "SELECT c_custkey, ntile(10) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS bin FROM customer")
def w12(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", F.ntile(10).over(Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")).cast("long").alias("bin"))


@query("W13_uniform_bins", "SELECT bin, count(*) AS n FROM (SELECT CAST(least(floor(CAST(o_orderkey % 101 AS DOUBLE) / 100.0 * 10 + 1e-9), 9) AS INTEGER) AS bin FROM orders) GROUP BY bin")
def w13(spark, sf):
    return read(spark, sf, "orders").select(uniform_bin((F.col("o_orderkey") % 101) / 100.0).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query("O1_total_order", "SELECT accession, items FROM (SELECT accession, items FROM (SELECT concat('a', CAST(o_orderkey AS VARCHAR)) AS accession, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS items FROM orders) ORDER BY items ASC NULLS LAST, accession LIMIT 200)")
def o1(spark, sf):
    f = read(spark, sf, "orders").select(F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("accession"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("items"))
    return f.orderBy(F.col("items").asc_nulls_last(), "accession").limit(200)  # the first rows of the order are the report


@query("O2_sorted_write", "SELECT o_orderkey, o_orderdate FROM orders")
def o2(spark, sf):
    from tidemark.sources.sinks import scratch, write_table

    path = scratch(spark, "o2")
    write_table(read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), path, order=["o_orderdate", "o_orderkey"])
    return spark.read.parquet(path)


@query("O5_top_n_report", "SELECT n_name, s FROM (SELECT n_name, round(sum(c_acctbal), 2) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name <> 'CHINA' GROUP BY 1) ORDER BY s DESC, n_name LIMIT 5")
def o5(spark, sf):
    c, n = read(spark, sf, "customer"), read(spark, sf, "nation")
    s = c.join(n, c["c_nationkey"] == n["n_nationkey"]).filter("n_name <> 'CHINA'").groupBy("n_name").agg(F.round(F.sum("c_acctbal"), 2).alias("s"))
    return s.orderBy(F.col("s").desc(), "n_name").limit(5)


@query("O6_arg_max", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best FROM orders GROUP BY 1".replace("arg_max(o_orderkey, (o_totalprice, -o_orderkey))", "first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)"))
def o6(spark, sf):
    return first_by(read(spark, sf, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]).select("o_custkey", F.col("o_orderkey").alias("best"))


@query("O7_first_links", "SELECT page_id, url FROM pages ORDER BY url DESC, page_id LIMIT 25")
def o7(spark, sf):
    return read(spark, sf, "pages").select("page_id", "url").orderBy(F.col("url").desc(), "page_id").limit(25)


@query("O8_union_scores", "SELECT 'a' AS source, c_custkey AS k, c_acctbal AS score FROM customer UNION ALL SELECT 'b', s_suppkey, s_acctbal FROM supplier")
def o8(spark, sf):
    a = read(spark, sf, "customer").select(F.lit("a").alias("source"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("score"))
    return a.unionByName(read(spark, sf, "supplier").select(F.lit("b").alias("source"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("score")))


@query("O9_union_dedupe", f"WITH {duck('filing')}, u AS (SELECT accession, 'amendment' AS kind, filing_date FROM filing WHERE form = '10-K/A' UNION ALL SELECT accession, 'amendment', report_date FROM filing WHERE form = '10-K/A') SELECT accession, kind, min(filing_date) AS d FROM u GROUP BY ALL")
def o9(spark, sf):
    f = view(spark, sf, "filing").filter("form = '10-K/A'").withColumn("kind", F.lit("amendment"))
    both = f.select("accession", "kind", F.col("filing_date").alias("d")).unionByName(f.select("accession", "kind", F.col("report_date").alias("d")))
    return first_by(both, ["accession", "kind"], [F.col("d").asc_nulls_last()])


@query("O10_distinct_pairs", "SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders")
def o10(spark, sf):
    return read(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("y")).distinct()


@query("O11_set_operations", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'left', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def o11(spark, sf):
    c, s, o = read(spark, sf, "customer"), read(spark, sf, "supplier"), read(spark, sf, "orders")
    both = c.select("c_nationkey").intersect(s.select("s_nationkey")).agg(F.count("*").alias("n")).select(F.lit("both").alias("kind"), "n")
    return both.unionByName(c.select("c_custkey").subtract(o.select("o_custkey")).agg(F.count("*").alias("n")).select(F.lit("left").alias("kind"), "n"))


