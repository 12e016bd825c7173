"""Supporting operators (X) and streams (T), each as a query with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audit as U
from tidemark.operators import facts as X
from tidemark.operators import labels as L
from tidemark.operators import overlap as V
from tidemark.operators import runner as R
from tidemark.plans.composites import public_panel
from tidemark.plans.lake import duck, query, read, view
from tidemark.sources import archives as A
from tidemark.sources import sinks as K
from tidemark.sources import tables as T
from tidemark.streaming import sessions as S


@query("X1_label_modes", "SELECT * FROM (VALUES (0, 'naive'), (1, 'proxy_imputed_lag_1y'), (2, 'proxy_imputed_lag_2y'), (3, 'matured')) t(k, mode)")
def x1(spark, sf):
    modes = L.label_modes(["naive", "proxy_imputed_lag_<N>y", "matured", "naive"], [1, 2])
    return spark.createDataFrame(list(enumerate(modes)), "k int, mode string")


@query("X2_unknown_positives", "WITH b AS (SELECT c_custkey, CAST(c_custkey % 7 AS INTEGER) AS y0, c_custkey % 2 AS y FROM customer) SELECT 'current_year' AS how, CAST(sum(y0) AS BIGINT) AS s FROM b WHERE y = 1 UNION ALL SELECT 'final_label', CAST(sum(y0 + 1) AS BIGINT) FROM b WHERE y = 1")
def x2(spark, sf):
    c = read(spark, sf, "customer").select((F.col("c_custkey") % 7).cast("int").alias("y0"), (F.col("c_custkey") % 2).cast("int").alias("y"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    out = None
    for how in ("current_year", "final_label"):
        one = L.with_detection_year(c, "y0", "y", ["a", "b"], how).agg(F.sum("detection_year_proxy").alias("s")).select(F.lit(how).alias("how"), "s")
        out = one if out is None else out.unionByName(one)
    return out


@query("X3_identifier_table", "SELECT 'cik' AS match_type, count(*) AS n FROM customer WHERE c_custkey > 0 UNION ALL SELECT 'ticker', 2 * count(*) FROM customer WHERE c_custkey > 0 UNION ALL SELECT 'name', count(*) FROM customer WHERE c_custkey > 0")
def x3(spark, sf):
    c = read(spark, sf, "customer")
    p = c.select(F.col("c_custkey").alias("issuer_cik"), F.concat(F.lit("a"), F.col("c_custkey").cast("string"), F.lit(";b"), F.col("c_custkey").cast("string")).alias("tickers_json"), F.col("c_name").alias("entity_name"))
    return V.identifiers(p).groupBy("match_type").agg(F.count("*").alias("n"))


@query("X4_overlap_stats", "WITH c AS (SELECT s_suppkey AS raw_row_id, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS issuer_cik, CAST(1996 + s_suppkey % 8 AS INTEGER) AS data_year FROM supplier WHERE s_suppkey > 0), k AS (SELECT DISTINCT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS issuer_cik, CAST(year(o_orderdate) AS INTEGER) AS data_year, 1 AS hit FROM orders) SELECT count(*) AS candidates, count(hit) AS public_candidates, count(DISTINCT raw_row_id) AS raw_rows, count(DISTINCT CASE WHEN hit = 1 THEN raw_row_id END) AS public_raw_rows, round((count(DISTINCT CASE WHEN hit = 1 THEN raw_row_id END)) / count(DISTINCT raw_row_id), 6) AS rate FROM c LEFT JOIN k USING (issuer_cik, data_year)")
def x4(spark, sf):
    c = read(spark, sf, "supplier").filter("s_suppkey > 0").select(F.col("s_suppkey").alias("raw_row_id"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("issuer_cik"), (1996 + F.col("s_suppkey") % 8).cast("int").alias("data_year"))
    k = V.public_annual(public_panel(spark, sf), ["label"])
    return V.overlap_stats(c, k).withColumn("rate", F.round("rate", 6))


@query("X5_ambiguous_candidates", "SELECT l_orderkey AS raw_row_id, count(DISTINCT l_suppkey) AS candidate_count FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def x5(spark, sf):
    return read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("raw_row_id")).agg(F.countDistinct("l_suppkey").alias("candidate_count")).filter("candidate_count > 1")


@query("X6_raw_keys", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS gvkey, CAST(year(o_orderdate) AS INTEGER) AS data_year, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS benchmark_label FROM orders")
def x6(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("gvkey"), F.year("o_orderdate").alias("data_year"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"))
    return V.raw_keys(o, label="label")


@query("X7_linkage_stats", "SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'entities', CAST(count(DISTINCT o_custkey) AS DOUBLE) FROM orders UNION ALL SELECT 'first_year', CAST(min(year(o_orderdate)) AS DOUBLE) FROM orders UNION ALL SELECT 'last_year', CAST(max(year(o_orderdate)) AS DOUBLE) FROM orders")
def x7(spark, sf):
    y = F.year("o_orderdate")
    return U.long_table(read(spark, sf, "orders"), {"rows": F.count("*"), "entities": F.countDistinct("o_custkey"), "first_year": F.min(y), "last_year": F.max(y)})


@query("X8_tolerant_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders")
def x8(spark, sf):
    from tidemark.functions.dates import day, mixed_date

    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", " yyyy-MM-dd ")).otherwise("NaT")
    return read(spark, sf, "orders").select("o_orderkey", day(mixed_date(text)).alias("d"))


@query("X9_schema_probe", "SELECT 'quality' AS label, CAST(NULL AS INTEGER) AS absent, count(*) AS n FROM labels GROUP BY ALL")
def x9(spark, sf):
    df = read(spark, sf, "labels")
    label = next(c for c in ("misstatement", "quality") if c in df.columns)
    return T.align(df, "doc_id long, absent int").agg(F.first("absent").alias("absent"), F.count("*").alias("n")).withColumn("label", F.lit(label))


@query("X11_only_row", "SELECT 'AFRICA' AS r_name")
def x11(spark, sf):
    r = U.only_row(read(spark, sf, "region").filter("r_name = 'AFRICA'"))
    return spark.createDataFrame([(r.r_name,)], "r_name string")


@query("X12_frozen_spec", "SELECT count(*) AS n FROM (SELECT DISTINCT o_orderpriority, year(o_orderdate) FROM orders)")
def x12(spark, sf):
    m = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("task"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("v"))
    return U.assert_unique(U.assert_known(m, ["task", "y"]), ["task", "y"]).agg(F.count("*").alias("n"))


@query("X13_canonical_order", "SELECT * FROM (SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey LIMIT 50)")
def x13(spark, sf):
    return read(spark, sf, "orders").orderBy("o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey").limit(50)


@query("X14_class_guard", "SELECT lang, count(DISTINCT quality) AS classes, CASE WHEN count(DISTINCT quality) < 2 THEN 'one_class' ELSE 'fit' END AS status FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def x14(spark, sf):
    j = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return j.groupBy("lang").agg(F.countDistinct("quality").alias("classes")).withColumn("status", F.when(F.col("classes") < 2, "one_class").otherwise("fit"))


@query("X15_preprocessor", "SELECT count(*) AS n, CAST(count(DISTINCT c_mktsegment) + 2 AS INTEGER) AS width FROM customer")
def x15(spark, sf):
    from pyspark.ml import Pipeline

    from tidemark.operators.models import preprocessor

    c = read(spark, sf, "customer").select(F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("bal"), "c_mktsegment")
    x = Pipeline(stages=preprocessor(["bal"], ["c_mktsegment"], "robust")).fit(c).transform(c)
    return x.agg(F.count("*").alias("n")).withColumn("width", F.lit(x.select("features").first()[0].size))


@query("X16_identifier_columns", "SELECT o_totalprice, o_orderstatus FROM orders")
def x16(spark, sf):
    return U.drop_identifiers(read(spark, sf, "orders"), ["o_orderdate", "o_orderpriority"])


@query("X18_mapping_report", "SELECT * FROM (VALUES ('assets', 'c_acctbal', 'mapped'), ('receivables', NULL, 'missing')) t(concept, column_name, status)")
def x18(spark, sf):
    have = set(read(spark, sf, "customer").columns)
    want = {"assets": ("balance", "c_acctbal"), "receivables": ("rect",)}
    rows = [(c, next((n for n in names if n in have), None)) for c, names in want.items()]
    return spark.createDataFrame([(c, n, "mapped" if n else "missing") for c, n in rows], "concept string, column_name string, status string")


@query("X19_task_frame", "SELECT count(*) AS n FROM (SELECT o_custkey, year(o_orderdate) FROM orders WHERE o_orderdate + INTERVAL 365 DAY <= TIMESTAMP '2001-08-01' GROUP BY ALL)")
def x19(spark, sf):
    from tidemark.functions.dates import censored

    o = read(spark, sf, "orders").filter(censored("o_orderdate", F.lit("2001-08-01").cast("timestamp_ntz")) == 0)
    one = o.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("c"))
    return U.assert_unique(one, ["o_custkey", "y"]).agg(F.count("*").alias("n"))


@query("X20_status_grid", "SELECT p.o_orderpriority, y.y, coalesce(c.n, 0) AS n, CASE WHEN c.n IS NULL THEN 'skipped_no_rows' ELSE 'fit' END AS status FROM (SELECT DISTINCT o_orderpriority FROM orders) p CROSS JOIN range(1999, 2004) y(y) LEFT JOIN (SELECT o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL) c ON c.o_orderpriority = p.o_orderpriority AND c.y = y.y")
def x20(spark, sf):
    o = read(spark, sf, "orders")
    grid = o.select("o_orderpriority").distinct().withColumn("y", F.explode(F.sequence(F.lit(1999).cast("long"), F.lit(2003).cast("long"))))
    c = o.groupBy("o_orderpriority", F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("n"))
    return grid.join(c, ["o_orderpriority", "y"], "left").select("o_orderpriority", "y", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "skipped_no_rows").otherwise("fit").alias("status"))


@query("X21_fallback_summary", f"WITH {duck('fact')} SELECT adsh, count(*) AS xbrl_fact_count FROM (SELECT DISTINCT * FROM fact) GROUP BY adsh")
def x21(spark, sf):
    return X.summary(view(spark, sf, "fact")).select("adsh", "xbrl_fact_count")


@query("X22_view_fallback", "SELECT 'orders' AS used, count(*) AS n FROM orders")
def x22(spark, sf):
    name = next(t for t in ("orders_summary", "orders") if T.exists(spark, f"{sf}/{t}.parquet"))
    return read(spark, sf, name).agg(F.count("*").alias("n")).withColumn("used", F.lit(name))


_NAMES = "string_agg(r_name || chr(10), '' ORDER BY r_regionkey)"


def _names_file(spark, sf, folder: str) -> str:
    """The regions' names as a file on the driver."""
    import os

    path = os.path.join(folder, "names.txt")
    with open(path, "w") as f:
        f.writelines(r.r_name + "\n" for r in read(spark, sf, "region").orderBy("r_regionkey").collect())
    return path


@query("X23_sidecar_hash", f"SELECT 'names.txt' AS file, sha256({_NAMES}) AS sha256, true AS change_found FROM region")
def x23(spark, sf):
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        p = _names_file(spark, sf, d)
        R.write_metadata(p)
        meta = R.verify_metadata(p)
        with open(p, "a") as f:
            f.write("x")
        try:
            R.verify_metadata(p)
            found = False
        except ValueError:
            found = True
    return spark.createDataFrame([(meta["file"], meta["sha256"], found)], "file string, sha256 string, change_found boolean")


@query("X24_batches", "SELECT CAST(n_regionkey // 2 AS INTEGER) AS batch, n_name, n_regionkey FROM nation")
def x24(spark, sf):
    """An archive for each region, read by batches of two."""
    rows = {}
    for r in read(spark, sf, "nation").select("n_regionkey", "n_nationkey", "n_name").collect():
        rows.setdefault(r.n_regionkey, ["key\tname\tregion"]).append(f"{r.n_nationkey}\t{r.n_name}\t{r.n_regionkey}")
    d = K.scratch(spark, "x24")
    paths = [T.write_bytes(spark, f"{d}/{k}.zip", A.make_zip({"readme.htm": "x", "in/sub.txt": "\n".join(rows[k]) + "\n"})) for k in sorted(rows)]
    out = None
    for k, batch in enumerate(R.batched(paths, 2)):
        one = A.zip_rows(spark, batch, "sub").select(F.lit(k).alias("batch"), A.field("name").alias("n_name"), A.field("region").cast("long").alias("n_regionkey"))
        out = one if out is None else out.unionByName(one)
    return out


@query("X25_overwrite", "SELECT count(*) AS n FROM region")
def x25(spark, sf):
    path = K.scratch(spark, "x25")
    K.write_table(read(spark, sf, "nation").select(F.col("n_name").alias("v")), path)
    K.write_table(read(spark, sf, "region").select(F.col("r_name").alias("v")), path, mode="overwrite")
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


@query("X27_contained", "SELECT n_name, n_nationkey % 3 <> 1 AS inside FROM nation")
def x27(spark, sf):
    def inside(r) -> bool:
        path = ("/data/lake/{}", "/data/lake/../{}", "/data/lake/x/../{}")[r.n_nationkey % 3].format(r.n_name)
        try:
            return bool(R.contained(path, "/data/lake"))
        except ValueError:
            return False

    return spark.createDataFrame([(r.n_name, inside(r)) for r in read(spark, sf, "nation").collect()], "n_name string, inside boolean")


@query("X28_distinct_profile", "SELECT 'n_name' AS column_name, count(DISTINCT n_name) AS n_distinct, (SELECT string_agg(n_name, ';' ORDER BY n_name) FROM (SELECT n_name FROM nation ORDER BY n_name LIMIT 3)) AS first_values FROM nation")
def x28(spark, sf):
    return U.distinct_profile(read(spark, sf, "nation"), ["n_name"], 3).withColumn("first_values", F.array_join("first_values", ";"))


_STATE = "CASE WHEN c_acctbal < -950 THEN 'blocked' WHEN c_acctbal < -900 THEN 'missing' WHEN c_acctbal < -850 THEN 'partial' ELSE 'fit' END"


@query("X31_claims", f"WITH s AS (SELECT c_nationkey, c_mktsegment, min({_STATE}) AS state FROM customer GROUP BY ALL) SELECT c_nationkey AS claim, CASE WHEN bool_or(state = 'blocked') THEN 'blocked' WHEN bool_or(state = 'missing') THEN 'missing' WHEN bool_or(state = 'partial') THEN 'partial' ELSE 'supported' END AS status FROM s GROUP BY 1")
def x31(spark, sf):
    s = read(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min(F.expr(_STATE)).alias("state"))
    by = s.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "state"))).alias("parts")).collect()
    return spark.createDataFrame([(r.c_nationkey, R.claim_status(r.parts)) for r in by], "claim long, status string")


_BY = "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY ALL"
_PUBLISHED = f"p AS (SELECT status, priority, CASE WHEN status = 'F' AND priority LIKE '1%' THEN n + 1 ELSE n END AS n, mean * 1.0000001 AS mean FROM r WHERE NOT (status = 'O' AND priority LIKE '2%'))"


@query("X32_verified_cells", f"WITH r AS ({_BY}), {_PUBLISHED} SELECT status, priority, CASE WHEN p.n IS NULL THEN '*' ELSE 'n' END AS column_name, CASE WHEN p.n IS NOT NULL THEN CAST(r.n AS VARCHAR) END AS recomputed, CAST(p.n AS VARCHAR) AS published, CASE WHEN p.n IS NULL THEN 'extra' ELSE 'different' END AS kind FROM r LEFT JOIN p USING (status, priority) WHERE p.n IS NULL OR p.n <> r.n")
def x32(spark, sf):
    """A table is computed twice; the published one has a changed cell, a missing row, and means that differ within the tolerance."""
    r = read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))
    first = lambda s, k: (F.col("status") == s) & F.col("priority").startswith(k)
    p = r.filter(~first("O", "2")).withColumns({"n": F.when(first("F", "1"), F.col("n") + 1).otherwise(F.col("n")), "mean": F.col("mean") * 1.0000001})
    if not U.same_rows(r, r.repartition(3)) or U.same_rows(r, p):
        raise ValueError("a table differs from itself, or equals a changed one")
    return U.verify_table(r, p, ["status", "priority"], 1e-5)


@query("X33_monitor", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, true AS complete FROM {t}" for t in ("region", "nation", "customer", "orders")))
def x33(spark, sf):
    import tempfile

    report = {t: read(spark, sf, t).count() for t in ("region", "nation", "customer", "orders")}
    R.check_report(report, dict.fromkeys(report, int))
    R.check_report(R.sample(tempfile.gettempdir()), {"time": float, "disk_used": int, "disk_free": int, "rss": int})
    return spark.createDataFrame([(t, n, n > 0) for t, n in report.items()], "name string, n long, complete boolean")


EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _event_stream(spark, sf):
    return S.read_stream(spark, sf, EVENT_SCHEMA, glob="events.parquet")


def _drained(spark, df, name):
    base = K.scratch(spark, name)
    S.drain(df, f"{base}/out", f"{base}/state")
    return spark.read.schema(df.schema).parquet(f"{base}/out")


@query("T1_stream_first_wins", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def t1(spark, sf):
    return _drained(spark, S.first_wins(_event_stream(spark, sf), ["event_id"], "ts", "40 days"), "t1").groupBy("event_type").agg(F.count("*").alias("n"))


#: what the watermark, a day behind the last event, has passed when all is read
@query("T2_stream_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 DAY THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def t2(spark, sf):
    s = _drained(spark, S.sessions(_event_stream(spark, sf), "user_id", "ts", "2 days"), "t2")
    return s.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_ts", "last_ts")), "n")


@query("T3_stream_counts", "SELECT event_type, start, count(*) AS n FROM (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS start FROM events) GROUP BY ALL HAVING start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def t3(spark, sf):
    c = _drained(spark, S.counts(_event_stream(spark, sf), "event_type", "ts", "1 day"), "t3")
    return c.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("T4_stream_look_ahead", "SELECT a.event_id, b.event_id AS later_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 3 DAY WHERE a.event_type = 'signup' AND b.event_type = 'purchase'")
def t4(spark, sf):
    """Pairs of a sign-up and a purchase of the same user within three days; rows without one come when their horizon is over."""
    e = _event_stream(spark, sf)
    a, b = e.filter("event_type = 'signup'").select("event_id", "user_id", "ts"), e.filter("event_type = 'purchase'").select(F.col("event_id").alias("later_id"), "user_id", "ts")
    pairs = S.look_ahead(a, b.withColumnRenamed("user_id", "other_id"), "user_id", "ts", "ts", 3, event_by="other_id", carried=["later_id"])
    return _drained(spark, pairs.select("event_id", "later_id"), "t4").filter("later_id is not null")


_BALANCES = "VALUES ('fixed_linear_score', 'none'), ('variable_logit', 'weights'), ('logit_sampled', 'undersample'), ('entropy_tree', 'undersample'), ('bagged_trees', 'undersample'), ('linear_svm', 'undersample'), ('tree_ensemble', 'weights'), ('neural_net', 'undersample'), ('stacked', 'undersample'), ('boosted_deep', 'weights')"


@query("X17_peer_specs", f"SELECT model, CAST(CASE WHEN balance = 'undersample' THEN 2 * (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) ELSE (SELECT count(*) FROM labels) END AS BIGINT) AS train_rows FROM ({_BALANCES}) t(model, balance)")
def x17(spark, sf):
    """The rows that each specification trains on."""
    from tidemark.operators.models import peer_specs

    labels = read(spark, sf, "labels")
    n = {"undersample": L.equal_classes(labels, "quality", "doc_id").count()}
    return spark.createDataFrame([(s.name, n.get(s.balance, labels.count())) for s in peer_specs(light=False)], "model string, train_rows long")


@query("X29_provenance", f"SELECT 'names.txt' AS name, sha256({_NAMES}) AS sha256 FROM region")
def x29(spark, sf):
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        p = R.provenance(d, [_names_file(spark, sf, d)])
    return spark.createDataFrame(list(p["inputs"].items()), "name string, sha256 string")


@query("X30_summary_text", "SELECT concat('| ', n_name, ' | ', n, ' |') AS line FROM (SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)")
def x30(spark, sf):
    n = read(spark, sf, "nation").join(read(spark, sf, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(x,) for x in K.markdown(n).split("\n")[2:]], "line string")

