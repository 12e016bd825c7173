"""Folds, models and inference (ML). What SQL can express has an oracle; fits are checked by their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import labels as L
from tidemark.operators import models as M
from tidemark.operators import stats as S
from tidemark.plans.lake import query, read

NUMERIC = ["o_totalprice", "lines", "quantity", "discount"]


def panel(spark, sf):
    """Orders as a panel: four numbers, a text column, the year, and a label."""
    l = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("label"))
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate", F.year("o_orderdate").alias("y"))
    return o.join(l, "o_orderkey").withColumns({"lines": F.col("lines").cast("double"), "label": F.col("label").cast("int")})


def years(df) -> list[int]:
    return sorted(r.y for r in df.select("y").distinct().collect())


@query("ML1_rolling_folds", "WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), w(k) AS (VALUES (NULL), (2)) SELECT coalesce(k, 0) AS k, a.y AS test_year, string_agg(CAST(b.y AS VARCHAR), ',' ORDER BY b.y) AS train FROM w CROSS JOIN y a JOIN y b ON b.y < a.y AND (k IS NULL OR b.y >= a.y - k) GROUP BY ALL HAVING count(*) >= 2")
def ml1_folds(spark, sf):
    ys = [r.y for r in read(spark, sf, "orders").select(F.year("o_orderdate").alias("y")).distinct().collect()]
    return spark.createDataFrame([(w or 0, t, ",".join(map(str, tr))) for w, t, tr in L.rolling_folds(ys, [None, 2], 2)], "k int, test_year long, train string")


@query("ML1_backtest")
def ml1(spark, sf):
    df = panel(spark, sf)
    ys = years(df)
    folds = [("rolling_2y", t, tr) for _, t, tr in L.rolling_folds(ys, [2], 2)]
    out, _ = M.backtest(df, [M.Spec("logit", "logit", "weights", {"maxIter": 10})], folds, "y", "label", NUMERIC, "o_orderkey", ["o_orderpriority"])
    return out


@query("ML2_mature_folds", "WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), j AS (SELECT a.y AS t, b.y AS b, row_number() OVER (PARTITION BY a.y ORDER BY b.y DESC) AS r, count(*) OVER (PARTITION BY a.y) AS n FROM y a JOIN y b ON b.y <= a.y - 2 WHERE make_date(a.y + 1, 1, 1) + INTERVAL 365 DAY <= DATE '2001-08-01') SELECT 'expanding' AS train_window, CAST(t AS INTEGER) AS test_year, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS train FROM j GROUP BY t HAVING count(*) >= 2 UNION ALL SELECT 'rolling_2y', CAST(t AS INTEGER), string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) FROM j WHERE r <= 2 GROUP BY t HAVING count(*) >= 2")
def ml2(spark, sf):
    f = L.mature_folds(spark, read(spark, sf, "orders"), "o_orderdate", "2001-08-01", [None, 2], 2)
    return f.select("train_window", "test_year", F.array_join(F.transform("train_years", lambda v: v.cast("string")), ",").alias("train"))


def _one(kind: str, **settings):
    def run(spark, sf):
        df = panel(spark, sf)
        ys = years(df)
        out, _, _ = M.fit_predict(M.Spec(kind, kind, "weights", settings), df.filter(F.col("y") < ys[-2]), df.filter(F.col("y") >= ys[-2]), "label", NUMERIC, "o_orderkey")
        return out

    return run


query("ML3_boosted_trees")(_one("gbt", maxIter=5, maxDepth=3))
query("ML13_logit")(_one("logit", maxIter=20))
query("ML13_entropy_tree")(_one("tree", maxDepth=3, minInstancesPerNode=5))
query("ML13_bagged_trees")(_one("bagged", numTrees=5))
query("ML13_calibrated_svm")(_one("svm", maxIter=10))
query("ML13_neural_net")(_one("mlp", maxIter=15))
query("ML13_stacked")(_one("stack"))


@query("ML4_one_hot", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def ml4(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    df = panel(spark, sf)
    x = Pipeline(stages=M.preprocessor([], ["o_orderpriority"])).fit(df).transform(df)
    return x.groupBy("o_orderpriority").agg(F.sum(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, b: a + b)).cast("long").alias("n"))


_DRAWN = "WITH l AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y FROM lineitem GROUP BY 1), d AS (SELECT CAST(o_custkey AS VARCHAR) AS c, o_totalprice AS s, y FROM orders JOIN l ON l_orderkey = o_orderkey), ids AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS k FROM (SELECT DISTINCT c FROM d)), g AS (SELECT count(*) AS g FROM ids), t AS (SELECT r, CAST(CAST('0x' || substr(md5(concat('7:', r, ':', i)), 1, 13) AS BIGINT) % g AS BIGINT) AS k, count(*) AS times FROM g, range(200) a(r), range((SELECT g FROM g)) b(i) GROUP BY ALL), w AS (SELECT r, s, sum(times) AS n, sum(times * y) AS pos FROM t JOIN ids USING (k) JOIN d USING (c) GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY r ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cn, sum(n) OVER (PARTITION BY r) AS tn, sum(pos) OVER (PARTITION BY r) AS tp FROM w), f AS (SELECT r, sum(pos * least(greatest(least(greatest(floor(tn * 0.1 + 0.5), 1), tn) - (cn - n), 0), n) / n) / max(least(greatest(floor(tn * 0.1 + 0.5), 1), tn)) / (max(tp) / max(tn)) AS lift FROM c GROUP BY r)"


@query("ML8_lift_interval", f"{_DRAWN} SELECT 'all' AS one, CASE WHEN (SELECT sum(y) FROM d) >= 30 THEN round(quantile_cont(lift, 0.025), 6) ELSE 'nan'::DOUBLE END AS ci_low, CASE WHEN (SELECT sum(y) FROM d) >= 30 THEN round(quantile_cont(lift, 0.975), 6) ELSE 'nan'::DOUBLE END AS ci_high FROM f")
def ml8(spark, sf):
    return S.lift_intervals(panel(spark, sf).withColumn("one", F.lit("all")), ["one"], "label", "o_totalprice", "o_custkey", reps=200).select("one", F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"))


#: with two restrictions the F distribution's tail has a closed form
_BREAKS = "WITH l AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y FROM lineitem GROUP BY 1), s AS (SELECT o_orderpriority, year(o_orderdate) AS y, avg(l.y) AS share FROM orders JOIN l ON l_orderkey = o_orderkey GROUP BY ALL), b AS (SELECT * FROM s CROSS JOIN (VALUES (1997), (1999)) t(break_year)), p AS (SELECT o_orderpriority, break_year, y >= break_year AS post, count(*) AS n, regr_syy(share, y) - regr_sxy(share, y) ** 2 / regr_sxx(share, y) AS rest FROM b GROUP BY ALL), f AS (SELECT o_orderpriority, break_year, sum(n) AS n, sum(rest) AS r1 FROM p GROUP BY ALL), a AS (SELECT o_orderpriority, break_year, regr_syy(share, y) - regr_sxy(share, y) ** 2 / regr_sxx(share, y) AS r0 FROM b GROUP BY ALL), v AS (SELECT *, ((r0 - r1) / 2) / (r1 / (n - 4)) AS v FROM f JOIN a USING (o_orderpriority, break_year) WHERE n >= 6)"


@query("ML9_structural_breaks", f"{_BREAKS} SELECT o_orderpriority, CAST(break_year AS BIGINT) AS break_year, round(v, 6) AS f_stat, round(((n - 4) / (n - 4 + 2 * v)) ** ((n - 4) / 2), 6) AS p_value, CAST(n AS BIGINT) AS n_years FROM v")
def ml9(spark, sf):
    s = panel(spark, sf).groupBy("o_orderpriority", "y").agg(F.avg("label").alias("share"))
    return S.structural_breaks(s, ["o_orderpriority"], "y", "share", [1997, 1999]).withColumns({c: F.round(c, 6) for c in ("f_stat", "p_value")})


@query("ML10_missing_profiles")
def ml10(spark, sf):
    df = panel(spark, sf).select("o_orderkey", *(F.when(F.col("o_orderkey") % k == 0, 1).otherwise(0).alias(f"missing_{k}") for k in (2, 3, 5)))
    return S.missing_profiles(df, ["missing_2", "missing_3", "missing_5"])[1].groupBy("missing_profile_cluster").agg(F.count("*").alias("n"))


REGRESSION = "WITH d AS (SELECT o_orderkey, o_custkey, o_totalprice / 1000 AS t, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM orders), s AS (SELECT count(*) AS n, sum(t) AS st, sum(y) AS sy, sum(t * t) AS stt, sum(t * y) AS sty FROM d), b AS (SELECT *, n * stt - st * st AS det, (n * sty - st * sy) / (n * stt - st * st) AS slope, (stt * sy - st * sty) / (n * stt - st * st) AS level FROM s), e AS (SELECT d.*, b.*, (n * t - st) / det AS pull, y - level - slope * t AS r, (stt - 2 * t * st + n * t * t) / det AS lever FROM d, b)"


@query("ML11_hc3_slope", f"{REGRESSION} SELECT count(*) AS n_obs, round(max(slope), 6) AS coef, round(sqrt(sum((pull * r / (1 - lever)) ** 2)), 6) AS std_err FROM e")
def ml11(spark, sf):
    d = read(spark, sf, "orders").select("o_custkey", (F.col("o_totalprice") / 1000).alias("t"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("y"))
    r = S.residual_regression(d, "y", "t")
    return spark.createDataFrame([(r["n_obs"], round(r["coef"], 6), round(r["std_err"], 6))], "n_obs long, coef double, std_err double")


@query("ML12_clustered_slope", f"{REGRESSION}, g AS (SELECT o_custkey, sum(pull * r) AS u FROM e GROUP BY 1) SELECT (SELECT count(*) FROM d) AS n_obs, (SELECT round(slope, 6) FROM b) AS coef, round(sqrt(sum(u * u) * count(*) / (count(*) - 1) * ((SELECT n FROM s) - 1) / ((SELECT n FROM s) - 2)), 6) AS std_err FROM g")
def ml12(spark, sf):
    d = read(spark, sf, "orders").select("o_custkey", (F.col("o_totalprice") / 1000).alias("t"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("y"))
    r = S.residual_regression(d, "y", "t", "o_custkey")
    return spark.createDataFrame([(r["n_obs"], round(r["coef"], 6), round(r["std_err"], 6))], "n_obs long, coef double, std_err double")


@query("ML12_dml")
def ml12_dml(spark, sf):
    r = M.dml(panel(spark, sf), "label", "o_totalprice", ["lines", "quantity"], "o_orderkey", "o_custkey", folds=2, trees=3)
    return spark.createDataFrame([(r["n_obs"], r["coef"], r["std_err"], r["p_value"], r["status"])], "n_obs long, coef double, std_err double, p_value double, status string")


@query("ML14_equal_classes", "SELECT quality, (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) AS n FROM labels GROUP BY quality")
def ml14(spark, sf):
    return L.equal_classes(read(spark, sf, "labels"), "quality", "doc_id").groupBy("quality").agg(F.count("*").alias("n"))


@query("ML15_importance")
def ml15(spark, sf):
    df = panel(spark, sf)
    _, shares, _ = M.fit_predict(M.Spec("t", "tree", "weights", {"maxDepth": 3}), df, df, "label", NUMERIC, "o_orderkey")
    return spark.createDataFrame(shares, "feature string, share double")


@query("ML16_status_grid", "WITH n AS (SELECT count(*) FILTER (year(o_orderdate) = 1995) AS a, count(*) FILTER (year(o_orderdate) = 1996) AS b FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) SELECT model, CAST(y AS BIGINT) AS test_year, CASE WHEN y = 2050 THEN 'skipped_no_rows' WHEN model = 'fixed' THEN 'fit' ELSE 'skipped_one_class' END AS status, a AS n_train, CASE WHEN y = 1996 THEN b ELSE 0 END AS n_test FROM n CROSS JOIN (VALUES ('fixed'), ('logit')) m(model) CROSS JOIN (VALUES (1996), (2050)) t(y)")
def ml16(spark, sf):
    df = panel(spark, sf).withColumn("label", F.when(F.col("y") == 1995, 0).otherwise(F.col("label")))
    return M.backtest(df, [M.Spec("fixed", "fixed", "none"), M.Spec("logit", "logit", "weights", {"maxIter": 5})], [("one", 1996, [1995]), ("none", 2050, [1995])], "y", "label", NUMERIC, "o_orderkey")[1]


@query("ML17_rare_values", "WITH c AS (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 85) SELECT coalesce(c.p_brand, 'rare') AS p_brand, count(*) AS n FROM part LEFT JOIN c USING (p_brand) GROUP BY 1")
def ml17(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_brand")
    return M.group_rare(p, p, "p_brand", 85)[0].groupBy("p_brand").agg(F.count("*").alias("n"))


@query("ML18_year_blocks", "WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), f AS (SELECT y, ntile(3) OVER (ORDER BY y) AS fold FROM y), r AS (SELECT fold, min(y) AS a, max(y) AS b, string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) AS test FROM f GROUP BY 1) SELECT CAST(fold AS INTEGER) AS fold, test, (SELECT coalesce(string_agg(CAST(y AS VARCHAR), ',' ORDER BY y), '') FROM y WHERE y < a - 1 OR y > b + 1) AS train FROM r")
def ml18(spark, sf):
    b = L.year_blocks(read(spark, sf, "orders").withColumn("y", F.year("o_orderdate")), "y", 3, 1)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return b.select("fold", text("test_years").alias("test"), text("train_years").alias("train"))


@query("ML19_cpu_budget", "SELECT n_nationkey AS cores, CASE WHEN n_nationkey >= 8 THEN 2 END AS jobs, CASE WHEN n_nationkey >= 8 THEN 4 END AS threads FROM nation")
def ml19(spark, sf):
    from tidemark.operators.runner import cpu_budget

    def fits(cores: int) -> tuple:
        try:
            return (cores, *cpu_budget(cores, 2, 4))
        except ValueError:
            return cores, None, None

    return spark.createDataFrame([fits(r.n_nationkey) for r in read(spark, sf, "nation").collect()], "cores long, jobs int, threads int")
