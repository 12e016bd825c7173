"""Ranking metrics (O3, O4, ML5-ML7, Q17), each as a query with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ranking as R
from tidemark.plans.lake import query, read


def scored(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") % 97 / 97.0).alias("p"))
    return read(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")).join(d, "doc_id")


SCORED = "s AS (SELECT doc_id, quality AS y, lang, n_chars % 97 / 97.0 AS p FROM labels JOIN documents USING (doc_id))"
BY = f"{SCORED}, g AS (SELECT lang, p, count(*) AS n, sum(y) AS pos FROM s GROUP BY ALL), c AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(n) OVER (PARTITION BY lang) AS tn, sum(pos) OVER (PARTITION BY lang) AS tp FROM g WINDOW w AS (PARTITION BY lang ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"


def _top(f: float) -> str:
    k = f"least(greatest(floor(tn * {f} + 0.5), 1), tn)"
    return f"sum(pos * least(greatest({k} - (cn - n), 0), n) / n) / max({k})"


@query("O3_top_k", f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p DESC, doc_id) AS rn, sum(y) OVER (PARTITION BY lang) AS t FROM s) " + " UNION ALL ".join(f"SELECT lang, {k} AS k, round(avg(y), 6) AS precision, round(sum(y) / greatest(max(t), 1), 6) AS recall FROM r WHERE rn <= {k} GROUP BY lang" for k in (10, 50)))
def o3(spark, sf):
    return R.top_k(scored(spark, sf), "y", "p", "doc_id", (10, 50), ["lang"]).select("lang", "k", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("O4_tie_precision", f"WITH {BY} SELECT lang, round({_top(0.1)}, 6) AS precision FROM c GROUP BY lang")
def o4(spark, sf):
    return R.by_score(scored(spark, sf), "y", "p", ["lang"]).groupBy("lang").agg(F.round(R.top_precision(0.1), 6).alias("precision"))


@query("ML5_calibration", f"WITH {SCORED}, b AS (SELECT *, CAST(least(floor(p * 10 + 1e-12), 9) AS INTEGER) AS u, ntile(10) OVER (ORDER BY p, doc_id) AS q, count(*) OVER () AS n, avg(y) OVER () AS rate FROM s) SELECT (SELECT count(*) FROM b) AS n_obs, (SELECT round(avg((p - y) ** 2), 6) FROM b) AS brier, (SELECT round(1 - avg((p - y) ** 2) / avg((rate - y) ** 2), 6) FROM b) AS brier_skill_score, (SELECT round(sum(e), 6) FROM (SELECT abs(avg(y) - avg(p)) * count(*) / max(n) AS e FROM b GROUP BY u)) AS ece, (SELECT round(sum(e), 6) FROM (SELECT abs(avg(y) - avg(p)) * count(*) / max(n) AS e FROM b GROUP BY q)) AS ece_quantile")
def ml5(spark, sf):
    c = R.calibration(scored(spark, sf), "y", "p", "doc_id")
    return c.select("n_obs", *(F.round(x, 6).alias(x) for x in ("brier", "brier_skill_score", "ece", "ece_quantile")))


@query("ML5_top_decile", f"WITH {SCORED}, t AS (SELECT quantile_cont(p, 0.9) AS threshold FROM s) SELECT round(threshold, 6) AS threshold, round((count(*) FILTER (p >= threshold AND y = 1)) / (count(*) FILTER (p >= threshold)), 6) AS precision, round((count(*) FILTER (p >= threshold AND y = 1)) / (count(*) FILTER (y = 1)), 6) AS recall FROM s, t GROUP BY threshold")
def ml5_top(spark, sf):
    t = R.top_decile_threshold(scored(spark, sf), "y", "p")
    return t.select(*(F.round(x, 6).alias(x) for x in ("threshold", "precision", "recall")))


@query("ML6_top_fraction", f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p DESC, doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n, sum(y) OVER (PARTITION BY lang) AS t FROM s), k AS (SELECT *, least(floor(n * 0.3 + 0.5), n) AS k FROM r), m AS (SELECT lang, max(k) AS k, max(n) AS n, max(t) AS t, sum(CASE WHEN rn <= k THEN y ELSE 0 END) AS tp, sum(CASE WHEN rn <= k AND y = 1 THEN 1 / log2(1 + rn) ELSE 0 END) AS dcg, sum(CASE WHEN rn <= k AND rn <= t THEN 1 / log2(1 + rn) ELSE 0 END) AS best FROM k GROUP BY lang) SELECT lang, CAST(k AS BIGINT) AS k, round(tp / k, 6) AS precision, round(tp / t, 6) AS sensitivity, round((n - t - (k - tp)) / nullif(n - t, 0), 6) AS specificity, round((tp / t + (n - t - (k - tp)) / nullif(n - t, 0)) / 2, 6) AS bac, round(coalesce(dcg / nullif(best, 0), 0), 6) AS ndcg FROM m")
def ml6(spark, sf):
    t = R.top_fraction(scored(spark, sf), "y", "p", "doc_id", 0.3, ["lang"])
    return t.select("lang", "k", *(F.round(x, 6).alias(x) for x in ("precision", "sensitivity", "specificity", "bac", "ndcg")))


_FIT = lambda x, n: f"CASE WHEN max(tp) >= 10 THEN round({x}, 6) END AS {n}"


@query("ML7_ranking_metrics", f"WITH {BY} SELECT lang, CAST(max(tp) AS BIGINT) AS n_pos, CAST(max(tn) - max(tp) AS BIGINT) AS n_neg, {_FIT('sum(pos * ((tn - tp) - (cn - cp) + 0.5 * (n - pos))) / (max(tp) * (max(tn) - max(tp)))', 'roc_auc')}, {_FIT('sum(pos / tp * (cp / cn))', 'pr_auc')}, {_FIT(_top(0.05), 'top_5pct_precision')}, {_FIT(f'{_top(0.1)} / (max(tp) / max(tn))', 'top_decile_lift')}, CASE WHEN max(tp) < 10 THEN 'blocked_sparse' ELSE 'fit' END AS status FROM c GROUP BY lang")
def ml7(spark, sf):
    m = R.ranking_metrics(scored(spark, sf), "y", "p", ["lang"])
    return m.select("lang", "n_pos", "n_neg", *(F.round(x, 6).alias(x) for x in ("roc_auc", "pr_auc", "top_5pct_precision", "top_decile_lift")), "status")


@query("X10_top_decile_lift", f"WITH {BY} SELECT lang, round({_top(0.1)} / (max(tp) / max(tn)), 6) AS lift FROM c GROUP BY lang")
def x10(spark, sf):
    g = R.by_score(scored(spark, sf), "y", "p", ["lang"]).groupBy("lang").agg(R.top_precision(0.1).alias("t"), (F.max("tp") / F.max("tn")).alias("r"))
    return g.select("lang", F.round(F.try_divide("t", "r"), 6).alias("lift"))


@query("Q17_ranking_alignment", f"WITH {SCORED}, u AS (SELECT 'length' AS source, lang, y, p FROM s UNION ALL SELECT 'reverse', lang, y, 1 - p FROM s), g AS (SELECT source, lang, p, count(*) AS n, sum(y) AS pos FROM u GROUP BY ALL), c AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(n) OVER (PARTITION BY source, lang) AS tn, sum(pos) OVER (PARTITION BY source, lang) AS tp FROM g WINDOW w AS (PARTITION BY source, lang ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) SELECT source, lang, {_FIT('sum(pos * ((tn - tp) - (cn - cp) + 0.5 * (n - pos))) / (max(tp) * (max(tn) - max(tp)))', 'roc_auc')} FROM c GROUP BY ALL")
def q17(spark, sf):
    s = scored(spark, sf)
    both = s.withColumn("source", F.lit("length")).unionByName(s.withColumn("p", 1 - F.col("p")).withColumn("source", F.lit("reverse")))
    return R.ranking_metrics(both, "y", "p", ["source", "lang"]).select("source", "lang", F.round("roc_auc", 6).alias("roc_auc"))
