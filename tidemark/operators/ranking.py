"""Quality of rankings and probabilities as aggregates. Rows are first grouped by score, so what is sorted has a row for each
distinct score and group. Unknown scores rank last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import half_up, uniform_bin
from tidemark.operators.ordered import running

LEAST_POSITIVES = 10


def _score(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.coalesce(F.when(~F.isnan(x), x), F.lit(float("-inf")))


def by_score(df: DataFrame, y: str, score: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """For each group and distinct score: n (rows, or the sum of a weight), pos, and running cn, cp from the top, with the group's tn and tp."""
    g = df.groupBy(*by, _score(score).alias("_s")).agg((F.sum(weight) if weight else F.count("*")).alias("n"), F.sum(F.coalesce(F.col(y), F.lit(0))).cast("long").alias("pos"))
    if not by:  # one group: ranges of scores are summed apart
        return running(g, [F.col("_s").desc()], {"cn": "n", "cp": "pos"}).join(F.broadcast(g.agg(F.sum("n").alias("tn"), F.sum("pos").alias("tp"))), F.lit(True))
    w, down = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumns({"cn": F.sum("n").over(down), "cp": F.sum("pos").over(down), "tn": F.sum("n").over(w), "tp": F.sum("pos").over(w)})


def top_rows(fraction: float) -> Column:
    """How many of tn rows the top fraction is: one at least."""
    return F.least(F.greatest(half_up(F.col("tn") * F.lit(fraction)), F.lit(1)), F.col("tn"))


def top_precision(fraction: float) -> Column:
    """Over by_score rows: precision among the top fraction, of which ties at the edge share what is left."""
    k = top_rows(fraction)
    taken = F.least(F.greatest(k - (F.col("cn") - F.col("n")), F.lit(0)), F.col("n"))
    return F.sum(F.col("pos") * taken / F.col("n")) / F.max(k)


def ranking_metrics(df: DataFrame, y: str, score: str, by: Sequence[str] = (), least: int = LEAST_POSITIVES) -> DataFrame:
    """n_pos, n_neg, ROC and PR areas, precision at 1, 5 and 10 %, lift of the top decile, status (ML7, T16). Groups with
    too few positives have no values."""
    g = by_score(df, y, score, by)
    neg_below = (F.col("tn") - F.col("tp")) - (F.col("cn") - F.col("cp"))
    roc = F.sum(F.col("pos") * (neg_below + (F.col("n") - F.col("pos")) * F.lit(0.5).cast("double"))) / (F.max("tp") * (F.max("tn") - F.max("tp")))
    pr = F.sum(F.col("pos") / F.col("tp") * (F.col("cp") / F.col("cn")))
    fair = g.filter((F.col("tp") > 0) & (F.col("tp") < F.col("tn")))
    m = g.groupBy(*by).agg(F.max("tp").alias("n_pos"), (F.max("tn") - F.max("tp")).alias("n_neg"), *(top_precision(f).alias(f"top_{round(100 * f)}pct_precision") for f in (0.01, 0.05, 0.10)), (F.max("tp") / F.max("tn")).alias("_rate"))
    a = fair.groupBy(*by).agg(roc.alias("roc_auc"), pr.alias("pr_auc"))
    m = m.join(a, list(by), "left") if by else m.join(a, F.lit(True), "left")
    m = m.withColumn("top_decile_lift", F.try_divide("top_10pct_precision", "_rate")).drop("_rate").withColumn("status", F.when(F.col("n_pos") < least, "blocked_sparse").otherwise("fit"))
    values = ("roc_auc", "pr_auc", "top_1pct_precision", "top_5pct_precision", "top_10pct_precision", "top_decile_lift")
    return m.withColumns({c: F.when(F.col("status") == "fit", F.col(c)) for c in values})


def top_k(df: DataFrame, y: str, score: str, key: str, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """k, precision and recall of the k best rows, ties by key (O3, ML5)."""
    w = Window.partitionBy(*by).orderBy(_score(score).desc(), key)
    if not by:  # the best rows of one group, by a top-k of each task; the window then sees just those
        total = df.agg(F.sum(y).alias("_p"))
        df = df.orderBy(_score(score).desc(), key).limit(max(ks))
    r = df.withColumn("_rn", F.row_number().over(w)).join(F.broadcast(total), F.lit(True)) if not by else df.withColumn("_rn", F.row_number().over(w)).withColumn("_p", F.sum(y).over(Window.partitionBy(*by)))
    out = None
    for k in ks:
        one = r.filter(F.col("_rn") <= k).groupBy(*by).agg(F.avg(F.col(y).cast("double")).alias("precision"), (F.sum(y) / F.greatest(F.max("_p"), F.lit(1))).alias("recall")).select(*by, F.lit(k).alias("k"), "precision", "recall")
        out = one if out is None else out.unionByName(one)
    return out


def top_fraction(df: DataFrame, y: str, score: str, key: str, fraction: float, by: Sequence[str] = ()) -> DataFrame:
    """k, precision, sensitivity, specificity, balanced accuracy and NDCG of the top fraction, ties by key (ML6, W11)."""
    one = Window.partitionBy(*by)
    r = df.select(*by, F.coalesce(F.col(y), F.lit(0)).cast("int").alias("_y"), _score(score).alias("_s"), F.col(key).alias("_key"))
    if by:
        r = r.withColumns({"_rn": F.row_number().over(one.orderBy(F.col("_s").desc(), "_key")), "_n": F.count("*").over(one), "_p": F.sum("_y").over(one)})
    else:
        n = r.agg(F.count("*").alias("_n"), F.sum("_y").alias("_p"))
        r = running(r.withColumn("_one", F.lit(1).cast("long")), [F.col("_s").desc(), F.col("_key")], {"_rn": "_one"}).join(F.broadcast(n), F.lit(True))
    r = r.withColumn("_k", F.least(half_up(F.col("_n") * F.lit(fraction)), F.col("_n")))
    hit, gain = F.col("_rn") <= F.col("_k"), 1 / F.log2(1 + F.col("_rn"))
    tp, k, p, n = F.sum(F.when(hit, F.col("_y")).otherwise(0)), F.max("_k"), F.max("_p"), F.max("_n")
    m = r.groupBy(*by).agg(k.alias("k"), tp.alias("_tp"), p.alias("_pos"), n.alias("_all"), F.sum(F.when(hit & (F.col("_y") == 1), gain).otherwise(0.0)).alias("_dcg"), F.sum(F.when((F.col("_rn") <= F.col("_k")) & (F.col("_rn") <= F.col("_p")), gain).otherwise(0.0)).alias("_best"))
    sens, spec = F.try_divide(F.col("_tp"), F.col("_pos")), F.try_divide(F.col("_all") - F.col("_pos") - (F.col("k") - F.col("_tp")), F.col("_all") - F.col("_pos"))
    return m.select(*by, "k", F.try_divide(F.col("_tp"), F.col("k")).alias("precision"), sens.alias("sensitivity"), spec.alias("specificity"), ((sens + spec) / 2).alias("bac"), F.coalesce(F.try_divide("_dcg", "_best"), F.lit(0.0)).alias("ndcg"))


def calibration(df: DataFrame, y: str, p: str, key: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Brier score, that of the base rate, skill, and calibration error with bins of equal width and of equal size (ML5, W12, W13)."""
    w = Window.partitionBy(*by)
    r = df.select(*by, F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p"), F.col(key).alias("_key"))
    r = r.withColumn("_u", uniform_bin(F.col("_p"), bins))
    if by:
        r = r.withColumns({"_q": F.ntile(bins).over(w.orderBy("_p", "_key")), "_n": F.count("*").over(w), "_rate": F.avg("_y").over(w)})
    else:
        n = r.agg(F.count("*").alias("_n"), F.avg("_y").alias("_rate"))
        r = running(r.withColumn("_one", F.lit(1).cast("long")), [F.col("_p").asc(), F.col("_key").asc()], {"_rn": "_one"}).join(F.broadcast(n), F.lit(True))
        size, more = F.floor(F.col("_n") / bins), F.col("_n") % bins  # the first `more` bins have a row more
        large = more * (size + 1)
        r = r.withColumn("_q", F.when(F.col("_rn") <= large, F.ceil(F.col("_rn") / (size + 1))).otherwise(more + F.ceil((F.col("_rn") - large) / F.greatest(size, F.lit(1)))).cast("int"))

    def error(b: str, name: str) -> DataFrame:
        one = r.groupBy(*by, b).agg((F.abs(F.avg("_y") - F.avg("_p")) * F.count("*") / F.max("_n")).alias("e"))
        return one.groupBy(*by).agg(F.sum("e").alias(name))

    m = r.groupBy(*by).agg(F.count("*").alias("n_obs"), F.avg(F.pow(F.col("_p") - F.col("_y"), 2)).alias("brier"), F.avg(F.pow(F.col("_rate") - F.col("_y"), 2)).alias("brier_null"), F.max("_rate").alias("pos_rate"))
    m = m.withColumn("brier_skill_score", F.when(F.col("brier_null") > 0, 1 - F.col("brier") / F.col("brier_null")))
    for b, name in (("_u", "ece"), ("_q", "ece_quantile")):
        e = error(b, name)
        m = m.join(e, list(by), "left") if by else m.join(e, F.lit(True), "left")
    return m


def top_decile_threshold(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """The interpolated 90 % quantile of p, and precision and recall of what reaches it."""
    t = df.groupBy(*by).agg(F.percentile(p, F.lit(0.9).cast("double")).alias("threshold"))
    j = df.join(F.broadcast(t), list(by)) if by else df.join(F.broadcast(t), F.lit(True))  # a row for each group
    hit = F.col(p) >= F.col("threshold")
    tp = F.count_if(hit & (F.col(y) == 1))
    return j.groupBy(*by, "threshold").agg(F.coalesce(F.try_divide(tp, F.count_if(hit)), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(tp, F.count_if(F.col(y) == 1)), F.lit(0.0)).alias("recall"))
