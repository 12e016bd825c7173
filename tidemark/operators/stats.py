"""Small-sample statistics in numpy, and their use on grouped frames. Heavy sums are Spark aggregates; what numpy gets is
bounded by the number of groups, parameters or bootstrap draws."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import numbered
from tidemark.operators.ranking import top_precision, top_rows
from tidemark.sources.sinks import kept

LIFT_RANGES = 128  # ranges of scores in which lift intervals look for the edge of the top decile


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_share(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if math.isfinite(f) else 0.0


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, residuals and (X'X)^-1."""
    inverse = np.linalg.pinv(x.T @ x)
    b = inverse @ x.T @ y
    return b, y - x @ b, inverse


def break_test(years: np.ndarray, share: np.ndarray, year: int) -> tuple[float, float]:
    """F and its p-value for a change of level and slope from a year on (ML9)."""
    post, c = (years >= year).astype(float), years - years.mean()
    full = np.stack([np.ones(len(c)), c, post, post * c], 1)
    r1, r0 = ols(full, share)[1], ols(full[:, :2], share)[1]
    d1, d2 = np.linalg.matrix_rank(full) - 2, len(c) - np.linalg.matrix_rank(full)
    if d1 <= 0 or d2 <= 0 or not r1 @ r1:
        return float("nan"), float("nan")
    f = ((r0 @ r0 - r1 @ r1) / d1) / (r1 @ r1 / d2)
    return float(f), f_tail(float(f), d1, d2)


def structural_breaks(shares: DataFrame, by: Sequence[str], year: str, share: str, breaks: Sequence[int], least: int = 6) -> DataFrame:
    """A break test for each group and year; groups with fewer years than `least` have none. A group is a few yearly rows."""
    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(year)
        n = f[year].nunique()
        rows = [(*key, b, *break_test(f[year].to_numpy(float), f[share].to_numpy(float), b), n) for b in breaks] if n >= least else []
        return pd.DataFrame(rows, columns=[*by, "break_year", "f_stat", "p_value", "n_years"])

    kinds = ", ".join(f"{c} {shares.schema[c].dataType.simpleString()}" for c in by)
    return shares.select(*by, year, share).groupBy(*by).applyInPandas(one, f"{kinds}, break_year long, f_stat double, p_value double, n_years long")


def residual_regression(df: DataFrame, y_res: str, t_res: str, cluster: str | None = None) -> dict:
    """Slope of y on t with a constant, HC3 errors or, with a cluster, clustered ones with the usual small-sample factor
    and t inference (ML11, ML12). All sums are aggregates; only five numbers reach the driver."""
    y, t = F.col(y_res).cast("double"), F.col(t_res).cast("double")
    n, st, sy, stt, sty, groups = df.agg(F.count("*"), F.sum(t), F.sum(y), F.sum(t * t), F.sum(t * y), F.countDistinct(cluster) if cluster else F.lit(0)).first()
    if not n or n < 3:
        return {"n_obs": n, "coef": None, "std_err": None, "p_value": None, "status": "skipped_too_small"}
    det = n * stt - st * st
    if det <= 1e-12 * max(1.0, n * stt):
        return {"n_obs": n, "coef": None, "std_err": None, "p_value": None, "status": "skipped_constant_treatment"}
    slope, level = (n * sty - st * sy) / det, (stt * sy - st * sty) / det
    e = y - F.lit(level) - F.lit(slope) * t
    pull = (F.lit(float(n)) * t - F.lit(st)) / F.lit(det)  # what a residual adds to the slope
    if cluster is None:
        lever = (F.lit(stt) - 2 * t * F.lit(st) + F.lit(float(n)) * t * t) / F.lit(det)
        variance = df.agg(F.sum(F.pow(pull * e / (1 - lever), 2))).first()[0]
        se = math.sqrt(variance)
        p = normal_tail(slope / se) if se else None
    else:
        raw = df.groupBy(F.coalesce(F.col(cluster).cast("string"), F.lit("__missing")).alias("_c")).agg(F.sum(pull * e).alias("s")).agg(F.sum(F.pow("s", 2)), F.count("*")).first()
        groups = raw[1]
        if groups < 2:
            return {"n_obs": n, "coef": slope, "std_err": None, "p_value": None, "status": "skipped_one_cluster"}
        se = math.sqrt(raw[0] * groups / (groups - 1) * (n - 1) / (n - 2))
        p = t_tail(slope / se, groups - 1) if se else None
    return {"n_obs": n, "coef": slope, "std_err": se, "p_value": p, "status": "fit"}


def lift_intervals(df: DataFrame, by: Sequence[str], y: str, score: str, cluster: str, reps: int = 1000, seed: int = 7, least: int = 30) -> DataFrame:
    """A percentile interval of the top decile's lift for each group: whole clusters are drawn anew with replacement, as many as there are;
    ties at the edge share (ML8). Null labels count as 0, null scores rank last. Fewer positives than `least`: NaN.

    Rows are first summed by cluster and score. A draw is a hash of seed, repetition and number, so that repetitions are spread over all
    machines and are alike on each run. Cells lie in ranges of scores. First each repetition is summed by range, where a cell times its draws is a
    row that joins and sums as it streams, never shuffled or sorted; then only the range that holds a repetition's edge is ranked by score."""
    s = F.col(score).cast("double")
    cells = df.groupBy(*by, F.coalesce(F.col(cluster).cast("string"), F.lit("")).alias("_c"), F.coalesce(F.when(~F.isnan(s), s), F.lit(float("-inf"))).alias("_s")).agg(F.count("*").alias("_n"), F.sum(F.coalesce(F.col(y), F.lit(0))).cast("long").alias("_pos"))
    cells = kept(cells, "cells")
    ids = kept(numbered(cells.select(*by, "_c").distinct(), *by, "_c"), "clusters")
    # few rows that become many: without a number of partitions they would be one task's
    groups = ids.groupBy(*by).agg(F.min("row_id").alias("_first"), F.count("*").alias("_g"))
    draws = groups.select("_first", "_g").withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).repartition(reps, "_r").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_g") - 1)))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "_r", "_i")), 1, 13), 16, 10).cast("long") % F.col("_g") + F.col("_first")
    times = kept(draws.groupBy("_r", pick.alias("row_id")).agg(F.count("*").alias("_times")), "draws")
    # equal scores of a group share a range
    ranged = kept(cells.join(ids, [*by, "_c"]).drop("_c").repartitionByRange(LIFT_RANGES, *by, F.col("_s").desc()).withColumn("_range", F.spark_partition_id()), "cells")
    weighed = (F.sum(F.col("_times") * F.col("_n")).alias("n"), F.sum(F.col("_times") * F.col("_pos")).alias("pos"))
    sums = times.join(ranged.groupBy(*by, "row_id", "_range").agg(F.sum("_n").alias("_n"), F.sum("_pos").alias("_pos")), "row_id").groupBy(*by, "_r", "_range").agg(*weighed)
    one = Window.partitionBy(*by, "_r")
    down = one.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumns({"cn": F.sum("n").over(down), "cp": F.sum("pos").over(down), "tn": F.sum("n").over(one), "tp": F.sum("pos").over(one)})
    edges = kept(sums.filter((F.col("cn") - F.col("n") < top_rows(0.1)) & (F.col("cn") >= top_rows(0.1))).select(*by, "_r", "_range", (F.col("cn") - F.col("n")).alias("_above_n"), (F.col("cp") - F.col("pos")).alias("_above_pos"), "tn", "tp"), "edges")
    near = ranged.join(edges.select(*by, "_range").distinct(), [*by, "_range"], "left_semi").join(times, "row_id")
    drawn = near.join(edges, [*by, "_r", "_range"]).groupBy(*by, "_r", "_above_n", "_above_pos", "tn", "tp", "_s").agg(*weighed)
    drawn = drawn.withColumn("cn", F.sum("n").over(one.orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_above_n"))
    precision = F.max("_above_pos") / F.max(top_rows(0.1)) + top_precision(0.1)
    lifts = drawn.groupBy(*by, "_r").agg(F.try_divide(precision, F.try_divide(F.max("tp"), F.max("tn"))).alias("_lift"))
    out = lifts.groupBy(*by).agg(F.percentile("_lift", F.lit(0.025).cast("double")).alias("ci_low"), F.percentile("_lift", F.lit(0.975).cast("double")).alias("ci_high"))
    enough = cells.groupBy(*by).agg((F.sum("_pos") >= least).alias("_enough"))
    return enough.join(out, list(by), "left").select(*by, *(F.when(F.col("_enough"), F.coalesce(c, F.lit(float("nan")))).otherwise(float("nan")).alias(c) for c in ("ci_low", "ci_high")))


def missing_profiles(df: DataFrame, flags: Sequence[str], ks: Sequence[int] = (3, 4, 5), seed: int = 7, steps: int = 60, floor: float = 1e-6) -> tuple[dict, DataFrame]:
    """A Gaussian mixture with diagonal covariances over 0/1 flags; the number of parts is chosen by BIC (ML10). Equal
    patterns are counted once, so EM runs over at most 2^flags weighted rows. The best model, and df with its cluster."""
    pattern = F.concat(*(F.coalesce(F.col(c).cast("int"), F.lit(0)).cast("string") for c in flags))
    counts = df.groupBy(pattern.alias("p")).count().collect()
    x = np.array([[int(v) for v in r.p] for r in counts], float).reshape(-1, len(flags))
    w = np.array([r["count"] for r in counts], float)
    best = None
    for k in ks:
        for start in range(5):
            rng = np.random.default_rng(seed + start)
            mean = x[rng.choice(len(x), k, p=w / w.sum())] + rng.normal(0, 0.05, (k, x.shape[1]))
            var, share = np.full(mean.shape, x.var() + floor), np.full(k, 1 / k)
            for _ in range(steps):
                log = np.log(share) - 0.5 * (np.log(2 * np.pi * var)[None] + (x[:, None] - mean) ** 2 / var).sum(2)
                top = log.max(1, keepdims=True)
                total = top[:, 0] + np.log(np.exp(log - top).sum(1))
                r = np.exp(log - total[:, None]) * w[:, None]
                mass = r.sum(0) + 1e-12
                mean = (r.T @ x) / mass[:, None]
                var = (r.T @ x**2) / mass[:, None] - mean**2 + floor
                share = mass / mass.sum()
            bic = -2 * (w @ total) + (2 * k * x.shape[1] + k - 1) * np.log(w.sum())
            if best is None or bic < best["bic"]:
                best = {"k": k, "bic": float(bic), "cluster": {c.p: int(i) for c, i in zip(counts, log.argmax(1))}}
    named = df.sparkSession.createDataFrame(list(best["cluster"].items()), "_p string, missing_profile_cluster int")
    return best, df.withColumn("_p", pattern).join(F.broadcast(named), "_p").drop("_p")
