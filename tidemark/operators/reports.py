"""Reports over panels: dispersion over folds, attrition ladders, lift by tier, event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio
from tidemark.operators.audit import long_table

T95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086)


def dispersion(folds: DataFrame, by: Sequence[str], value: str, positives: str, least_positives: int = 10, least_folds: int = 5) -> DataFrame:
    """Mean, deviation, standard error and 95 % interval of a metric over folds that have enough positives."""
    d = folds.filter((F.col(positives) >= least_positives) & F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count("*").alias("folds"), F.min(value).alias("least"), F.max(value).alias("most"))
    t = F.coalesce(F.get(F.array(*map(F.lit, T95)), (F.col("folds") - 2).cast("int")), F.lit(1.96))
    d = d.filter(F.col("folds") >= least_folds).withColumn("se", F.col("sd") / F.sqrt("folds"))
    return d.withColumn("low", F.col("mean") - t * F.col("se")).withColumn("high", F.col("mean") + t * F.col("se"))


def ladder(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """metric, value: rows left after each step, counted in one pass."""
    out, held = {"all": F.count("*")}, F.lit(True)
    for name, cond in steps.items():
        held = held & F.coalesce(cond, F.lit(False))
        out[name] = F.count_if(held)
    return long_table(df, out)


def tier_lift(df: DataFrame, tier: str, flag: str, target: str, superset: str = "all_matched") -> DataFrame:
    """tier, n, n11, rate by flag, and lift, with a tier of all that aren't dropped."""
    t = df.select(F.explode(F.when(F.col(tier) == "dropped", F.array(tier)).otherwise(F.array(F.col(tier), F.lit(superset)))).alias("tier"), F.col(flag).cast("double").alias("f"), F.col(target).cast("double").alias("y"))
    out = t.groupBy("tier").agg(F.count("*").alias("n"), F.count_if((F.col("f") == 1) & (F.col("y") == 1)).alias("n11"), F.avg("y").alias("prevalence"), F.avg(F.when(F.col("f") == 1, F.col("y"))).alias("rate"))
    return out.withColumn("lift", ratio("rate", "prevalence"))


def event_time(anchors: DataFrame, panel: DataFrame, key: str, year: str, label: str, reach: int = 3) -> DataFrame:
    """rel, n, rate: the label of years around each anchor, for anchors whose years are all there (J17, J24, Q18). The
    shifts are generated on the anchors' side, so one equi-join serves all of them."""
    a = anchors.select(key, F.col(year).alias("_y0"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("rel")).withColumn(year, F.col("_y0") + F.col("rel"))
    j = a.join(panel.select(key, year, F.col(label).cast("double").alias("_v")), [key, year])
    full = j.groupBy(key, "_y0").agg(F.countDistinct("rel").alias("c")).filter(F.col("c") == 2 * reach + 1).select(key, "_y0")
    return j.join(full, [key, "_y0"], "left_semi").groupBy("rel").agg(F.count("*").alias("n"), F.avg("_v").alias("rate"))
