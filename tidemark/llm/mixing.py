"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Token counts are summed over the cells that the dimensions (source, language, topic) span. Cell weights
start as those sums; each step scales them so that one dimension's sums meet its targets, and steps
alternate over the dimensions until all hold within a tolerance; targets that can't be met together (which may be
so if combinations of values have no documents) end with an error that names the gap. A document is then kept with a probability of its cell: a
common factor times weight over tokens, at most 1, where the factor is set so that the expected tokens
are `keep` of all (cells that reach 1 leave their excess to the others). The draw is a hash of the
document id and a seed, so it's alike on every run and machine.

Targets of a dimension are shares by value, or an exponent: shares in proportion to the tokens to that power.
Null values of a dimension are a value of their own. Null and empty texts have no tokens and are kept
with their cell's probability, or dropped if the cell has no tokens at all. Rows of one doc_id are drawn alike;
a null doc_id is drawn as the text "null". An empty table gives an empty one. Columns of docs stay as they are, whatever
their names: mix() refuses a prefix whose columns exist, sample() picks one of its own.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import stored

BROADCAST_CELLS = 100_000


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def style(text: str | Column) -> Column:
    """A stand-in where documents have no column of topics: the kind of text, by marks that it holds. Any other column can be a dimension."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(t.contains(" | "), "table").when(t.contains("!! "), "notice").when(F.lower(t).contains("license"), "licensed").when(F.length(t) < 600, "short").otherwise("prose")


def rake(cells: DataFrame, dims: Sequence[str], targets: Sequence[dict | float], tolerance: float = 1e-12, rounds: int = 400, most: float = 1e-4) -> DataFrame:
    """cells (dims, tokens) with a column weight, whose sums by each dimension meet the targets; the sum of all stays. Steps end when no sum misses its
    target by more than `tolerance` of all tokens, or after so many rounds, or when they gain hardly anything any more: then with a warning, or if the gap is above `most`, an error."""
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    whole = Window.partitionBy()
    out = out.withColumn("total", F.sum("tokens").over(whole).cast("double"))
    for d, target in zip(dims, targets):
        by = out.groupBy(d).agg(F.sum("tokens").cast("double").alias("t"))
        if isinstance(target, dict):
            share = F.coalesce(*(F.when(F.col(d).eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in target.items()), F.lit(0.0))
        else:
            share = F.when(F.col("t") > 0, F.pow("t", F.lit(float(target)))).otherwise(0.0)
        by = by.select(F.col(d).alias("v"), share.alias("s")).withColumn("s", F.try_divide("s", F.sum("s").over(whole)))
        out = out.join(by, F.col(d).eqNullSafe(F.col("v")), "left").withColumn(f"goal_{d}", F.col("s") * F.col("total")).drop("v", "s")
    out, last = stored(out, "cells"), float("inf")
    for i in range(4, rounds + 1, 4):
        for d in [*dims] * 4:
            now = F.sum("weight").over(Window.partitionBy(d))
            out = out.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"goal_{d}") / now).otherwise(0.0))
        out = stored(out, "cells")
        gap = None
        for d in dims:
            by = out.groupBy(d).agg(F.abs(F.sum("weight") - F.first(f"goal_{d}")).alias("g"), F.first("total").alias("total")).select(F.try_divide("g", "total").alias("g"))
            gap = by if gap is None else gap.unionByName(by)
        gap = gap.agg(F.coalesce(F.max("g"), F.lit(0.0))).first()[0]  # null: there are no tokens or no targets
        if gap <= tolerance:
            return out
        if gap > 0.995 * last:  # it has settled elsewhere
            break
        last = gap
    if gap <= most:
        warnings.warn(f"after {i} rounds a marginal still misses its target by {gap:.3g} of all tokens", stacklevel=2)
        return out
    raise RuntimeError(f"after {i} rounds a marginal still misses its target by {gap:.3g} of all tokens")


def calibrate(raked: DataFrame, keep: float) -> DataFrame:
    """raked with a column probability."""
    room = Window.orderBy("ratio", *(c for c in raked.columns if c not in ("tokens", "weight", "total") and not c.startswith("goal_"))).rowsBetween(Window.unboundedPreceding, -1)
    x = raked.withColumn("ratio", F.when(F.col("weight") > 0, F.col("tokens") / F.col("weight"))).withColumn("w_all", F.sum("weight").over(Window.partitionBy()))
    live = x.filter("ratio is not null")
    live = live.withColumn("t_before", F.coalesce(F.sum("tokens").over(room), F.lit(0))).withColumn("w_before", F.coalesce(F.sum("weight").over(room), F.lit(0.0)))
    budget = F.col("total") * F.lit(float(keep))
    full = F.col("t_before") + F.col("ratio") * (F.col("w_all") - F.col("w_before")) <= budget
    live = live.withColumn("full", full)
    every = Window.partitionBy()
    spent, gone = F.sum(F.when(F.col("full"), F.col("tokens")).otherwise(0)).over(every), F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0.0)).over(every)
    factor = F.try_divide(budget - spent, F.col("w_all") - gone)
    p = F.when(F.col("full"), 1.0).otherwise(F.least(F.lit(1.0), factor / F.col("ratio")))
    return live.withColumn("probability", p).select(*raked.columns, "probability").unionByName(x.filter("ratio is null").select(*raked.columns, F.lit(0.0).alias("probability")))


def draw(key: str | Column, seed: str) -> Column:
    """A number in [0, 1) from a hash."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / float(16**13)


def mix(docs: DataFrame, dims: Sequence[Column], targets: Sequence[dict | float], keep: float = 0.5, seed: str = "mix", key: str = "doc_id", text: str = "text", tolerance: float = 1e-12, broadcast_cells: int = BROADCAST_CELLS, prefix: str = "mix") -> DataFrame:
    """docs with the columns mix_0.. (the dimensions), mix_tokens, mix_probability and mix_sampled, or another prefix."""
    names, tokens, chance, sampled = [f"{prefix}_{i}" for i in range(len(dims))], f"{prefix}_tokens", f"{prefix}_probability", f"{prefix}_sampled"
    own = [*names, tokens, chance, sampled, *(f"{prefix}_cell_{i}" for i in range(len(dims)))]
    if taken := {c.lower() for c in own} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has the columns {sorted(taken)}; choose another prefix")
    x = docs.withColumns(dict(zip(names, dims)) | {tokens: words(text)})
    cells = stored(x.groupBy(*names).agg(F.sum(tokens).alias("tokens")), "cells")
    chances = stored(calibrate(rake(cells, names, targets, tolerance), keep).select(*(F.col(n).alias(f"{prefix}_cell_{i}") for i, n in enumerate(names)), F.col("probability").alias(chance)), "chances")
    on = [F.col(n).eqNullSafe(F.col(f"{prefix}_cell_{i}")) for i, n in enumerate(names)]
    small = chances.count() <= broadcast_cells
    out = x.join(F.broadcast(chances) if small else chances, on, "left").drop(*own[-len(dims) :])
    return out.withColumn(sampled, draw(key, seed) < F.coalesce(F.col(chance), F.lit(0.0)))


def sample(docs: DataFrame, dims: Sequence[Column], targets: Sequence[dict | float], **how) -> DataFrame:
    """The rows drawn, with the columns of docs."""
    prefix = "mix"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "x"
    return mix(docs, dims, targets, prefix=prefix, **how).filter(f"{prefix}_sampled").select(*docs.columns)


def shares(mixed: DataFrame, targets: Sequence[dict | float]) -> DataFrame:
    """dimension, value, target, expected: shares of tokens wanted, and expected under the probabilities of mix (which
    cells that reach 1 keep from the targets); the rows are those of the dimensions' values."""
    every, out = Window.partitionBy("dimension"), None
    for i, target in enumerate(targets):
        t = F.sum("mix_tokens").cast("double")
        by = mixed.groupBy(F.col(f"mix_{i}").cast("string").alias("value")).agg(t.alias("t"), F.sum(F.col("mix_tokens") * F.coalesce("mix_probability", F.lit(0.0))).alias("k"))
        want = F.coalesce(*(F.when(F.col("value").eqNullSafe(F.lit(None if k is None else str(k))), F.lit(float(v))) for k, v in target.items()), F.lit(0.0)) if isinstance(target, dict) else F.when(F.col("t") > 0, F.pow("t", F.lit(float(target)))).otherwise(0.0)
        by = by.select(F.lit(i).alias("dimension"), "value", want.alias("s"), "k")
        out = by if out is None else out.unionByName(by)
    return out.select("dimension", "value", F.try_divide("s", F.sum("s").over(every)).alias("target"), F.try_divide("k", F.sum("k").over(every)).alias("expected"))
