"""Fits against second computations: Newton's method for the logistic model, all splits for a tree of one level."""

import random

import numpy as np
import pytest

from tidemark.functions.numeric import finite, sigmoid, task_seed
from tidemark.operators import models as M


@pytest.fixture(scope="module")
def panel():
    r = random.Random(4)
    out = []
    for i in range(400):
        a, b, c = r.randrange(15), r.randrange(9), r.choice([None, 1.0, 2.0, 4.0])
        out.append((i, float(a), float(b), c, int(r.random() < 1 / (1 + np.exp(-(a - 9) / 2 + b / 6)))))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int")


def matrix(rows):
    x = np.array([[v if v is not None else np.nan for v in row[1:4]] for row in rows])
    seen = np.sort(x[:, 2][~np.isnan(x[:, 2])])
    x[np.isnan(x[:, 2]), 2] = seen[(len(seen) - 1) // 2]  # the lower median
    y = np.array([row[4] for row in rows], float)
    return x, y, np.where(y == 1, (y == 0).sum() / y.sum(), 1.0)


def test_logit_equals_newtons_method(spark, panel):
    df = frame(spark, panel)
    out, _, status = M.fit_predict(M.Spec("l", "logit", "weights", {"maxIter": 500, "tol": 1e-12}), df, df, "y", ["a", "b", "c"], "id")
    got = {r.id: r.probability for r in out.collect()}
    x, y, w = matrix(panel)
    x = x / x.std(0, ddof=1)
    # the penalty is on coefficients of features with unit deviation under the weights, as Spark standardizes them again
    mean = (w[:, None] * x).sum(0) / w.sum()
    spread = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / (w.sum() - 1))
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    beta, ridge = np.zeros(4), np.diag([0.01, 0.01, 0.01, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        gradient = z.T @ (w * (p - y)) / w.sum() + ridge @ beta
        beta -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z / w.sum() + ridge, gradient)
    assert status == "fit" and np.abs(gradient).max() < 1e-10
    assert max(abs(got[row[0]] - q) for row, q in zip(panel, 1 / (1 + np.exp(-z @ beta)))) < 1e-3


def test_tree_of_one_level_equals_all_splits(spark, panel):
    df = frame(spark, panel)
    out, shares, _ = M.fit_predict(M.Spec("t", "tree", "weights", {"maxDepth": 1}), df, df, "y", ["a", "b", "c"], "id")
    x, y, w = matrix(panel)

    def entropy(some):
        p = (w * y)[some].sum() / w[some].sum()
        return 0.0 if p in (0.0, 1.0) else -p * np.log2(p) - (1 - p) * np.log2(1 - p)

    best = max((entropy(np.ones(len(y), bool)) - sum(w[s].sum() * entropy(s) for s in (x[:, f] <= v, x[:, f] > v)) / w.sum(), f, v) for f in range(3) for v in np.unique(x[:, f])[:-1])
    low = x[:, best[1]] <= best[2]
    want = np.where(low, (w * y)[low].sum() / w[low].sum(), (w * y)[~low].sum() / w[~low].sum())
    got = {r.id: r.probability for r in out.collect()}
    assert max(abs(got[row[0]] - q) for row, q in zip(panel, want)) < 1e-9
    assert dict(shares)["abc"[best[1]]] == pytest.approx(1.0) and sum(s for _, s in shares) == pytest.approx(1.0)


def test_seeds_are_spread_and_stable():
    seeds = {task_seed("model", k) for k in range(2000)}
    assert len(seeds) == 2000 and 0 < min(seeds) and max(seeds) < 2**31 - 1 and np.mean(list(seeds)) == pytest.approx(2**30, rel=0.05)


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(1, None), (2, 0.0), (3, 5e13), (4, float("nan")), (5, float("-inf")), (6, -5e13)], "id long, x double")
    got = {r.id: (r.f, r.s) for r in df.select("id", finite("x").alias("f"), sigmoid("x").alias("s")).collect()}
    assert [got[i][0] for i in range(1, 7)] == [None, 0.0, 1e12, None, None, -1e12] and got[1][1] is None and got[2][1] == 0.5
    few = spark.createDataFrame([(float(i),) for i in range(100)] + [(None,)], "x double")
    clipped = [r.x for r in M.clip_quantiles(few, few, ["x"])[0].collect()]
    assert clipped.count(None) == 1 and max(v for v in clipped if v is not None) <= 99
