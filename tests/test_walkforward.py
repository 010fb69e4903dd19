"""Expanding medians, imputed ridge and boosted trees against plain refits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import forecasting, walkforward


@pytest.mark.parametrize("block", [1, 4, 32, 1000])
def test_expanding_medians_are_exact(spark, block):
    rng = np.random.default_rng(5)
    rows = [(c, int(s), None if rng.random() < 0.1 else float(rng.integers(0, 30)))
            for c in "ab" for s in rng.integers(0, 60, 180)]
    values = spark.createDataFrame(rows, "cell string, step int, value double")
    asked = spark.createDataFrame([(c, s) for c in "ab" for s in (0, 1, 17, 33, 59, 80)], "cell string, step int")
    got = {(r.cell, r.step): r.median for r in walkforward.expanding_medians(values, asked, ["cell"], block).collect()}
    for c in "ab":
        for s in (0, 1, 17, 33, 59, 80):
            seen = [v for k, t, v in rows if k == c and t <= s and v is not None]
            assert got.get((c, s)) == (np.median(seen) if seen else None)


def holed(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) + [0, 3, -1]
    x[rng.random((n, 3)) < 0.15] = np.nan
    x[:40, 2] = np.nan
    y = np.nan_to_num(x[:, 0]) - 0.5 * np.nan_to_num(x[:, 1]) + rng.normal(size=n)
    return x, y


@pytest.mark.parametrize("span", [5, 64])
def test_imputed_ridge_equals_a_refit_with_training_medians(spark, span):
    n, refit = 260, 7
    data = {c: holed(n, seed) for seed, c in enumerate("pq")}
    rows = [(c, i, float(y[i]), *(None if math.isnan(v) else float(v) for v in x[i])) for c, (x, y) in data.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "c string, d int, y double, a double, b double, e double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")))
    plan = forecasting.walk_forward(frame, ["c"], 1, refit=refit)
    sets = {"A": ["a"], "ABE": ["a", "b", "e"]}
    out = walkforward.expanding_ridge(plan, ["c"], "y", sets, alpha=1.0, impute=True, span=span).collect()
    assert len(out) == 2 * 2 * (n - int(n * 0.75))
    got = {(r.c, r.pos, r.info_set): r.forecast for r in out}
    start = int(n * 0.75)
    for c, (x, y) in data.items():
        for pos in (start, start + 8, n - 1):
            cut = start + (pos - start) // refit * refit
            for name, cols in (("A", [0]), ("ABE", [0, 1, 2])):
                med = np.nanmedian(x[:cut], 0)
                tr, te = (np.where(np.isnan(v), med, v)[..., cols] for v in (x[:cut], x[pos]))
                mu, sd = tr.mean(0), tr.std(0)
                s = (tr - mu) / sd
                b = np.linalg.solve(s.T @ s + np.eye(len(cols)), s.T @ (y[:cut] - y[:cut].mean()))
                assert math.isclose(got[c, pos, name], y[:cut].mean() + (te - mu) / sd @ b, rel_tol=1e-6)


def test_boosted_trees_find_planted_steps(spark):
    rng = np.random.default_rng(7)
    n = 400
    x = rng.normal(size=(n, 3))
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) + np.where((x[:, 1] > 0) & (x[:, 0] > 0.3), 1.5, 0.0) + 0.1 * rng.normal(size=n)
    rows = [(c, i, float(y[i]), *map(float, x[i])) for c in ("p", "q") for i in range(n)]
    frame = spark.createDataFrame(rows, "c string, d int, y double, a double, b double, e double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")))
    plan = forecasting.walk_forward(frame, ["c"], 1, refit=21)
    sets = {"E": ["e"], "AB": ["a", "b"], "ABE": ["a", "b", "e"]}
    rows = walkforward.boosted_sets(plan, ["c"], "y", sets).collect()
    assert len(rows) == 2 * 3 * 100
    r2 = {}
    for name in sets:
        mine = [r for r in rows if r.info_set == name]
        truth = np.array([r.y for r in mine])
        r2[name] = 1 - ((truth - [r.forecast for r in mine]) ** 2).sum() / ((truth - truth.mean()) ** 2).sum()
    assert r2["AB"] > 0.95 and r2["ABE"] > 0.95 and r2["E"] < 0.1
    p, q = ({(r.pos, r.info_set): r.forecast for r in rows if r.c == c} for c in "pq")
    assert p == q  # the same data and draws give the same trees


def test_boosting_keeps_a_constant_and_one_split():
    x = np.array([[0.0], [0.0], [1.0], [1.0]] * 25)
    flat = walkforward.boosted(x, np.full(100, 3.0), x[:4], n_trees=5)
    assert np.allclose(flat, 3.0)
    step = walkforward.boosted(x, np.array([0.0, 0.0, 1.0, 1.0] * 25), x[:4], n_trees=400, rate=0.1, rows=1.0, columns=1.0)
    assert np.allclose(step, [0, 0, 1, 1], atol=0.02)


def test_decayed_sums_equal_the_recursion(spark):
    rng = np.random.default_rng(8)
    data = {(k, d): rng.normal(size=n) for k, n in (("p", 300), ("q", 64), ("r", 1)) for d in (0.6, 0.9)}
    rows = [(k, d, i, float(v)) for (k, d), x in data.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "key string, d double, pos int, c double")
    got = {(r.key, r.d, r.pos): r.h for r in forecasting.decayed_sums(df, ["key", "d"], "pos", "c", F.col("d"), "h").collect()}
    for (k, d), x in data.items():
        h = None
        for i, v in enumerate(x):
            h = v if h is None else v + d * h
            assert math.isclose(got[k, d, i], h, rel_tol=1e-6, abs_tol=1e-8)
    assert len(got) == len(rows)


def test_variance_recursion_equals_a_loop(spark):
    rng = np.random.default_rng(9)
    ret = rng.normal(size=400)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(ret)], "key string, d int, ret double").withColumn(
        "date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")))
    a, g, b = 0.05, 0.04, 0.85
    got = {r.date: r.forecast for r in forecasting.variance_benchmark(df.select("key", "date", "ret"), "key", [(a, g, b)]).collect()}
    start, h = df.agg(F.min("date")).first()[0], None
    for i in range(1, 400):
        level = (ret[:i] ** 2).mean()
        h = level if h is None else (1 - a - g / 2 - b) * level + (a + (g if ret[i - 1] < 0 else 0)) * ret[i - 1] ** 2 + b * h
        day = start + __import__("datetime").timedelta(days=i)
        if i >= 300:
            assert math.isclose(got[day], h, rel_tol=1e-8)
