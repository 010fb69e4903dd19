"""Regressions, tests and resampling against numpy or planted answers."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.functions import tails
from tidewire.operators import audit, forecasting, grids, moments, neardup, testing

D0 = dt.date(2020, 1, 1)


def rows_of(spark, data, names, cell="c"):
    n = len(next(iter(data.values())))
    rows = [("c", D0 + dt.timedelta(days=i), *[float(data[k][i]) for k in names]) for i in range(n)]
    return spark.createDataFrame(rows, f"{cell} string, date date, " + ", ".join(f"{k} double" for k in names))


def test_tails(spark):
    zs = [-3.0, -0.5, 0.0, 1.96, 5.0, 8.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r[0] for r in df.select(tails.normal_sf(F.col("z"))).collect()]
    for z, p in zip(zs, got):
        assert math.isclose(p, 0.5 * math.erfc(z / math.sqrt(2)), rel_tol=1e-9, abs_tol=1e-15)
    assert math.isclose(tails.t_tail(2.228, 10), 0.05, abs_tol=2e-5)
    assert math.isclose(tails.f_tail(4.10, 2, 10), 0.05, abs_tol=1e-4)
    assert math.isclose(tails.f_tail(1.0, 5, 5), 0.5, abs_tol=1e-9)


def test_hac_matches_numpy(spark):
    rng = np.random.default_rng(0)
    n, lags = 300, 5
    d = {k: rng.normal(size=n) for k in ("a", "b", "e")}
    d["y"] = 0.8 * d["a"] + np.convolve(d["e"], [1, 0.5], "same")
    d["off"] = np.zeros(n)
    df = rows_of(spark, d, ["y", "a", "b", "off"])
    fit = moments.ols_hac(df, ["c"], "y", ["a", "b", "off"], {"both": ["a", "b"]}, lags)
    z = np.column_stack([np.ones(n), d["a"], d["b"]])
    beta = np.linalg.lstsq(z, d["y"], rcond=None)[0]
    s = z * (d["y"] - z @ beta)[:, None]
    meat = s.T @ s
    for k in range(1, lags + 1):
        g = s[k:].T @ s[:-k]
        meat += (1 - k / (lags + 1)) * (g + g.T)
    inv = np.linalg.inv(z.T @ z)
    cov = inv @ meat @ inv
    got = {r["term"]: r for r in moments.terms(fit, ["c"]).collect()}
    assert set(got) == {"const", "a", "b"}
    for i, name in enumerate(["const", "a", "b"]):
        assert math.isclose(got[name]["coef"], beta[i], rel_tol=1e-8, abs_tol=1e-10)
        assert math.isclose(got[name]["se"], math.sqrt(cov[i, i]), rel_tol=1e-8)
    wald = beta[1:] @ np.linalg.solve(cov[1:, 1:], beta[1:]) / 2
    joint = moments.tests(fit, ["c"]).collect()[0]
    assert math.isclose(joint["f"], wald, rel_tol=1e-8) and joint["q"] == 2 and joint["p"] < 1e-6


def test_clustered_matches_numpy(spark):
    rng = np.random.default_rng(3)
    g = np.repeat(np.arange(40), 5)
    x = rng.normal(size=200)
    y = 0.3 * x + rng.normal(size=40)[g] + rng.normal(size=200)
    rows = [("c", int(g[i]), float(y[i]), float(x[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "c string, g int, y double, x double")
    fit = moments.terms(moments.ols_clustered(df, ["c"], "y", ["x"], "g"), ["c"])
    z = np.column_stack([np.ones(200), x])
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    s = z * (y - z @ beta)[:, None]
    sums = np.array([s[g == k].sum(0) for k in range(40)])
    inv = np.linalg.inv(z.T @ z)
    cov = inv @ sums.T @ sums @ inv * (40 / 39) * (199 / 198)
    got = {r["term"]: r for r in fit.collect()}
    assert math.isclose(got["x"]["se"], math.sqrt(cov[1, 1]), rel_tol=1e-8)


def test_ridge_matches_refit(spark):
    rng = np.random.default_rng(4)
    n = 260
    d = {"a": rng.normal(size=n), "b": rng.normal(size=n) + 3}
    d["y"] = d["a"] - d["b"] + rng.normal(size=n)
    frame = rows_of(spark, d, ["y", "a", "b"])
    plan = forecasting.walk_forward(frame, ["c"], 1, refit=7)
    sets = {"A": ["a"], "AB": ["a", "b"]}
    got = {(r["pos"], r["info_set"]): r["forecast"] for r in forecasting.ridge_sets(plan, ["c"], "y", sets).collect()}
    start = int(n * 0.75)
    for pos in (start, start + 6, start + 7, n - 1):
        cut = start + (pos - start) // 7 * 7
        for name, cols in sets.items():
            x = np.column_stack([d[k] for k in cols])
            tr = x[:cut]
            mu, sd = tr.mean(0), tr.std(0)
            s = (tr - mu) / sd
            ym = d["y"][:cut].mean()
            b = np.linalg.solve(s.T @ s + 10 * np.eye(len(cols)), s.T @ (d["y"][:cut] - ym))
            assert math.isclose(got[pos, name], ym + (x[pos] - mu) / sd @ b, rel_tol=1e-7)


def test_purged_cutoffs_do_not_leak(spark):
    frame = rows_of(spark, {"y": np.arange(200.0)}, ["y"])
    for h in (1, 5):
        plan = forecasting.walk_forward(frame, ["c"], h, refit=10)
        leak = forecasting.leakage(forecasting.cutoffs(plan, ["c"], h), ["c"]).collect()[0]
        assert leak["n_leaking"] == 0 and leak["n_cutoffs"] == 5
        first = plan.filter("train_step <= test_start").agg(F.max("pos")).first()[0]
        assert first == 150 - h


def test_accuracy_tests_signs(spark):
    rng = np.random.default_rng(5)
    n = 400
    signal = rng.normal(size=n)
    d = {"y": signal + rng.normal(size=n), "good": 0.9 * signal, "zero": np.zeros(n), "noise": rng.normal(size=n)}
    df = rows_of(spark, d, list(d))
    fit = testing.oos_fit(df, ["c"], "y", "good", "zero").first()
    assert fit["r2_oos"] > 0.2 and testing.oos_fit(df, ["c"], "y", "noise", "zero").first()["r2_oos"] < 0
    assert testing.clark_west(df, ["c"], "y", "zero", "good").first()["cw_p"] < 0.001
    assert testing.diebold_mariano(df, ["c"], "y", "zero", "good").first()["dm_stat"] > 2
    same = testing.diebold_mariano(df, ["c"], "y", "good", "good").first()
    assert same["dm_stat"] is None
    with pytest.raises(ValueError):
        testing.oos_fit(df, ["c"], "zero", "good", "zero", strict=True)


def test_bh(spark):
    df = spark.createDataFrame([(p,) for p in (0.01, 0.04, 0.03, None, 0.5)], "p double")
    got = {r["p"]: r["p_bh"] for r in testing.benjamini_hochberg(df, "p").collect()}
    assert got[None] is None and math.isclose(got[0.01], 0.04)
    assert math.isclose(got[0.03], 0.04 * 4 / 3) and math.isclose(got[0.5], 0.5)


def test_break_found_and_quiet_twin(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(0, 0.3, 600)
    moved = base + (np.arange(600) >= 200)
    rows = [(s, D0 + dt.timedelta(days=i), float(v[i])) for s, v in (("quiet", base), ("moved", moved)) for i in range(600)]
    df = spark.createDataFrame(rows, "series string, date date, value double")
    got = {r["series"]: r for r in testing.bootstrap_break(df, ["series"], "value", n_boot=60).collect()}
    assert abs((got["moved"]["break_at"] - D0).days - 200) <= 30 and got["moved"]["p_boot"] == 0
    assert got["quiet"]["p_boot"] > 0.05


def test_confidence_set_drops_the_bad_model(spark):
    rng = np.random.default_rng(7)
    rows = [(i, m, float(v)) for m, mu in (("good", 1), ("also", 1), ("bad", 5))
            for i, v in enumerate(rng.normal(mu, 0.2, 200))]
    df = spark.createDataFrame(rows, "period int, model string, loss double")
    got = {r["model"]: r["in_confidence_set"] for r in testing.confidence_set(df, n_boot=100).collect()}
    assert got["bad"] is False and got["good"] is True


def test_candidate_rules(spark):
    rng = np.random.default_rng(8)
    ref = rng.normal(0.1, 1.4, 600)
    cands = {"near": ref + rng.normal(0, 0.1, 600), "unrelated": rng.normal(0.1, 1.4, 600), "steep": 1.6 * ref}
    rows = [(k, D0 + dt.timedelta(days=i), float(v[i]), float(ref[i])) for k, v in cands.items() for i in range(600)]
    df = spark.createDataFrame(rows, "pair string, date date, cand double, ref double")
    got = {r["pair"]: r for r in testing.validate_candidates(df).collect()}
    assert got["near"]["passed"] and "beta" in got["steep"]["failures"] and not got["unrelated"]["passed"]


def test_permutation_moves_columns_together(spark):
    df = rows_of(spark, {"a": np.arange(50.0), "b": np.arange(50.0) * 2, "k": np.arange(50.0)}, ["a", "b", "k"])
    got = forecasting.permuted(df, ["c"], ["a", "b"], 1).collect()
    assert all(r["b"] == 2 * r["a"] for r in got) and sorted(r["a"] for r in got) == list(range(50))
    assert any(r["a"] != r["k"] for r in got)


def test_binomial_tail(spark):
    df = spark.createDataFrame([(9, 12), (0, 3)], "h int, n int")
    got = [r[0] for r in df.select(testing.binomial_tail(F.col("h"), F.col("n"))).collect()]
    assert math.isclose(got[0], 299 / 4096) and math.isclose(got[1], 1.0)


def test_claims_country_order(spark):
    rows = [("Q1", "P17", 0, "Q2305208"), ("Q1", "P17", 1, "Q15180"), ("Q1", "P495", 0, "Q159"),
            ("Q2", "P17", 0, "Q15180"), ("Q3", "P17", 0, "Q424242")]
    df = spark.createDataFrame(rows, "item string, property string, position int, value string")
    got = {r["item"]: r["country"] for r in audit.item_country(df).collect()}
    assert got == {"Q1": "RU", "Q2": "RU"}


def test_audit_precision_of_nothing_is_null(spark):
    reg = spark.createDataFrame([("a.com", "WEST"), ("b.com", "UA")], "domain string, ecosystem string")
    ref = spark.createDataFrame([("a.com", "Q1", "", "A")], "domain string, qid string, country string, label string")
    got = audit.precision_by_label(audit.audit_register(reg, ref)).collect()
    assert all(r["precision"] is None and r["verified"] == 0 for r in got)


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(9)
    words = ["alpha", "bravo", "delta", "echo", "golf", "hotel", "india", "kilo", "lima", "mike"]
    texts = []
    for i in range(12):
        base = " ".join(rng.choice(words, 60))
        texts += [base, base, base + " extra words here"]
    texts += ["tiny"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["key"]: (r["duplicate_of"], r["jaccard"]) for r in neardup.near_duplicates(df, "id", "t").collect()}
    sets = [{t[i:i + 5] for i in range(len(t) - 4)} for t in texts]
    for k, t in enumerate(texts[:-1]):
        best = max((len(sets[k] & sets[j]) / len(sets[k] | sets[j]) for j in range(k)), default=0)
        assert (k in got) == (best >= 0.7)
        if k in got:
            j, sim = got[k]
            assert math.isclose(sim, len(sets[k] & sets[j]) / len(sets[k] | sets[j]), rel_tol=1e-12)


def test_grid_windows_are_inclusive(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, d),) for d in (1, 2, 3)], "date date")
    got = grids.in_windows(df, {"w": ("2020-01-01", "2020-01-02"), "all": None})
    assert got.filter("window = 'w'").count() == 2 and got.filter("window = 'all'").count() == 3
