"""Many small regressions at once, from moments.

The rows of every cell stay in Spark: cross products are map-side aggregates and score
lags are windows. Python sees one row of finished moments per cell, never the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewire.functions import tails
from tidewire.operators import series
from tidewire.session import durable


def cross_products(
    rows: DataFrame, cell: Sequence[str], left: str, right: str, width: int, out: str,
) -> DataFrame:
    """Row-major sums of ``left[i] * right[j]`` per cell.

    Rows unfold over ``i`` only; the ``j`` sums are plain aggregates, so each task keeps
    (cell, i) partial sums and the shuffle carries those alone.
    """
    unfolded = rows.select(*cell, F.col(right), F.posexplode(left).alias("i", "a"))
    sums = unfolded.groupBy(*cell, "i").agg(F.array(*[
        F.sum(F.col("a") * F.col(right)[j]) for j in range(width)]).alias("row"))
    lines = F.array_sort(F.collect_list(F.struct("i", "row")))
    return sums.groupBy(*cell).agg(F.flatten(F.transform(lines, lambda r: r["row"])).alias(out))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def solve_moments(gram: np.ndarray, ridge: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and inverse from ``[Z'Z | Z'y]``; columns that are all zero stay out."""
    k = gram.shape[0]
    g, zy = gram[:, :k], gram[:, k]
    on = np.flatnonzero(np.diag(g) > 0)
    inv = np.zeros((k, k))
    small = g[np.ix_(on, on)]
    scale = 1.0 / np.sqrt(np.diag(small))
    core = np.linalg.pinv(small * np.outer(scale, scale), rcond=1e-11, hermitian=True)
    inv[np.ix_(on, on)] = core * np.outer(scale, scale)
    return inv @ zy, inv


def _solver(width: int):
    @F.pandas_udf("struct<beta: array<double>, inv: array<double>, k: int>")
    def solve(grams: pd.Series) -> pd.DataFrame:
        out = []
        for g in grams:
            m = np.asarray(g, dtype=float).reshape(width, width + 1)
            beta, inv = solve_moments(m)
            out.append((beta.tolist(), inv.ravel().tolist(), int((np.diag(m) > 0).sum())))
        return pd.DataFrame(out, columns=["beta", "inv", "k"])
    return solve


def _tester(width: int, blocks: Sequence[Sequence[int]], doubled: bool):
    @F.pandas_udf("struct<se: array<double>, f: array<double>, q: array<int>>")
    def test(inv: pd.Series, meat: pd.Series, beta: pd.Series, scale: pd.Series) -> pd.DataFrame:
        out = []
        for a, m, b, s in zip(inv, meat, beta, scale):
            a = np.asarray(a, dtype=float).reshape(width, width)
            m = np.asarray(m, dtype=float).reshape(width, width)
            b = np.asarray(b, dtype=float)
            cov = a @ ((m + m.T) if doubled else m) @ a * s
            stats, sizes = [], []
            for idx in blocks:
                on = [i for i in idx if cov[i, i] > 0]
                sizes.append(len(on))
                if not on:
                    stats.append(None)
                    continue
                part = cov[np.ix_(on, on)]
                stats.append(float(b[on] @ np.linalg.pinv(part, hermitian=True) @ b[on] / len(on)))
            out.append((np.sqrt(np.maximum(np.diag(cov), 0)).tolist(), stats, sizes))
        return pd.DataFrame(out, columns=["se", "f", "q"])
    return test


def _moments(rows: DataFrame, cell: Sequence[str], width: int) -> DataFrame:
    gram = cross_products(rows.withColumn("zy", F.concat("z", F.array("y"))),
                          cell, "z", "zy", width + 1, "gram")
    totals = rows.groupBy(*cell).agg(
        F.count("*").alias("n"), (F.var_pop("y") * F.count("*")).alias("sst"))
    solved = gram.join(totals, list(cell)).withColumn("fit", _solver(width)("gram"))
    return solved.select(*cell, "n", "sst", "fit.*")


def _report(
    fits: DataFrame, cell: Sequence[str], names: Sequence[str], blocks: Sequence[str],
    test: Column, dof: Column | None,
) -> DataFrame:
    """One row per cell with term and block arrays."""
    tested = fits.withColumn("t", test)
    terms = F.array(*[F.struct(
        F.lit(n).alias("term"), F.col("beta")[i].alias("coef"), F.col("t.se")[i].alias("se"),
    ) for i, n in enumerate(names)])
    z = lambda t: F.when(t["se"] > 0, t["coef"] / t["se"])
    terms = F.transform(F.filter(terms, lambda t: t["se"] > 0), lambda t: F.struct(
        t["term"].alias("term"), t["coef"].alias("coef"), t["se"].alias("se"),
        z(t).alias("z"), tails.normal_two_sided(z(t)).alias("p")))
    joint = F.array(*[F.struct(
        F.lit(n).alias("block"), F.col("t.f")[i].alias("f"), F.col("t.q")[i].alias("q"),
        tails.f_sf(F.col("t.f")[i], F.col("t.q")[i].cast("double"),
                   dof.cast("double")).alias("p"),
    ) for i, n in enumerate(blocks)]) if blocks else F.array().cast(
        "array<struct<block: string, f: double, q: int, p: double>>")
    return tested.select(
        *cell, "n", "k", F.when(F.col("sst") > 0, 1.0 - F.col("ssr") / F.col("sst")).alias("r2"),
        terms.alias("terms"), joint.alias("tests"))


def ols_hac(
    design: DataFrame, cell: Sequence[str], y: str, features: Sequence[str],
    blocks: Mapping[str, Sequence[str]] | None = None, maxlags: int = 5,
    lag_column: str | None = None, date: str = "date",
) -> DataFrame:
    """OLS with a constant and a Newey-West covariance per cell.

    Bartlett weights ``1 - k/(L+1)``, no small-sample factor, normal p-values; a block
    test is F(q, n - k). ``lag_column`` gives cells their own truncation, at most
    ``maxlags``. ``design`` holds complete cases; a feature that is 0 throughout a cell
    is not part of it. Returns one row per cell; see :func:`terms` and :func:`tests`.

    Weighted lagged scores are added into one vector first, so the whole covariance is a
    single cross product instead of one per lag.
    """
    blocks = blocks or {}
    names = ["const", *features]
    width = len(names)
    z = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features])
    truncation = F.col(lag_column) if lag_column else F.lit(maxlags)
    rows = durable(design.select(
        *cell, F.col(date).alias("date"), F.col(y).cast("double").alias("y"), z.alias("z"),
        truncation.cast("double").alias("cut")))
    fits = _moments(rows, cell, width)
    resid = rows.join(fits.select(*cell, "beta"), list(cell)).withColumn(
        "u", F.col("y") - _dot(F.col("z"), F.col("beta")))
    scored = resid.select(*cell, "date", "u", "cut",
                          F.transform("z", lambda a: a * F.col("u")).alias("s"))
    w = series.by(cell)
    lagged = scored.withColumns({f"s{k}": F.lag("s", k).over(w) for k in range(1, maxlags + 1)})

    def smoothed(i: Column) -> Column:
        out = F.col("s")[i] / 2.0
        for k in range(1, maxlags + 1):
            weight = F.greatest(F.lit(0.0), 1.0 - k / (F.col("cut") + 1.0))
            out = out + weight * F.coalesce(F.col(f"s{k}")[i], F.lit(0.0))
        return out
    mixed = lagged.select(*cell, "u", "s", F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), smoothed).alias("v"))
    meat = cross_products(mixed, cell, "s", "v", width, "meat")
    ssr = mixed.groupBy(*cell).agg(F.sum(F.col("u") * F.col("u")).alias("ssr"))
    full = fits.join(meat, list(cell)).join(ssr, list(cell))
    index = [[names.index(f) for f in fs] for fs in blocks.values()]
    test = _tester(width, index, doubled=True)("inv", "meat", "beta", F.lit(1.0))
    return _report(full, cell, names, list(blocks), test, F.col("n") - F.col("k"))


def ols_clustered(
    design: DataFrame, cell: Sequence[str], y: str, features: Sequence[str], cluster: str,
) -> DataFrame:
    """OLS with a constant and cluster-robust covariance, scaled by
    ``G/(G-1) * (n-1)/(n-k)``, normal p-values."""
    names = ["const", *features]
    width = len(names)
    z = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features])
    rows = durable(design.select(
        *cell, F.col(cluster).alias("g"), F.col(y).cast("double").alias("y"), z.alias("z")))
    fits = _moments(rows, cell, width)
    resid = rows.join(fits.select(*cell, "beta"), list(cell)).withColumn(
        "u", F.col("y") - _dot(F.col("z"), F.col("beta")))
    by_group = resid.groupBy(*cell, "g").agg(
        F.array(*[F.sum(F.col("z")[i] * F.col("u")) for i in range(width)]).alias("s"),
        F.sum(F.col("u") * F.col("u")).alias("uu"))
    meat = cross_products(by_group, cell, "s", "s", width, "meat")
    sizes = by_group.groupBy(*cell).agg(
        F.count("*").cast("double").alias("groups"), F.sum("uu").alias("ssr"))
    full = fits.join(meat, list(cell)).join(sizes, list(cell))
    factor = (F.col("groups") / (F.col("groups") - 1.0)
              * (F.col("n") - 1.0) / (F.col("n") - F.col("k")))
    test = _tester(width, [], doubled=False)("inv", "meat", "beta", factor)
    return _report(full, cell, names, [], test, None)


def terms(fits: DataFrame, cell: Sequence[str]) -> DataFrame:
    return fits.select(*cell, "n", "k", "r2", F.inline("terms"))


def tests(fits: DataFrame, cell: Sequence[str]) -> DataFrame:
    return fits.select(*cell, "n", "k", "r2", F.inline("tests"))


def block_p(fits: DataFrame, cell: Sequence[str], blocks: Sequence[str]) -> DataFrame:
    """One ``p_<block>`` column per block test."""
    def p(name: str) -> Column:
        return F.try_element_at(F.filter("tests", lambda t: t["block"] == name), F.lit(1))["p"]
    return fits.select(*cell, "n", "k", "r2", *[p(b).alias(f"p_{b}") for b in blocks])


# --- expanding ridge -------------------------------------------------------------

def prefix_moments(
    frame: DataFrame, cell: Sequence[str], y: str, features: Sequence[str], step: str,
) -> DataFrame:
    """Training moments at every cut-off.

    Rows carry ``step``, the first cut-off that may train on them. Each step's cross
    products are one aggregate; a running sum over steps then gives every expanding
    training set, so no row is visited once per cut-off.
    """
    width = len(features) + 2
    z = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features],
                F.col(y).cast("double"))
    rows = frame.select(*cell, F.col(step).alias("step"), z.alias("z"))
    unfolded = rows.select(*cell, "step", "z", F.posexplode("z").alias("i", "a"))
    sums = unfolded.groupBy(*cell, "step", "i").agg(F.array(*[
        F.sum(F.col("a") * F.col("z")[j]) for j in range(width)]).alias("row"))
    entries = sums.select(*cell, "step", "i", F.posexplode("row").alias("j", "m"))
    w = series.by([*cell, "i", "j"], "step").rowsBetween(
        series.Window.unboundedPreceding, 0)
    running = entries.withColumn("m", F.sum("m").over(w))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "m"))), lambda t: t["m"])
    return running.groupBy(*cell, "step").agg(cells.alias("moments"))


def ridge_from_moments(moments: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and slopes of a standardised ridge from ``[1 x y]`` cross products.

    Standardising divides by the population deviation of the training rows; folding that
    back gives coefficients on the raw features. A feature without variance gets 0.
    """
    n = moments[0, 0]
    k = moments.shape[0] - 2
    mean = moments[0, 1:] / n
    cov = moments[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
    on = np.flatnonzero(sd > 1e-9 * np.maximum(np.abs(mean[:k]), 1e-300))
    slope = np.zeros(k)
    if len(on):
        scale = np.outer(sd[on], sd[on])
        gram = cov[np.ix_(on, on)] / scale * n + alpha * np.eye(len(on))
        target = cov[on, k] / sd[on] * n
        slope[on] = np.linalg.solve(gram, target) / sd[on]
    return np.concatenate([[mean[k] - slope @ mean[:k]], slope])


