"""Accuracy tests, resampling, multiple testing, breaks and decision rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidewire import fixed_values as fixed
from tidewire.functions import columns as c, draws, tails
from tidewire.operators import series


# --- multiple testing ----------------------------------------------------------

def benjamini_hochberg(
    grid: DataFrame, p: str, family: Sequence[str] = (), alpha: float = 0.05,
) -> DataFrame:
    """Adjusted p and decision within each family; unknown p stay out of the count.

    A family is a grid of specifications, never data rows.
    """
    keys = list(family) or [F.lit("grid")]
    known = F.col(p).isNotNull()
    group = Window.partitionBy(*keys, known)
    m = F.count(p).over(group)
    rank = F.row_number().over(group.orderBy(F.col(p)))
    ranked = grid.withColumns({"_m": m, "_rank": rank})
    down = Window.partitionBy(*keys, known).orderBy(F.desc("_rank"))
    adjusted = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down))
    out = ranked.withColumn(f"{p}_bh", F.when(known, adjusted))
    return out.withColumn(
        "survives_bh", F.coalesce(F.col(f"{p}_bh") <= alpha, F.lit(False))
    ).drop("_m", "_rank")


def romano_wolf(
    statistics: DataFrame, draw_rows: DataFrame, alpha: float = 0.05,
) -> DataFrame:
    """Step-down familywise control.

    ``statistics`` is (test, statistic); ``draw_rows`` is (draw, test, value) under the
    null. Tests are ordered from the strongest. A running maximum from the weakest test up
    gives, for every draw, the largest value among the tests still standing at each step,
    so all steps come from one pass over the draws.
    """
    order = Window.partitionBy(F.lit("tests")).orderBy(F.abs("statistic").desc(), F.asc("test"))
    ranked = statistics.withColumn("step", F.row_number().over(order))
    joined = draw_rows.join(ranked, "test")
    w = Window.partitionBy("draw").orderBy(F.desc("step"))
    standing = joined.withColumn("top", F.max(F.abs("value")).over(w))
    steps = standing.groupBy("test", "statistic", "step").agg(
        F.percentile("top", 1.0 - alpha).alias("critical_value"),
        F.avg((F.col("top") >= F.abs("statistic")).cast("double")).alias("p_rw"))
    up = Window.partitionBy(F.lit("tests")).orderBy("step")
    passed = F.abs("statistic") > F.col("critical_value")
    flagged = steps.withColumn("all_passed", F.min(passed.cast("int")).over(up) == 1)
    first_fail = F.min(F.when(~F.col("all_passed"), F.col("step"))).over(
        Window.partitionBy(F.lit("tests")))
    at_fail = F.first(F.when(~F.col("all_passed"), F.col("critical_value")), True).over(
        Window.partitionBy(F.lit("tests")).orderBy("step").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))
    return flagged.withColumns({"fail": first_fail, "fail_value": at_fail}).select(
        "test", "statistic", "step",
        F.when(F.col("step") > F.col("fail"), F.col("fail_value")).otherwise(
            F.col("critical_value")).alias("critical_value"),
        F.when(F.col("step") <= F.coalesce("fail", "step"), F.col("p_rw")).alias("p_rw"),
        F.col("all_passed").alias("reject"))


# --- equal accuracy ----------------------------------------------------------------

def _differential_stats(
    rows: DataFrame, cell: Sequence[str], horizon: int | str, most: int,
) -> DataFrame:
    """Mean of ``d`` and its Bartlett long-run variance with h-1 lags, per cell."""
    h = F.lit(horizon) if isinstance(horizon, int) else F.col(horizon)
    known = rows.filter(F.col("d").isNotNull())
    p, w = series.whole(cell), series.by(cell)
    centred = known.withColumn("e", F.col("d") - F.avg("d").over(p)).withColumn("h", h)
    lagged = centred.withColumns({f"e{k}": F.lag("e", k).over(w) for k in range(1, most)})
    n = F.count("*")
    out = lagged.groupBy(*cell).agg(
        n.alias("n"), F.avg("d").alias("mean_d"), F.max("h").alias("h"),
        (F.sum(F.col("e") * F.col("e")) / n).alias("g0"),
        *[(F.coalesce(F.sum(F.col("e") * F.col(f"e{k}")), F.lit(0.0)) / n).alias(f"g{k}")
          for k in range(1, most)])
    var = F.col("g0")
    for k in range(1, most):
        weight = F.greatest(F.lit(0.0), 1.0 - k / F.col("h"))
        var = var + 2.0 * weight * F.when(F.col("h") > k, F.col(f"g{k}")).otherwise(0.0)
    return out.select(*cell, "n", "mean_d", "h", var.alias("lrv"))


def loss(kind: str, actual: Column, forecast: Column) -> Column:
    if kind == "squared":
        return (actual - forecast) * (actual - forecast)
    if kind == "absolute":
        return F.abs(actual - forecast)
    if kind == "qlike":
        return c.qlike(actual, forecast)
    raise ValueError(f"unknown loss: {kind!r}")


def diebold_mariano(
    rows: DataFrame, cell: Sequence[str], actual: str, a: str, b: str, kind: str = "squared",
    horizon: int | str = 1, max_horizon: int = 1, small_sample: bool = True,
) -> DataFrame:
    """Equal accuracy of two non-nested forecasts; positive means ``a`` loses more.

    A cell without positive long-run variance has no statistic: it comes back NULL.
    """
    d = loss(kind, F.col(actual), F.col(a)) - loss(kind, F.col(actual), F.col(b))
    most = horizon if isinstance(horizon, int) else max_horizon
    s = _differential_stats(rows.withColumn("d", d), cell, horizon, most)
    n, h = F.col("n"), F.col("h")
    stat = F.when(F.col("lrv") > 0, F.col("mean_d") / F.sqrt(F.col("lrv") / n))
    if small_sample:
        stat = stat * F.sqrt((n + 1.0 - 2.0 * h + h * (h - 1.0) / n) / n)
    return s.select(*cell, "n", "mean_d", stat.alias("dm_stat"))


def clark_west(
    rows: DataFrame, cell: Sequence[str], actual: str, benchmark: str, model: str,
    horizon: int | str = 1, max_horizon: int = 1,
) -> DataFrame:
    """Nested-model test: one-sided, positive favours the larger model."""
    a, b, m = F.col(actual), F.col(benchmark), F.col(model)
    d = (a - b) * (a - b) - ((a - m) * (a - m) - (b - m) * (b - m))
    most = horizon if isinstance(horizon, int) else max_horizon
    s = _differential_stats(rows.withColumn("d", d), cell, horizon, most)
    stat = F.when(F.col("lrv") > 0, F.col("mean_d") / F.sqrt(F.col("lrv") / F.col("n")))
    out = s.select(*cell, "n", stat.alias("cw_stat"))
    return out.withColumn("cw_p", tails.normal_sf(F.col("cw_stat")))


def oos_fit(
    rows: DataFrame, cell: Sequence[str], actual: str, forecast: str, benchmark: str,
    strict: bool = False,
) -> DataFrame:
    """Out-of-sample R2 and MSE ratio; NULL for a benchmark without error, or an error if
    ``strict``."""
    known = rows.dropna(subset=[actual, forecast, benchmark])
    a = F.col(actual)
    out = known.groupBy(*cell).agg(
        F.count("*").alias("n"),
        F.sum((a - F.col(forecast)) * (a - F.col(forecast))).alias("sse"),
        F.sum((a - F.col(benchmark)) * (a - F.col(benchmark))).alias("sse_bench"))
    if strict and out.filter(F.col("sse_bench") == 0).limit(1).collect():
        raise ValueError("benchmark has zero forecast error; the fit is undefined")
    ratio = F.when(F.col("sse_bench") > 0, F.col("sse") / F.col("sse_bench"))
    return out.select(*cell, "n", ratio.alias("mse_ratio"), (1.0 - ratio).alias("r2_oos"))


def loss_table(
    rows: DataFrame, cell: Sequence[str], actual: str, forecast: str, benchmark: str,
    least: int = 50,
) -> DataFrame:
    """MAE, RMSE, bias, QLIKE, directional accuracy and gain over a benchmark."""
    known = rows.dropna(subset=[actual, forecast, benchmark])
    a, f, b = F.col(actual), F.col(forecast), F.col(benchmark)
    hit = (F.signum(a) == F.signum(f)).cast("double")
    out = known.groupBy(*cell).agg(
        F.count("*").alias("n_test"), F.avg(F.abs(a - f)).alias("mae"),
        F.avg(F.abs(a - b)).alias("mae_bench"), F.sqrt(F.avg((a - f) * (a - f))).alias("rmse"),
        F.avg(f - a).alias("bias"), F.avg(hit).alias("dir_acc"))
    gain = F.when(F.col("mae_bench") > 0,
                  100.0 * (F.col("mae_bench") - F.col("mae")) / F.col("mae_bench"))
    return out.filter(F.col("n_test") >= least).withColumn("mae_gain_pct", gain)


def detectable_effect(counts: DataFrame, n: str = "n") -> DataFrame:
    """Smallest standardised effect seen with 80 % power at 5 %, one- and two-sided."""
    # Normal quantiles at 0.95, 0.975 and 0.80.
    one, two, power = 1.6448536269514722, 1.959963984540054, 0.8416212335729143
    root = F.sqrt(F.col(n).cast("double"))
    return counts.filter(F.col(n) >= 2).withColumns({
        "effect_one_sided": (one + power) / root, "effect_two_sided": (two + power) / root})


def economic_value(
    rows: DataFrame, cell: Sequence[str], actual: str, forecast: str, benchmark: str,
    gamma: float = 3.0, window: int = 60, cap: float = 1.5, cost_bps: Sequence[float] = (0.0, 10.0),
    compat: bool = False,
) -> DataFrame:
    """Certainty equivalents and Sharpe ratios of a capped mean-variance timer.

    The variance behind a weight uses the rows before it; ``compat`` includes the current
    row. The first turnover is the absolute first weight.
    """
    w = series.by(cell)
    known = rows.dropna(subset=[actual, forecast, benchmark])
    f = series.rolling(w, window, 0 if compat else -1)
    var = F.when(F.count(actual).over(f) >= 20, F.var_samp(actual).over(f))
    usable = known.withColumn("var", var).filter(F.col("var") > 0)
    weighted = usable.withColumns({
        f"w_{k}": c.clip(F.col(x) / (gamma * F.col("var")), -cap, cap)
        for k, x in (("m", forecast), ("b", benchmark))})
    turned = weighted.withColumns({
        f"t_{k}": F.abs(F.col(f"w_{k}") - F.coalesce(F.lag(f"w_{k}").over(w), F.lit(0.0)))
        for k in "mb"})
    costed = turned.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(x)) for x in cost_bps])))
    earned = costed.withColumns({
        f"r_{k}": F.col(f"w_{k}") * F.col(actual) - F.col(f"t_{k}") * F.col("cost_bps") / 100.0
        for k in "mb"})
    aggs = [F.count("*").alias("n")]
    for k in "mb":
        aggs += [(F.avg(f"r_{k}") * 252.0).alias(f"mu_{k}"),
                 (F.stddev_pop(f"r_{k}") * F.sqrt(F.lit(252.0))).alias(f"sd_{k}")]
    out = earned.groupBy(*cell, "cost_bps").agg(*aggs).filter(F.col("n") >= 60)
    cer = {k: F.col(f"mu_{k}") - 0.5 * gamma * F.col(f"sd_{k}") * F.col(f"sd_{k}") / 100.0
           for k in "mb"}
    sharpe = {k: F.when(F.col(f"sd_{k}") > 0, F.col(f"mu_{k}") / F.col(f"sd_{k}")) for k in "mb"}
    return out.select(
        *cell, "cost_bps", "n", cer["m"].alias("cer_model_pct"),
        cer["b"].alias("cer_benchmark_pct"), (cer["m"] - cer["b"]).alias("cer_gain_pct"),
        sharpe["m"].alias("sharpe_model"), sharpe["b"].alias("sharpe_benchmark"))


# --- structural breaks ------------------------------------------------------------------

def _ssr(sxx: Column, syy: Column, sxy: Column) -> Column:
    return syy - F.when(sxx > 0, sxy * sxy / sxx).otherwise(0.0)


def chow(
    rows: DataFrame, cell: Sequence[str], y: str, break_date: str, x: str | None = None,
) -> DataFrame:
    """Chow statistic for a break at a known date, in the mean or in a regression on ``x``.

    Residual sums come from centred moments of the pooled sample and of both sides, in one
    aggregation.
    """
    known = rows.dropna(subset=[y] + ([x] if x else []))
    after = F.col("date") >= F.lit(break_date).cast("date")
    parts = {"all": F.lit(True), "pre": ~after, "post": after}
    aggs = []
    for k, test in parts.items():
        yy = F.when(test, F.col(y))
        aggs.append(F.count(yy).alias(f"n_{k}"))
        aggs.append((F.var_pop(yy) * F.count(yy)).alias(f"yy_{k}"))
        if x:
            xx = F.when(test, F.col(x))
            aggs.append((F.var_pop(xx) * F.count(xx)).alias(f"xx_{k}"))
            aggs.append((F.covar_pop(yy, xx) * F.count(yy)).alias(f"xy_{k}"))
    s = known.groupBy(*cell).agg(*aggs)

    def ssr(k: str) -> Column:
        return _ssr(F.col(f"xx_{k}"), F.col(f"yy_{k}"), F.col(f"xy_{k}")) if x else F.col(f"yy_{k}")
    k = 2 if x else 1
    split = ssr("pre") + ssr("post")
    dof = F.col("n_all") - 2 * k
    stat = ((ssr("all") - split) / k) / (split / dof)
    usable = (F.col("n_all") >= 20) & (F.col("n_pre") >= 10) & (F.col("n_post") >= 10) & (split > 0)
    return s.filter(usable).select(
        *cell, F.col("n_all").alias("n"), stat.alias("chow_stat"), dof.alias("dof"),
        F.lit(k).alias("q"))


def supremum_scan(
    rows: DataFrame, cell: Sequence[str], y: str, trim: float = 0.15, order: str = "date",
    least: int = 60,
) -> DataFrame:
    """The largest mean-break statistic over the interior cuts, and where it is.

    Running sums of centred values give the split residual at every cut in closed form.
    """
    p = series.whole(cell)
    known = rows.filter(F.col(y).isNotNull())
    centred = known.withColumns({"_n": F.count("*").over(p), "_e": F.col(y) - F.avg(y).over(p)})
    w = series.by(cell, order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    scan = centred.withColumns({
        "_i": (F.row_number().over(w) - 1).cast("double"),
        "_s": F.sum("_e").over(before), "_t": F.sum(F.col("_e") * F.col("_e")).over(p)})
    n, i, s = F.col("_n"), F.col("_i"), F.col("_s")
    # With a zero total, the two sides sum to s and -s.
    gain = s * s / i + s * s / (n - i)
    split = F.col("_t") - gain
    inside = (i >= F.floor(n * trim)) & (i < F.floor(n * (1.0 - trim))) & (i > 0) & (n >= least)
    stat = F.when(inside & (split > 0), gain / (split / (n - 2.0)))
    cuts = scan.withColumn("_f", stat).filter(F.col("_f").isNotNull())
    return cuts.groupBy(*cell).agg(
        F.max("_f").alias("sup_stat"),
        F.min_by(order, F.struct(-F.col("_f"), F.col(order))).alias("break_at"),
        F.max("_n").alias("n"))


def bootstrap_break(
    rows: DataFrame, cell: Sequence[str], y: str, trim: float = 0.15, n_boot: int = 400,
    seed: int = 0,
) -> DataFrame:
    """p-value of :func:`supremum_scan` by resampling residuals of the no-break model.

    Replicates are rows: (cell, replicate, t) picks a hashed position and meets the
    residual there by an equality join. A series holds one calendar of days, so the
    replicate table is cells x replicates x days and spreads over all of them.
    """
    found = supremum_scan(rows, cell, y, trim)
    p, w = series.whole(cell), series.by(cell)
    known = rows.filter(F.col(y).isNotNull())
    resid = known.select(
        *cell, (F.row_number().over(w) - 1).cast("bigint").alias("pos"),
        (F.col(y) - F.avg(y).over(p)).alias("e"), F.count("*").over(p).alias("size"))
    frame = resid.select(*cell, F.col("pos").alias("t"), "size").withColumn(
        "rep", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    picks = frame.withColumn("pos", draws.index(
        F.col("size"), seed, *[F.col(k) for k in cell], F.col("rep"), F.col("t")))
    drawn = picks.join(resid.select(*cell, "pos", "e"), [*cell, "pos"])
    boot = supremum_scan(drawn, [*cell, "rep"], "e", trim, order="t").select(
        *cell, "rep", F.col("sup_stat").alias("boot_stat"))
    joined = found.join(boot, list(cell))
    return joined.groupBy(*cell, "sup_stat", "break_at", "n").agg(
        F.avg((F.col("boot_stat") >= F.col("sup_stat")).cast("double")).alias("p_boot"),
        F.count("*").alias("n_boot"))


# --- model confidence set ---------------------------------------------------------------

def replicate_means(
    losses: DataFrame, n_boot: int, seed: int = 0, cell: Sequence[str] = (), chunk: int = 50,
) -> DataFrame:
    """(cell, rep, model, mean) of i.i.d. resamples of a cell's periods.

    ``losses`` is (cell, period, model, loss) on common periods, one calendar of them a cell. Replicates
    are dealt into chunks; a (cell, chunk) is a key, and a replicate is a weight per period times the
    matrix of losses. Draws depend on the seed and the replicate alone, so a lost task draws the same.
    """
    cell = list(cell)
    spread = losses.select(*cell, "period", "model", F.col("loss").cast("double").alias("loss"), F.explode(
        F.sequence(F.lit(0), F.lit((n_boot - 1) // chunk))).alias("_chunk"))
    shape = T.StructType([*(losses.schema[k] for k in cell), *T.StructType.fromDDL("rep int, model string, mean double").fields])

    def draw(key: tuple, mine: pd.DataFrame) -> pd.DataFrame:
        wide = mine.pivot(index="period", columns="model", values="loss").sort_index()
        m, n = wide.to_numpy(), len(wide)
        reps = np.arange(key[-1] * chunk + 1, min((key[-1] + 1) * chunk, n_boot) + 1)
        weights = np.stack([np.bincount(np.random.default_rng([seed, rep]).integers(0, n, n), minlength=n) for rep in reps])
        made = pd.DataFrame(weights @ m / n, index=pd.Index(reps, name="rep"), columns=wide.columns).stack().rename("mean").reset_index()
        for name, value in zip(cell, key):
            made[name] = value
        return made[shape.names]

    return spread.groupBy(*cell, "_chunk").applyInPandas(draw, shape)


def confidence_set(
    losses: DataFrame, cell: Sequence[str] = (), alpha: float = 0.10, n_boot: int = 500, seed: int = 0,
) -> DataFrame:
    """Models of each cell that cannot be told apart from its best one.

    Replicate means do not depend on which models survive, so they are computed once for all
    cells. The steps that drop models only look at a cell's replicates x models, so cells take
    their steps side by side, each on its own small matrix. A cell of one model keeps it.
    """
    cell = list(cell)
    common = losses.filter(F.col("loss").isNotNull())
    sized = common.groupBy(*cell, "period").agg(F.count_distinct("model").alias("k"))
    most = common.groupBy(*cell).agg(F.count_distinct("model").alias("models"))
    if cell:
        full = sized.join(most, cell).filter("k = models").select(*cell, "period")
    else:
        full = sized.join(F.broadcast(most), F.col("k") == F.col("models")).select("period")
    common = common.join(full, [*cell, "period"], "left_semi")
    observed = common.groupBy(*cell, "model").agg(F.avg("loss").alias("d"), F.count("*").alias("n"))
    table = replicate_means(common, n_boot, seed, cell).join(observed, [*cell, "model"])
    shape = T.StructType([*(losses.schema[k] for k in cell), *T.StructType.fromDDL(
        "model string, eliminated_at_step int, statistic double, critical_value double").fields])

    def steps(key: tuple, mine: pd.DataFrame) -> pd.DataFrame:
        wide = mine.pivot(index="rep", columns="model", values="mean").sort_index(axis=1)
        own = mine.drop_duplicates("model").set_index("model").loc[wide.columns]
        d, n = own["d"].to_numpy(), own["n"].to_numpy()
        b = wide.to_numpy() - d
        scale = np.sqrt(b.var(0, ddof=1) / n)
        alive, gone = np.arange(len(d)), {}
        while len(alive) > 1:
            with np.errstate(divide="ignore", invalid="ignore"):
                t = (d[alive] - d[alive].mean()) / scale[alive]
                bt = (b[:, alive] - b[:, alive].mean(1, keepdims=True)) / scale[alive]
            use = scale[alive] > 0
            if not use.any():
                break
            stat = np.abs(t[use]).max()
            critical = np.quantile(np.abs(bt[:, use]).max(1), 1.0 - alpha)
            if stat <= critical:
                break
            worst = alive[use][np.flatnonzero(t[use] == t[use].max())[-1]]
            gone[worst] = len(gone) + 1, stat, critical
            alive = alive[alive != worst]
        rows = [(*key, m, *gone.get(i, (None, None, None))) for i, m in enumerate(wide.columns)]
        return pd.DataFrame(rows, columns=shape.names).astype({"eliminated_at_step": "Int32"})

    groups = table.groupBy(*cell) if cell else table.groupBy()
    return groups.applyInPandas(steps, shape).withColumn("in_confidence_set", F.col("eliminated_at_step").isNull())


# --- comparisons ---------------------------------------------------------------------------

def welch(rows: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """Welch statistic and degrees of freedom for two groups."""
    def part(name: str) -> list[Column]:
        v = F.when(F.col(group) == name, F.col(value))
        k = "a" if name == a else "b"
        return [F.count(v).alias(f"n_{k}"), F.avg(v).alias(f"mean_{k}"),
                (F.var_samp(v) / F.count(v)).alias(f"q_{k}")]
    s = rows.agg(*part(a), *part(b)).filter((F.col("n_a") > 1) & (F.col("n_b") > 1))
    q = F.col("q_a") + F.col("q_b")
    dof = q * q / (F.col("q_a") * F.col("q_a") / (F.col("n_a") - 1)
                   + F.col("q_b") * F.col("q_b") / (F.col("n_b") - 1))
    return s.select("n_a", "n_b", "mean_a", "mean_b",
                    ((F.col("mean_a") - F.col("mean_b")) / F.sqrt(q)).alias("t"), dof.alias("dof"))


def binomial_tail(hits: Column, total: Column, p: float = 0.5) -> Column:
    """P(X >= hits) for a fair (or ``p``) coin, by its recurrence over the terms."""
    odds = p / (1.0 - p)
    first = F.pow(F.lit(1.0 - p), total)
    start = F.struct(first.alias("term"), F.when(hits <= 0, first).otherwise(0.0).alias("tail"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * (total - k + 1) / k * odds
        return F.struct(term.alias("term"),
                        (acc["tail"] + F.when(k >= hits, term).otherwise(0.0)).alias("tail"))
    return F.aggregate(F.sequence(F.lit(1), total.cast("int")), start, step, lambda s: s["tail"])


def sign_agreement(coefs: DataFrame, predicted: Mapping[str, int]) -> DataFrame:
    """Matches with signs fixed in advance, overall, with the exact binomial tail."""
    spark = coefs.sparkSession
    want = spark.createDataFrame(list(predicted.items()), "term string, sign int")
    joined = coefs.join(F.broadcast(want), "term")
    out = joined.agg(
        F.count_if(F.signum("coef") == F.col("sign")).alias("matches"), F.count("*").alias("total"))
    return out.withColumn("p", binomial_tail(F.col("matches"), F.col("total")))


def validate_candidates(
    pairs: DataFrame, thresholds: Mapping[str, float] = fixed.MATCH_THRESHOLDS,
    least: int = 60,
) -> DataFrame:
    """How well candidate daily returns track a reference.

    ``pairs`` is (pair, date, cand, ref) on the days both exist. Fewer than ``least`` days
    give no row. ``failures`` lists every threshold missed.
    """
    known = pairs.dropna(subset=["cand", "ref"])
    w = series.by("pair")
    vols = known.withColumns({
        f"v_{k}": series.prior_volatility(F.col(k), w, 20) for k in ("cand", "ref")})
    diff = F.col("cand") - F.col("ref")
    both = F.col("v_cand").isNotNull() & F.col("v_ref").isNotNull()
    out = vols.groupBy("pair").agg(
        F.count("*").alias("n_overlap"), F.corr("cand", "ref").alias("return_corr"),
        F.when(F.count_if(both) > 30, F.corr(
            F.when(both, F.col("v_cand")), F.when(both, F.col("v_ref")))).alias("vol_corr"),
        F.regr_slope("cand", "ref").alias("beta"), F.regr_r2("cand", "ref").alias("r2"),
        F.stddev_samp(diff).alias("tracking_error"), F.avg(diff).alias("mean_diff"),
        F.try_divide(F.stddev_samp("cand"), F.stddev_samp("ref")).alias("std_ratio"))
    t = thresholds
    beta = F.col("beta")
    missed = F.array_compact(F.array(
        F.when(F.col("return_corr") < t["return_corr_min"], "return_corr"),
        F.when(F.col("vol_corr") < t["vol_corr_min"], "vol_corr"),
        F.when(~beta.between(t["beta_low"], t["beta_high"]), "beta"),
        F.when(F.col("r2") < t["r2_min"], "r2"),
        F.when(F.col("tracking_error") > t["tracking_error_max"], "tracking_error")))
    kept = out.filter(F.col("n_overlap") >= least).withColumn("failures", F.array_join(missed, "; "))
    return kept.withColumn("passed", F.col("failures") == "")


def measurement_gate(
    indices: DataFrame, risk: DataFrame, labels: Sequence[str], event: str,
    gate: Mapping[str, float] = fixed.MEASUREMENT_GATE,
) -> DataFrame:
    """Per label: median volume, change correlation with the risk index, z on the event
    day, mean tone; with the largest pairwise correlation and the verdicts on every row."""
    from tidewire.operators import reports
    wide = indices.join(risk.select("date", "gpr"), "date", "left").withColumn("p", F.lit("gate"))
    w, p = series.by("p"), series.whole("p")
    changed = wide.withColumns({
        **{f"d_{e}": series.change(F.col(f"att_{e}"), w) for e in labels},
        "d_gpr": series.change(F.col("gpr"), w)})
    at_event = F.col("date") == F.lit(event).cast("date")
    zs = changed.withColumns({f"z_{e}": series.zscore(F.col(f"att_{e}"), p) for e in labels})
    rows = zs.agg(*[x for e in labels for x in (
        F.percentile(f"vol_{e}", 0.5).alias(f"vol_{e}"),
        F.when(F.count(F.when(F.col(f"d_{e}").isNotNull() & F.col("d_gpr").isNotNull(), 1)) > 60,
               F.corr(f"d_{e}", "d_gpr")).alias(f"corr_{e}"),
        F.max(F.when(at_event, F.col(f"z_{e}"))).alias(f"z_{e}"),
        F.avg(f"tone_{e}").alias(f"tone_{e}"))])
    table = rows.select(F.inline(F.array(*[F.struct(
        F.lit(e).alias("ecosystem"), F.col(f"vol_{e}").alias("median_daily_articles"),
        F.col(f"corr_{e}").alias("corr_with_risk"), F.col(f"z_{e}").alias("event_z"),
        F.col(f"tone_{e}").alias("mean_tone")) for e in labels])))
    pairs = reports.pairwise_correlations(
        changed.select(*[F.col(f"d_{e}").alias(e) for e in labels]), list(labels))
    # Five rows from here on: the overall verdicts are windows over the result table.
    largest = pairs.groupBy(F.lit("gate").alias("gate")).agg(
        F.max(F.abs("corr")).alias("max_pairwise_corr"))
    every = Window.partitionBy("gate")
    west = F.when(F.col("ecosystem") == "WEST", F.abs("corr_with_risk"))
    checks = {
        "west_pass": F.max(west).over(every) >= gate["west_risk_corr_min"],
        "volume_pass": F.min("median_daily_articles").over(every) >= gate["min_daily_articles"],
        "event_pass": F.max("event_z").over(every) >= gate["event_zscore_min"],
        "collinearity_pass": F.col("max_pairwise_corr") <= gate["max_pairwise_corr"],
    }
    out = table.withColumn("gate", F.lit("gate")).join(largest, "gate", "left")
    out = out.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in checks.items()})
    overall = F.col("west_pass") & F.col("collinearity_pass") & F.col("volume_pass")
    return out.withColumn("overall_pass", overall & F.col("event_pass")).drop("gate")


def rules(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """(rule, pass) rows from aggregate conditions over one result table, and ``overall``."""
    wide = df.agg(*[F.coalesce(v, F.lit(False)).alias(k) for k, v in conditions.items()])
    pairs = [F.struct(F.lit(k).alias("rule"), F.col(k).alias("pass")) for k in conditions]
    every = F.lit(True)
    for k in conditions:
        every = every & F.col(k)
    pairs.append(F.struct(F.lit("overall").alias("rule"), every.alias("pass")))
    return wide.select(F.inline(F.array(*pairs)))


def strict_rules(
    grid: DataFrame, coefs: DataFrame, cell: Sequence[str], window: str, targets: Sequence[str], episodes: Sequence[str],
) -> DataFrame:
    """The strict reading of the pass rule, (rule, pass) rows.

    Arm 1: a survivor of the correction in ``window`` on one of ``targets``. Arm 2: survivors in at
    least two of the ``episodes`` windows that agree, that is, some term of ``coefs`` (cell, term, coef)
    has one sign in all surviving cells of two windows or more. Either arm passes.
    """
    lived = grid.filter("survives_bh")
    named = lived.filter((F.col("window") == window) & F.col("target").isin(list(targets)))
    inside = lived.filter(F.col("window").isin(list(episodes)))
    by_term = coefs.join(inside.select(*cell), list(cell), "left_semi").filter("coef <> 0").groupBy("term").agg(
        F.count_distinct("window").alias("windows"), F.count_distinct(F.signum("coef")).alias("signs"))
    facts = [named.agg(F.lit("one").alias("k"), (F.count("*") > 0).alias("v")),
             inside.agg(F.lit("two").alias("k"), (F.count_distinct("window") >= 2).alias("v")),
             by_term.agg(F.lit("agree").alias("k"), F.bool_or((F.col("windows") >= 2) & (F.col("signs") == 1)).alias("v"))]
    told = facts[0].unionByName(facts[1]).unionByName(facts[2])
    held = lambda k: F.coalesce(F.bool_or((F.col("k") == k) & F.col("v")), F.lit(False))
    pairs = [("arm 1: survivor on a qualifying target", held("one")), ("arm 2: survivors in two episode windows", held("two")),
             ("arm 2: a term of one sign in them", held("agree")), ("overall", held("one") | held("two") & held("agree"))]
    wide = told.agg(*[v.alias(f"_{i}") for i, (_, v) in enumerate(pairs)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"_{i}").alias("pass")) for i, (k, _) in enumerate(pairs)])))


def holdout_rules(
    grid: DataFrame, placebo: DataFrame, dynamics: DataFrame, horizons: Sequence[int], p: str = "p_local",
) -> DataFrame:
    """The rule on held-out blocks, (rule, pass) rows: the correction's survivors at every horizon, a
    shuffled placebo above 0.20 everywhere, and p under 0.05 everywhere with twelve own lags.

    The three tables are results of one outcome with a row a horizon. A missing row or p fails.
    """
    def part(df: DataFrame, name: str, good: Column) -> DataFrame:
        return df.select(F.lit(name).alias("part"), "horizon", F.coalesce(good, F.lit(False)).alias("good"))

    rows = part(grid, "grid", F.col("survives_bh")).unionByName(part(placebo, "placebo", F.col(p) > 0.20)).unionByName(
        part(dynamics, "dynamics", F.col(p) < 0.05)).filter(F.col("horizon").isin(list(horizons)))

    def every(name: str) -> Column:
        mine = F.col("part") == name
        return (F.count_distinct(F.when(mine, F.col("horizon"))) == len(horizons)) & (F.count_if(mine & ~F.col("good")) == 0)

    return rules(rows, {
        "survives at every horizon": every("grid"), "shuffle placebo above a fifth": every("placebo"),
        "survives twelve own lags": every("dynamics")})


def sensitivity_summary(
    grid: DataFrame, family: Sequence[str], p: str = "p_local", alpha: float = 0.05,
) -> DataFrame:
    """Per family: cells, nominal hits, survivors of the correction, smallest p."""
    tested = benjamini_hochberg(grid, p, family, alpha)
    return tested.groupBy(*family).agg(
        F.count(p).alias("n_cells"), F.count_if(F.col(p) < alpha).alias("nominal"),
        F.count_if("survives_bh").alias("survivors"), F.min(p).alias("min_p"))
