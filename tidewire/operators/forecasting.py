"""Walk-forward forecasts: cells, cut-offs and replicates are rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewire.functions import columns as c, tails
from tidewire.operators import moments, series, testing, walkforward
from tidewire.session import durable


# --- plans ---------------------------------------------------------------------

def common_frame(df: DataFrame, y: str, widest: Sequence[str], cell: Sequence[str],
                 least: int = 400) -> DataFrame:
    """Complete cases of the widest feature set, so every set races on the same rows.
    Cells under ``least`` rows are left out."""
    kept = durable(df).filter(c.all_known([y, *widest]))
    sized = kept.withColumn("_n", F.count("*").over(series.whole(cell)))
    return sized.filter(F.col("_n") >= least).drop("_n")


def walk_forward(
    frame: DataFrame, cell: Sequence[str], h: int | str = 1, test_fraction: float = 0.25,
    refit: int = 21,
) -> DataFrame:
    """Row positions and cut-offs.

    Adds ``pos``, ``test_start``, ``use_step`` (the cut-off that forecasts a held-out row,
    NULL in training) and ``train_step`` (the first cut-off that may train on a row). An
    ``h``-row label at ``pos`` is realised by pos + h, so no fit sees an open label.
    """
    w, p = series.by(cell), series.whole(cell)
    hh = F.lit(h) if isinstance(h, int) else F.col(h)
    start = F.floor(F.col("_n") * (1.0 - test_fraction)).cast("int")
    placed = frame.withColumns({
        "pos": F.row_number().over(w) - 1, "_n": F.count("*").over(p)})
    placed = placed.withColumn("test_start", start)
    ts, pos = F.col("test_start"), F.col("pos")
    use = ts + F.floor((pos - ts) / refit) * refit
    late = F.greatest(F.lit(0), F.ceil((pos + hh - ts) / refit))
    return placed.withColumns({
        "use_step": F.when(pos >= ts, use).cast("int"),
        "train_step": (ts + late * refit).cast("int"),
    }).drop("_n")


def cutoffs(plan: DataFrame, cell: Sequence[str], h: int | str = 1) -> DataFrame:
    """Per cut-off: last training day, first and last forecast day, and both sizes."""
    hh = F.lit(h) if isinstance(h, int) else F.col(h)
    uses = plan.filter(F.col("use_step").isNotNull()).groupBy(
        *cell, F.col("use_step").alias("step")).agg(
        F.count("*").alias("n_test"), F.min("date").alias("test_from"),
        F.max("date").alias("test_to"))
    trains = plan.groupBy(*cell, F.col("train_step").alias("step")).agg(
        F.count("*").alias("m"), F.max("date").alias("last"),
        F.max(F.col("pos") + hh - 1).alias("last_label_pos"))
    w = series.by(cell, "step").rowsBetween(Window.unboundedPreceding, 0)
    return uses.join(trains, [*cell, "step"], "left").withColumns({
        "n_train": F.sum("m").over(w), "train_to": F.max("last").over(w),
        "last_label_pos": F.max("last_label_pos").over(w)}).drop("m", "last")


def leakage(cut: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Cut-offs whose training labels or days reach into their forecast days."""
    bad = (F.col("train_to") >= F.col("test_from")) | (F.col("last_label_pos") >= F.col("step"))
    return cut.groupBy(*cell).agg(
        F.count("*").alias("n_cutoffs"), F.count_if(bad).alias("n_leaking"))


def unlagged_features(features: DataFrame) -> DataFrame:
    """Feature names that break the naming rule for lagged inputs."""
    return features.filter(
        ~F.col("feature").rlike(r"(_lag\d+|_d1|_rolling_lag1)$")
        & ~F.col("feature").startswith("regime_"))


# --- predictor grids ----------------------------------------------------------------

def predictor_grid(
    long: DataFrame, cell: Sequence[str], min_train: int = 250, least: int = 200,
) -> DataFrame:
    """Expanding-mean and one-predictor forecasts of every (target, predictor) cell.

    ``long`` is (cell, date, y, x) with x already lagged. Refitting at every row costs
    nothing extra: both forecasts are running aggregates of one pass.
    """
    w = series.by(cell)
    y = long.filter(F.col("y").isNotNull())
    out = y.withColumns({
        "pos": F.row_number().over(w) - 1,
        "bench": series.expanding_mean(F.col("y"), w),
        "model": series.expanding_ols(F.col("y"), F.col("x"), w)})
    tested = out.filter(F.col("pos") >= min_train).dropna(subset=["bench", "model"])
    sized = tested.withColumn("_n", F.count("*").over(series.whole(cell)))
    return sized.filter(F.col("_n") >= least).drop("_n")


def combine(forecasts: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Mean and median of the known forecasts of a day; a day without any drops out.
    ``keep`` names columns that are constant within a key."""
    out = forecasts.groupBy(*keys).agg(
        *[F.max(k).alias(k) for k in keep],
        F.avg("forecast").alias("combination_mean"),
        F.percentile("forecast", 0.5).alias("combination_median"))
    return out.filter(F.col("combination_mean").isNotNull())


# --- ridge ------------------------------------------------------------------------------

def ridge_sets(
    plan: DataFrame, cell: Sequence[str], y: str, sets: Mapping[str, Sequence[str]],
    alpha: float = 10.0, min_rows: int = 100, impute: bool = False,
) -> DataFrame:
    """Ridge forecasts of every nested feature set; see :func:`walkforward.expanding_ridge`."""
    return walkforward.expanding_ridge(plan, cell, y, sets, alpha, min_rows, impute)


# --- variance -------------------------------------------------------------------------

def variance_targets(returns: DataFrame, key: str, h: int) -> DataFrame:
    """Realised variance over ``h`` rows from the current one, and its floored log."""
    w = series.by(key)
    sq = returns.filter(F.col("ret").isNotNull()).withColumn("sq", F.col("ret") * F.col("ret"))
    rv = sq.withColumn("rv", series.forward_sum(F.col("sq"), w, h))
    return rv.withColumn("log_rv", F.ln(F.when(
        F.col("rv").isNotNull(), F.greatest(F.col("rv"), F.lit(1e-12)))))


def har_forecasts(
    returns: DataFrame, key: str, horizons: Sequence[int], extra: Mapping[str, Sequence[str]] | None = None,
    alpha: float = 1.0, refit: int = 1, least: int = 400,
) -> DataFrame:
    """HAR on log realised variance, exponentiated, for every horizon; ``extra`` adds named feature blocks.

    ``returns`` is (key, date, ret, and any extra features, already lagged). A row needs its
    variance only; unknown inputs take the training median of the cut-off.
    """
    w = series.by(key)
    har = ["l1", "l5", "l22"]
    sets = {"HAR-RV": har}
    for name, features in (extra or {}).items():
        sets[f"HAR-RV-X ({name})"] = [*har, *features]
    rows = None
    for h in horizons:
        part = variance_targets(returns, key, h)
        part = part.withColumns(series.har_terms(F.col("log_rv"), w, h)).withColumn("horizon", F.lit(h))
        rows = part if rows is None else rows.unionByName(part)
    cell = [key, "horizon"]
    known = rows.filter(F.col("log_rv").isNotNull()).withColumn("_n", F.count("*").over(series.whole(cell)))
    plan = walk_forward(durable(known.filter(F.col("_n") >= least).drop("_n")), cell, "horizon", refit=refit)
    fits = ridge_sets(plan, cell, "log_rv", sets, alpha, impute=True)
    actual = plan.select(*cell, "date", "rv")
    return fits.join(actual, [*cell, "date"]).select(
        *cell, "date", "rv", F.col("info_set").alias("model"), F.exp("forecast").alias("forecast"))


def variance_grid(alphas: Sequence[float], betas: Sequence[float],
                  leverages: Sequence[float]) -> list[tuple[float, float, float]]:
    return [(a, g, b) for a in alphas for g in leverages for b in betas if a + g / 2 + b < 1.0]


def decayed_sums(rows: DataFrame, keys: Sequence[str], pos: str, c: str, decay: Column, name: str, block: int = 64) -> DataFrame:
    """``name``: h with h = c at the first row of a key and h = c + decay * h(before) from then on.

    A step is the map h -> c + decay * h, and maps compose, so a series is scanned in two levels:
    inside blocks of ``block`` rows as running sums of c over powers of the decay, then one row a
    block for what the blocks before it carry in. Memory is one block, not one path; blocks are
    keys, so there are more tasks than series. ``decay`` is constant in a key, between 0 and 1; a
    block is short enough that its powers keep their digits down to a decay of about 0.6.
    """
    keys = list(keys)
    at = F.col(pos) % block
    inside = Window.partitionBy(*keys, "_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.withColumns({"_b": F.floor(F.col(pos) / block), "_d": decay})
    local = cut.withColumn("_l", F.sum(F.col(c) / F.pow("_d", at)).over(inside) * F.pow("_d", at))
    ends = local.groupBy(*keys, "_b").agg(F.max_by("_l", pos).alias("_end"), F.max("_d").alias("_d"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    step = lambda h, e: e["_end"] + h * F.pow(e["_d"], e["_n"])
    carried = ends.withColumn("_past", F.collect_list(F.struct("_end", "_d", "_n")).over(before)).select(
        *keys, "_b", F.aggregate("_past", F.lit(0.0), step).alias("_in"))
    out = local.join(carried, [*keys, "_b"])
    return out.withColumn(name, F.col("_l") + F.col("_in") * F.pow("_d", at + 1)).drop("_b", "_d", "_l", "_in")


def variance_benchmark(
    returns: DataFrame, key: str, params: Sequence[tuple[float, float, float]],
    test_fraction: float = 0.25, refit: int = 21,
) -> DataFrame:
    """Best variance-targeted recursion per (series, cut-off), out of sample.

    Every (series, parameter) pair is a key. The recursion h' = w + (a + g*[r<0]) r^2 + b h is a
    decayed sum of what is known at each row, see :func:`decayed_sums`. The long-run level is the
    expanding variance known at the time, and the state moves every day.
    """
    w, p = series.by(key), series.whole(key)
    known = returns.filter(F.col("ret").isNotNull())
    sq = F.col("ret") * F.col("ret")
    placed = known.withColumns({
        "pos": F.row_number().over(w) - 1, "n": F.count("*").over(p), "before": F.lag("ret").over(w),
        "level": F.avg(sq).over(series.past(w))})
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(g).alias("g"), F.lit(b).alias("b"))
                     for a, g, b in params])
    a, g, b = F.col("m.a"), F.col("m.g"), F.col("m.b")
    spread = placed.filter("level IS NOT NULL").select(key, "n", "pos", "date", "ret", "before", "level", F.explode(grid).alias("m"))
    news = (a + F.when(F.col("before") < 0, g).otherwise(0.0)) * F.col("before") * F.col("before")
    spread = spread.withColumns({"k": F.col("pos") - 1, "c": F.when(F.col("pos") == 1, F.col("level")).otherwise(
        (1.0 - a - g / 2.0 - b) * F.col("level") + news)})
    daily = decayed_sums(spread, [key, "m"], "k", "c", b, "h")
    daily = daily.withColumns({
        "rv": F.col("ret") * F.col("ret"),
        "ts": F.floor(F.col("n") * (1.0 - test_fraction)).cast("int")})
    scored = daily.withColumn("q", c.qlike(F.col("rv"), F.col("h")))
    wm = Window.partitionBy(key, "m").orderBy("pos")
    scored = scored.withColumns({
        "seen": F.avg("q").over(wm.rowsBetween(Window.unboundedPreceding, -1)),
        "step": F.col("ts") + F.floor((F.col("pos") - F.col("ts")) / refit).cast("int") * refit})
    at_cut = scored.filter((F.col("pos") == F.col("step")) & (F.col("pos") >= F.col("ts")))
    best = at_cut.groupBy(key, "step").agg(
        F.min_by("m", F.struct("seen", "m")).alias("m"), F.min("seen").alias("train_qlike"))
    return scored.filter(F.col("pos") >= F.col("ts")).join(best, [key, "step", "m"]).select(
        key, "date", "step", "m.*", "train_qlike", "rv", F.col("h").alias("forecast"))


# --- attribution --------------------------------------------------------------

def permuted(
    df: DataFrame, cell: Sequence[str], columns: Sequence[str], seed: int, date: str = "date",
) -> DataFrame:
    """The named columns moved to other rows of the cell by one hashed permutation.

    All columns move together. Rank by hash meets rank by date, an equality join.
    """
    w = series.by(cell, date)
    shuffled = Window.partitionBy(*cell).orderBy(
        F.xxhash64(F.lit(seed), F.col(date)), F.col(date))
    keep = df.withColumn("_k", F.row_number().over(w)).drop(*columns)
    moved = df.select(*cell, *columns, F.row_number().over(shuffled).alias("_k"))
    return keep.join(moved, [*cell, "_k"]).drop("_k")


def block_attribution(
    plan: DataFrame, cell: Sequence[str], y: str, blocks: Mapping[str, Sequence[str]],
    alpha: float = 10.0, seed: int = 0,
) -> DataFrame:
    """Rise in held-out squared error when a block's columns are permuted together.

    Columns: block, features, loss increase, its share of the positive total, and the
    increase per feature. One ridge is trained at the first cut-off and scores every copy.
    """
    features = [f for fs in blocks.values() for f in fs]
    first = plan.withColumn("train_step", F.when(
        F.col("train_step") <= F.col("test_start"), F.col("test_start"))).withColumn(
        "use_step", F.when(F.col("use_step").isNotNull(), F.col("test_start")))
    train = first.filter(F.col("train_step").isNotNull() & F.col("use_step").isNull())
    test = first.filter(F.col("use_step").isNotNull())
    copies = test.withColumn("copy", F.lit("as is"))
    for i, (name, columns) in enumerate(blocks.items()):
        moved = permuted(test, cell, columns, seed + i)
        copies = copies.unionByName(moved.withColumn("copy", F.lit(name)))
    trained = moments.prefix_moments(train, cell, y, features, "train_step")
    k = len(features)

    @F.pandas_udf("array<double>")
    def solve(arrays: pd.Series) -> pd.Series:
        return pd.Series([moments.ridge_from_moments(
            np.asarray(a, dtype=float).reshape(k + 2, k + 2), alpha) for a in arrays])
    beta = trained.select(*cell, solve("moments").alias("beta"))
    x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features])
    scored = copies.join(beta, list(cell)).withColumn("e", F.col(y) - moments._dot(x, F.col("beta")))
    mse = scored.groupBy(*cell, "copy").agg(F.avg(F.col("e") * F.col("e")).alias("mse"))
    base = mse.filter(F.col("copy") == "as is").select(*cell, F.col("mse").alias("base"))
    sizes = F.create_map(*[v for n, fs in blocks.items() for v in (F.lit(n), F.lit(len(fs)))])
    rise = mse.filter(F.col("copy") != "as is").join(base, list(cell)).select(
        *cell, F.col("copy").alias("block"), F.try_element_at(sizes, F.col("copy")).alias("features"),
        (F.col("mse") - F.col("base")).alias("loss_increase"))
    positive = F.greatest(F.col("loss_increase"), F.lit(0.0))
    total = F.sum(positive).over(series.whole(cell))
    return rise.withColumns({
        "share": F.try_divide(positive, total),
        "per_feature": F.col("loss_increase") / F.col("features")})


def p_two_sided_t(stat: Column, n: Column) -> Column:
    return tails.t_two_sided(stat, (n - 1).cast("double"))
