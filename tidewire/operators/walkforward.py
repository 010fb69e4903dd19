"""Models refit along a calendar: expanding medians, a block-scanned ridge and boosted trees.

A plan has a row per day of a cell with ``train_step``, the first cut-off that may train on it, and
``use_step``, the cut-off that forecasts it (null in training). Cells and cut-offs are keys, so
hundreds of refits run side by side; none visits the rows of an earlier one again.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidewire.operators import moments


# --- order statistics of growing sets ---------------------------------------------------------

def expanding_medians(values: DataFrame, asked: DataFrame, keys: Sequence[str], block: int = 32) -> DataFrame:
    """(keys, step, median) of the values known by each asked step, exact.

    ``values`` is (keys, step, value): a value is known from its step on. ``asked`` is (keys, step).
    Values are ranked once and cut into blocks of neighbouring ranks. Running counts by (block,
    step) say in which block the middle ranks of a step lie; only that block is looked into. So a
    step costs the number of blocks and one block, not all values before it.
    """
    keys = list(keys)
    known = values.filter(F.col("value").isNotNull())
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("value", "step")) - 1
    placed = known.withColumn("_b", F.floor(rank / block))
    counts = placed.groupBy(*keys, "_b", "step").agg(F.count("*").alias("_c"))
    steps = asked.select(*keys, "step").distinct()
    blocks = counts.select(*keys, "_b").distinct()
    # A mark for every (block, asked step); counts of the same step stand before it.
    marks = steps.join(blocks, keys).withColumn("_c", F.lit(0).cast("long")).withColumn("_ask", F.lit(1))
    events = counts.withColumn("_ask", F.lit(0)).unionByName(marks)
    upto = Window.partitionBy(*keys, "_b").orderBy("step", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    filled = events.withColumn("_f", F.sum("_c").over(upto)).filter("_ask = 1")
    along = Window.partitionBy(*keys, "step").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    full = filled.withColumns({"_upto": F.sum("_f").over(along), "_n": F.sum("_f").over(Window.partitionBy(*keys, "step"))})
    middle = F.array(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1)
    wanted = full.select(*keys, "step", "_b", "_upto", "_f", F.posexplode(middle).alias("_half", "_k")).filter(
        (F.col("_k") > F.col("_upto") - F.col("_f")) & (F.col("_k") <= F.col("_upto"))).select(
        *keys, "_b", F.col("step").alias("_at"), "_half", (F.col("_k") - (F.col("_upto") - F.col("_f"))).alias("_k"))
    inside = wanted.join(placed.select(*keys, "_b", "step", "value"), [*keys, "_b"]).filter(F.col("step") <= F.col("_at"))
    order = Window.partitionBy(*keys, "_at", "_half").orderBy("value")
    found = inside.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == F.col("_k"))
    return found.groupBy(*keys, F.col("_at").alias("step")).agg(F.avg("value").alias("median"))


# --- ridge ------------------------------------------------------------------------------------

def _packed(z: np.ndarray) -> np.ndarray:
    """Upper half of the cross products of rows z."""
    return (z.T @ z)[np.triu_indices(z.shape[1])]


def _square(half: np.ndarray, width: int) -> np.ndarray:
    m = np.zeros((width, width))
    m[np.triu_indices(width)] = half
    return m + np.triu(m, 1).T


def _spread(x: np.ndarray, y: np.ndarray, holes: bool) -> np.ndarray:
    """Rows [1, x, y] and, with ``holes``, which x are unknown; unknown ones count as 0."""
    gone = np.isnan(x)
    parts = [np.ones((len(x), 1)), np.where(gone, 0.0, x), y[:, None]]
    return np.hstack([*parts, gone.astype(float)] if holes else parts)


def expanding_ridge(
    plan: DataFrame, cell: Sequence[str], y: str, sets: Mapping[str, Sequence[str]], alpha: float = 10.0,
    min_rows: int = 100, impute: bool = False, span: int = 64,
) -> DataFrame:
    """Ridge forecasts of every feature set at every cut-off: (cell, date, pos, y, info_set, n_features, forecast).

    Cross products of the widest set hold those of every subset. Cut-offs fall into blocks of
    ``span`` steps. The cross products of each block are summed first, in pieces of rows; a block
    then starts from the sum of the blocks before it and moves along its own cut-offs, adding
    their rows and solving each set. Matrices leave a task once a block, not once a cut-off.

    With ``impute``, an unknown feature takes the median of the training rows of its cut-off, in
    training rows anew at every cut-off: sums over known values and over indicators of unknown
    ones give the cross products of filled rows for any medians.
    """
    cell = list(cell)
    widest: list[str] = list(dict.fromkeys(f for fs in sets.values() for f in fs))
    k, width = len(widest), (2 if not impute else 2 + len(widest)) + len(widest)
    picks = {name: np.array([widest.index(f) for f in fs]) for name, fs in sets.items()}
    x = F.array(*[F.col(f).cast("double") for f in widest])
    kinds = [plan.schema[c] for c in cell]
    rows = plan.select(*cell, "date", "pos", F.col(y).cast("double").alias("_y"), x.alias("_x"), "train_step", "use_step")
    train = rows.filter(F.col("_y").isNotNull()).withColumn("_blk", F.floor(F.col("train_step") / span))

    @F.pandas_udf("array<double>")
    def summed(xs: pd.Series, ys: pd.Series) -> list[float]:
        z = _spread(np.array(xs.tolist(), dtype=float).reshape(len(xs), k), ys.to_numpy(float), impute)
        return _packed(z).tolist()

    pieces = train.groupBy(*cell, "_blk", F.floor(F.col("pos") / 512).alias("_piece")).agg(summed("_x", "_y").alias("_m"))
    add = lambda a, b: F.zip_with(a, b, lambda p, q: p + q)
    total = lambda c: F.reduce(F.slice(c, 2, F.size(c)), F.get(c, F.lit(0)), add)
    totals = pieces.groupBy(*cell, "_blk").agg(F.collect_list("_m").alias("_l")).select(*cell, "_blk", total(F.col("_l")).alias("_m"))
    tests = rows.filter(F.col("use_step").isNotNull()).withColumn("_blk", F.floor(F.col("use_step") / span))
    if impute:
        long = train.select(*cell, F.posexplode("_x").alias("_i", "value"), F.col("train_step").alias("step"))
        asked = tests.select(*cell, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_i"), F.col("use_step").alias("step"))
        mid = expanding_medians(long, asked, [*cell, "_i"])
        fills = mid.groupBy(*cell, F.col("step").alias("use_step")).agg(F.map_from_entries(
            F.collect_list(F.struct("_i", "median"))).alias("_fill"))
        fill = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.try_element_at("_fill", i))
        tests = tests.join(fills, [*cell, "use_step"], "left").withColumn("_med", fill).drop("_fill")
    else:
        tests = tests.withColumn("_med", F.lit(None).cast("array<double>"))
    # A block needs its own rows and the sums of the blocks before it.
    spots = tests.select(*cell, "_blk").distinct().unionByName(totals.select(*cell, "_blk")).distinct()
    before = Window.partitionBy(*cell).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    other = [f"_k{i}" for i in range(len(cell) + 1)]  # names of its own: both sides come from the plan
    carry = spots.join(totals, [*cell, "_blk"], "left").withColumn("_l", F.collect_list("_m").over(before)).select(
        *[F.col(c).alias(o) for c, o in zip([*cell, "_blk"], other)], F.when(F.size("_l") > 0, total(F.col("_l"))).alias("_m"))
    none = F.lit(None)
    work = train.select(*cell, "_blk", F.col("train_step").alias("_step"), F.lit(0).alias("_kind"), "date", "pos", "_y", "_x",
                        none.cast("array<double>").alias("_med"))
    work = work.unionByName(tests.select(*cell, "_blk", F.col("use_step").alias("_step"), F.lit(1).alias("_kind"), "date", "pos", "_y", "_x", "_med"))

    out = T.StructType([*kinds, plan.schema["date"], T.StructField("pos", T.IntegerType()), T.StructField(y, T.DoubleType()),
                        T.StructField("info_set", T.StringType()), T.StructField("n_features", T.IntegerType()), T.StructField("forecast", T.DoubleType())])

    def walk(key: tuple, mine: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
        start = carried["_m"].iloc[0] if len(carried) else None
        m = _square(np.asarray(start, float), width) if start is not None else np.zeros((width, width))
        found = []
        for _, part in mine.sort_values(["_step", "_kind"], kind="stable").groupby("_step", sort=True):
            fresh, held = part[part["_kind"] == 0], part[part["_kind"] == 1]
            if len(fresh):
                z = _spread(np.array(fresh["_x"].tolist(), float).reshape(len(fresh), k), fresh["_y"].to_numpy(float), impute)
                m = m + z.T @ z
            if not len(held) or not m[0, 0]:
                continue
            now, values = m, np.array(held["_x"].tolist(), float).reshape(len(held), k)
            if impute:
                med = np.nan_to_num(np.array(held["_med"].iloc[0], dtype=float))
                fill = np.hstack([np.eye(k + 2), np.vstack([np.zeros(k), np.diag(med), np.zeros(k)])])
                now, values = fill @ m @ fill.T, np.where(np.isnan(values), med, values)
            for name, idx in picks.items():
                if now[0, 0] < min_rows:
                    forecast = np.full(len(held), now[0, k + 1] / now[0, 0])
                else:
                    on = np.concatenate([[0], idx + 1, [k + 1]])
                    beta = moments.ridge_from_moments(now[np.ix_(on, on)], alpha)
                    forecast = beta[0] + values[:, idx] @ beta[1:]
                found.append(pd.DataFrame({"date": held["date"], "pos": held["pos"], y: held["_y"], "info_set": name,
                                           "n_features": len(idx), "forecast": forecast}))
        if not found:
            return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in out.fields})
        made = pd.concat(found, ignore_index=True)
        for name, value in zip(cell, key):
            made[name] = value
        return made[out.names]

    return work.groupBy(*cell, "_blk").cogroup(carry.groupBy(*other)).applyInPandas(walk, out)


# --- boosted trees ----------------------------------------------------------------------------

def _level(codes: np.ndarray, node: np.ndarray, weight: np.ndarray, n_nodes: int, n_codes: int) -> np.ndarray:
    """Sums of ``weight`` by (node, feature and bin)."""
    place = codes + (node * n_codes)[:, None]
    return np.bincount(place.ravel(), np.repeat(weight, codes.shape[1]), n_nodes * n_codes).reshape(n_nodes, n_codes)


def boosted(
    x: np.ndarray, y: np.ndarray, held: np.ndarray, n_trees: int = 200, depth: int = 3, rate: float = 0.05, rows: float = 0.8,
    columns: float = 0.8, penalty: float = 1.0, bins: int = 64, seed: int = 0,
) -> np.ndarray:
    """Forecasts for rows ``held`` of boosted trees on squared error, trained on x and y.

    Trees grow level by level from sums by (node, feature, bin); bins are quantiles of the training
    rows. Rows and features are drawn for each tree, features alike for equal widths.
    """
    n, k = x.shape
    draw = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = lambda v: np.stack([np.searchsorted(e, v[:, j], side="left") for j, e in enumerate(edges)], 1)
    train, test = binned(x), binned(held)
    base = y.mean()
    fitted, forecast = np.full(n, base), np.full(len(held), base)
    for _ in range(n_trees):
        chosen = np.sort(draw.permutation(n)[:max(1, round(rows * n))])
        used = np.sort(draw.permutation(k)[:max(1, round(columns * k))])
        codes = train[np.ix_(chosen, used)] + np.arange(len(used)) * bins
        slope = y[chosen] - fitted[chosen]
        node = np.zeros(len(chosen), np.int64)
        all_node, test_node = np.zeros(n, np.int64), np.zeros(len(held), np.int64)
        for level in range(depth):
            size = 1 << level
            g = _level(codes, node, slope, size, len(used) * bins).reshape(size, len(used), bins).cumsum(2)
            h = _level(codes, node, np.ones(len(chosen)), size, len(used) * bins).reshape(size, len(used), bins).cumsum(2)
            whole_g, whole_h = g[:, :, -1:], h[:, :, -1:]
            gain = g * g / (h + penalty) + (whole_g - g) ** 2 / (whole_h - h + penalty) - whole_g ** 2 / (whole_h + penalty)
            gain[(h < 1) | (whole_h - h < 1)] = 0.0
            best = gain.reshape(size, -1).argmax(1)
            feature, cut = used[best // bins], best % bins
            cut = np.where(gain.reshape(size, -1).max(1) > 1e-12, cut, bins)  # no split: all go left
            node = 2 * node + (train[chosen, feature[node]] > cut[node])
            all_node = 2 * all_node + (train[np.arange(n), feature[all_node]] > cut[all_node])
            test_node = 2 * test_node + (test[np.arange(len(held)), feature[test_node]] > cut[test_node])
        leaf = rate * np.bincount(node, slope, 1 << depth) / (np.bincount(node, minlength=1 << depth) + penalty)
        fitted += leaf[all_node]
        forecast += leaf[test_node]
    return forecast


def boosted_sets(plan: DataFrame, cell: Sequence[str], y: str, sets: Mapping[str, Sequence[str]], refit: int = 21, **settings) -> DataFrame:
    """Boosted trees refit at every cut-off with the same parameters for every set:
    (cell, date, pos, y, info_set, n_features, forecast).

    Every (cell, cut-off) is a key that its training rows and its held-out rows meet under, so all
    refits share one shuffle and run side by side. A key holds one calendar of days.
    """
    cell = list(cell)
    widest: list[str] = list(dict.fromkeys(f for fs in sets.values() for f in fs))
    picks = {name: [widest.index(f) for f in fs] for name, fs in sets.items()}
    whole = plan.dropna(subset=widest).select(*cell, "date", F.col("pos").cast("int").alias("pos"), F.col(y).cast("double").alias("_y"), F.array(*[
        F.col(f).cast("double") for f in widest]).alias("_x"), "train_step", "use_step", F.max("use_step").over(Window.partitionBy(*cell)).alias("_last"))
    later = F.when(F.col("train_step") <= F.col("_last"), F.sequence("train_step", F.col("_last"), F.lit(refit)))
    train = whole.filter(F.col("_y").isNotNull()).withColumn("_step", F.explode(later)).withColumn("_kind", F.lit(0))
    tests = whole.filter(F.col("use_step").isNotNull()).withColumn("_step", F.col("use_step")).withColumn("_kind", F.lit(1))
    out = T.StructType([*(plan.schema[c] for c in cell), plan.schema["date"], T.StructField("pos", T.IntegerType()), T.StructField(y, T.DoubleType()),
                        T.StructField("info_set", T.StringType()), T.StructField("n_features", T.IntegerType()), T.StructField("forecast", T.DoubleType())])

    def fit(key: tuple, mine: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values(["pos", "_kind"])
        known, held = mine[mine["_kind"] == 0], mine[mine["_kind"] == 1]
        found = []
        if len(known) and len(held):
            x, xt = (np.array(part["_x"].tolist(), float).reshape(len(part), len(widest)) for part in (known, held))
            for name, idx in picks.items():
                forecast = boosted(x[:, idx], known["_y"].to_numpy(float), xt[:, idx], **settings)
                found.append(pd.DataFrame({"date": held["date"], "pos": held["pos"], y: held["_y"], "info_set": name,
                                           "n_features": len(idx), "forecast": forecast}))
        if not found:
            return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in out.fields})
        made = pd.concat(found, ignore_index=True)
        for name, value in zip(cell, key):
            made[name] = value
        return made[out.names]

    columns = [*cell, "_step", "_kind", "date", "pos", "_y", "_x"]
    both = train.select(*columns).unionByName(tests.select(*columns))
    return both.groupBy(*cell, "_step").applyInPandas(fit, out)
