"""Specification grids as rows: windows, frequencies, targets, lags, variants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewire import fixed_values as fixed
from tidewire.functions import columns as c
from tidewire.operators import intervals, moments, series
from tidewire.operators.testing import benjamini_hochberg
from tidewire.session import durable

Windows = Mapping[str, tuple[str, str] | None]


def window_table(spark: SparkSession, windows: Windows) -> DataFrame:
    """(window, start, end); ``None`` means all days."""
    rows = [(name, *(span or ("0001-01-01", "9999-12-31"))) for name, span in windows.items()]
    return spark.createDataFrame(rows, "window string, a string, b string").select(
        "window", F.to_date("a").alias("start"), F.to_date("b").alias("end"))


def in_windows(panel: DataFrame, windows: Windows | DataFrame, date: str = "date") -> DataFrame:
    """One copy of a row for every window its day falls in (both ends included). Windows are a
    mapping or a table (window, start, end) of any length."""
    table = windows if isinstance(windows, DataFrame) else window_table(panel.sparkSession, windows)
    return intervals.within(panel, table, ["window"], date).select(*panel.columns, "window")


def per_target(rows: DataFrame, targets: Mapping[str, str | None]) -> DataFrame:
    """One copy of a row per target, with ``y`` and its benchmark ``mkt``."""
    cells = F.array(*[F.struct(
        F.lit(t).alias("target"), F.col(t).cast("double").alias("y"),
        (F.col(b) if b else F.lit(0.0)).cast("double").alias("mkt"))
        for t, b in targets.items()])
    keep = [x for x in rows.columns if x not in ("target", "y", "mkt")]
    return rows.select(*keep, F.inline(cells))


def enough_targets(rows: DataFrame, cell: Sequence[str], y: str = "y", least: int = 40) -> DataFrame:
    """Cells with at least ``least`` known targets."""
    n = F.count(y).over(series.whole(cell))
    return rows.withColumn("_n", n).filter(F.col("_n") >= least).drop("_n")


def both_frequencies(
    rows: DataFrame, cell: Sequence[str], mean: Sequence[str], total: Sequence[str],
    last: Sequence[str],
) -> DataFrame:
    """Daily rows and Friday-ending weekly rows, tagged ``freq``."""
    used = [*cell, "date", *mean, *total, *last]
    day = rows.select(*used).withColumn("freq", F.lit("D"))
    week = series.weekly(rows, cell, mean=mean, total=total, last=last).withColumn(
        "freq", F.lit("W"))
    return day.unionByName(week.select(*used, "freq"))


def shocks(
    rows: DataFrame, cell: Sequence[str], news: Sequence[str], lag: int | str = 0,
    changes: bool = True,
) -> DataFrame:
    """News columns as z-scored first differences ``lag`` rows back, within the cell.

    ``lag`` may name a 0/1 column. A series that is unknown throughout a cell (a rule that
    never makes that label) becomes 0, which takes it out of the regression.
    """
    w, p = series.by(cell), series.whole(cell)

    def step(x: str) -> Column:
        if not changes:
            return F.col(x)
        if isinstance(lag, int):
            return series.change(F.col(x), w, lag)
        return F.when(F.col(lag) == 1, series.change(F.col(x), w, 1)).otherwise(
            series.change(F.col(x), w, 0))
    stepped = rows.withColumns({f"_{x}": step(x) for x in news})
    made = {x: F.when(F.count(f"_{x}").over(p) == 0, 0.0).otherwise(
        series.zscore(F.col(f"_{x}"), p)) for x in news}
    return stepped.withColumns(made).drop(*[f"_{x}" for x in news])


def complete(
    rows: DataFrame, cell: Sequence[str], y: str, features: Sequence[str],
    least: int = 40, per_parameter: int = 4, factor: float = 1.0,
) -> DataFrame:
    """Complete cases of cells with n >= factor * max(least, per_parameter * (k + 1)).

    ``k`` counts the features a cell really has.
    """
    kept = rows.filter(c.all_known([y, *features]))
    p = series.whole(cell)
    used = sum((F.max((F.col(f) != 0).cast("int")).over(p) for f in features), F.lit(0))
    sized = kept.withColumns({"_n": F.count("*").over(p), "_k": used})
    rule = F.greatest(F.lit(float(least)), per_parameter * (F.col("_k") + 1)) * factor
    return sized.filter(F.col("_n") >= rule).drop("_n", "_k")


def blocks_by_label(features: Sequence[str], groups: Mapping[str, Sequence[str]]) -> dict:
    """Feature names of each block, by label suffix."""
    return {
        name: [f for f in features if any(f.endswith(f"_{e}") for e in labels)]
        for name, labels in groups.items()}


LOCAL_AND_WEST = {"local": fixed.LOCAL_LABELS, "west": fixed.WESTERN_LABELS}


def label_fits(
    panel: DataFrame, windows: Windows, targets: Mapping[str, str],
    prefixes: Sequence[str] = ("att", "tone"), labels: Sequence[str] = fixed.CORE_LABELS,
    lags: Sequence[int] = (0,), extra_cell: Sequence[str] = (), control: str = "lvix",
) -> tuple[DataFrame, list[str]]:
    """The regressions of a whole grid of (window, freq, target, lag), and the names of its keys. The
    panel has one row per day (and per ``extra_cell`` value); the grid multiplies days, not facts. The
    panel is worked out once and written, as windows and both frequencies read it again."""
    news = [f"{p}_{e}" for e in labels for p in prefixes]
    used = dict.fromkeys([*extra_cell, "date", *news, *targets, *filter(None, targets.values()), control])
    panel = durable(panel.select(*used))
    base = [*extra_cell, "window", "target"]
    rows = enough_targets(per_target(in_windows(panel, windows), targets), base)
    both = both_frequencies(rows, base, mean=news, total=["y", "mkt"], last=[control])
    tagged = both.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags])))
    cell = [*base, "freq", "lag"]
    made = shocks(tagged, cell, news, lag="lag")
    made = made.withColumn(control, series.zscore(F.col(control), series.whole(cell)))
    features = [*news, "mkt", control]
    design = complete(made, cell, "y", features)
    return moments.ols_hac(design, cell, "y", features, blocks_by_label(news, LOCAL_AND_WEST), maxlags=5), cell


def label_race(panel: DataFrame, windows: Windows, targets: Mapping[str, str], **settings) -> DataFrame:
    """The joint test of local labels given the western ones, for a whole grid: n, k, r2,
    ``p_local``, ``p_west`` of each cell; see :func:`label_fits`."""
    out = moments.block_p(*label_fits(panel, windows, targets, **settings), ["local", "west"])
    return out.filter(F.col("p_local").isNotNull())


def local_terms(fits: DataFrame, cell: Sequence[str]) -> DataFrame:
    """(cell, term, coef) of the local labels."""
    local = "|".join(LOCAL_AND_WEST["local"])
    return moments.terms(fits, cell).filter(F.col("term").rlike(f"_({local})$")).select(*cell, "term", "coef")


def with_bh(grid: DataFrame, p: str = "p_local", family: Sequence[str] = ("lag",)) -> DataFrame:
    return benjamini_hochberg(grid, p, family)
