"""Composed panels, kept as named jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewire import fixed_values as fixed
from tidewire.functions import columns as c
from tidewire.operators import series


def perception_indices(
    daily: DataFrame, labels: Sequence[str] = fixed.CORE_LABELS,
) -> DataFrame:
    """Long daily table to wide ``att_ tone_ vol_`` series, one row per day.

    The pivot values are given, so no extra pass looks for them, and a label without rows
    still gets its columns.
    """
    measures = {"att": "share", "tone": "tone_conflict", "vol": "n_conflict"}
    picks = [
        F.max(F.when(F.col("ecosystem") == e, F.col(v))).alias(f"{p}_{e}")
        for p, v in measures.items() for e in labels]
    # The label test sits above the aggregate: below it, the optimizer would push it into
    # the fact scan and every article would work out its label twice.
    wanted = F.count_if(F.col("ecosystem").isin(list(labels)))
    wide = daily.groupBy(F.col("day").alias("date")).agg(*picks, wanted.alias("_n"))
    return wide.filter(F.col("_n") > 0).drop("_n")


def threat_act_indices(daily: DataFrame, labels: Sequence[str] = fixed.CORE_LABELS) -> DataFrame:
    """Long threat/act table to wide ``act_ thr_`` shares."""
    measures = {"act": "act_share", "thr": "threat_share"}
    picks = [
        F.max(F.when(F.col("ecosystem") == e, F.col(v))).alias(f"{p}_{e}")
        for e in labels for p, v in measures.items()]
    return daily.groupBy(F.col("day").alias("date")).agg(*picks)


def macro_spine(
    spark: SparkSession, start: str, end: str, risk: DataFrame, rates: DataFrame,
) -> DataFrame:
    """Calendar with risk and rate series carried forward; the freshness flag is set
    before the carry, so it marks rows with a new observation."""
    spine = series.attach(series.calendar_spine(spark, start, end), risk, rates)
    carried = [x for x in (*risk.columns, *rates.columns) if x != "date"]
    flagged = spine.withColumns({
        "is_fresh_obs": F.coalesce(*carried).isNotNull(), "spine": F.lit("macro")})
    w = series.by("spine")
    return flagged.withColumns({x: series.carry(F.col(x), w) for x in carried}).drop("spine")


def equity_panel(
    prices: DataFrame, baskets: dict[str, Sequence[str]], funds: dict[str, str],
    benchmarks: dict[str, str], levels: dict[str, str], risk: DataFrame,
    start: str, end: str, required: Sequence[str],
) -> DataFrame:
    """Baskets with contributor counts, fund and benchmark returns, level series; then the
    risk index carried at most four rows, the regime, the window and complete cases.

    Every ticker belongs to a named set, so the whole table is one conditional
    aggregation by date instead of a chain of joins.
    """
    w = series.by("ticker")
    rows = prices.withColumn("ret", series.log_return(F.col("adjclose"), w))
    picks = []
    for name, members in baskets.items():
        mine = F.col("ticker").isin(list(members))
        picks.append(F.avg(F.when(mine, F.col("ret"))).alias(name))
        picks.append(F.count(F.when(mine, F.col("adjclose"))).alias(f"n_{name}"))
    for name, ticker in {**funds, **benchmarks}.items():
        picks.append(F.max(F.when(F.col("ticker") == ticker, F.col("ret"))).alias(name))
    for name, ticker in levels.items():
        picks.append(F.max(F.when(F.col("ticker") == ticker, F.col("adjclose"))).alias(name))
    wide = rows.groupBy("date").agg(*picks).join(risk, "date", "left")
    inside = wide.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    inside = inside.withColumn("panel", F.lit("equity"))
    p = series.by("panel")
    measures = [x for x in risk.columns if x != "date"]
    out = inside.withColumns({x: series.carry(F.col(x), p, 4) for x in measures})
    return out.withColumn("regime", c.regime("date")).dropna(subset=list(required)).drop("panel")


def index_panel(
    indices: DataFrame, names: Sequence[str], risk: DataFrame, market: DataFrame,
    start: str, end: str,
) -> DataFrame:
    """Index levels with returns and volatilities, risk and market carried four rows, the
    market return, log lagged volatility and the regime."""
    one = indices.withColumn("panel", F.lit("index"))
    w = series.by("panel")
    one = one.withColumns({f"r_{n}": series.log_return(F.col(n), w) for n in names})
    one = one.withColumns({f"vol_{n}": F.abs(f"r_{n}") for n in names})
    joined = series.attach(one, risk, market)
    cut = joined.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    carried = [x for x in (*risk.columns, *market.columns) if x != "date"]
    cut = cut.withColumns({x: series.carry(F.col(x), w, 4) for x in carried})
    cut = cut.withColumns({
        "r_mkt": series.log_return(F.col("spx"), w),
        "lvix": F.lag(c.positive_log(F.col("vix"))).over(w),
        "regime": c.regime("date"),
    })
    needed = [f"r_{n}" for n in names] + ["gpr_act", "gpr_threat"]
    return cut.dropna(subset=needed).drop("panel")


def asset_panel(
    indices: DataFrame, returns: DataFrame, tickers: Sequence[str], levels: DataFrame,
) -> DataFrame:
    """News indices joined to one return column per asset and to level controls."""
    wide = returns.groupBy("date").agg(*[
        F.max(F.when(F.col("ticker") == t, F.col("ret"))).alias(t) for t in tickers])
    joined = indices.join(wide, "date").join(levels, "date").withColumn("panel", F.lit("asset"))
    w = series.by("panel")
    return joined.withColumn("lvix", F.lag(c.positive_log(F.col("vix"))).over(w)).drop("panel")


GAPS = {
    "ua_west": ("UA", "WEST"), "ru_west": ("RU_STATE", "WEST"), "ua_ru": ("UA", "RU_STATE"),
    "state_indep": ("RU_STATE", "RU_INDEP"),
}


def model_panel(
    trading: DataFrame, returns: Sequence[str], levels: Sequence[str], indices: DataFrame,
    physical: DataFrame,
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Everything lagged, and the feature names of each information set.

    Sets are nested by construction: F in P and N, P in PN, PN in PNG.
    """
    news = [x for x in indices.columns if x.startswith(("att_", "tone_"))]
    phys = [x for x in physical.columns if x not in ("date", "attack_unobserved")]
    d = series.attach(trading, indices, physical).withColumns({
        "panel": F.lit("model"), "regime": c.regime("date")})
    w = series.by("panel")
    made = {}
    fin: list[str] = []
    for x in returns:
        for k in (1, 5):
            made[f"{x}_lag{k}"] = F.lag(x, k).over(w)
            fin.append(f"{x}_lag{k}")
    for x in levels:
        made[f"{x}_lag1"] = F.lag(x, 1).over(w)
        fin.append(f"{x}_lag1")
    for n in fixed.REGIMES:
        made[f"regime_{n}"] = (F.col("regime") == n).cast("double")
        fin.append(f"regime_{n}")
    for x in news:
        made[f"{x}_d1"] = series.change(F.col(x), w, 1)
    for x in phys:
        made[f"{x}_lag1"] = F.lag(x, 1).over(w)
    for name, (a, b) in GAPS.items():
        made[f"gap_{name}_lag1"] = F.lag(F.col(f"tone_{a}") - F.col(f"tone_{b}")).over(w)
    p = [f"{x}_lag1" for x in phys]
    n = [f"{x}_d1" for x in news]
    g = [f"gap_{k}_lag1" for k in GAPS]
    sets = {"F": fin, "P": fin + p, "N": fin + n, "PN": fin + p + n, "PNG": fin + p + n + g}
    return d.withColumns(made).drop("panel"), sets


def information_sets(spark: SparkSession, sets: dict[str, list[str]]) -> DataFrame:
    rows = [(name, f) for name, features in sets.items() for f in features]
    return spark.createDataFrame(rows, "info_set string, feature string")


def nesting_violations(sets: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Features of the smaller set that the larger one lacks; no rows means nested."""
    spark = sets.sparkSession
    want = spark.createDataFrame(list(pairs), "small string, large string")
    small = want.join(sets, F.col("small") == F.col("info_set")).select("small", "large", "feature")
    large = sets.select(F.col("info_set").alias("large"), "feature")
    return small.join(large, ["large", "feature"], "left_anti")
