"""Coverage, descriptive and reconciliation tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tidewire.functions import columns as c
from tidewire.operators import labelling, series


def coverage_report(df: DataFrame, columns: Sequence[str], date: str = "date") -> DataFrame:
    """Known rows, percent, first and last known date of each column, in one pass."""
    long = labelling.to_long(df, [date], columns)
    known = F.col("value").isNotNull()
    return long.groupBy(F.col("feature").alias("column")).agg(
        F.count("value").alias("n_non_null"),
        F.round(100.0 * F.count("value") / F.count("*"), 2).alias("pct_covered"),
        F.min(F.when(known, F.col(date))).alias("first_date"),
        F.max(F.when(known, F.col(date))).alias("last_date"),
    )


def descriptives(df: DataFrame, columns: Sequence[str], date: str = "date") -> DataFrame:
    """Mean, sd, min, max, n and span of every column, in levels and first changes."""
    long = labelling.to_long(df, [date], columns)
    w = series.by("feature", date)
    both = long.withColumn("change", series.change(F.col("value"), w)).select(
        date, "feature", F.inline(F.array(
            F.struct(F.lit("level").alias("form"), F.col("value").alias("x")),
            F.struct(F.lit("change").alias("form"), F.col("change").alias("x")))))
    return both.filter(F.col("x").isNotNull()).groupBy("feature", "form").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"),
        F.min("x").alias("low"), F.max("x").alias("high"),
        F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def event_shift(df: DataFrame, keys: Sequence[str], value: str, event: str,
                day: str = "day") -> DataFrame:
    """Mean before and from an event day per group."""
    after = F.col(day) >= F.lit(event).cast("date")
    return df.groupBy(*keys).agg(
        F.avg(F.when(~after, F.col(value))).alias("before"),
        F.avg(F.when(after, F.col(value))).alias("after"),
    ).withColumn("shift", F.col("after") - F.col("before"))


def reconcile(found: DataFrame, expected: Mapping[str, float]) -> DataFrame:
    """One-row totals against published values: (name, found, published, matches)."""
    pairs = F.array(*[
        F.struct(F.lit(k).alias("name"), F.col(k).cast("double").alias("found"),
                 F.lit(float(v)).alias("published")) for k, v in expected.items()])
    rows = found.select(F.inline(pairs))
    return rows.withColumn("matches", F.col("found").eqNullSafe(F.col("published")))


def regime_structure(df: DataFrame, act: str, threat: str, extra: Sequence[str] = ()) -> DataFrame:
    """Means, threat-to-act ratio, and level and change correlations per regime.

    Changes are taken within the regime, so none spans a boundary.
    """
    w = series.by("regime")
    changed = df.withColumns({
        "d_act": series.change(F.col(act), w), "d_threat": series.change(F.col(threat), w)})
    return changed.groupBy("regime").agg(
        F.count("*").alias("n"), F.avg(act).alias("act"), F.avg(threat).alias("threat"),
        F.try_divide(F.avg(threat), F.avg(act)).alias("threat_act_ratio"),
        F.corr(act, threat).alias("corr_levels"),
        F.corr("d_act", "d_threat").alias("corr_changes"),
        *[F.avg(x).alias(f"mean_{x}") for x in extra])


def pairwise_correlations(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (),
) -> DataFrame:
    """Pairwise-complete correlations of every unordered pair, from one aggregation.

    ``corr`` skips rows where either side is unknown, so each pair keeps its own rows.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    aggs = [x for i, (a, b) in enumerate(pairs) for x in (
        F.corr(a, b).alias(f"c{i}"),
        F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n{i}"))]
    wide = df.groupBy(*keys).agg(*aggs)
    return wide.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                 F.col(f"c{i}").alias("corr"), F.col(f"n{i}").alias("n"))
        for i, (a, b) in enumerate(pairs)])))


def histogram(df: DataFrame, value: str, keys: Sequence[str], bins: int = 60) -> DataFrame:
    """Equal-width bins over the observed range; the top edge belongs to the last bin."""
    known = df.filter(F.col(value).isNotNull())
    ends = known.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    with_ends = known.join(ends, list(keys))
    raw = F.floor((F.col(value) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo")))
    slot = F.when(F.col("_hi") > F.col("_lo"), F.least(raw, F.lit(bins - 1))).otherwise(F.lit(0))
    return with_ends.groupBy(*keys, slot.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def duplicate_targets(df: DataFrame, value: str, date: str, digits: int = 10) -> DataFrame:
    """How many distinct values repeat, and the share of weekend rows."""
    repeated = df.filter(F.col(value).isNotNull()).groupBy(F.round(value, digits)).count()
    twice = repeated.agg(F.count_if(F.col("count") > 1).alias("n_repeated"))
    rows = df.agg(F.count("*").alias("n_rows"),
                  F.count_if(c.weekday(date) >= 5).alias("n_weekend"))
    both = rows.select(
        F.inline(F.array(
            F.struct(F.lit("rows").alias("measure"), F.col("n_rows").alias("value")),
            F.struct(F.lit("weekend_rows").alias("measure"), F.col("n_weekend").alias("value")))))
    return both.unionByName(twice.select(
        F.lit("repeated_values").alias("measure"), F.col("n_repeated").alias("value")))


def best_per_cell(
    df: DataFrame, cell: Sequence[str], score: str, model: Sequence[str], lowest: bool = True,
) -> DataFrame:
    """Best model of each cell; ties go to the first name."""
    signed = F.col(score) if lowest else -F.col(score)
    order = F.struct(signed, *model)
    known = df.filter(F.col(score).isNotNull())
    best = known.groupBy(*cell).agg(F.min_by(F.struct(*model, score), order).alias("best"))
    return best.select(*cell, "best.*")


def win_counts(best: DataFrame, model: Sequence[str]) -> DataFrame:
    return best.groupBy(*model).agg(F.count("*").alias("wins"))


def monthly_observed_share(df: DataFrame, value: str, date: str = "date") -> DataFrame:
    return df.groupBy(F.last_day(date).alias("month_end")).agg(
        F.avg(F.col(value).isNotNull().cast("double")).alias("share"))


def weekly_sum(df: DataFrame, value: str, date: str = "date", day_name: str = "SUN") -> DataFrame:
    """Weekly sums that stay NULL for a week without any known value."""
    return df.groupBy(c.week_ending(date, day_name).alias("week")).agg(F.sum(value).alias("total"))

