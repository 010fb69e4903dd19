"""Daily series operators.

Every window carries a partition key (series, block or cell) and runs over at most one
calendar of days, because the fact tables are reduced to days before any window starts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.window import WindowSpec

from tidewire import fixed_values as fixed
from tidewire.functions import columns as c
from tidewire.operators import intervals


def by(keys: Sequence[str] | str, order: str = "date") -> WindowSpec:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return Window.partitionBy(*keys).orderBy(order)


def whole(keys: Sequence[str] | str) -> WindowSpec:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return Window.partitionBy(*keys)


def rolling(w: WindowSpec, n: int, end: int = 0) -> WindowSpec:
    """``n`` rows ending ``end`` rows from the current one."""
    return w.rowsBetween(end - n + 1, end)


def past(w: WindowSpec, gap: int = 1) -> WindowSpec:
    """All rows at least ``gap`` before the current one."""
    return w.rowsBetween(Window.unboundedPreceding, -gap)


# --- returns and volatility ---------------------------------------------------

def log_return(x: Column, w: WindowSpec) -> Column:
    """Percent log return; NULL on a non-positive price or a missing prior."""
    prev = F.lag(x).over(w)
    return F.when((x > 0) & (prev > 0), 100.0 * F.ln(x / prev))


def rms(x: Column, w: WindowSpec, n: int) -> Column:
    """Root mean square over exactly ``n`` known rows."""
    f = rolling(w, n)
    return F.when(F.count(x).over(f) == n, F.sqrt(F.avg(x * x).over(f)))


def prior_volatility(x: Column, w: WindowSpec, n: int = 20) -> Column:
    """Sample deviation over the ``n`` rows strictly before the current one."""
    f = rolling(w, n, -1)
    return F.when(F.count(x).over(f) == n, F.stddev_samp(x).over(f))


def return_features(prices: DataFrame, key: str, price: str, n: int = 5) -> DataFrame:
    w = by(key)
    r = F.col("ret")
    return (
        prices.withColumn("ret", log_return(F.col(price), w))
        .withColumns({"vol": F.abs(r), f"rv{n}": rms(r, w, n)})
    )


def basket(returns: DataFrame, price: str = "adjclose") -> DataFrame:
    """Equal-weight daily mean return over whatever constituents exist, and how many
    quote that day."""
    return returns.groupBy("date").agg(
        F.avg("ret").alias("basket_return"), F.count(price).alias("n_constituents"))


# --- carries and calendars ---------------------------------------------------------

def carry(x: Column, w: WindowSpec, limit: int | None = None) -> Column:
    """Last known value, optionally no older than ``limit`` rows."""
    start = Window.unboundedPreceding if limit is None else -limit
    return F.last(x, ignorenulls=True).over(w.rowsBetween(start, 0))


def calendar(spark: SparkSession, start: str, end: str, name: str = "date") -> DataFrame:
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return spark.range(1).select(F.explode(days).alias(name))


def calendar_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per calendar day with regime, event time, weekend flag and dummies."""
    cal = calendar(spark, start, end).withColumn("regime", c.regime("date"))
    event = F.lit(fixed.INVASION_DATE).cast("date")
    return cal.withColumns({
        "days_since_invasion": F.datediff("date", event),
        "is_weekend": c.weekday("date") >= 5,
        "year": F.year("date"),
        **{f"regime_{n}": (F.col("regime") == n).cast("int") for n in fixed.REGIMES},
    })


def span_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """Every day between a table's first and last date."""
    ends = df.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias(date))


def attach(base: DataFrame, *parts: DataFrame, on: str = "date", how: str = "left") -> DataFrame:
    """Equality joins of daily series onto a calendar."""
    for p in parts:
        base = base.join(p, on, how)
    return base


def next_trading_day(days: DataFrame, trading: DataFrame, strict: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """For every day, the first trading day after it (or on it, if not strict), by key.

    Days meet the trading days of their month and, beyond it, the first trading day of the months
    after it. So a calendar of any length is a table of months and joins by month, and no window
    runs over more than one month of days or one calendar of months.
    """
    keys = list(keys)
    month = F.trunc("date", "month")
    open_days = trading.select(*keys, "date", month.alias("_m")).distinct()
    firsts = open_days.groupBy(*keys, "_m").agg(F.min("date").alias("_first"))
    asked_months = days.select(*keys, month.alias("_m")).distinct().withColumn("_first", F.lit(None).cast("date"))
    w = Window.partitionBy(*keys or [F.lit("calendar")]).orderBy("_m").rowsBetween(1, Window.unboundedFollowing)
    months = asked_months.unionByName(firsts).groupBy(*keys, "_m").agg(F.max("_first").alias("_first"))
    later = months.select(*keys, "_m", F.first("_first", ignorenulls=True).over(w).alias("_later"))
    both = days.select(*keys, "date", month.alias("_m"), F.lit(True).alias("_asked"), F.lit(None).cast("date").alias("_open"))
    both = both.unionByName(open_days.select(*keys, "date", "_m", F.lit(False).alias("_asked"), F.col("date").alias("_open")))
    merged = both.groupBy(*keys, "_m", "date").agg(F.bool_or("_asked").alias("_asked"), F.max("_open").alias("_open"))
    inside = Window.partitionBy(*keys, "_m").orderBy("date").rowsBetween(1 if strict else 0, Window.unboundedFollowing)
    ahead = merged.withColumn("_open", F.first("_open", ignorenulls=True).over(inside)).filter("_asked")
    return ahead.join(later, [*keys, "_m"], "left").select(*keys, "date", F.coalesce("_open", "_later").alias("trading_day"))


def weekly(
    df: DataFrame, keys: Sequence[str], mean: Sequence[str] = (), total: Sequence[str] = (),
    last: Sequence[str] = (), day_name: str = "FRI", date: str = "date",
) -> DataFrame:
    """Weeks by closing day: means, sums (0 for a week of unknowns) and last known values.

    Weeks without any row are added, so a later ``lag`` steps by weeks, not by rows:
    their sums are 0 and everything else is NULL.
    """
    week = c.week_ending(date, day_name)
    aggs = [F.avg(x).alias(x) for x in mean]
    aggs += [F.coalesce(F.sum(x), F.lit(0.0)).alias(x) for x in total]
    aggs += [F.max_by(x, F.when(F.col(x).isNotNull(), F.col(date))).alias(x) for x in last]
    grouped = df.groupBy(*keys, week.alias(date)).agg(*aggs)
    ends = grouped.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    weeks = ends.select(*keys, F.explode(
        F.sequence("_a", "_b", F.expr("interval 7 days"))).alias(date))
    dense = weeks.join(grouped, [*keys, date], "left")
    return dense.withColumns({x: F.coalesce(x, F.lit(0.0)) for x in total}) if total else dense


def three_period_fill(
    calendar_days: DataFrame, measured: DataFrame, features: Sequence[str],
) -> DataFrame:
    """Zeros before the event, unknown between the event and the first counts, and zero
    for a day without a record once counting starts. The flag marks the middle window."""
    joined = calendar_days.join(measured.select("date", *features), "date", "left")
    period = c.observation_period("date")
    filled = {
        f: F.when(period == "pre-war", 0.0)
        .when(period == "measured", F.coalesce(F.col(f).cast("double"), F.lit(0.0)))
        for f in features
    }
    return joined.withColumns({**filled, "attack_unobserved": period == "invasion"})


# --- standardising and shocks ----------------------------------------------------------

def zscore(x: Column, w: WindowSpec) -> Column:
    """(x - mean) / sd; NULL where the deviation is zero or undefined."""
    sd = F.stddev_samp(x).over(w)
    return F.when(sd > 0, (x - F.avg(x).over(w)) / sd)


def strict_zscore(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """:func:`zscore` that fails on a column without variance in any group."""
    flat = df.groupBy(*keys).agg(*[F.stddev_samp(x).alias(x) for x in columns])
    bad = flat.filter(" OR ".join(f"coalesce(`{x}`, 0) = 0" for x in columns)).limit(1).collect()
    if bad:
        raise ValueError(f"cannot standardize: zero or undefined variance in {bad[0].asDict()}")
    w = whole(keys)
    return df.withColumns({x: zscore(F.col(x), w) for x in columns})


def change(x: Column, w: WindowSpec, lag: int = 0) -> Column:
    """First difference by rows, ``lag`` rows back."""
    now = F.lag(x, lag).over(w) if lag else x
    return now - F.lag(x, lag + 1).over(w)


def surprise(x: Column, w: WindowSpec, n: int) -> Column:
    """Value against the mean of the ``n`` rows before it."""
    return x - F.avg(x).over(rolling(w, n, -1))


def smooth(x: Column, w: WindowSpec, n: int, min_rows: int) -> Column:
    f = rolling(w, n)
    return F.when(F.count(x).over(f) >= min_rows, F.avg(x).over(f))


def trailing_z(x: Column, w: WindowSpec, n: int, min_rows: int) -> Column:
    f = rolling(w, n)
    sd = F.stddev_samp(x).over(f)
    return F.when((F.count(x).over(f) >= min_rows) & (sd > 0), (x - F.avg(x).over(f)) / sd)


def anticipation(
    risk: DataFrame, key: str, window: int = 750, min_rows: int = 250, n: int = 21,
) -> DataFrame:
    """Trailing z of threat minus trailing z of act, averaged over ``n`` rows."""
    w = by(key)
    gap = (trailing_z(F.col("gpr_threat"), w, window, min_rows)
           - trailing_z(F.col("gpr_act"), w, window, min_rows))
    return risk.withColumn("gap", gap).withColumn(
        "score", smooth(F.col("gap"), w, n, n)).drop("gap")


def compounded(x: Column, w: WindowSpec) -> Column:
    """100 times the running product of (1 + r/100)."""
    return 100.0 * F.exp(F.sum(F.ln(1.0 + x / 100.0)).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))


def forward_sum(x: Column, w: WindowSpec, h: int) -> Column:
    """Sum of ``h`` rows from the current one; NULL when one is missing."""
    f = w.rowsBetween(0, h - 1)
    return F.when(F.count(x).over(f) == h, F.sum(x).over(f))


def forward_change(x: Column, w: WindowSpec, h: int) -> Column:
    return F.lead(x, h).over(w) - x


def har_terms(log_variance: Column, w: WindowSpec, h: int = 1) -> dict[str, Column]:
    """Daily, weekly and monthly means of log variance known ``h`` rows ahead.

    An ``h``-row target ending at row t-h is the last one fully realised at t, so every
    term steps back by ``h``, not by one.
    """
    def mean(n: int) -> Column:
        f = rolling(w, n, -h)
        return F.when(F.count(log_variance).over(f) == n, F.avg(log_variance).over(f))
    return {"l1": F.lag(log_variance, h).over(w), "l5": mean(5), "l22": mean(22)}


def own_dynamics(x: Column, w: WindowSpec, lags: int, name: str = "out") -> dict[str, Column]:
    """Lags 0..p-1 of the level and of its change."""
    out = {}
    for k in range(lags):
        out[f"{name}_l{k}"] = F.lag(x, k).over(w)
        out[f"d{name}_l{k}"] = F.lag(x, k).over(w) - F.lag(x, k + 1).over(w)
    return out


def drop_extremes(df: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """Leave out the ``k`` largest absolute values of each cell; unknown values stay."""
    if k <= 0:
        return df
    order = [F.abs(value).desc_nulls_last(), F.asc("date")]
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_move", F.row_number().over(w))
    return ranked.filter((F.col("_move") > k) | F.col(value).isNull()).drop("_move")


# --- blocks and episodes -----------------------------------------------------------------

def blocks(df: DataFrame, key: str, max_gap_days: int = 7) -> DataFrame:
    """Contiguous blocks: a jump of more than ``max_gap_days`` starts a new one."""
    w = by(key)
    jump = F.datediff("date", F.lag("date").over(w)) > max_gap_days
    started = F.coalesce(jump.cast("int"), F.lit(0))
    return df.withColumn("_jump", started).withColumn(
        "block", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    ).drop("_jump")


def long_blocks(df: DataFrame, key: str, min_rows: int) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(key, "block"))
    return df.withColumn("_n", n).filter(F.col("_n") >= min_rows).drop("_n")


def episodes(
    scores: DataFrame, key: str, threshold: float = 0.5, min_days: int = 30,
    merge_gap: int = 21,
) -> DataFrame:
    """Runs above a threshold, runs close in time merged, short ones dropped.

    Rows are tagged by windows alone. An above row opens an episode when the row before it
    is not above and the last above row lies more than ``merge_gap`` calendar days back.
    Dips up to the episode's last above row count as part of it.
    """
    w = by(key)
    known = scores.filter(F.col("score").isNotNull())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    tagged = known.withColumn("above", F.col("score") > threshold).withColumns({
        "prev_above": F.lag("above").over(w),
        "last_above": F.max(F.when(F.col("above"), F.col("date"))).over(before),
    })
    opens = F.col("above") & ~F.coalesce("prev_above", F.lit(False)) & (
        F.col("last_above").isNull()
        | (F.datediff("date", "last_above") > merge_gap))
    numbered = tagged.withColumn("opens", opens.cast("int")).withColumn(
        "episode", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = numbered.filter(F.col("episode") > 0).withColumn(
        "end", F.max(F.when(F.col("above"), F.col("date"))).over(whole([key, "episode"])))
    rows = inside.filter(F.col("date") <= F.col("end"))
    out = rows.groupBy(key, "episode").agg(
        F.min("date").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_days"),
        F.max("score").alias("peak"), F.avg("score").alias("mean"))
    return out.filter(F.col("n_days") >= min_days).drop("episode")


def label_episodes(found: DataFrame, known: DataFrame) -> DataFrame:
    """Names of known dates inside each episode, joined by ``; `` in date order; ``known`` is
    (name, known_date)."""
    spans = found.select("start", "end").distinct()
    hits = intervals.within(known, spans, ["start", "end"], "known_date")
    names = hits.groupBy("start", "end").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("known_date", "name"))), lambda p: p["name"]), "; ").alias("label"))
    return found.join(names, ["start", "end"], "left").select(*found.columns, F.coalesce("label", F.lit("")).alias("label"))


def episode_days(found: DataFrame) -> DataFrame:
    """The days inside episodes, for equality joins: semi keeps them, anti leaves them out."""
    return found.select(F.explode(F.sequence("start", "end")).alias("date")).distinct()


# --- expanding forecasts ----------------------------------------------------------------------

def expanding_mean(y: Column, w: WindowSpec, gap: int = 1) -> Column:
    return F.avg(y).over(past(w, gap))


def expanding_ols(
    y: Column, x: Column, w: WindowSpec, gap: int = 1, min_pairs: int = 30,
) -> Column:
    """One-predictor forecast from all rows at least ``gap`` back; the expanding mean when
    there are too few pairs, the predictor is unknown, or it has no variance."""
    f = past(w, gap)
    usable = (F.regr_count(y, x).over(f) >= min_pairs) & x.isNotNull() & (
        F.regr_sxx(y, x).over(f) > 0)
    slope, level = F.regr_slope(y, x).over(f), F.regr_intercept(y, x).over(f)
    return F.when(usable, level + slope * x).otherwise(F.avg(y).over(f))


def ar1(
    df: DataFrame, key: str | Sequence[str], y: str, h: int = 1, name: str = "ar1",
    min_pairs: int = 30,
) -> DataFrame:
    """AR(1) for an ``h``-row target: the predictor is the last fully realised one, and
    the fit uses rows whose own target is realised."""
    w = by(key)
    lagged = df.withColumn("_lag", F.lag(y, h).over(w))
    fit = expanding_ols(F.col(y), F.col("_lag"), w, gap=h, min_pairs=min_pairs)
    return lagged.withColumn(name, fit).drop("_lag")
