"""Calendars, carries, windows, episodes and descriptive tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire import fixed_values as fixed
from tidewire.functions import columns as c
from tidewire.operators import reports, series
from tidewire.plans.queries.articles import DAILY_RAW, DAILY_SQL
from tidewire.plans.queries.sources import EVENTS_SQL, RATES_SQL, event_table, rate_parts
from tidewire.plans.registry import query
from tidewire.plans.sqltext import r, rr
from tidewire.sources import markets


def W():
    """Window over one ticker by date."""
    return series.by("ticker")


RET = """SELECT ticker, date, adjclose,
  CASE WHEN adjclose > 0 AND lag(adjclose) OVER w > 0
       THEN 100 * ln(adjclose / lag(adjclose) OVER w) END AS ret
FROM {prices} WINDOW w AS (PARTITION BY ticker ORDER BY date)"""
FRIDAY = "(d + CAST((12 - dayofweek(d)) % 7 AS INTEGER))"


def returns(x):
    return x.view("prices").withColumn("ret", series.log_return(F.col("adjclose"), W()))


def rounded(df, digits, *columns):
    return df.withColumns({k: r(F.col(k), digits) for k in columns})


@query("E1", f"SELECT ticker, date, {rr('ret', 6)} AS ret FROM ({RET})")
def log_returns(x):
    return rounded(returns(x).select("ticker", "date", "ret"), 6, "ret")


@query("E2", f"""
SELECT ticker, date, {rr('abs(ret)', 6)} AS vol, {rr('''CASE WHEN count(ret) OVER f = 5
  THEN sqrt(avg(ret * ret) OVER f) END''', 6)} AS rv5
FROM ({RET}) WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
""")
def return_volatility(x):
    out = series.return_features(x.view("prices"), "ticker", "adjclose", 5)
    return rounded(out.select("ticker", "date", "vol", "rv5"), 6, "vol", "rv5")


@query("E3 Q8", f"""
SELECT ticker, date, {rr('CASE WHEN count(ret) OVER f = 20 THEN stddev_samp(ret) OVER f END', 6)} AS rv
FROM ({RET}) WINDOW f AS (PARTITION BY ticker ORDER BY date
  ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
""")
def prior_volatility(x):
    out = returns(x).withColumn("rv", series.prior_volatility(F.col("ret"), W(), 20))
    return rounded(out.select("ticker", "date", "rv"), 6, "rv")


@query("D9", f"""
SELECT date, {rr('avg(ret)', 6)} AS basket_return, count(adjclose) AS n_constituents
FROM ({RET}) GROUP BY date
""")
def basket_returns(x):
    return rounded(series.basket(returns(x)), 6, "basket_return")


SPINE_DAYS = """SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
FROM {risk}"""
RATE_MAX = ", ".join(f"max(value) FILTER (WHERE series = '{n}') AS {n}"
                     for n in fixed.RATE_NAMES.values())
CARRIED = ["gpr", "gpr_act", "gpr_threat", *fixed.RATE_NAMES.values()]
MACRO_SQL = f"""
WITH cal AS ({SPINE_DAYS}), rates AS (SELECT date, {RATE_MAX} FROM ({RATES_SQL}) GROUP BY date),
j AS (SELECT * FROM cal LEFT JOIN {{risk}} USING (date) LEFT JOIN rates USING (date))
SELECT date, {' OR '.join(f'{k} IS NOT NULL' for k in CARRIED)} AS is_fresh_obs,
  {', '.join(f'last_value({k} IGNORE NULLS) OVER w AS {k}' for k in CARRIED)}
FROM j WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""


def macro_spine(x):
    from tidewire.plans import panels
    rates = markets.rate_panel(rate_parts(x), list(fixed.RATE_NAMES.values()))
    ends = x.view("risk").agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    return panels.macro_spine(x.spark, str(ends["a"]), str(ends["b"]), x.view("risk"), rates)


@query("K1 C1 C4", MACRO_SQL)
def macro_spine_panel(x):
    return macro_spine(x).select("date", "is_fresh_obs", *CARRIED)


@query("D12 K1", f"""
SELECT "column", count(v) AS n_non_null, round(100.0 * count(v) / count(*), 2) AS pct_covered,
  min(CASE WHEN v IS NOT NULL THEN date END) AS first_date,
  max(CASE WHEN v IS NOT NULL THEN date END) AS last_date
FROM ({' UNION ALL '.join(f"SELECT date, '{k}' AS column, {k} AS v FROM ({MACRO_SQL})" for k in CARRIED)})
GROUP BY 1
""".replace("AS column", 'AS "column"'))
def spine_coverage(x):
    return reports.coverage_report(macro_spine(x), CARRIED)


@query("C5", f"""
SELECT date, last_value(gpr IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
  AS gpr FROM ({SPINE_DAYS}) LEFT JOIN (SELECT date, CASE WHEN gpr > 26.5 THEN gpr END AS gpr FROM {{risk}}) USING (date)
""")
def carry_four_rows(x):
    cal = series.span_calendar(x.view("risk"))
    sparse = x.view("risk").selectExpr("date", "IF(gpr > 26.5, gpr, NULL) AS gpr")
    joined = series.attach(cal, sparse).withColumn("series", F.lit("gpr"))
    out = joined.withColumn("gpr", series.carry(F.col("gpr"), series.by("series"), 4))
    return out.select("date", "gpr")


@query("C2", f"""
SELECT ticker, r.date, {rr('ret', 6)} AS ret, spx FROM ({RET}) r JOIN {{market}} m ON r.date = m.date
WHERE ret IS NOT NULL AND spx IS NOT NULL
""")
def inner_aligned(x):
    mine = returns(x).select("ticker", "date", "ret")
    both = mine.join(x.view("market").select("date", "spx"), "date").dropna(subset=["ret", "spx"])
    return rounded(both, 6, "ret")


@query("E4 E5", f"""
SELECT series, date, {rr('CASE WHEN sd > 0 THEN (d - m) / sd END', 6)} AS shock FROM (
  SELECT *, avg(d) OVER p AS m, stddev_samp(d) OVER p AS sd FROM (
    SELECT series, date, lag(value, 1) OVER w - lag(value, 2) OVER w AS d FROM {{rates}}
    WINDOW w AS (PARTITION BY series ORDER BY date)) WINDOW p AS (PARTITION BY series))
""")
def lagged_shocks(x):
    w = series.by("series")
    d = x.view("rates").withColumn("d", series.change(F.col("value"), w, 1))
    out = d.withColumn("shock", series.zscore(F.col("d"), series.whole("series")))
    return rounded(out.select("series", "date", "shock"), 6, "shock")


def _z(col: str) -> str:
    return (f"CASE WHEN count({col}) OVER f >= 250 AND stddev_samp({col}) OVER f > 0 "
            f"THEN ({col} - avg({col}) OVER f) / stddev_samp({col}) OVER f END")


SCORE_SQL = f"""
SELECT series, date, CASE WHEN count(gap) OVER s = 21 THEN avg(gap) OVER s END AS score FROM (
  SELECT 'risk' AS series, date, {_z('gpr_threat')} - {_z('gpr_act')} AS gap FROM {{risk}}
  WINDOW f AS (ORDER BY date ROWS BETWEEN 749 PRECEDING AND CURRENT ROW))
WINDOW s AS (PARTITION BY series ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)
"""


def scores(x):
    return series.anticipation(x.view("risk").withColumn("series", F.lit("risk")), "series")


@query("E6", f"SELECT series, date, {rr('score', 6)} AS score FROM ({SCORE_SQL})")
def anticipation_score(x):
    return rounded(scores(x).select("series", "date", "score"), 6, "score")


EPISODES_SQL = f"""
WITH s AS (SELECT series, date, round(score, 6) AS score FROM ({SCORE_SQL}) WHERE score IS NOT NULL),
a AS (SELECT *, score > 0.02 AS above, coalesce(lag(score > 0.02) OVER w, false) AS prev FROM s
      WINDOW w AS (PARTITION BY series ORDER BY date)),
g AS (SELECT *, sum(CASE WHEN above <> prev THEN 1 ELSE 0 END) OVER w AS run FROM a
      WINDOW w AS (PARTITION BY series ORDER BY date)),
runs AS (SELECT series, run, min(date) AS s, max(date) AS e FROM g WHERE above GROUP BY 1, 2),
m AS (SELECT *, sum(CASE WHEN s - p <= 21 THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY s)
        AS k FROM (SELECT *, lag(e) OVER (PARTITION BY series ORDER BY s) AS p FROM runs)),
ep AS (SELECT series, k, min(s) AS start, max(e) AS "end" FROM m GROUP BY 1, 2)
SELECT ep.series, ep.start, ep."end", count(*) AS n_days, max(score) AS peak, avg(score) AS mean
FROM ep JOIN s ON s.series = ep.series AND s.date BETWEEN ep.start AND ep."end"
GROUP BY 1, 2, 3 HAVING count(*) >= 30
"""


def found_episodes(x):
    rows = scores(x).withColumn("score", F.round("score", 6))
    return series.episodes(rows, "series", threshold=0.02, min_days=30)


@query("E7 Q5", f"SELECT * REPLACE ({rr('peak', 6)} AS peak, {rr('mean', 5)} AS mean) FROM ({EPISODES_SQL})")
def anticipation_episodes(x):
    return rounded(rounded(found_episodes(x), 6, "peak"), 5, "mean")


KNOWN_VALUES = ", ".join(f"('{n}', DATE '{d}')" for n, d in fixed.KNOWN_EVENTS.items())


@query("C6", f"""
SELECT e.start, e."end", coalesce(string_agg(k.name, '; ' ORDER BY k.day, k.name), '') AS label
FROM ({EPISODES_SQL}) e LEFT JOIN (VALUES {KNOWN_VALUES}) k(name, day)
  ON k.day BETWEEN e.start AND e."end" GROUP BY 1, 2
""")
def episode_labels(x):
    known = x.spark.createDataFrame(list(fixed.KNOWN_EVENTS.items()), "name string, d string")
    known = known.select("name", F.to_date("d").alias("known_date"))
    return series.label_episodes(found_episodes(x), known).select("start", "end", "label")


@query("C7", f"""
SELECT inside, count(*) AS n, count(DISTINCT ticker) AS n_tickers FROM (
  SELECT ticker, EXISTS (SELECT 1 FROM ({EPISODES_SQL}) e WHERE p.date BETWEEN e.start AND e."end")
    AS inside FROM {{prices}} p) GROUP BY 1
""")
def episode_split(x):
    days = series.episode_days(found_episodes(x))
    prices = x.view("prices")
    parts = [
        prices.join(days, "date", how).groupBy(F.lit(flag).alias("inside")).agg(
            F.count("*").alias("n"), F.count_distinct("ticker").alias("n_tickers"))
        for how, flag in (("left_semi", True), ("left_anti", False))]
    return parts[0].unionByName(parts[1])


@query("E8", """
SELECT ticker, block, count(*) AS n, min(date) AS first_day, max(date) AS last_day FROM (
  SELECT *, CAST(sum(CASE WHEN date - p > 4 THEN 1 ELSE 0 END) OVER
      (PARTITION BY ticker ORDER BY date) AS INTEGER) AS block
  FROM (SELECT ticker, date, lag(date) OVER (PARTITION BY ticker ORDER BY date) AS p
        FROM {firm_prices})) GROUP BY 1, 2 HAVING count(*) >= 12
""")
def contiguous_blocks(x):
    cut = series.long_blocks(series.blocks(x.view("firm_prices"), "ticker", 4), "ticker", 12)
    return cut.groupBy("ticker", "block").agg(
        F.count("*").alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query("E9 E10", f"""
SELECT ticker, date, {rr('CASE WHEN count(ret) OVER f = 5 THEN sum(ret) OVER f END', 6)} AS y5,
  {rr('lead(adjclose, 5) OVER w - adjclose', 4)} AS change5, {rr('lead(ret) OVER w', 6)} AS lead1
FROM ({RET}) WINDOW w AS (PARTITION BY ticker ORDER BY date),
  f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
""")
def forward_targets(x):
    out = returns(x).withColumns({
        "y5": series.forward_sum(F.col("ret"), W(), 5),
        "change5": series.forward_change(F.col("adjclose"), W(), 5),
        "lead1": F.lead("ret", 1).over(W())})
    return rounded(rounded(out.select("ticker", "date", "y5", "change5", "lead1"), 6, "y5", "lead1"),
                   4, "change5")


def _back_mean(n: int, h: int) -> str:
    over = (f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n + h - 1} PRECEDING "
            f"AND {h} PRECEDING)")
    return rr(f"CASE WHEN count(lv) {over} = {n} THEN avg(lv) {over} END", 6)


@query("E11 Q1", f"""
SELECT ticker, date, {rr('lag(lv, 5) OVER w', 6)} AS l1, {_back_mean(5, 5)} AS l5,
  {_back_mean(22, 5)} AS l22
FROM (SELECT ticker, date, ln(greatest(v, 1e-12)) AS lv FROM (
  SELECT *, CASE WHEN count(ret) OVER f = 5 THEN sum(ret * ret) OVER f END AS v FROM ({RET})
  WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)))
WINDOW w AS (PARTITION BY ticker ORDER BY date)
""".replace("greatest(v, 1e-12)", "CASE WHEN v IS NOT NULL THEN greatest(v, 1e-12) END"))
def har_predictors(x):
    rows = returns(x).withColumn("sq", F.col("ret") * F.col("ret"))
    rows = rows.withColumn("v", series.forward_sum(F.col("sq"), W(), 5))
    rows = rows.withColumn("lv", F.ln(F.when(F.col("v").isNotNull(),
                                             F.greatest(F.col("v"), F.lit(1e-12)))))
    out = rows.withColumns(series.har_terms(F.col("lv"), W(), 5))
    return rounded(out.select("ticker", "date", "l1", "l5", "l22"), 6, "l1", "l5", "l22")


@query("E12", f"""
SELECT date, {', '.join(f"lag(gpr, {k}) OVER w AS out_l{k}, {rr(f'lag(gpr, {k}) OVER w - lag(gpr, {k + 1}) OVER w', 6)} AS dout_l{k}" for k in range(3))}
FROM {{risk}} WINDOW w AS (ORDER BY date)
""")
def own_dynamics(x):
    df = x.view("risk").withColumn("series", F.lit("risk"))
    out = df.withColumns(series.own_dynamics(F.col("gpr"), series.by("series"), 3))
    cols = [f"{p}_l{k}" for k in range(3) for p in ("out", "dout")]
    return rounded(out.select("date", *cols), 6, *[f"dout_l{k}" for k in range(3)])


@query("E13", f"""
SELECT date, {rr('CASE WHEN count(gpr_act) OVER f >= 20 THEN avg(gpr_act) OVER f END', 6)} AS smooth
FROM (SELECT date, CASE WHEN gpr_act > 24 THEN gpr_act END AS gpr_act
      FROM ({SPINE_DAYS}) LEFT JOIN {{risk}} USING (date))
WINDOW f AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
""")
def smoothed_series(x):
    cal = series.span_calendar(x.view("risk"))
    some = x.view("risk").select("date", F.when(F.col("gpr_act") > 24, F.col("gpr_act")).alias("v"))
    df = series.attach(cal, some).withColumn("series", F.lit("risk"))
    out = df.withColumn("smooth", series.smooth(F.col("v"), series.by("series"), 30, 20))
    return rounded(out.select("date", "smooth"), 6, "smooth")


@query("E14", f"""
SELECT ticker, date, {rr('100 * exp(sum(ln(1 + ret / 1000 / 100)) OVER (PARTITION BY ticker ORDER BY date))', 5)}
  AS level FROM ({RET}) WHERE ret IS NOT NULL
""")
def compounded_index(x):
    rows = returns(x).filter("ret IS NOT NULL")
    out = rows.withColumn("level", series.compounded(F.col("ret") / 1000.0, W()))
    return rounded(out.select("ticker", "date", "level"), 5, "level")


@query("E18", f"""
SELECT day, {', '.join(f"{rr(f'launched_total - avg(launched_total) OVER (ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)', 6)} AS surprise_{n}" for n in (7, 30, 90))},
  coalesce(launched_total > avg(launched_total) OVER f + 2 * stddev_samp(launched_total) OVER f, false)
    AS large_attack, {rr('CASE WHEN launched_total > 0 THEN launched_uav::DOUBLE / launched_total END', 8)}
    AS uav_share
FROM ({EVENTS_SQL}) WINDOW f AS (ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)
""")
def attack_surprises(x):
    df = event_table(x).withColumn("series", F.lit("attacks"))
    w, total = series.by("series", "day"), F.col("launched_total")
    f = series.rolling(w, 30, -1)
    out = df.withColumns({f"surprise_{n}": series.surprise(total, w, n) for n in (7, 30, 90)})
    out = out.withColumns({
        "large_attack": F.coalesce(
            total > F.avg(total).over(f) + 2 * F.stddev_samp(total).over(f), F.lit(False)),
        "uav_share": F.try_divide("launched_uav", "launched_total")})
    names = [f"surprise_{n}" for n in (7, 30, 90)]
    return rounded(rounded(out.select("day", *names, "large_attack", "uav_share"), 6, *names),
                   8, "uav_share")


@query("E19", f"""
SELECT date, CASE WHEN date < DATE '2022-02-24' THEN 0.0
    WHEN date >= DATE '2022-09-29' THEN coalesce(CAST(launched_total AS DOUBLE), 0.0) END AS launched_total,
  date >= DATE '2022-02-24' AND date < DATE '2022-09-29' AS attack_unobserved
FROM (SELECT DISTINCT date FROM {{prices}}) LEFT JOIN (SELECT day AS date,
  CASE WHEN launched_total > 200 THEN launched_total END AS launched_total FROM ({EVENTS_SQL})) USING (date)
""".replace("0.0", "CAST(0 AS DOUBLE)"))
def three_period_fill(x):
    days = x.view("prices").select("date").distinct()
    measured = event_table(x).selectExpr("day AS date", "IF(launched_total > 200, launched_total, NULL) AS launched_total")
    return series.three_period_fill(days, measured, ["launched_total"])


NEWS_WIDE = f"""
SELECT day AS date, max(n_total) FILTER (WHERE ecosystem = 'UA') AS n_ua,
  max(n_total) FILTER (WHERE ecosystem = 'WEST') AS n_west,
  max(tone_all) FILTER (WHERE ecosystem = 'UA') AS tone_ua,
  max(tone_all) FILTER (WHERE ecosystem = 'WEST') AS tone_west, sum(n_total) AS n_all
FROM ({DAILY_RAW}) GROUP BY day
"""


@query("E20", f"""
SELECT date, {rr('n_ua::DOUBLE / n_all', 8)} AS ua_share, {rr('ln(1 + n_ua)', 8)} AS ua_log,
  {rr('CASE WHEN count(n_ua) OVER f >= 30 AND stddev_samp(n_ua) OVER f > 0 THEN (n_ua - avg(n_ua) OVER f) / stddev_samp(n_ua) OVER f END', 6)} AS ua_z30,
  {rr('lag(tone_ua - tone_west) OVER (ORDER BY date)', 5)} AS gap_ua_west_lag1
FROM ({NEWS_WIDE}) WINDOW f AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
""")
def news_normalisations(x):
    table = x.labels()

    def pick(col, e):
        return F.max(F.when(F.col("ecosystem") == e, F.col(col)))
    wide = table.groupBy(F.col("day").alias("date")).agg(
        pick("n_total", "UA").alias("n_ua"), F.sum("n_total").alias("n_all"),
        pick("tone_all", "UA").alias("tone_ua"), pick("tone_all", "WEST").alias("tone_west"))
    wide = wide.withColumn("series", F.lit("news"))
    w = series.by("series")
    gap = F.col("tone_ua") - F.col("tone_west")
    out = wide.select(
        "date", r(F.try_divide("n_ua", "n_all"), 8).alias("ua_share"),
        r(F.ln(1 + F.col("n_ua")), 8).alias("ua_log"),
        r(series.trailing_z(F.col("n_ua"), w, 30, 30), 6).alias("ua_z30"),
        r(F.lag(gap).over(w), 5).alias("gap_ua_west_lag1"))
    return out


@query("E21", f"""
SELECT ticker, date, {rr('ret - lag(ret) OVER (PARTITION BY ticker ORDER BY date)', 6)} AS d FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY abs(ret) DESC NULLS LAST, date) AS k
  FROM ({RET})) WHERE k > 10
""")
def extremes_dropped(x):
    kept = series.drop_extremes(returns(x), ["ticker"], "ret", 10)
    out = kept.withColumn("d", series.change(F.col("ret"), W()))
    return rounded(out.select("ticker", "date", "d"), 6, "d")


@query("E23", f"""
SELECT ticker, date, (SELECT min(t.date) FROM {{prices}} t
  WHERE t.ticker = k.ticker AND t.date > c.date) AS trading_day FROM ({SPINE_DAYS}) c CROSS JOIN (SELECT DISTINCT ticker FROM {{prices}}) k
""")
def next_trading_days(x):
    """The first day after each calendar day on which each series is quoted."""
    prices = x.view("prices").select("ticker", "date")
    # Every series asks for every calendar day: one array of days, laid out once a series.
    days = series.span_calendar(x.view("risk")).agg(F.collect_list("date").alias("days"))
    asked = prices.select("ticker").distinct().join(F.broadcast(days)).select("ticker", F.explode("days").alias("date"))
    return series.next_trading_day(asked, prices, keys=["ticker"])


@query("D18 Q7", f"""
WITH p AS (SELECT ticker, r.date AS d, ret, gpr, CASE WHEN vix > 25 AND vix < 25.5 THEN vix END AS vix FROM ({RET}) r
  JOIN {{risk}} USING (date) JOIN {{market}} USING (date)),
g AS (SELECT ticker, {FRIDAY} AS week, avg(gpr) AS gpr, coalesce(sum(ret), 0) AS ret,
      arg_max(vix, d) FILTER (WHERE vix IS NOT NULL) AS vix FROM p GROUP BY 1, 2),
k AS (SELECT ticker, CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM g GROUP BY 1)
SELECT ticker, week, {rr('gpr', 6)} AS gpr, {rr('coalesce(ret, 0)', 6)} AS ret, vix,
  {rr('gpr - lag(gpr) OVER (PARTITION BY ticker ORDER BY week)', 6)} AS d_gpr FROM k LEFT JOIN g USING (ticker, week)
""")
def weekly_resample(x):
    daily_rows = returns(x).join(
        x.view("risk").select("date", "gpr"), "date").join(
        x.view("market").selectExpr("date", "IF(vix > 25 AND vix < 25.5, vix, NULL) AS vix"), "date")
    out = series.weekly(daily_rows, ["ticker"], mean=["gpr"], total=["ret"], last=["vix"])
    out = out.withColumn("d_gpr", series.change(F.col("gpr"), W()))
    return rounded(out.select("ticker", F.col("date").alias("week"), "gpr", "ret", "vix", "d_gpr"),
                   6, "gpr", "ret", "d_gpr")


@query("D19", f"""
SELECT d + CAST((7 - dayofweek(d)) % 7 AS INTEGER) AS week, {rr('sum(ret)', 6)} AS total
FROM (SELECT date AS d, CASE WHEN adjclose > 250000 THEN ret END AS ret FROM ({RET})) GROUP BY 1
""")
def weekly_sums(x):
    some = returns(x).withColumn("ret", F.when(F.col("adjclose") > 250000, F.col("ret")))
    return rounded(reports.weekly_sum(some, "ret"), 6, "total")


@query("D19", """
SELECT last_day(date) AS month_end,
  round(avg(CASE WHEN value > 40000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS share FROM {rates} GROUP BY 1
""")
def monthly_observed_share(x):
    some = x.view("rates").withColumn("v", F.when(F.col("value") > 40000, F.col("value")))
    return rounded(reports.monthly_observed_share(some, "v"), 8, "share")


@query("D20", """
SELECT ticker, CAST(CASE WHEN hi > lo THEN least(floor((adjclose - lo) * 60 / (hi - lo)), 59) ELSE 0 END
  AS INTEGER) AS bin, count(*) AS n
FROM {prices} JOIN (SELECT ticker, min(adjclose) AS lo, max(adjclose) AS hi FROM {prices} GROUP BY 1)
USING (ticker) GROUP BY 1, 2
""")
def price_histogram(x):
    return reports.histogram(x.view("prices"), "adjclose", ["ticker"])


@query("D21", """
SELECT 'rows' AS measure, count(*) AS value FROM {market}
UNION ALL SELECT 'weekend_rows', count(*) FILTER (WHERE dayofweek(date) IN (0, 6)) FROM {market}
UNION ALL SELECT 'repeated_values', count(*) FROM (
  SELECT round(vix, 2) FROM {market} WHERE vix IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
""")
def duplicate_targets(x):
    return reports.duplicate_targets(x.view("market"), "vix", "date", 2)


@query("D14", """
SELECT feature, form, count(*) AS n, round(avg(x), 4) + 0.0 AS mean, round(stddev_samp(x), 4) AS sd,
  round(min(x), 4) + 0.0 AS low, round(max(x), 4) + 0.0 AS high, min(date) AS first_date,
  max(date) AS last_date
FROM (SELECT date, feature, 'level' AS form, v AS x FROM l UNION ALL
  SELECT date, feature, 'change', v - lag(v) OVER (PARTITION BY feature ORDER BY date) FROM l)
WHERE x IS NOT NULL GROUP BY 1, 2
""".replace("FROM (SELECT date, feature, 'level'", "FROM (SELECT date, feature, 'level'").replace(
    "SELECT feature, form, count(*)", """WITH l AS (
  SELECT date, 'gpr' AS feature, gpr AS v FROM {risk} UNION ALL SELECT date, 'gpr_act', gpr_act FROM {risk}
  UNION ALL SELECT date, 'gpr_threat', gpr_threat FROM {risk})
SELECT feature, form, count(*)""", 1))
def descriptives(x):
    out = reports.descriptives(x.view("risk"), ["gpr", "gpr_act", "gpr_threat"])
    return rounded(out, 4, "mean", "sd", "low", "high")


@query("D15", f"""
SELECT ecosystem, {rr("avg(CASE WHEN day < DATE '2022-02-24' THEN share END)", 8)} AS before,
  {rr("avg(CASE WHEN day >= DATE '2022-02-24' THEN share END)", 8)} AS after,
  {rr("avg(CASE WHEN day >= DATE '2022-02-24' THEN share END) - avg(CASE WHEN day < DATE '2022-02-24' THEN share END)", 7)} AS shift
FROM ({DAILY_SQL}) GROUP BY 1
""")
def event_day_shift(x):
    table = x.labels().withColumn("share", F.round("share", 8))
    out = reports.event_shift(table, ["ecosystem"], "share", fixed.INVASION_DATE)
    return rounded(rounded(out, 8, "before", "after"), 7, "shift")


@query("D16", f"""
SELECT name, found, published, found IS NOT DISTINCT FROM published AS matches FROM (
  SELECT unnest(['market_info_dates', 'weapons_launched', 'weapons_destroyed']) AS name,
    unnest([d, l, s]) AS found, unnest([809, 102396, 76126]::DOUBLE[]) AS published
  FROM (SELECT CAST(count(*) FILTER (WHERE launched_total > 0) AS DOUBLE) AS d,
    CAST(sum(launched_total) AS DOUBLE) AS l, CAST(sum(destroyed_total) AS DOUBLE) AS s
    FROM ({EVENTS_SQL})))
""")
def published_totals(x):
    found = event_table(x).agg(
        F.count_if(F.col("launched_total") > 0).alias("market_info_dates"),
        F.sum("launched_total").alias("weapons_launched"),
        F.sum("destroyed_total").alias("weapons_destroyed"))
    # Totals published with the records.
    return reports.reconcile(found, {
        "market_info_dates": 809, "weapons_launched": 102396, "weapons_destroyed": 76126})


REGIME_CASE = """CASE WHEN date >= DATE '2022-09-29' THEN 'attrition'
  WHEN date >= DATE '2022-02-24' THEN 'invasion' WHEN date >= DATE '2021-11-01' THEN 'buildup'
  ELSE 'pre_war' END"""


@query("D17", f"""
SELECT regime, count(*) AS n, {rr('avg(gpr_act)', 6)} AS act, {rr('avg(gpr_threat)', 6)} AS threat,
  {rr('avg(gpr_threat) / avg(gpr_act)', 6)} AS threat_act_ratio,
  {rr('corr(gpr_act, gpr_threat)', 6)} AS corr_levels, {rr('corr(da, dt)', 6)} AS corr_changes,
  {rr('avg(gpr)', 6)} AS mean_gpr
FROM (SELECT *, gpr_act - lag(gpr_act) OVER w AS da, gpr_threat - lag(gpr_threat) OVER w AS dt
  FROM (SELECT *, {REGIME_CASE} AS regime FROM {{risk}})
  WINDOW w AS (PARTITION BY regime ORDER BY date)) GROUP BY 1
""")
def regime_structure(x):
    df = x.view("risk").withColumn("regime", c.regime("date"))
    out = reports.regime_structure(df, "gpr_act", "gpr_threat", ["gpr"])
    return rounded(out, 6, *[k for k in out.columns if k not in ("regime", "n")])


PIVOT = ", ".join(
    f"max({v}) FILTER (WHERE ecosystem = '{e}') AS {p}_{e}"
    for p, v in (("att", "share"), ("tone", "tone_conflict"), ("vol", "n_conflict"))
    for e in fixed.CORE_LABELS)


@query("D23", f"SELECT day AS date, {PIVOT} FROM ({DAILY_SQL}) WHERE ecosystem IN ('UA','RU_STATE','RU_INDEP','WEST','EN_GLOBAL') GROUP BY day")
def perception_indices(x):
    from tidewire.plans import panels
    out = panels.perception_indices(x.labels())
    out = rounded(out, 8, *[f"att_{e}" for e in fixed.CORE_LABELS])
    return rounded(out, 6, *[f"tone_{e}" for e in fixed.CORE_LABELS])


@query("B17", f"""
SELECT feature, count(value) AS n, {rr('avg(value)', 5)} AS mean FROM ({' UNION ALL '.join(
    f"SELECT 'launched_{k}' AS feature, CAST(launched_{k} AS DOUBLE) AS value FROM ({EVENTS_SQL})" for k in fixed.WEAPON_CLASSES if k != 'other')}
  UNION ALL SELECT 'launched_total', CAST(launched_total AS DOUBLE) FROM ({EVENTS_SQL})) GROUP BY 1
""")
def feature_block(x):
    from tidewire.operators import labelling
    df = event_table(x)
    names = labelling.columns_like(df, include=["launch"], exclude=["other"], prefix=["launched_"])
    long = labelling.to_long(df, ["day"], names)
    return rounded(long.groupBy("feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean")), 5, "mean")


@query("G18", f"""
SELECT a, b, {rr('corr(x, y)', 6)} AS corr, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS n
FROM (SELECT l.feature AS a, k.feature AS b, l.d AS x, k.d AS y FROM p l JOIN p k
  ON l.date = k.date AND l.i < k.i) GROUP BY 1, 2
""".replace("SELECT a, b,", f"""WITH s AS (SELECT day AS date, ecosystem AS feature, share,
  list_position(['UA','RU_STATE','RU_INDEP','WEST','EN_GLOBAL'], ecosystem) AS i FROM ({DAILY_SQL})
  WHERE ecosystem IN ('UA','RU_STATE','RU_INDEP','WEST','EN_GLOBAL')),
g AS (SELECT date, f.feature, f.i, share FROM (SELECT DISTINCT date FROM s)
  CROSS JOIN (SELECT DISTINCT feature, i FROM s) f LEFT JOIN s USING (date, feature)),
p AS (SELECT date, feature, i, share - lag(share) OVER (PARTITION BY feature ORDER BY date) AS d FROM g)
SELECT a, b,""", 1))
def change_correlations(x):
    from tidewire.plans import panels
    wide = panels.perception_indices(x.labels()).withColumn(
        "series", F.lit("news"))
    w = series.by("series")
    changed = wide.withColumns({
        e: series.change(F.round(F.col(f"att_{e}"), 8), w) for e in fixed.CORE_LABELS})
    return rounded(reports.pairwise_correlations(changed, fixed.CORE_LABELS), 6, "corr")
