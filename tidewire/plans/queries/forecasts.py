"""Expanding forecasts, accuracy tests, combinations and economic value."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire import fixed_values as fixed
from tidewire.functions import columns as c
from tidewire.functions.tails import normal_sf_sql
from tidewire.operators import forecasting, reports, series, testing, walkforward
from tidewire.plans import panels
from tidewire.plans.queries.articles import DAILY_RAW
from tidewire.plans.queries.daily_series import PIVOT, RET, W, returns, rounded
from tidewire.plans.registry import query
from tidewire.plans.sqltext import r, rr

TICKERS = ("T1", "T2", "T3", "T4", "T5")
NEWS = [f"{p}_{e}" for e in fixed.CORE_LABELS for p in ("att", "tone")]
PAST = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND {} PRECEDING)"


@query("E15", f"""
SELECT ticker, date, {rr(f'avg(ret) OVER {PAST.format(1)}', 6)} AS forecast FROM ({RET}) WHERE ret IS NOT NULL
""")
def expanding_mean(x):
    rows = returns(x).filter("ret IS NOT NULL")
    out = rows.withColumn("forecast", series.expanding_mean(F.col("ret"), W()))
    return rounded(out.select("ticker", "date", "forecast"), 6, "forecast")


AR_ROWS = f"""
SELECT ticker, date, y, lag(y, 5) OVER (PARTITION BY ticker ORDER BY date) AS x,
  avg(y) OVER {PAST.format(5)} AS bench FROM (
  SELECT ticker, date, CASE WHEN count(ret) OVER f = 5 THEN sum(ret) OVER f END AS y FROM ({RET})
  WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
"""
AR_SQL = f"""
SELECT ticker, date, y, bench, CASE WHEN regr_count(y, x) OVER f >= 30 AND x IS NOT NULL
    AND regr_sxx(y, x) OVER f > 0
  THEN regr_intercept(y, x) OVER f + regr_slope(y, x) OVER f * x ELSE avg(y) OVER f END AS ar1
FROM ({AR_ROWS}) WINDOW f AS {PAST.format(5)}
"""


def ar_rows(x):
    rows = returns(x).withColumn("y", series.forward_sum(F.col("ret"), W(), 5))
    rows = rows.withColumn("bench", series.expanding_mean(F.col("y"), W(), 5))
    return series.ar1(rows, "ticker", "y", h=5).select("ticker", "date", "y", "bench", "ar1")


@query("E17 Q2", f"SELECT ticker, date, {rr('bench', 5)} AS bench, {rr('ar1', 5)} AS ar1 FROM ({AR_SQL})")
def ar1_forecast(x):
    return rounded(ar_rows(x).drop("y"), 5, "bench", "ar1")


_FEATS = " UNION ALL ".join(
    f"SELECT date, '{n}' AS predictor, lag(\"{n}\", 1) OVER (ORDER BY date) - lag(\"{n}\", 2) OVER (ORDER BY date) AS x FROM wide"
    for n in NEWS)
GRID_SQL = f"""
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY target, predictor) AS m FROM (
SELECT target, predictor, date, y, row_number() OVER o AS pos, avg(y) OVER f AS bench,
  CASE WHEN regr_count(y, x) OVER f >= 30 AND x IS NOT NULL AND regr_sxx(y, x) OVER f > 0
    THEN regr_intercept(y, x) OVER f + regr_slope(y, x) OVER f * x ELSE avg(y) OVER f END AS model
FROM (WITH wide AS (SELECT day AS date, {PIVOT} FROM ({DAILY_RAW})
        WHERE ecosystem IN ('UA','RU_STATE','RU_INDEP','WEST','EN_GLOBAL') GROUP BY day),
      feats AS ({_FEATS}), p AS (SELECT DISTINCT predictor FROM feats)
      SELECT t.ticker AS target, p.predictor, t.date, t.ret AS y, f.x FROM ({RET}) t CROSS JOIN p
      LEFT JOIN feats f ON f.date = t.date AND f.predictor = p.predictor WHERE t.ret IS NOT NULL)
WINDOW o AS (PARTITION BY target, predictor ORDER BY date),
  f AS (PARTITION BY target, predictor ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE pos > 250) WHERE m >= 200
"""


def forecast_grid(x):
    """(target, predictor, date, y, bench, model) for every return and news shock."""
    wide = panels.perception_indices(x.labels()).withColumn(
        "k", F.lit("news"))
    w = series.by("k")
    shocks = wide.withColumns({n: series.change(F.col(n), w, 1) for n in NEWS})
    rows = returns(x).filter("ret IS NOT NULL").select(
        F.col("ticker").alias("target"), "date", F.col("ret").alias("y"))
    joined = rows.join(shocks.select("date", *NEWS), "date", "left")
    long = joined.unpivot(["target", "date", "y"], NEWS, "predictor", "x")
    return forecasting.predictor_grid(long, ["target", "predictor"])


CW_SQL = f"""
SELECT target, predictor, count(*) AS n, 1 - sum((y - model) ** 2) / sum((y - bench) ** 2) AS r2_oos,
  avg(d) / sqrt(var_pop(d) / count(*)) AS cw_stat FROM (
  SELECT *, (y - bench) ** 2 - ((y - model) ** 2 - (bench - model) ** 2) AS d FROM ({GRID_SQL})) GROUP BY 1, 2
"""


def forecast_tests(x):
    rows = forecast_grid(x)
    cell = ["target", "predictor"]
    fit = testing.oos_fit(rows, cell, "y", "model", "bench").drop("mse_ratio", "n")
    return testing.clark_west(rows, cell, "y", "bench", "model").join(fit, cell)


@query("E16 H2 H9 I2", f"""
SELECT target, predictor, n, {rr('r2_oos', 6)} AS r2_oos, {rr('cw_stat', 4)} AS cw_stat,
  {rr(normal_sf_sql('cw_stat'), 5)} AS cw_p FROM ({CW_SQL})
""")
def predictor_forecast_tests(x):
    out = forecast_tests(x)
    return rounded(rounded(rounded(out, 6, "r2_oos"), 4, "cw_stat"), 5, "cw_p")


BH_SQL = f"""
SELECT *, least(1.0, min(cw_p * m / k) OVER (PARTITION BY FAMILY ORDER BY k DESC)) AS cw_p_bh FROM (
  SELECT *, count(*) OVER (PARTITION BY FAMILY) AS m,
    row_number() OVER (PARTITION BY FAMILY ORDER BY cw_p) AS k FROM (
    SELECT *, {normal_sf_sql('cw_stat')} AS cw_p, split_part(predictor, '_', 1) AS kind FROM ({CW_SQL})))
"""


@query("I4", f"SELECT target, predictor, {rr('cw_p_bh', 5)} AS cw_p_bh, cw_p_bh <= 0.05 AS survives_bh FROM ({BH_SQL.replace('FAMILY', '1')})")
def bh_over_grid(x):
    out = testing.benjamini_hochberg(forecast_tests(x), "cw_p")
    return rounded(out.select("target", "predictor", "cw_p_bh", "survives_bh"), 5, "cw_p_bh")


@query("I17", f"""
SELECT target, kind, count(*) AS n_cells, count(*) FILTER (WHERE cw_p < 0.05) AS nominal,
  count(*) FILTER (WHERE cw_p_bh <= 0.05) AS survivors, {rr('min(cw_p)', 5)} AS min_p
FROM ({BH_SQL.replace('FAMILY', 'target, kind')}) GROUP BY 1, 2
""")
def forecast_sensitivity(x):
    grid = forecast_tests(x).withColumn("kind", F.split("predictor", "_")[0])
    out = testing.sensitivity_summary(grid, ["target", "kind"], "cw_p")
    return rounded(out, 5, "min_p")


@query("I16", f"""
SELECT unnest(['any_survivor', 'every_target_tested', 'best_fit_positive', 'overall']) AS rule,
  unnest([a, b, c, a AND b AND c]) AS pass FROM (SELECT bool_or(cw_p_bh <= 0.05) AS a,
    count(DISTINCT target) = (SELECT count(DISTINCT ticker) FROM {{prices}}) AS b, max(r2_oos) > 0 AS c FROM ({BH_SQL.replace('FAMILY', '1')}))
""")
def forecast_rules(x):
    series_known = x.view("prices").agg(F.count_distinct("ticker").alias("n_series"))
    grid = testing.benjamini_hochberg(forecast_tests(x), "cw_p").join(F.broadcast(series_known))
    return testing.rules(grid, {
        "any_survivor": F.bool_or("survives_bh"),
        "every_target_tested": F.count_distinct("target") == F.max("n_series"),
        "best_fit_positive": F.max("r2_oos") > 0})


@query("D22", f"""
SELECT target, arg_max(predictor, (r2_oos, predictor)) AS predictor, {rr('max(r2_oos)', 6)} AS r2_oos
FROM ({CW_SQL}) GROUP BY 1
""")
def best_predictor(x):
    out = reports.best_per_cell(forecast_tests(x), ["target"], "r2_oos", ["predictor"], lowest=False)
    return rounded(out, 6, "r2_oos")


COMBO_SQL = f"""
SELECT target, date, max(y) AS y, max(bench) AS bench, avg(model) AS combination_mean,
  median(model) AS combination_median FROM ({GRID_SQL}) GROUP BY 1, 2
"""


@query("H7", f"SELECT target, date, {rr('combination_mean', 6)} AS combination_mean, {rr('combination_median', 6)} AS combination_median FROM ({COMBO_SQL})")
def combined_forecasts(x):
    rows = forecast_grid(x).withColumnRenamed("model", "forecast")
    out = forecasting.combine(rows, ["target", "date"])
    return rounded(out, 6, "combination_mean", "combination_median")


def combos(x):
    rows = forecast_grid(x).withColumnRenamed("model", "forecast")
    return forecasting.combine(rows, ["target", "date"], keep=["y", "bench"])


_EV = {k: f"""greatest(-1.5, least(1.5, {f} / (3.0 * v)))""" for k, f in
       (("m", "combination_mean"), ("b", "bench"))}
EV_SQL = f"""
WITH a AS (SELECT *, CASE WHEN count(y) OVER f >= 20 THEN var_samp(y) OVER f END AS v FROM ({COMBO_SQL})
  WINDOW f AS (PARTITION BY target ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, {_EV['m']} AS wm, {_EV['b']} AS wb FROM a WHERE v > 0),
c AS (SELECT *, abs(wm - coalesce(lag(wm) OVER w, 0)) AS tm, abs(wb - coalesce(lag(wb) OVER w, 0)) AS tb
  FROM b WINDOW w AS (PARTITION BY target ORDER BY date)),
d AS (SELECT target, cost AS cost_bps, wm * y - tm * cost / 100 AS rm, wb * y - tb * cost / 100 AS rb
  FROM c CROSS JOIN (SELECT unnest([0.0, 10.0]::DOUBLE[]) AS cost)),
e AS (SELECT target, cost_bps, count(*) AS n, avg(rm) * 252 AS mm, stddev_pop(rm) * sqrt(252) AS sm,
  avg(rb) * 252 AS mb, stddev_pop(rb) * sqrt(252) AS sb FROM d GROUP BY 1, 2 HAVING count(*) >= 60)
SELECT target, cost_bps, n, {rr('mm - 1.5 * sm * sm / 100', 3)} AS cer_model_pct,
  {rr('mb - 1.5 * sb * sb / 100', 3)} AS cer_benchmark_pct,
  {rr('mm - 1.5 * sm * sm / 100 - (mb - 1.5 * sb * sb / 100)', 3)} AS cer_gain_pct,
  {rr('mm / sm', 4)} AS sharpe_model, {rr('mb / sb', 4)} AS sharpe_benchmark FROM e
"""


@query("I13 Q3", EV_SQL)
def economic_value(x):
    out = testing.economic_value(combos(x), ["target"], "y", "combination_mean", "bench")
    return rounded(rounded(out, 3, "cer_model_pct", "cer_benchmark_pct", "cer_gain_pct"),
                   4, "sharpe_model", "sharpe_benchmark")


@query("I1 F3", f"""
SELECT kind, ticker, n, {rr('mean_d', 4)} AS mean_d, {rr('''mean_d / sqrt(lrv / n)
  * sqrt((n + 1 - 10 + 20.0 / n) / n)''', 4)} AS dm_stat FROM (
  SELECT kind, ticker, count(*) AS n, max(mean_d) AS mean_d, (sum(e * e)
    + 2 * (0.8 * sum(e * e1) + 0.6 * sum(e * e2) + 0.4 * sum(e * e3) + 0.2 * sum(e * e4))) / count(*) AS lrv
  FROM (SELECT *, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3,
      lag(e, 4) OVER w AS e4 FROM (
    SELECT *, d - avg(d) OVER (PARTITION BY kind, ticker) AS e,
      avg(d) OVER (PARTITION BY kind, ticker) AS mean_d FROM (
      SELECT 'squared' AS kind, ticker, date, (y - ar1) ** 2 - (y - bench) ** 2 AS d FROM ({AR_SQL})
      UNION ALL SELECT 'absolute', ticker, date, abs(y - ar1) - abs(y - bench) FROM ({AR_SQL}))
    WHERE d IS NOT NULL) WINDOW w AS (PARTITION BY kind, ticker ORDER BY date)) GROUP BY 1, 2)
""")
def equal_accuracy(x):
    parts = [testing.diebold_mariano(ar_rows(x), ["ticker"], "y", "ar1", "bench", kind, horizon=5)
             .withColumn("kind", F.lit(kind)) for kind in ("squared", "absolute")]
    return rounded(parts[0].unionByName(parts[1]), 4, "mean_d", "dm_stat")


@query("I1")
def equal_accuracy_p_values(x):
    out = testing.diebold_mariano(ar_rows(x), ["ticker"], "y", "ar1", "bench", horizon=5)
    return out.withColumn("dm_p", forecasting.p_two_sided_t(F.col("dm_stat"), F.col("n")))


VAR_SQL = f"""
SELECT ticker, date, ret * ret AS rv, avg(ret * ret) OVER {PAST.format(1)} AS slow,
  avg(ret * ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING) AS fast
FROM ({RET}) WHERE ret IS NOT NULL
"""


def variance_rows(x):
    rows = returns(x).filter("ret IS NOT NULL").withColumn("rv", F.col("ret") * F.col("ret"))
    w = W()
    return rows.withColumns({
        "slow": series.expanding_mean(F.col("rv"), w),
        "fast": F.avg("rv").over(series.rolling(w, 22, -1))})


def _q(f: str) -> str:
    ratio = f"(greatest(rv, 1e-12) / greatest({f}, 1e-12))"
    return f"({ratio} - ln({ratio}) - 1)"


@query("I3", f"""
SELECT ticker, count(*) AS n, {rr(f"avg({_q('slow')})", 5)} AS qlike_slow, {rr(f"avg({_q('fast')})", 5)} AS qlike_fast
FROM ({VAR_SQL}) WHERE slow IS NOT NULL AND fast IS NOT NULL GROUP BY 1
""")
def qlike_losses(x):
    rows = variance_rows(x).filter("slow IS NOT NULL AND fast IS NOT NULL")
    return rounded(rows.groupBy("ticker").agg(
        F.count("*").alias("n"), F.avg(c.qlike(F.col("rv"), F.col("slow"))).alias("qlike_slow"),
        F.avg(c.qlike(F.col("rv"), F.col("fast"))).alias("qlike_fast")), 5, "qlike_slow", "qlike_fast")


LOSS_SQL = f"""
SELECT ticker, count(*) AS n_test, avg(abs(y - ar1)) AS mae, avg(abs(y - bench)) AS mae_bench,
  sqrt(avg((y - ar1) ** 2)) AS rmse, avg(ar1 - y) AS bias,
  avg(CASE WHEN sign(y) = sign(ar1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS dir_acc
FROM ({AR_SQL}) WHERE y IS NOT NULL AND ar1 IS NOT NULL AND bench IS NOT NULL GROUP BY 1
"""


@query("H8", f"""
SELECT ticker, n_test, {', '.join(f"{rr(k, 4)} AS {k}" for k in ('mae', 'mae_bench', 'rmse', 'bias', 'dir_acc'))},
  {rr('100 * (mae_bench - mae) / mae_bench', 4)} AS mae_gain_pct FROM ({LOSS_SQL})
""")
def loss_table(x):
    out = testing.loss_table(ar_rows(x), ["ticker"], "y", "ar1", "bench")
    return rounded(out, 4, "mae", "mae_bench", "rmse", "bias", "dir_acc", "mae_gain_pct")


@query("D22 K8", f"""
SELECT model, count(*) AS wins FROM (SELECT ticker, CASE WHEN mae <= mae_bench THEN 'AR(1)' ELSE 'mean' END
  AS model FROM ({LOSS_SQL})) GROUP BY 1
""")
def win_counts(x):
    t = testing.loss_table(ar_rows(x), ["ticker"], "y", "ar1", "bench")
    long = t.select("ticker", F.inline(F.array(
        F.struct(F.lit("AR(1)").alias("model"), F.col("mae").alias("mae")),
        F.struct(F.lit("mean").alias("model"), F.col("mae_bench").alias("mae")))))
    return reports.win_counts(reports.best_per_cell(long, ["ticker"], "mae", ["model"]), ["model"])


@query("I12", f"""
SELECT target, n, {rr('(1.6448536269514722 + 0.8416212335729143) / sqrt(n)', 8)} AS effect_one_sided,
  {rr('(1.959963984540054 + 0.8416212335729143) / sqrt(n)', 8)} AS effect_two_sided
FROM (SELECT target, count(*) AS n FROM ({COMBO_SQL}) GROUP BY 1)
""")
def detectable_effect(x):
    counts = combos(x).groupBy("target").agg(F.count("combination_mean").alias("n"))
    return rounded(testing.detectable_effect(counts), 8, "effect_one_sided", "effect_two_sided")


# --- breaks, resampling, validation ------------------------------------------------------

BREAK_DATE = "2020-06-01"


@query("I7", f"""
WITH d AS (SELECT series, date, value FROM {{rates}}), s AS (SELECT series, count(*) AS n,
  var_pop(value) * count(*) AS t, var_pop(value) FILTER (WHERE date < DATE '{BREAK_DATE}')
    * count(*) FILTER (WHERE date < DATE '{BREAK_DATE}') AS a,
  var_pop(value) FILTER (WHERE date >= DATE '{BREAK_DATE}') * count(*) FILTER (WHERE date >= DATE '{BREAK_DATE}') AS b
  FROM d GROUP BY 1)
SELECT series, n, {rr('(t - a - b) / ((a + b) / (n - 2))', 6)} AS chow_stat, n - 2 AS dof, 1 AS q FROM s
""")
def chow_known_date(x):
    return rounded(testing.chow(x.view("rates"), ["series"], "value", BREAK_DATE), 6, "chow_stat")


def _ssr(test: str) -> str:
    return (f"(regr_syy(gpr_act, gpr_threat) FILTER (WHERE {test}) - pow(regr_sxy(gpr_act, gpr_threat) "
            f"FILTER (WHERE {test}), 2) / regr_sxx(gpr_act, gpr_threat) FILTER (WHERE {test}))")


@query("I7", f"""
SELECT k, n, {rr('((t - a - b) / 2) / ((a + b) / (n - 4))', 6)} AS chow_stat, n - 4 AS dof, 2 AS q FROM (
  SELECT 'risk' AS k, count(*) AS n, {_ssr('true')} AS t, {_ssr(f"date < DATE '{BREAK_DATE}'")} AS a,
    {_ssr(f"date >= DATE '{BREAK_DATE}'")} AS b FROM {{risk}} WHERE gpr_act IS NOT NULL AND gpr_threat IS NOT NULL)
""")
def chow_regression(x):
    rows = x.view("risk").withColumn("k", F.lit("risk"))
    out = testing.chow(rows, ["k"], "gpr_act", BREAK_DATE, "gpr_threat")
    return rounded(out, 6, "chow_stat")


@query("I8", f"""
WITH d AS (SELECT series, date, value - avg(value) OVER (PARTITION BY series) AS e,
    count(*) OVER (PARTITION BY series) AS n,
    row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS i FROM {{rates}}),
c AS (SELECT *, sum(e) OVER w AS s, sum(e * e) OVER (PARTITION BY series) AS t FROM d
  WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (s * s / i + s * s / (n - i)) AS g FROM c
  WHERE i > 0 AND i >= floor(n * 0.15) AND i < floor(n * (1 - 0.15))),
h AS (SELECT *, g / ((t - g) / (n - 2)) AS stat FROM f)
SELECT series, {rr('max(stat)', 5)} AS sup_stat, arg_max(date, stat) AS break_at, max(n) AS n FROM h GROUP BY 1
""")
def supremum_break(x):
    return rounded(testing.supremum_scan(x.view("rates"), ["series"], "value"), 5, "sup_stat")


@query("I9 I10")
def break_table(x):
    """Both break tests for every risk series, with the bootstrap p and the distance of the
    found break from the known date."""
    long = x.view("risk").unpivot(["date"], ["gpr", "gpr_act", "gpr_threat"], "series", "value")
    found = testing.bootstrap_break(long, ["series"], "value", n_boot=400)
    known = testing.chow(long, ["series"], "value", BREAK_DATE).drop("n")
    return found.join(known, "series").withColumn(
        "days_from_event", F.datediff("break_at", F.lit(BREAK_DATE).cast("date")))


RW_ROWS = f"""
SELECT last_day(date) AS draw, ticker AS test, avg(ret) - avg(avg(ret)) OVER (PARTITION BY ticker) AS value
FROM ({RET}) WHERE ret IS NOT NULL GROUP BY 1, 2
"""


@query("I5", f"""
WITH d AS ({RW_ROWS}), k AS (SELECT draw FROM d GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT test) FROM d)),
s AS (SELECT ticker AS test, sqrt(avg(ret * ret)) * (CASE ticker WHEN 'T1' THEN 3.0 WHEN 'T2' THEN 2.5 ELSE 0.3 END)
  AS statistic FROM ({RET}) GROUP BY 1),
o AS (SELECT *, CAST(row_number() OVER (ORDER BY abs(statistic) DESC, test) AS INTEGER) AS step FROM s),
t AS (SELECT a.test, a.statistic, a.step, d.draw, max(abs(d.value)) AS top FROM o a JOIN o b ON b.step >= a.step
  JOIN d ON d.test = b.test WHERE d.draw IN (SELECT draw FROM k) GROUP BY 1, 2, 3, 4),
u AS (SELECT test, statistic, step, quantile_cont(top, 0.95) AS crit,
  avg(CASE WHEN top >= abs(statistic) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM t GROUP BY 1, 2, 3),
v AS (SELECT *, (SELECT min(step) FROM u WHERE abs(statistic) <= crit) AS fail FROM u)
SELECT test, {rr('statistic', 5)} AS statistic, step,
  {rr('CASE WHEN step > fail THEN (SELECT crit FROM u z WHERE z.step = v.fail) ELSE crit END', 5)} AS critical_value,
  {rr('CASE WHEN step <= coalesce(fail, step) THEN p END', 6)} AS p_rw, step < coalesce(fail, 99) AS reject FROM v
""")
def step_down(x):
    rows = returns(x).filter("ret IS NOT NULL")
    monthly = rows.groupBy(F.last_day("date").alias("draw"), F.col("ticker").alias("test")).agg(
        F.avg("ret").alias("m"))
    draw_rows = monthly.withColumn("value", F.col("m") - F.avg("m").over(series.whole("test")))
    known = draw_rows.agg(F.count_distinct("test").alias("n"))  # one row
    full = draw_rows.groupBy("draw").count().join(F.broadcast(known)).filter("count = n").select("draw")
    scale = F.when(F.col("ticker") == "T1", 3.0).when(F.col("ticker") == "T2", 2.5).otherwise(0.3)
    stats = rows.groupBy("ticker").agg(F.sqrt(F.avg(F.col("ret") * F.col("ret"))).alias("s")).select(
        F.col("ticker").alias("test"), (F.col("s") * scale).alias("statistic"))
    out = testing.romano_wolf(stats, draw_rows.join(full, "draw", "left_semi").drop("m"))
    return rounded(rounded(out, 5, "statistic", "critical_value"), 6, "p_rw")


@query("I6")
def confidence_set(x):
    """Models of each target that cannot be told apart, on squared errors of the forecast grid."""
    rows = forecasting.durable(forecast_grid(x))
    losses = rows.select("target", F.col("date").alias("period"), F.col("predictor").alias("model"),
                         testing.loss("squared", F.col("y"), F.col("model")).alias("loss"))
    base = rows.groupBy("target", F.col("date").alias("period")).agg(F.max(
        testing.loss("squared", F.col("y"), F.col("bench"))).alias("loss"))
    both = forecasting.durable(losses.unionByName(base.withColumn("model", F.lit("benchmark"))))  # read four times
    return testing.confidence_set(both, ["target"])


VALID_SQL = f"""
WITH p AS (SELECT t.ticker || ' vs basket' AS pair, t.date, t.ret AS cand, b.ref FROM ({RET}) t
  JOIN (SELECT date, avg(ret) AS ref FROM ({RET}) GROUP BY 1) b ON b.date = t.date WHERE t.ret IS NOT NULL AND ref IS NOT NULL),
v AS (SELECT *, CASE WHEN count(cand) OVER f = 20 THEN stddev_samp(cand) OVER f END AS vc,
  CASE WHEN count(ref) OVER f = 20 THEN stddev_samp(ref) OVER f END AS vr FROM p
  WINDOW f AS (PARTITION BY pair ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
s AS (SELECT pair, count(*) AS n_overlap, corr(cand, ref) AS return_corr, corr(vc, vr) AS vol_corr,
  regr_slope(cand, ref) AS beta, regr_r2(cand, ref) AS r2, stddev_samp(cand - ref) AS tracking_error,
  avg(cand - ref) AS mean_diff, stddev_samp(cand) / stddev_samp(ref) AS std_ratio FROM v GROUP BY 1)
SELECT pair, n_overlap, {', '.join(f"{rr(k, 5)} AS {k}" for k in ('return_corr', 'vol_corr', 'beta', 'r2', 'tracking_error', 'mean_diff', 'std_ratio'))},
  concat_ws('; ', CASE WHEN return_corr < 0.95 THEN 'return_corr' END, CASE WHEN vol_corr < 0.9 THEN 'vol_corr' END,
    CASE WHEN NOT beta BETWEEN 0.85 AND 1.15 THEN 'beta' END, CASE WHEN r2 < 0.9 THEN 'r2' END,
    CASE WHEN tracking_error > 0.5 THEN 'tracking_error' END) AS failures, failures = '' AS passed FROM s
"""


@query("I14 K3", VALID_SQL)
def candidate_validation(x):
    rows = returns(x)
    basket = series.basket(rows).select("date", F.col("basket_return").alias("ref"))
    pairs = rows.join(basket, "date").select(
        F.concat("ticker", F.lit(" vs basket")).alias("pair"), "date",
        F.col("ret").alias("cand"), "ref")
    out = testing.validate_candidates(pairs)
    return rounded(out, 5, "return_corr", "vol_corr", "beta", "r2", "tracking_error", "mean_diff", "std_ratio")


_GATE_ROWS = " UNION ALL ".join(
    f"SELECT '{e}' AS ecosystem, date, \"att_{e}\" AS a, \"tone_{e}\" AS t, \"vol_{e}\" AS v FROM w" for e in fixed.CORE_LABELS)
GATE_SQL = f"""
WITH w AS (SELECT day AS date, {PIVOT} FROM ({DAILY_RAW})
  WHERE ecosystem IN ('UA','RU_STATE','RU_INDEP','WEST','EN_GLOBAL') GROUP BY day),
l AS ({_GATE_ROWS}),
g AS (SELECT date, gpr - lag(gpr) OVER (ORDER BY date) AS dg FROM w LEFT JOIN {{risk}} USING (date)),
d AS (SELECT l.*, a - lag(a) OVER (PARTITION BY ecosystem ORDER BY l.date) AS da, dg,
  (a - avg(a) OVER p) / stddev_samp(a) OVER p AS z FROM l JOIN g ON l.date = g.date
  WINDOW p AS (PARTITION BY ecosystem)),
t AS (SELECT ecosystem, quantile_cont(v, 0.5) AS median_daily_articles, corr(da, dg) AS corr_with_risk,
  max(z) FILTER (WHERE date = DATE '2022-02-24') AS event_z, avg(t) AS mean_tone FROM d GROUP BY 1),
x AS (SELECT max(abs(k)) AS max_pairwise_corr FROM (SELECT corr(p.da, q.da) AS k FROM d p JOIN d q
  ON p.date = q.date AND p.ecosystem < q.ecosystem GROUP BY p.ecosystem, q.ecosystem))
SELECT ecosystem, CAST(median_daily_articles AS DOUBLE) AS median_daily_articles, {rr('corr_with_risk', 6)} AS corr_with_risk,
  {rr('event_z', 5)} AS event_z, {rr('mean_tone', 5)} AS mean_tone, {rr('max_pairwise_corr', 6)} AS max_pairwise_corr,
  coalesce(max(CASE WHEN ecosystem = 'WEST' THEN abs(corr_with_risk) END) OVER () >= 0.4, false) AS west_pass,
  coalesce(min(median_daily_articles) OVER () >= 50, false) AS volume_pass,
  coalesce(max(event_z) OVER () >= 2, false) AS event_pass, max_pairwise_corr <= 0.7 AS collinearity_pass,
  west_pass AND volume_pass AND event_pass AND collinearity_pass AS overall_pass FROM t CROSS JOIN x
"""


@query("I15", GATE_SQL)
def measurement_gate(x):
    wide = panels.perception_indices(x.labels())
    out = testing.measurement_gate(wide, x.view("risk"), fixed.CORE_LABELS, fixed.INVASION_DATE)
    return rounded(rounded(out, 6, "corr_with_risk", "max_pairwise_corr"), 5, "event_z", "mean_tone")


@query("G20", f"""
SELECT n_a, n_b, {rr('ma', 6)} AS mean_a, {rr('mb', 6)} AS mean_b, {rr('(ma - mb) / sqrt(qa + qb)', 5)} AS t,
  {rr('pow(qa + qb, 2) / (qa * qa / (n_a - 1) + qb * qb / (n_b - 1))', 4)} AS dof FROM (
  SELECT count(ret) FILTER (WHERE ticker = 'T1') AS n_a, count(ret) FILTER (WHERE ticker = 'T2') AS n_b,
    avg(ret) FILTER (WHERE ticker = 'T1') AS ma, avg(ret) FILTER (WHERE ticker = 'T2') AS mb,
    var_samp(ret) FILTER (WHERE ticker = 'T1') / n_a AS qa, var_samp(ret) FILTER (WHERE ticker = 'T2') / n_b AS qb
  FROM ({RET}))
""")
def welch_test(x):
    out = testing.welch(returns(x), "ticker", "ret", "T1", "T2")
    return rounded(rounded(rounded(out, 6, "mean_a", "mean_b"), 5, "t"), 4, "dof")


# --- walk-forward models ------------------------------------------------------------------

def carried_news(x):
    """News indices with a quiet day filled from at most four rows back."""
    wide = panels.perception_indices(x.labels()).withColumn(
        "k", F.lit("news"))
    w = series.by("k")
    return wide.select("date", *[series.carry(F.col(n), w, 4).alias(n) for n in NEWS])


def model_panel(x):
    from tidewire.plans.queries.regressions import spine
    from tidewire.plans.queries.sources import event_table
    trading = spine(x).drop("regime", "gpr", "gpr_act", "gpr_threat", "lvix")
    indices = carried_news(x)
    events = event_table(x).select(
        F.col("day").alias("date"), "launched_total", "destroyed_total", "interception_rate",
        "weapon_diversity")
    phys = series.three_period_fill(trading.select("date"), events, events.columns[1:])
    return panels.model_panel(trading, ["T1", "T2", "r_spx"], ["vix"], indices, phys)


_PHYS = ("launched_total", "destroyed_total", "interception_rate", "weapon_diversity")
_SET_F = [f"{n}_lag{k}" for n in ("T1", "T2", "r_spx") for k in (1, 5)] + ["vix_lag1"] + [f"regime_{n}" for n in fixed.REGIMES]
_SET_P = [f"{n}_lag1" for n in _PHYS]
_SET_N = [f"{p}_{e}_d1" for p in ("att", "tone") for e in fixed.CORE_LABELS]
_SET_G = [f"gap_{n}_lag1" for n in panels.GAPS]


def panel_sql():
    """The model panel in SQL: (date, T1, T2, features, attack_unobserved)."""
    from tidewire.plans.queries.sources import EVENTS_SQL

    def filled(n):
        value = f"coalesce(CAST(e.{n} AS DOUBLE), CAST(0 AS DOUBLE))"
        return (f"CASE WHEN date < DATE '{fixed.INVASION_DATE}' THEN CAST(0 AS DOUBLE) "
                f"WHEN date >= DATE '{fixed.COUNTS_START}' THEN {value} END AS {n}")

    regime = (f"CASE WHEN date >= DATE '{fixed.COUNTS_START}' THEN 'attrition' WHEN date >= DATE '{fixed.INVASION_DATE}' THEN 'invasion' "
              f"WHEN date >= DATE '{fixed.BUILDUP_START}' THEN 'buildup' ELSE 'pre_war' END")
    made = [f"lag({n}, {k}) OVER w AS {n}_lag{k}" for n in ("T1", "T2", "r_spx") for k in (1, 5)] + ["lag(vix) OVER w AS vix_lag1"]
    made += [f"CAST({regime} = '{n}' AS INTEGER)::DOUBLE AS regime_{n}" for n in fixed.REGIMES]
    made += [f"lag({n}_{e}, 1) OVER w - lag({n}_{e}, 2) OVER w AS {n}_{e}_d1" for n in ("att", "tone") for e in fixed.CORE_LABELS]
    made += [f"lag({n}) OVER w AS {n}_lag1" for n in _PHYS]
    made += [f"lag(tone_{a} - tone_{b}) OVER w AS gap_{n}_lag1" for n, (a, b) in panels.GAPS.items()]
    news = ", ".join(f"last_value({n} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS {n}" for n in NEWS)
    return f"""
SELECT date, T1, T2, {', '.join(made)}, date >= DATE '{fixed.INVASION_DATE}' AND date < DATE '{fixed.COUNTS_START}' AS attack_unobserved
FROM (SELECT date, max(ret) FILTER (WHERE ticker = 'T1') AS T1, max(ret) FILTER (WHERE ticker = 'T2') AS T2 FROM ({RET}) GROUP BY 1) t
JOIN (SELECT date, vix, CASE WHEN spx > 0 AND lag(spx) OVER (ORDER BY date) > 0
  THEN 100 * ln(spx / lag(spx) OVER (ORDER BY date)) END AS r_spx FROM {{market}}) m USING (date)
JOIN (SELECT date AS date FROM {{risk}}) k USING (date)
LEFT JOIN (SELECT date, {news} FROM (SELECT day AS date, {PIVOT} FROM ({DAILY_RAW})
  WHERE ecosystem IN ('UA', 'RU_STATE', 'RU_INDEP', 'WEST', 'EN_GLOBAL') GROUP BY day)) n USING (date)
LEFT JOIN (SELECT date, {', '.join(map(filled, _PHYS))} FROM (SELECT DISTINCT date FROM {{prices}}) d
  LEFT JOIN (SELECT day AS date, {', '.join(_PHYS)} FROM ({EVENTS_SQL})) e USING (date)) p USING (date)
WINDOW w AS (ORDER BY date)"""


def plan_for(x, horizons=(1, 5), refit=21, targets=("T1", "T2")):
    """Common complete-case frame and cut-offs of every (target, horizon) cell."""
    panel, sets = model_panel(x)
    panel = panel.filter("NOT attack_unobserved").withColumn("k", F.lit("p"))
    w = series.by("k")
    ys = F.array(*[F.struct(
        F.lit(t).alias("target"), F.lit(h).alias("horizon"), F.col(f"_{t}_{h}").alias("y"))
        for t in targets for h in horizons])
    made = panel.withColumns({
        f"_{t}_{h}": series.forward_sum(F.col(t), w, h) for t in targets for h in horizons})
    cells = made.select("date", *sets["PNG"], F.inline(ys))
    cell = ["target", "horizon"]
    frame = forecasting.common_frame(cells, "y", sets["PNG"], cell, least=300)
    return forecasting.walk_forward(frame, cell, "horizon", refit=refit), sets, cell


def sample_plan(x, refit=1):
    """The same cells over two samples: without the unobserved window, and with it. Only
    financial and news inputs are asked for, so the window keeps its rows."""
    panel, sets = model_panel(x)
    panel = panel.withColumn("k", F.lit("p"))
    w = series.by("k")
    keys = [(t, h) for t in ("T1", "T2") for h in (1, 5)]
    made = panel.withColumns({f"_{t}_{h}": series.forward_sum(F.col(t), w, h) for t, h in keys})
    ys = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(h).alias("horizon"), F.col(f"_{t}_{h}").alias("y"))
                   for t, h in keys])
    samples = F.array_compact(F.array(
        F.lit("full"), F.when(~F.col("attack_unobserved"), F.lit("observed"))))
    cells = made.select("date", *sets["N"], F.explode(samples).alias("sample"), ys.alias("ys"))
    cells = cells.select("date", "sample", *sets["N"], F.inline("ys"))
    cell = ["sample", "target", "horizon"]
    frame = forecasting.common_frame(cells, "y", sets["N"], cell, least=300)
    return forecasting.walk_forward(frame, cell, "horizon", refit=refit), sets, cell


@query("H1 I18")
def walk_forward_plan(x):
    plan, _, cell = plan_for(x)
    return forecasting.cutoffs(plan, cell, "horizon")


_KNOWN = " AND ".join(f"{f} IS NOT NULL" for f in _SET_F + _SET_P + _SET_N + _SET_G)
_LABELS = " UNION ALL ".join(
    f"SELECT '{t}' AS target, {h} AS horizon, * FROM (SELECT date, {_KNOWN} AS known, "
    f"count({t}) OVER f = {h} AS labelled FROM o WINDOW f AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING))"
    for t in ("T1", "T2") for h in (1, 5))
# Positions, cut-offs and the last label that each may train on, from the definition of the plan.
LEAKAGE_SQL = f"""
WITH o AS (SELECT * FROM ({panel_sql()}) WHERE NOT attack_unobserved),
r AS (SELECT *, row_number() OVER (PARTITION BY target, horizon ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY target, horizon) AS n
  FROM ({_LABELS}) WHERE known AND labelled),
t AS (SELECT *, CAST(floor(n * 0.75) AS BIGINT) AS ts FROM r WHERE n >= 300),
u AS (SELECT DISTINCT target, horizon, ts, ts + (pos - ts) // 21 * 21 AS step FROM t WHERE pos >= ts),
k AS (SELECT target, horizon, step, (SELECT max(pos + a.horizon - 1) FROM t b WHERE b.target = a.target AND b.horizon = a.horizon
  AND a.ts + greatest(0, ceil((b.pos + a.horizon - a.ts) / 21.0)) * 21 <= a.step) AS last_label FROM u a)
SELECT target, CAST(horizon AS INTEGER) AS horizon, count(*) AS n_cutoffs, count(*) FILTER (last_label >= step) AS n_leaking,
  CASE WHEN target = 'T1' THEN (SELECT count(*) FROM (DESCRIBE SELECT * EXCLUDE (date, T1, T2, attack_unobserved) FROM o)
    WHERE NOT regexp_matches(column_name, '(_lag[0-9]+|_d1|_rolling_lag1)$') AND NOT starts_with(column_name, 'regime_')) END AS n_unlagged
FROM k GROUP BY 1, 2
"""


@query("I18", LEAKAGE_SQL)
def leakage_audit(x):
    """No cut-off trains on a label its forecast days have not realised; no unlagged input."""
    plan, sets, cell = plan_for(x)
    leaks = forecasting.leakage(forecasting.cutoffs(plan, cell, "horizon"), cell)
    loose = forecasting.unlagged_features(panels.information_sets(x.spark, sets)).agg(
        F.count("*").alias("n_unlagged")).withColumn("target", F.lit("T1"))
    return leaks.join(loose, "target", "left")


_NESTED = {"F": _SET_F, "P": _SET_F + _SET_P, "N": _SET_F + _SET_N, "PN": _SET_F + _SET_P + _SET_N,
           "PNG": _SET_F + _SET_P + _SET_N + _SET_G}
_PAIRS = [("F", "P"), ("F", "N"), ("P", "PN"), ("N", "PN"), ("PN", "PNG")]
# Which set a column of the panel belongs to is told by its name; the sets are then counted and compared.
NESTING_SQL = f"""
WITH c AS (SELECT column_name AS f, CASE WHEN column_name LIKE 'gap%' THEN 'G' WHEN column_name LIKE '%!_d1' ESCAPE '!' THEN 'N'
    WHEN column_name IN ({', '.join(f"'{n}_lag1'" for n in _PHYS)}) THEN 'P' ELSE 'F' END AS part
  FROM (DESCRIBE SELECT * EXCLUDE (date, T1, T2, attack_unobserved) FROM ({panel_sql()}))),
s(info_set, parts) AS (VALUES ('F', 'F'), ('P', 'FP'), ('N', 'FN'), ('PN', 'FPN'), ('PNG', 'FPNG')),
m AS (SELECT info_set, f FROM s JOIN c ON contains(parts, part)),
x(small, large) AS (VALUES {', '.join(str(p) for p in _PAIRS)}),
b AS (SELECT large, count(*) AS n FROM x JOIN m ON m.info_set = small
  WHERE NOT EXISTS (SELECT 1 FROM m k WHERE k.info_set = large AND k.f = m.f) GROUP BY 1)
SELECT info_set, count(*) AS n_features, coalesce(max(b.n), 0) AS n_missing FROM m LEFT JOIN b ON b.large = info_set GROUP BY 1
"""


@query("F6 K6", NESTING_SQL)
def information_set_nesting(x):
    """Features per set, and how many break the nesting (0 everywhere)."""
    _, sets = model_panel(x)
    rows = panels.information_sets(x.spark, sets)
    broken = panels.nesting_violations(rows, _PAIRS)
    counts = rows.groupBy("info_set").agg(F.count("*").alias("n_features"))
    bad = broken.groupBy(F.col("large").alias("info_set")).agg(F.count("*").alias("n_missing"))
    return counts.join(bad, "info_set", "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0)))


def _scored(plan, forecasts, cell):
    bench = plan.withColumn("bench", series.expanding_mean(F.col("y"), series.by(cell), 1))
    return forecasts.join(bench.select(*cell, "date", "bench"), [*cell, "date"])


@query("H12")
def news_race_by_sample(x):
    """Financial inputs with and without news, over the full sample and the observed one."""
    plan, sets, cell = sample_plan(x)
    pair = {name: sets[name] for name in ("F", "N")}
    rows = _scored(plan, forecasting.ridge_sets(plan, cell, "y", pair), cell)
    keys = [*cell, "info_set"]
    table = testing.loss_table(rows, keys, "y", "forecast", "bench")
    cw = testing.clark_west(rows, keys, "y", "bench", "forecast", "horizon", 5).drop("n")
    return testing.benjamini_hochberg(table.join(cw, keys), "cw_p", ["sample"])


@query("K8")
def error_by_information_set(x):
    """Mean error of the ridge by nested set at one horizon, beside the benchmark's."""
    plan, sets, cell = plan_for(x, horizons=(1,), refit=1)
    rows = _scored(plan, forecasting.ridge_sets(plan, cell, "y", sets), cell)
    table = testing.loss_table(rows, [*cell, "info_set"], "y", "forecast", "bench")
    return table.groupBy("horizon", "info_set").agg(
        F.avg("mae").alias("mae"), F.avg("mae_bench").alias("mae_bench"), F.count("*").alias("n_targets"))


@query("H3 H8")
def ridge_race(x):
    """Nested information sets under an expanding ridge fitted anew for every row, with loss
    table and test."""
    plan, sets, cell = plan_for(x, refit=1)
    rows = _scored(plan, forecasting.ridge_sets(plan, cell, "y", sets), cell)
    keys = [*cell, "info_set"]
    table = testing.loss_table(rows, keys, "y", "forecast", "bench")
    cw = testing.clark_west(rows, keys, "y", "bench", "forecast", "horizon", 5).drop("n")
    return testing.benjamini_hochberg(table.join(cw, keys), "cw_p")


@query("H4")
def tree_race(x):
    """Boosted trees with identical parameters on every nested set: 200 trees at rate 0.05 of
    depth 3, refit every 21 rows, three targets, two horizons."""
    plan, sets, cell = plan_for(x, targets=("T1", "T2", "T3"))
    rows = _scored(plan, walkforward.boosted_sets(plan, cell, "y", sets), cell)
    keys = [*cell, "info_set"]
    table = testing.loss_table(rows, keys, "y", "forecast", "bench")
    cw = testing.clark_west(rows, keys, "y", "bench", "forecast", "horizon", 5).drop("n")
    return testing.benjamini_hochberg(table.join(cw, keys), "cw_p")


@query("H5")
def har_race(x):
    """HAR and HAR with physical, news and gap blocks at two horizons, QLIKE against plain HAR,
    with the accuracy test."""
    panel, sets = model_panel(x)
    phys, news = ([f for f in sets[s] if f not in sets["F"]] for s in ("P", "N"))
    gaps = [f for f in sets["PNG"] if f not in sets["PN"]]
    known = panel.filter("NOT attack_unobserved").select("date", *phys, *news, *gaps)
    rows = returns(x).join(known, "date")
    blocks = {"P": phys, "N": news, "PN": phys + news, "PNG": phys + news + gaps}
    out = forecasting.durable(forecasting.har_forecasts(rows, "ticker", (1, 5), blocks, least=300))
    base = out.filter("model = 'HAR-RV'").select("ticker", "horizon", "date", F.col("forecast").alias("bench"))
    both = out.filter("model <> 'HAR-RV'").join(base, ["ticker", "horizon", "date"])
    keys = ["ticker", "horizon", "model"]
    loss = both.groupBy(*keys).agg(
        F.avg(c.qlike(F.col("rv"), F.col("forecast"))).alias("qlike"),
        F.avg(c.qlike(F.col("rv"), F.col("bench"))).alias("qlike_har"))
    dm = testing.diebold_mariano(both, keys, "rv", "forecast", "bench", "qlike", "horizon", 5)
    return loss.join(dm, keys)


@query("H6 Q4")
def variance_benchmark(x):
    """Best variance recursion per (series, cut-off) from a parameter grid."""
    grid = forecasting.variance_grid([0.02, 0.05, 0.1], [0.8, 0.9], [0.0, 0.05])
    out = forecasting.variance_benchmark(returns(x).select("ticker", "date", "ret"), "ticker", grid)
    return out.groupBy("ticker", "a", "g", "b").agg(
        F.count("*").alias("n"), F.avg(c.qlike(F.col("rv"), F.col("forecast"))).alias("qlike"))


@query("H10")
def block_attribution(x):
    """Rise in held-out error when a feature block is permuted."""
    plan, sets, cell = plan_for(x, horizons=(1,))
    blocks = {"financial": sets["F"], "physical": [f for f in sets["P"] if f not in sets["F"]],
              "news": [f for f in sets["N"] if f not in sets["F"]]}
    return forecasting.block_attribution(plan, cell, "y", blocks)


@query("H11")
def weekend_comparison(x):
    """The same ridge with all rows and with weekdays only, for every series; unknown inputs take the
    training median of their cut-off."""
    panel, sets = model_panel(x)
    calendars = F.array_compact(F.array(
        F.lit("all rows"), F.when(c.weekday("date") < 5, F.lit("weekdays only"))))
    ys = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in TICKERS])
    rows = panel.select("date", *sets["N"], F.explode(calendars).alias("calendar"), ys.alias("ys"))
    rows = rows.select("date", *sets["N"], "calendar", F.inline("ys")).filter("y IS NOT NULL")
    cell = ["calendar", "target"]
    plan = forecasting.walk_forward(forecasting.durable(rows), cell, 1)
    pair = {"F": sets["F"], "N": sets["N"]}
    scored = _scored(plan, forecasting.ridge_sets(plan, cell, "y", pair, impute=True), cell)
    keys = [*cell, "info_set"]
    fit = testing.oos_fit(scored, keys, "y", "forecast", "bench")
    cw = testing.clark_west(scored, keys, "y", "bench", "forecast").drop("n")
    return fit.join(cw, keys)
