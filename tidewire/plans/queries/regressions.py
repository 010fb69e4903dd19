"""Regression grids and their families."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire import fixed_values as fixed
from tidewire.functions import columns as c
from tidewire.operators import grids, moments, races, series, testing
from tidewire.plans import panels
from tidewire.plans.queries.daily_series import RET, returns, rounded
from tidewire.plans.registry import query
from tidewire.plans.sqltext import r, rr
from tidewire.functions.tails import normal_sf_sql
from tidewire.session import durable

# Windows over the test calendar with the roles of the fixed ones.
WINDOWS = {
    "Russia buildup+invasion": ("2021-11-22", "2022-03-22"),
    "all ingested days": None,
    "2017-19 episodes": ("2017-04-23", "2019-10-21"),
}
TARGETS = {"T1": "r_spx", "T2": "r_sxxp", "T3": "r_spx"}


def news_panel(x, kind="tone"):
    """News indices joined to returns, benchmark returns and the lagged log level."""
    if kind == "tone":
        wide = panels.perception_indices(x.labels())
    else:
        wide = panels.threat_act_indices(x.threat_act())
    return wide.join(spine(x), "date")


def spine(x):
    wide = returns(x).groupBy("date").agg(*[
        F.max(F.when(F.col("ticker") == t, F.col("ret"))).alias(t)
        for t in ("T1", "T2", "T3", "T4", "T5")])
    m = x.view("market").withColumn("k", F.lit("m"))
    w = series.by("k")
    m = m.withColumns({
        "r_spx": series.log_return(F.col("spx"), w), "r_sxxp": series.log_return(F.col("sxxp"), w),
        "lvix": F.lag(F.ln("vix")).over(w)}).drop("k")
    joined = wide.join(m, "date").join(x.view("risk"), "date").withColumn("regime", c.regime("date"))
    return joined.withColumns({f"vol_{t}": F.abs(t) for t in ("T1", "T2")})


HAC_DATA = f"""
SELECT r.ticker, r.date, r.ret AS y, m.x FROM ({RET}) r JOIN (
  SELECT date, 100 * ln(spx / lag(spx) OVER (ORDER BY date)) AS x FROM {{market}}) m
ON r.date = m.date WHERE r.ret IS NOT NULL AND m.x IS NOT NULL
"""
_LAGS = ", ".join(f"lag(s0, {k}) OVER w AS a{k}, lag(s1, {k}) OVER w AS b{k}" for k in range(1, 6))
_M = {
    (i, j): " + ".join([f"sum(s{i} * s{j})"] + [
        f"{1 - k / 6!r} * (coalesce(sum(s{i} * {'ab'[j]}{k}), 0) + coalesce(sum({'ab'[i]}{k} * s{j}), 0))"
        for k in range(1, 6)])
    for i, j in ((0, 0), (0, 1), (1, 1))}
HAC_SQL = f"""
WITH d AS ({HAC_DATA}),
f AS (SELECT ticker, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sum(x) AS sx,
      sum(x * x) AS sxx, regr_r2(y, x) AS r2 FROM d GROUP BY 1),
s AS (SELECT ticker, date, y - a - b * x AS s0, (y - a - b * x) * x AS s1 FROM d JOIN f USING (ticker)),
l AS (SELECT *, {_LAGS} FROM s WINDOW w AS (PARTITION BY ticker ORDER BY date)),
m AS (SELECT ticker, {_M[0, 0]} AS m00, {_M[0, 1]} AS m01, {_M[1, 1]} AS m11 FROM l GROUP BY 1),
v AS (SELECT *, n * sxx - sx * sx AS det FROM f JOIN m USING (ticker)),
t AS (SELECT ticker, n, r2, b, a,
  (sx * sx * m00 - 2 * n * sx * m01 + n::DOUBLE * n * m11) / (det * det) AS vb,
  (sxx * sxx * m00 - 2 * sx * sxx * m01 + sx * sx * m11) / (det * det) AS va FROM v)
SELECT ticker, n, {rr('r2', 6)} AS r2, term, {rr('coef', 6)} AS coef, {rr('se', 6)} AS se,
  {rr('coef / se', 4)} AS z, {rr(f"2 * {normal_sf_sql('abs(coef / se)')}", 5)} AS p
FROM (SELECT ticker, n, r2, 'const' AS term, a AS coef, sqrt(va) AS se FROM t
      UNION ALL SELECT ticker, n, r2, 'x', b, sqrt(vb) FROM t)
"""


@query("G1", HAC_SQL)
def hac_regression(x):
    m = x.view("market").withColumn("k", F.lit("m"))
    m = m.withColumn("x", series.log_return(F.col("spx"), series.by("k"))).select("date", "x")
    rows = returns(x).select("ticker", "date", F.col("ret").alias("y")).join(m, "date").dropna()
    fits = moments.ols_hac(rows, ["ticker"], "y", ["x"], maxlags=5)
    out = moments.terms(fits, ["ticker"]).drop("k")
    return rounded(rounded(rounded(out, 6, "r2", "coef", "se"), 4, "z"), 5, "p")


@query("G2 G3 C15")
def label_race_same_day(x):
    """Local labels given western ones: frequency x window x target."""
    grid = grids.label_race(news_panel(x), WINDOWS, TARGETS)
    return grids.with_bh(grid)


@query("G19 I4")
def label_race_by_lag(x):
    """The same grid with news of the day and of the day before, side by side."""
    grid = grids.label_race(news_panel(x), WINDOWS, TARGETS, lags=(0, 1))
    return grids.with_bh(grid)


@query("G4")
def threat_act_race(x):
    """Threat and act shares of each label, lagged (primary) and same-day."""
    grid = grids.label_race(news_panel(x, "threat_act"), WINDOWS, TARGETS,
                            prefixes=("act", "thr"), lags=(0, 1))
    return grids.with_bh(grid)


def _variant_grid(x):
    table = x.variants()
    wide = table.filter(F.col("ecosystem").isin(fixed.CORE_LABELS)).groupBy(
        "variant", F.col("day").alias("date")).agg(*[
            F.max(F.when(F.col("ecosystem") == e, F.col(v))).alias(f"{p}_{e}")
            for p, v in (("att", "share"), ("tone", "tone_conflict")) for e in fixed.CORE_LABELS])
    return grids.label_race(wide.join(spine(x), "date"), {"all ingested days": None},
                            {"T1": "r_spx", "T2": "r_sxxp"}, lags=(0, 1), extra_cell=["variant"])


@query("G3 I17 F3")
def variant_sensitivity(x):
    """The grid under every rule order, summarised by (lag, variant)."""
    return testing.sensitivity_summary(_variant_grid(x), ["lag", "variant"])


ASSET_WINDOWS = {"to the buildup": ("2016-11-01", "2021-10-31"), "to the invasion": ("2017-06-01", "2022-06-05")}
_FORMS = [
    {"name": f"primary {f}", "asset": "T1", "controls": ["brent", "lvix"], "freq": f} for f in ("D", "W")
] + [
    {"name": f"placebo {t}", "asset": t, "controls": ["brent", "lvix"]} for t in ("T3", "T4")
] + [
    {"name": f"drop {k}", "asset": "T1", "controls": ["brent", "lvix"], "drop": k} for k in (0, 10)
] + [
    {"name": "controls " + "+".join(cs), "asset": "T1", "controls": cs}
    for cs in (["r_spx", "lvix"], ["brent", "r_spx", "lvix"])
]
ARMS = [{**form, "name": f"{form['name']} @ {window}", "span": span}
        for form in _FORMS for window, span in ASSET_WINDOWS.items()]


def _assets(x):
    rates = x.view("rates").filter("series = 'DCOILBRENTEU'").withColumn(
        "brent", series.log_return(F.col("value"), series.by("series"))).select("date", "brent")
    return news_panel(x).join(rates, "date")


@query("G5 K5")
def asset_race(x):
    """Assets, frequencies, placebos, dropped extremes and control sets as arms."""
    return _asset_grid(x)


def _asset_grid(x):
    """Every arm in every window, corrected over the whole grid."""
    grid = races.asset_race(_assets(x), ARMS)
    parts = F.split("arm", " @ ")
    grid = grid.withColumns({"window": parts[1], "arm": parts[0]})
    return testing.benjamini_hochberg(grid, "p_local")


@query("I16")
def asset_rules(x):
    """The written rule on the asset arms: corrected survivors in both windows, placebos,
    extremes, leading label."""
    grid = _asset_grid(x)
    survivors = F.count_distinct(F.when(F.col("arm").startswith("primary") & F.col("survives_bh"), F.col("window")))
    primary, placebo = F.col("arm").startswith("primary"), F.col("arm").startswith("placebo")
    p = F.col("p_local")
    return testing.rules(grid, {
        "survives_in_both_windows": survivors == len(ASSET_WINDOWS),
        "all_placebos_above_a_tenth": F.min(F.when(placebo, (p > 0.10).cast("int"))) == 1,
        "survives_dropping_extremes": F.max(F.when(F.col("arm") == "drop 10", p)) < 0.05,
        "RU_STATE_leads": F.min(F.when(primary, (F.col("top_local") == "RU_STATE").cast("int"))) == 1,
    })


HALVES = {"all": None, "first half": ("2016-11-01", "2020-06-30"),
          "second half": ("2020-07-01", "2023-12-31")}


def _held_out(x):
    wide = panels.perception_indices(x.labels())
    return wide.join(x.view("risk"), "date")


@query("G6 K7")
def escalation_grid(x):
    """Label levels against later changes of the risk index, by horizon, lags and half."""
    grid = races.escalation(_held_out(x), ["gpr_act", "gpr_threat"], (1, 5), (1, 6),
                            samples=HALVES)
    return testing.benjamini_hochberg(grid, "p_local", ["sample"])


@query("G6")
def escalation_levels_and_changes(x):
    grid = races.escalation(_held_out(x), ["gpr_act", "gpr"], (1, 5), (6,),
                            forms=("levels", "changes"), within_blocks=False)
    return testing.benjamini_hochberg(grid, "p_local", ["form"])


@query("G7")
def escalation_placebo(x):
    """All news columns moved by one permutation."""
    return races.escalation(_held_out(x), ["gpr_act"], (1, 5), (6,), shuffle_seed=0)


@query("I16 G6 G7")
def holdout_rules(x):
    """The rule on held-out blocks: survivors at both horizons, placebo, twelve own lags."""
    rows = _held_out(x)
    grid = testing.benjamini_hochberg(races.escalation(rows, ["gpr_act", "gpr_threat"], (1, 5), (6,)), "p_local")
    placebo = races.escalation(rows, ["gpr_act"], (1, 5), (6,), shuffle_seed=0)
    dynamics = races.escalation(rows, ["gpr_act"], (1, 5), (12,))
    parts = (df.withColumnRenamed("h", "horizon") for df in (grid.filter("outcome = 'gpr_act'"), placebo, dynamics))
    return testing.holdout_rules(*parts, (1, 5))


@query("I16 G4")
def strict_rules(x):
    """The strict reading of the pass rule over the threat and act grid."""
    fits, cell = grids.label_fits(news_panel(x, "threat_act"), WINDOWS, TARGETS, prefixes=("act", "thr"))
    fits = durable(fits)
    grid = grids.with_bh(moments.block_p(fits, cell, ["local", "west"]).filter("p_local IS NOT NULL"))
    return testing.strict_rules(grid, grids.local_terms(fits, cell), cell, "Russia buildup+invasion", ["T1", "T2"],
                                ["Russia buildup+invasion", "2017-19 episodes"])


MARKETS = {"spx": "r_spx", "sxxp": "r_sxxp", "none": None}


def _kinds(kind, *targets):
    return dict.fromkeys(targets, kind)


@query("G8 G9")
def channel_race_by_regime(x):
    return races.channel_race(spine(x), {**_kinds("return", "T1", "T2"), **_kinds("volatility", "vol_T1", "vol_T2")}, races.by_regime(),
                              {"spx": "r_spx"})


@query("G10")
def channel_race_interacted(x):
    return races.interacted_race(spine(x), _kinds("return", "T1", "T2"), "r_spx")


@query("G11")
def market_control_swap(x):
    spans = {"buildup": ("2021-06-01", "2022-02-23"), "full sample": None}
    return races.channel_race(spine(x), _kinds("return", "T1", "T2"), races.in_spans(spans), MARKETS)


@query("G11")
def market_as_target(x):
    spans = {"buildup": ("2021-06-01", "2022-02-23"), "full sample": None}
    return races.channel_race(spine(x), _kinds("return", "r_spx", "r_sxxp"), races.in_spans(spans), {"none": None})


MECH_SPANS = {"buildup": ("2021-06-01", "2022-02-23"), "full": None}


@query("G12", f"""
WITH m AS (SELECT date, 100 * ln(spx / lag(spx) OVER (ORDER BY date)) AS s,
    100 * ln(sxxp / lag(sxxp) OVER (ORDER BY date)) AS e FROM {{market}}),
d AS (SELECT * FROM m JOIN {{risk}} USING (date) JOIN (SELECT DISTINCT date FROM {{prices}}) USING (date)),
x AS (SELECT 'buildup' AS "window", * FROM d WHERE date BETWEEN DATE '2021-06-01' AND DATE '2022-02-23'
  UNION ALL SELECT 'full', * FROM d),
c AS (SELECT *, gpr_act - lag(gpr_act) OVER w AS da, gpr_threat - lag(gpr_threat) OVER w AS dt FROM x
  WINDOW w AS (PARTITION BY "window" ORDER BY date)),
b AS (SELECT "window", covar_samp(e, s) / var_samp(CASE WHEN e IS NOT NULL THEN s END) AS beta
  FROM c GROUP BY 1)
SELECT "window", {rr('corr(e, s)', 6)} AS corr_ab, {rr('stddev_samp(e)', 5)} AS sd_a,
  {rr('max(beta)', 6)} AS beta, {rr('stddev_samp(e - beta * s)', 5)} AS sd_resid,
  {rr('corr(e - beta * s, dt)', 6)} AS corr_resid_dthreat, {rr('corr(e - beta * s, da)', 6)} AS corr_resid_dact
FROM c JOIN b USING ("window") GROUP BY 1
""")
def orthogonal_mechanism(x):
    out = races.orthogonal_mechanism(spine(x), MECH_SPANS, "r_sxxp", "r_spx")
    return rounded(rounded(out, 6, "corr_ab", "beta", "corr_resid_dthreat", "corr_resid_dact"),
                   5, "sd_a", "sd_resid")


@query("G13")
def levels_and_changes(x):
    samples = F.when(F.col("regime") == "attrition", F.array(F.lit("attrition"), F.lit("pooled"))
                     ).otherwise(F.array(F.lit("pooled")))
    return races.channel_race(spine(x), _kinds("volatility", "vol_T1", "vol_T2"), samples, {"spx": "r_spx"},
                              forms=("levels", "changes"))


@query("G13")
def start_date_sweep(x):
    """The same race from moving start dates, a placebo window, and next-day returns."""
    spans = {f"from {d}": (d, "2022-02-23") for d in
             ("2021-05-01", "2021-06-01", "2021-07-01", "2021-08-01", "2021-09-01")}
    spans["placebo"] = ("2019-05-01", "2019-12-31")
    led = spine(x).withColumn("k", F.lit("p"))
    led = led.withColumn("lead_T1", F.lead("T1").over(series.by("k")))
    return races.channel_race(led, _kinds("return", "T1", "lead_T1"), races.in_spans(spans), {"spx": "r_spx"})


SPECS = {
    "controls": ((), 1), "western": (fixed.WESTERN_LABELS, 1),
    "local_same_day": (fixed.CORE_LABELS, 0), "local_lagged": (fixed.CORE_LABELS, 1)}


@query("G14")
def coefficient_table(x):
    return races.nested_table(news_panel(x), "T1", "r_sxxp", SPECS)


# --- firms --------------------------------------------------------------------------

FIRM_SQL = """
SELECT ticker, date, ret, CASE WHEN region IN ('EUROPE', 'MIDDLE EAST') THEN e ELSE s END AS mkt FROM (
  SELECT f.ticker, f.date, r_name AS region,
    100 * ln(adjclose / lag(adjclose) OVER (PARTITION BY f.ticker ORDER BY f.date)) AS ret
  FROM {firm_prices} f JOIN nation ON n_name = f.ticker JOIN region ON n_regionkey = r_regionkey)
JOIN (SELECT date, 100 * ln(spx / lag(spx) OVER (ORDER BY date)) AS s,
  100 * ln(sxxp / lag(sxxp) OVER (ORDER BY date)) AS e FROM {market}) USING (date)
WHERE ret IS NOT NULL AND mkt IS NOT NULL
"""
ABN_SQL = f"""
SELECT d.ticker, date, ret - (a + b * mkt) AS abn FROM ({FIRM_SQL}) d JOIN (
  SELECT ticker, regr_slope(ret, mkt) AS b, regr_intercept(ret, mkt) AS a FROM ({FIRM_SQL})
  GROUP BY 1 HAVING count(*) >= 430) f ON d.ticker = f.ticker
"""
EXPOSURE_RANK = """
SELECT n_name AS ticker, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE)
  / (count(*) * 100) / 10000 AS arms_share
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
"""


def firm_panel(x):
    w = series.by("ticker")
    firms = x.view("firm_prices").withColumn("ret", series.log_return(F.col("adjclose"), w))
    places = x.table("nation").join(
        x.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_name").alias("ticker"), F.col("r_name").alias("region"))
    m = x.view("market").withColumn("k", F.lit("m"))
    k = series.by("k")
    m = m.select("date", series.log_return(F.col("spx"), k).alias("s"),
                 series.log_return(F.col("sxxp"), k).alias("e"))
    joined = firms.join(places, "ticker").join(m, "date")
    bench = F.when(F.col("region").isin("EUROPE", "MIDDLE EAST"), F.col("e")).otherwise(F.col("s"))
    return joined.select("ticker", "date", "ret", bench.alias("mkt"))


@query("C13 G15", f"SELECT ticker, date, {rr('abn', 5)} AS abn FROM ({ABN_SQL})")
def firm_abnormal_returns(x):
    out = races.abnormal_returns(firm_panel(x), 430)
    return rounded(out.select("ticker", "date", "abn"), 5, "abn")


def _sweeps(source: str, keys: str, columns: list[str], n: int) -> str:
    parts, last = [f"z0 AS ({source})"], "z0"
    i = 0
    for _ in range(n):
        for key in ("ticker", "date"):
            i += 1
            sel = ", ".join(f"{v} - avg({v}) OVER (PARTITION BY {keys}{key}) AS {v}" for v in columns)
            parts.append(f"z{i} AS (SELECT * REPLACE ({sel}) FROM {last})")
            last = f"z{i}"
    return "WITH " + ", ".join(parts) + f" SELECT * FROM {last}"


@query("G16", f"SELECT ticker, date, {rr('abn', 5)} AS abn FROM ({_sweeps(ABN_SQL, '', ['abn'], 12)})")
def two_way_demeaned(x):
    rows = races.abnormal_returns(firm_panel(x), 430).select("ticker", "date", "abn")
    return rounded(races.two_way_demean(rows, [], ["abn"], 12), 5, "abn")


GRAD_WINDOWS = {"full sample": None, "pre_war": ("2015-02-18", "2021-10-31"),
                "attrition": ("2022-09-29", "2026-06-30")}
_GW = " UNION ALL ".join(
    f"SELECT '{k}' AS \"window\", * FROM j" + (
        f" WHERE date BETWEEN DATE '{v[0]}' AND DATE '{v[1]}'" if v else "")
    for k, v in GRAD_WINDOWS.items())
_GRAD_ROWS = f"""
SELECT "window", date, ticker, outcome, CASE WHEN outcome = 'signed' THEN abn ELSE abs(abn) END AS y,
  shock * (arms_share - avg(arms_share) OVER (PARTITION BY "window", outcome)) AS interaction
FROM (WITH j AS (SELECT a.ticker, a.date, abn, arms_share, shock FROM ({ABN_SQL}) a
  JOIN ({EXPOSURE_RANK}) e ON a.ticker = e.ticker JOIN (
    SELECT date, (d - avg(d) OVER ()) / stddev_samp(d) OVER () AS shock FROM (
      SELECT date, gpr_threat - lag(gpr_threat) OVER (ORDER BY date) AS d FROM {{risk}})) s
  ON a.date = s.date WHERE shock IS NOT NULL)
  {_GW}) CROSS JOIN (SELECT unnest(['signed', 'absolute']) AS outcome)
"""
GRAD_SQL = f"""
WITH w AS ({_sweeps(_GRAD_ROWS, '"window", outcome, ', ['y', 'interaction'], 12)}),
b AS (SELECT "window", outcome, count(*) AS n, count(DISTINCT ticker) AS n_firms,
  count(DISTINCT date) AS n_days, regr_slope(y, interaction) AS beta,
  regr_intercept(y, interaction) AS a, sum(interaction) AS sx, sum(interaction * interaction) AS sxx
  FROM w GROUP BY 1, 2),
s AS (SELECT w."window", w.outcome, date, sum(y - a - beta * interaction) AS s0,
  sum((y - a - beta * interaction) * interaction) AS s1
  FROM w JOIN b ON w."window" = b."window" AND w.outcome = b.outcome GROUP BY 1, 2, 3),
m AS (SELECT "window", outcome, count(*) AS g, sum(s0 * s0) AS m00, sum(s0 * s1) AS m01,
  sum(s1 * s1) AS m11 FROM s GROUP BY 1, 2),
v AS (SELECT b.*, (sx * sx * m00 - 2 * n * sx * m01 + n::DOUBLE * n * m11)
  / ((n * sxx - sx * sx) * (n * sxx - sx * sx)) * (g::DOUBLE / (g - 1)) * ((n - 1)::DOUBLE / (n - 2)) AS vb
  FROM b JOIN m ON b."window" = m."window" AND b.outcome = m.outcome)
SELECT "window", outcome, n, n_firms, n_days, {rr('beta', 5)} AS beta, {rr('sqrt(vb)', 5)} AS se,
  {rr(f"2 * {normal_sf_sql('abs(beta / sqrt(vb))')}", 4)} AS p FROM v
"""


@query("G17", GRAD_SQL)
def exposure_gradient(x):
    firms = races.abnormal_returns(firm_panel(x), 430)
    cents = F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint")).cast("double")
    share = x.table("customer").join(
        x.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).groupBy(F.col("n_name").alias("ticker")).agg(
        (cents / (F.count("*") * 100) / 10000).alias("arms_share"))
    k = x.view("risk").withColumn("k", F.lit("r"))
    k = k.withColumn("d", series.change(F.col("gpr_threat"), series.by("k")))
    shock = k.select("date", series.zscore(F.col("d"), series.whole("k")).alias("shock"))
    out = races.exposure_gradient(firms.join(share, "ticker"), shock, GRAD_WINDOWS)
    return rounded(rounded(out, 5, "beta", "se"), 4, "p")


@query("G21")
def held_out_signs(x):
    """Signs fixed in advance against weekly coefficients of a held-out window."""
    news = [f"{p}_{e}" for e in fixed.CORE_LABELS for p in ("act", "thr")]
    rows = grids.per_target(
        grids.in_windows(news_panel(x, "threat_act"), {"held out": ("2017-04-23", "2019-10-21")}),
        {"T1": "r_spx", "T2": "r_sxxp"})
    cell = ["window", "target"]
    week = series.weekly(rows, cell, mean=news, total=["y", "mkt"], last=["lvix"])
    made = grids.shocks(week, cell, news, lag=1)
    made = made.withColumn("lvix", series.zscore(F.col("lvix"), series.whole(cell)))
    features = [*news, "mkt", "lvix"]
    design = grids.complete(made, cell, "y", features, least=30, factor=0.6)
    coefs = moments.terms(moments.ols_hac(design, cell, "y", features), cell)
    return testing.sign_agreement(coefs, fixed.PREDICTED_SIGNS)


@query("G21", f"""
WITH c AS (SELECT ticker, sign(corr(y, x)) AS s FROM ({HAC_DATA}) GROUP BY 1),
t AS (SELECT count(*) AS total, count(*) FILTER (WHERE (ticker IN ('T1', 'T2') AND s = 1)
  OR (ticker IN ('T3', 'T4', 'T5') AND s = -1)) AS matches FROM c)
SELECT matches, total, (SELECT round(sum(comb), 8) FROM (
  SELECT factorial(total::INT) / (factorial(k::INT) * factorial(total::INT - k::INT)) / 2.0 ** total AS comb
  FROM (SELECT unnest(range(0, total + 1)) AS k) WHERE k >= matches)) AS p FROM t
""".replace("AS p FROM t", "AS p FROM t"))
def sign_agreement(x):
    m = x.view("market").withColumn("k", F.lit("m"))
    m = m.withColumn("x", series.log_return(F.col("spx"), series.by("k"))).select("date", "x")
    rows = returns(x).select("ticker", "date", F.col("ret").alias("y")).join(m, "date").dropna()
    coefs = rows.groupBy(F.col("ticker").alias("term")).agg(F.corr("y", "x").alias("coef"))
    out = testing.sign_agreement(coefs, {"T1": 1, "T2": 1, "T3": -1, "T4": -1, "T5": -1})
    return out.withColumn("p", r(F.col("p"), 8))
