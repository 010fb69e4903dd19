"""Register audit, resolution, near-duplicates, panels and stream forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire import fixed_values as fixed
from tidewire.functions import columns as c
from tidewire.operators import audit, daily, neardup, series
from tidewire.plans import panels
from tidewire.plans.queries.articles import DAILY_RAW, DAILY_SQL, IN_SPANS, SPANS, rounded_daily
from tidewire.plans.queries.daily_series import PIVOT, RET, returns, rounded
from tidewire.plans.queries.sources import HOST
from tidewire.plans.registry import query
from tidewire.plans.sqltext import r, rr
from tidewire.session import scratch
from tidewire.sources import tables
from tidewire.streaming import feeds

AUDIT_SQL = """
SELECT c.domain, ecosystem, qid, label, state_owned,
  CASE ecosystem WHEN 'UA' THEN 'UA' WHEN 'WEST' THEN 'WEST' ELSE 'RU' END AS register_country,
  nullif(country, '') AS found_country,
  CASE WHEN qid IS NULL THEN 'unresolved' ELSE 'website-confirmed' END AS identity,
  CASE WHEN nullif(country, '') IS NULL THEN 'unverified'
    WHEN country = register_country THEN 'match' ELSE 'mismatch' END AS verdict
FROM {claims} c LEFT JOIN {reference} r ON r.domain = c.domain
"""


def audited(x):
    return audit.audit_register(x.view("claims"), x.view("reference"))


@query("C9", AUDIT_SQL)
def register_audit(x):
    return audited(x).select("domain", "ecosystem", "qid", "label", "state_owned",
                             "register_country", "found_country", "identity", "verdict")


@query("D13", f"""
SELECT ecosystem, count(*) AS outlets, count(*) FILTER (WHERE verdict <> 'unverified') AS verified,
  count(*) FILTER (WHERE verdict = 'match') AS matches, count(*) FILTER (WHERE verdict = 'mismatch') AS mismatches,
  {rr("count(*) FILTER (WHERE verdict = 'match')::DOUBLE / nullif(count(*) FILTER (WHERE verdict <> 'unverified'), 0)", 8)} AS precision,
  CAST(grouping(ecosystem) AS INTEGER) AS is_overall
FROM ({AUDIT_SQL}) GROUP BY ROLLUP (ecosystem)
""")
def audit_precision(x):
    return rounded(audit.precision_by_label(audited(x)), 8, "precision")


@query("D13", f"SELECT identity, count(*) AS outlets, count(*) FILTER (WHERE verdict = 'unverified') AS unverified FROM ({AUDIT_SQL}) GROUP BY 1")
def audit_reasons(x):
    return audit.reason_counts(audited(x))


@query("D13", f"""
SELECT count(*) AS n, count(state_owned) AS n_known,
  {rr("count(*) FILTER (WHERE (ecosystem = 'RU_STATE') = state_owned)::DOUBLE / count(state_owned)", 8)} AS agreement
FROM ({AUDIT_SQL}) WHERE ecosystem IN ('RU_STATE', 'RU_INDEP')
""")
def audit_ownership(x):
    return rounded(audit.ownership_agreement(audited(x)), 8, "agreement")


# Country items the pages claim, in listing order; two of them are defunct countries.
_ITEMS = ["Q15180", "Q159", "Q2305208", "Q212", "Q183", "Q142", "Q9999999"]
_PICK = "split_part('" + ",".join(_ITEMS) + "', ',', CAST((page_id {}) % 7 AS INT) + 1)"
_OWNER = "split_part('Government of X|Free Press Ltd|Ministry of Y||Holding', '|', CAST(page_id % 5 AS INT) + 1)"
CLAIMS = f"""
SELECT concat('Q', CAST(page_id AS STRING)) AS item, 'P856' AS property, 0 AS position, url AS value FROM {{pages}}
UNION ALL SELECT concat('Q', CAST(page_id AS STRING)), 'P17', 0, {_PICK.format('')} FROM {{pages}}
UNION ALL SELECT concat('Q', CAST(page_id AS STRING)), 'P17', 1, {_PICK.format('+ 3')} FROM {{pages}} WHERE page_id % 2 = 0
UNION ALL SELECT concat('Q', CAST(page_id AS STRING)), 'P495', 0, {_PICK.format('* 5')} FROM {{pages}}
UNION ALL SELECT concat('Q', CAST(page_id AS STRING)), 'P127', 0, concat('O', CAST(page_id % 5 AS STRING)) FROM {{pages}} WHERE page_id % 3 < 2
UNION ALL SELECT concat('Q', CAST(page_id AS STRING)), 'P749', 0, concat('O', CAST((page_id + 1) % 5 AS STRING)) FROM {{pages}} WHERE page_id % 3 = 1
"""
OWNERS = f"SELECT DISTINCT concat('O', CAST(page_id % 5 AS STRING)) AS item, {_OWNER} AS label FROM {{pages}}"


def claims(x):
    return x.sql(CLAIMS, pages=x.table("pages"))


def _in(items):
    return ", ".join(f"'{i}'" for i in items)


COUNTRY_SQL = f"""
SELECT item, value AS country_item, country FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY value IN ({_in(fixed.DEFUNCT_COUNTRIES)}), property, position) AS rn
  FROM (SELECT *, CASE WHEN value IN ({_in(fixed.COUNTRY_ITEMS['RU'])}) THEN 'RU'
      WHEN value IN ({_in(fixed.COUNTRY_ITEMS['UA'])}) THEN 'UA'
      WHEN value IN ({_in(fixed.COUNTRY_ITEMS['WEST'])}) THEN 'WEST' END AS country FROM ({CLAIMS})
    WHERE property IN ('P17', 'P495')) WHERE country IS NOT NULL) WHERE rn = 1
"""


@query("C11", COUNTRY_SQL)
def item_countries(x):
    return audit.item_country(claims(x))


@query("C12", f"""
SELECT c.item, bool_or(regexp_matches(lower(o.label), '{"|".join(fixed.STATE_OWNER_WORDS)}')) AS state_owned
FROM (SELECT * FROM ({CLAIMS}) WHERE property IN ('P127', 'P749')) c JOIN ({OWNERS}) o ON o.item = c.value
WHERE o.label <> '' GROUP BY 1
""")
def item_ownership(x):
    return audit.item_ownership(claims(x), x.sql(OWNERS, pages=x.table("pages")))


DOMAINS = f"SELECT DISTINCT regexp_replace({HOST}, '^(m|blog)\\.', '') AS domain FROM {{pages}}"


@query("C10", f"""
SELECT domain, item, country FROM (SELECT d.domain, s.item, k.country, row_number() OVER (
    PARTITION BY d.domain ORDER BY k.country IS NULL, CAST(substr(s.item, 2) AS BIGINT)) AS rn
  FROM ({DOMAINS}) d LEFT JOIN (SELECT item, host FROM (
      SELECT concat('Q', page_id) AS item, {HOST} AS host FROM {{pages}}) WHERE host <> '') s
    ON s.host = d.domain OR ends_with(s.host, '.' || d.domain) OR ends_with(d.domain, '.' || s.host)
  LEFT JOIN ({COUNTRY_SQL}) k ON k.item = s.item) WHERE rn = 1
""")
def resolved_items(x):
    domains = x.table("pages").select(
        F.regexp_replace(c.host("url"), r"^(m|blog)\.", "").alias("domain")).distinct()
    return audit.resolve_items(domains, claims(x))


# All pairs by shared shingles, then one text after another in the order of ids against those that stand.
NEAR_SQL = """
WITH RECURSIVE t AS (SELECT min(doc_id) AS id, text FROM {documents} WHERE length(text) >= 20 GROUP BY text),
s AS (SELECT DISTINCT id, substr(text, i, 5) AS g FROM (SELECT id, text, unnest(range(1, length(text) - 3)) AS i FROM t)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.id AS first, b.id AS leader, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND b.id < a.id GROUP BY 1, 2),
e AS (SELECT first, leader, c / (x.n + y.n - c) AS jaccard FROM c JOIN n x ON x.id = first JOIN n y ON y.id = leader
      WHERE c / (x.n + y.n - c) >= 0.7),
o AS (SELECT id, row_number() OVER (ORDER BY id) AS rn, coalesce(list(leader) FILTER (leader IS NOT NULL), []) AS earlier
      FROM (SELECT first AS id FROM e UNION SELECT leader FROM e) LEFT JOIN e ON e.first = id GROUP BY id),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS standing UNION ALL
      SELECT i + 1, CASE WHEN list_has_any(earlier, standing) THEN standing ELSE list_append(standing, id) END FROM g JOIN o ON rn = i + 1),
k AS (SELECT unnest(standing) AS leader FROM (SELECT standing FROM g ORDER BY i DESC LIMIT 1))
SELECT doc_id AS key, id AS duplicate_of, CAST(1 AS DOUBLE) AS jaccard FROM {documents} JOIN t USING (text) WHERE doc_id <> id
UNION ALL SELECT first, arg_min(leader, (-jaccard, leader)), max(jaccard) FROM e JOIN k USING (leader) GROUP BY first
"""


@query("D28", NEAR_SQL)
def near_duplicate_texts(x):
    """Whole documents against earlier ones: 5-character shingles, Jaccard 0.7."""
    return neardup.near_duplicates(x.table("documents"), "doc_id", "text")


# --- panels ------------------------------------------------------------------------------

_SETS = {"us_defence": ("T1", "T2"), "eu_defence": ("T3", "T4", "T5")}


@query("K2 D9", f"""
WITH r AS (SELECT ticker, date, adjclose, CASE WHEN adjclose > 0 AND lag(adjclose) OVER w > 0
    THEN 100 * ln(adjclose / lag(adjclose) OVER w) END AS ret FROM {{prices}}
  WINDOW w AS (PARTITION BY ticker ORDER BY date)),
p AS (SELECT date, {', '.join(f"avg(ret) FILTER (WHERE ticker IN {v}) AS {k}, count(adjclose) FILTER (WHERE ticker IN {v}) AS n_{k}" for k, v in _SETS.items())},
  max(ret) FILTER (WHERE ticker = 'T1') AS r_ita, max(ret) FILTER (WHERE ticker = 'T3') AS spx,
  max(adjclose) FILTER (WHERE ticker = 'T5') AS vix FROM r GROUP BY 1),
j AS (SELECT p.*, gpr_act FROM p LEFT JOIN (SELECT date, CASE WHEN gpr_act > 23 THEN gpr_act END AS gpr_act FROM {{risk}}) USING (date)
  WHERE date BETWEEN DATE '2017-01-01' AND DATE '2023-06-30'),
k AS (SELECT * REPLACE (last_value(gpr_act IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS gpr_act) FROM j)
SELECT date, {rr('us_defence', 6)} AS us_defence, n_us_defence, {rr('eu_defence', 6)} AS eu_defence, n_eu_defence,
  {rr('r_ita', 6)} AS r_ita, {rr('spx', 6)} AS spx, vix, gpr_act, CASE WHEN date >= DATE '2022-09-29' THEN 'attrition'
  WHEN date >= DATE '2022-02-24' THEN 'invasion' WHEN date >= DATE '2021-11-01' THEN 'buildup' ELSE 'pre_war' END AS regime
FROM k WHERE us_defence IS NOT NULL AND eu_defence IS NOT NULL AND gpr_act IS NOT NULL
""")
def equity_panel(x):
    risk = x.view("risk").selectExpr("date", "IF(gpr_act > 23, gpr_act, NULL) AS gpr_act")
    out = panels.equity_panel(
        x.view("prices"), _SETS, {"r_ita": "T1"}, {"spx": "T3"}, {"vix": "T5"}, risk,
        "2017-01-01", "2023-06-30", ["us_defence", "eu_defence", "gpr_act"])
    return rounded(out, 6, "us_defence", "eu_defence", "r_ita", "spx")


_TICKERS = ("T1", "T2", "T3", "T4", "T5")
_CARRIED = ("gpr_act", "gpr_threat", "spx", "vix")


@query("K4", f"""
WITH i AS (SELECT date, {', '.join(f"max(adjclose) FILTER (WHERE ticker = '{t}') AS {t}" for t in _TICKERS)} FROM {{prices}} GROUP BY 1),
q AS (SELECT *, {', '.join(f"100 * ln({t} / lag({t}) OVER w) AS r{t}" for t in _TICKERS)} FROM i WINDOW w AS (ORDER BY date)),
j AS (SELECT q.*, gpr_act, gpr_threat, spx, vix FROM q LEFT JOIN {{risk}} USING (date) LEFT JOIN {{market}} USING (date)
  WHERE date BETWEEN DATE '2018-01-01' AND DATE '2023-06-30'),
k AS (SELECT date, {', '.join(f'r{t}' for t in _TICKERS)}, {', '.join(f"last_value({n} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS {n}" for n in _CARRIED)} FROM j),
m AS (SELECT *, 100 * ln(spx / lag(spx) OVER (ORDER BY date)) AS r_mkt, lag(ln(vix)) OVER (ORDER BY date) AS lvix FROM k)
SELECT date, {', '.join(f"{rr(f'r{t}', 6)} AS r_{t}, {rr(f'abs(r{t})', 6)} AS vol_{t}" for t in _TICKERS)}, gpr_act, gpr_threat,
  {rr('r_mkt', 6)} AS r_mkt, {rr('lvix', 6)} AS lvix
FROM m WHERE {' AND '.join(f'r{t} IS NOT NULL' for t in _TICKERS)} AND gpr_act IS NOT NULL AND gpr_threat IS NOT NULL
""")
def index_only_panel(x):
    from tidewire.sources import markets
    idx = markets.join_series(x.view("prices"), _TICKERS, key="ticker", value="adjclose")
    out = panels.index_panel(idx, _TICKERS, x.view("risk"), x.view("market").drop("sxxp"),
                             "2018-01-01", "2023-06-30")
    made = [f"{p}_{t}" for t in _TICKERS for p in ("r", "vol")]
    return rounded(out.select("date", *made, "gpr_act", "gpr_threat", "r_mkt", "lvix"), 6, *made, "r_mkt", "lvix")


_CORE = "ecosystem IN ('UA', 'RU_STATE', 'RU_INDEP', 'WEST', 'EN_GLOBAL')"
_NEWS_COLS = [f"{p}_{e}" for p in ("att", "tone") for e in fixed.CORE_LABELS]


@query("K5", f"""
WITH w AS (SELECT day AS date, {PIVOT} FROM ({DAILY_RAW}) WHERE {_CORE} GROUP BY day),
r AS (SELECT date, {', '.join(f"max(ret) FILTER (WHERE ticker = '{t}') AS {t}" for t in ('T1', 'T2', 'T3'))} FROM ({RET}) GROUP BY 1),
j AS (SELECT * FROM w JOIN r USING (date) JOIN (SELECT date, vix FROM {{market}}) USING (date))
SELECT date, vix, {', '.join(f'{rr(k, 6)} AS {k}' for k in (*_NEWS_COLS, 'T1', 'T2', 'T3'))},
  {rr('lag(ln(vix)) OVER (ORDER BY date)', 6)} AS lvix FROM j
""")
def asset_panel(x):
    """News indices, one return column per asset, and the lagged log level."""
    wide = panels.perception_indices(x.labels())
    out = panels.asset_panel(wide, returns(x), ["T1", "T2", "T3"], x.view("market").select("date", "vix"))
    out = out.drop(*[f"vol_{e}" for e in fixed.CORE_LABELS])
    return rounded(out, 6, *_NEWS_COLS, "T1", "T2", "T3", "lvix")


@query("K7 E8", f"""
WITH w AS (SELECT day AS date, {PIVOT} FROM ({DAILY_RAW}) WHERE {_CORE} GROUP BY day),
j AS (SELECT date, "att_UA", "tone_WEST", gpr_act, gpr_threat, lag(date) OVER (ORDER BY date) AS p FROM (
  SELECT * FROM w JOIN (SELECT * REPLACE (CASE WHEN gpr_act < 26 THEN gpr_act END AS gpr_act) FROM {{risk}}) USING (date)))
SELECT date, {rr('"att_UA"', 6)} AS "att_UA", {rr('"tone_WEST"', 6)} AS "tone_WEST", gpr_act, gpr_threat,
  CAST(sum(CASE WHEN date - p > 2 THEN 1 ELSE 0 END) OVER (ORDER BY date) AS INTEGER) AS block FROM j
""")
def outcome_panel(x):
    wide = panels.perception_indices(x.labels())
    risk = x.view("risk").withColumn("gpr_act", F.expr("IF(gpr_act < 26, gpr_act, NULL)"))
    both = wide.join(risk, "date").withColumn("k", F.lit("p"))
    out = series.blocks(both, "k", 2).select(
        "date", "att_UA", "tone_WEST", "gpr_act", "gpr_threat", "block")
    return rounded(out, 6, "att_UA", "tone_WEST")


@query("A16", DAILY_SQL)
def parquet_sink_round_trip(x):
    """The daily label table written by month and read back."""
    folder = scratch(x.spark)
    table = daily.daily_labels(x.view("articles")).withColumn("month", F.trunc("day", "month"))
    tables.write_partitioned(table, folder, ["month"])
    return rounded_daily(x.spark.read.parquet(folder).drop("month"))


@query("K9 A1", f"SELECT * FROM ({DAILY_SQL}) WHERE {IN_SPANS}")
def reused_label_table(x):
    """The daily label table that all queries of this input share; only the months asked for are opened."""
    return rounded_daily(x.daily("daily_labels", daily.daily_labels).read(SPANS))


@query("F5", " INTERSECT ".join(f"SELECT date FROM {{prices}} WHERE ticker = '{t}'" for t in _TICKERS))
def common_days(x):
    """Days on which every series is quoted: one count a day against the number of series."""
    p = x.view("prices").select("date", "ticker").distinct()
    n = p.agg(F.count_distinct("ticker").alias("all"))
    return p.groupBy("date").agg(F.count("*").alias("n")).join(F.broadcast(n), F.col("n") == F.col("all")).select("date")


_GRID = {"2017-19 episodes": ("2017-04-23", "2019-10-21"), "all ingested days": None}


@query("C15", f"""
SELECT "window", target, count(*) AS n, count(y) AS n_known, min(date) AS first_day, {rr('avg(y)', 6)} AS mean_y FROM (
  SELECT w AS "window", ticker AS target, date, ret AS y FROM ({RET}) CROSS JOIN (
    SELECT '2017-19 episodes' AS w, DATE '2017-04-23' AS a, DATE '2019-10-21' AS b
    UNION ALL SELECT 'all ingested days', DATE '1900-01-01', DATE '2100-01-01') WHERE date BETWEEN a AND b) GROUP BY 1, 2 HAVING count(y) >= 40
""")
def grid_cells(x):
    """(window, target) cells and the days each one uses."""
    from tidewire.operators import grids
    rows = grids.in_windows(returns(x), _GRID).withColumn("target", F.col("ticker"))
    kept = grids.enough_targets(rows.withColumn("y", F.col("ret")), ["window", "target"])
    return rounded(kept.groupBy("window", "target").agg(
        F.count("*").alias("n"), F.count("y").alias("n_known"), F.min("date").alias("first_day"),
        F.avg("y").alias("mean_y")), 6, "mean_y")


@query("H1 I18", """
WITH p AS (SELECT series, date, CAST(row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS INTEGER) AS pos,
    CAST(floor(count(*) OVER (PARTITION BY series) * 0.75) AS INTEGER) AS ts FROM {rates})
SELECT series, date, pos, ts AS test_start,
  CASE WHEN pos >= ts THEN CAST(ts + floor((pos - ts) / 21.0) * 21 AS INTEGER) END AS use_step,
  CAST(ts + greatest(0, ceil((pos + 5 - ts) / 21.0)) * 21 AS INTEGER) AS train_step FROM p
""")
def walk_forward_cutoffs(x):
    from tidewire.operators import forecasting
    out = forecasting.walk_forward(x.view("rates"), ["series"], 5, refit=21)
    return out.select("series", "date", "pos", "test_start", "use_step", "train_step")


def _panel_twin():
    from tidewire.plans.queries import forecasts as f

    columns = f._SET_F + f._SET_P + f._SET_N + f._SET_G
    return f"SELECT date, {', '.join(f'{rr(c, 6)} AS {c}' for c in columns)} FROM ({f.panel_sql()})"


@query("K6", _panel_twin())
def model_panel_rows(x):
    from tidewire.plans.queries.forecasts import model_panel
    panel, sets = model_panel(x)
    # The event table gives its two ratios to eight digits.
    ratios = rounded(panel.select("date", *sets["PNG"]), 8, "interception_rate_lag1", "weapon_diversity_lag1")
    return rounded(ratios, 6, *sets["PNG"])


# --- streams: each is driven to the end of the table and read back --------------------------

_FEEDS: dict[tuple[str, str], str] = {}


def _feed(x, more=None):
    """Article records as a stream: the batch mapping written once for all streams of a session, then
    read as files. ``more`` makes rows that are delivered last, into a feed of its own."""
    batch = x.view("articles").withColumn("ts", F.timestamp_seconds(F.unix_date("day").cast("bigint") * 86400))
    key = (x.spark.sparkContext.applicationId, x.folder)
    place = _FEEDS.get(key) if more is None else None
    if place is None:
        place = f"{scratch(x.spark)}/in"
        batch.repartitionByRange("day").write.mode("overwrite").parquet(place)
        feeds.ordered_files(x.spark, place)
        if more is None:
            _FEEDS[key] = place
        else:
            more(batch).write.mode("append").parquet(place)
    return feeds.read_feed(x.spark, place, batch.schema), scratch(x.spark)


def _url_feed(x):
    """The URL of every article record as a stream. No URL waits for a time, so records are written as they
    come, without the shuffle by day and the other columns of :func:`_feed`."""
    urls = x.view("articles").select("url")
    place = f"{scratch(x.spark)}/in"
    urls.write.parquet(place)
    return feeds.read_feed(x.spark, place, urls.schema)


def _drain(stream, folder: str):
    """Run a stream to the end of its feed, into files, and read them."""
    stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query("J1 J2", DAILY_SQL)
def streamed_daily_labels(x):
    """The daily label table from micro-batches upserted by (day, ecosystem)."""
    feed, folder = _feed(x)
    counts = feeds.daily_counts(feed)
    counts = counts.withColumn("month", F.trunc("day", "month"))
    feeds.upsert_stream(
        counts, f"{folder}/table", f"{folder}/state", ["day", "ecosystem"], "month",
    ).trigger(availableNow=True).start().awaitTermination()
    return rounded_daily(feeds.ratios(x.spark.read.parquet(f"{folder}/table")))


@query("J3", """
SELECT publisher, min(day) AS first_day, max(day) + 7 AS closed_day, count(*) AS n FROM (
  SELECT publisher, day, sum(CASE WHEN day - p <= 7 THEN 0 ELSE 1 END) OVER (
    PARTITION BY publisher ORDER BY day, article_id, rn) AS block FROM (
    SELECT *, lag(day) OVER (PARTITION BY publisher ORDER BY day, article_id, rn) AS p FROM (
      SELECT *, row_number() OVER () AS rn FROM {articles}))) GROUP BY publisher, block
""")
def streamed_activity_blocks(x):
    # One record long after the last closes every block; its own stays open.
    def end(batch):
        last = batch.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 60 DAYS"))
        return last.withColumn("publisher", F.lit("end of feed"))

    feed, folder = _feed(x, end)
    out = _drain(feeds.activity_blocks(feed, "publisher", "168 hours"), folder)
    return out.select("publisher", feeds._utc_day(F.col("start")).alias("first_day"),
                      feeds._utc_day(F.col("end")).alias("closed_day"), "n")


@query("J4", "SELECT DISTINCT url FROM {articles}")
def streamed_distinct_urls(x):
    feed, folder = _url_feed(x), scratch(x.spark)
    with feeds.store_on_disk(x.spark):
        feeds.distinct_urls_table(feed, f"{folder}/out", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return x.spark.read.parquet(f"{folder}/out").select("url")
