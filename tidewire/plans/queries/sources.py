"""Readers, guards, merges and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire import fixed_values as fixed
from tidewire.functions import columns as c
from tidewire.operators import daily, labelling
from tidewire.plans.registry import query
from tidewire.plans.sqltext import names, r, rr
from tidewire.sources import articles as feed, guard, markets, tables


_PRICED = {"l_shipdate": "8 * count(l_shipdate)", "l_suppkey": "8 * count(l_suppkey)", "l_linenumber": "4 * count(l_linenumber)",
           "l_returnflag": "sum(strlen(l_returnflag))", "l_quantity": "8 * count(l_quantity)"}


@query("A2", " UNION ALL ".join(
    f"SELECT '{k}' AS \"column\", CAST({v} AS BIGINT) AS bytes, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_files FROM {{lineitem}}"
    for k, v in _PRICED.items()))
def column_scan_costs(x):
    """Bytes by column of a projection of the largest table, from statistics of its files."""
    guard.guarded_scan(x.spark, x.path("lineitem"), list(_PRICED), 10 ** 15)
    return guard.scan_price(x.spark, x.path("lineitem"), list(_PRICED))


UPSERT_SQL = """
WITH base AS (SELECT day, publisher, count(*) AS n, sum(words) AS words FROM {articles}
              WHERE publisher IS NOT NULL GROUP BY 1, 2),
fresh AS (SELECT day, publisher, count(*) AS n, -1 AS words FROM {articles}
          WHERE publisher IS NOT NULL AND words > 40 GROUP BY 1, 2)
SELECT day, publisher, n, CAST(words AS BIGINT) AS words FROM (
  SELECT *, row_number() OVER (PARTITION BY day, publisher ORDER BY side DESC) AS rn FROM (
    SELECT *, 0 AS side FROM base UNION ALL SELECT *, 1 AS side FROM fresh)) WHERE rn = 1
"""


def _two_batches(x):
    arts = x.view("articles").filter("publisher IS NOT NULL")
    base = arts.groupBy("day", "publisher").agg(
        F.count("*").alias("n"), F.sum("words").alias("words"))
    fresh = arts.filter("words > 40").groupBy("day", "publisher").agg(
        F.count("*").alias("n"), F.lit(-1).cast("bigint").alias("words"))
    return base, fresh


@query("A3 Q13", UPSERT_SQL)
def upsert_keep_last(x):
    base, fresh = _two_batches(x)
    return tables.upsert(base, fresh, ["day", "publisher"])


@query("F2 A3", UPSERT_SQL.replace("ORDER BY side DESC", "ORDER BY side"))
def union_keep_first(x):
    base, fresh = _two_batches(x)
    return tables.upsert(base, fresh, ["day", "publisher"], keep="first")


def _v1_lines(x):
    fields = ["concat('20', date_format(day, 'yyMMdd'))"] + ["'f'"] * 8 + [
        "concat('www.', coalesce(publisher, ''), '; ', upper(coalesce(publisher, '')))"]
    extra = "CASE WHEN words > 45 THEN '' ELSE '\tlast' END"
    line = f"concat(concat_ws('\t', {', '.join(fields)}), {extra})"
    return x.view("articles").selectExpr(
        f"CASE WHEN words = 1 THEN concat('x', {line}) ELSE {line} END AS value",
        "concat('file', substr(CAST(day AS STRING), 1, 4)) AS file")


@query("A6 D7", """
SELECT file, host, tld, count(*) AS n FROM (
  SELECT concat('file', substr(CAST(day AS STRING), 1, 4)) AS file,
    unnest([concat('www.', coalesce(publisher, '')), lower(coalesce(publisher, ''))]) AS host,
    CASE WHEN publisher IS NULL THEN NULL ELSE regexp_extract(publisher, '([^.]+)$', 1) END AS t,
    coalesce(t, '') AS tld
  FROM {articles} WHERE words <> 1 AND words <= 45) WHERE host <> '' GROUP BY 1, 2, 3
""")
def feed_v1_hosts(x):
    hosts = feed.read_feed_v1(_v1_lines(x))
    return hosts.groupBy("file", "host", "tld").agg(F.count("*").alias("n"))


def _v2_lines(x):
    fields = ["date_format(day, 'yyyyMMdd')", "'1'", "'2'", "coalesce(publisher, '')"]
    fields += ["'f'"] * 20 + ["coalesce(translation_info, '')"]
    line = f"concat_ws('\t', {', '.join(fields)})"
    return x.view("articles").selectExpr(
        f"CASE WHEN words > 45 THEN {line} ELSE concat({line}, '\ttail') END AS value",
        "concat('file', substr(CAST(day AS STRING), 1, 4)) AS file")


V2_ROWS = """
SELECT concat('file', substr(CAST(day AS STRING), 1, 4)) AS file,
  coalesce(publisher, '') AS publisher,
  CASE WHEN publisher IS NULL THEN '' ELSE regexp_extract(publisher, '([^.]+)$', 1) END AS tld,
  CASE WHEN translation_info LIKE '%srclc:%'
       THEN regexp_extract(translation_info, 'srclc:([a-z]+)', 1) ELSE 'eng (native)' END AS lang
FROM {articles} WHERE words <= 45
"""


@query("A7", f"SELECT file, publisher, tld, lang, count(*) AS n FROM ({V2_ROWS}) GROUP BY ALL")
def feed_v2_records(x):
    rows = feed.read_feed_v2(_v2_lines(x))
    return rows.groupBy("file", "publisher", "tld", "lang").agg(F.count("*").alias("n"))


@query("D7", f"""
SELECT file, CASE WHEN grouping(tld) = 1 AND grouping(lang) = 1 THEN 'file'
    WHEN grouping(lang) = 1 THEN 'tld' ELSE 'lang' END AS level,
  coalesce(tld, lang) AS key, count(*) AS n,
  count(*) FILTER (WHERE tld IN ('ru', 'ua')) AS n_ru_ua
FROM ({V2_ROWS}) GROUP BY GROUPING SETS ((file), (file, tld), (file, lang))
""")
def stream_composition(x):
    return daily.stream_composition(feed.read_feed_v2(_v2_lines(x)))


def _chart_payloads(x):
    bars = x.view("prices").selectExpr(
        "ticker", "date", "unix_date(date) * 86400L + 52200 AS ts", "adjclose",
        "CASE WHEN adjclose > 400000 THEN NULL ELSE adjclose END AS close", "0 AS late")
    again = bars.filter("adjclose < 100000").selectExpr(
        "ticker", "date", "ts + 60 AS ts", "adjclose + 1 AS adjclose", "close + 1 AS close",
        "1 AS late")
    ordered = bars.unionByName(again).groupBy("ticker").agg(F.array_sort(F.collect_list(
        F.struct("ts", "adjclose", "close"))).alias("b"))
    doc = F.struct(F.struct(F.array(F.struct(
        F.col("b.ts").alias("timestamp"),
        F.struct(
            F.array(F.struct(F.col("b.close").alias("close"), F.col("b.close").alias("open"))
                    ).alias("quote"),
            F.when(F.col("ticker") != "T5", F.array(F.struct(F.col("b.adjclose").alias("adjclose")))
                   ).alias("adjclose"),
        ).alias("indicators"),
    )).alias("result")).alias("chart"))
    good = ordered.select("ticker", F.to_json(doc, {"ignoreNullFields": "false"}).alias("payload"))
    bad = x.view("prices").groupBy("ticker").agg(F.count("*").alias("n")).select(
        F.concat(F.lit("BAD-"), "ticker").alias("ticker"),
        F.when(F.col("ticker") < "T3", '{"chart": {"result": null, "error": "Not Found"}}')
        .otherwise('{"chart": {"result": [{"timestamp": []}]}}').alias("payload"))
    return good.unionByName(bad)


@query("A8", """
SELECT ticker, date, close, CASE WHEN ticker = 'T5' THEN close ELSE adjclose END AS adjclose
FROM (SELECT ticker, date, adjclose + (CASE WHEN adjclose < 100000 THEN 1 ELSE 0 END) AS adjclose,
  CASE WHEN adjclose > 400000 THEN NULL
       ELSE adjclose + (CASE WHEN adjclose < 100000 THEN 1 ELSE 0 END) END AS close
  FROM {prices}) WHERE close IS NOT NULL
""")
def chart_payload_rows(x):
    return markets.read_chart_json(_chart_payloads(x)).select("ticker", "date", "close", "adjclose")


@query("A8", """
SELECT concat('BAD-', ticker) AS ticker, CASE WHEN ticker < 'T3' THEN 'no result in payload'
  ELSE 'no timestamps in payload' END AS reason FROM {prices} GROUP BY ticker
""")
def chart_payload_rejects(x):
    return markets.chart_rejects(_chart_payloads(x))


def _export(x):
    prices = x.view("prices")
    w = F.row_number().over(
        labelling.Window.partitionBy("ticker").orderBy(F.desc("date")))
    body = prices.select(
        F.col("ticker").alias("file"), (w + 6).alias("rn"),
        F.when(F.dayofmonth("date") == 31, "n/a").otherwise(F.col("date").cast("string")).alias("c0"),
        F.when(F.col("adjclose") > 400000, "#N/A").otherwise(
            F.col("adjclose").cast("string")).alias("c1"),
        F.lit("7").alias("c2"))
    heads = prices.select(F.col("ticker").alias("file")).distinct().select("file", F.inline(F.array(*[
        F.struct(F.lit(i).alias("rn"), F.lit(a).alias("c0"), F.lit(b).alias("c1"), F.lit(b).alias("c2"))
        for i, (a, b) in enumerate([
            ("Security", "INDEX"), ("Start Date", "2015-01-01"), ("End Date", None),
            ("Period", "D"), ("Currency", "EUR"), ("Date", "PX_LAST")])])))
    return body.unionByName(heads)


EXPORT_SQL = """
SELECT ticker AS file, date, adjclose AS px, CAST(7 AS DOUBLE) AS volume FROM {prices}
WHERE day(date) <> 31 AND adjclose <= 400000
"""


@query("A9", EXPORT_SQL)
def index_export_rows(x):
    return markets.read_index_export(_export(x))


WIDE = ", ".join(f"max(px) FILTER (WHERE file = 'T{i}') AS \"T{i}\"" for i in range(1, 6))


@query("A10 C3 D23", f"SELECT date, {WIDE} FROM ({EXPORT_SQL}) GROUP BY date")
def index_panel(x):
    rows = markets.read_index_export(_export(x))
    return markets.join_series(rows, [f"T{i}" for i in range(1, 6)], key="file", value="px")


@query("A11", """
SELECT date, gpr, CASE WHEN gpr_act > 40 THEN NULL ELSE gpr_act END AS gpr_act, gpr_threat
FROM {risk}
""")
def risk_index_rows(x):
    raw = x.view("risk").select(
        F.date_format("date", "yyyyMMdd").cast("int").alias("DAY"),
        F.col("gpr").cast("string").alias("GPRD"),
        F.when(F.col("gpr_act") > 40, "?").otherwise(F.col("gpr_act").cast("string")).alias("GPRD_ACT"),
        F.col("gpr_threat").cast("string").alias("GPRD_THREAT"))
    return markets.read_risk_index(raw)


RATES_SQL = """
SELECT date, CASE series WHEN 'VIXCLS' THEN 'vix' WHEN 'DCOILBRENTEU' THEN 'brent'
  WHEN 'DEXUSEU' THEN 'usd_eur' WHEN 'DGS10' THEN 'ust10y' ELSE 'usd_broad' END AS series,
  CASE WHEN day(date) = 1 THEN NULL ELSE value END AS value FROM {rates}
"""


def rate_parts(x):
    rates = x.view("rates")
    text = F.when(F.dayofmonth("date") == 1, ".").otherwise(F.col("value").cast("string"))
    parts = []
    for i, sid in enumerate(fixed.RATE_NAMES):
        raw = rates.filter(F.col("series") == sid).select(
            F.col("date").cast("string").alias("DATE" if i else "observation_date"),
            text.alias(sid))
        parts.append(markets.read_rate_series(raw, sid))
    return parts


@query("A12", RATES_SQL)
def rate_series_rows(x):
    parts = rate_parts(x)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


RATE_COLS = ", ".join(
    f"max(value) FILTER (WHERE series = '{n}') AS {n}" for n in fixed.RATE_NAMES.values())


@query("A13 C3", f"SELECT date, {RATE_COLS} FROM ({RATES_SQL}) GROUP BY date")
def rate_panel(x):
    return markets.rate_panel(rate_parts(x), list(fixed.RATE_NAMES.values()))


def sheets(x):
    """All yearly sheets as one table, in the headings of a sheet."""
    rows = x.view("revenue").select(
        F.col("year").alias("Year"), F.col("company").alias("Company"), F.col("country").alias("Country/Region"),
        F.col("arms").alias("Arms revenues"),
        F.when(F.col("total") > 4e6, None).otherwise(F.col("total")).alias("Total revenues"))
    return markets.read_exposure_sheet(rows)


EXPOSURE_SQL = """
SELECT year, company, country, arms, CASE WHEN total > 4e6 THEN NULL ELSE total END AS total,
  regexp_replace(lower(company), ' (corp\\.|plc)$', '') AS key,
  CASE WHEN total <= 4e6 THEN least(greatest(arms / total, 0), 1) END AS arms_share
FROM {revenue}
"""


@query("A14 B18", f"SELECT * REPLACE ({rr('arms_share', 8)} AS arms_share) FROM ({EXPOSURE_SQL})")
def exposure_sheet_rows(x):
    return sheets(x).withColumn("arms_share", r(F.col("arms_share"), 8))


MAP_ROWS = [(f"NATION_{i} Group" if i % 2 else f"nation_{i} corp.", f"TK{i // 2}")
            for i in range(20)]
MAP_VALUES = ", ".join(f"('nation_{i}', 'TK{i // 2}')" for i in range(20))


def name_map(x):
    return x.spark.createDataFrame(MAP_ROWS, "name string, ticker string")


MATCHED_SQL = f"""
SELECT ticker, year, min(company) AS company, arg_min(country, company) AS country,
  round(sum(arms), 2) AS arms, max(total) AS total, avg(arms_share) AS arms_share
FROM ({EXPOSURE_SQL}) e JOIN (VALUES {MAP_VALUES}) m(key, ticker) USING (key) GROUP BY 1, 2
"""


@query("C8 D10", MATCHED_SQL.replace("avg(arms_share) AS", f"{rr('avg(arms_share)', 7)} AS"))
def exposure_by_year(x):
    out = markets.match_tickers(sheets(x), name_map(x))
    return out.withColumns({"arms": r(F.col("arms"), 2), "arms_share": r(F.col("arms_share"), 7)})


@query("D11", f"""
SELECT ticker, arg_min(company, year) AS company, arg_min(country, year) AS country,
  {rr('avg(arms_share)', 7)} AS arms_share, count(DISTINCT year) AS years, max(year) AS last_year
FROM ({MATCHED_SQL}) GROUP BY 1
""")
def exposure_by_ticker(x):
    out = markets.exposure_by_ticker(markets.match_tickers(sheets(x), name_map(x)))
    return out.withColumn("arms_share", r(F.col("arms_share"), 7))


@query("A15 B13", f"""
SELECT "group", count(DISTINCT publisher) AS n_domains, count(*) AS n_articles FROM {{articles}}
JOIN (SELECT unnest([{names(fixed.UA_DOMAINS)}]) AS publisher, 'UA' AS "group"
      UNION ALL SELECT unnest([{names(fixed.RU_STATE)}]), 'RU_STATE'
      UNION ALL SELECT unnest([{names(fixed.RU_INDEP)}]), 'RU_INDEP'
      UNION ALL SELECT unnest([{names(fixed.WEST_DOMAINS)}]), 'WEST') USING (publisher) GROUP BY 1
""")
def config_lookup_join(x):
    lists = {"UA": fixed.UA_DOMAINS, "RU_STATE": fixed.RU_STATE, "RU_INDEP": fixed.RU_INDEP,
             "WEST": fixed.WEST_DOMAINS}
    table = labelling.lookup(x.spark, lists, "publisher", "group")
    return x.view("articles").join(F.broadcast(table), "publisher").groupBy("group").agg(
        F.count_distinct("publisher").alias("n_domains"), F.count("*").alias("n_articles"))


HOST = ("regexp_replace(regexp_extract(lower(url), "
        "'^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)', 1), '^www\\.', '')")


@query("B9", f"SELECT page_id, {HOST} AS host FROM {{pages}}")
def page_hosts(x):
    return x.table("pages").select("page_id", c.host("url").alias("host"))


@query("B10", f"""
SELECT DISTINCT h.host, d.domain FROM (SELECT DISTINCT {HOST} AS host FROM {{pages}}) h
JOIN (SELECT DISTINCT regexp_replace({HOST}, '^(m|blog)\\.', '') AS domain FROM {{pages}}) d
ON h.host <> '' AND (h.host = d.domain OR ends_with(h.host, '.' || d.domain)
   OR ends_with(d.domain, '.' || h.host))
""")
def site_confirmations(x):
    from tidewire.operators import audit
    hosts = x.table("pages").select(c.host("url").alias("host")).distinct()
    domains = hosts.select(
        F.regexp_replace("host", r"^(m|blog)\.", "").alias("domain")).distinct()
    return audit.confirm_sites(hosts, domains)


@query("B12 E22", f"""
SELECT d AS date, CASE WHEN d >= DATE '2022-09-29' THEN 'attrition'
    WHEN d >= DATE '2022-02-24' THEN 'invasion' WHEN d >= DATE '2021-11-01' THEN 'buildup'
    ELSE 'pre_war' END AS regime,
  CAST(d - DATE '2022-02-24' AS INTEGER) AS days_since_invasion,
  dayofweek(d) IN (0, 6) AS is_weekend, CAST(year(d) AS INTEGER) AS year,
  CAST(d < DATE '2021-11-01' AS INTEGER) AS regime_pre_war,
  CAST(d >= DATE '2021-11-01' AND d < DATE '2022-02-24' AS INTEGER) AS regime_buildup,
  CAST(d >= DATE '2022-02-24' AND d < DATE '2022-09-29' AS INTEGER) AS regime_invasion,
  CAST(d >= DATE '2022-09-29' AS INTEGER) AS regime_attrition
FROM (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS d
      FROM {{articles}})
""")
def calendar_spine(x):
    from tidewire.operators import series
    ends = x.view("articles").agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    return series.calendar_spine(x.spark, str(ends["a"]), str(ends["b"]))


@query("B11", """
SELECT CASE WHEN day >= DATE '2022-09-29' THEN 'attrition'
    WHEN day >= DATE '2022-02-24' THEN 'invasion' WHEN day >= DATE '2021-11-01' THEN 'buildup'
    ELSE 'pre_war' END AS regime,
  CASE WHEN day < DATE '2022-02-24' THEN 'pre-war' WHEN day < DATE '2022-09-29' THEN 'invasion'
    ELSE 'measured' END AS period, count(*) AS n, min(day) AS first_day, max(day) AS last_day
FROM {articles} GROUP BY 1, 2
""")
def regime_labels(x):
    return x.view("articles").groupBy(
        c.regime("day").alias("regime"), c.observation_period("day").alias("period")
    ).agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


KEYWORDS = [
    {"name": "subject_and_weapon", "any": {"en": ["that", "three"], "de": ["und", "der"]},
     "weapon": {"en": ["retitioning", "thing", "whither"], "de": ["die"]}},
    {"name": "english_only", "any": {"en": ["been for", "with by", "the of"]}},
    {"name": "french", "any": {"fr": ["dans", "que", "éreaux"]}},
]


def _any_word(words):
    return "(" + " OR ".join(
        f"regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}]){w}($|[^\\p{{L}}\\p{{N}}])')"
        for w in words) + ")"


def _keyword_sql():
    parts = []
    for q in KEYWORDS:
        tests = []
        for code, words in q["any"].items():
            t = f"lang = '{code}' AND {_any_word(words)}"
            if q.get("weapon", {}).get(code):
                t += f" AND {_any_word(q['weapon'][code])}"
            tests.append(f"({t})")
        parts.append(f"SELECT doc_id, '{q['name']}' AS query FROM [[documents]] "
                     f"WHERE {' OR '.join(tests)}")
    return " UNION ALL ".join(parts).replace("[[", "{").replace("]]", "}")


@query("B15", _keyword_sql())
def keyword_matches(x):
    return labelling.keyword_queries(x.table("documents"), KEYWORDS, "doc_id")


WEAPON_RULES = [
    ("hot gear", "uav", True), ("gear", "ballistic_missile", False),
    ("red", "cruise_missile", False), ("widget", "uav", False), ("small", "recon_uav", False),
    ("BLUE", "loitering_munition", False), ("bolt", "guided_bomb", False),
]


WEAPON_CASE = """CASE WHEN lower(model) = 'hot gear' THEN 'uav'
 WHEN contains(lower(model), 'gear') THEN 'ballistic_missile'
 WHEN contains(lower(model), 'red') THEN 'cruise_missile'
 WHEN contains(lower(model), 'blue') THEN 'loitering_munition'
 WHEN contains(lower(model), 'widget') THEN 'uav'
 WHEN contains(lower(model), 'small') THEN 'recon_uav'
 WHEN contains(lower(model), 'bolt') THEN 'guided_bomb' ELSE 'other' END"""


@query("B19", f"SELECT model, {WEAPON_CASE} AS weapon_class, count(*) AS n FROM {{attacks}} GROUP BY 1, 2")
def weapon_classes(x):
    return x.view("attacks").groupBy(
        "model", labelling.weapon_class("model", WEAPON_RULES).alias("weapon_class")
    ).agg(F.count("*").alias("n"))


_SUMS = ", ".join(
    f"coalesce(sum(CASE WHEN k = '{k}' THEN launched END), 0)::BIGINT AS launched_{k}, "
    f"coalesce(sum(CASE WHEN k = '{k}' THEN destroyed END), 0)::BIGINT AS destroyed_{k}"
    for k in fixed.WEAPON_CLASSES)
_DIV = " + ".join(f"(launched_{k}::DOUBLE / launched_total) ** 2" for k in fixed.WEAPON_CLASSES)
EVENTS_SQL = f"""
WITH rows AS (SELECT greatest(CAST(time_start AS DATE), CAST(time_end AS DATE)) AS day,
    {WEAPON_CASE} AS k, CASE WHEN launched >= 0 THEN launched END AS launched,
    CASE WHEN destroyed >= 0 THEN destroyed END AS destroyed FROM {{attacks}}),
daily AS (SELECT day, sum(launched) AS launched_total, sum(destroyed) AS destroyed_total,
    {_SUMS}, count(*) AS n_attack_events FROM rows GROUP BY day),
cal AS (SELECT CAST(unnest(generate_series(min(day), max(day) + 3, INTERVAL 1 DAY)) AS DATE) AS day
        FROM rows)
SELECT day, coalesce(launched_total, 0)::BIGINT AS launched_total,
  coalesce(destroyed_total, 0)::BIGINT AS destroyed_total,
  {', '.join(f'coalesce(launched_{k}, 0) AS launched_{k}, coalesce(destroyed_{k}, 0) AS destroyed_{k}' for k in fixed.WEAPON_CLASSES)},
  coalesce(n_attack_events, 0) AS n_attack_events,
  {rr('CASE WHEN launched_total > 0 THEN destroyed_total / launched_total END', 8)} AS interception_rate,
  {rr(f'CASE WHEN launched_total > 0 THEN 1 - ({_DIV}) END', 8)} AS weapon_diversity,
  {rr('ln(1 + coalesce(launched_total, 0))', 8)} AS war_intensity
FROM cal LEFT JOIN daily USING (day)
"""


def event_table(x):
    from tidewire.operators import series
    records = x.view("attacks").withColumn(
        "weapon_class", labelling.weapon_class("model", WEAPON_RULES))
    ends = records.agg(
        F.min(F.to_date("time_end")).alias("a"),
        F.date_add(F.max(F.to_date("time_end")), 3).alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    return daily.event_table(records, days)


@query("D24 B21", EVENTS_SQL)
def daily_event_table(x):
    out = event_table(x)
    return out.withColumns({k: r(F.col(k), 8) for k in
                            ("interception_rate", "weapon_diversity", "war_intensity")})
