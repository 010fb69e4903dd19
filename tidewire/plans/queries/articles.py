"""Scans, labels and daily tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from tidewire import fixed_values as fixed
from tidewire.functions import columns as c
from tidewire.operators import daily, labelling
from tidewire.plans.registry import query
from tidewire.plans.sqltext import (
    TONE, TLD, LANG, CONFLICT, LABEL, label_case, names, r, rr, tld_group_case,
)
from tidewire.sources import articles as scan

SPANS = [("2016-12-01", "2017-12-31"), ("2021-11-01", "2022-06-05")]
IN_SPANS = " OR ".join(f"day BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in SPANS)


@query("A1", f"""
SELECT day, count(*) AS n, count(DISTINCT publisher) AS n_publishers
FROM {{articles}} WHERE ({IN_SPANS}) AND publisher IS NOT NULL GROUP BY day
""")
def article_scan(x):
    # The mapping moves days forward; moving the spans back instead lets them reach the files.
    back = [tuple(str(date.fromisoformat(d) - timedelta(days=8000)) for d in span) for span in SPANS]
    few = x.table("lineitem").filter(scan.in_spans(F.col("l_shipdate"), back))
    rows = scan.scan_articles(x.view("articles", lineitem=few), SPANS)
    return rows.groupBy("day").agg(
        F.count("*").alias("n"), F.count_distinct("publisher").alias("n_publishers"))


PRESET_VALUES = ", ".join(
    f"('{p}', '{t}', DATE '{a}', DATE '{b}')"
    for p, (t, _, spans) in fixed.SPAN_PRESETS.items() for a, b in spans)


@query("A4", f"""
SELECT p.preset, p.target, count(*) AS n, min(a.day) AS first_day, max(a.day) AS last_day
FROM {{articles}} a JOIN (VALUES {PRESET_VALUES}) p(preset, target, s, e)
  ON a.day BETWEEN p.s AND p.e GROUP BY 1, 2
""")
def preset_routing(x):
    presets = scan.preset_spans(x.spark)
    routed = scan.route_to_presets(x.view("articles").select("day"), presets)
    return routed.groupBy("preset", "target").agg(
        F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("A5", """
SELECT CAST(day AS DATE) AS day, CAST(translation_info AS VARCHAR) AS ecosystem,
  CAST(count(*) AS BIGINT) AS n_total, CAST(count(themes) AS BIGINT) AS n_conflict,
  CAST(max(words) AS DOUBLE) AS share, CAST(min(words) AS DOUBLE) AS tone_conflict,
  CAST(NULL AS DOUBLE) AS tone_all
FROM {articles} GROUP BY day, translation_info
""")
def schema_normalised(x):
    raw = x.view("articles").groupBy("day", "translation_info").agg(
        F.count("*").alias("n"), F.count("themes").alias("m"),
        F.max("words").alias("hi"), F.min("words").alias("lo"))
    texts = raw.select(
        F.col("day").cast("string").alias("day"), F.col("translation_info").alias("ecosystem"),
        F.col("n").cast("string").alias("n_total"), F.col("m").cast("double").alias("n_conflict"),
        F.col("hi").cast("string").alias("share"), F.col("lo").alias("tone_conflict"),
        F.lit(float("nan")).alias("tone_all"))
    return scan.normalise(texts, scan.DAILY_SCHEMAS["ecosystem"])


@query("B1 B2 B3 B4", f"""
SELECT {LANG} AS lang, {TLD} AS tld, coalesce({CONFLICT}, false) AS conflict,
  count(*) AS n, {rr(f'avg({TONE})', 6)} AS mean_tone, count({TONE}) AS n_tone
FROM {{articles}} GROUP BY 1, 2, 3
""")
def field_extraction(x):
    return x.view("articles").groupBy(
        c.src_lang("translation_info").alias("lang"), c.tld("publisher").alias("tld"),
        F.coalesce(c.is_conflict("locations"), F.lit(False)).alias("conflict"),
    ).agg(F.count("*").alias("n"), r(F.avg(c.lead_tone("v2tone")), 6).alias("mean_tone"),
          F.count(c.lead_tone("v2tone")).alias("n_tone"))


@query("B5", f"""
SELECT themes,
  list_has_any(string_split(themes, ';'), [{names(fixed.ACT_THEMES)}]) AS act,
  list_has_any(string_split(themes, ';'), [{names(fixed.THREAT_THEMES)}])
    AS threat, count(*) AS n
FROM {{articles}} GROUP BY 1, 2, 3
""")
def theme_membership(x):
    return x.view("articles").groupBy(
        "themes", c.has_theme("themes", fixed.ACT_THEMES).alias("act"),
        c.has_theme("themes", fixed.THREAT_THEMES).alias("threat"),
    ).agg(F.count("*").alias("n"))


@query("B6", f"""
SELECT publisher, {LANG} AS lang, {LABEL} AS ecosystem, count(*) AS n
FROM {{articles}} GROUP BY 1, 2, 3
""")
def publisher_labels(x):
    lang = c.src_lang("translation_info")
    return x.view("articles").groupBy(
        "publisher", lang.alias("lang"), labelling.label("publisher", lang).alias("ecosystem"),
    ).agg(F.count("*").alias("n"))


VARIANT_UNION = " UNION ALL ".join(
    f"SELECT day, '{v}' AS variant, {label_case(v)} AS ecosystem, locations, v2tone "
    f"FROM {{articles}} WHERE publisher IS NOT NULL" for v in labelling.VARIANTS)


def _measures() -> str:
    return f"""count(*) AS n_total, count(*) FILTER (WHERE {CONFLICT}) AS n_conflict,
  {rr(f'count(*) FILTER (WHERE {CONFLICT})::DOUBLE / count(*)', 8)} AS share,
  {rr(f'avg(CASE WHEN {CONFLICT} THEN {TONE} END)', 6)} AS tone_conflict,
  {rr(f'avg({TONE})', 6)} AS tone_all"""


DAILY_SQL = f"""
SELECT day, ecosystem, {_measures()} FROM (
  SELECT *, {LABEL} AS ecosystem FROM {{articles}} WHERE publisher IS NOT NULL)
WHERE ecosystem <> 'AGGREGATOR' GROUP BY day, ecosystem
"""


DAILY_RAW = f"""
SELECT day, ecosystem, count(*) AS n_total, count(*) FILTER (WHERE {CONFLICT}) AS n_conflict,
  count(*) FILTER (WHERE {CONFLICT})::DOUBLE / count(*) AS share,
  avg(CASE WHEN {CONFLICT} THEN {TONE} END) AS tone_conflict, avg({TONE}) AS tone_all
FROM (SELECT *, {LABEL} AS ecosystem FROM {{articles}} WHERE publisher IS NOT NULL)
WHERE ecosystem <> 'AGGREGATOR' GROUP BY day, ecosystem
"""


def rounded_daily(df):
    return df.withColumns({
        "share": r(F.col("share"), 8), "tone_conflict": r(F.col("tone_conflict"), 6),
        "tone_all": r(F.col("tone_all"), 6)})


@query("D1 B8", DAILY_SQL)
def daily_label_table(x):
    return rounded_daily(daily.daily_labels(x.view("articles")))


@query("D3 B7 K9", f"""
SELECT day, variant, ecosystem, {_measures()} FROM ({VARIANT_UNION})
WHERE ecosystem <> 'AGGREGATOR' GROUP BY day, variant, ecosystem
""")
def daily_variant_table(x):
    return rounded_daily(daily.daily_variants(x.view("articles")))


@query("D2", f"""
SELECT day, ecosystem, count(*) AS n_conflict, count(*) FILTER (WHERE act) AS n_act,
  count(*) FILTER (WHERE threat) AS n_threat,
  {rr('count(*) FILTER (WHERE act)::DOUBLE / count(*)', 8)} AS act_share,
  {rr('count(*) FILTER (WHERE threat)::DOUBLE / count(*)', 8)} AS threat_share
FROM (SELECT day, {LABEL} AS ecosystem,
  list_has_any(string_split(themes, ';'), [{names(fixed.ACT_THEMES)}]) AS act,
  list_has_any(string_split(themes, ';'), [{names(fixed.THREAT_THEMES)}])
    AS threat
  FROM {{articles}} WHERE publisher IS NOT NULL AND themes IS NOT NULL AND {CONFLICT})
WHERE ecosystem NOT IN ('AGGREGATOR', 'OTHER') GROUP BY day, ecosystem
""")
def daily_threat_act_table(x):
    return daily.daily_threat_act(x.view("articles")).withColumns({
        "act_share": r(F.col("act_share"), 8), "threat_share": r(F.col("threat_share"), 8)})


TOP_SQL = f"""
SELECT publisher AS domain, {TLD} AS tld, {LANG} AS srclc, count(*) AS n
FROM {{articles}} WHERE publisher IS NOT NULL AND {CONFLICT} GROUP BY 1, 2, 3
ORDER BY n DESC, domain, srclc NULLS FIRST LIMIT 400
"""


@query("D4 F1", TOP_SQL.replace("LIMIT 400", "LIMIT 50"))
def top_publishers(x):
    return daily.top_publishers(x.view("articles"), None, 50)


@query("D5", f"""
SELECT {LANG} AS srclc, count(*) AS n FROM {{articles}} GROUP BY 1
ORDER BY n DESC, srclc NULLS FIRST LIMIT 15
""")
def language_mix(x):
    return daily.language_mix(x.view("articles"))


@query("D5", f"""
SELECT day, count(*) FILTER (WHERE {LANG} = 'rus') AS rus,
  count(*) FILTER (WHERE {LANG} = 'ukr') AS ukr,
  count(*) FILTER (WHERE translation_info IS NULL OR translation_info = '') AS eng_native,
  count(*) AS total FROM {{articles}} GROUP BY day
""")
def language_coverage(x):
    return daily.language_coverage(x.view("articles"))


@query("D6 F1", f"""
SELECT domain, count(DISTINCT srclc) AS n_languages FROM (
  SELECT * FROM ({TOP_SQL.replace('LIMIT 400', '')}) WHERE tld = 'ru' ORDER BY n DESC, domain, srclc NULLS FIRST LIMIT 20)
GROUP BY domain HAVING count(DISTINCT srclc) > 1
""")
def multilingual_publishers(x):
    return daily.multilingual_publishers(daily.publisher_counts(x.view("articles")), "ru")


@query("F1", f"""
SELECT tld, domain, n, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY tld ORDER BY n DESC, domain) AS INTEGER) AS rank
  FROM (SELECT {TLD} AS tld, publisher AS domain, count(*) AS n FROM {{articles}}
        WHERE publisher IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 3
""")
def largest_publishers_by_tld(x):
    counts = x.view("articles").filter("publisher IS NOT NULL").groupBy(
        c.tld("publisher").alias("tld"), F.col("publisher").alias("domain")
    ).agg(F.count("*").alias("n"))
    return labelling.top_in_group(counts, ["tld"], [F.desc("n"), F.asc("domain")], 3)


@query("B13", f"""
WITH votes AS (
  SELECT publisher, country, n, sum(n) OVER (PARTITION BY publisher) AS total,
    row_number() OVER (PARTITION BY publisher ORDER BY n DESC, country) AS rn
  FROM (SELECT publisher, country, count(*) AS n FROM {{articles}}
        WHERE publisher IS NOT NULL GROUP BY 1, 2)),
g AS (SELECT a.publisher,
  CASE WHEN a.publisher IN ({names(fixed.UA_DOMAINS)}) THEN 'ukrainian'
       WHEN a.publisher IN ({names(fixed.RU_STATE)}) THEN 'russian' END AS dg,
  CASE WHEN v.publisher IS NULL THEN NULL
       WHEN v.country IN ({names(fixed.COUNTRY_GROUPS['ukrainian'])}) THEN 'ukrainian'
       WHEN v.country IN ({names(fixed.COUNTRY_GROUPS['russian'])}) THEN 'russian'
       WHEN v.country IN ({names(fixed.COUNTRY_GROUPS['western'])}) THEN 'western'
       ELSE 'other' END AS cg,
  {tld_group_case('a.publisher')} AS tg
  FROM {{articles}} a LEFT JOIN votes v
    ON v.publisher = a.publisher AND v.rn = 1 AND v.n::DOUBLE / v.total >= 0.34
  WHERE a.publisher IS NOT NULL)
SELECT publisher, coalesce(dg, cg, tg, 'other') AS source_group,
  CASE WHEN dg IS NOT NULL THEN 'domain' WHEN cg IS NOT NULL THEN 'country'
       WHEN tg IS NOT NULL THEN 'tld' ELSE 'none' END AS method, count(*) AS n
FROM g GROUP BY 1, 2, 3
""")
def hybrid_groups(x):
    arts = x.view("articles").filter("publisher IS NOT NULL").select("publisher", "country")
    return labelling.hybrid_group(
        arts.drop("country"), _domain_lists(x), labelling.country_votes(arts),
        _country_lists(x), 0.34,
    ).groupBy("publisher", "source_group", "method").agg(F.count("*").alias("n"))


def _domain_lists(x):
    lists = {"ukrainian": fixed.UA_DOMAINS, "russian": fixed.RU_STATE}
    return labelling.lookup(x.spark, lists, "publisher", "group")


def _country_lists(x):
    return labelling.lookup(x.spark, fixed.COUNTRY_GROUPS, "country", "group")


@query("B14", f"""
WITH votes AS (
  SELECT publisher, country, n, sum(n) OVER (PARTITION BY publisher) AS total,
    row_number() OVER (PARTITION BY publisher ORDER BY n DESC, country) AS rn
  FROM (SELECT publisher, country, count(*) AS n FROM {{articles}}
        WHERE publisher IS NOT NULL GROUP BY 1, 2)),
g AS (SELECT
  CASE WHEN publisher IN ({names(fixed.UA_DOMAINS)}) THEN 'ukrainian'
       WHEN publisher IN ({names(fixed.RU_STATE)}) THEN 'russian' END AS dg,
  CASE WHEN n::DOUBLE / total < 0.5 THEN NULL
       WHEN country IN ({names(fixed.COUNTRY_GROUPS['ukrainian'])}) THEN 'ukrainian'
       WHEN country IN ({names(fixed.COUNTRY_GROUPS['russian'])}) THEN 'russian'
       WHEN country IN ({names(fixed.COUNTRY_GROUPS['western'])}) THEN 'western'
       ELSE 'other' END AS cg,
  {tld_group_case('publisher')} AS tg, total FROM votes WHERE rn = 1)
SELECT strategy, strategy_group, CAST(sum(total) AS BIGINT) AS n FROM (
  SELECT 'domain_only' AS strategy, coalesce(dg, 'other') AS strategy_group, total FROM g
  UNION ALL SELECT 'tld_only', coalesce(tg, 'other'), total FROM g
  UNION ALL SELECT 'country_only', coalesce(cg, 'other'), total FROM g
  UNION ALL SELECT 'hybrid', coalesce(dg, cg, tg, 'other'), total FROM g
  UNION ALL SELECT 'hybrid_no_tld', coalesce(dg, cg, 'other'), total FROM g)
GROUP BY 1, 2
""")
def grouping_strategies(x):
    arts = x.view("articles").filter("publisher IS NOT NULL").select("publisher", "country")
    votes = labelling.country_votes(arts)
    sized = votes.select("publisher", "n_articles")
    grouped = labelling.hybrid_group(
        sized, _domain_lists(x), votes.drop("n_articles"), _country_lists(x), 0.5)
    return labelling.strategy_groups(grouped).groupBy("strategy", "strategy_group").agg(
        F.sum("n_articles").alias("n"))


@query("B16 C14", f"""
SELECT publisher, count(*) AS n FROM {{articles}}
WHERE publisher IS NULL OR publisher NOT IN ({names(fixed.INTERNAL_HOSTS)}) GROUP BY 1
""")
def news_hosts_only(x):
    kept = labelling.drop_internal_hosts(x.view("articles"))
    return kept.groupBy("publisher").agg(F.count("*").alias("n"))


PANEL_SQL = f"""
SELECT ecosystem, publisher, count(*) FILTER (WHERE day < DATE '2021-01-01') AS n_pre,
  count(*) FILTER (WHERE day >= DATE '2021-01-01') AS n_post,
  avg(CASE WHEN day < DATE '2021-01-01' THEN {TONE} END) AS tone_pre,
  avg(CASE WHEN day >= DATE '2021-01-01' THEN {TONE} END) AS tone_post
FROM (SELECT *, {LABEL} AS ecosystem FROM {{articles}} WHERE publisher IS NOT NULL
      AND {CONFLICT} AND day BETWEEN DATE '2018-01-01' AND DATE '2023-06-30')
WHERE ecosystem IN ('RU_STATE', 'RU_INDEP') GROUP BY 1, 2
HAVING n_pre >= 210 AND n_post >= 210 AND tone_pre IS NOT NULL AND tone_post IS NOT NULL
"""
PANEL_ARGS = ("2021-01-01", ("2018-01-01", "2023-06-30"), ("RU_STATE", "RU_INDEP"), 210)


@query("D8", f"""
SELECT ecosystem, publisher, n_pre, n_post, {rr('tone_pre', 6)} AS tone_pre,
  {rr('tone_post', 6)} AS tone_post, {rr('tone_post - tone_pre', 6)} AS shift FROM ({PANEL_SQL})
""")
def fixed_panel_shift(x):
    panel = daily.fixed_panel_shift(x.view("articles"), *PANEL_ARGS)
    return panel.withColumns({k: r(F.col(k), 6) for k in ("tone_pre", "tone_post", "shift")})


@query("D8", f"""
SELECT ecosystem, count(*) AS n_outlets, {rr('avg(tone_pre)', 6)} AS tone_pre,
  {rr('avg(tone_post)', 6)} AS tone_post, {rr('avg(tone_post - tone_pre)', 6)} AS shift
FROM ({PANEL_SQL}) GROUP BY 1
""")
def fixed_panel_summary(x):
    out = daily.shift_summary(daily.fixed_panel_shift(x.view("articles"), *PANEL_ARGS))
    return out.withColumns({k: r(F.col(k), 6) for k in ("tone_pre", "tone_post", "shift")})


@query("C14 F4", f"""
SELECT publisher FROM (SELECT DISTINCT publisher, {LABEL} AS e FROM {{articles}}
  WHERE publisher IS NOT NULL) WHERE e IN ('RU_STATE', 'RU_INDEP')
EXCEPT SELECT publisher FROM ({PANEL_SQL})
""")
def publishers_off_panel(x):
    arts = x.view("articles").filter("publisher IS NOT NULL")
    labelled = labelling.with_label(arts).filter(F.col("ecosystem").isin("RU_STATE", "RU_INDEP"))
    panel = daily.fixed_panel_shift(x.view("articles"), *PANEL_ARGS)
    return labelled.select("publisher").distinct().join(panel, "publisher", "left_anti")


@query("D25", """
SELECT publisher, country, n_top, n_articles, round(n_top::DOUBLE / n_articles, 8) AS confidence
FROM (SELECT publisher, country, n AS n_top,
        CAST(sum(n) OVER (PARTITION BY publisher) AS BIGINT) AS n_articles,
        row_number() OVER (PARTITION BY publisher ORDER BY n DESC, country) AS rn
      FROM (SELECT publisher, country, count(*) AS n FROM {articles}
            WHERE publisher IS NOT NULL GROUP BY 1, 2)) WHERE rn = 1
""")
def publisher_country_votes(x):
    arts = x.view("articles").filter("publisher IS NOT NULL")
    return labelling.country_votes(arts).withColumn("confidence", r(F.col("confidence"), 8))


@query("D25", f"""
WITH votes AS (
  SELECT publisher, country, n, sum(n) OVER (PARTITION BY publisher) AS total,
    row_number() OVER (PARTITION BY publisher ORDER BY n DESC, country) AS rn
  FROM (SELECT publisher, country, count(*) AS n FROM {{articles}}
        WHERE publisher IS NOT NULL GROUP BY 1, 2)),
g AS (SELECT publisher, total,
  CASE WHEN publisher IN ({names(fixed.UA_DOMAINS)}) THEN 'ukrainian'
       WHEN publisher IN ({names(fixed.RU_STATE)}) THEN 'russian' END AS dg,
  CASE WHEN country IN ({names(fixed.COUNTRY_GROUPS['ukrainian'])}) THEN 'ukrainian'
       WHEN country IN ({names(fixed.COUNTRY_GROUPS['russian'])}) THEN 'russian'
       WHEN country IN ({names(fixed.COUNTRY_GROUPS['western'])}) THEN 'western'
       ELSE 'other' END AS cg,
  {tld_group_case('publisher')} AS tg, n::DOUBLE / total AS confidence FROM votes WHERE rn = 1)
SELECT coalesce(dg, tg, 'other') AS source_group,
  CASE WHEN dg IS NOT NULL THEN 'domain' WHEN tg IS NOT NULL THEN 'tld' ELSE 'none' END AS method,
  count(*) AS n_domains, CAST(sum(total) AS BIGINT) AS n_articles,
  {rr("sum(CASE WHEN coalesce(dg, tg, 'other') = cg THEN total ELSE 0 END)::DOUBLE / sum(total)", 8)}
    AS agreement
FROM g WHERE total >= 100 AND confidence >= 0.3 GROUP BY 1, 2
""")
def group_agreement(x):
    from tidewire.operators import audit
    arts = x.view("articles").filter("publisher IS NOT NULL").select("publisher", "country")
    out = audit.group_agreement(labelling.country_votes(arts), _domain_lists(x),
                                _country_lists(x), min_articles=100, min_confidence=0.3)
    return out.withColumn("agreement", r(F.col("agreement"), 8))


@query("D27", """
SELECT day, count(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY day, article_id) AS rn
  FROM (SELECT DISTINCT day, url, article_id FROM {articles})) WHERE rn = 1 GROUP BY day
""")
def url_deduplicated(x):
    rows = x.view("articles").select("day", "url", "article_id")
    first = labelling.first_in_order(rows, ["url"], [F.col("day"), F.col("article_id")])
    return first.groupBy("day").agg(F.count("*").alias("n"))


SAMPLE_SEED = 42


@query("D29")
def stratified_sample(x):
    """100 articles per label, fixed by a hashed seed."""
    labelled = labelling.with_label(x.view("articles").filter("publisher IS NOT NULL"))
    from tidewire.functions import draws
    order = [draws.uniform(SAMPLE_SEED, F.col("article_id")), F.col("article_id"), F.col("url")]
    rows = labelled.select("article_id", "day", "url", "publisher", "ecosystem")
    return labelling.top_in_group(rows, ["ecosystem"], order, 100)


@query("B20", f"""
SELECT day, count(*) AS n FROM {{articles}}
WHERE day BETWEEN DATE '2021-11-22' AND DATE '2022-03-22' AND dayofweek(day) BETWEEN 1 AND 5
  AND locations IS NOT NULL GROUP BY 1
""")
def window_cut(x):
    rows = x.view("articles").filter(
        F.col("day").between(F.lit("2021-11-22").cast("date"), F.lit("2022-03-22").cast("date"))
        & (c.weekday("day") < 5) & F.col("locations").isNotNull())
    return rows.groupBy("day").agg(F.count("*").alias("n"))


@query("D26", f"""
SELECT day, count(*) FILTER (WHERE e = 'UA' AND t = 'act') AS n_ua_act,
  count(*) FILTER (WHERE e = 'UA' AND t = 'threat') AS n_ua_threat,
  count(*) FILTER (WHERE e = 'WEST' AND t = 'act') AS n_west_act,
  count(*) FILTER (WHERE e = 'WEST' AND t = 'threat') AS n_west_threat,
  {rr(f"avg(CASE WHEN e = 'UA' THEN {TONE} END)", 6)} AS tone_ua,
  {rr(f"avg(CASE WHEN e = 'WEST' THEN {TONE} END)", 6)} AS tone_west
FROM (SELECT day, v2tone, {LABEL} AS e, unnest(CASE
    WHEN act AND threat THEN ['act', 'threat'] WHEN act THEN ['act']
    WHEN threat THEN ['threat'] ELSE [NULL] END) AS t FROM (SELECT *,
  list_has_any(string_split(themes, ';'), [{names(fixed.ACT_THEMES)}]) AS act,
  list_has_any(string_split(themes, ';'), [{names(fixed.THREAT_THEMES)}])
    AS threat FROM {{articles}} WHERE publisher IS NOT NULL))
WHERE e IN ('UA', 'WEST') GROUP BY day
""")
def query_group_pivot(x):
    kinds = F.array_compact(F.array(
        F.when(c.has_theme("themes", fixed.ACT_THEMES), "act"),
        F.when(c.has_theme("themes", fixed.THREAT_THEMES), "threat")))
    rows = labelling.with_label(x.view("articles").filter("publisher IS NOT NULL"))
    rows = rows.filter(F.col("ecosystem").isin("UA", "WEST")).select(
        "day", "ecosystem", c.lead_tone("v2tone").alias("tone"),
        F.explode_outer(kinds).alias("kind"))
    aggs = []
    for e in ("UA", "WEST"):
        mine = F.col("ecosystem") == e
        for k in ("act", "threat"):
            aggs.append(F.count_if(mine & (F.col("kind") == k)).alias(f"n_{e.lower()}_{k}"))
        aggs.append(r(F.avg(F.when(mine, F.col("tone"))), 6).alias(f"tone_{e.lower()}"))
    return rows.groupBy("day").agg(*aggs)
