"""Driver tables mapped onto the shapes the operators expect.

Every mapping is one SQL text that both engines read, so a query and its twin start
from the same rows. Dates are moved forward by 8,000 days, which puts the test years
inside the fixed calendar (regimes, windows, episodes). No mapping drops rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewire import fixed_values
from tidewire.functions import columns
from tidewire.operators import daily, labelling
from tidewire.sources import derived
from tidewire.sources.derived import DerivedTable

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# 40 publishers over every tier, one of them NULL.
_PUBLISHERS = (
    "reuters.com,tass.ru,unian.net,meduza.io,msn.com,spiegel.de,rt.com,pravda.com.ua,"
    "theins.ru,lenta.ru,24tv.ua,fontanka.ru,derstandard.at,example.com,,heise.de,"
    "ukrinform.net,vedomosti.ru,bbc.co.uk,yahoo.com,iz.ru,kyivpost.com,zona.media,"
    "wsj.com,world.net,ria.ru,liga.net,rbc.ru,cnn.com,daily.org,kp.ru,censor.net,"
    "tvrain.ru,apnews.com,facebook.com,gazeta.ru,strana.news,republic.ru,faz.net,news.mail.ru"
)

_THEMES = (
    "KILL;LEADER|MILITARY;TAX_FNCACT|TAX_MILITARY_TITLE;SKILLS|THREATEN;BORDER|WOUND|"
    "NUCLEAR;SANCTIONS;KILL||ECON_STOCKMARKET|ARMEDCONFLICT;SIEGE|SECURITY_SERVICES;TERROR|"
    "EDUCATION;KILLJOY|MILITARY"
)

STANDINS: dict[str, str] = {}


def _mean(amount: str, when: str = "") -> str:
    """Mean of a two-decimal amount through integer cents: exact in both engines."""
    cents = f"CAST(round({amount} * 100) AS BIGINT)"
    if when:
        cents = f"CASE WHEN {when} THEN {cents} END"
    return (f"CAST(sum({cents}) AS DOUBLE) / CAST(nullif(count({cents}), 0) * 100 AS DOUBLE)")


def _total(amount: str, when: str = "") -> str:
    cents = f"CAST(round({amount} * 100) AS BIGINT)"
    if when:
        cents = f"CASE WHEN {when} THEN {cents} END"
    return f"CAST(sum({cents}) AS DOUBLE) / CAST(100 AS DOUBLE)"


# Article records. One row per line of the largest table.
STANDINS["articles"] = f"""
SELECT l_orderkey * 8 + l_linenumber AS article_id,
       CAST(l_shipdate AS DATE) + 8000 AS day,
       nullif(split_part('{_PUBLISHERS}', ',', CAST(l_suppkey % 40 AS INT) + 1), '') AS publisher,
       CASE WHEN l_linenumber <= 3 THEN NULL
            WHEN l_linenumber = 4 THEN 'srclc:rus;eng:moses'
            WHEN l_linenumber = 5 THEN 'srclc:ukr;eng:moses'
            WHEN l_linenumber = 6 THEN 'srclc:deu;eng:moses'
            ELSE '' END AS translation_info,
       CASE WHEN l_returnflag = 'R' THEN '1#Ukraine#UP#UP#49#32#UP'
            WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN '4#Moscow#RS#RS48#55#37#RS'
            WHEN l_linenumber = 7 THEN NULL
            ELSE '2#Paris#FR#FRA8#48#2#FR' END AS locations,
       CASE WHEN l_tax >= 0.08 THEN 'n/a'
            ELSE concat(CAST(CAST(l_quantity AS INT) - 25 AS STRING), '.',
                        CAST(l_partkey % 10 AS STRING), ',3.1,4.2') END AS v2tone,
       nullif(split_part('{_THEMES}', '|', CAST(l_partkey % 12 AS INT) + 1), '') AS themes,
       CASE WHEN l_linestatus = 'F' THEN 'UA' WHEN l_returnflag = 'R' THEN 'US'
            WHEN l_returnflag = 'A' THEN 'RU' ELSE 'IN' END AS country,
       concat('https://www.site', CAST(l_suppkey AS STRING), '.com/a/',
              CAST(l_partkey AS STRING)) AS url,
       CAST(l_quantity AS BIGINT) AS words
FROM {{lineitem}}
"""

# Five priced series, one row per (date, ticker).
STANDINS["prices"] = f"""
SELECT CAST(o_orderdate AS DATE) + 8000 AS date,
       concat('T', substr(o_orderpriority, 1, 1)) AS ticker,
       {_mean('o_totalprice')} AS adjclose
FROM {{orders}} GROUP BY 1, 2
"""

# Market levels, one row per date.
STANDINS["market"] = f"""
SELECT CAST(l_shipdate AS DATE) + 8000 AS date,
       {_mean('l_extendedprice', "l_linestatus = 'O'")} AS spx,
       {_mean('l_extendedprice', "l_linestatus = 'F'")} AS sxxp,
       {_mean('l_quantity')} AS vix
FROM {{lineitem}} GROUP BY 1
"""

# The daily risk index and its two parts.
STANDINS["risk"] = f"""
SELECT CAST(l_shipdate AS DATE) + 8000 AS date,
       {_mean('l_quantity')} AS gpr,
       {_mean('l_quantity', "l_returnflag = 'R'")} AS gpr_act,
       {_mean('l_quantity', "l_returnflag = 'A'")} AS gpr_threat
FROM {{lineitem}} GROUP BY 1
"""

# Rate series in long form; each is published on the days its lines ship.
STANDINS["rates"] = f"""
SELECT CAST(l_shipdate AS DATE) + 8000 AS date,
       CASE WHEN l_linenumber = 1 THEN 'VIXCLS' WHEN l_linenumber = 2 THEN 'DCOILBRENTEU'
            WHEN l_linenumber = 3 THEN 'DEXUSEU' WHEN l_linenumber = 4 THEN 'DGS10'
            ELSE 'DTWEXBGS' END AS series,
       {_mean('l_extendedprice')} AS value
FROM {{lineitem}} GROUP BY 1, 2
"""

# Attack records. A wave starts at 23:00 and ends the next morning, or the same evening.
STANDINS["attacks"] = """
SELECT l_orderkey * 8 + l_linenumber AS record_id,
       l_shipdate + INTERVAL '192000' HOUR AS time_start,
       CASE WHEN l_linenumber <= 4 THEN l_shipdate + INTERVAL '192008' HOUR
            ELSE l_shipdate + INTERVAL '192032' HOUR END AS time_end,
       p_name AS model,
       CASE WHEN l_tax >= 0.08 THEN -1 ELSE CAST(l_quantity AS INT) END AS launched,
       CAST(floor(l_quantity * (1 - l_discount * 5)) AS INT) AS destroyed
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

# Firm-day prices: a firm is a nation, quoted on the days its customers order.
STANDINS["firm_prices"] = f"""
SELECT CAST(o_orderdate AS DATE) + 8000 AS date, n_name AS ticker,
       {_mean('o_totalprice')} AS adjclose
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
JOIN {{nation}} ON c_nationkey = n_nationkey GROUP BY 1, 2
"""

# Arms revenue by firm and year.
STANDINS["revenue"] = f"""
SELECT CAST(substr(CAST(o_orderdate AS STRING), 1, 4) AS INT) AS year,
       concat(n_name, CASE WHEN o_orderpriority = '1-URGENT' THEN ' Corp.' ELSE ' plc' END)
           AS company,
       r_name AS country,
       {_total('o_totalprice', "o_orderstatus = 'F'")} AS arms,
       {_total('o_totalprice')} AS total
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
JOIN {{nation}} ON c_nationkey = n_nationkey
JOIN {{region}} ON n_regionkey = r_regionkey GROUP BY 1, 2, 3
"""

# Register claims and the outside reference they are checked against.
STANDINS["claims"] = """
SELECT concat('doc', CAST(doc_id AS STRING), '.', lang) AS domain,
       CASE WHEN lang = 'en' THEN 'WEST' WHEN lang = 'fr' THEN 'UA'
            WHEN n_chars > 1000 THEN 'RU_STATE' ELSE 'RU_INDEP' END AS ecosystem
FROM {documents}
"""
STANDINS["reference"] = """
SELECT concat('doc', CAST(d.doc_id AS STRING), '.', lang) AS domain,
       concat('Q', CAST(d.doc_id AS STRING)) AS qid,
       CASE WHEN toxic = 1 THEN '' WHEN quality = 1 THEN 'WEST'
            WHEN lang = 'fr' THEN 'UA' ELSE 'RU' END AS country,
       source AS label,
       CASE WHEN n_chars % 3 = 0 THEN NULL ELSE n_chars % 3 = 1 END AS state_owned
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
"""


def twin(text: str) -> str:
    """Expand ``{{name}}`` markers of a SQL twin into the mapping it reads."""
    out = text
    for name, body in STANDINS.items():
        marker = "{" + name + "}"
        if marker in out:
            for table in BASE_TABLES:
                body = body.replace("{" + table + "}", table)
            out = out.replace(marker, f"({body})")
    for table in BASE_TABLES:
        out = out.replace("{" + table + "}", table)
    return out


class Inputs:
    """The driver tables and mappings of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def view(self, name: str, **instead: DataFrame) -> DataFrame:
        """A mapping over the driver tables, some of which may be given already filtered."""
        text = STANDINS[name]
        used = {t: instead.get(t) or self.table(t) for t in BASE_TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    def daily(self, name: str, build: Callable[[DataFrame], DataFrame]) -> DerivedTable:
        """A daily table of the articles that is written once for all queries of this input."""
        day = F.date_add(F.to_date("l_shipdate"), 8000)
        rules = derived.rules_of(fixed_values, columns, labelling, daily)
        return derived.DerivedTable(
            self.spark, name, self.path("lineitem"), day,
            lambda rows: build(self.view("articles", lineitem=rows)), [STANDINS["articles"], rules])

    def labels(self) -> DataFrame:
        return self.daily("daily_labels", daily.daily_labels).read()

    def threat_act(self) -> DataFrame:
        return self.daily("daily_threat_act", daily.daily_threat_act).read()

    def variants(self) -> DataFrame:
        return self.daily("daily_variants", daily.daily_variants).read()

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text, **frames)
