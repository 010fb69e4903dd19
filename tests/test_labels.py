"""Labels, text fields and daily tables on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewire import fixed_values as fixed
from tidewire.functions import columns as c
from tidewire.operators import daily, labelling

ROWS = [
    ("msn.com", None), ("unian.net", "srclc:rus;x"), ("tass.ru", None), ("meduza.io", "srclc:rus"),
    ("reuters.com", None), ("24tv.ua", "srclc:rus"), ("fontanka.ru", None), ("derstandard.at", "srclc:deu"),
    ("a.com", None), ("b.com", "srclc:ukr"), ("c.com", "srclc:rus"), ("d.com", "srclc:deu"), ("us", None),
]


def labels(spark, variant):
    df = spark.createDataFrame(ROWS, "publisher string, translation_info string")
    out = labelling.with_label(df, variant).select("publisher", "ecosystem").collect()
    return {r["publisher"]: r["ecosystem"] for r in out}


def test_tier_order(spark):
    got = labels(spark, "baseline")
    assert got == {
        "msn.com": "AGGREGATOR", "unian.net": "UA", "tass.ru": "RU_STATE", "meduza.io": "RU_INDEP",
        "reuters.com": "WEST", "24tv.ua": "UA", "fontanka.ru": "RU_OTHER", "derstandard.at": "WEST",
        "a.com": "EN_GLOBAL", "b.com": "UA", "c.com": "RU_OTHER", "d.com": "OTHER", "us": "EN_GLOBAL"}


def test_variants(spark):
    assert labels(spark, "register_only")["24tv.ua"] == "OTHER"
    assert labels(spark, "no_language_tier")["a.com"] == "OTHER"
    assert labels(spark, "language_first")["24tv.ua"] == "RU_OTHER"
    assert labels(spark, "with_aggregators")["msn.com"] == "EN_GLOBAL"
    with pytest.raises(ValueError):
        labelling.label(F.lit("x"), F.lit("y"), "nope")


def test_variant_pass_holds_baseline(spark):
    df = spark.createDataFrame(ROWS, "publisher string, translation_info string")
    both = labelling.with_variants(df).filter("variant = 'baseline'").select("publisher", "ecosystem")
    assert {r[0]: r[1] for r in both.collect()} == labels(spark, "baseline")


def test_register_is_disjoint():
    sets = [fixed.RU_STATE, fixed.RU_INDEP, fixed.UA_DOMAINS, fixed.WEST_DOMAINS, fixed.AGGREGATORS]
    flat = [d for s in sets for d in s]
    assert len(flat) == len(set(flat))


def test_text_fields(spark):
    df = spark.createDataFrame([
        ("http://WWW.A.com:80/x", "-2.5,1", "SKILL;MILITARY", "Babcock International Group"),
        ("nonsense", "n/a", "TAX_MILITARY_TITLE", "Raytheon Co."), (None, None, None, "Airbus SE"),
    ], "u string, t string, th string, n string")
    got = df.select(
        c.host("u"), c.lead_tone("t"), c.has_theme("th", ["KILL", "MILITARY"]), c.normalise_name("n")).collect()
    assert [tuple(r) for r in got] == [
        ("a.com:80", -2.5, True, "babcock international"), ("", None, False, "raytheon"),
        ("", None, None, "airbus")]


def test_site_match(spark):
    df = spark.createDataFrame([("rus.a.com", "a.com"), ("a.com", "rus.a.com"), ("ba.com", "a.com"), ("", "a.com")],
                               "h string, d string")
    assert [r[0] for r in df.select(c.site_matches("h", "d")).collect()] == [True, True, False, False]


def test_weapon_priority(spark):
    rules = [("shahed", "uav", False), ("x-59", "cruise_missile", False), ("iskander", "ballistic_missile", False),
             ("молнія", "loitering_munition", False), ("x-59", "uav", True)]
    df = spark.createDataFrame([("Iskander-M and X-59",), ("X-59",), ("МОЛНІЯ-1",), ("?",)], "model string")
    got = [r[0] for r in df.select(labelling.weapon_class("model", rules)).collect()]
    assert got == ["ballistic_missile", "uav", "loitering_munition", "other"]


def test_daily_table_null_rules(spark):
    d = dt.date(2022, 1, 1)
    df = spark.createDataFrame([
        (d, "reuters.com", None, "1#X#UP#", "2.0,1"), (d, "reuters.com", None, None, "4.0,1"),
        (d, None, None, "1#X#UP#", "9,1"), (d, "msn.com", None, "1#X#UP#", "9,1"),
        (d, "tass.ru", None, "#FR#", "bad"),
    ], "day date, publisher string, translation_info string, locations string, v2tone string")
    got = {r["ecosystem"]: r for r in daily.daily_labels(df).collect()}
    assert set(got) == {"WEST", "RU_STATE"}
    assert (got["WEST"]["n_total"], got["WEST"]["n_conflict"], got["WEST"]["share"]) == (2, 1, 0.5)
    assert (got["WEST"]["tone_conflict"], got["WEST"]["tone_all"]) == (2.0, 3.0)
    assert got["RU_STATE"]["tone_all"] is None and got["RU_STATE"]["share"] == 0.0


def test_hashed_sample_is_stable(spark):
    from tidewire.functions import draws
    df = spark.range(1000).withColumn("g", F.col("id") % 2)
    def take(parts):
        rows = labelling.top_in_group(df.repartition(parts), ["g"], [draws.uniform(42, F.col("id"))], 5)
        return {r["id"] for r in rows.collect()}
    assert take(1) == take(7) and len(take(3)) == 10
