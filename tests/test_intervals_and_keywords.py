"""Interval joins and keyword matching without nested loops, against plain loops."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from tidewire.operators import grids, intervals, labelling

D0 = dt.date(2015, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_day_meets_every_interval_that_holds_it(spark):
    pick = random.Random(3)
    spans = [(i, D0 + dt.timedelta(days=pick.randrange(900)), pick.choice([0, 1, 2, 3, 7, 40, 500, 5000])) for i in range(300)]
    rows = [(i, a, a + dt.timedelta(days=n)) for i, a, n in spans] + [(999, D0 + dt.timedelta(days=5), D0)]
    table = spark.createDataFrame(rows, "name int, start date, end date")
    days = [D0 + dt.timedelta(days=pick.randrange(1200)) for _ in range(400)] + [D0] * 3
    facts = spark.createDataFrame([(d, i) for i, d in enumerate(days)] + [(None, -1)], "date date, id int")
    got = sorted((r.id, r.name) for r in intervals.within(facts, table, ["name"]).collect())
    assert got == sorted((i, n) for i, d in enumerate(days) for n, a, b in rows if a <= d <= b)


def test_a_hundred_thousand_intervals_make_no_nested_loop(spark):
    table = spark.range(100_000).select("id", F.expr("date_add(DATE '2015-01-01', CAST(id % 4000 AS INT))").alias("start")).withColumn(
        "end", F.expr("date_add(start, CAST(id % 90 AS INT))"))
    days = spark.sql("SELECT explode(sequence(DATE '2015-01-01', DATE '2025-12-31')) AS date")
    pairs = intervals.day_pairs(days, table)
    assert "NestedLoop" not in plan_of(pairs) and "Cartesian" not in plan_of(pairs)
    assert pairs.count() == sum(min(i % 90 + 1, (dt.date(2025, 12, 31) - D0).days - i % 4000 + 1) for i in range(100_000))


def test_windows_may_be_a_table(spark):
    df = spark.createDataFrame([(D0 + dt.timedelta(days=i),) for i in range(5)], "date date")
    table = grids.window_table(spark, {"w": ("2015-01-02", "2015-01-03"), "all": None})
    got = grids.in_windows(df, table).groupBy("window").count().collect()
    assert {(r.window, r["count"]) for r in got} == {("w", 2), ("all", 5)}


def slow_matches(texts, queries):
    hit = lambda text, words: any(re.search(rf"(?<![^\W_]){re.escape(w.lower())}(?![^\W_])", text) for w in words)
    out = set()
    for key, lang, text in texts:
        for q in queries:
            for code, words in q["any"].items():
                weapon = q.get("weapon", {}).get(code)
                if text is not None and code == lang and hit(text.lower(), words) and (not weapon or hit(text.lower(), weapon)):
                    out.add((key, q["name"]))
    return out


QUERIES = [
    {"name": "strike", "any": {"en": ["air strike", "Raid", "x-ray"], "uk": ["удар"]}, "weapon": {"en": ["drone", "Shahed-136"]}},
    {"name": "plain", "any": {"en": ["raid", "of the"], "uk": ["дрон", "ЇЖАК"]}},
    {"name": "signs", "any": {"en": ["c++", "#war"]}},
]
TEXTS = [
    (1, "en", "An air strike by drone"), (2, "en", "An air  strike by drone"), (3, "en", "RAID! Shahed-136."), (4, "en", "raids and drones"),
    (5, "uk", "Удар і дрон, їжак"), (6, "en", "end of the raid"), (7, "en", None), (8, "en", ""), (9, "de", "raid drone"), (10, "en", "c++ and #war_x #war"),
    (11, "en", "x-ray drone x ray"), (12, "en", "x ray drone"), (13, "en", "raid1 drone2 " * 50_000 + "raid drone"), (14, None, "raid"),
]


def test_keywords_match_as_whole_words(spark):
    texts = spark.createDataFrame(TEXTS, "k int, lang string, text string")
    for most in (500_000, 0):
        got = {tuple(r) for r in labelling.keyword_queries(texts, QUERIES, "k", most_broadcast=most).collect()}
        assert got == slow_matches(TEXTS, QUERIES)


def test_many_keywords_are_probed_by_one_join(spark):
    words = [f"kw{i}" for i in range(10_000)]
    queries = [{"name": f"q{i}", "any": {"en": words[i::100]}} for i in range(100)]
    texts = spark.createDataFrame([(i, "en", f"some kw{i} and kw{i}x words") for i in range(300)], "k int, lang string, text string")
    found = labelling.keyword_queries(texts, queries, "k")
    assert {tuple(r) for r in found.collect()} == {(i, f"q{i % 100}") for i in range(300)}
    assert plan_of(found).upper().count("RLIKE") < 20  # one test of loose hits, not one a keyword
