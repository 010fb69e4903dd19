"""Windows, episodes, carries and calendars with planted answers."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from tidewire.functions import columns as c
from tidewire.operators import series
from tidewire.sources import articles, guard, markets, tables
import pytest

D0 = dt.date(2020, 1, 1)


def frame(spark, values, start=D0, step=1):
    rows = [("s", start + dt.timedelta(days=i * step), None if v is None else float(v))
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, date date, x double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def test_regime_edges(spark):
    days = ["2021-10-31", "2021-11-01", "2022-02-23", "2022-02-24", "2022-09-28", "2022-09-29"]
    df = spark.createDataFrame([(d,) for d in days], "d string").withColumn("d", F.to_date("d"))
    assert [r[0] for r in df.select(c.regime("d")).collect()] == [
        "pre_war", "buildup", "buildup", "invasion", "invasion", "attrition"]


def test_forward_sum_and_carry(spark):
    df = frame(spark, [1, 2, 3, 4, 5, 6]).withColumn("sq", F.col("x") * F.col("x"))
    w = series.by("series")
    assert column(df.withColumn("y", series.forward_sum(F.col("sq"), w, 5)), "y") == [55, 90] + [None] * 4
    sparse = frame(spark, [1] + [None] * 6)
    assert column(sparse.withColumn("y", series.carry(F.col("x"), w, 4)), "y") == [1] * 5 + [None] * 2


def test_prior_volatility_excludes_today(spark):
    vals = list(np.random.default_rng(0).normal(size=30)) + [1000.0]
    got = column(frame(spark, vals).withColumn(
        "v", series.prior_volatility(F.col("x"), series.by("series"), 20)), "v")
    assert math.isclose(got[-1], np.std(vals[10:30], ddof=1), rel_tol=1e-9) and got[19] is None


def test_episode_merge_and_edge_cases(spark):
    def run(values, **kw):
        df = frame(spark, values).withColumnRenamed("x", "score")
        return [(r["start"], r["end"], r["n_days"], r["peak"]) for r in
                series.episodes(df, "series", **kw).orderBy("start").collect()]
    # Two runs, a 10-day dip between them: one episode, dips counted.
    values = [0] * 5 + [1] * 20 + [0] * 9 + [2] * 20 + [0] * 40 + [1] * 40
    got = run(values)
    assert [g[2:] for g in got] == [(49, 2.0), (40, 1.0)]
    assert got[0][0] == D0 + dt.timedelta(days=5) and got[0][1] == D0 + dt.timedelta(days=53)
    assert run([1] * 5 + [0] * 5) == []
    assert run([0] * 50) == []


def test_blocks(spark):
    rows = [("a", D0 + dt.timedelta(days=k)) for k in (0, 1, 8, 16, 17)]
    df = spark.createDataFrame(rows, "k string, date date")
    assert [r["block"] for r in series.blocks(df, "k").orderBy("date").collect()] == [0, 0, 0, 1, 1]


def test_weekly_keeps_empty_weeks(spark):
    rows = [("a", dt.date(2024, 1, 1), 1.0, 2.0), ("a", dt.date(2024, 1, 5), 3.0, None),
            ("a", dt.date(2024, 1, 15), 5.0, 7.0)]
    df = spark.createDataFrame(rows, "k string, date date, x double, y double")
    got = series.weekly(df, ["k"], mean=["x"], total=["y"]).orderBy("date").collect()
    assert [(str(r["date"]), r["x"], r["y"]) for r in got] == [
        ("2024-01-05", 2.0, 2.0), ("2024-01-12", None, 0.0), ("2024-01-19", 5.0, 7.0)]


def test_expanding_ols_equals_refit(spark):
    rng = np.random.default_rng(1)
    x, e = rng.normal(size=200), rng.normal(size=200)
    y = 0.5 * x + e
    rows = [("s", D0 + dt.timedelta(days=i), float(y[i]), float(x[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "series string, date date, y double, x double")
    got = column(df.withColumn("f", series.expanding_ols(F.col("y"), F.col("x"), series.by("series"))), "f")
    for t in (40, 77, 150, 199):
        b = np.polyfit(x[:t], y[:t], 1)
        assert math.isclose(got[t], b[1] + b[0] * x[t], rel_tol=1e-8)
    assert math.isclose(got[10], y[:10].mean(), rel_tol=1e-9)


def test_ar1_sees_no_future(spark):
    e = np.random.default_rng(2).normal(size=400)
    df = frame(spark, e).withColumn("y", series.forward_sum(F.col("x"), series.by("series"), 5))
    df = series.ar1(df, "series", "y", 5).withColumn("m", F.avg("y").over(series.past(series.by("series"), 5)))
    rows = [(r["y"], r["ar1"], r["m"]) for r in df.orderBy("date").collect()[150:] if r["y"] is not None]
    y, f, m = map(np.array, zip(*rows))
    assert 1 - ((y - f) ** 2).sum() / ((y - m) ** 2).sum() < 0.2


def test_upsert(spark):
    base = spark.createDataFrame([("a", 1, 1000), ("b", 1, 5)], "k string, day int, n int")
    fresh = spark.createDataFrame([("a", 1, 800)], "k string, day int, n int")
    once = tables.upsert(base, fresh, ["k", "day"])
    assert {tuple(r) for r in once.collect()} == {("a", 1, 800), ("b", 1, 5)}
    assert sorted(tables.upsert(once, fresh, ["k", "day"]).collect()) == sorted(once.collect())
    first = tables.upsert(base, fresh, ["k", "day"], keep="first")
    assert ("a", 1, 1000) in {tuple(r) for r in first.collect()}


def test_upsert_partitions_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "k string, day int, n int")
    b = spark.createDataFrame([("a", 1, 9)], "k string, day int, n int")
    for batch in (a, b, b):
        tables.upsert_partitions(batch, path, ["k", "day"])
    assert {(r["k"], r["n"]) for r in spark.read.parquet(path).collect()} == {("a", 9), ("b", 2)}


def test_guard(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(10000).selectExpr("id", "CAST(id * 2 AS INT) AS b", "repeat('é', 3) AS t", "id % 4 AS part").write.partitionBy("part").parquet(path)
    price = {r.column: (r.bytes, r.n_rows) for r in guard.scan_price(spark, path, ["id", "b", "t"]).collect()}
    assert price == {"id": (80000, 10000), "b": (40000, 10000), "t": (60000, 10000)}
    some = {r.column: r.bytes for r in guard.scan_price(spark, path, ["id"], F.col("part") < 2).collect()}
    assert some == {"id": 40000}
    assert guard.guarded_scan(spark, path, ["id"], 40000, F.col("part") < 2).count() == 5000
    with pytest.raises(guard.ScanTooLarge):
        guard.guarded_scan(spark, path, ["id"], 39999, F.col("part") < 2)
    # Files that come later are priced, files that go are not; what is known is not read again.
    for file in (tmp_path / "p" / "part=0").glob("*.parquet"):
        file.unlink()
    spark.range(8).selectExpr("id", "CAST(1 AS INT) AS b", "'x' AS t").write.mode("append").parquet(f"{path}/part=9")
    assert {r.column: r.bytes for r in guard.scan_price(spark, path, ["id"]).collect()} == {"id": 60000 + 64}


def test_readers_fail_loudly(spark, tmp_path):
    raw = spark.createDataFrame([(20200101, 1.0, 2.0, 3.0)] * 2, "DAY int, GPRD double, GPRD_ACT double, GPRD_THREAT double")
    with pytest.raises(markets.DuplicateDates):
        markets.read_risk_index(raw)
    with pytest.raises(ValueError):
        markets.read_risk_index(raw.drop("GPRD"))
    f = tmp_path / "x.csv"
    f.write_text("Security,IDX\n\nDate,PX_LAST,PX_VOLUME\n2024-01-02,5,1\n2024-01-01,#N/A,1\n")
    rows = markets.export_rows(spark, str(f))
    assert [(str(r["date"]), r["px"]) for r in markets.read_index_export(rows).collect()] == [("2024-01-02", 5.0)]
    with pytest.raises(ValueError):
        markets.read_index_export(rows.filter("c0 <> 'Date'"))


def test_name_map_suffixes_reach(spark):
    revenue = spark.createDataFrame([(2020, "Raytheon Co.", "US", 5.0, None)],
                                    "year int, company string, country string, arms double, total double")
    names = spark.createDataFrame([("raytheon co.", "RTX")], "name string, ticker string")
    got = markets.match_tickers(markets.exposure_shares(revenue), names).collect()
    assert got[0]["ticker"] == "RTX" and got[0]["arms_share"] is None


def test_three_periods(spark):
    days = spark.createDataFrame([(d,) for d in ("2022-02-23", "2022-03-01", "2022-10-01", "2022-10-02")], "d string")
    days = days.select(F.to_date("d").alias("date"))
    seen = spark.createDataFrame([("2022-10-01", 7)], "d string, launched int").select(F.to_date("d").alias("date"), "launched")
    got = series.three_period_fill(days, seen, ["launched"]).orderBy("date").collect()
    assert [(r["launched"], r["attack_unobserved"]) for r in got] == [(0.0, False), (None, True), (7.0, False), (0.0, False)]


def test_preset_spans_hold_out_apart(spark):
    rows = articles.preset_spans(spark)
    days = rows.filter("preset IN ('full', 'holdout')").select(
        "preset", F.explode(F.sequence("start", "end")).alias("d"))
    assert days.groupBy("d").agg(F.count_distinct("preset").alias("n")).filter("n > 1").count() == 0
