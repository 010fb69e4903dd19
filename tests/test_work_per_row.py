"""Rows of large tables are labelled once, and small tables made from them are worked out once."""

import datetime as dt

from pyspark.sql import functions as F

from tidewire.operators import daily, grids
from tidewire.sources import derived

DAY = dt.date(2020, 1, 2)


def test_an_article_works_out_its_threat_act_label_once(spark):
    rows = [(DAY, p, None, "1#Ukraine#UP#UP#49#32#UP", t) for p, t in (
        ("tass.ru", "KILL"), ("tass.ru", "BORDER"), ("msn.com", "KILL"), ("example.com", "KILL"), (None, "KILL"), ("unian.net", None))]
    # The publisher is an expression, not a stored column, as in the mappings of the driver's tables.
    articles = spark.createDataFrame(rows, "day date, p string, translation_info string, locations string, themes string").withColumn(
        "publisher", F.nullif(F.lower("p"), F.lit(""))).drop("p")
    made = daily.daily_threat_act(articles)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("epravda.com.ua") == 1  # one CASE, outside the filter of the scan
    # Native English of a publisher that no set names is EN_GLOBAL, and stays; aggregators and OTHER do not.
    assert {(r["ecosystem"], r["n_conflict"], r["n_act"], r["n_threat"]) for r in made.collect()} == {("RU_STATE", 2, 1, 1), ("EN_GLOBAL", 1, 1, 0)}
    other = articles.withColumn("translation_info", F.lit("srclc:deu;eng:moses"))
    assert [r["ecosystem"] for r in daily.daily_threat_act(other).collect()] == ["RU_STATE"]
    assert made.columns == ["day", "ecosystem", "n_conflict", "n_act", "n_threat", "act_share", "threat_share"]


def test_a_grid_works_out_its_panel_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    names = [f"{p}_{e}" for e in ("A", "B") for p in ("att", "tone")]
    days = spark.range(400).select(F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("date"), *[
        (F.xxhash64("id", F.lit(x)) % 1000 / 1000.0).alias(x) for x in (*names, "T", "m", "lvix")])
    panel = days.mapInArrow(counted, days.schema)
    fits, cell = grids.label_fits(panel, {"all": None, "half": ("2020-01-02", "2020-07-01")}, {"T": "m"}, labels=("A", "B"))
    assert {(r["window"], r["freq"]) for r in fits.select(*cell).collect()} >= {("all", "D"), ("all", "W"), ("half", "D")}
    assert seen.value == 400


def test_months_of_files_are_read_once(spark, tmp_path):
    path, seen = str(tmp_path / "facts"), spark.sparkContext.accumulator(0)

    @F.udf("date")
    def counted(d):
        seen.add(1)
        return d

    def table():
        return derived.DerivedTable(spark, "once", path, counted("day"), lambda rows: rows.groupBy("day").agg(F.count("*").alias("n")), str(tmp_path))

    rows = [(dt.date(2020, m, d),) for m in (1, 2) for d in range(1, 11)]
    spark.createDataFrame(rows, "day date").coalesce(1).write.parquet(path)
    assert table().update() == [dt.date(2020, 1, 1), dt.date(2020, 2, 1)]
    assert seen.value == 20
    assert {r["n"] for r in table().read().collect()} == {1} and table().update() == []
