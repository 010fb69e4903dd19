"""Nothing is cut off: owners, years, publishers; scans prune; merges know their order."""

import os
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tidewire.functions import tails
from tidewire.operators import audit, daily, neardup, races, series
from tidewire.sources import markets, tables
from tidewire.streaming import feeds

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_fourth_owner_counts(spark):
    claims = spark.createDataFrame([("Q1", "P127", i, f"O{i}") for i in range(4)], "item string, property string, position int, value string")
    labels = spark.createDataFrame([(f"O{i}", "Some people" if i < 3 else "Government of X") for i in range(4)], "item string, label string")
    assert audit.item_ownership(claims, labels).first()["state_owned"]
    assert not audit.item_ownership(claims, labels, first=3).first()["state_owned"]


def test_any_year_of_a_sheet_is_read(spark):
    rows = spark.createDataFrame([(1980, "A plc", "X", "1", "4"), (2031, "B Corp.", "Y", "2", None)],
                                 "`Year` int, `Company` string, `Country` string, `Arms revenues` string, `Total revenues` string")
    got = {r.year: r.arms_share for r in markets.read_exposure_sheet(rows).collect()}
    assert got == {1980: 0.25, 2031: None}
    sheet = rows.drop("Year").withColumnRenamed("Arms revenues", "Arms revenues (1999)")
    assert {r.year for r in markets.read_exposure_sheets({1999: sheet}).collect()} == {1999}


def test_small_publishers_of_a_tld_are_seen(spark):
    big = [(f"p{i}.com", "com", "eng", 1000) for i in range(500)]
    small = [("a.ru", "ru", "rus", 2), ("a.ru", "ru", "eng", 1)]
    counts = spark.createDataFrame(big + small, "domain string, tld string, srclc string, n long")
    assert [tuple(r) for r in daily.multilingual_publishers(counts, "ru").collect()] == [("a.ru", 2)]


def test_target_kinds_choose_the_market_form(spark):
    frame = spark.range(60).select(
        F.expr("date_add(DATE '2020-01-01', CAST(id AS INT))").alias("date"), (F.col("id") % 7 - 3).cast("double").alias("m"),
        F.col("id").cast("double").alias("a"), F.col("id").cast("double").alias("b"),
        (F.col("id") * F.col("id")).cast("double").alias("gpr_act"), (F.col("id") % 5).cast("double").alias("gpr_threat"),
        (F.col("id") % 3).cast("double").alias("lvix"))
    rows, _, _ = races.channel_cells(frame, {"a": "volatility", "b": "return"}, F.array(F.lit("all")), {"m": "m"})
    low = {r.target: r.low for r in rows.groupBy("target").agg(F.min("r_mkt").alias("low")).collect()}
    assert low["a"] >= 0 > low["b"]


def test_article_scan_reaches_the_files(spark):
    assert "PushedFilters: [Or(" in plan_of(contract.queries()["article_scan"](spark, SMALL)).replace("\n", " ")


def test_a_written_table_opens_only_its_months(spark, tmp_path):
    table = spark.sql("SELECT explode(sequence(DATE '2020-01-01', DATE '2020-12-31')) AS day").withColumn("month", F.trunc("day", "month"))
    tables.write_partitioned(table, str(tmp_path / "t"), ["month"])
    got = tables.read_days(spark, str(tmp_path / "t"), [("2020-02-10", "2020-03-05"), ("2020-07-01", "2020-07-02")])
    assert got.count() == 20 + 5 + 2 and "PartitionFilters: [(" in plan_of(got)
    assert len({f.split("month=")[1][:10] for f in got.inputFiles()}) <= 12


def test_upsert_wants_an_order_where_keys_repeat(spark):
    base = spark.createDataFrame([(1, 5)], "k int, v int")
    fresh = spark.createDataFrame([(1, 9), (1, 7)], "k int, v int")
    with pytest.raises(Exception, match="order they were delivered"):
        tables.upsert(base, fresh, ["k"]).collect()
    dated = [df.withColumn("at", F.lit(i)) for i, df in enumerate((base, fresh.filter("v = 9"), fresh.filter("v = 7")))]
    got = tables.upsert(dated[0], dated[1].unionByName(dated[2]), ["k"], delivered=[F.col("at")]).first()
    assert got.v == 7


def test_results_are_written_as_one_csv(spark, tmp_path):
    tables.write_result(spark.createDataFrame([(1, "a")], "k int, v string"), str(tmp_path / "r"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "r")).collect()] == [("1", "a")]


def test_a_batch_delivered_twice_changes_nothing(spark, tmp_path):
    feed = spark.createDataFrame([("2020-01-01", "p", 1), ("2020-02-01", "p", 2)], "day string, k string, n int")
    for _ in range(2):
        tables.upsert_partitions(feed, str(tmp_path / "t"), ["day", "k"])
    assert sorted((str(r.day), r.n) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("2020-01-01", 1), ("2020-02-01", 2)]


def test_blocks_close_and_late_rows_do_not_reopen_them(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp, publisher string"

    def deliver(*days):
        spark.createDataFrame([(d, "p") for d in days], "d string, publisher string").select(
            F.col("d").cast("timestamp").alias("ts"), "publisher").coalesce(1).write.mode("append").parquet(source)

    def run():
        feed = spark.readStream.schema(schema).parquet(source)
        feeds.activity_blocks(feed, "publisher", "168 hours").writeStream.outputMode("append").format("parquet").option(
            "path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.n for r in spark.read.parquet(out).collect())

    deliver("2020-01-01", "2020-01-03", "2020-03-01")
    assert run() == [2]
    deliver("2020-01-02", "2020-05-01")  # the first is far behind the watermark
    assert run() == [1, 2]


def test_pairs_hold_only_with_standing_leaders(spark):
    texts = [(1, "abcdefghijklmnopqrstuvwxyz0123456789"), (2, "abcdefghijklmnopqrstuvwxyz01234567AB"), (3, "abcdefghijklmnopqrstuvwxyz0123CDEFAB"[2:] + "xy")]
    found = neardup.near_duplicates(spark.createDataFrame(texts * 1, "k long, t string"), "k", "t", threshold=0.7).collect()
    gone = {r.key for r in found}
    assert all(r.duplicate_of not in gone for r in found)


def test_strict_z_score_and_tails(spark):
    assert abs(tails.f_tail(1.0, 10, 10) - 0.5) < 1e-12 and abs(tails.t_tail(2.0, 1e7) - 0.0455) < 1e-4
    assert tails.beta_tail(0.5, 1e6, 1e6) == pytest.approx(0.5, abs=1e-6)
    flat = spark.createDataFrame([(1, 2.0), (2, 2.0)], "d int, v double")
    assert flat.withColumn("k", F.lit(1)).withColumn("z", series.zscore(F.col("v"), series.whole("k"))).filter("z IS NULL").count() == 2


def test_scratch_tables_can_be_cleared(spark):
    from tidewire import session
    kept, session._SCRATCH[:] = list(session._SCRATCH), []
    spark.range(3).write.parquet(session.scratch(spark))
    session.scratch(spark)
    assert session.clear_scratch(spark) == 1 and not session._SCRATCH
    session._SCRATCH[:] = kept


def test_feeds_of_many_triggers_lose_and_repeat_nothing(spark, tmp_path):
    days = [(f"2020-01-{d:02d} 00:00:00", url) for d in range(1, 25, 4) for url in ("a", "b", None, f"u{d}")]
    rows = spark.createDataFrame(days, "ts string, url string").withColumn("ts", F.to_timestamp("ts"))
    rows.repartitionByRange(6, "ts").write.parquet(f"{tmp_path}/in")
    for i, part in enumerate(sorted((tmp_path / "in").glob("part-*"), reverse=True)):
        os.utime(part, (1.6e9 + i, 1.6e9 + i))  # later days finish first
    feeds.ordered_files(spark, f"{tmp_path}/in")
    feed = feeds.read_feed(spark, f"{tmp_path}/in", rows.schema, files_per_trigger=1)
    with feeds.store_on_disk(spark):
        feeds.distinct_urls_table(feed, f"{tmp_path}/urls", f"{tmp_path}/s1").trigger(availableNow=True).start().awaitTermination()
    urls = [r.url for r in spark.read.parquet(f"{tmp_path}/urls").collect()]
    assert len(urls) == 9 and set(urls) == {None, "a", "b", *(f"u{d}" for d in range(1, 25, 4))}
    counts = feed.withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day")).count().select("window.start", "count")
    counts.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/n").option(
        "checkpointLocation", f"{tmp_path}/s2").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/n").agg(F.sum("count")).first()[0] == 20  # all but the open last day


def test_a_feed_of_urls_reads_its_own_batch_only(spark, tmp_path):
    schema, seen = "ts timestamp, url string", set()

    def deliver(urls):
        rows = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("ts", F.lit("2020-01-01").cast("timestamp"))
        rows.select("ts", "url").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with feeds.store_on_disk(spark):
            query = feeds.distinct_urls_table(feeds.read_feed(spark, f"{tmp_path}/in", schema), f"{tmp_path}/urls", f"{tmp_path}/state").trigger(
                availableNow=True).start()
            query.awaitTermination()
        return [p for p in query.recentProgress if p["numInputRows"]]

    for turn in range(4):
        urls = [f"u{i}" for i in range(turn * 50, turn * 50 + 100)] + [None, "u0"]
        progress = deliver(urls)
        seen |= set(urls)
        assert sum(p["numInputRows"] for p in progress) == len(urls)  # its own rows, no history
        assert progress[-1]["stateOperators"][0]["numRowsTotal"] == len(seen)
        got = [r.url for r in spark.read.parquet(f"{tmp_path}/urls").collect()]
        assert len(got) == len(seen) and set(got) == seen
        if turn == 1:  # what was written before can't be read any more, and is not
            for part in (tmp_path / "urls").glob("part-*.parquet"):
                os.rename(part, part.with_suffix(".gone"))
            deliver(["u0", "u149"])
            for part in (tmp_path / "urls").glob("*.gone"):
                os.rename(part, part.with_suffix(".parquet"))


@pytest.mark.parametrize("block", [4, 256])
def test_closest_standing_text_by_brute_force(spark, block):
    import random

    pick, texts = random.Random(6), []
    for i in range(25):  # chains: each text changes some of the one before
        words = [pick.choice(["alpha", "bravo", "delta", "echo", "golf", "hotel", "india", "kilo"]) + str(pick.randrange(50)) for _ in range(60)]
        for _ in range(6):
            texts.append(" ".join(words))
            for _ in range(3):
                words[pick.randrange(60)] = f"new{pick.randrange(999)}"
    texts += ["x" * 30, "x" * 30, "short"]
    order = list(enumerate(texts))
    pick.shuffle(order)
    got = {r.key: (r.duplicate_of, r.jaccard) for r in neardup.near_duplicates(
        spark.createDataFrame(order, "k long, t string"), "k", "t", block=block).collect()}
    sets = {k: {t[i:i + 5] for i in range(len(t) - 4)} for k, t in order if len(t) >= 20}
    stands, want, seen = [], {}, {}
    for k in sorted(sets):
        text = texts[k]
        if text in seen:
            want[k] = (seen[text], 1.0)
            continue
        seen[text] = k
        near = [(-len(sets[k] & sets[j]) / len(sets[k] | sets[j]), j) for j in stands]
        best = min((x for x in near if -x[0] >= 0.7), default=None)
        if best:
            want[k] = (best[1], -best[0])
        else:
            stands.append(k)
    assert got == want and len(want) > 60
