"""The registry, the driver contract and stream forms."""

import re

import pytest

import __spark_entry__ as contract
from tidewire.streaming import feeds
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_every_twin_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert not any(re.search(r"\{[a-z_]+\}", sql) for sql in contract.oracle_sql().values())


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert {"day", "ecosystem", "share"} <= set(df.columns) and df.count() > 0


@pytest.mark.parametrize("name", ["daily_variant_table", "anticipation_score", "register_audit"])
def test_queries_run_small(spark, name):
    assert contract.queries()[name](spark, SMALL).count() > 0


def test_stream_equals_batch(spark):
    batch = contract.queries()["daily_label_table"](spark, SMALL)
    stream = contract.queries()["streamed_daily_labels"](spark, SMALL)
    both = batch.join(stream.withColumnsRenamed({"share": "s", "n_total": "n"}), ["day", "ecosystem"], "full")
    bad = both.filter((F.col("n") != F.col("n_total")) | F.col("n").isNull() | F.col("n_total").isNull()
                      | (F.abs(F.col("share") - F.col("s")) > 1e-6))
    assert bad.count() == 0 and batch.count() == stream.count()


def test_url_stream_keeps_one(spark):
    urls = contract.queries()["streamed_distinct_urls"](spark, SMALL)
    assert urls.count() == urls.select("url").distinct().count()
    assert feeds.distinct_urls is not None


def test_url_feed_holds_every_url_and_nothing_else(spark):
    from tidewire.plans.queries import audits
    from tidewire.plans.standins import Inputs

    x = Inputs(spark, SMALL)
    feed = audits._url_feed(x)
    assert feed.isStreaming and feed.columns == ["url"]
    assert contract.queries()["streamed_distinct_urls"](spark, SMALL).count() == x.view("articles").select("url").distinct().count()
