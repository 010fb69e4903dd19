"""Derived tables are found again, opened by month, and made again only where their input changed."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidewire.sources import derived


@pytest.fixture
def articles(spark, tmp_path):
    """A year of articles in one file a month, and a builder that marks its runs."""
    path = tmp_path / "articles"
    for month in range(1, 13):
        rows = [(dt.date(2020, month, d), d % 3) for d in range(1, 29) for _ in range(month)]
        spark.createDataFrame(rows, "day date, k int").coalesce(1).write.parquet(str(path / f"part{month:02d}"))
    runs = []

    def table():
        runs.append(1)
        mark = len(runs)
        return derived.DerivedTable(
            spark, "counts", str(path / "*"), F.col("day"),
            lambda rows: rows.groupBy("day", "k").agg(F.count("*").alias("n")).withColumn("run", F.lit(mark)), str(tmp_path))

    return path, table


def parts(path, month):
    folder = path / f"part{month:02d}"
    return [folder / f for f in os.listdir(folder) if f.endswith(".parquet")]


def test_a_second_reader_opens_no_input_file(articles):
    path, table = articles
    first = {tuple(r) for r in table().read().collect()}
    for month in range(1, 13):
        for file in parts(path, month):  # what is inside can't be read any more, and nobody needs it
            stat = os.stat(file)
            os.chmod(file, 0o644)
            with open(file, "r+b") as f:
                f.write(b"x" * stat.st_size)
            os.utime(file, ns=(stat.st_atime_ns, stat.st_mtime_ns))
            for crc in (file.parent / f".{file.name}.crc",):
                if crc.exists():
                    crc.unlink()
    again = table()
    assert again.update() == []
    assert {tuple(r) for r in again.read().collect()} == first and len(first) == 12 * 28


def test_changed_files_make_only_their_months_again(spark, articles):
    path, table = articles
    assert len(table().update()) == 12
    more = [(dt.date(2020, 5, 3), 7), (dt.date(2020, 6, 4), 7), (dt.date(2021, 2, 1), 7)]
    spark.createDataFrame(more, "day date, k int").coalesce(1).write.parquet(str(path / "part13"))
    for file in parts(path, 9):
        os.remove(file)
    second = table()
    assert [d.strftime("%Y-%m") for d in second.update()] == ["2020-05", "2020-06", "2020-09", "2021-02"]
    rows = second.read().collect()
    assert {r.day.strftime("%Y-%m") for r in rows if r.run == 2} == {"2020-05", "2020-06", "2021-02"}
    assert not [r for r in rows if (r.day.year, r.day.month) == (2020, 9)]
    whole = spark.read.parquet(str(path / "*")).groupBy("day", "k").count().collect()
    assert {(r.day, r.k, r.n) for r in rows} == {(r.day, r.k, r["count"]) for r in whole}


def test_a_run_that_died_before_its_manifest_is_made_up_for(spark, articles):
    path, table = articles
    table().update()
    spark.createDataFrame([(dt.date(2020, 3, 3), 9)], "day date, k int").write.parquet(str(path / "part14"))
    dying = table()
    dying._keep = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        dying.update()
    assert [d.month for d in table().update()] == [3]
    assert table().update() == []


def test_spans_open_their_months_only_and_settings_part_tables(spark, articles):
    path, table = articles
    one = table()
    got = one.read([("2020-02-10", "2020-03-05")])
    assert {r.day.month for r in got.collect()} == {2, 3}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    other = derived.DerivedTable(spark, "counts", one.path, one.day, one.build, "other settings")
    assert other.folder != one.folder


def test_an_input_without_rows(spark, tmp_path):
    spark.createDataFrame([], "day date, k int").write.parquet(str(tmp_path / "none"))
    table = derived.DerivedTable(spark, "none", str(tmp_path / "none"), F.col("day"), lambda rows: rows.groupBy("day").count(), str(tmp_path))
    assert table.read().count() == 0 and table.update() == []
