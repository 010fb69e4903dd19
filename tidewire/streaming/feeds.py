"""Incremental forms of the daily tables on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from tidewire.operators.daily import _facts
from tidewire.operators import labelling
from tidewire.sources.tables import upsert_partitions


STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",  # every partition holds a buffer
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition reserves megabytes
}


def read_feed(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ordered_files(spark: SparkSession, path: str) -> None:
    """Give the files of a folder modification times in order of their names.

    A feed takes files in order of time. Parts of ``repartitionByRange`` are named in order of their
    ranges, but may finish in any; delivered by name, no later trigger holds earlier rows.
    """
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    newest = max((fs.getFileStatus(f).getModificationTime() for f in files), default=0)
    for i, file in enumerate(files):
        fs.setTimes(file, newest - len(files) + 1 + i, -1)


def _utc_day(ts: Column) -> Column:
    """The UTC calendar day of an instant, whatever the session time zone."""
    days = F.floor(F.unix_seconds(ts) / 86400).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def daily_counts(feed: DataFrame, delay: str = "2 days") -> DataFrame:
    """Additive daily state per label: counts and tone sums; late rows within ``delay``
    still count. Ratios are taken in :func:`ratios`, so state stays small and mergeable."""
    facts = labelling.without_aggregators(_facts(feed)).withWatermark("ts", delay)
    kept = labelling.with_label(facts)
    conflict = F.col("is_conflict")
    return kept.groupBy(F.window("ts", "1 day"), "ecosystem").agg(
        F.count("*").alias("n_total"), F.count_if(conflict).alias("n_conflict"),
        F.sum("tone").alias("tone_sum"), F.count("tone").alias("tone_n"),
        F.sum(F.when(conflict, F.col("tone"))).alias("tone_conflict_sum"),
        F.count(F.when(conflict, F.col("tone"))).alias("tone_conflict_n"),
    ).select(_utc_day(F.col("window.start")).alias("day"), "ecosystem", "n_total", "n_conflict",
             "tone_sum", "tone_n", "tone_conflict_sum", "tone_conflict_n")


def ratios(counts: DataFrame) -> DataFrame:
    """The daily label table from additive counts."""
    return counts.select(
        "day", "ecosystem", "n_total", "n_conflict",
        F.try_divide("n_conflict", "n_total").alias("share"),
        F.try_divide("tone_conflict_sum", "tone_conflict_n").alias("tone_conflict"),
        F.try_divide("tone_sum", "tone_n").alias("tone_all"))


def upsert_stream(
    rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], partition: str = "day",
) -> DataStreamWriter:
    """Merge every micro-batch into a table, the newest row per key winning. A batch that
    is delivered again changes nothing."""
    def merge(batch: DataFrame, _: int) -> None:
        upsert_partitions(batch, path, keys, partition)
    return rows.writeStream.outputMode("update").option(
        "checkpointLocation", checkpoint).foreachBatch(merge)


def activity_blocks(feed: DataFrame, key: str, gap: str = "168 hours", delay: str = "2 days") -> DataFrame:
    """Blocks of activity separated by more than ``gap``."""
    return feed.withWatermark("ts", delay).groupBy(
        key, F.session_window("ts", gap)).agg(F.count("*").alias("n")).select(
        key, F.col("session_window.start").alias("start"),
        F.col("session_window.end").alias("end"), "n")


@contextmanager
def store_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the on-disk store, so keys need not fit in memory."""
    kept = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def distinct_urls_table(feed: DataFrame, path: str, checkpoint: str, url: str = "url") -> DataStreamWriter:
    """Each URL once, however far apart its records are, as files under ``path``.

    The URLs seen are keyed state: a micro-batch looks up its own URLs and nothing else, so what it
    reads does not grow with history. Files are listed in the sink's log, so a batch that is
    delivered again adds nothing. Start it inside :func:`store_on_disk`.
    """
    fresh = feed.select(url).dropDuplicates([url])
    return fresh.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def distinct_urls(feed: DataFrame, url: str = "url", delay: str = "2 days") -> DataFrame:
    """The first record of each URL inside the watermark."""
    return feed.withWatermark("ts", delay).dropDuplicatesWithinWatermark([url])
