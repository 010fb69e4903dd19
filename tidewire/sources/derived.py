"""Derived tables: written once, found again by what they were made from, extended by what changed.

A table made month by month from a fact table lies in a folder named by a fingerprint: its name, the
place of its input and its settings. Beside its data stands a manifest of the input files (place,
size, time) and the months each of them holds. A later request lists the input's files, which opens
none of them, and compares:

* nothing changed: the written table is read;
* files came, went or changed: the months they hold, and only these, are made again from the input
  and overwritten in place. The days of new files are read to learn their months.

The manifest is written last. A run that dies before leaves the old manifest, so the next one finds
the same changes and makes the same months again. One writer at a time is assumed.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable, Sequence
from types import ModuleType

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewire.session import durable, shared_folder
from tidewire.sources.articles import in_spans

MANIFEST = "path string, size bigint, changed timestamp, month date"
LITERAL_PATHS = 1000  # up to so many changed files are named in the filter, which prunes the scan


def store_folder(spark: SparkSession) -> str:
    """Where derived tables lie: ``spark.tidewire.store``, or inside the shared folder."""
    return spark.conf.get("spark.tidewire.store", None) or f"{shared_folder(spark).rstrip('/')}/derived"


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, changed) of the parquet files under a path. Only the file system is asked."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    m = F.col("_metadata")
    return files.select(m["file_path"].alias("path"), m["file_size"].alias("size"), m["file_modification_time"].alias("changed"))


def of_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of the given files. Few files are named in the filter, so that others are not opened."""
    named = [r[0] for r in files.select("path").limit(LITERAL_PATHS + 1).collect()]
    place = F.col("_metadata.file_path")
    if len(named) <= LITERAL_PATHS:
        return rows.filter(place.isin(named))
    return rows.join(files.select(F.col("path").alias("_place")), place == F.col("_place"), "left_semi")


def rules_of(*modules: ModuleType) -> str:
    """A fingerprint of code whose change must give new tables."""
    return hashlib.sha256("".join(map(inspect.getsource, modules)).encode()).hexdigest()


class DerivedTable:
    """One derived table: ``build`` maps rows of the input to rows with a ``day``, and never mixes months.

    ``day`` is the day of an input row.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, day: Column, build: Callable[[DataFrame], DataFrame], settings: object = None):
        self.spark, self.path, self.build = spark, path.rstrip("/"), build
        self.day, self.month = day, F.trunc(day, "month")
        print_of = hashlib.sha256(json.dumps([name, self.path, settings], sort_keys=True).encode()).hexdigest()[:20]
        self.folder = f"{store_folder(spark)}/{name}-{print_of}"

    # -- what is known -------------------------------------------------------------------------
    def manifest(self) -> tuple[int, DataFrame]:
        """The latest version of the manifest, 0 and empty if there is none."""
        try:
            kept = self.spark.read.schema(MANIFEST + ", version int").parquet(f"{self.folder}/manifest")
            last = kept.agg(F.max("version")).first()[0] or 0
        except AnalysisException:
            last = 0
        if not last:
            return 0, self.spark.createDataFrame([], MANIFEST)
        return last, kept.filter(F.col("version") == last).drop("version")

    def _months_of(self, files: DataFrame | None) -> DataFrame:
        """(path, month) of the given files, or of all; only the day column is read."""
        rows = self.spark.read.parquet(self.path)
        if files is not None:
            rows = of_files(rows, files)
        return rows.select(F.col("_metadata.file_path").alias("path"), self.month.alias("month")).distinct()

    # -- reading -------------------------------------------------------------------------------
    def read(self, spans: Sequence[tuple[str, str]] | None = None) -> DataFrame:
        """The table, brought up to date; with ``spans``, only the months of these are opened."""
        self.update()
        try:
            table = self.spark.read.parquet(f"{self.folder}/data")
        except AnalysisException:  # an input without rows
            return self.build(self.spark.read.parquet(self.path).limit(0))
        if spans is not None:
            from tidewire.sources import tables

            return tables.read_days(self.spark, f"{self.folder}/data", spans)
        return table.drop("month")

    def update(self) -> list:
        """Make the months again that changed files hold; returns these months."""
        version, known = self.manifest()
        now = file_list(self.spark, self.path)
        if not version:
            pairs = durable(self._months_of(None))  # read twice below
            self._write(None)
            self._keep(1, now.join(pairs, "path"))
            return [r[0] for r in pairs.select("month").distinct().orderBy("month").collect()]
        same = ["path", "size", "changed"]
        fresh = now.join(known, same, "left_anti")
        gone = known.join(now, same, "left_anti")
        if not fresh.select("path").unionByName(gone.select("path")).limit(1).count():
            return []
        pairs = durable(self._months_of(fresh))
        stale = sorted(r[0] for r in pairs.select("month").unionByName(gone.select("month")).distinct().collect() if r[0])
        self._write(stale)
        self._keep(version + 1, known.join(now, same, "left_semi").unionByName(fresh.join(pairs, "path")))
        return stale

    def _keep(self, version: int, rows: DataFrame) -> None:
        rows.select("path", "size", "changed", "month").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")

    def _write(self, stale: list | None) -> None:
        """Overwrite the stale months, or all; a month without rows any more is taken away."""
        from tidewire.sources import tables

        rows = self.spark.read.parquet(self.path)
        if stale is not None:
            if not stale:
                return
            rows = rows.filter(in_spans(self.day, month_spans(stale)))
        made = self.build(rows).withColumn("month", F.trunc("day", "month"))
        if stale is None:
            tables.write_partitioned(made, f"{self.folder}/data", ["month"])
            return
        tables.write_partitioned(made, f"{self.folder}/data", ["month"], dynamic=True)
        filled = {r[0] for r in self._months_present(stale)}
        jvm = self.spark._jvm
        for month in stale:
            if month not in filled:
                place = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data/month={month}")
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def _months_present(self, stale: list) -> list:
        """The stale months that the input still has rows of."""
        rows = self.spark.read.parquet(self.path).filter(in_spans(self.day, month_spans(stale)))
        return rows.select(self.month).distinct().collect()


def month_spans(months: Sequence) -> list[tuple[str, str]]:
    """First and last days of runs of neighbouring months."""
    import datetime as dt

    spans: list[list] = []
    for month in sorted(months):
        last = (month.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
        if spans and spans[-1][1] + dt.timedelta(days=1) == month:
            spans[-1][1] = last
        else:
            spans.append([month, last])
    return [(str(a), str(b)) for a, b in spans]
