"""Merges by key and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def upsert(
    base: DataFrame, fresh: DataFrame, keys: Sequence[str], keep: str = "last",
    delivered: Sequence[Column] | None = None,
) -> DataFrame:
    """Merge two tables of one schema; one row per key survives.

    ``keep='last'`` lets the fresh row win, ``'first'`` the existing one. ``delivered``, such as
    batch number and file time, says which of several rows of one side came later; without
    it a key that repeats within a side with different rows is an error. An aggregate with map-side combine, not a window: a key with
    very many copies shrinks before the shuffle.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last', not {keep!r}")
    both = base.withColumn("_side", F.lit(0)).unionByName(fresh.withColumn("_side", F.lit(1)))
    order = F.struct(F.col("_side"), *(delivered or []))
    pick = F.max_by if keep == "last" else F.min_by
    values = F.struct(*[F.col(x) for x in base.columns if x not in keys])
    row = pick(values, order)
    if delivered is None:
        sides = [F.when(F.col("_side") == side, values) for side in (0, 1)]
        same = [F.min(v).eqNullSafe(F.max(v)) for v in sides]
        row = F.when(same[0] & same[1], row).otherwise(F.raise_error(
            F.lit("a key repeats with different rows: say in which order they were delivered")))
    merged = both.groupBy(*keys).agg(row.alias("_row"))
    return merged.select(*[
        F.col(x) if x in keys else F.col(f"_row.{x}").alias(x) for x in base.columns
    ])


def upsert_partitions(
    fresh: DataFrame, path: str, keys: Sequence[str], partition: str = "day",
) -> None:
    """Merge ``fresh`` into a parquet table, rewriting only the partitions it touches.

    Only the stored partitions with a fresh day are read back, and the write replaces
    just those (dynamic overwrite). Running it twice changes nothing.
    """
    spark = fresh.sparkSession
    try:
        stored = spark.read.parquet(path)
    except Exception as exc:  # the first write finds no table
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        merged = upsert(fresh.limit(0), fresh, keys)
    else:
        touched = fresh.select(partition).distinct()
        base = stored.select(*fresh.columns).join(touched, partition, "left_semi")
        merged = upsert(base.select(*fresh.columns), fresh, keys)
    from tidewire.session import durable
    write_partitioned(durable(merged), path, [partition], dynamic=True)


def write_partitioned(
    df: DataFrame, path: str, by: Sequence[str], dynamic: bool = False,
) -> None:
    """Parquet by partition; rows of one partition value meet before the write, so each
    value gets few files."""
    writer = df.repartition(*by).write.mode("overwrite").partitionBy(*by)
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def read_days(
    spark: SparkSession, path: str, spans: Sequence[tuple[str, str]], partition: str = "month",
) -> DataFrame:
    """The days of a table written by month; other months are not opened."""
    stored = spark.read.parquet(path)
    months = [F.col(partition).between(F.trunc(F.lit(a).cast("date"), "month"), F.lit(b).cast("date")) for a, b in spans]
    days = [F.col("day").between(F.lit(a).cast("date"), F.lit(b).cast("date")) for a, b in spans]
    return stored.filter(reduce(or_, months) & reduce(or_, days)).drop(partition)


def write_result(df: DataFrame, path: str) -> None:
    """A small result table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
