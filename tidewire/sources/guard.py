"""Price a scan before running it, and refuse one above a ceiling.

Prices come from a table of statistics: for every file of a data set the bytes that its columns hold.
It is made by one pass over the files it does not know yet, best right after they are written, and
lies beside the derived tables. A scan is priced by the files that its partition filter leaves: these
are listed without being opened, on any file system, and joined with the statistics.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewire.sources import derived

# Bytes of a value of each type of fixed width.
WIDTHS = {
    T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.DateType: 4, T.FloatType: 4,
    T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16,
}
STATISTICS = "path string, size bigint, changed timestamp, column string, n_rows bigint, bytes bigint"


class ScanTooLarge(RuntimeError):
    pass


def _bytes_of(field: T.StructField) -> Column:
    """Bytes that a column holds: fixed widths, encoded lengths of texts, JSON lengths of nested values."""
    col = F.col(f"`{field.name}`")
    width = WIDTHS.get(type(field.dataType))
    if width is not None:
        return F.count(col) * width
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.sum(F.octet_length(col)), F.lit(0))
    return F.coalesce(F.sum(F.octet_length(F.to_json(col))), F.lit(0))


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """STATISTICS of the files that are there now. Only files it does not know yet are read."""
    place = f"{derived.store_folder(spark)}/statistics-{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:20]}"
    same = ["path", "size", "changed"]
    now = derived.file_list(spark, path)
    try:
        known = spark.read.schema(STATISTICS).parquet(place)
        fresh = now.join(known, same, "left_anti")
        if not fresh.limit(1).count():
            return known.join(now, same, "left_semi")
    except AnalysisException:  # none yet
        fresh = now
    rows = derived.of_files(spark.read.parquet(path), fresh)
    fields = [f for f in spark.read.parquet(path).schema.fields]
    m = F.col("_metadata")
    sums = rows.groupBy(m["file_path"].alias("path"), m["file_size"].alias("size"), m["file_modification_time"].alias("changed")).agg(
        F.count("*").alias("n_rows"), F.array(*[F.struct(F.lit(f.name).alias("column"), _bytes_of(f).cast("bigint").alias("bytes")) for f in fields]).alias("c"))
    sums.select(*same, F.inline("c"), "n_rows").select(*(c.split()[0] for c in STATISTICS.split(", "))).coalesce(1).write.mode("append").parquet(place)
    return spark.read.schema(STATISTICS).parquet(place).join(now, same, "left_semi")


def scan_price(spark: SparkSession, path: str, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """(column, bytes, n_rows, n_files) that a scan of the columns would read; ``where`` is a filter on
    partition columns."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    if where is not None:
        files = files.filter(where)
    left = files.select(F.col("_metadata.file_path").alias("path"))
    kept = statistics(spark, path).filter(F.col("column").isin(list(columns))).join(left, "path", "left_semi")
    return kept.groupBy("column").agg(
        F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_files"))


def guarded_scan(spark: SparkSession, path: str, columns: Sequence[str], max_bytes: int, where: Column | None = None) -> DataFrame:
    """The scan, if it is under the ceiling; an error before any of its data is read if not."""
    total = scan_price(spark, path, columns, where).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    if total > max_bytes:
        raise ScanTooLarge(f"{path}: would read {total} bytes, above the ceiling of {max_bytes}")
    rows = spark.read.parquet(path)
    return (rows if where is None else rows.filter(where)).select(*columns)
