"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewire.session import scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = r"[\x20\x09-\x0D]+"  # what parts words


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, gap: str = BLANKS) -> Column:
    """The words of a text between runs of ``gap``; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once: named inside a lambda, an expression would be
    computed again for every element."""
    return F.transform(F.array(value), then)[0]


def written(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back.

    Lineage ends there, lost executors lose nothing of it, and the reader knows its real size,
    so that the optimizer can choose a join by it.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """The place of a public vocabulary file; ``folder`` overrides where it is looked for."""
    folder = folder or os.environ.get("TIDEWIRE_TOKENIZERS")
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder, name)


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def small_batches(
    batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20, most_rows: int = 2048,
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most about ``most_bytes`` of ``text``, or one row."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and (held + size > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many marks behind it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
