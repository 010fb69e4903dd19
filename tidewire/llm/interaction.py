"""Operator 11: what each of several filters removes, in every order, kept up to date by retraction.

Five filters read whole texts: A few words, B few distinct words, C many capitals, D symbols, E the
text of a smaller doc_id. The files of the documents are a stream of available-now micro-batches.
A to D are known from a text alone; E is known from keyed state, which holds for every text the
smallest id so far and what was counted for it. When a smaller id comes, what was counted for the
old one is taken back and counted again with E. Each micro-batch writes the changes of its part counters (part,
flags, n) under its number, so a batch that runs twice changes nothing; counters are their sum. All
120 orders are then read off the counters: a step depends only on the set of filters before it.

State is in the state store (RocksDB, checkpointed in the shared folder), so no batch reads earlier
documents again, and a later ``update`` takes new files only. Texts are told apart by 128-bit
hashes; a key of the store holds the texts of one of ``groups`` hash ranges, about ``per_group`` of
them by the row count at the first run. Before the shuffle each task puts equal texts together: all
but those of its smallest id fail E for certain and become counts, so a text that a third of all
rows share sends a few rows a task.

Defined cases: a null text is empty; empty texts equal one another; rows that share the smallest
id do not fail E; a row with a null id is never E and makes no other row E; a null source is the
part of the empty string; repeated labels count once, and labels are as they are when a file is read; a repeated row is counted each time; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewire.llm.common import small_batches, written
from tidewire.session import scratch
from tidewire.streaming.feeds import store_on_disk

FILTERS = "ABCDE"
E, GOOD, TOXIC = 16, 32, 64  # A to D are 1, 2, 4, 8
SYMBOLS = b"#$%&*|"
_UPPER = bytes(range(65, 91))
_INNER = bytes(range(0x80, 0xC0))  # bytes of a character after its first


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # of bytes: at ASCII white space
    chars = len(text) - (len(text) - len(text.translate(None, _INNER)))
    upper = len(text) - len(text.translate(None, _UPPER))
    return ((len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * upper > 5 * chars) << 2
            | (len(text.translate(None, SYMBOLS)) < len(text)) << 3)


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, h, flags) of each document."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()),
                 pa.array(map(failures, texts), pa.int32())], ["doc_id", "part", "h", "flags"])

    return docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text").mapInArrow(
        work, "doc_id bigint, part string, h binary, flags int")


def combined(rows: DataFrame, groups: int, most: int = 200_000) -> DataFrame:
    """(grp, h, doc_id, part, flags, n): equal texts of a task put together. Rows of its smallest id
    keep it; rows whose flags are certain have no hash."""
    names = ["grp", "h", "doc_id", "part", "flags", "n"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, tuple[int, Counter]] = {}
        sure: Counter = Counter()

        def emitted() -> Iterator[pa.RecordBatch]:
            rows_ = [(int.from_bytes(h[:8], "little") % groups, h, doc, part, flags, n)
                     for h, (doc, held) in least.items() for (part, flags), n in held.items()]
            rows_ += [(xxhash.xxh64_intdigest(f"{flags} {part}") % groups, None, None, part, flags, n) for (part, flags), n in sure.items()]
            for at in range(0, len(rows_), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_[at:at + 5000]), types)], names)

        for batch in batches:
            for doc, part, h, flags in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "h", "flags"))):
                if doc is None:
                    sure[part, flags] += 1
                    continue
                found = least.get(h)
                if found is None or doc < found[0]:
                    if found is not None:
                        for (p, f), n in found[1].items():
                            sure[p, f | E] += n
                    least[h] = doc, Counter({(part, flags): 1})
                elif doc == found[0]:
                    found[1][part, flags] += 1
                else:
                    sure[part, flags | E] += 1
            if len(least) > most:
                yield from emitted()
                least, sure = {}, Counter()
        yield from emitted()

    types = [pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
    return rows.mapInArrow(work, "grp int, h binary, doc_id bigint, part string, flags int, n bigint")


def changed(rows: DataFrame) -> DataFrame:
    """(part, flags, n): changes of the counters, from combined rows and the state of their texts."""
    def work(key, frames, state):
        import pandas as pd

        held = json.loads(state.get[0]) if state.exists else {}
        changes: Counter = Counter()
        for frame in frames:
            for h, doc, part, flags, n in zip(*(frame[c].tolist() for c in ("h", "doc_id", "part", "flags", "n"))):
                if h is None:
                    changes[part, flags] += n
                    continue
                text = bytes(h).hex()
                doc = int(doc)
                found = held.get(text)
                if found is None or doc < found[0]:
                    if found is not None:  # the old smallest id is none any more
                        for p, f, m in found[1]:
                            changes[p, f] -= m
                            changes[p, f | E] += m
                    held[text] = [doc, [[part, flags, n]]]
                    changes[part, flags] += n
                elif doc == found[0]:
                    found[1].append([part, flags, n])
                    changes[part, flags] += n
                else:
                    changes[part, flags | E] += n
        state.update((json.dumps(held),))
        own = [(p, f, n) for (p, f), n in changes.items() if n]
        yield pd.DataFrame({"part": [p for p, _, _ in own], "flags": [f for _, f, _ in own], "n": [n for _, _, n in own]})

    # Ids travel as text: a column of them with nulls would become floating-point numbers.
    plain = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    return plain.groupBy("grp").applyInPandasWithState(
        work, "part string, flags int, n bigint", "held string", "append", "NoTimeout")


def one_pattern(path: str) -> str:
    """The path as a pattern that only it matches: a stream reads a single file only by a pattern."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


class InteractionAudit:
    """Counters of filter failures over the files at ``path``, kept in ``folder``."""

    def __init__(self, spark: SparkSession, path: str, labels: DataFrame, folder: str | None = None, batches: int = 4, per_group: int = 32):
        self.spark, self.path = spark, path
        self.folder = folder or scratch(spark)
        self.batches, self.per_group = batches, per_group
        self.labels = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
            (F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")) * GOOD + F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")) * TOXIC).alias("marks"))

    def _groups(self, docs: int) -> int:
        """The number of hash ranges, fixed by the first run that writes into the folder."""
        place = f"{self.folder}/groups"
        try:
            return self.spark.read.schema("n int").parquet(place).first()[0]
        except AnalysisException:
            n = max(64, docs // self.per_group)
            self.spark.createDataFrame([(n,)], "n int").coalesce(1).write.parquet(place)
            return n

    def update(self) -> InteractionAudit:
        """Count all files not counted yet, in about ``batches`` micro-batches if all are new."""
        spark = self.spark
        docs = spark.read.parquet(self.path)
        size = docs.select("_metadata.file_path").groupBy("file_path").agg(F.count("*").alias("n")).agg(
            F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("docs")).first()
        groups = self._groups(size["docs"])
        labels = written(self.labels)
        stream = spark.readStream.schema(docs.schema).option(
            "maxFilesPerTrigger", max(1, -(-size["files"] // self.batches))).parquet(one_pattern(self.path))
        known = masks(stream).join(labels.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left").select(
            "doc_id", "part", "h", F.col("flags").bitwiseOR(F.coalesce("marks", F.lit(0))).alias("flags"))
        with store_on_disk(spark):
            query = changed(combined(known, groups)).writeStream.outputMode("append").option(
                "checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).foreachBatch(self._written).start()
            query.awaitTermination()
        return self

    def _written(self, changes: DataFrame, batch: int) -> None:
        changes.groupBy("part", "flags").agg(F.sum("n").alias("n")).coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/changes/batch={batch}")

    def counters(self) -> DataFrame:
        """(part, flags, n): documents of each part by the filters they fail and their labels."""
        try:
            changes = self.spark.read.schema("part string, flags int, n bigint").parquet(f"{self.folder}/changes")
        except AnalysisException:  # no file yet
            changes = self.spark.createDataFrame([], "part string, flags int, n bigint")
        return changes.groupBy("part", "flags").agg(F.sum("n").alias("n")).filter("n <> 0")

    def result(self) -> DataFrame:
        """One row a part, order and step, from the counters: 80 pairs of a filter and those before it."""
        pairs = [(before, f) for f in range(5) for before in range(32) if not before >> f & 1]
        pair = F.explode(F.array(*(F.struct(F.lit(b).alias("before"), F.lit(1 << f).alias("f")) for b, f in pairs)))
        each = self.counters().select("part", "flags", "n", pair.alias("p")).select(
            "part", "n", "p.before", "p.f", F.col("flags").bitwiseAND(31).alias("mask"), "flags")
        fails, early = F.col("mask").bitwiseAND(F.col("f")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
        total = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).alias(name)
        sums = each.groupBy("part", "before", "f").agg(
            total(~early & ~fails, "kept"), total(fails & ~early, "removed"), total(fails & early, "redundant"),
            total(F.col("mask") == F.col("f"), "unique_fails"),
            total(fails & ~early & (F.col("flags").bitwiseAND(GOOD) != 0), "good_lost"),
            total(fails & ~early & (F.col("flags").bitwiseAND(TOXIC) != 0), "toxic_lost"))
        first = F.bit_count("before")
        ways = sum((F.when(first == k, factorial(k) * factorial(4 - k)).otherwise(0) for k in range(5)), F.lit(0))
        shapley = sums.groupBy("part", "f").agg(F.sum(F.col("removed") * ways).alias("shapley"))
        orders = [("".join(o), k + 1, sum(1 << FILTERS.index(x) for x in o[:k]), 1 << FILTERS.index(o[k]))
                  for o in permutations(FILTERS) for k in range(5)]
        steps = self.spark.createDataFrame(orders, "filter_order string, step int, before int, f int")
        return sums.join(shapley, ["part", "f"]).join(steps, ["before", "f"]).select(
            "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
