"""Operator 5: shards along a Hilbert curve over several metadata dimensions. JVM expressions only.

Each dimension is quantised to ``2**bits`` steps, the steps become one place on the curve, rows are
sorted by it over the whole cluster and the order is cut into runs, so that every run is a compact
box in all dimensions and files can be skipped by any of them.

Law ``rows``: counts of shards differ by one at most. The sort deals rows by (curve, hash of the
row), so equal metadata never fills one task.

Defined cases: null dimensions stand at the lowest step; null texts have size 8 and the CRC of no
bytes; ties and repeated rows are told apart by a running number and get a slot each; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewire.llm.common import written


def curve_index(steps: list[Column], bits: int) -> Column:
    """The place of a cell on the Hilbert curve, from its step in each dimension.

    Walks from the highest bit down and keeps, in one running value, the cell as turned and
    mirrored so far; then the bits are read out across the dimensions.
    """
    n = len(steps)
    cell = F.array(*(s.cast("long") for s in steps))
    moves = F.array(*(F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(d).alias("d"))
                      for b in range(bits - 1, 0, -1) for d in range(n)))

    def turn(x: Column, m: Column) -> Column:
        low = m["q"] - 1
        mine, first = F.get(x, m["d"]), F.get(x, F.lit(0))
        swap = first.bitwiseXOR(mine).bitwiseAND(low)
        return F.when(mine.bitwiseAND(m["q"]) != 0, F.transform(
            x, lambda v, i: F.when(i == 0, v.bitwiseXOR(low)).otherwise(v))).otherwise(F.transform(
                x, lambda v, i: F.when((i == 0) | (i == m["d"]), F.when(
                    m["d"] == 0, v).otherwise(v.bitwiseXOR(swap))).otherwise(v)))

    turned = F.aggregate(moves, cell, turn)
    # Gray code across dimensions, then undo the carry of the last one.
    def gray(x: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), x, lambda a, d: F.transform(
            a, lambda v, i: F.when(i == d, v.bitwiseXOR(F.get(a, d - 1))).otherwise(v))) if n > 1 else x

    carry = lambda x: F.aggregate(
        F.array(*(F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1))), F.lit(0).cast("long"),
        lambda t, q: F.when(F.get(x, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    places = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(d).alias("d"))
                       for b in range(bits - 1, -1, -1) for d in range(n)))

    def read(held: Column) -> Column:
        return F.aggregate(places, F.lit(0).cast("long"), lambda t, p: t * 2 + F.getbit(
            F.get(held["x"], p["d"]).bitwiseXOR(held["t"]), p["b"]))

    step = F.transform(F.array(turned), gray)
    both = F.transform(step, lambda x: F.struct(x.alias("x"), carry(x).alias("t")))
    return F.transform(both, read)[0]


def named_step(column: Column, bits: int) -> Column:
    """A name's step: equal names share one, null stands at 0."""
    return F.when(column.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(column), F.lit(1 << bits)))


def size_step(column: Column, bits: int) -> Column:
    """A size's step: four steps for each doubling, so that long tails keep their order."""
    return F.when(column.isNull(), F.lit(0)).otherwise(F.least(
        F.floor(F.log2(F.greatest(column, F.lit(0)) + 1) * 4), F.lit((1 << bits) - 1)))


def ordered(df: DataFrame, curve: Column, tie: Column, partitions: int | None = None) -> DataFrame:
    """df with ``curve`` and ``place``: a gapless number from 0 in curve order over all rows.

    One range shuffle; the sorted rows are written to the shared folder, then only the counts of
    its partitions are summed.
    """
    tagged = df.withColumns({"curve": curve, "_tie": tie, "_run": F.monotonically_increasing_id()})
    keys = ["curve", "_tie", "_run"]
    n = partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = written(tagged.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(
        "_part", F.spark_partition_id()).withColumn("_line", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = sorted_rows.groupBy("_part").agg(F.count("*").alias("n"))
    before = counts.select(F.col("_part"), F.coalesce(F.sum("n").over(
        W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return sorted_rows.join(F.broadcast(before), "_part").withColumn(
        "place", F.col("_before") + F.col("_line")).drop("_part", "_line", "_before", "_tie", "_run")


def sharded(docs: DataFrame, shards: int = 24, bits: int = 6) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) over language, source and size."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "lang", "source", (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    curve = curve_index([named_step(F.col("lang"), bits), named_step(F.col("source"), bits),
                         size_step(F.col("size"), bits)], bits)
    placed = ordered(rows, curve, F.xxhash64("doc_id", "text_crc32"))
    total = placed.agg(F.count("*").alias("total"))
    # The first total % shards shards hold one row more.
    few, more = F.expr(f"total div {shards}"), F.col("total") % shards
    edge = more * (few + 1)
    shard = F.when(F.col("place") < edge, F.expr(f"place div (total div {shards} + 1)")).otherwise(
        more + F.expr(f"(place - (total % {shards}) * (total div {shards} + 1)) div greatest(total div {shards}, 1)"))
    slot = F.when(F.col("place") < edge, F.col("place") % (few + 1)).otherwise(
        (F.col("place") - edge) % F.greatest(few, F.lit(1)))
    return placed.join(F.broadcast(total)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
