"""Near-duplicate texts: shingles, min-hash bands, exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewire.session import durable, scratch


def shingle_codes(text: str, size: int) -> np.ndarray:
    """Distinct 64-bit codes of all ``size``-character windows of the whole text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(points) < size:
        return np.empty(0, dtype=np.int64)
    code = np.zeros(len(points) - size + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            code = code * np.uint64(0x9E3779B97F4A7C15) + points[k:len(code) + k].astype(np.uint64)
            code ^= code >> np.uint64(29)
    code.sort()
    return code[np.append(True, code[1:] != code[:-1])].view(np.int64)


def odd_sketch(codes: np.ndarray) -> bytes:
    """One bit for each bin of the codes: whether it holds an odd number of them. The bins are a power of
    two: one or two a code, for more than 2048 codes half of that, 256 at least. Two sketches differ in the odd bins of the
    codes that are not in both."""
    bins = 1 << max(8, min(len(codes).bit_length(), max(11, len(codes).bit_length() - 1)))
    held = np.bincount(codes.view(np.uint64) & np.uint64(bins - 1), minlength=bins)
    return np.packbits((held & 1).astype(np.uint8)).tobytes()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _stored(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back, so that later steps open only their columns.
    The shuffle files of the write go when it ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def signer(size: int, n_perm: int, seed: int, sketches: bool = False):
    """A function of batches (first, hash, text) to (first, hash, signature): ``n_perm`` bytes, the low ones
    of min-hashes. Unequal minima share a byte once in 256, which adds candidates and loses none. On
    request also n, the number of distinct shingles, and their odd sketch.

    One text at a time is cut into shingles, which stay inside the task; texts without any give no row.
    """
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 32, n_perm, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, n_perm, dtype=np.uint32)

    def minima(u: np.ndarray) -> np.ndarray:
        low, many = np.empty(n_perm, np.uint32), max(1, (1 << 15) // len(u))  # as many hashes at once as the cache holds
        for k in range(0, n_perm, many):
            hashed = np.multiply(a[k:k + many, None], u)
            hashed += b[k:k + many, None]
            hashed.min(1, out=low[k:k + many])
        return low

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed, counts, odd = [], [], []
            for t in batch.column("text"):
                codes = shingle_codes(t.as_py(), size)
                u = (codes.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
                signed.append(minima(u).astype(np.uint8).tobytes() if len(u) else None)
                if sketches:
                    counts.append(len(u))
                    odd.append(odd_sketch(codes))
            out = {"first": batch.column("first"), "hash": batch.column("hash"), "signature": pa.array(signed, pa.binary())}
            if sketches:
                out |= {"n": pa.array(counts, pa.int64()), "sketch": pa.array(odd, pa.binary())}
            out = pa.RecordBatch.from_arrays(list(out.values()), list(out))
            yield out.filter(out.column("signature").is_valid())
    return sign


class _Sieve:
    """Pairs of texts in one bucket that may reach the threshold, by their numbers of shingles and sketches.

    A similarity of t leaves (1 - t) / (1 + t) of both sets together outside the common part, and the larger
    set has at most 1 / t of the smaller one. The sketches of d differing shingles differ in d bins at most, and in
    m / 2 * (1 - exp(-2 * d / m)) of m bins on average; a pair goes beyond five standard errors above that.
    """

    def __init__(self, threshold: float, room: int = 1 << 15):
        self.threshold, self.room = threshold, room
        self.share = (1 - threshold) / (1 + threshold)
        self.folds = int(np.ceil(np.log2(1 / threshold)))
        self.bounds: dict[tuple[int, int], np.ndarray] = {}

    def bound(self, level: int, parts: int) -> np.ndarray:
        """By d: the most bins that may differ in one of ``parts`` of a sketch of 2^level bins."""
        if (level, parts) not in self.bounds:
            bins = 1 << level
            d = np.arange(int(self.share * (4 * bins) * (1 + 1 / self.threshold)) + 3)
            mean, spread = bins / 2 * -np.expm1(-2 * d / bins) / parts, bins / 4 * -np.expm1(-4 * d / bins) / parts
            self.bounds[level, parts] = np.minimum(d, mean + 5 * np.sqrt(spread)).astype(np.int32)
        return self.bounds[level, parts]

    def pairs(self, cells: np.ndarray, sides: np.ndarray, crossed: np.ndarray, n: np.ndarray, sketches: list[bytes]) -> Iterator[tuple]:
        """Positions (one, two), a part at a time. Rows are sorted by (cell, n); in crossed cells the sides must differ."""
        rows, any_crossed = np.arange(len(n)), crossed.any()
        ends = np.searchsorted((cells << 32) + n, (cells << 32) + np.floor(n / self.threshold + 1e-9).astype(np.int64), "right")
        many = ends - rows - 1
        level = np.array([len(x) for x in sketches]) * 8
        for bins in np.unique(level[many > 0]).tolist():
            # Sketches of this size, and larger ones folded to it: a partner is at most 1 / t as large.
            table, at = [], np.zeros(len(n), np.int64)
            for fold in range(self.folds + 1):
                some = np.flatnonzero(level == bins << fold)
                words = np.frombuffer(b"".join([sketches[i] for i in some]), np.uint64).reshape(len(some), 1 << fold, bins // 64)
                at[some] = sum(map(len, table)) + np.arange(len(some))
                table.append(np.bitwise_xor.reduce(words, axis=1))
            table = np.concatenate(table)
            parts = max(1, bins // 512)  # most pairs stand out in the first 512 bins
            head = np.ascontiguousarray(table[:, :bins // 64 // parts].T)
            with_any = np.flatnonzero((level == bins) & (many > 0))
            stops = np.cumsum(many[with_any])
            begin = 0
            while begin < len(with_any):
                stop = max(begin + 1, int(np.searchsorted(stops, (stops[begin - 1] if begin else 0) + self.room, "right")))
                lefts = with_any[begin:stop]
                one = np.repeat(lefts, many[lefts])
                two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(many[lefts]) - many[lefts], many[lefts])
                begin = stop
                if any_crossed:
                    good = ~crossed[one] | (sides[one] != sides[two])
                    one, two = one[good], two[good]
                out, x, y = (self.share * (n[one] + n[two]) + 1e-9).astype(np.int64), at[one], at[two]
                differ = np.zeros(len(one), np.int32)
                for word in head:
                    differ += np.bitwise_count(word[x] ^ word[y])
                good = np.flatnonzero(differ <= self.bound(bins.bit_length() - 1, parts)[out])
                if parts > 1:
                    differ = np.bitwise_count(table[x[good]] ^ table[y[good]]).sum(1, dtype=np.int32)
                    good = good[differ <= self.bound(bins.bit_length() - 1, 1)[out[good]]]
                if len(good):
                    yield one[good], two[good]


def _candidates(met: DataFrame, rows: int, threshold: float, batch: int = 4096) -> DataFrame:
    """(first, leader): pairs of a block pair that may reach the threshold, each once.

    ``met`` is (band, bucket, lo, hi, side, first, n, head, sketch), a row for each member of two blocks, or of
    one with itself; ``head`` are the bands before the last of the turn. Rows come sorted by block pair; a task
    holds one batch and one block pair. A pair comes from the first band that it shares only.
    """
    key = ["band", "bucket", "lo", "hi"]
    columns = [*key, "side", "first", "n", "head", "sketch"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = _Sieve(threshold)

        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            band, bucket, lo, hi, side, ids, n = (table.column(c).to_numpy().astype(np.int64) for c in columns[:7])
            new = np.append(False, (np.diff(np.stack([band, bucket, lo, hi]), axis=1) != 0).any(0))
            cells = np.cumsum(new)
            order = np.lexsort((n, cells))
            sketches = table.column("sketch").to_pylist()
            heads = table.column("head").to_pylist()
            heads = np.frombuffer(b"".join(heads), np.uint8).reshape(len(n), len(heads[0]) // rows, rows)
            for one, two in sieve.pairs(cells, side[order], (lo != hi)[order], n[order], [sketches[i] for i in order]):
                one, two = order[one], order[two]
                known = (heads[one] == heads[two]).all(2) & (np.arange(heads.shape[1]) < band[one][:, None])
                one, two = ids[one], ids[two]
                good = ~known.any(1) & (one != two)
                one, two = one[good], two[good]
                if len(one):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(one, two)), pa.array(np.minimum(one, two))], ["first", "leader"])

        held: list[pa.RecordBatch] = []  # whole block pairs, and the one that the last batch ended in
        for part in batches:
            held.append(part.select(columns))
            if sum(x.num_rows for x in held) < batch:
                continue
            table = pa.Table.from_batches(held)
            ends = np.stack([table.column(c).to_numpy().astype(np.int64) for c in key])
            cuts = np.flatnonzero((ends[:, 1:] != ends[:, :-1]).any(0))
            cut = int(cuts[-1]) + 1 if len(cuts) else 0
            if cut:
                yield from found(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held and sum(x.num_rows for x in held):
            yield from found(pa.Table.from_batches(held))

    return met.repartition(*key).sortWithinPartitions(*key).select(*columns).mapInArrow(work, "first bigint, leader bigint")


def _verified(pairs: DataFrame, size: int, threshold: float) -> DataFrame:
    """(first, leader, jaccard) of pairs (first, leader, text, other) at or above the threshold, by the
    whole shingle sets of both texts. The sets live in the task, two at a time."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, np.ndarray]] = {}

        def codes(side: str, text: str) -> np.ndarray:  # neighbouring rows often share a text
            if side not in known or known[side][0] != text:
                known[side] = (text, shingle_codes(text, size))
            return known[side][1]

        for batch in batches:
            found = []
            for x, y in zip(batch.column("text"), batch.column("other")):
                one, two = codes("text", x.as_py()), codes("other", y.as_py())
                both = np.concatenate([one, two])
                both.sort(kind="stable")  # merges two sorted runs
                common = int((both[1:] == both[:-1]).sum())
                found.append(common / (len(one) + len(two) - common))
            out = pa.RecordBatch.from_arrays(
                [batch.column("first"), batch.column("leader"), pa.array(found, pa.float64())], ["first", "leader", "jaccard"])
            yield out.filter(pa.array(np.array(found) >= threshold))

    return pairs.select("first", "leader", "text", "other").mapInArrow(work, "first bigint, leader bigint, jaccard double")


def _roots(left: DataFrame) -> DataFrame:
    """(root): leaders of ``left`` (first, leader) that are below no other."""
    return left.select(F.col("leader").alias("root")).distinct().join(
        left.select(F.col("first").alias("root")).distinct(), "root", "left_anti")


def _edges(pairs: DataFrame, sets: DataFrame, size: int, threshold: float, early: int = 2) -> DataFrame:
    """(first, leader, jaccard): all pairs at or above the threshold whose leader may stand.

    A large group of near copies has a pair for any two of its texts, but nearly all fall to its first one.
    So ``early`` turns verify the pairs of the earliest texts alone; those of texts that fall by them are
    not needed, as these lead nothing. What is left after that is verified at once.
    """
    def verified(some: DataFrame) -> DataFrame:
        joined = some.join(sets, "first").join(sets.select(F.col("first").alias("leader"), F.col("text").alias("other")), "leader")
        return _stored(_verified(joined, size, threshold))

    found = None
    rest, left = pairs, pairs  # pairs not verified of leaders that have not fallen; those of undecided texts
    for _ in range(early):
        roots = _stored(_roots(left).withColumnRenamed("root", "leader"))
        now = verified(rest.join(roots, "leader", "left_semi"))
        found = now if found is None else found.unionByName(now)
        fallen = _stored(now.select(F.col("first").alias("leader")).distinct())
        rest = _stored(rest.join(roots.unionByName(fallen), "leader", "left_anti"))
        left = rest.join(fallen.withColumnRenamed("leader", "first"), "first", "left_anti")
    rest = verified(rest)
    return rest if found is None else found.unionByName(rest)


def _standing(edges: DataFrame) -> DataFrame | None:
    """(root): the leaders in ``edges`` (first, leader) that no earlier standing text is close to; None without edges.

    A text with no undecided earlier neighbour stands; its later neighbours fall with all their edges.
    Each turn decides the earliest text of every cluster left, on the table of edges alone. A text may stand
    after all that it leads have fallen to others, so those that stand are the leaders that never fall.
    """
    left = durable(edges.select("first", "leader"))
    gone = None
    while left.limit(1).count():
        roots = durable(_roots(left))
        fallen = left.join(roots.withColumnRenamed("root", "leader"), "leader", "left_semi").select(F.col("first").alias("gone")).distinct()
        fallen = durable(fallen)
        gone = fallen if gone is None else gone.unionByName(fallen)
        rest = left.join(fallen.withColumnRenamed("gone", "leader"), "leader", "left_anti").join(
            fallen.withColumnRenamed("gone", "first"), "first", "left_anti").join(roots.withColumnRenamed("root", "leader"), "leader", "left_anti")
        left = durable(rest)
    if gone is None:
        return None
    return edges.select(F.col("leader").alias("root")).distinct().join(gone.withColumnRenamed("gone", "root"), "root", "left_anti")


def near_duplicates(
    texts: DataFrame, key: str, text: str, size: int = 5, n_perm: int = 128, bands: int = 32,
    threshold: float = 0.7, min_length: int = 20, seed: int = 1, block: int = 4096, turn: int = 4,
) -> DataFrame:
    """(key, duplicate_of, jaccard): texts at or above the threshold with an earlier text that stands,
    and the closest such text.

    Keys are integers. Identical texts collapse first, so a group of copies of any size is one row from
    then on. Distinct texts that share a band fall into one bucket; ``turn`` bands are worked on at a time, as
    the members of a bucket travel with their sketches. Members of a bucket above ``block`` are dealt into
    blocks by hash. Blocks and pairs of them are compared inside tasks, which emit the pairs that may
    reach the threshold (see ``_Sieve``), each in the first band it shares. It is verified on whole
    shingle sets, which are made from its texts inside the task and leave it for nowhere. The number of
    jobs does not depend on the size of a bucket.

    A pair is missed only if no band agrees (1.5e-4 at the default threshold, less above it) or its sketches
    stand out by five standard errors (3e-7).
    """
    rows = n_perm // bands
    long = texts.filter(F.length(text) >= min_length).select(
        F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    named = long.withColumn("hash", F.sha2("text", 256))
    # Copies are signed where they are read, so that no text travels.
    signed = named.select(F.col("key").alias("first"), "hash", "text").mapInArrow(
        signer(size, n_perm, seed, sketches=True), "first bigint, hash string, signature binary, n bigint, sketch binary")
    base = _stored(signed.groupBy("hash").agg(
        F.min("first").alias("first"), *[F.any_value(c).alias(c) for c in ("signature", "n", "sketch")]))

    def buckets(begin: int, end: int, *columns) -> DataFrame:
        values = F.array(*[F.xxhash64(F.substring("signature", i * rows + 1, rows)) for i in range(begin, end)])
        return base.select(*columns, F.posexplode(values).alias("band", "bucket")).withColumn("band", F.col("band") + begin)

    large = _stored(buckets(0, bands).groupBy("band", "bucket").agg(F.count("*").alias("members")).filter(F.col("members") > block))
    pairs = None
    for begin in range(0, bands, turn):
        end = min(begin + turn, bands)
        head = F.substring("signature", 1, (end - 1) * rows).alias("head")
        members = buckets(begin, end, "first", "n", head, "sketch").join(large, ["band", "bucket"], "left").withColumn(
            "parts", F.coalesce(F.ceil(F.col("members") / block), F.lit(1)).cast("int"))
        members = members.withColumn("own", F.pmod(F.xxhash64("first"), F.col("parts")).cast("int"))
        # A member meets every block of its bucket, its own once.
        met = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
            "band", "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
            (F.col("own") > F.col("other")).cast("int").alias("side"), "first", "n", "head", "sketch")
        found = _stored(_candidates(met, rows, threshold))
        pairs = found if pairs is None else pairs.unionByName(found)
    ids = pairs.select("first").unionByName(pairs.select(F.col("leader").alias("first"))).distinct()
    paired = base.select("first", "hash").join(ids, "first").withColumnRenamed("first", "key")
    sets = _stored(named.join(paired, ["key", "hash"], "left_semi").groupBy(F.col("key").alias("first")).agg(
        F.any_value("text").alias("text")))
    edges = _edges(pairs, sets, size, threshold)
    named = named.drop("text")
    exact = named.join(named.groupBy("hash").agg(F.min("key").alias("first")), "hash")
    same = exact.filter(F.col("key") != F.col("first")).select(
        "key", F.col("first").alias("duplicate_of"), F.lit(1.0).alias("jaccard"))
    stands = _standing(edges)
    if stands is not None:
        near = edges.join(stands.withColumnRenamed("root", "leader"), "leader", "left_semi").groupBy(F.col("first").alias("key")).agg(
            F.min_by("leader", F.struct(-F.col("jaccard"), "leader")).alias("duplicate_of"), F.max("jaccard").alias("jaccard"))
        same = same.unionByName(near)
    kind = texts.schema[key].dataType
    return same.select(F.col("key").cast(kind).alias("key"), F.col("duplicate_of").cast(kind).alias("duplicate_of"), "jaccard")
