"""Operator 4: near-duplicate documents by MinHash, with sequential Bayesian verification.

Equal shingle sets collapse to one class first. Classes sign with MinHash; equal bands put them in
one bucket. Candidates are compared by their signatures, a batch of hashes at a time, and are
dropped once the posterior probability of reaching the threshold falls under ``miss``; what
survives is verified on full sets. Pairs that hold link classes; components take their smallest id.

No bucket gives all its pairs. A round compares every member with one hub of its bucket; hubs
change from round to round, and members already in the hub's component are not compared again.
When a further round would save less than half, every pair of a bucket that is still in two
components is compared: its members outside the bucket's largest component against all others,
in buckets of more than ``few`` members by blocks inside tasks, which emit links only.
So a link is lost only where no band agrees (3e-6 at similarity 0.8 with the default bands) or
at ``miss``. All state is in tables of the shared folder.

Sets and classes are told apart by 64 and 128-bit hashes.

Defined cases: null texts and texts without words have an empty set and link with nothing; a text
of fewer words than a shingle is one shingle; rows with a null id take part, and a component of
them alone has a null id; repeated rows share a class and a component; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tidewire.llm.common import LOWER, UPPER, small_batches, unused, written

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWERED = str.maketrans(UPPER, LOWER)


class Shingles:
    """Distinct 64-bit codes of the runs of ``size`` words of a text."""

    def __init__(self, size: int, cache_size: int = 200_000):
        self.size, self.cache_size = size, cache_size
        self.cache: dict[str, int] = {}

    def _word(self, word: str) -> int:
        if len(self.cache) >= self.cache_size:
            self.cache.clear()
        self.cache[word] = code = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) | 1
        return code

    def codes(self, text: str | None) -> np.ndarray:
        words = _WORDS.findall((text or "").translate(_LOWERED))
        if not words:
            return np.empty(0, np.uint64)
        get, miss = self.cache.get, self._word
        each = np.array([get(w) or miss(w) for w in words], np.uint64)
        width = min(self.size, len(each))
        with np.errstate(over="ignore"):
            code = np.full(len(each) - width + 1, width, np.uint64)
            for k in range(width):
                code = (code ^ each[k:len(code) + k]) * np.uint64(0x9E3779B97F4A7C15)
                code ^= code >> np.uint64(31)
        return np.unique(code)


def sign(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A row of upper 32 bits of minimum hashes for each set; none of the sets is empty."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), len(a)), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(len(a)):
            out[:, k] = np.minimum.reduceat(joined * a[k] + b[k], starts) >> np.uint64(32)
    return out


def least_matches(steps: list[int], threshold: float, miss: float, bits: int = 8) -> list[int]:
    """For each number of compared hashes, the fewest equal ones at which a pair stays.

    Under an even prior of the similarity s, hashes of ``bits`` bits agree with probability
    s + (1 - s) / 2**bits; a pair is dropped where the posterior of s >= threshold is under ``miss``.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 2 ** bits
    out = []
    for n in steps:
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-np.minimum(p, 1 - 1e-15))
            weight = np.exp(log - log.max())
            if weight[s >= threshold].sum() >= miss * weight.sum():
                break
        out.append(m)
    return out


SIGNED = "n_shingles long, cid binary, buckets array<bigint>, signature binary"


class NearDuplicates:
    """The near-duplicate components of a table of texts."""

    def __init__(
        self, docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80,
        bands: int = 32, rows: int = 5, batch: int = 32, miss: float = 1e-6, seed: int = 1,
        few: int = 8, block: int = 256,
    ):
        self.docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
        self.size, self.percent, self.bands, self.rows, self.batch, self.miss = size, percent, bands, rows, batch, miss
        self.few, self.block = few, block
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    # -- signatures and classes ------------------------------------------------------------
    def signed(self) -> DataFrame:
        """(doc_id, n_shingles, class, buckets, signature) of each row; no class for empty sets."""
        size, bands, rows, a, b = self.size, self.bands, self.rows, self.a, self.b

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles = Shingles(size)
            salt = (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            for batch in small_batches(batches, "text", 1 << 20):
                sets = [shingles.codes(t) for t in batch.column("text").to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                cids: list[bytes | None] = [None] * len(sets)
                buckets: list[np.ndarray | None] = [None] * len(sets)
                marks: list[bytes | None] = [None] * len(sets)
                if full:
                    signature = sign([sets[i] for i in full], a, b)
                    wide = signature.reshape(len(full), bands, rows).astype(np.uint64)
                    with np.errstate(over="ignore"):
                        code = np.broadcast_to(salt, (len(full), bands)).copy()
                        for k in range(rows):
                            code = (code ^ wide[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
                            code ^= code >> np.uint64(29)
                    low = (signature & 255).astype(np.uint8)
                    for k, i in enumerate(full):
                        cids[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                        buckets[i] = code[k].view(np.int64)
                        marks[i] = low[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(cids, pa.binary()),
                     pa.array(buckets, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                    ["doc_id", "n_shingles", "cid", "buckets", "signature"])

        return self.docs.mapInArrow(work, f"doc_id long, {SIGNED}")

    def sets_of(self, cids: DataFrame, classes: DataFrame) -> DataFrame:
        """(cid, codes) of the given classes, from the text of the first row of each."""
        size = self.size

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles = Shingles(size)
            for batch in small_batches(batches, "text", 2 << 20):
                sets = [shingles.codes(t) for t in batch.column("text").to_pylist()]
                full = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in full], pa.binary()),
                     pa.array([s.view(np.int64) for s in full], pa.list_(pa.int64()))], ["cid", "codes"])

        wanted = classes.join(cids, "cid").select(F.col("first").alias("_first")).distinct()
        texts = self.docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
        found = texts.mapInArrow(work, "cid binary, codes array<bigint>").join(cids, "cid", "left_semi")
        return found.groupBy("cid").agg(F.any_value("codes").alias("codes"))

    # -- candidates ------------------------------------------------------------------------
    def close(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The pairs (a, b) that hold: signatures first, batch by batch, then full sets."""
        steps = list(range(self.batch, self.bands * self.rows + 1, self.batch))
        least = least_matches(steps, self.percent / 100, self.miss)
        width = self.bands * self.rows

        def alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.arange(batch.num_rows)
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, width)
                        for c in ("x", "y"))
                equal, at = np.zeros(batch.num_rows, np.int64), 0
                for n, m in zip(steps, least):
                    equal[stays] += (x[stays, at:n] == y[stays, at:n]).sum(axis=1)
                    stays, at = stays[equal[stays] >= m], n
                yield batch.select(["a", "b"]).take(pa.array(stays))

        marks = classes.select("cid", "signature")
        both = pairs.join(marks.withColumnsRenamed({"cid": "a", "signature": "x"}), "a").join(
            marks.withColumnsRenamed({"cid": "b", "signature": "y"}), "b")
        left = written(both.select("a", "b", "x", "y").mapInArrow(alive, "a binary, b binary"))
        cids = left.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        sets = written(self.sets_of(cids, classes))
        full = left.join(sets.withColumnsRenamed({"cid": "a", "codes": "p"}), "a").join(
            sets.withColumnsRenamed({"cid": "b", "codes": "q"}), "b")
        common = F.size(F.array_intersect("p", "q"))
        counted = full.select("a", "b", common.alias("c"), (F.size("p") + F.size("q")).alias("n"))
        return counted.filter(F.col("c").cast("long") * 100 >= (F.col("n") - F.col("c")) * self.percent).select("a", "b")

    def blocks(self, inside: DataFrame, classes: DataFrame) -> DataFrame:
        """The links (a, b) between components in the buckets given as (cid, comp, major).

        All buckets of one largest component are compared together: the classes outside it against
        all, in blocks of ``block`` by ``block``, each one task's work. Of the links of a class to a
        component, one is given.
        """
        size = self.block
        steps = list(range(self.batch, self.bands * self.rows + 1, self.batch))
        least, percent = least_matches(steps, self.percent / 100, self.miss), self.percent
        parts = written(inside.select("major", "cid", "comp").distinct())
        sizes = parts.groupBy("major").agg(F.count("*").alias("ny"), F.count_if(F.col("comp") != F.col("major")).alias("nx"))
        sizes = sizes.select("major", F.ceil(F.col("ny") / size).alias("yb"), F.ceil(F.col("nx") / size).alias("xb"))
        placed = parts.join(sizes, "major")
        dealt = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "cid"), F.col(n))
        ys = placed.select("major", "cid", "comp", F.lit(False).alias("asks"), dealt("yb", 1).alias("y"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.col("xb") - 1)).alias("x"))
        xs = placed.filter("comp != major").select("major", "cid", "comp", F.lit(True).alias("asks"), dealt("xb", 2).alias("x"),
                                                   F.explode(F.sequence(F.lit(0).cast("long"), F.col("yb") - 1)).alias("y"))
        sets = written(self.sets_of(parts.select("cid").distinct(), classes).join(classes.select("cid", "signature"), "cid"))
        rows = ys.unionByName(xs).join(sets, "cid").select("major", "x", "y", "cid", "comp", "asks", "signature", "codes")

        def compare(group: pa.Table) -> pa.Table:
            asks = group.column("asks").to_numpy(zero_copy_only=False)
            x, y = (group.filter(pa.array(m)) for m in (asks, ~asks))
            out = []
            if x.num_rows and y.num_rows:
                marks = np.frombuffer(b"".join(y.column("signature").to_pylist()), np.uint8).reshape(y.num_rows, -1)
                comps, cids = y.column("comp").to_pylist(), y.column("cid").to_pylist()
                codes = [np.asarray(v.values) for v in y.column("codes")]
                sizes = np.array([len(c) for c in codes])
                joined, owner = np.concatenate(codes), np.repeat(np.arange(len(codes)), sizes)
                order = np.argsort(joined, kind="stable")
                joined, owner = joined[order], owner[order]
                for a, comp, mark, mine in zip(x.column("cid").to_pylist(), x.column("comp").to_pylist(),
                                               x.column("signature").to_pylist(), x.column("codes")):
                    stays = np.array([i for i, c in enumerate(comps) if c != comp], np.int64)
                    mark, equal, at = np.frombuffer(mark, np.uint8), np.zeros(len(comps), np.int64), 0
                    for n, m in zip(steps, least):
                        equal[stays] += (marks[stays, at:n] == mark[at:n]).sum(axis=1)
                        stays, at = stays[equal[stays] >= m], n
                    if not len(stays):
                        continue
                    mine = np.sort(np.asarray(mine.values))
                    begin, end = np.searchsorted(joined, mine, "left"), np.searchsorted(joined, mine, "right")
                    hit = np.zeros(len(joined) + 1, np.int64)
                    np.add.at(hit, begin, 1)
                    np.add.at(hit, end, -1)
                    common = np.bincount(owner[np.cumsum(hit[:-1]) > 0], minlength=len(comps))[stays]
                    holds = stays[common * 100 >= (len(mine) + sizes[stays] - common) * percent]
                    chosen = {comps[i]: cids[i] for i in holds}
                    out += [(min(a, b), max(a, b)) for b in chosen.values()]
            return pa.table({"a": pa.array([p[0] for p in out], pa.binary()), "b": pa.array([p[1] for p in out], pa.binary())})

        return rows.groupBy("major", "x", "y").applyInArrow(compare, "a binary, b binary").distinct()

    @staticmethod
    def _component(members: DataFrame, found: DataFrame | None) -> DataFrame:
        if found is None:
            return members.withColumn("comp", F.col("cid"))
        return members.join(found, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))

    def components(self, classes: DataFrame) -> DataFrame:
        """(cid, comp) of the classes that are linked with others."""
        members = classes.select("cid", F.explode("buckets").alias("bucket"))
        shared = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
        members = written(members.join(shared, "bucket"))
        found: DataFrame | None = None
        before, turn = float("inf"), 0
        while True:
            now = self._component(members, found)
            sizes = now.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.min_by(
                "cid", F.xxhash64(F.lit(turn), "cid")).alias("cid"))
            spread = sizes.groupBy("bucket").agg(
                F.sum("n").alias("rows"), F.count("*").alias("comps"), F.sum(F.col("n") * F.col("n")).alias("same"),
                F.max_by("comp", F.struct("n", "comp")).alias("major"),
                F.min_by(F.struct("cid", "comp"), F.xxhash64(F.lit(turn), "cid")).alias("hub")).filter("comps > 1")
            spread = written(spread)
            total = spread.agg(F.sum("rows").alias("rows"),
                               F.sum((F.col("rows") * F.col("rows") - F.col("same")) / 2).alias("pairs")).first()
            rows, left = total["rows"] or 0, total["pairs"] or 0
            if not left:
                break
            last = turn > 0 and (left <= rows or left > 0.5 * before)
            if last:
                few = spread.filter(F.col("rows") <= self.few).select("bucket", "major")
                inside = now.join(few, "bucket")
                minor = inside.filter("comp != major").select("bucket", F.col("cid").alias("a"), F.col("comp").alias("comp_a"))
                pairs = minor.join(inside.select("bucket", F.col("cid").alias("b"), F.col("comp").alias("comp_b")), "bucket")
                pairs = pairs.filter("a != b AND comp_a != comp_b").select(
                    F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                many = spread.filter(F.col("rows") > self.few).select("bucket", "major")
                links = self.close(pairs.distinct(), classes).unionByName(self.blocks(now.join(many, "bucket"), classes))
            else:
                pairs = now.join(spread.select("bucket", F.col("hub.cid").alias("b"), F.col("hub.comp").alias("comp_b")), "bucket")
                pairs = pairs.filter("comp != comp_b").select(
                    F.least("cid", "b").alias("a"), F.greatest("cid", "b").alias("b"))
                links = self.close(pairs.distinct(), classes)
            found = merged(found, written(links))
            before, turn = left, turn + 1
            if last:
                break
        return found if found is not None else members.select("cid", F.col("cid").alias("comp")).limit(0)

    def result(self) -> DataFrame:
        """(doc_id, n_shingles, cid, component_id, lead) for each row.

        ``component_id`` is the smallest id of the component; ``lead`` is true for the rows of the one
        class that stands for the component.
        """
        signed = written(self.signed())
        classes = written(signed.filter("cid IS NOT NULL").groupBy("cid").agg(
            F.min("doc_id").alias("first"), F.any_value("buckets").alias("buckets"), F.any_value("signature").alias("signature")))
        comp = self._component(classes.select("cid", "first"), self.components(classes))
        names = comp.groupBy("comp").agg(
            F.min("first").alias("component_id"),
            F.min_by("cid", F.struct(F.col("first").isNull(), "first", "cid")).alias("lead_cid"))
        named = written(comp.join(names, "comp").select("cid", "component_id", (F.col("cid") == F.col("lead_cid")).alias("lead")))
        rows = signed.select("doc_id", "n_shingles", "cid")
        empty = rows.filter("cid IS NULL").select("*", F.col("doc_id").alias("component_id"), F.lit(True).alias("lead"))
        return rows.filter("cid IS NOT NULL").join(named, "cid").select(
            "doc_id", "n_shingles", "cid", "component_id", "lead").unionByName(empty)


def merged(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """(cid, comp): components of ``found`` joined along ``links`` (a, b); a component is named by
    its smallest member. Smallest labels travel along links, and labels of labels are taken."""
    if found is not None:
        ends = links
        for end in ("a", "b"):
            ends = ends.join(found.withColumnsRenamed({"cid": end, "comp": f"comp_{end}"}), end, "left").withColumn(
                end, F.coalesce(f"comp_{end}", end)).drop(f"comp_{end}")
        links = ends.filter("a != b").distinct()
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = edges.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        step = written(lower.join(up, "label").select("node", F.least("label", "above").alias("label"), "was"))
        moved = step.filter("label != was").limit(1).count()
        labels = step.select("node", "label")
        if not moved:
            break
    new = labels.select(F.col("node").alias("cid"), F.col("label").alias("comp"))
    if found is None:
        return new
    # What had a component before takes the new name of that component.
    renamed = found.join(new.select(F.col("cid").alias("comp"), F.col("comp").alias("to")), "comp", "left").select(
        "cid", F.coalesce("to", "comp").alias("comp"))
    return written(renamed.unionByName(new.join(found, "cid", "left_anti").select("cid", "comp")))


def kept_documents(docs: DataFrame, near: NearDuplicates) -> DataFrame:
    """docs with one row of each component and every row without words, all columns as they are.

    Rows are found again by their id. Where an id stands on several rows, these rows alone are
    told apart by their sets, and of equal ones any is kept.
    """
    rows = near.result()
    key, lead, cid, row = (unused(docs, c) for c in ("_id", "_lead", "_cid", "_row"))
    ids = written(rows.groupBy(F.col("doc_id").alias(key)).agg(
        F.count("*").alias("n"), F.max(F.col("lead") & F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")))
    one, more = ids.filter("n = 1 AND stays").select(key), ids.filter("n > 1").select(key)
    once = docs.join(one, docs["doc_id"].eqNullSafe(one[key]), "left_semi")
    if not more.limit(1).count():
        return once
    size = near.size

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch in small_batches(batches, "text", 2 << 20):
            sets = [shingles.codes(t) for t in batch.column("text").to_pylist()]
            cids = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, cids], [*batch.schema.names, cid])

    several = docs.join(more, docs["doc_id"].eqNullSafe(more[key]), "left_semi")
    several = several.mapInArrow(marked, T.StructType([*docs.schema.fields, T.StructField(cid, T.BinaryType())]))
    leads = rows.filter(F.col("lead") & F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("cid").isNotNull()).select(
        F.col("doc_id").alias(key), F.col("cid").alias(lead)).distinct()
    chosen = several.join(leads, several["doc_id"].eqNullSafe(leads[key]) & (several[cid] == leads[lead]), "left_semi")
    chosen = chosen.groupBy("doc_id", cid).agg(F.any_value(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
    return once.unionByName(chosen).unionByName(several.filter(F.col(cid).isNull()).drop(cid))
