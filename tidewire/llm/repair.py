"""Operator 12: repair of conversation structure by lightest derivations.

Rows are damaged by a checksum of their keys, put in order and marked with their faults. The edits
Keep, Rerole, Delete and Insert then turn each conversation into one whose role initials read
``(s?(ua)+)?``, at the least cost and, among those, with the least string of edit initials.

Edits are deductions over items (rows used up, state of the pattern). An agenda pops the item of
the least (cost, audit) first, as a best-first search of lightest derivations does, until the goal
item is final. Every rule adds a cost and appends letters, so it never makes an item lighter and
keeps their order. Two audits of one item never are a prefix of each other at equal cost: what one
has more could only be insertions, which cost. An edit's letter and the state give the next state, so an audit stands
for one repair.

No conversation is gathered. A range sort by (conversation, turn) numbers all rows, and every
``CHUNK`` numbers are a chunk. A conversation inside a chunk is derived there to its goal. Where a
chunk cuts one, each part is derived from every state it may begin in to every state it may end
in; its derivations are then edges (cost, place in the order of audits) of the level above, where
up to ``FAN`` parts are joined by the same agenda, and so on until one part is left. The chosen
states are handed down again by joins. Insertions stand before the row that follows them, so that
equal costs are settled inside one part. Only the digest of a repaired conversation needs its rows
in one place: they stream through a task in order, none is held.

Defined cases: null columns count as one space, in keys, roles and texts; rows with a null
conversation are one conversation, returned as null; null turns come first; rows of equal turn
are in the order of role and text; an empty role has no initial, so it can't be kept; repeated
rows are faults (duplicate); conversations whose rows are all dropped have zeros, no audit and the
hash of nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewire.llm.common import written

CHUNK, FAN = 256, 64
BLANKS = " \t\n\x0b\f\r"

# States of the pattern: nothing yet, after s, after u, after a; the goal stands after the end.
START, SYSTEM, USER, ASSISTANT, GOAL = range(5)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what a new role leads to
ENDINGS = {START: (0, ""), SYSTEM: (6, "II"), USER: (3, "I"), ASSISTANT: (0, "")}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = frozenset(["su", "ua", "au"])

Edges = Iterable[tuple[int, object, int, int]]


def damaged(rows: DataFrame) -> DataFrame:
    """(cid, conv_id, turn, role, text): rows dropped, emptied, stripped, repeated or given a role."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    source = rows.select(key_of(F.col("conv_id")).alias("cid"), "turn", plain("role").alias("role"), plain("text").alias("text"),
                         kind.alias("kind"))
    return source.filter("kind <> 0").select(
        "cid", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def key_of(conv: Column) -> Column:
    """A key that tells null from every other conversation."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def in_order(rows: DataFrame) -> DataFrame:
    """rows (cid, turn, role, text) with ``seq``, their place in the order of the whole table.

    Ranges are drawn by the first letters of texts, so that samples stay small and a turn or
    conversation of any size is spread; rows of one range are sorted by whole texts.
    """
    start = F.substring("text", 1, 48)
    spread = rows.repartitionByRange("cid", F.asc_nulls_first("turn"), "role", start)
    return written(spread.sortWithinPartitions("cid", F.asc_nulls_first("turn"), "role", "text").withColumn(
        "seq", F.monotonically_increasing_id()))


def with_faults(rows: DataFrame) -> DataFrame:
    """(cid, seq, turn, initial, fault) of ordered rows; the fault is empty where there is none."""
    seen = rows.groupBy("cid", "role", F.xxhash64("text").alias("h"), F.hash("text", F.lit(7)).alias("g")).agg(
        F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    marks = rows.select("cid", "seq", "turn", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"),
                        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    return marks.join(seen, "seq", "left").select(
        "cid", "seq", "turn", "initial", F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(
            F.col("cut"), "truncated").otherwise("").alias("fault"))


def lightest(start: tuple[int, int], goals: int, edges: Callable[[int, int], Edges], empty) -> dict[tuple[int, int], tuple]:
    """Final items with their (cost, audit): the agenda over items (place, state).

    ``edges`` of an item are (cost, what the audit gains, place, state). It ends once ``goals``
    items of the state GOAL are final, or no item is left.
    """
    agenda = [(0, empty, *start)]
    final: dict[tuple[int, int], tuple] = {}
    while agenda and goals:
        cost, audit, place, state = heappop(agenda)
        if (place, state) in final:
            continue
        final[place, state] = cost, audit
        goals -= state == GOAL
        for more, gain, to, then in edges(place, state):
            if (to, then) not in final:
                heappush(agenda, (cost + more, audit + gain, to, then))
    return final


def edits(rows: list[tuple[str, str]], closed: bool) -> Callable[[int, int], Edges]:
    """The edits of rows (initial, fault); ``closed`` where the conversation ends with them."""
    def at(place: int, state: int) -> Edges:
        if place == len(rows):
            if closed and state != GOAL:
                cost, letters = ENDINGS[state]
                yield cost, letters, place, GOAL
            return
        initial, fault = rows[place]
        yield 3, "I", place, NEXT[state]
        yield 4, "D", place + 1, state
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "truncated" else 0
            yield 3 + more, "R", place + 1, NEXT[state]
            kept = KEPT.get((state, initial))
            if kept is not None:
                yield more, "K", place + 1, kept

    return at


def derived(rows: list[tuple[str, str]], begins: bool, ends: bool) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit): the lightest derivations of a part of a conversation; from the start
    only if it ``begins`` here, to the goal only if it ``ends`` here."""
    out = []
    for state in (START,) if begins else (START, SYSTEM, USER, ASSISTANT):
        final = lightest((0, state), 1 if ends else 5, edits(rows, ends), "")
        out += [(state, to, cost, audit) for (place, to), (cost, audit) in final.items()
                if place == len(rows) and (to == GOAL) == ends]
    return out


PART = ("cid string, chunk bigint, first_seq bigint, illegal bigint, initials array<string>, "
        "edges array<struct<p: int, q: int, cost: bigint, audit: string>>, shut boolean")


def parts(rows: DataFrame) -> DataFrame:
    """The derivations of every part of a conversation inside one chunk, ``shut`` if it is whole."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list] = {}  # shapes of short conversations come again and again

        def part(chunk: int, run: list, begins: bool, ends: bool) -> dict:
            shape = tuple((initial, fault) for _, _, initial, fault in run)
            key = (shape, begins, ends)
            found = known.get(key)
            if found is None:
                found = [dict(zip("pq", e[:2]), cost=e[2], audit=e[3]) for e in derived(list(shape), begins, ends)]
                if len(shape) <= 24:
                    if len(known) >= 50_000:
                        known.clear()
                    known[key] = found
            illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(shape, shape[1:]))
            return {"cid": run[0][0], "chunk": chunk, "first_seq": run[0][1], "illegal": illegal,
                    "initials": [initial for initial, _ in shape], "edges": found, "shut": begins and ends}

        def runs(rows_: Iterator[tuple]) -> Iterator[dict]:
            chunk, run, begins = None, [], False
            for row in rows_:
                here = row[1] // CHUNK
                if here != chunk or row[0] != run[0][0]:
                    if run:
                        yield part(chunk, run, begins, here == chunk)
                    begins = here == chunk
                    chunk, run = here, []
                run.append(row)
            if run:
                yield part(chunk, run, begins, False)

        flat = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("cid", "seq", "initial", "fault"))))
        out: list[dict] = []
        for found in runs(flat):
            out.append(found)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=shape_of)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=shape_of)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape_of = to_arrow_schema(StructType.fromDDL(PART))
    ordered = rows.select("cid", "seq", "initial", "fault").repartition(F.expr(f"seq div {CHUNK}")).sortWithinPartitions("seq")
    return ordered.mapInArrow(work, PART)


NODE = "cid string, place bigint, edges array<struct<p: int, q: int, cost: bigint, rank: int, way: array<int>>>"


def _ranked(found: list[tuple[int, int, int, object, list[int]]]) -> list[dict]:
    """Edges with the place of their audit among those that begin in the same state."""
    out = []
    for state in sorted({f[0] for f in found}):
        same = sorted((f for f in found if f[0] == state), key=lambda f: f[3])
        out += [{"p": p, "q": q, "cost": cost, "rank": i, "way": way} for i, (p, q, cost, _, way) in enumerate(same)]
    return out


def joined(nodes: DataFrame) -> DataFrame:
    """Up to FAN neighbouring parts as one part of the level above."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                below = [n["edges"] for n in sorted(row["n"], key=lambda n: n["place"])]
                found = []
                for state in {e["p"] for e in below[0]}:
                    def at(place: int, now: int) -> Edges:
                        if place < len(below):
                            for e in below[place]:
                                if e["p"] == now:
                                    yield e["cost"], ((e["rank"], e["q"]),), place + 1, e["q"]

                    final = lightest((0, state), 5, at, ())
                    found += [(state, to, cost, [r for r, _ in audit], [state, *(q for _, q in audit)])
                              for (place, to), (cost, audit) in final.items() if place == len(below)]
                out.append({"cid": row["cid"], "place": row["place"], "edges": _ranked(found)})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=shape_of)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape_of = to_arrow_schema(StructType.fromDDL(NODE))
    thin = F.struct("place", F.transform("edges", lambda e: F.struct(e["p"].alias("p"), e["q"].alias("q"), e["cost"].alias("cost"), e["rank"].alias("rank"))).alias("edges"))
    groups = nodes.groupBy("cid", F.expr(f"place div {FAN}").alias("place")).agg(F.collect_list(thin).alias("n"))
    return groups.mapInArrow(work, NODE)


def settled(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For the parts of cut conversations: which (p, q) each takes, as (cid, chunk, p, q), and the
    (cid, cost, q) of whole conversations, without what their end adds."""
    rank = F.expr("transform(edges, e -> named_struct('p', e.p, 'q', e.q, 'cost', e.cost, "
                  "'rank', size(filter(edges, f -> f.p = e.p AND f.audit < e.audit)), 'way', array(e.p, e.q)))")
    place = F.row_number().over(W.partitionBy("cid").orderBy("chunk")) - 1
    leaves = written(cut.select("cid", place.cast("long").alias("place"), "chunk", rank.alias("edges")))
    levels = [leaves.drop("chunk")]
    while levels[-1].filter("place > 0").limit(1).count():
        levels.append(written(joined(levels[-1])))
    ending = F.when(F.col("e.q") == SYSTEM, 6).when(F.col("e.q") == USER, 3).otherwise(0)
    top = levels[-1].select("cid", F.explode(F.filter("edges", lambda e: e["p"] == START)).alias("e"))
    best = top.groupBy("cid").agg(F.min_by("e", F.struct(F.col("e.cost") + ending, "e.rank")).alias("e"))
    best = written(best.select("cid", F.lit(0).cast("long").alias("place"), "e.p", "e.q", "e.cost"))
    chosen = best.select("cid", "place", "p", "q")
    for level in reversed(levels[1:]):
        path = F.expr("filter(edges, e -> e.p = p AND e.q = q)[0].way").alias("way")
        steps = chosen.join(level, ["cid", "place"]).select("cid", "place", path)
        chosen = steps.select("cid", "place", "way", F.posexplode(F.slice("way", F.lit(2), F.size("way") - 1)).alias("i", "to")).select(
            "cid", (F.col("place") * FAN + F.col("i")).alias("place"), F.get("way", F.col("i")).alias("p"), F.col("to").alias("q"))
    return chosen.join(leaves.select("cid", "place", "chunk"), ["cid", "place"]).select("cid", "chunk", "p", "q"), best.select("cid", "cost", "q")


def row_edits(chosen: DataFrame) -> DataFrame:
    """(cid, seq, letters, lead, role, stays) from chosen parts (cid, first_seq, initials, p, audit): the letters of
    each row, the roles inserted before it, a new role, and whether it stays. Letters of no row
    have the greatest seq."""
    shape = "cid string, seq bigint, letters string, lead array<string>, role string, stays boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cid, seq, state, audit, initials in zip(*(batch.column(c).to_pylist() for c in ("cid", "first_seq", "p", "audit", "initials"))):
                letters, lead, row = "", [], 0
                for letter in audit:
                    letters += letter
                    if letter == "I":
                        state = NEXT[state]
                        lead.append(ROLES[state])
                        continue
                    if letter == "R":
                        state = NEXT[state]
                    elif letter == "K":
                        state = KEPT[state, initials[row]]
                    out.append((cid, seq + row, letters, lead, ROLES[state] if letter == "R" else None, letter != "D"))
                    letters, lead, row = "", [], row + 1
                if letters:
                    out.append((cid, (1 << 63) - 1, letters, lead, None, False))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    names = ["cid", "seq", "letters", "lead", "role", "stays"]
    types = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_()]
    return chosen.mapInArrow(work, shape)


def repaired_rows(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows and their edits together, each edit before its row, in order inside a conversation."""
    null = lambda kind: F.lit(None).cast(kind)
    both = rows.select("cid", "seq", F.lit(1).alias("kind"), null("string").alias("letters"), null("array<string>").alias("lead"),
                       "role", null("boolean").alias("stays"), "text").unionByName(
        changes.select("cid", "seq", F.lit(0).alias("kind"), "letters", "lead", "role", "stays", null("string").alias("text")))
    return both.repartition("cid").sortWithinPartitions("cid", "seq", "kind")


def digests(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """(cid, audit, repaired_sha256): rows stream through, a hash and the letters are all that is held."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, audit, lines, edit, out = None, hashlib.sha256(), [], 0, None, []

        def add(line: str) -> None:
            nonlocal lines
            state.update(("\n" if lines else "").encode() + line.encode())
            lines += 1

        columns = ("cid", "kind", "letters", "lead", "role", "stays", "text")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for cid, kind, letters, lead, role, stays, text in zip(*(piece.column(c).to_pylist() for c in columns)):
                    if cid != now:
                        if now is not None:
                            out.append((now, "".join(audit), state.hexdigest()))
                        now, state, audit, lines = cid, hashlib.sha256(), [], 0
                    if kind == 0:
                        edit = role, stays
                        audit.append(letters)
                        for inserted in lead:
                            add(f"{inserted}:")
                    elif edit[1]:
                        add(f"{edit[0] or role}:{text}")
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names)
                out = []
        if now is not None:
            out.append((now, "".join(audit), state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names)

    names = ["cid", "audit", "repaired_sha256"]
    return repaired_rows(rows, changes).mapInArrow(work, "cid string, audit string, repaired_sha256 string")


class Repair:
    """Damages and repairs conversations (conv_id, turn, role, text); every table is written."""

    def __init__(self, rows: DataFrame):
        self.convs = rows.select("conv_id", key_of(F.col("conv_id")).alias("cid")).groupBy("cid").agg(F.first("conv_id").alias("conv_id"))
        self.rows = in_order(damaged(rows))
        self.marks = written(with_faults(self.rows))
        self.parts = written(parts(self.marks))
        cut = self.parts.filter("NOT shut")
        taken, self.whole = settled(cut)
        edge = F.expr("filter(edges, e -> e.p = p AND e.q = q)[0].audit")
        # What the end of a cut conversation adds stands on its last part.
        ends = cut.groupBy("cid").agg(F.max("chunk").alias("chunk")).join(self.whole, "cid").select(
            "cid", "chunk", F.when(F.col("q") == SYSTEM, "II").when(F.col("q") == USER, "I").otherwise("").alias("tail"))
        pieces = cut.join(taken, ["cid", "chunk"]).join(ends, ["cid", "chunk"], "left").select(
            "cid", "first_seq", "initials", "p", F.concat(edge, F.coalesce("tail", F.lit(""))).alias("audit"))
        own = self.parts.filter("shut").select(
            "cid", "first_seq", "initials", F.lit(START).alias("p"), F.col("edges")[0]["audit"].alias("audit"))
        self.edits = written(row_edits(pieces.unionByName(own)))

    def result(self) -> DataFrame:
        """One row a conversation: faults, cost, audit and the hash of the repaired rows."""
        ending = F.when(F.col("q") == SYSTEM, 6).when(F.col("q") == USER, 3).otherwise(0)
        costs = self.whole.select("cid", (F.col("cost") + ending).alias("cost")).unionByName(
            self.parts.filter("shut").select("cid", F.col("edges")[0]["cost"].alias("cost")))
        span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
        counts = self.marks.groupBy("cid").agg(
            F.coalesce(span, F.lit(0)).cast("long").alias("gaps"),
            *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")))
        seams = self.parts.filter("NOT shut").withColumn("before", F.lag(
            F.element_at("initials", -1)).over(W.partitionBy("cid").orderBy("chunk")))
        bad = F.when(F.col("before").isNotNull() & ~F.concat("before", F.col("initials")[0]).isin(*sorted(LEGAL)), 1).otherwise(0)
        illegal = self.parts.filter("shut").select("cid", "illegal").unionByName(
            seams.select("cid", (F.col("illegal") + bad).alias("illegal"))).groupBy("cid").agg(F.sum("illegal").alias("illegal"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return self.convs.join(counts, "cid", "left").join(illegal, "cid", "left").join(costs, "cid", "left").join(
            digests(self.rows, self.edits), "cid", "left").select(
            "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
            F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the repaired conversations, in order by (conv_id, place)."""
    fixed = Repair(rows)
    kept = fixed.edits.join(fixed.rows.select("seq", "turn", F.col("role").alias("own"), "text"), "seq", "left")
    added = kept.select("cid", "seq", F.posexplode("lead").alias("i", "role")).select(
        "cid", "seq", "i", F.lit(None).cast("long").alias("turn"), "role", F.lit("").alias("text"))
    own = kept.filter("stays").select("cid", "seq", F.lit(1 << 30).alias("i"), F.col("turn").cast("long").alias("turn"),
                                      F.coalesce("role", "own").alias("role"), "text")
    order = F.struct("seq", "i").alias("place")
    return added.unionByName(own).join(fixed.convs, "cid").select("conv_id", order, "turn", "role", "text")
