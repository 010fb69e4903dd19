"""Operator 3: token ids packed into fixed rows by best-fit decreasing.

Each document is encoded whole; a document longer than a row is cut into row-long segments, so
no token is lost. Segments are packed longest first into the open row with the least room that
still holds them; a segment tree over remaining room finds that row in log2(row) steps.

Packing works on groups of documents of a task, each of a bounded number of tokens
(``group_tokens``): memory does not depend on the data, nothing is shuffled, and a lost task is
redone alone. Only the rows left open at the end of a group lose room.

Defined cases: null and empty texts have no tokens and take no room; a row's unused end holds
``pad_id``; repeated rows are packed each; a null doc_id is kept as null; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.bytebpe import ByteCoder
from tidewire.llm.common import file_bytes, small_batches


class Room:
    """Open rows by remaining room, under a segment tree of how many rows have which room."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, by: int) -> None:
        at = self.base + room
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, room) of the row with the least room of at least ``need``; it is taken out."""
        at = self.base + need
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.base:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.base
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: list[int], row: int) -> list[list[int]]:
    """Indexes of ``lengths`` (1 to ``row``) for each packed row, best-fit decreasing."""
    rows: list[list[int]] = []
    room = Room(row)
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = room.take(lengths[i])
        if found is None:
            rows.append([])
            found = len(rows) - 1, row
        at, left = found
        rows[at].append(i)
        if left > lengths[i]:
            room.put(left - lengths[i], at)
    return rows


ROWS = ("pack_id long, n_tokens int, n_segments int, doc_ids array<bigint>, doc_offsets array<int>, "
        "cu_seqlens array<int>, ids binary, positions binary")


def packed(
    docs: DataFrame, ranks: str, row: int = 2048, pad_id: int = 50256, group_tokens: int = 4 << 20,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One line per packed row of ``row`` tokens.

    ``ids`` is the row of the id matrix (little-endian, 16 bits an id, 32 if an id needs them),
    ``positions`` the row of positions that start again at 0 with each segment, ``cu_seqlens`` the
    cumulative segment lengths from 0, and ``doc_ids`` and ``doc_offsets`` say where each segment
    comes from: the document, and its first token there.
    """
    data = file_bytes(ranks)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteCoder(data)
        kind = "<u2" if max(coder.most, pad_id) < 1 << 16 else "<u4"
        place = "<u2" if row <= 1 << 16 else "<u4"
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        made = 0
        segments: list[tuple[object, int, np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            out = []
            for chosen in best_fit([len(s[2]) for s in segments], row):
                parts = [segments[i] for i in chosen]
                sizes = [len(s[2]) for s in parts]
                ids = np.full(row, pad_id, kind)
                ids[:sum(sizes)] = np.concatenate([s[2] for s in parts])
                places = np.zeros(row, place)
                places[:sum(sizes)] = np.concatenate([np.arange(n, dtype=place) for n in sizes])
                out.append((base + made, sum(sizes), len(parts), [s[0] for s in parts], [s[1] for s in parts],
                            np.cumsum([0, *sizes]).tolist(), ids.tobytes(), places.tobytes()))
                made += 1
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()),
                     pa.list_(pa.int32()), pa.binary(), pa.binary()]
            names = [c.split()[0] for c in ROWS.split(", ")]
            for at in range(0, len(out), 512):
                columns = zip(*out[at:at + 512])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in small_batches(batches, "text"):
            for name, body in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                ids = coder.encode(body).astype(kind)
                segments += [(name, at, ids[at:at + row]) for at in range(0, len(ids), row)]
                held += len(ids)
                if held >= group_tokens:
                    yield from flush()
                    segments, held = [], 0
        if segments:
            yield from flush()

    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return source.mapInArrow(pack, ROWS)
