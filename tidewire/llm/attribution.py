"""Operator 6: token counts by section, from one encoding of the whole document.

A document is encoded once; each token keeps the span of characters it covers, and spans are
joined to sections by interval inside the task that read the document. A token that crosses a
boundary goes where ``rule`` says: ``"start"``: to the section that holds its first character;
``"most"``: to the section that holds most of its characters, the earlier one on a tie.

Defined cases: a null or empty text has one section without tokens where sections are lines, and
no rows where they come from a column that is null or empty; sections may be empty (0 tokens);
where sections overlap, the one that begins last holds the character; tokens outside all
sections count under section -1, a row given only if there are any; repeated rows are counted
each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidewire.llm.bytebpe import ByteCoder
from tidewire.llm.common import file_bytes, small_batches

COUNTS = "section int, n_chars int, n_tokens int, n_crossing int"


def line_sections(text: str) -> list[tuple[int, int]]:
    """Each line with its line end, as (begin, end) in characters."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"] if "\n" in text else []
    bounds = [0, *ends, len(text)]
    return list(zip(bounds, bounds[1:]))


def character_spans(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token, and the one after its last, from the bytes it covers."""
    ends = np.cumsum(sizes, dtype=np.int64)
    begins = ends - sizes
    if text.isascii():
        return begins, ends
    leads = np.frombuffer(text.encode("utf-8", "replace"), np.uint8) & 0xC0 != 0x80
    upto = np.concatenate([[0], np.cumsum(leads)])  # characters begun before each byte
    return upto[begins + 1] - 1, upto[ends]


def allocate(begins: np.ndarray, ends: np.ndarray, sections: list[tuple[int, int]], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token (-1: none), and whether it crosses a boundary."""
    order = sorted(range(len(sections)), key=lambda i: (sections[i], i))
    if not order:
        return np.full(len(begins), -1), np.zeros(len(begins), bool)
    starts = np.array([sections[i][0] for i in order])
    stops = np.array([sections[i][1] for i in order])
    names = np.array(order)

    def holder(points: np.ndarray) -> np.ndarray:
        at = np.searchsorted(starts, points, "right") - 1
        out = np.full(len(points), -1)
        pending = np.arange(len(points))
        while len(pending):  # a section that ended earlier gives way to one that began before it
            pending = pending[at[pending] >= 0]
            inside = points[pending] < stops[at[pending]]
            out[pending[inside]] = names[at[pending[inside]]]
            pending = pending[~inside]
            at[pending] -= 1
        return out

    first = holder(begins)
    crossing = np.zeros(len(begins), bool)
    bounds = np.unique(np.concatenate([starts, stops]))
    inside = np.searchsorted(bounds, begins, "right") != np.searchsorted(bounds, np.maximum(ends - 1, begins), "right")
    for i in np.flatnonzero(inside):
        held = holder(np.arange(begins[i], ends[i]))
        crossing[i] = (held != held[0]).any()
        if rule == "most":
            values, at, n = np.unique(held, return_index=True, return_counts=True)
            first[i] = values[np.lexsort((at, -n))[0]]
    return first, crossing


def attributed(
    docs: DataFrame, ranks: str, sections: str | Callable[[str], list[tuple[int, int]]] = line_sections,
    rule: str = "start", key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, section, n_chars, n_tokens, n_crossing) for each section of each document.

    ``sections`` is a function of the text, or a column array<struct<begin int, end int>> of
    character spans; a section is named by its place there.
    """
    if rule not in ("start", "most"):
        raise ValueError(f"unknown rule: {rule}")
    data = file_bytes(ranks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteCoder(data)
        for batch in small_batches(batches, "text", 2 << 20):
            texts = batch.column("text").to_pylist()
            given = batch.column("spans").to_pylist() if "spans" in batch.schema.names else None
            rows, parts = [], []
            for i, body in enumerate(texts):
                body = body or ""
                spans = sections(body) if given is None else [
                    (s["begin"] or 0, s["end"] or 0) for s in given[i] or [] if s is not None]
                if not spans and given is not None and not given[i]:
                    continue
                begins, ends = character_spans(body, coder.sizes[coder.encode(body)])
                where, crossing = allocate(begins, ends, spans, rule)
                n = np.bincount(where + 1, minlength=len(spans) + 1)
                x = np.bincount(where + 1, crossing, minlength=len(spans) + 1).astype(np.int64)
                low = 0 if n[0] else 1
                names = np.arange(low - 1, len(spans))
                chars = np.array([0, *(max(0, min(b, len(body)) - max(a, 0)) for a, b in spans)])
                rows.append(np.full(len(names), i))
                parts.append(np.stack([names, chars[low:], n[low:], x[low:]]))
            if rows:
                owner = pa.array(np.concatenate(rows))
                table = np.concatenate(parts, axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(owner), *(pa.array(c) for c in table)],
                    ["key", *(c.split()[0] for c in COUNTS.split(", "))])

    spans = [F.col(sections).alias("spans")] if isinstance(sections, str) else []
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *spans)
    schema = T.StructType([source.schema["key"], *T.StructType.fromDDL(COUNTS).fields])
    return source.mapInArrow(count, schema).withColumnRenamed("key", key)
