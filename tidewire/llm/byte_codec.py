"""Operator 13: byte-level BPE encoding with offsets, and decoding, over Arrow batches.

The tokenizers library encodes whole texts from its vocabulary file. That file spells bytes as
characters: printable Latin-1 bytes stand for themselves, the others for characters from U+0100 on.
Decoding reverses this table: an id gives back its bytes, and the bytes of neighbouring ids are put
together before they are read as UTF-8, so a character split over several ids comes back whole.

Offsets count characters of the text: the bytes that the ids before stand for are mapped to the
characters they are of. Ids that share a split character share its place: the span of each holds the
whole character, as the library's own offsets do, which cost a third more time.

Texts are encoded where they are read; nothing is shuffled. A text is cut where white space follows a
visible character: no match of the splitting pattern crosses such a place, so the ids stay the same.
The library encodes the parts of a batch that are new; a bounded cache remembers the ids of the
others, as most words come again.

Defined cases: a null or empty text has no ids and decodes to no bytes; strings of special tokens are
ordinary text; a text of any length is encoded whole, runs of white space too; repeated rows give
repeated rows; an empty table gives an empty one; other columns are not read. Decoding null ids gives
no bytes, unknown ids raise an error, and bytes that form no character show as U+FFFD in ``text``.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidewire.llm.common import file_bytes, small_batches

# White space as the splitting pattern has it, before a visible run or at the end.
_BLANKS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PARTS, _GAPS = re.compile(f"[{_BLANKS}]*[^{_BLANKS}]+|[{_BLANKS}]+"), re.compile(f"[{_BLANKS}]")
CACHED, LONGEST = 200_000, 48  # parts in the cache, and characters of one


def byte_table() -> dict[str, int]:
    """What byte each character of a vocabulary file stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteCodec:
    """Encodes and decodes by one vocabulary file of the tokenizers library."""

    def __init__(self, vocabulary: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel part
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_str(vocabulary.decode())
        self.coder.encode_special_tokens = True
        special = {t["id"] for t in json.loads(vocabulary).get("added_tokens", [])}
        table = byte_table()
        spelt: dict[int, bytes] = {}
        for token, i in self.coder.get_vocab(with_added_tokens=True).items():
            spelt[i] = token.encode() if i in special else bytes(map(table.__getitem__, token))
        self.spelt: list[bytes | None] = [spelt.get(i) for i in range(max(spelt) + 1)]
        self.cache: dict[str, bytes] = {}
        self.sizes = np.array([len(b or b"") for b in self.spelt], np.int64)  # bytes that an id stands for

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, spans) of each text; spans has a row of begin and end for each id."""
        parts = [_PARTS.findall(t) if t else [] for t in texts]
        found = [list(map(self.cache.get, ps)) for ps in parts]
        new = {p for ps, got in zip(parts, found) if None in got for p, b in zip(ps, got) if b is None}
        fresh = self._encoded_parts(list(new))
        out = []
        for text, ps, got in zip(texts, parts, found):
            if None in got:
                got = [fresh[p] if b is None else b for p, b in zip(ps, got)]
            ids = np.frombuffer(b"".join(got), "<u4").astype(np.int32)
            out.append((ids, self.spans(text or "", ids)))
        if len(self.cache) + len(fresh) > CACHED:
            self.cache.clear()
        self.cache.update((p, b) for p, b in fresh.items() if len(p) <= LONGEST)
        return out

    def _encoded_parts(self, parts: list[str]) -> dict[str, bytes]:
        """The packed ids of parts. Those that begin with white space and end in a visible character
        are encoded as one text, as it is cut between them, and taken apart by their bytes."""
        inner = [p for p in parts if _GAPS.match(p) and not _GAPS.match(p[-1])]
        chosen = set(inner)
        alone = [p for p in parts if p not in chosen]
        out = {p: np.array(e.ids, "<u4").tobytes() for p, e in zip(alone, self.coder.encode_batch_fast(alone, add_special_tokens=False))}
        for at in range(0, len(inner), 50_000):
            some = inner[at:at + 50_000]
            ids = np.array(self.coder.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(p.encode()) for p in some])) + 1
            packed, begin = ids.tobytes(), 0
            for p, end in zip(some, (4 * ends).tolist()):
                out[p] = packed[begin:end]
                begin = end
        return out

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Begin and end of each id in characters: the bytes before it, mapped to the characters they are of."""
        if not len(ids):
            return np.empty((0, 2), np.int32)
        source = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((source & 0xC0) != 0x80, dtype=np.int32) - 1  # of each byte
        ends = np.cumsum(self.sizes[ids])
        return np.stack([char[ends - self.sizes[ids]], char[ends - 1] + 1], 1)

    def decode(self, ids: list[int]) -> bytes:
        if ids and min(ids) < 0:
            raise ValueError(f"no such id: {min(ids)}")
        return b"".join(map(self.spelt.__getitem__, ids))


def encoded(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", back: bool = False) -> DataFrame:
    """(key, ids, begins, ends): the ids of each whole text and their spans in its characters.

    With ``back``, also ``raw``: the bytes the ids decode to, and ``packed``: the ids as little-endian
    unsigned 32-bit integers, in the same pass.
    """
    data = file_bytes(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteCodec(data)
        for batch in small_batches(batches, "text", 1 << 20):
            got = codec.encode(batch.column("text").to_pylist())
            bounds = np.cumsum([0, *(len(ids) for ids, _ in got)], dtype=np.int32)
            ids = np.concatenate([g[0] for g in got])
            spans = np.concatenate([g[1] for g in got])
            columns = [pa.ListArray.from_arrays(bounds, pa.array(c)) for c in (ids, spans[:, 0], spans[:, 1])]
            if back:
                columns += [pa.array([codec.decode(i.tolist()) for i, _ in got], pa.binary()),
                            pa.array([i.astype("<u4").tobytes() for i, _ in got], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], names)

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shape = "ids array<int>, begins array<int>, ends array<int>" + (", raw binary, packed binary" if back else "")
    schema = T.StructType([source.schema["key"], *T.StructType.fromDDL(shape).fields])
    names = schema.names
    return source.mapInArrow(work, schema).withColumnRenamed("key", key)


def decoded(coded: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, raw, text): the bytes of each row's ids, and these read as UTF-8."""
    data = file_bytes(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteCodec(data)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [codec.decode(row or []) for row in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw])], names)

    source = coded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    schema = T.StructType([source.schema["key"], *T.StructType.fromDDL("raw binary, text string").fields])
    names = schema.names
    return source.mapInArrow(work, schema).withColumnRenamed("key", key)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, covered_chars) of each document.

    ``covered_chars`` are the characters from the first span's begin to the last one's end.
    """
    coded = encoded(docs, vocabulary, back=True)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)) - F.try_element_at("begins", F.lit(1)), F.lit(0)).cast("long").alias("covered_chars"))
