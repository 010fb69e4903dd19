"""Operator 9: SentencePiece encoding with offsets, and decoding.

The text is normalised by the longest prefix found in the model's compiled character map, and
every normalised character keeps the source bytes it came from. Pieces are merged on the
normalised text; their bounds are then projected back to byte spans of the source.

Whole texts are encoded inside the tasks that read them, so nothing is shuffled. A text falls
into segments that no merge can cross (before a run of word marks, and at line ends); a bounded
cache remembers the pieces of a segment.

Defined cases: a null or empty text has no ids and decodes to an empty text; a text of any
length is encoded whole; repeated rows give repeated rows; an empty table gives an empty one;
only the named columns are read, whatever else the table holds.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidewire.llm.common import file_bytes, small_batches

MARK = "▁"
_NONE = np.empty(0, np.int32)
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed: kinds of piece in a model file


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at:at + size]
        at += size


class CharacterMap:
    """Longest-prefix replacement by a compiled character map: a double-array trie over UTF-8
    bytes and the block of its replacement strings."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, dtype="<u4", count=size // 4, offset=4).tolist() if size else []
        self.block = compiled[4 + size:]
        self.firsts = {b for b in range(256) if self._step(0, b) is not None} if self.units else set()

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _step(self, node: int, byte: int) -> int | None:
        to = node ^ self._offset(self.units[node]) ^ byte
        return to if self.units[to] & 0x800000FF == byte else None

    def longest(self, source: bytes, at: int) -> tuple[str, int] | None:
        """The replacement of the longest mapped prefix at ``at``, and that prefix's length."""
        if not self.units or source[at] not in self.firsts:
            return None
        node, found = 0, None
        for i in range(at, len(source)):
            to = self._step(node, source[i])
            if to is None:
                break
            node = to
            if self.units[node] & 256:
                leaf = node ^ self._offset(self.units[node])
                found = self.units[leaf] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        start = found[0]
        return self.block[start:self.block.index(b"\0", start)].decode(), found[1]


class PieceModel:
    """A BPE piece model read from its file: pieces, scores, kinds and the normaliser's settings."""

    def __init__(self, data: bytes, cache_size: int = 250_000):
        self.pieces, self.kinds, scores = [], [], {}
        self.dummy = self.squeeze = self.escape = True
        compiled, algorithm = b"", 1
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in _fields(value):
                    piece = v.decode() if k == 1 else piece
                    score = struct.unpack("<f", v)[0] if k == 2 else score
                    kind = v if k == 3 else kind
                if kind in (NORMAL, USER):
                    scores[piece] = score
                self.pieces.append(piece)
                self.kinds.append(kind)
            elif number == 2:
                algorithm = dict(_fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(_fields(value))
                compiled = spec.get(2, b"")
                self.dummy, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if algorithm != 2 or USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("only BPE models without user-defined or unused pieces are encoded")
        places = {x: i for i, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank, self.no_rank = {p: places[x] for p, x in scores.items()}, len(places)
        self.map = CharacterMap(compiled)
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_ids = [0] * 256
        for i, p in enumerate(self.pieces):
            if self.kinds[i] == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self.controls = frozenset(i for i, k in enumerate(self.kinds) if k == CONTROL)
        self.falls_back = BYTE in self.kinds
        # Merges never cross the start of a run of marks if no piece has a mark after another character.
        self.parted = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.plain_ends = not any("\n" in p for p in self.ids)
        self.segments = re.compile(self._cuts()).findall
        self.cache: dict[str, bytes] = {}
        self.packed: dict[str, bytes] = {}  # of single pieces and characters
        self.cache_size = cache_size
        self.identity = not self.map.units and not self.squeeze

    def _cuts(self) -> str:
        """A pattern of segments that no merge can join: cut before each run of marks, at line
        ends, and before punctuation that no piece has after what stands there."""
        before: dict[str, set[str]] = {}
        for piece in self.ids:
            for x, y in zip(piece, piece[1:]):
                before.setdefault(y, set()).add(x)
        apart = [c for c in ".,;:!?)\"'|#$%&*" if not any(x.isalnum() for x in before.get(c, ()))]
        joins = {x for c in apart for x in before.get(c, ())} | {" ", MARK}
        mark, gap = (f" {MARK}" if self.escape else MARK), "\n" if self.plain_ends else ""
        cut, held = "".join(map(re.escape, apart)), "".join(map(re.escape, sorted(joins)))
        run = f"[^{mark}{gap}{cut}]+" + (f"|(?<=[{held}])[{cut}]" if cut else "")
        return f"[{mark}]+(?:{run})*|(?:{run})+" + (f"|[{cut}](?:{run})*" if cut else "") + ("|\n" if gap else "")

    # -- normalisation ---------------------------------------------------------------------
    def normalised(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and for each of its characters the source byte where what it
        came from begins; one more entry for the end."""
        source = text.encode("utf-8", "replace")
        out: list[str] = []
        begins: list[int] = []
        at, end, space = 0, len(source), " "
        mark = MARK if self.escape else " "

        def part(i: int) -> tuple[str, int]:
            found = self.map.longest(source, i)
            if found is not None:
                return found
            first = source[i]
            n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            return source[i:i + n].decode(), n

        if self.squeeze:
            while at < end:
                got, n = part(at)
                if got != space:
                    break
                at += n
        if at >= end:
            return "", [end]
        if self.dummy:
            out.append(mark)
            begins.append(at)
        after_space = self.squeeze
        while at < end:
            got, n = part(at)
            if after_space:
                got = got.lstrip(space)
            for ch in got:
                out.append(mark if ch == space else ch)
                begins.append(at)
            if got:
                after_space = self.squeeze and got.endswith(space)
            at += n
        last = end
        if self.squeeze:
            while out and out[-1] == mark:
                out.pop()
                last = begins.pop()
        return "".join(out), [*begins, last]

    # -- merging ---------------------------------------------------------------------------
    def merged(self, segment: str) -> list[str]:
        """Pieces of a segment: the adjacent pair of the best score merges first, leftmost on ties."""
        if len(segment) > 100:
            return self._merged_long(segment)
        parts, rank, none = list(segment), self.rank.get, self.no_rank
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            joined = parts[i] = parts[i] + parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(joined + parts[i + 1], none)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + joined, none)
        return parts

    def _merged_long(self, segment: str) -> list[str]:
        """The same by a heap of pairs over a linked list, for segments of any length."""
        parts: list[str | None] = list(segment)
        rank, end = self.rank.get, len(parts)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(r, i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank(a + b)) is not None]
        heapify(heap)
        while heap:
            _, i, joined = heappop(heap)
            j = after[i]
            if parts[i] is None or j == end or parts[i] + parts[j] != joined:
                continue  # one of the two is part of a longer piece by now
            parts[i], parts[j] = joined, None
            k = after[i] = after[j]
            if k < end:
                before[k] = i
                if (r := rank(joined + parts[k])) is not None:
                    heappush(heap, (r, i, joined + parts[k]))
            h = before[i]
            if h >= 0 and (r := rank(parts[h] + joined)) is not None:
                heappush(heap, (r, h, parts[h] + joined))
        return [p for p in parts if p is not None]

    def coded(self, segment: str) -> list[tuple[int, int, int]]:
        """(id, characters, bytes of the character) of a segment; ``characters`` is 0 and
        ``bytes`` 1 for all but the last byte of a character that falls back to bytes."""
        out = []
        for piece in self.merged(segment):
            got = self.ids.get(piece)
            if got is not None:
                out.append((got, len(piece), 0))
            elif self.falls_back:
                raw = piece.encode()
                out += [(self.byte_ids[b], int(k == len(raw) - 1), 1) for k, b in enumerate(raw)]
            else:
                out.append((self.unknown, len(piece), 0))
        return out

    # -- encoding --------------------------------------------------------------------------
    def _direct(self, segment: str, dummy: bool = False) -> bytes:
        """Ids and source bytes of the pieces of a segment where every character is its own
        source, packed as 64-bit words: id in the upper half, bytes in the lower."""
        text = segment.replace(" ", MARK) if self.escape else segment
        if dummy or MARK in segment:  # marks that are not one byte of the source
            widths = [1 if c < "\x80" else len(c.encode("utf-8", "replace")) for c in segment]
            if dummy:
                text, widths = (MARK if self.escape else " ") + text, [0, *widths]
            words, at = [], 0
            for got, n, single in self.coded(text):
                words.append(got << 32 | (1 if single else sum(widths[at:at + n])))
                at += n
            value = struct.pack(f"<{len(words)}Q", *words)
        else:
            packed = self.packed
            value = b"".join([packed.get(p) or self._pack(p) for p in self.merged(text)])
        if not dummy and len(segment) <= 256:
            if len(self.cache) >= self.cache_size:
                self.cache.clear()
            self.cache[segment] = value
        return value

    def _pack(self, piece: str) -> bytes:
        words = [got << 32 | (1 if single else len(piece.replace(MARK, " ").encode("utf-8", "replace")))
                 for got, _, single in self.coded(piece)]
        self.packed[piece] = value = struct.pack(f"<{len(words)}Q", *words)
        return value

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each piece begins and ends in the bytes of the source."""
        if not text:
            return _NONE, _NONE, _NONE
        if self.identity and self.parted:
            return self._encode_direct(text)
        norm, begins = self.normalised(text)
        if not norm:
            return _NONE, _NONE, _NONE
        mark = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        ids, starts, ends, at = [], [], [], 0
        for segment in mark.findall(norm) if self.parted else [norm]:
            byte = 0
            for got, n, single in self.coded(segment):
                a = begins[at] + byte
                if single:  # one byte of a character; within the source only if it is unchanged
                    byte = 0 if n else byte + 1
                    starts.append(min(a, begins[at + 1]))
                    ends.append(begins[at + 1] if n else min(a + 1, begins[at + 1]))
                else:
                    starts.append(a)
                    ends.append(begins[at + n])
                ids.append(got)
                at += n
        return np.array(ids, np.int32), np.array(starts, np.int32), np.array(ends, np.int32)

    def _encode_direct(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = self.segments(text)
        first = self._direct(parts.pop(0), dummy=True) if self.dummy else b""
        get, miss = self.cache.get, self._direct
        packed = np.frombuffer(first + b"".join([get(p) or miss(p) for p in parts]), dtype="<u4")
        ends = np.cumsum(packed[::2], dtype=np.int32)
        return packed[1::2].astype(np.int32), ends - packed[::2].astype(np.int32), ends

    # -- decoding --------------------------------------------------------------------------
    def spellings(self) -> list[bytes]:
        """What each id stands for: control pieces are silent, unknown ones show a sign."""
        out = []
        for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds)):
            out.append(b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN
                       else bytes([int(piece[3:5], 16)]) if kind == BYTE
                       else piece.replace(MARK, " ").encode() if self.escape else piece.encode())
        return out

    def decode(self, ids: list[int], spellings: list[bytes]) -> str:
        """The text of ids; the mark put before the text is dropped, each byte that is no
        part of a character becomes U+FFFD."""
        if not self.controls.isdisjoint(ids):  # bytes on either side of a control piece stay apart
            runs = [list(g) for silent, g in groupby(ids, self.controls.__contains__) if not silent]
            return "".join(self._spelt(run, spellings, k == 0) for k, run in enumerate(runs))
        return self._spelt(ids, spellings, True)

    def _spelt(self, ids: list[int], spellings: list[bytes], first: bool) -> str:
        raw = b"".join(map(spellings.__getitem__, ids))
        if first and raw[:1] == b" " and (self.dummy or self.squeeze) and self.kinds[ids[0]] == NORMAL:
            raw = raw.lstrip(b" ") if self.squeeze else raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            out, at = [], 0
            while at < len(raw):
                n = next((n for n in (1, 2, 3, 4) if _is_char(raw[at:at + n])), 0)
                out.append(raw[at:at + n].decode() if n else "�")
                at += n or 1
            return "".join(out)


def _is_char(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


SPANS = "ids array<int>, begins array<int>, ends array<int>"


def encoded(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", back: bool = False) -> DataFrame:
    """(key, ids, begins, ends): the pieces of each whole text and their spans in its UTF-8 bytes.

    With ``back``, also ``text``: what the ids decode to, in the same pass.
    """
    data = file_bytes(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceModel(data)
        spellings = coder.spellings()
        for batch in small_batches(batches, "text", 2 << 20):
            got = [coder.encode(t) for t in batch.column("text").to_pylist()]
            bounds = np.cumsum([0, *(len(g[0]) for g in got)], dtype=np.int32)
            columns = [pa.ListArray.from_arrays(bounds, np.concatenate([_NONE, *(g[k] for g in got)])) for k in range(3)]
            if back:
                columns.append(pa.array([coder.decode(g[0].tolist(), spellings) for g in got], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], names)

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([source.schema["key"], *T.StructType.fromDDL(SPANS + (", text string" if back else "")).fields])
    names = schema.names
    return source.mapInArrow(encode, schema).withColumnRenamed("key", key)


def decoded(coded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, text): the text of each row's ids; null ids give an empty text."""
    data = file_bytes(model)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceModel(data)
        spellings = coder.spellings()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [coder.decode(row or [], spellings) for row in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], names)

    source = coded.select(F.col(ids).alias("_ids"), key, *keep)
    names = [*source.columns[1:], "text"]
    schema = T.StructType([*source.schema.fields[1:], T.StructField("text", T.StringType())])
    return source.mapInArrow(decode, schema)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes) of each document.

    ``covered_bytes`` are the source bytes inside the spans of its pieces.
    """
    coded = encoded(docs, model, back=True)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)) - F.try_element_at("begins", F.lit(1)), F.lit(0)).cast("long").alias("covered_bytes"))
