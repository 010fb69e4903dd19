import base64
import hashlib

import numpy as np
import pytest
import tiktoken

from tidewire.llm import byte_codec, queries
from tidewire.llm.bytebpe import PATTERN, ByteCoder
from tidewire.llm.common import file_bytes, tokenizer_path

VOCABULARY = tokenizer_path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "plain words, 12 of them", "<|endoftext|> is text", "naïve 👩‍🚀 日本語 \U000e0001", "a\x00b\r\n\t 　  x  ",
    "don't we'll  I'M", " lead", "trail   ", "x" * 70_000, "word " * 30_000, "日本" * 40_000, "tab\t\tx " * 20_000, "\x1c a\x1fb\x85c",
]


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file_bytes(tokenizer_path("byte_bpe_50k.tiktoken")).splitlines())}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(row, plain, text):
    ids = plain.encode_ordinary(text or "")
    assert row.n_tokens == len(ids)
    assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert row.covered_chars == len(text or "")


def test_ids_equal_the_plain_library_and_decode_to_the_text(spark, plain):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, key string")
    for row in byte_codec.digests(docs, VOCABULARY).collect():
        digest(row, plain, TEXTS[row.doc_id])


def test_query_over_the_whole_table(spark, small, plain):
    texts = {r.doc_id: r.text for r in small["documents"].collect()}
    rows = queries.QUERIES["op13_byte_codec"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == small["documents"].count()
    for row in rows:
        digest(row, plain, texts[row.doc_id])


def test_white_space_of_two_million_characters():
    codec = byte_codec.ByteCodec(file_bytes(VOCABULARY))
    coder = ByteCoder(file_bytes(tokenizer_path("byte_bpe_50k.tiktoken")))
    for text in (" " * 2_000_000 + "x y", "\n \t" * 700_000, "a" + "\n" * 1_500_000, " " * 400_000 + "é " + " " * 20_000):
        (ids, spans), = codec.encode([text])
        assert codec.decode(ids.tolist()).decode() == text
        assert spans[0, 0] == 0 and spans[-1, 1] == len(text)
        assert coder.encode(text).tolist() == ids.tolist()


def test_spans_hold_their_characters_and_split_characters_come_back(spark):
    text = "héllo 👩 x"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    coded = byte_codec.encoded(docs, VOCABULARY)
    row = coded.first()
    codec = byte_codec.ByteCodec(file_bytes(VOCABULARY))
    assert max(row.ends) == len(text)
    for i, b, e in zip(row.ids, row.begins, row.ends):
        assert codec.spelt[i] in text[b:e].encode()
    split = [i for i, b, e in zip(row.ids, row.begins, row.ends) if "👩" in text[b:e]]
    assert len(split) > 1 and b"".join(codec.spelt[i] for i in split).decode().strip() == "👩"
    back = byte_codec.decoded(coded, VOCABULARY).first()
    assert bytes(back.raw).decode() == text == back.text
    half = spark.createDataFrame([(1, row.ids[:-3]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in byte_codec.decoded(half, VOCABULARY).collect()}
    assert got[2] == got[3] == ""
    with pytest.raises(Exception):
        byte_codec.decoded(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), VOCABULARY).collect()


def test_spans_are_those_of_the_library():
    codec = byte_codec.ByteCodec(file_bytes(VOCABULARY))
    for text in TEXTS:
        if text and len(text) < 50_000:
            (ids, spans), = codec.encode([text])
            plain = codec.coder.encode(text, add_special_tokens=False)
            assert ids.tolist() == plain.ids and [tuple(s) for s in spans.tolist()] == plain.offsets


def test_a_full_cache_changes_nothing(monkeypatch, plain):
    monkeypatch.setattr(byte_codec, "CACHED", 5)
    codec = byte_codec.ByteCodec(file_bytes(VOCABULARY))
    texts = ["one two three four", "two three", "six seven eight nine ten one", "one one", "", None, "four"] * 3
    for _ in range(2):
        assert [ids.tolist() for ids, _ in codec.encode(texts)] == [plain.encode_ordinary(t or "") for t in texts]


def test_cuts_at_every_kind_of_character(plain):
    codec = byte_codec.ByteCodec(file_bytes(VOCABULARY))
    kinds = [chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 0x1680, 0x180E, 0x2000, 0x200A, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    texts = [f"a{x}{y}b!{x}?{y} {x}1{y}{y}'s{x}" for x in kinds for y in kinds]
    assert [ids.tolist() for ids, _ in codec.encode(texts)] == [plain.encode_ordinary(t) for t in texts]


def test_odd_tables(spark, odd_docs, plain):
    rows = byte_codec.digests(odd_docs, VOCABULARY).collect()
    assert len(rows) == odd_docs.count()
    assert byte_codec.digests(odd_docs.limit(0), VOCABULARY).count() == 0
