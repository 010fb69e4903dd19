"""Piece encoding against the library whose ids it must equal."""

import random

import sentencepiece

from tidewire.llm import pieces
from tidewire.llm.common import file_bytes, tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "  lead", "trail  ", "a\0b\tc\n\n", "ﬁ　① 😀 €", "▁ ▁x", "<s> </s> <0x0A>", "é" * 300, "x,y.z;w! (q)?", "ab" * 4000]


def test_ids_and_texts_equal_the_library(small):
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.PieceModel(file_bytes(MODEL))
    spellings = own.spellings()
    for text in [r.text for r in small["documents"].collect()] + ODD:
        ids, begins, ends = (x.tolist() for x in own.encode(text))
        assert ids == library.encode(text)
        assert own.decode(ids, spellings) == library.decode(ids)
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(begins, ends)) == raw
        plain = [i for i in ids if own.kinds[i] == pieces.NORMAL]
        spans = [raw[a:b].decode() for i, a, b in zip(ids, begins, ends) if own.kinds[i] == pieces.NORMAL]
        assert all(own.pieces[i].replace("▁", " ").lstrip(" ") == s.replace("▁", " ").lstrip(" ") for i, s in zip(plain, spans))


def test_any_ids_decode_as_the_library_does():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.PieceModel(file_bytes(MODEL))
    spellings, pick = own.spellings(), random.Random(3)
    for _ in range(1500):
        ids = [pick.choice([0, 1, 2, 259, pick.randrange(3, 259), pick.randrange(32000)]) for _ in range(pick.randrange(12))]
        assert own.decode(ids, spellings) == library.decode(ids)


def test_compiled_maps_normalise_as_the_library_does(small):
    texts = [r.text for r in small["documents"].limit(40).collect()] + ODD
    for rule in ("nmt_nfkc", "nfkc_cf"):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        spec = dict(pieces._fields(dict(pieces._fields(library.serialized_model_proto()))[3]))
        own = pieces.PieceModel.__new__(pieces.PieceModel)
        own.map, own.dummy, own.squeeze, own.escape = pieces.CharacterMap(spec[2]), *(bool(spec.get(k, 1)) for k in (3, 4, 5))
        for text in texts:
            norm, begins = own.normalised(text)
            assert norm == library.normalize(text)
            assert begins == sorted(begins) and begins[-1] <= len(text.encode())


def test_odd_rows(spark, odd_docs):
    got = pieces.digests(odd_docs, MODEL).collect()
    assert len(got) == odd_docs.count()
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert all(r.covered_bytes == len((t or "").encode()) for r, t in zip(got, [x.text for x in odd_docs.collect()]))
    assert pieces.digests(odd_docs.limit(0), MODEL).count() == 0


def test_both_ways_to_decode_agree(small):
    docs = small["documents"].limit(30)
    once = {r.doc_id: r.text for r in pieces.encoded(docs, MODEL, back=True).collect()}
    apart = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(docs, MODEL), MODEL).collect()}
    assert once == apart == {r.doc_id: r.text for r in docs.collect()}


def test_long_unspaced_text_takes_seconds_and_keeps_its_ids():
    import random
    import time

    import sentencepiece

    model = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    coder = pieces.PieceModel(pieces.file_bytes(model))
    pick = random.Random(4)
    mixed = "".join(pick.choice(["the", "ing", "日本", "é", "x", "00", "\U0001f469", "а"]) for _ in range(120_000))
    for text in ("the" * 330_000, "日本語" * 100_000, "a" * 1_000_000, mixed, "=" * 300_000):
        start = time.time()
        ids = coder.encode(text)[0].tolist()
        assert time.time() - start < 60
        assert ids == library.encode(text)
    for n in range(90, 130):  # either way of merging gives the same pieces
        short = mixed[:n]
        assert coder.encode(short)[0].tolist() == library.encode(short)
