"""Packed rows give every token back; section counts equal a slow count."""

import numpy as np
import tiktoken
from hypothesis import given, settings, strategies as st

from tidewire.llm import attribution, packing
from tidewire.llm.bytebpe import PATTERN, ByteCoder
from tidewire.llm.common import file_bytes, tokenizer_path

RANKS = tokenizer_path("byte_bpe_50k.tiktoken")
CODER = ByteCoder(file_bytes(RANKS))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_is_best_fit(lengths):
    rows = packing.best_fit(lengths, 50)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in r) <= 50 for r in rows)
    left: list[int] = []  # the same by looking at every row
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(left) if room >= n]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= n
        else:
            left.append(50 - n)
    assert len(rows) == len(left)


def test_rows_give_all_tokens_back(spark, small, odd_docs):
    coder = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=CODER.ranks, special_tokens={})
    for docs in (small["documents"].select("doc_id", "text"), odd_docs):
        segments: dict = {}
        for r in packing.packed(docs, RANKS, row=256).collect():
            ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
            assert len(ids) == len(places) == 256 and r.cu_seqlens[-1] == r.n_tokens
            assert (ids[r.n_tokens:] == 50256).all()
            for k, (doc, at) in enumerate(zip(r.doc_ids, r.doc_offsets)):
                a, b = r.cu_seqlens[k], r.cu_seqlens[k + 1]
                assert places[a:b].tolist() == list(range(b - a))
                segments.setdefault(doc, []).append((at, ids[a:b].tolist()))
        want: dict = {}
        for r in docs.collect():
            want.setdefault(r.doc_id, []).append(coder.encode_ordinary(r.text or ""))
        for doc, texts in want.items():
            parts = sorted(segments.get(doc, []))
            assert sorted(i for _, p in parts for i in p) == sorted(i for t in texts for i in t)
            if len(texts) == 1:
                assert [i for _, p in parts for i in p] == texts[0]
    assert packing.packed(odd_docs.limit(0), RANKS).count() == 0


def slow(text, spans, rule):
    ids = CODER.encode(text)
    owner = [i for i, c in enumerate(text) for _ in c.encode()]
    at, counts = 0, {}
    for i in ids:
        chars = sorted(set(owner[at:at + CODER.sizes[i]]))
        at += CODER.sizes[i]
        def holder(c):
            held = [(spans[k], k) for k in range(len(spans)) if spans[k][0] <= c < spans[k][1]]
            return max(held)[1] if held else -1
        held = [holder(c) for c in chars]
        where = held[0] if rule == "start" else max(dict.fromkeys(held), key=held.count)
        counts[where] = counts.get(where, 0) + 1
    return counts


@settings(max_examples=80, deadline=None)
@given(st.text("ab .\né€😀", max_size=40), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 12)), max_size=5),
       st.sampled_from(["start", "most"]))
def test_allocation_is_as_the_rule_says(text, cuts, rule):
    spans = [(a, a + n) for a, n in cuts]
    begins, ends = attribution.character_spans(text, CODER.sizes[CODER.encode(text)])
    where, _ = attribution.allocate(begins, ends, spans, rule)
    values, n = np.unique(where, return_counts=True)
    assert dict(zip(values.tolist(), n.tolist())) == slow(text, spans, rule)


def test_lines_hold_all_tokens(spark, small, odd_docs):
    for docs in (small["documents"], odd_docs):
        got: dict = {}
        for r in attribution.attributed(docs, RANKS, rule="most").collect():
            got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
        want: dict = {}
        for r in docs.collect():
            want[r.doc_id] = want.get(r.doc_id, 0) + len(CODER.encode(r.text))
        assert got == want
    given_spans = spark.createDataFrame([(1, "ab cd", [(0, 2), (2, 5)]), (2, "x", None)],
                                        "doc_id long, text string, spans array<struct<begin int, end int>>")
    assert [(r.doc_id, r.section, r.n_tokens) for r in attribution.attributed(given_spans, RANKS, "spans").collect()] == [(1, 0, 1), (1, 1, 1)]
    assert attribution.attributed(odd_docs.limit(0), RANKS).count() == 0
