"""Decontamination, curve shards and robust outliers against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import decontamination, hilbert, outliers

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def slow_hits(docs, items):
    windows: dict = {}
    for item, text in items:
        w = item_words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = item_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        ids = ",".join(sorted(str(i) for i in found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def planted(spark, small, odd_docs):
    items = [(r.item_id, r.text) for r in small["benchmark"].collect()] + [(900, "Just four odd words"), (901, ""), (902, None), (903, items_text())]
    long = items[0][1]
    docs = [(r.doc_id, r.text) for r in small["documents"].limit(60).collect()]
    docs += [(1000, f"before {long} after, {long}"), (1001, f"x JUST four-odd   words y {items[1][1].upper()}"), (1002, None), (1003, items_text())]
    return (spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, items string"), docs,
            spark.createDataFrame(items, "item_id long, text string"), items)


def items_text():
    return " ".join(f"w{i % 7}" for i in range(60))


@pytest.mark.parametrize("bound", [200_000, 0])
def test_hits_equal_brute_force(planted, bound):
    docs, rows, benchmark, items = planted
    got = decontamination.judged(docs, benchmark, broadcast_windows=bound).select(
        "doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), "contaminated")
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_hits(rows, items)


def test_documents_and_spans_go(planted):
    docs, rows, benchmark, items = planted
    bad = {r[0] for r in slow_hits(rows, items) if r[-1]}
    clean = decontamination.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - bad
    spans = {r.doc_id: r.text for r in decontamination.clean_spans(docs, benchmark).collect()}
    assert spans[1000] == "before after, " and spans[1001].startswith("x y") and spans[1002] is None
    assert all(spans[d] == t for d, t in rows if d not in bad)


def test_odd_documents_are_judged(spark, odd_docs, small):
    assert decontamination.digests(odd_docs, small["benchmark"]).count() == odd_docs.count()
    assert decontamination.clean_spans(odd_docs, small["benchmark"]).columns == odd_docs.columns
    assert decontamination.digests(odd_docs, small["benchmark"].limit(0)).filter("contaminated").count() == 0
    assert decontamination.digests(odd_docs.limit(0), small["benchmark"]).count() == 0


@pytest.mark.parametrize("n, bits", [(2, 3), (3, 2), (1, 4)])
def test_curve_visits_each_cell_once_and_steps_to_neighbours(spark, n, bits):
    cells = spark.range(1 << (n * bits)).select(*[F.expr(f"(id div {1 << (bits * k)}) % {1 << bits}").alias(f"x{k}") for k in range(n)])
    rows = cells.select("*", hilbert.curve_index([F.col(f"x{k}") for k in range(n)], bits).alias("c")).orderBy("c").collect()
    assert [r.c for r in rows] == list(range(1 << (n * bits)))
    assert all(sum(abs(a[k] - b[k]) for k in range(n)) == 1 for a, b in zip(rows, rows[1:]))


def test_shards_hold_the_law(spark, small, odd_docs):
    for docs, n in ((small["documents"], small["documents"].count()), (odd_docs, odd_docs.count()), (odd_docs.limit(0), 0)):
        rows = hilbert.sharded(docs).collect()
        assert len(rows) == n
        slots: dict = {}
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots.get(k, [])) for k in range(24)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    text = {r.doc_id: r.text.encode() for r in small["documents"].collect()}
    rows = hilbert.sharded(small["documents"]).collect()
    assert all(r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in rows)
    assert all(a.curve <= b.curve for a, b in zip(*(sorted(rows, key=lambda r: (r.shard, r.slot))[k:] for k in (0, 1))))


def slow_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_base_counts_equal_brute_force(spark, small, odd_docs):
    for docs in (small["documents"], odd_docs):
        want = Counter((r.doc_id, *slow_counts(r.text)) for r in docs.collect())
        got = outliers.judged(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
        assert not any(r.kept for r in got if r.base_failed)
    assert outliers.judged(odd_docs.limit(0)).count() == 0


def test_good_documents_stay_and_bad_go(spark, small):
    marks = {r.doc_id: r.quality for r in small["labels"].collect()}
    got = {r.doc_id: r for r in outliers.judged(small["documents"]).collect()}
    good = [got[d] for d, q in marks.items() if q == 1 and d in got and not got[d].base_failed]
    bad = [got[d] for d, q in marks.items() if q == 0 and d in got]
    assert all(r.kept for r in good) and sum(not r.kept for r in bad) >= 0.8 * len(bad)


def test_large_and_small_groups_keep_every_row(spark):
    """Sources over and under the pooling bound, null names among them."""
    rows = [(i, f"word{i % 7} and some more words to make it long enough for the rule number {i}", lang, source)
            for i, (lang, source) in enumerate([("en", "a")] * 60 + [("en", "b")] * 50 + [("de", "a")] * 60 + [("de", "b")] * 9
                                               + [("fr", "a")] * 25 + [("fr", "b")] * 25 + [(None, None)] * 3 + [(None, "c")] * 45)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = outliers.judged(docs, least_rows=40).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows))) and all(r.distance is not None for r in got)
    assert outliers.kept_documents(docs, least_rows=40).count() == sum(r.kept for r in got)


def test_inverse_and_determinant(spark):
    a = np.array([[4.0, 1.0, 0.5], [1.0, 3.0, 0.2], [0.5, 0.2, 2.0]])
    e = spark.range(1).select(outliers.inverted(F.array(*map(F.lit, a.ravel().tolist())), 3).alias("e")).select("e.*").first()
    assert np.allclose(np.array(e.m).reshape(3, 3), np.linalg.inv(a)) and np.isclose(e.logdet, np.log(np.linalg.det(a)))


def test_chi_square():
    assert abs(outliers.chi_square_quantile(0.975, 5) - 12.8325) < 1e-3
    assert abs(outliers.chi_square_quantile(0.5, 1) - 0.454936) < 1e-5


def test_planted_outliers_do_not_move_the_estimate(spark):
    rng = np.random.default_rng(5)
    cov = np.array([[1.0, 0.6], [0.6, 2.0]])
    x = rng.multivariate_normal([3.0, -1.0], cov, 3000)
    far = rng.multivariate_normal([12.0, 9.0], cov / 20, 600)
    rows = spark.createDataFrame([("a", [float(v) for v in r]) for r in np.vstack([x, far])], "grp string, x array<double>")
    e = outliers.minimum_covariance(rows, 2, [1e-3, 1e-3]).first()
    assert np.allclose(e["mean"], [3.0, -1.0], atol=0.1)
    assert np.allclose(np.linalg.inv(np.array(e["inverse"]).reshape(2, 2)), cov, atol=0.25)
