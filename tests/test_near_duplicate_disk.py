"""What near-duplicates write grows with the texts, not with pairs of texts that only share common shingles."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import neardup


def drawn(seed, words, n):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def test_texts_of_one_small_vocabulary_are_no_candidates(spark, monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(60)]
    texts = [drawn(k, words, 400) for k in range(120)]  # any two share about half of their shingles
    texts += [t[:-20] + " changed end" for t in texts[:10]]
    seen, edges = [], neardup._edges
    monkeypatch.setattr(neardup, "_edges", lambda pairs, *a, **k: (seen.append(pairs.count()), edges(pairs, *a, **k))[1])
    found = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t")
    assert {r.key: r.duplicate_of for r in found.collect()} == {120 + i: i for i in range(10)}
    assert seen == [10]


@pytest.mark.parametrize("threshold", [0.4, 0.7])
def test_no_sketch_hides_a_close_text(threshold):
    r, texts = random.Random(7), []
    for n in (8, 30, 120, 500, 2500):
        for _ in range(5 if n < 500 else 2):
            base = [f"w{r.randint(0, 9999)}" for _ in range(n)]
            texts += [" ".join(base[: int(n * part)]) for part in (1, 0.95, 0.8, 0.72, 0.68, 0.45)]
    codes = [neardup.shingle_codes(t, 5) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: len(codes[i]))
    n, none = np.array([len(codes[i]) for i in order]), np.zeros(len(order), np.int64)
    sketches = [neardup.odd_sketch(codes[i]) for i in order]
    got = {(order[i], order[j]) for one, two in neardup._Sieve(threshold, 500).pairs(none, none, none > 0, n, sketches)
           for i, j in zip(one.tolist(), two.tolist())}
    want = set()
    for at, i in enumerate(order):
        for j in order[at + 1:]:
            common = len(np.intersect1d(codes[i], codes[j]))
            if common >= threshold * (len(codes[i]) + len(codes[j]) - common):
                want.add((i, j))
    assert want <= got and 60 < len(want) and len(got) < 0.15 * len(texts) ** 2 / 2


def test_stored_tables_leave_no_shuffle_files(spark):
    def files():
        there = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (there.apply(i).getName() for i in range(there.size())) if name.startswith("shuffle_")}

    before = files()
    table = neardup._stored(spark.range(5000).groupBy((F.col("id") % 100).alias("k")).count().repartition(7, "k"))
    ends = time.time() + 20
    while files() - before and time.time() < ends:
        time.sleep(0.2)
    assert not files() - before and table.count() == 100
