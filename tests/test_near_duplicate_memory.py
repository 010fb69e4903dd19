"""Near-duplicate steps hold one text's shingles at a time."""

import tracemalloc

import pyarrow as pa
import pytest

from tidewire.operators import neardup


def test_signing_holds_no_shingles_of_a_batch():
    texts = ["".join(chr(33 + (i * k) % 9001) for k in range(20_000)) for i in range(1, 200)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts)), pa.int64()), pa.array(["h"] * len(texts)), pa.array(texts)], ["first", "hash", "text"])
    tracemalloc.start()
    (out,) = neardup.signer(5, 128, 1)([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.column_names == ["first", "hash", "signature"] and {len(s) for s in out["signature"].to_pylist()} == {128}
    assert peak < 8 << 20


@pytest.mark.parametrize("early", [0, 1, 3])
def test_pairs_of_fallen_texts_are_not_verified(spark, early):
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join([*words, str(k)]) for k in range(40)]
    sets = spark.createDataFrame(list(enumerate(texts)), "first long, text string")
    pairs = spark.createDataFrame([(a, b) for a in range(40) for b in range(a)], "first long, leader long")
    edges = neardup._edges(pairs, sets, 5, 0.7, early)
    assert edges.count() == (39 if early else 780)
    assert [tuple(r) for r in neardup._standing(edges).collect()] == [(0,)]
