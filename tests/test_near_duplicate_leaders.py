"""A text that stands leads, also if all texts close to it have fallen to others before it was decided."""

from tidewire.operators import neardup


def test_a_text_that_stands_late_leads(spark):
    # 2 falls to 1, so 3 stands; 4 had fallen to 1 by then and is close to 3 too.
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 1), (4, 3)], "first long, leader long")
    assert {r.root for r in neardup._standing(edges).collect()} == {1, 3}
    assert neardup._standing(edges.limit(0)) is None


def test_the_closest_leader_may_have_stood_late(spark):
    words = [f"w{k:04d}" for k in range(400)]
    texts = {1: words[:200], 2: words[22:222], 3: words[44:244], 4: words[33:233]}
    rows = [(k, " ".join(t)) for k, t in texts.items()]
    sets = {k: {t[i:i + 5] for i in range(len(t) - 4)} for k, t in rows}
    jaccard = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if b < a}
    assert min(jaccard[2, 1], jaccard[3, 2], jaccard[4, 1]) >= 0.7 > jaccard[3, 1] and jaccard[4, 3] > jaccard[4, 1]
    got = {r.key: (r.duplicate_of, r.jaccard) for r in neardup.near_duplicates(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    assert got == {2: (1, jaccard[2, 1]), 4: (3, jaccard[4, 3])}
