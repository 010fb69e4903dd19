import re
from collections import Counter
from itertools import permutations

import pytest

from tidewire.llm import interaction

NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def slow(docs, labels):
    """Every order played through on the documents themselves."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least: dict = {}
    for doc, text, _ in docs:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    rows = []
    for doc, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": doc is not None and doc > least[text]}
        rows.append((source or "", {k for k, v in fails.items() if v}, doc in good, doc in toxic))
    out, sums = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {r[0] for r in rows}:
            here = [r for r in rows if r[0] == part]
            left = here
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in here if f in r[1]]
                out[part, order, step] = (len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in here),
                                          sum(r[2] for r in gone), sum(r[3] for r in gone))
                sums[part, f] += len(gone)
    return sorted((p, o, s, *v, sums[p, o[s - 1]]) for (p, o, s), v in out.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*NAMES).collect())


SHAPE = "doc_id long, text string, source string"
LABELS = [(1, 1, 0), (1, 1, 1), (3, 0, 1), (4, 1, 0), (4, None, None), (None, 1, 1), (9, 1, 1)]
LONG = " ".join(f"w{i}" for i in range(80))
DOCS = [
    (9, LONG, "a"), (4, LONG, "a"), (4, LONG, None), (7, "SHOUT " * 60, "b"), (3, "SHOUT " * 60, "a"), (1, None, None), (2, "", ""),
    (5, " \t ", "b"), (None, LONG, "b"), (None, None, None), (6, LONG + " $5", "a"), (8, "ü é ñ #tag", "c"), (4, LONG, "a"),
    (11, "naïve " * 100_000 + "|", "b"), (12, "\x1cone\x1dtwo\x85three", "c"),
]


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, part string")


def test_every_order_of_made_documents(spark, marks, tmp_path):
    path = str(tmp_path / "docs")
    names = ["part", "h", "flags", "n", "grp", "marks", "_id"]
    extra = ", ".join(f"{n} string" for n in names)
    spark.createDataFrame([(*d, *names) for d in DOCS], f"{SHAPE}, {extra}").repartition(5).write.parquet(path)
    audit = interaction.InteractionAudit(spark, path, marks, batches=3)
    assert rows_of(audit.update().result()) == slow(DOCS, LABELS)


def test_smaller_ids_in_later_files_take_back_what_was_counted(spark, marks, tmp_path):
    path, folder, seen = str(tmp_path / "docs"), str(tmp_path / "state"), []
    order = sorted((d for d in DOCS if d[0] is not None), key=lambda d: -d[0])
    for at in range(0, len(order), 4):
        seen += order[at:at + 4]
        spark.createDataFrame(order[at:at + 4], SHAPE).coalesce(1).write.mode("append").parquet(path)
        audit = interaction.InteractionAudit(spark, path, marks, folder=folder)
        assert rows_of(audit.update().result()) == slow(seen, LABELS)
    before = spark.read.parquet(f"{folder}/changes").count()
    assert spark.read.parquet(f"{folder}/changes").filter("n < 0").count() > 0
    assert rows_of(audit.update().result()) == slow(seen, LABELS)  # nothing new: no batch
    assert spark.read.parquet(f"{folder}/changes").count() == before


def test_a_text_that_many_rows_share(spark, marks, tmp_path):
    path = str(tmp_path / "docs")
    docs = [(i, LONG if i % 3 else f"{i} {LONG}", "a" if i % 2 else "b") for i in range(3000)]
    spark.createDataFrame(docs, SHAPE).repartition(16).write.parquet(path)
    assert rows_of(interaction.InteractionAudit(spark, path, marks).update().result()) == slow(docs, LABELS)


def test_an_empty_table(spark, marks, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([], SHAPE).write.parquet(path)
    assert interaction.InteractionAudit(spark, path, marks.limit(0)).update().result().count() == 0
