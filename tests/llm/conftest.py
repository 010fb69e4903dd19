import pytest

from tidewire.llm.common import table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    return {n: table(spark, SMALL, n) for n in ("documents", "pages", "benchmark", "labels", "conversations")}


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = "a long text of words " * 5000
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "   \n ", None, None), (None, "one two three", "en", None),
            (None, "one two three", "en", None), (4, long, "en", "s"), (5, "same words here now " * 4, "de", "s"),
            (6, "same words here now " * 4, "de", "s"), (6, "same words here now " * 4, "de", "s"), (7, "ü", "fr", "t"),
            (7, "another text under one id with more than ten words in it to count", None, "t")]
    names = ["kept", "w", "h", "n", "key", "comp", "_id", "_key", "_hit", "_spans", "_cid", "_lead", "_row", "model", "spans"]
    extra = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(*r, *(["x"] * len(names))) for r in rows],
                                 f"doc_id long, text string, lang string, source string, {extra}")
