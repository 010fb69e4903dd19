"""Operator 2: benchmark decontamination by a hash set of word windows. JVM expressions only.

Windows of ``width`` words of the benchmark items are hashed; the windows of every document are
hashed in the scan, matched against that set, and each match is verified on the words themselves.
The set is broadcast only if its counted entries are within ``broadcast_windows``; a larger one is
joined by shuffle on the window's words, with the same result.

Defined cases: null and empty texts have no words, hits or windows; an item of fewer words than
``width``, but not none, is one window of its length; items without words match nothing; an item
with a null id hits words but is not listed; repeated rows are judged each; empty tables give
empty or clean results; of both tables only the named columns are read.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from tidewire.llm.common import bound, lower_ascii, split_words, unused

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing: all ASCII but digits and letters


def item_words(text: Column) -> Column:
    return split_words(lower_ascii(text), GAP)


def _windows(words: Column, width: int) -> Column:
    """The hash of each window of ``width`` words; none for shorter texts. Words are taken one by
    one, as a slice copies its whole array."""
    return bound(words, lambda w: F.when(F.size(w) >= width, F.transform(
        F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))))


def benchmark_windows(benchmark: DataFrame, width: int = 10) -> DataFrame:
    """(length, h, window, items): each distinct window and the ids of the items that hold it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), item_words(F.col("text")).alias("w"))
    n = F.least(F.size("w"), F.lit(width))
    slices = bound(F.col("w"), lambda w: F.when(F.size(w) > 0, F.transform(
        F.sequence(F.lit(1), F.size(w) - F.least(F.size(w), F.lit(width)) + 1), lambda i: F.slice(w, i, F.least(F.size(w), F.lit(width))))))
    windows = items.select("item", n.alias("length"), F.explode_outer(slices).alias("window")).filter("window IS NOT NULL")
    return windows.groupBy("length", "window").agg(F.collect_set("item").alias("items")).select(
        "length", F.xxhash64("window").alias("h"), "window", "items")


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, broadcast_windows: int = 200_000) -> DataFrame:
    """(doc_id, text_key, spans, items): verified windows of each hit document, as first word and
    length, and the items they come from."""
    windows = benchmark_windows(benchmark, width)
    sizes = {r["length"]: (r["n"], r["m"]) for r in windows.groupBy("length").agg(
        F.count("*").alias("n"), F.sum(F.size("items")).alias("m")).collect()}  # at most ``width`` rows
    small = sum(n + m for n, m in sizes.values()) <= broadcast_windows
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), item_words(F.col("text")).alias("w"))
    parts = []
    for length in sorted(sizes) or [width]:
        known = windows.filter(F.col("length") == length).select("h", "window", "items")
        # The outer form: an inner one makes the optimizer compute the windows a second time in a filter.
        hashed = base.withColumn("hashes", _windows(F.col("w"), length))
        # Two comparisons, so that the words are looked at only where the hash is found.
        here = F.slice("w", F.col("at") + 1, length)
        same = (here <= F.col("window")) & (here >= F.col("window"))
        if small:
            scan = hashed.select("doc_id", "text_key", "w", F.posexplode_outer("hashes").alias("at", "h"))
            found = scan.join(F.broadcast(known), (scan["h"] == known["h"]) & same)
        else:
            # Hashes alone are shuffled; the words of what they find are fetched again by document.
            scan = hashed.select("doc_id", "text_key", F.posexplode_outer("hashes").alias("at", "h"))
            words = base.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_text"), "w").dropDuplicates(["_doc", "_text"])
            met = scan.join(known, "h")
            found = met.join(words, met["doc_id"].eqNullSafe(words["_doc"]) & met["text_key"].eqNullSafe(words["_text"])).filter(same)
        parts.append(found.select("doc_id", "text_key", F.struct(
            F.col("at"), F.lit(length).alias("length")).alias("span"), "items"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def _covered(spans: str) -> Column:
    """Words inside at least one span; ``spans`` is sorted by first word."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    return F.aggregate(spans, start, lambda s, x: F.struct(
        F.greatest(s["upto"], x["at"] + x["length"]).alias("upto"),
        (s["n"] + F.greatest(F.lit(0), x["at"] + x["length"] - F.greatest(s["upto"], x["at"]))).alias("n")),
        lambda s: s["n"])


def judged(docs: DataFrame, benchmark: DataFrame, width: int = 10, broadcast_windows: int = 200_000) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, items, spans, contaminated), a row for each document."""
    found = hits(docs, benchmark, width, broadcast_windows)
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_key"),
                          F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    found = found.withColumnsRenamed({"doc_id": "_hit", "text_key": "_key"})
    same = F.col("doc_id").eqNullSafe(F.col("_hit")) & (F.col("text_key") == F.col("_key"))
    none = F.array().cast("array<string>")
    return counted.join(found, same, "left").select(
        "doc_id", "text_key", "n_words",
        F.coalesce(_covered("spans"), F.lit(0)).cast("long").alias("n_hit"),
        F.array_sort(F.coalesce("items", none)).alias("items"), "spans",
        F.coalesce(F.size("spans") > 0, F.lit(False)).alias("contaminated"))


def digests(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    return judged(docs, benchmark, width).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """docs without the rows that hold a benchmark window, all columns as they are."""
    found = hits(docs, benchmark, width).select(F.col("doc_id").alias("_hit"), F.col("text_key").alias("_key"))
    same = docs["doc_id"].eqNullSafe(found["_hit"]) & (F.xxhash64(docs["text"]) == found["_key"])
    return docs.join(found, same, "left_anti")


def clean_spans(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """docs with every hit word and what parts it from the next one taken out of ``text``."""
    spans = unused(docs, "_spans")
    found = hits(docs, benchmark, width).select(
        F.col("doc_id").alias("_hit"), F.col("text_key").alias("_key"), F.col("spans").alias(spans))
    same = docs["doc_id"].eqNullSafe(found["_hit"]) & (F.xxhash64(docs["text"]) == found["_key"])
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    head = F.regexp_extract(docs["text"], f"^({gap})", 1)
    chunks = F.regexp_extract_all(docs["text"], F.lit(f"({word}{gap})"), 1)
    hit = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1))))
    # The kept chunks are the places that are not hit.
    places = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(chunks) - 1), hit))
    left = bound(chunks, lambda c: F.concat(head, F.array_join(F.transform(places, lambda i: c[i]), "")))
    joined = docs.join(found, same, "left")
    return joined.select(*(F.when(F.size(spans) > 0, left).otherwise(docs["text"]).alias("text")
                           if c == "text" else docs[c] for c in docs.columns))
