"""Operator 7: quality rules and robust multivariate outliers. JVM expressions only.

Each document gives a vector of transformed statistics. For each language and source, the minimum
covariance determinant is sought by concentration steps from two starts (median and MAD, and the
spatial sign covariance): estimate mean and covariance on the closest share of rows, measure
Mahalanobis distances, take the closest rows again, until no determinant falls by more than two percent. The better
start is made consistent, reweighted once, and documents too far from it are rejected.

A step sees rows only through sums per group and counts per group and distance bin, so a group of
any size stays spread; the closest share is the smallest whole number of bins that holds it.
Sources under ``least_rows`` are pooled by language, languages still under it together. Variances
have a floor, for statistics that are nearly always 0.

Windows are compared by 64-bit hashes. Defined cases: null and empty texts have no words and fail
the base rule; null languages and sources are groups of their own; repeated rows are judged each;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewire.llm.common import bound, split_words, written

SYMBOLS = "#*$%&|<>"  # fixed value of the contract
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜ"
WINDOW = 5


def repeated_words(words: Column) -> Column:
    """Words inside windows of 5 that occur twice or more in the text. Words are taken one by one,
    as a slice copies its whole array."""
    def places(h: Column) -> Column:
        marked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twins = bound(marked, lambda s: F.filter(s, lambda x, i: (
            (i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(F.array_sort(F.transform(twins, lambda x: x["i"])), start, lambda s, p: F.struct(
            (p + WINDOW).alias("upto"), (s["n"] + p + WINDOW - F.greatest(s["upto"], p)).alias("n")), lambda s: s["n"])

    hashes = bound(words, lambda w: F.when(F.size(w) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))).otherwise(
            F.array().cast("array<bigint>")))
    return bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(places(h)))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, lang, source, counts of the base rule and of the statistics)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.xxhash64("text", "lang", "source").alias("row_key"), "lang", "source",
                       text.alias("text"), split_words(F.col("text")).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return base.select(
        "doc_id", "row_key", "lang", "source", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        (F.length("text") - F.length(F.translate("text", UPPER, ""))).cast("long").alias("n_upper"),
        (F.length("text") - F.length(F.translate("text", "!?;:", ""))).cast("long").alias("n_marks"),
    ).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def vector() -> list[Column]:
    """The transformed statistics. Each share is drawn towards a usual value as if by some more
    words or lines of it, so that short texts do not stand out by chance."""
    chars, words = F.col("word_chars").cast("double"), F.col("n_words").cast("double")
    return [
        F.log((chars + 300) / (words + 60)),
        F.sqrt(100 * F.col("n_symbols") / (chars + 100)),
        F.sqrt(100 * F.col("n_dup_lines") / (F.col("n_lines") + 20)),
        F.sqrt(100 * F.col("n_repeat_words") / (words + 100)),
        F.sqrt(100 * F.col("n_upper") / (chars + 300)),
        F.sqrt(100 * F.col("n_marks") / (chars + 100)),
    ]


FLOORS = [0.08, 0.4, 1.0, 0.8, 0.4, 0.4]  # least standard deviations of the vector, in its units
BINS = 48  # distance bins for each factor e


def chi_square_quantile(p: float, k: int) -> float:
    """By bisection on the series of the incomplete gamma function."""
    def below(x: float) -> float:
        if x <= 0:
            return 0.0
        term = total = 1 / (k / 2)
        n = 0
        while term > total * 1e-16:
            n += 1
            term *= x / 2 / (k / 2 + n)
            total += term
        return total * math.exp(-x / 2 + k / 2 * math.log(x / 2) - math.lgamma(k / 2))

    low, high = 0.0, 10.0 * k + 400
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def consistency(share: float, k: int) -> float:
    """What the covariance of the closest share is multiplied by to fit a normal distribution."""
    cut = chi_square_quantile(share, k)
    low, high = 0.0, 1.0
    for _ in range(60):  # the share of a chi-square with two more degrees below the same cut
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_quantile(mid, k + 2) < cut else (low, mid)
    return share / high


def inverted(matrix: Column, k: int) -> Column:
    """(m, logdet): inverse and log determinant of a k x k covariance given row by row, by sweeps."""
    def sweep(s: Column, p: Column) -> Column:
        m = s["m"]
        d = F.get(m, p * k + p)
        cell = lambda v, at: F.when(
            (at.cast("int") == p * k + p), 1 / d).when(
            F.expr("1") * F.floor(at / k) == p, v / d).when(
            at % k == p, -v / d).otherwise(v - F.get(m, (F.floor(at / k) * k + p).cast("int")) * F.get(m, (p * k + at % k).cast("int")) / d)
        return F.struct(F.transform(m, cell).alias("m"), (s["logdet"] + F.log(d)).alias("logdet"))

    start = F.struct(matrix.alias("m"), F.lit(0.0).alias("logdet"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), start, sweep)


def _distance(x: str, mean: str, inverse: str, k: int) -> Column:
    """Squared Mahalanobis distance."""
    gap = [F.get(F.col(x), F.lit(i)) - F.get(F.col(mean), F.lit(i)) for i in range(k)]
    return sum((F.get(F.col(inverse), F.lit(i * k + j)) * gap[i] * gap[j] * (1 if i == j else 2)
                for i in range(k) for j in range(i, k)), F.lit(0.0))


def _bin(distance: Column) -> Column:
    return F.floor(F.log(F.greatest(distance, F.lit(1e-6))) * BINS).cast("int")


def _estimated(rows: DataFrame, keys: list[str], k: int, floors: list[float], factor: float = 1.0) -> DataFrame:
    """(keys, n, mean, inverse, logdet) of each group, from sums."""
    x = [F.get(F.col("x"), F.lit(i)) for i in range(k)]
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.array(*(F.avg(c) for c in x)).alias("mean"),
        F.array(*(F.avg(x[min(i, j)] * x[max(i, j)]) for i in range(k) for j in range(k))).alias("square"))
    cell = F.array(*(F.get(F.col("square"), F.lit(i * k + j)) - F.get(F.col("mean"), F.lit(i)) * F.get(F.col("mean"), F.lit(j))
                     for i in range(k) for j in range(k)))
    least = F.array(*(F.lit(floors[i] ** 2 if i == j else 0.0) for i in range(k) for j in range(k)))
    covariance = F.zip_with(cell, least, lambda c, f: c * factor + f)
    return sums.select(*keys, "n", "mean", inverted(covariance, k).alias("e")).select(*keys, "n", "mean", F.col("e.m").alias("inverse"), "e.logdet")


def _medians(rows: DataFrame, k: int, step: float = 0.01) -> DataFrame:
    """(grp, med): medians of each dimension, to a hundredth, from counts of rounded values."""
    long = rows.select("grp", F.posexplode("x").alias("d", "v")).select("grp", "d", F.round(F.col("v") / step).cast("long").alias("b"))
    counts = long.groupBy("grp", "d", "b").agg(F.count("*").alias("c"))
    by = W.partitionBy("grp", "d")
    half = counts.select("grp", "d", "b", F.sum("c").over(by.orderBy("b")).alias("upto"), F.sum("c").over(by).alias("n"))
    mids = half.filter("2 * upto >= n").groupBy("grp", "d").agg((F.min("b") * step).alias("m"))
    return mids.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("m")).select(
        "grp", F.transform("m", lambda x: x["m"]).alias("med"))


def minimum_covariance(
    rows: DataFrame, k: int, floors: list[float], share: float = 0.75, least_fall: float = 0.02,
) -> DataFrame:
    """(grp, mean, inverse): the reweighted estimate of each group of ``rows`` (grp, x)."""
    med = written(_medians(rows, k))
    centred = rows.join(med, "grp").withColumn("gap", F.zip_with("x", "med", lambda a, b: a - b))
    mad = _medians(centred.select("grp", F.transform("gap", F.abs).alias("x")), k).withColumnRenamed("med", "mad")
    scale = med.join(mad, "grp").select("grp", "med", F.zip_with(
        "mad", F.array(*map(F.lit, floors)), lambda m, f: m * m * 2.2 + f * f).alias("variance"))
    flat = F.array(*((1 / F.get(F.col("variance"), F.lit(i))) if i == j else F.lit(0.0) for i in range(k) for j in range(k)))
    plain = scale.select("grp", F.lit(0).alias("start"), F.col("med").alias("mean"), flat.alias("inverse"), F.lit(1e300).alias("logdet"))
    signs = rows.join(scale, "grp").withColumn("z", F.transform(
        F.arrays_zip("x", "med", "variance"), lambda a: (a["x"] - a["med"]) / F.sqrt(a["variance"])))
    norm = F.greatest(F.sqrt(F.aggregate("z", F.lit(0.0), lambda t, v: t + v * v)), F.lit(1e-6))
    signs = signs.withColumn("r", norm).select("grp", F.transform(
        F.arrays_zip("z", "variance"), lambda a: a["z"] / F.col("r") * F.sqrt(a["variance"])).alias("x"))
    signs = _estimated(signs, ["grp"], k, floors).join(med, "grp").select(
        "grp", F.lit(1).alias("start"), F.col("med").alias("mean"), "inverse", F.lit(1e300).alias("logdet"))
    now = written(plain.unionByName(signs))

    while True:
        near = _closest(rows, now, k, share)
        step = written(_estimated(near, ["grp", "start"], k, floors).drop("n").join(
            now.select("grp", "start", F.col("logdet").alias("was")), ["grp", "start"]))
        falling = step.filter(F.col("logdet") < F.col("was") - least_fall).limit(1).count()
        now = step.drop("was")
        if not falling:
            break
    best = now.groupBy("grp").agg(F.min_by(F.struct("mean", "inverse"), F.struct("logdet", "start")).alias("b"))
    factor = consistency(share, k)
    raw = written(best.select("grp", "b.mean", F.transform("b.inverse", lambda v: v / factor).alias("inverse")))
    cut = chi_square_quantile(0.975, k)
    heavy = rows.join(raw, "grp").filter(_distance("x", "mean", "inverse", k) <= cut).select("grp", "x")
    return _estimated(heavy, ["grp"], k, floors, consistency(0.975, k)).select("grp", "mean", "inverse")


def _closest(rows: DataFrame, now: DataFrame, k: int, share: float) -> DataFrame:
    """The rows in the smallest whole number of distance bins that holds the share, for each start."""
    far = rows.join(now, "grp").select("grp", "start", "x", _bin(_distance("x", "mean", "inverse", k)).alias("b"))
    counts = far.groupBy("grp", "start", "b").agg(F.count("*").alias("c"))
    by = W.partitionBy("grp", "start")
    run = counts.select("grp", "start", "b", F.sum("c").over(by.orderBy("b")).alias("upto"), F.sum("c").over(by).alias("n"))
    cut = run.filter(F.col("upto") >= F.col("n") * share).groupBy("grp", "start").agg(F.min("b").alias("cut"))
    return far.join(cut, ["grp", "start"]).filter("b <= cut").select("grp", "start", "x")


def judged(docs: DataFrame, least_rows: int = 200, tail: float = 1e-5, share: float = 0.75) -> DataFrame:
    """(doc_id, row_key, counts, base_failed, distance, kept), one row a document.

    ``distance`` is the squared Mahalanobis distance (null where the base rule fails), rejected over
    the quantile 1 - ``tail`` of the chi-square distribution.
    """
    x = vector()
    k = len(x)
    names = ["doc_id", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    stats = written(statistics(docs).select(*names, "lang", "source", F.array(*x).alias("x")))
    fine = stats.filter("NOT base_failed")
    counts = fine.groupBy("lang", "source").agg(F.count("*").alias("c"))
    counts = written(counts)
    of_lang = counts.filter(F.col("c") < least_rows).groupBy(F.col("lang").alias("_l")).agg(F.sum("c").alias("l"))
    joined = counts.join(of_lang, counts["lang"].eqNullSafe(of_lang["_l"]), "left").drop("_l")
    name = lambda *c: F.to_json(F.array(*(F.coalesce(x.cast("string"), F.lit("\0")) for x in c)))
    grp = F.when(F.col("c") >= least_rows, name(F.col("lang"), F.col("source"))).when(
        F.coalesce("l", F.lit(0)) >= least_rows, name(F.col("lang"))).otherwise(F.lit("all"))
    groups = written(joined.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), grp.alias("grp")))
    same = fine["lang"].eqNullSafe(groups["_lang"]) & fine["source"].eqNullSafe(groups["_source"])
    rows = fine.join(groups, same).select(*names, "grp", "x")
    estimate = written(minimum_covariance(rows.select("grp", "x"), k, FLOORS, share))
    cut = chi_square_quantile(1 - tail, k)
    far = rows.join(estimate, "grp", "left").withColumn("distance", _distance("x", "mean", "inverse", k))
    far = far.select(*names, "distance", (F.col("distance") <= cut).alias("kept"))
    failed = stats.filter("base_failed").select(*names, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return far.unionByName(failed)


def kept_documents(docs: DataFrame, **settings) -> DataFrame:
    """docs without the rows that the rules reject, all columns as they are."""
    bad = judged(docs, **settings).filter("NOT kept").select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"], docs["lang"], docs["source"]) == bad["_key"])
    return docs.join(bad, same, "left_anti")
