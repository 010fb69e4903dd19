"""Publisher labels: ordered tiers, variants in one pass, groups, keywords, classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewire import fixed_values as fixed
from tidewire.functions import columns as c

VARIANTS = [
    "baseline", "register_only", "no_language_tier", "language_first", "with_aggregators",
]

# Each tier is an ordered list of (test name, label); a variant is an order of tiers.
_TIERS = {
    "aggregator": ["AGGREGATOR"],
    "register": ["UA", "RU_STATE", "RU_INDEP", "WEST"],
    "country": ["UA", "RU_OTHER", "WEST"],
    "language": ["EN_GLOBAL", "UA", "RU_OTHER"],
}

_ORDERS = {
    "baseline": ["aggregator", "register", "country", "language"],
    "register_only": ["aggregator", "register"],
    "no_language_tier": ["aggregator", "register", "country"],
    "language_first": ["aggregator", "language", "register", "country"],
    "with_aggregators": ["register", "country", "language"],
}

_REGISTER = {
    "UA": fixed.UA_DOMAINS, "RU_STATE": fixed.RU_STATE, "RU_INDEP": fixed.RU_INDEP,
    "WEST": fixed.WEST_DOMAINS,
}


def _tests(tier: str, domain: Column, lang: Column) -> list[tuple[Column, str]]:
    labels = _TIERS[tier]
    if tier == "aggregator":
        found = [domain.isin(fixed.AGGREGATORS)]
    elif tier == "register":
        found = [domain.isin(_REGISTER[name]) for name in labels]
    elif tier == "country":
        # The listed codes are plain lower-case letters, so the text after the last dot
        # decides membership without a regular expression per row.
        last = F.substring_index(domain, ".", -1)
        found = [domain.endswith(".ua"), domain.endswith(".ru"),
                 domain.contains(".") & last.isin(fixed.WEST_TLDS)]
    else:
        found = [lang.isNull(), lang == "ukr", lang == "rus"]
    return list(zip(found, labels))


def label(domain: Column | str, lang: Column | str, variant: str = "baseline") -> Column:
    """The label of a publisher under one rule order; the first match wins.

    Written as one ``CASE`` over literal sets: the register is about 90 names, the
    sets compile to hash lookups, and no join or shuffle is needed.
    """
    if variant not in _ORDERS:
        raise ValueError(f"unknown variant: {variant}")
    domain = F.col(domain) if isinstance(domain, str) else domain
    lang = F.col(lang) if isinstance(lang, str) else lang
    out = None
    for tier in _ORDERS[variant]:
        for test, name in _tests(tier, domain, lang):
            out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("OTHER")


def with_label(articles: DataFrame, variant: str = "baseline") -> DataFrame:
    """Adds ``ecosystem``. The language is a column of its own, so it is read once per row."""
    tagged = articles.withColumn("src_lang", c.src_lang("translation_info"))
    return tagged.withColumn("ecosystem", label("publisher", "src_lang", variant)).drop("src_lang")


def without_aggregators(articles: DataFrame) -> DataFrame:
    """Drop aggregators by name. The test reaches the scan, while a test on the label would
    make every row work out its label twice."""
    listed = F.coalesce(F.col("publisher").isin(fixed.AGGREGATORS), F.lit(False))
    return articles.filter(~listed)


def with_variants(articles: DataFrame, variants: Sequence[str] = VARIANTS) -> DataFrame:
    """Every rule order from one scan: one row per (article, variant).

    The rows multiply after the scan and before the map-side aggregation, so only
    (day, variant, label) partial sums reach the shuffle.
    """
    lang = c.src_lang("translation_info")
    tagged = articles.withColumn("src_lang", lang)
    pairs = F.array(*[
        F.struct(F.lit(v).alias("variant"), label("publisher", "src_lang", v).alias("ecosystem"))
        for v in variants
    ])
    kept = [F.col(name) for name in articles.columns]
    return tagged.select(*kept, F.inline(pairs))


def exclude_labels(labelled: DataFrame, labels: Sequence[str] = ("AGGREGATOR",)) -> DataFrame:
    return labelled.filter(~F.col("ecosystem").isin(list(labels)))


# --- lookup-driven grouping ------------------------------------------------------

def lookup(spark, groups: Mapping[str, Sequence[str]], key: str, value: str) -> DataFrame:
    """A (key, value) table from config lists. Config lists are short by nature."""
    rows = [(k, name) for name, keys in groups.items() for k in keys]
    return spark.createDataFrame(rows, f"{key} string, {value} string")


def hybrid_group(
    articles: DataFrame, domains: DataFrame, publisher_country: DataFrame,
    countries: DataFrame, min_confidence: float = 0.0,
) -> DataFrame:
    """Group by domain list, then majority country, then TLD, else other.

    ``publisher_country`` has one row per publisher and grows with the corpus, so the
    join strategy is left to the optimizer; the two config lookups are short.
    """
    voted = publisher_country.filter(F.col("confidence") >= min_confidence).join(
        F.broadcast(countries.withColumnRenamed("group", "country_group")), "country", "left"
    ).select("publisher", F.coalesce("country_group", F.lit("other")).alias("country_group"))
    by_name = F.broadcast(domains.withColumnRenamed("group", "domain_group"))
    joined = articles.join(by_name, "publisher", "left").join(voted, "publisher", "left")
    joined = joined.withColumn("tld_group", tld_group("publisher"))
    return (
        joined.withColumn(
            "source_group",
            F.coalesce("domain_group", "country_group", "tld_group", F.lit("other")),
        )
        .withColumn(
            "method",
            F.when(F.col("domain_group").isNotNull(), "domain")
            .when(F.col("country_group").isNotNull(), "country")
            .when(F.col("tld_group").isNotNull(), "tld")
            .otherwise("none"),
        )
    )


def tld_group(domain: Column | str) -> Column:
    t = c.tld(domain)
    return (
        F.when(t == "ua", "ukrainian").when(t == "ru", "russian")
        .when(t.isin(fixed.WEST_TLDS), "western")
    )


STRATEGIES = ["domain_only", "tld_only", "country_only", "hybrid", "hybrid_no_tld"]


def strategy_groups(grouped: DataFrame) -> DataFrame:
    """Five assignment strategies from the columns :func:`hybrid_group` leaves behind."""
    other = F.lit("other")
    choice = {
        "domain_only": F.coalesce("domain_group", other),
        "tld_only": F.coalesce("tld_group", other),
        "country_only": F.coalesce("country_group", other),
        "hybrid": F.coalesce("domain_group", "country_group", "tld_group", other),
        "hybrid_no_tld": F.coalesce("domain_group", "country_group", other),
    }
    pairs = F.array(*[
        F.struct(F.lit(name).alias("strategy"), choice[name].alias("strategy_group"))
        for name in STRATEGIES
    ])
    return grouped.select("*", F.inline(pairs))


def drop_internal_hosts(df: DataFrame, host: str = "publisher") -> DataFrame:
    """Leave out social and hosting platforms; a NULL host is kept."""
    listed = F.col(host).isin(fixed.INTERNAL_HOSTS)
    return df.filter(~F.coalesce(listed, F.lit(False)))


_APART = r"[^\p{L}\p{N}]+"  # what stands between tokens


def keyword_table(spark: SparkSession, queries: Sequence[dict]) -> DataFrame:
    """(lang, query, kind, word, size, hash, pattern, needs_weapon): the keywords of all queries.

    A keyword is found by the hash of its tokens. One that is not a single token is tested again
    by ``pattern``, as what stands between its tokens counts too.
    """
    rows = [(code, q["name"], kind, w.lower(), rf"(^|[^\p{{L}}\p{{N}}]){_quote(w.lower())}($|[^\p{{L}}\p{{N}}])",
             code in q.get("weapon", {}))
            for q in queries for kind in ("any", "weapon") for code, words in q.get(kind, {}).items()
            for w in words if code in q["any"]]
    table = spark.createDataFrame(rows, "lang string, query string, kind string, word string, pattern string, needs_weapon boolean")
    tokens = F.filter(F.split("word", _APART), lambda t: t != "")
    keyed = table.withColumn("_t", tokens)
    return keyed.withColumns({"size": F.size("_t"), "hash": F.xxhash64("_t"), "exact": F.rlike("word", F.lit(r"^[\p{L}\p{N}]+$"))}).drop("_t")


def keyword_queries(
    texts: DataFrame, queries: Sequence[dict], key: str, text: str = "text", lang: str = "lang", most_broadcast: int = 500_000,
) -> DataFrame:
    """(key, query): every query that a text matches: any subject word and, if the query lists
    weapon words for that language, any of those too.

    ``queries`` is config: ``name``, ``any`` and ``weapon`` as language -> words. Words match as
    whole words, ignoring case, over the whole text; ``key`` names each text once.

    One pass lays out the distinct token windows of a text, of the sizes that keywords have, and
    probes the table of keywords with their hashes. So the cost does not grow with the number of
    keywords. Hits alone leave the pass. The table is broadcast while it has at most
    ``most_broadcast`` keywords, beyond that both sides are shuffled.
    """
    spark = texts.sparkSession
    table = keyword_table(spark, queries)
    found_sizes = [r["size"] for r in table.select("size").distinct().collect()]
    if 0 in found_sizes:
        raise ValueError("a keyword without a letter or digit can't be found")
    n = sum(len(words) for q in queries for kind in ("any", "weapon") for words in q.get(kind, {}).values())
    probe = F.broadcast(table) if n <= most_broadcast else table
    tokens = F.filter(F.split(F.lower(text), _APART), lambda t: t != "")

    def windows_of(t: Column, k: int) -> Column:  # tokens are taken one by one, as a slice copies its whole array
        places = F.sequence(F.lit(0), F.size(t) - k)
        made = F.transform(places, lambda i: F.xxhash64(*[F.get(t, i + j) for j in range(k)]))
        return F.when(F.size(t) >= k, made).otherwise(F.array().cast("array<bigint>"))

    # A value named inside a lambda is computed again for each element, so it is bound first.
    windows = F.transform(F.array(tokens), lambda t: F.array_distinct(
        F.flatten(F.array(*[windows_of(t, k) for k in sorted(found_sizes)]))))[0]
    spread = texts.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(lang).alias("lang"), F.explode(windows).alias("hash"))
    hits = spread.join(probe, ["lang", "hash"]).select("_key", "query", "kind", "needs_weapon", "exact", "pattern")
    loose = hits.filter("NOT exact").join(texts.select(F.col(key).alias("_key"), F.lower(text).alias("_text")), "_key").filter(
        F.rlike("_text", F.col("pattern")))
    columns = ["_key", "query", "kind", "needs_weapon"]
    sure = hits.filter("exact").select(*columns).unionByName(loose.select(*columns))
    both = sure.groupBy("_key", "query").agg(
        F.bool_or(F.col("kind") == "any").alias("any"), F.bool_or(F.col("kind") == "weapon").alias("weapon"), F.bool_or("needs_weapon").alias("needs"))
    return both.filter("any AND (weapon OR NOT needs)").select(F.col("_key").alias(key), "query")


def _quote(word: str) -> str:
    return "".join("\\" + ch if not (ch.isalnum() or ch == " ") else ch for ch in word)


def weapon_class(model: Column | str, rules: Sequence[tuple[str, str, bool]]) -> Column:
    """Class of a model string: an exact override, else the first class by priority
    whose keyword occurs, else ``other``. Case is ignored in any script.

    ``rules`` is config, ``(keyword, class, exact)``; it becomes one literal array, so
    the records are classified in place without a join.
    """
    m = F.lower(F.col(model) if isinstance(model, str) else model)
    table = F.array(*[
        F.struct(
            F.lit(0 if exact else 1).alias("tier"),
            F.lit(fixed.WEAPON_CLASSES.index(name)).alias("priority"),
            F.lit(name).alias("class"),
            F.lit(keyword.lower()).alias("keyword"),
        )
        for keyword, name, exact in rules
    ])
    hits = F.filter(
        table,
        lambda r: F.when(r["tier"] == 0, m == r["keyword"]).otherwise(m.contains(r["keyword"])),
    )
    return F.coalesce(F.array_min(hits)["class"], F.lit("other"))


def columns_like(
    df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (),
    prefix: Sequence[str] = (), suffix: Sequence[str] = (),
) -> list[str]:
    """Column names chosen by name rule, in table order."""
    def keep(name: str) -> bool:
        low = name.lower()
        return (
            (not include or any(k in low for k in include))
            and not any(k in name for k in exclude)
            and (not prefix or name.startswith(tuple(prefix)))
            and (not suffix or name.endswith(tuple(suffix)))
        )
    return [name for name in df.columns if keep(name)]


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(ids, feature, value) rows from a wide block."""
    typed = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    return typed.unpivot(list(ids), list(values), "feature", "value")


def country_votes(articles: DataFrame) -> DataFrame:
    """Majority country per publisher with its share of that publisher's articles.

    Two aggregations with map-side combine: the second sees one row per
    (publisher, country), so a dominant publisher does not become a large group.
    """
    counts = articles.groupBy("publisher", "country").agg(F.count("*").alias("n"))
    order = F.struct(-F.col("n"), F.col("country"))
    top = counts.groupBy("publisher").agg(
        F.min_by("country", order).alias("country"),
        F.max("n").alias("n_top"),
        F.sum("n").alias("n_articles"),
    )
    return top.withColumn("confidence", F.col("n_top") / F.col("n_articles"))


def first_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole row per key: the smallest by ``order``, which must be total.

    An aggregate, not a window: rows of a hot key combine before the shuffle.
    """
    row = F.struct(*df.columns)
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("row"))
    return best.select("row.*")


def top_in_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
) -> DataFrame:
    """The first ``k`` rows of every group.

    Spark cuts each group to ``k`` before the shuffle (window group limit), so a large
    group does not travel whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
