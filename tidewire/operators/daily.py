"""Fact table to daily tables. Every step is one scan and one map-side aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewire import fixed_values as fixed
from tidewire.functions import columns as c
from tidewire.operators import labelling


def _facts(articles: DataFrame) -> DataFrame:
    return articles.filter(F.col("publisher").isNotNull()).withColumns({
        "is_conflict": F.coalesce(c.is_conflict("locations"), F.lit(False)),
        "tone": c.lead_tone("v2tone"),
    })


def coverage_measures() -> list[Column]:
    conflict = F.col("is_conflict")
    return [
        F.count("*").alias("n_total"),
        F.count_if(conflict).alias("n_conflict"),
        F.try_divide(F.count_if(conflict), F.count("*")).alias("share"),
        F.avg(F.when(conflict, F.col("tone"))).alias("tone_conflict"),
        F.avg("tone").alias("tone_all"),
    ]


def daily_labels(articles: DataFrame, variant: str = "baseline") -> DataFrame:
    """(day, ecosystem): volume, conflict volume, its share, and mean tones."""
    facts = _facts(articles)
    if variant != "with_aggregators":
        facts = labelling.without_aggregators(facts)
    kept = labelling.with_label(facts, variant)
    return kept.groupBy("day", "ecosystem").agg(*coverage_measures())


def daily_variants(articles: DataFrame, variants: Sequence[str] = labelling.VARIANTS) -> DataFrame:
    """The same measures under every rule order, from one scan."""
    facts = _facts(articles).select(
        "day", "publisher", "translation_info", "is_conflict", "tone"
    )
    kept = labelling.exclude_labels(labelling.with_variants(facts, variants))
    return kept.groupBy("day", "variant", "ecosystem").agg(*coverage_measures())


def daily_threat_act(articles: DataFrame) -> DataFrame:
    """(day, ecosystem): act and threat counts and shares within conflict coverage."""
    conflict = labelling.without_aggregators(articles).filter(
        F.col("publisher").isNotNull() & F.col("themes").isNotNull() & c.is_conflict("locations")
    ).withColumns({
        "is_act": c.has_theme("themes", fixed.ACT_THEMES),
        "is_threat": c.has_theme("themes", fixed.THREAT_THEMES),
    })
    # The label test reads a flag that is aggregated with the rest. On the label itself it would be pushed
    # into the fact scan, where every article would work out its publisher once per set and its label twice.
    n = F.count("*")
    out = labelling.with_label(conflict).groupBy("day", "ecosystem").agg(
        n.alias("n_conflict"),
        F.count_if("is_act").alias("n_act"),
        F.count_if("is_threat").alias("n_threat"),
        F.try_divide(F.count_if("is_act"), n).alias("act_share"),
        F.try_divide(F.count_if("is_threat"), n).alias("threat_share"),
        F.bool_or(~F.col("ecosystem").isin("AGGREGATOR", "OTHER")).alias("_wanted"),
    )
    return out.filter("_wanted").drop("_wanted")


def publisher_counts(articles: DataFrame, days: Sequence[str] | None = None) -> DataFrame:
    """Articles on conflict by (domain, tld, language)."""
    rows = articles.filter(F.col("publisher").isNotNull() & c.is_conflict("locations"))
    if days:
        rows = rows.filter(F.col("day").isin([F.lit(d).cast("date") for d in days]))
    return rows.groupBy(
        F.col("publisher").alias("domain"), c.tld("publisher").alias("tld"),
        c.src_lang("translation_info").alias("srclc"),
    ).agg(F.count("*").alias("n"))


def top_publishers(articles: DataFrame, days: Sequence[str] | None, limit: int) -> DataFrame:
    """Largest publishers of conflict coverage by (domain, tld, language)."""
    counts = publisher_counts(articles, days)
    order = [F.desc("n"), F.asc("domain"), F.asc_nulls_first("srclc")]
    return counts.orderBy(*order).limit(limit)


def language_mix(articles: DataFrame, limit: int = 15) -> DataFrame:
    """Articles by source language, the largest first."""
    counts = articles.groupBy(c.src_lang("translation_info").alias("srclc")).agg(
        F.count("*").alias("n")
    )
    return counts.orderBy(F.desc("n"), F.asc_nulls_first("srclc")).limit(limit)


def language_coverage(articles: DataFrame) -> DataFrame:
    """Per day: Russian, Ukrainian, native English and all articles."""
    lang = c.src_lang("translation_info")
    info = F.col("translation_info")
    return articles.groupBy("day").agg(
        F.count_if(lang == "rus").alias("rus"),
        F.count_if(lang == "ukr").alias("ukr"),
        F.count_if(info.isNull() | (info == "")).alias("eng_native"),
        F.count("*").alias("total"),
    )


def multilingual_publishers(outlets: DataFrame, tld: str, k: int = 20) -> DataFrame:
    """Publishers with more than one language among a TLD's top ``k`` rows."""
    order = [F.desc("n"), F.asc("domain"), F.asc_nulls_first("srclc")]
    top = outlets.filter(F.col("tld") == tld).orderBy(*order).limit(k)
    langs = top.groupBy("domain").agg(F.count_distinct("srclc").alias("n_languages"))
    return langs.filter(F.col("n_languages") > 1)


def stream_composition(records: DataFrame) -> DataFrame:
    """Counts per file, per (file, tld) and per (file, language) in one pass."""
    sets = records.groupingSets(
        [("file",), ("file", "tld"), ("file", "lang")], "file", "tld", "lang"
    ).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("tld").isin("ru", "ua")).alias("n_ru_ua"),
        F.grouping("tld").cast("int").alias("tld_rolled"),
        F.grouping("lang").cast("int").alias("lang_rolled"),
    )
    level = (
        F.when((F.col("tld_rolled") == 1) & (F.col("lang_rolled") == 1), "file")
        .when(F.col("lang_rolled") == 1, "tld").otherwise("lang")
    )
    return sets.select("file", level.alias("level"),
                       F.coalesce("tld", "lang").alias("key"), "n", "n_ru_ua")


def fixed_panel_shift(
    articles: DataFrame, event: str, span: tuple[str, str], labels: Sequence[str],
    min_articles: int,
) -> DataFrame:
    """Per publisher: mean conflict tone before and after an event day.

    Only publishers with at least ``min_articles`` on both sides enter the panel. The
    two sides are conditional aggregates of one pass, so no pivot is needed.
    """
    after = F.col("day") >= F.lit(event).cast("date")
    inside = F.col("day").between(F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date"))
    facts = labelling.with_label(_facts(articles).filter("is_conflict").filter(inside))
    sides = facts.filter(F.col("ecosystem").isin(list(labels))).groupBy(
        "ecosystem", "publisher"
    ).agg(
        F.count_if(~after).alias("n_pre"), F.count_if(after).alias("n_post"),
        F.avg(F.when(~after, F.col("tone"))).alias("tone_pre"),
        F.avg(F.when(after, F.col("tone"))).alias("tone_post"),
    )
    panel = sides.filter(
        (F.col("n_pre") >= min_articles) & (F.col("n_post") >= min_articles)
        & F.col("tone_pre").isNotNull() & F.col("tone_post").isNotNull()
    )
    return panel.withColumn("shift", F.col("tone_post") - F.col("tone_pre"))


def shift_summary(panel: DataFrame) -> DataFrame:
    return panel.groupBy("ecosystem").agg(
        F.count("*").alias("n_outlets"), F.avg("tone_pre").alias("tone_pre"),
        F.avg("tone_post").alias("tone_post"), F.avg("shift").alias("shift"),
    )


def event_table(records: DataFrame, calendar: DataFrame) -> DataFrame:
    """Daily event table from wave records, with explicit zero days.

    A wave counts on the day it ends. ``records`` holds ``time_start, time_end,
    launched, destroyed, weapon_class``; negative counts are unknown.
    """
    seen = F.greatest(F.to_date("time_start"), F.to_date("time_end"))
    launched = F.when(F.col("launched") >= 0, F.col("launched")).cast("bigint")
    destroyed = F.when(F.col("destroyed") >= 0, F.col("destroyed")).cast("bigint")
    rows = records.select(
        seen.alias("day"), "weapon_class",
        launched.alias("launched"), destroyed.alias("destroyed"),
    )
    sums = [F.sum("launched").alias("launched_total"), F.sum("destroyed").alias("destroyed_total")]
    for name in fixed.WEAPON_CLASSES:
        mine = F.col("weapon_class") == name
        sums.append(F.sum(F.when(mine, F.col("launched"))).alias(f"launched_{name}"))
        sums.append(F.sum(F.when(mine, F.col("destroyed"))).alias(f"destroyed_{name}"))
    daily = rows.groupBy("day").agg(*sums, F.count("*").alias("n_attack_events"))
    counts = [x for x in daily.columns if x != "day"]
    dense = calendar.join(daily, "day", "left").select(
        "day", *[F.coalesce(x, F.lit(0)).alias(x) for x in counts]
    )
    total = F.col("launched_total")
    squares = sum(
        (F.try_divide(F.col(f"launched_{n}"), total) * F.try_divide(F.col(f"launched_{n}"), total)
         for n in fixed.WEAPON_CLASSES), F.lit(0.0),
    )
    return dense.withColumns({
        "interception_rate": F.try_divide(F.col("destroyed_total"), total),
        "weapon_diversity": F.when(total > 0, 1.0 - squares),
        "war_intensity": F.ln(1.0 + total),
    })
