"""Article scans, declared schemas, and feed-file readers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewire import fixed_values as fixed
from tidewire.functions import columns as c

Span = tuple[str, str]

DAILY_SCHEMAS = {
    "ecosystem": T.StructType([
        T.StructField("day", T.DateType()),
        T.StructField("ecosystem", T.StringType()),
        T.StructField("n_total", T.LongType()),
        T.StructField("n_conflict", T.LongType()),
        T.StructField("share", T.DoubleType()),
        T.StructField("tone_conflict", T.DoubleType()),
        T.StructField("tone_all", T.DoubleType()),
    ]),
    "threat_act": T.StructType([
        T.StructField("day", T.DateType()),
        T.StructField("ecosystem", T.StringType()),
        T.StructField("n_conflict", T.LongType()),
        T.StructField("n_act", T.LongType()),
        T.StructField("n_threat", T.LongType()),
        T.StructField("act_share", T.DoubleType()),
        T.StructField("threat_share", T.DoubleType()),
    ]),
}


def in_spans(day: Column | str, spans: Sequence[Span]) -> Column:
    """Inclusive ranges OR-ed on the bare partition column, so partitions are pruned."""
    d = F.col(day) if isinstance(day, str) else day
    tests = [d.between(F.lit(a).cast("date"), F.lit(b).cast("date")) for a, b in spans]
    return reduce(lambda x, y: x | y, tests)


def scan_articles(articles: DataFrame, spans: Sequence[Span]) -> DataFrame:
    """The listed days only, records with a publisher only."""
    return articles.filter(in_spans("day", spans) & F.col("publisher").isNotNull())


def preset_spans(spark: SparkSession, presets=None) -> DataFrame:
    """Named spans as rows: (preset, target, kind, start, end)."""
    presets = presets or fixed.SPAN_PRESETS
    rows = [
        (name, target, kind, a, b)
        for name, (target, kind, spans) in presets.items() for a, b in spans
    ]
    df = spark.createDataFrame(
        rows, "preset string, target string, kind string, start_text string, end_text string"
    )
    return df.select(
        "preset", "target", "kind",
        F.to_date("start_text").alias("start"), F.to_date("end_text").alias("end"),
    )


def route_to_presets(df: DataFrame, presets: DataFrame, day: str = "day") -> DataFrame:
    """Tag rows with every preset whose span holds their day."""
    from tidewire.operators import intervals

    return intervals.within(df, presets.select("preset", "target", "start", "end"), ["preset", "target"], day)


def normalise(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast and order columns to a declared schema; NaN becomes NULL."""
    out = []
    for f in schema.fields:
        col = F.col(f.name).cast(f.dataType)
        if isinstance(f.dataType, T.DoubleType):
            col = F.when(~F.isnan(col), col)
        out.append(col.alias(f.name))
    return df.select(*out)


def read_feed_v1(lines: DataFrame) -> DataFrame:
    """First feed layout: data lines start with ``20`` and hold at least 11 tab fields;
    field 9 lists hosts joined by ``;``. One row per (record, host), blanks left out."""
    fields = F.split("value", "\t")
    kept = lines.filter(F.col("value").startswith("20") & (F.size(fields) >= 11))
    hosts = F.explode(F.split(F.element_at(fields, 10), ";")).alias("raw_host")
    return (
        kept.select(*[x for x in lines.columns if x != "value"], hosts)
        .filter(F.trim("raw_host") != "")
        .select("*", F.lower(F.trim("raw_host")).alias("host"),
                c.tld_or_blank("raw_host").alias("tld"))
        .drop("raw_host")
    )


def read_feed_v2(lines: DataFrame) -> DataFrame:
    """Second feed layout: at least 26 tab fields; field 3 is the publisher and the first
    field holding ``srclc:`` names the language. No such field means native English."""
    fields = F.split(F.regexp_replace("value", r"\r?\n$", ""), "\t")
    info = F.try_element_at(F.filter(fields, lambda f: f.contains("srclc:")), F.lit(1))
    code = F.element_at(F.split(F.element_at(F.split(info, "srclc:"), 2), ";"), 1)
    kept = lines.filter(F.size(fields) >= 26)
    return kept.select(
        *[x for x in lines.columns if x != "value"],
        F.element_at(fields, 4).alias("publisher"),
        c.tld_or_blank(F.element_at(fields, 4)).alias("tld"),
        F.coalesce(code, F.lit("eng (native)")).alias("lang"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with the file they came from."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
