"""Readers for landed market files: chart payloads, index exports, risk and rate series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewire import fixed_values as fixed
from tidewire.functions import columns as c

CHART_SCHEMA = """
struct<chart: struct<
  result: array<struct<
    timestamp: array<bigint>,
    indicators: struct<
      quote: array<struct<open: array<double>, high: array<double>, low: array<double>,
                          close: array<double>, volume: array<bigint>>>,
      adjclose: array<struct<adjclose: array<double>>>>>>,
  error: string>>
"""


class DuplicateDates(ValueError):
    pass


def _chart(payloads: DataFrame) -> DataFrame:
    parsed = payloads.withColumn("doc", F.from_json("payload", CHART_SCHEMA.replace("\n", " ")))
    return parsed.withColumn("res", F.try_element_at("doc.chart.result", F.lit(1)))


def read_chart_json(payloads: DataFrame) -> DataFrame:
    """(ticker, payload) to daily rows. UTC day, NULL closes dropped, the last row of a
    date wins, ``adjclose`` falls back to ``close``. Bad payloads give no rows here; see
    :func:`chart_rejects`."""
    good = _chart(payloads).filter(F.size("res.timestamp") > 0)
    quote = F.col("res.indicators.quote")[0]
    adj = F.try_element_at("res.indicators.adjclose", F.lit(1))["adjclose"]
    # A missing array would make the whole zip NULL; an empty one is padded instead.
    none = F.array().cast("array<double>")
    bars = F.arrays_zip(
        F.col("res.timestamp").alias("ts"),
        *[F.coalesce(quote[k], none).alias(k) for k in ("open", "high", "low", "close")],
        F.coalesce(quote["volume"], F.array().cast("array<bigint>")).alias("volume"),
        F.coalesce(adj, quote["close"], none).alias("adjclose"),
    )
    rows = good.select("ticker", F.posexplode(bars).alias("pos", "bar"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("bar.ts") / 86400).cast("int"))
    flat = rows.select(
        "ticker", day.alias("date"), "pos",
        *[F.col(f"bar.{k}").alias(k) for k in
          ("open", "high", "low", "close", "volume", "adjclose")],
    ).filter(F.col("close").isNotNull())
    values = [x for x in flat.columns if x not in ("ticker", "date", "pos")]
    last = flat.groupBy("ticker", "date").agg(F.max_by(F.struct(*values), "pos").alias("bar"))
    return last.select("ticker", "date", *[F.col(f"bar.{v}").alias(v) for v in values])


def chart_rejects(payloads: DataFrame) -> DataFrame:
    """Payloads without a result or without timestamps, and why."""
    doc = _chart(payloads)
    reason = (
        F.when(F.col("res").isNull(), "no result in payload")
        .when(F.coalesce(F.size("res.timestamp"), F.lit(0)) < 1, "no timestamps in payload")
    )
    return doc.select("ticker", reason.alias("reason")).filter(F.col("reason").isNotNull())


def export_rows(spark: SparkSession, path: str, columns: int = 3) -> DataFrame:
    """Lines of index exports as (file, rn, c0, c1, ...).

    One export is one index's daily history, a bounded file, so it is read whole to keep
    true line numbers.
    """
    files = spark.read.text(path, wholetext=True)
    lines = files.select(
        F.col("_metadata.file_name").alias("file"),
        F.posexplode(F.split("value", r"\r?\n")).alias("rn", "line"),
    )
    cells = F.split("line", ",")
    return lines.select("file", "rn", *[
        F.try_element_at(cells, F.lit(i + 1)).alias(f"c{i}") for i in range(columns)
    ])


def read_index_export(rows: DataFrame, check: bool = True) -> DataFrame:
    """Skip everything up to the single ``Date`` header of each file; coerce cells; drop
    rows without date or price. ``check`` fails on a missing or second header and on
    duplicate dates, from one small aggregate."""
    is_header = F.trim("c0") == "Date"
    headers = rows.filter(is_header).groupBy("file").agg(
        F.min("rn").alias("header_rn"), F.count("*").alias("n_headers"))
    joined = rows.join(headers, "file", "left")
    body = joined.filter(F.col("rn") > F.col("header_rn")).select(
        "file", F.col("c0").try_cast("date").alias("date"),
        c.number("c1").alias("px"), c.number("c2").alias("volume"),
    ).filter(F.col("date").isNotNull() & F.col("px").isNotNull())
    if check:
        wrong = rows.select("file").distinct().join(headers, "file", "left").filter(
            F.coalesce("n_headers", F.lit(0)) != 1).limit(1).collect()
        if wrong:
            raise ValueError(f"{wrong[0]['file']}: expected exactly one 'Date' header row")
        _fail_on_duplicates(body, ["file", "date"])
    return body


def _fail_on_duplicates(df: DataFrame, keys: Sequence[str]) -> None:
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise DuplicateDates(f"duplicate dates: {twice[0].asDict()}")


def join_series(
    long: DataFrame, names: Sequence[str], key: str = "series", value: str = "value",
    date: str = "date",
) -> DataFrame:
    """One column per named series on the union of dates: a pivot with given values
    instead of a chain of full joins. Keys must be unique per (date, series)."""
    return long.groupBy(date).pivot(key, list(names)).agg(F.first(value, ignorenulls=True))


def read_risk_index(raw: DataFrame, check: bool = True) -> DataFrame:
    """Integer ``YYYYMMDD`` days and three coerced measures."""
    needed = {"DAY", "GPRD", "GPRD_ACT", "GPRD_THREAT"}
    missing = sorted(needed - set(raw.columns))
    if missing:
        raise ValueError(f"risk file is missing expected columns: {missing}")
    out = raw.select(
        F.to_date(F.col("DAY").cast("string"), "yyyyMMdd").alias("date"),
        c.number("GPRD").alias("gpr"), c.number("GPRD_ACT").alias("gpr_act"),
        c.number("GPRD_THREAT").alias("gpr_threat"),
    )
    if check:
        _fail_on_duplicates(out, ["date"])
    return out


def read_rate_series(raw: DataFrame, series_id: str, names: Mapping[str, str] | None = None):
    """Two-column series: the first column is the date under any header; ``.`` is NULL and
    keeps its row; the series takes its mapped name."""
    names = fixed.RATE_NAMES if names is None else names
    date_col = raw.columns[0]
    value_col = series_id if series_id in raw.columns else raw.columns[1]
    return raw.select(
        F.col(date_col).cast("date").alias("date"),
        F.lit(names.get(series_id, series_id.lower())).alias("series"),
        c.number(value_col).alias("value"),
    )


def rate_panel(parts: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """Several rate series as one wide table on date."""
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return join_series(long, names)


def read_exposure_sheet(raw: DataFrame, year: int | None = None) -> DataFrame | None:
    """One yearly sheet, or sheets of all years in one table with a year column: columns are found by keyword, and a sheet without company, arms
    and total columns is skipped."""
    low = {str(x).strip().lower(): x for x in raw.columns}

    def find(*keys: str):
        return next((orig for k, orig in low.items() if all(t in k for t in keys)), None)

    company, country = find("company"), find("country")
    arms = find("arms revenues", str(year)) or find("arms revenues")
    when = F.lit(year) if year is not None else F.col(find("year")).cast("int")
    total = find("total revenues")
    if not (company and arms and total):
        return None
    known = F.col(f"`{country}`") if country else F.lit(None)
    return exposure_shares(raw.select(
        when.alias("year"), F.col(f"`{company}`").alias("company"),
        known.cast("string").alias("country"),
        c.number(F.col(f"`{arms}`").cast("string")).alias("arms"),
        c.number(F.col(f"`{total}`").cast("string")).alias("total"),
    ))


def exposure_shares(rows: DataFrame) -> DataFrame:
    """Name key and arms share bounded to [0, 1]; an unknown total leaves it NULL."""
    named = rows.filter(F.col("company").isNotNull())
    return named.withColumns({
        "key": c.normalise_name("company"),
        "arms_share": c.clip(F.try_divide("arms", "total"), 0.0, 1.0),
    })


def read_exposure_sheets(sheets: Mapping[int, DataFrame]) -> DataFrame:
    parts = [p for p in (read_exposure_sheet(df, y) for y, df in sorted(sheets.items())) if p]
    if not parts:
        raise ValueError("no sheet holds company, arms and total columns")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def match_tickers(revenue: DataFrame, name_map: DataFrame) -> DataFrame:
    """(ticker, year) exposure of mapped firms; unmapped firms are dropped, never guessed.

    Both sides are normalised, so a map key written with a legal suffix still matches.
    """
    keys = name_map.select(c.normalise_name("name").alias("key"), "ticker").distinct()
    matched = revenue.join(F.broadcast(keys), "key")
    return matched.groupBy("ticker", "year").agg(
        F.min("company").alias("company"), F.min_by("country", "company").alias("country"),
        F.sum("arms").alias("arms"), F.max("total").alias("total"),
        F.avg("arms_share").alias("arms_share"),
    )


def exposure_by_ticker(matched: DataFrame) -> DataFrame:
    """One exposure per ticker: the mean share over the years it is known."""
    first = F.struct("year", "company")
    return matched.groupBy("ticker").agg(
        F.min_by("company", first).alias("company"), F.min_by("country", first).alias("country"),
        F.avg("arms_share").alias("arms_share"), F.count_distinct("year").alias("years"),
        F.max("year").alias("last_year"),
    )
