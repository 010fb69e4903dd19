"""Fragments shared by the SQL twins, and the rounding both sides use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tidewire import fixed_values as fixed


def r(col: Column, n: int) -> Column:
    """Rounded value, never negative zero."""
    return F.round(col, n) + F.lit(0.0)


def rr(expr: str, n: int) -> str:
    return f"(round({expr}, {n}) + 0.0)"


def names(values: Sequence[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


LANG = "nullif(regexp_extract(translation_info, 'srclc:([a-zA-Z]+)', 1), '')"
TLD = "nullif(regexp_extract(publisher, '\\.([a-z]+)$', 1), '')"
CONFLICT = "(contains(locations, '#UP#') OR contains(locations, '#RS#'))"
TONE = "TRY_CAST(string_split(v2tone, ',')[1] AS DOUBLE)"

_AGG = f"WHEN publisher IN ({names(fixed.AGGREGATORS)}) THEN 'AGGREGATOR' "
_REG = (
    f"WHEN publisher IN ({names(fixed.UA_DOMAINS)}) THEN 'UA' "
    f"WHEN publisher IN ({names(fixed.RU_STATE)}) THEN 'RU_STATE' "
    f"WHEN publisher IN ({names(fixed.RU_INDEP)}) THEN 'RU_INDEP' "
    f"WHEN publisher IN ({names(fixed.WEST_DOMAINS)}) THEN 'WEST' "
)
_CC = (
    "WHEN publisher LIKE '%.ua' THEN 'UA' WHEN publisher LIKE '%.ru' THEN 'RU_OTHER' "
    f"WHEN {TLD} IN ({names(fixed.WEST_TLDS)}) THEN 'WEST' "
)
_LNG = (
    f"WHEN {LANG} IS NULL THEN 'EN_GLOBAL' WHEN {LANG} = 'ukr' THEN 'UA' "
    f"WHEN {LANG} = 'rus' THEN 'RU_OTHER' "
)


def label_case(variant: str) -> str:
    body = {
        "baseline": _AGG + _REG + _CC + _LNG,
        "register_only": _AGG + _REG,
        "no_language_tier": _AGG + _REG + _CC,
        "language_first": _AGG + _LNG + _REG + _CC,
        "with_aggregators": _REG + _CC + _LNG,
    }[variant]
    return f"(CASE {body} ELSE 'OTHER' END)"


LABEL = label_case("baseline")


def tld_group_case(col: str) -> str:
    t = f"nullif(regexp_extract({col}, '\\.([a-z]+)$', 1), '')"
    return (f"CASE WHEN {t} = 'ua' THEN 'ukrainian' WHEN {t} = 'ru' THEN 'russian' "
            f"WHEN {t} IN ({names(fixed.WEST_TLDS)}) THEN 'western' END")
