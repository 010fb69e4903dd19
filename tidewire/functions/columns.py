"""Column expressions shared by the operators. All stay inside JVM codegen."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from tidewire import fixed_values as fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text -------------------------------------------------------------------

def src_lang(translation_info: Column | str) -> Column:
    """Source language code, NULL when the record is native English."""
    found = F.regexp_extract(_col(translation_info), r"srclc:([a-zA-Z]+)", 1)
    return F.nullif(found, F.lit(""))


def tld(domain: Column | str) -> Column:
    """Last dot segment, NULL when there is none."""
    return F.nullif(F.regexp_extract(_col(domain), r"\.([a-z]+)$", 1), F.lit(""))


def tld_or_blank(domain: Column | str) -> Column:
    """Trimmed, lower-cased last dot segment; an empty string without a dot."""
    d = F.lower(F.trim(_col(domain)))
    return F.when(d.contains("."), F.element_at(F.split(d, r"\."), -1)).otherwise("")


def is_conflict(locations: Column | str, marks: Sequence[str] = fixed.CONFLICT_MARKS) -> Column:
    """Whether any marker occurs; NULL locations give NULL, which counts as false."""
    c = _col(locations)
    return reduce(lambda a, b: a | b, [c.contains(m) for m in marks])


def number(c: Column | str) -> Column:
    """Text to double, NULL for anything that is not a number (NaN included)."""
    return F.nanvl(_col(c).try_cast("double"), F.lit(None).cast("double"))


def lead_tone(v2tone: Column | str) -> Column:
    """First comma field as a number."""
    return number(F.substring_index(_col(v2tone), ",", 1))


def has_theme(themes: Column | str, codes: Sequence[str]) -> Column:
    """Whole-code membership in a ``;`` list: a code never matches inside another."""
    return F.arrays_overlap(F.split(_col(themes), ";"), F.array(*[F.lit(c) for c in codes]))


def host(url: Column | str) -> Column:
    """Lower-cased host without one leading ``www.``; an empty string if not a URL."""
    netloc = F.regexp_extract(F.lower(_col(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//([^/?#]*)", 1)
    return F.coalesce(F.regexp_replace(netloc, r"^www\.", ""), F.lit(""))


def site_matches(h: Column | str, domain: Column | str) -> Column:
    """Same host, a subdomain of it, or its parent."""
    h, d = _col(h), F.lower(_col(domain))
    dot = F.lit(".")
    return (h != "") & ((h == d) | h.endswith(F.concat(dot, d)) | d.endswith(F.concat(dot, h)))


def parent_domains(h: Column | str) -> Column:
    """All dotted suffixes of a host with at least two segments, longest first.

    ``a.b.c`` gives ``[a.b.c, b.c]``. Exploding this turns the subdomain test of
    :func:`site_matches` into an equality join.
    """
    parts = F.split(_col(h), r"\.")
    n = F.size(parts)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(parts, i, n), "."),
    )
    return F.when(_col(h) != "", suffixes)


def normalise_name(name: Column | str) -> Column:
    """Trim, lower-case, and strip each legal suffix once, in list order."""
    s = F.lower(F.trim(_col(name)))
    for suffix in fixed.LEGAL_SUFFIXES:
        s = F.trim(F.regexp_replace(s, suffix.replace(".", r"\.") + "$", ""))
    return s


# --- arithmetic ----------------------------------------------------------------

def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)


def clip(x: Column | str, low: float, high: float) -> Column:
    """Bounded value. ``greatest`` and ``least`` skip NULLs, so NULL is guarded."""
    c = _col(x)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def all_known(names: Sequence[str]) -> Column:
    """No NULL among the named numeric columns.

    Apply it to stored columns. Over dozens of derived ones, the optimizer rewrites the
    test once per combination of their aliases, and planning time explodes.
    """
    return F.forall(F.array(*[F.col(n).cast("double") for n in names]), lambda v: v.isNotNull())


def positive_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def qlike(actual: Column, forecast: Column, floor: float = 1e-12) -> Column:
    """Variance loss ``r - ln r - 1`` with both arguments floored."""
    r = F.greatest(actual, F.lit(floor)) / F.greatest(forecast, F.lit(floor))
    loss = r - F.ln(r) - 1.0
    return F.when(actual.isNotNull() & forecast.isNotNull(), loss)


def sign_of(x: Column) -> Column:
    return F.signum(x)


# --- calendar ---------------------------------------------------------------------

def weekday(d: Column | str) -> Column:
    """Monday is 0, Sunday is 6."""
    return F.weekday(_col(d))


def week_ending(d: Column | str, day_name: str = "FRI") -> Column:
    """The closing day of the week a date falls in; a closing day maps to itself."""
    return F.next_day(F.date_sub(_col(d), 1), day_name)


def regime(d: Column | str, bounds: Sequence[tuple[str, str]] | None = None) -> Column:
    """Ordered label by date; each bound is inclusive on its start date."""
    bounds = bounds or [
        ("buildup", fixed.BUILDUP_START),
        ("invasion", fixed.INVASION_DATE),
        ("attrition", fixed.COUNTS_START),
    ]
    c = _col(d)
    out = None
    for name, start in reversed(list(bounds)):
        test = c >= F.lit(start).cast("date")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("pre_war")


def observation_period(d: Column | str) -> Column:
    c = _col(d)
    return (
        F.when(c < F.lit(fixed.INVASION_DATE).cast("date"), "pre-war")
        .when(c < F.lit(fixed.COUNTS_START).cast("date"), "invasion")
        .otherwise("measured")
    )
