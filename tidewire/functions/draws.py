"""Deterministic draws from hashed keys.

A draw depends only on its seed and keys, so a retried or moved task gives the same
value. ``rand()`` would not: it depends on the partition a row lands in.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_SPAN = 1 << 52


def uniform(*keys: Column | int | str) -> Column:
    """A value in (0, 1) fixed by the keys."""
    cols = [k if isinstance(k, Column) else F.lit(k) for k in keys]
    bits = F.pmod(F.xxhash64(*cols), F.lit(_SPAN))
    return (bits + 0.5) / float(_SPAN)


def index(n: Column, *keys: Column | int | str) -> Column:
    """An integer in 0..n-1 fixed by the keys."""
    return F.floor(uniform(*keys) * n).cast("bigint")


def normal(*keys: Column | int | str) -> Column:
    """A standard normal value fixed by the keys (Box-Muller)."""
    radius = F.sqrt(-2.0 * F.ln(uniform("radius", *keys)))
    return radius * F.cos(2.0 * math.pi * uniform("angle", *keys))
