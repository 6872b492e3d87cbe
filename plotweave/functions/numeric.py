"""Rounding, ranks and medians with fixed tie rules, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if not isinstance(x, str) else F.col(x)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, by binding it to a lambda's variable."""
    return F.transform(F.array(value), body)[0]


def half_up(x, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity, unlike round(), which rounds them away from zero."""
    scale = 10.0**digits
    return F.floor(col(x) * scale + 0.5) / scale


def clamp(x, low, high) -> Column:
    return F.least(F.greatest(col(x), col(low)), col(high))


def ratio(a, b, digits: int = 6) -> Column:
    """a / b rounded, null where b is zero or null."""
    return half_up(F.when(col(b) != 0, col(a) / col(b)), digits)


def _pick(values: Column, place: Column) -> Column:
    return F.get(F.sort_array(values), place.cast("int"))


def nearest_rank(values: Column, p: float) -> Column:
    """The element at round(p * (n - 1)) of an array; null of an empty one."""
    return _pick(values, F.floor((F.size(values) - 1) * p + 0.5))


def floor_rank(values: Column, p: float) -> Column:
    """The element at floor(p * (n - 1)); 0 of an empty array."""
    return F.coalesce(_pick(values, F.floor((F.size(values) - 1) * p)), F.lit(0.0))


def upper_median(values: Column) -> Column:
    return _pick(values, F.floor(F.size(values) / 2))


def middle_median(values: Column) -> Column:
    """The mean of the middle two elements."""
    n = F.size(values)
    return (_pick(values, F.floor((n - 1) / 2)) + _pick(values, F.floor(n / 2))) / 2.0


def hash01(lon, lat, salt) -> Column:
    """A value in [0, 1) that a place and a salt fix."""
    s = F.sin(col(lon) * 127.1 + col(lat) * 311.7 + col(salt) * 74.7) * 43758.5453
    return s - F.floor(s)
