"""Numbers with the rounding, medians and clamping that page analysis relies on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity (-0.5 gives 0), unlike round() and bround()."""
    return F.floor(x + F.lit(0.5))


def half_up_1dp(x: Column) -> Column:
    return half_up(x * 10) / F.lit(10.0)


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def upper_median(values: Column, empty: float = 0.0) -> Column:
    """The element at floor(n / 2) of the sorted finite values of an array."""
    good = F.array_sort(F.filter(values, lambda v: finite(v).isNotNull()))
    return F.coalesce(F.try_element_at(good, (F.floor(F.size(good) / 2) + 1).cast("int")).cast("double"), F.lit(empty))


def upper_median_agg(x: Column, empty: float = 0.0) -> Column:
    """upper_median as an aggregate over a group."""
    return upper_median(F.collect_list(x), empty)


def clamp01(x: Column) -> Column:
    """Into 0..1; null and NaN become 0."""
    x = x.cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))


def calibrated(x: Column) -> Column:
    """Similarity above 0.85 is stretched by a square root."""
    r = clamp01(x)
    return F.when(r <= 0.85, r).otherwise(0.85 + 0.15 * F.sqrt((r - 0.85) / 0.15))


def at_least(x: Column, floor: float) -> Column:
    return F.greatest(F.lit(floor), x)
