"""Colours as arrays of three channels, 0..255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import half_up, upper_median

#: Fixed values of the foreground rule.
FOREGROUND_ALPHA = 80
FOREGROUND_LUMINANCE = 244


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.array(r.cast("double"), g.cast("double"), b.cast("double"))


def luminance(c: Column) -> Column:
    return 0.2126 * c[0] + 0.7152 * c[1] + 0.0722 * c[2]


def distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(F.slice(a, 1, 3), F.slice(b, 1, 3), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v))


def rgb_hex(c: Column) -> Column:
    """Six upper-case hex digits, channels rounded and clamped."""
    part = lambda v: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), half_up(v))).cast("bigint")), 2, "0")
    return F.concat(part(c[0]), part(c[1]), part(c[2]))


def quantized(c: Column, step: int = 24) -> Column:
    return F.transform(F.slice(c, 1, 3), lambda v: F.least(F.lit(255.0), (half_up(v / step) * step).cast("double")))


def saturation(c: Column) -> Column:
    most, least = F.greatest(c[0], c[1], c[2]), F.least(c[0], c[1], c[2])
    return F.when(most > 0, (most - least) / most).otherwise(F.lit(0.0))


def is_foreground(c: Column, alpha: Column) -> Column:
    return (alpha > FOREGROUND_ALPHA) & (luminance(c) < FOREGROUND_LUMINANCE)


def median_color(colors: Column) -> Column:
    """Upper median of each channel of an array of colours; white where it is empty."""

    def channel(i: int) -> Column:
        return upper_median(F.transform(colors, lambda c: c[i]), 255.0)

    return F.array(*[channel(i) for i in range(3)])


def clean_hex(value: Column, fallback: str) -> Column:
    return F.when(value.rlike("^[0-9a-fA-F]{6}$"), F.upper(value)).otherwise(F.lit(fallback))
