"""Boxes: structs (x0, y0, x1, y1) in pixels, or (x, y, w, h) on a page grid of 0..1000."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numeric import half_up

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
GRID_BOX = "struct<x:bigint,y:bigint,w:bigint,h:bigint>"


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    named = [c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)]
    return F.struct(*named)


def grid_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    named = [c.cast("bigint").alias(n) for c, n in zip((x, y, w, h), ("x", "y", "w", "h"), strict=True)]
    return F.struct(*named)


def _span(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), b - a)


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return _span(b["x0"], b["x1"]) * _span(b["y0"], b["y1"])


def intersection(a: Column, b: Column) -> Column:
    across = _span(F.greatest(a["x0"], b["x0"]), F.least(a["x1"], b["x1"]))
    return across * _span(F.greatest(a["y0"], b["y0"]), F.least(a["y1"], b["y1"]))


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(F.lit(1.0), whole)


def overlap_of_first(a: Column, b: Column) -> Column:
    return _share(intersection(a, b), area(a))


def overlap_of_second(a: Column, b: Column) -> Column:
    """The second area is not clamped at zero, but counts as one pixel at least."""
    return _share(intersection(a, b), width(b) * height(b))


def overlap_of_smaller(a: Column, b: Column) -> Column:
    return _share(intersection(a, b), F.least(area(a), area(b)))


def iou(a: Column, b: Column) -> Column:
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union == 0, F.lit(0.0)).otherwise(F.try_divide(intersection(a, b), union))


def grid_iou(a: Column, b: Column) -> Column:
    across = _span(F.greatest(a["x"], b["x"]), F.least(a["x"] + a["w"], b["x"] + b["w"]))
    both = across * _span(F.greatest(a["y"], b["y"]), F.least(a["y"] + a["h"], b["y"] + b["h"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, F.try_divide(both, union)).otherwise(F.lit(0.0))


def intersects(a: Column, b: Column, padding: Column | float = 0.0) -> Column:
    """Closed boxes: touching counts."""
    pad = F.lit(padding) if isinstance(padding, (int, float)) else padding
    return (
        (a["x1"] + pad >= b["x0"]) & (b["x1"] + pad >= a["x0"]) & (a["y1"] + pad >= b["y0"]) & (b["y1"] + pad >= a["y0"])
    )


def expanded(b: Column, padding: Column, wide: Column, high: Column) -> Column:
    return box(
        F.greatest(F.lit(0.0), b["x0"] - padding),
        F.greatest(F.lit(0.0), b["y0"] - padding),
        F.least(wide, b["x1"] + padding),
        F.least(high, b["y1"] + padding),
    )


def bounding(a: Column, b: Column) -> Column:
    return box(
        F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"])
    )


def grid_bounding(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    x1, y1 = F.greatest(a["x"] + a["w"], b["x"] + b["w"]), F.greatest(a["y"] + a["h"], b["y"] + b["h"])
    return grid_box(x, y, F.greatest(F.lit(1), x1 - x), F.greatest(F.lit(1), y1 - y))


def grid_to_pixels(g: Column, wide: Column, high: Column) -> Column:
    return box(
        F.greatest(F.lit(0), half_up(g["x"] * wide / 1000)),
        F.greatest(F.lit(0), half_up(g["y"] * high / 1000)),
        F.least(wide, half_up((g["x"] + g["w"]) * wide / 1000)),
        F.least(high, half_up((g["y"] + g["h"]) * high / 1000)),
    )


def on_grid(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Rounded and kept within the grid, one cell large at least."""
    left = F.greatest(F.lit(0), F.least(F.lit(999), half_up(x)))
    top = F.greatest(F.lit(0), F.least(F.lit(999), half_up(y)))
    return grid_box(
        left, top, F.greatest(F.lit(1), F.least(1000 - left, half_up(w))), F.greatest(F.lit(1), F.least(1000 - top, half_up(h)))
    )


def quadrants(wide: Column, high: Column, overlap: float = 0.08) -> Column:
    """Array of four overlapping regions struct(label, left, top, width, height)."""
    over_x = F.greatest(F.lit(1), half_up(wide * overlap))
    over_y = F.greatest(F.lit(1), half_up(high * overlap))
    mid_x, mid_y = F.floor(wide / 2), F.floor(high / 2)
    left_end = F.least(wide, mid_x + F.ceil(over_x / 2))
    right_start = F.greatest(F.lit(0), mid_x - F.floor(over_x / 2))
    top_end = F.least(high, mid_y + F.ceil(over_y / 2))
    bottom_start = F.greatest(F.lit(0), mid_y - F.floor(over_y / 2))

    def region(label: str, left: Column, top: Column, w: Column, h: Column) -> Column:
        parts = zip((left, top, w, h), ("left", "top", "width", "height"), strict=True)
        return F.struct(F.lit(label).alias("label"), *[c.cast("bigint").alias(n) for c, n in parts])

    zero = F.lit(0)
    return F.array(
        region("top-left", zero, zero, left_end, top_end),
        region("top-right", right_start, zero, wide - right_start, top_end),
        region("bottom-left", zero, bottom_start, left_end, high - bottom_start),
        region("bottom-right", right_start, bottom_start, wide - right_start, high - bottom_start),
    )


def quadrant_to_page(g: Column, region: Column, wide: Column, high: Column) -> Column:
    """A grid box of a region on the grid of the page."""
    return on_grid(
        (region["left"] + g["x"] / 1000 * region["width"]) / wide * 1000,
        (region["top"] + g["y"] / 1000 * region["height"]) / high * 1000,
        g["w"] / 1000 * region["width"] / wide * 1000,
        g["h"] / 1000 * region["height"] / high * 1000,
    )


def to_inches(b: Column, image: Column, slide: Column) -> Column:
    """struct(x, y, w, h) on the slide; 0.01 inch wide and high at least."""
    sx, sy = slide["width"] / image["width"], slide["height"] / image["height"]
    return F.struct(
        (b["x0"] * sx).alias("x"),
        (b["y0"] * sy).alias("y"),
        F.greatest(F.lit(0.01), width(b) * sx).alias("w"),
        F.greatest(F.lit(0.01), height(b) * sy).alias("h"),
    )


def text_frame(inches: Column, slide: Column) -> Column:
    """A text box with a little room around the measured one, kept on the slide."""
    wide = F.greatest(F.lit(0.025), F.least(F.lit(0.09), inches["w"] * 0.035))
    high = F.greatest(F.lit(0.012), inches["h"] * 0.08)
    return F.struct(
        F.greatest(F.lit(0.0), inches["x"] - wide / 2).alias("x"),
        F.greatest(F.lit(0.0), inches["y"] - high).alias("y"),
        F.least(slide["width"] - inches["x"] + wide / 2, inches["w"] + wide).alias("w"),
        F.least(slide["height"] - inches["y"], inches["h"] + high * 2).alias("h"),
    )


def quadrant_table(spark: SparkSession, wide: int, high: int, overlap: float = 0.08) -> DataFrame:
    one = spark.range(1).select(F.lit(float(wide)).alias("w"), F.lit(float(high)).alias("h"))
    return one.select(F.posexplode(quadrants(F.col("w"), F.col("h"), overlap)).alias("seq", "r")).select("seq", "r.*")
