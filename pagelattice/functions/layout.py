"""Fonts, component types, icons and model objects: row-wise layout rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G
from .color import clean_hex
from .numeric import clamp01, half_up, half_up_1dp, upper_median
from .text import SPACE, text_or_empty, units

#: Fixed values of the layout policy.
MIN_FONT_PT, MAX_FONT_PT = 4.5, 42.0
MAX_FALLBACK_SHARE, MAX_ICON_SHARE, MIN_SHAPE_SHARE = 0.25, 0.035, 0.00008
FONT_FACE = "Arial"
#: Icon names and what they are called otherwise.
ICON_KEYS = (
    "none", "analytics", "business", "application", "database", "ai", "server", "customer", "product", "order",
    "billing", "charging", "marketplace", "loyalty", "data", "operation", "crm", "arrow", "other",
)
ICON_ALIASES = {
    "growth": "analytics", "chart": "analytics", "people": "business", "users": "business", "cube": "application",
    "storage": "database", "intelligence": "ai", "technology": "server", "customer360": "customer",
    "operations": "operation",
}
OBJECT_KINDS = ("icon", "image", "rect", "roundRect", "ellipse", "line")
BACKGROUND_SHAPES = ("none", "rect", "roundRect", "ellipse")
TEXT_ROLES = ("title", "subtitle", "body", "label")


def text_width_units(t: Column) -> Column:
    """Estimated advance width in ems: narrow 0.28, wide 0.9, capitals and digits 0.61, others 0.52; 1 at least."""
    count = lambda p: F.regexp_count(t, F.lit(p))
    narrow = count(SPACE) + count(r"[ilI1|.,:;'`]")
    wide = count("[MW@%&#]")
    capital = count("[A-Z0-9&&[^MWI1]]")
    rest = F.char_length(t) - narrow - wide - capital
    return F.greatest(F.lit(1.0), narrow * 0.28 + wide * 0.9 + capital * 0.61 + rest * 0.52)


def font_style(line: Column, image: Column, slide: Column) -> Column:
    """Style struct of a line(text, bbox, words): height decides, width limits."""
    text, b = line["text"], line["bbox"]
    words = F.filter(F.coalesce(line["words"], F.array()), lambda w: (w["confidence"] >= 45) & w["text"].rlike("[A-Za-z0-9]"))
    heights = F.filter(F.transform(words, lambda w: w["bbox"]["y1"] - w["bbox"]["y0"]), lambda h: h >= 2)
    box_height = F.greatest(F.lit(1.0), G.height(b))
    glyph = F.when(F.size(heights) > 0, F.least(box_height, upper_median(heights))).otherwise(box_height)
    height_pt = glyph * slide["height"] * 72 / image["height"]
    width_pt = F.greatest(F.lit(0.02), G.width(b) * slide["width"] / image["width"]) * 72 / text_width_units(text)
    compact = F.regexp_replace(text, SPACE, "")
    upper = F.regexp_count(text, F.lit("[A-Z0-9]")) / F.greatest(F.lit(1), units(compact))
    title = (height_pt >= 18) | ((upper > 0.55) & (height_pt > 12))
    factor = F.when(title, F.lit(0.96)).otherwise(F.lit(0.9))
    short = F.when(units(text) <= 4, F.lit(1.08)).otherwise(F.lit(1.0))
    fitted = F.least(height_pt * factor, width_pt * 0.98) * short
    size = F.greatest(F.lit(MIN_FONT_PT), F.least(F.lit(MAX_FONT_PT), fitted))
    return F.struct(
        F.lit(FONT_FACE).alias("fontFace"),
        half_up_1dp(size).alias("fontSize"),
        (title | ((upper > 0.72) & (height_pt > 10.5))).alias("bold"),
        glyph.alias("measuredGlyphHeight"),
        (width_pt < height_pt * 0.9).alias("widthLimited"),
        (height_pt * factor * short).alias("heightBasedFontPt"),
        (width_pt * 0.98 * short).alias("maxWidthFontPt"),
    )


def component_type(c: Column, image: Column) -> Column:
    """struct(type, areaRatio, gradientCandidate): the first rule that holds decides."""
    share = G.area(c["bbox"]) / (image["width"] * image["height"])
    w, h, fill, aspect = c["width"], c["height"], c["fillRatio"], c["aspect"]
    thin = (h <= F.greatest(F.lit(4.0), image["height"] * 0.006)) | (w <= F.greatest(F.lit(4.0), image["width"] * 0.004))
    filled = (fill > 0.72) & (share >= MIN_SHAPE_SHARE)
    outline = c["count"] / F.greatest(F.lit(1.0), 2 * (w + h))
    kind = (
        F.when(thin & ((aspect > 5) | (aspect < 0.2)), "line")
        .when(filled & (aspect > 0.78) & (aspect < 1.28) & (fill < 0.9), "ellipse")
        .when(filled, "roundRect")
        .when((fill < 0.28) & (outline > 0.35) & (share > 0.0004) & (w > 12) & (h > 8), "outlineRect")
        .when(share <= MAX_ICON_SHARE, "icon")
        .otherwise("fragment")
    )
    gradient = F.when(kind == "roundRect", c["colorVariance"] > 14)
    return F.struct(kind.alias("type"), share.alias("areaRatio"), gradient.alias("gradientCandidate"))


def forbidden_fallback(w: Column, h: Column, filled: Column, image: Column) -> Column:
    share = w * h / (image["width"] * image["height"])
    return (F.coalesce(filled, F.lit(1.0)) > 0.15) & (share >= MAX_FALLBACK_SHARE)


def icon_key(value: Column) -> Column:
    """Canonical icon name; unknown ones are other."""
    compact = F.regexp_replace(F.lower(text_or_empty(value)), "[^a-z0-9]", "")
    known = {k: k for k in ICON_KEYS} | ICON_ALIASES
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, compact), F.lit("other"))


def sane_objects(objects: Column) -> Column:
    """Model objects with a known kind and a confidence of 0.55 or more, every field within its range."""
    good = F.filter(
        F.coalesce(objects, F.array()),
        lambda o: o["kind"].isin(*OBJECT_KINDS) & ~F.coalesce(o["confidence"] < 0.55, F.lit(False)),
    )

    def clean(o: Column) -> Column:
        b = o["bbox"]
        shape = F.when(o["backgroundShape"].isin(*BACKGROUND_SHAPES), o["backgroundShape"]).otherwise("none")
        layer = F.greatest(F.lit(0), F.least(F.lit(20), half_up(F.coalesce(o["layer"].cast("double"), F.lit(0.0)))))
        return F.struct(
            o["kind"].alias("kind"),
            G.on_grid(*[b[k].cast("double") for k in ("x", "y", "w", "h")]).alias("bbox"),
            F.substring(text_or_empty(o["label"]), 1, 160).alias("label"),
            icon_key(o["iconKey"]).alias("iconKey"),
            clean_hex(o["foregroundColor"], "333333").alias("foregroundColor"),
            shape.alias("backgroundShape"),
            clean_hex(o["backgroundColor"], "FFFFFF").alias("backgroundColor"),
            clamp01(o["confidence"]).alias("confidence"),
            F.coalesce(o["containsText"], F.lit(False)).alias("containsText"),
            layer.cast("int").alias("layer"),
        )

    return F.transform(good, clean)


def sane_evaluation(v: Column) -> Column:
    """Model scores within 0..1 and their weighted total; at most 20 errors, texts cut to their lengths."""
    names = ("layoutScore", "contentScore", "appearanceScore", "semanticScore")
    score = {n: clamp01(v[n]) for n in names}
    errors = F.transform(
        F.slice(F.coalesce(v["criticalErrors"], F.array()), 1, 20),
        lambda e: F.struct(
            F.substring(F.coalesce(F.nullif(e["category"], F.lit("")), F.lit("semantic")), 1, 40).alias("category"),
            F.when(e["severity"].isin("minor", "major", "critical"), e["severity"]).otherwise("major").alias("severity"),
            F.substring(F.coalesce(F.nullif(e["region"], F.lit("")), F.lit("unknown")), 1, 100).alias("region"),
            F.substring(text_or_empty(e["description"]), 1, 300).alias("description"),
        ),
    )
    total = score["contentScore"] * 0.3 + score["layoutScore"] * 0.28 + score["appearanceScore"] * 0.22 + score["semanticScore"] * 0.2
    return F.struct(*[score[n].alias(n) for n in names], errors.alias("criticalErrors"), total.alias("overallScore"))


def native_shape(c: Column, inches: Column) -> Column:
    """What is drawn for a component: shape, fill, line and its width; null where nothing is."""
    outline, line = c["type"] == "outlineRect", c["type"] == "line"
    flat = c["width"] >= c["height"]
    sharp = (c["areaRatio"] > 0.5) | F.coalesce(c["hasSharpCorners"], F.lit(False))
    shape = F.when(c["type"].isin("rect", "roundRect", "ellipse", "line"), c["type"]).when(
        outline, F.when(sharp, "rect").otherwise("roundRect")
    )
    inside = outline & (c["areaRatio"] < 0.5) & F.coalesce(c["hasDistinctInterior"], F.lit(False))
    fill = F.when(c["type"].isin("rect", "roundRect", "ellipse"), c["colorHex"]).when(inside, c["interiorColorHex"])
    thick = F.greatest(F.lit(0.45), F.least(F.lit(2.5), F.when(flat, inches["h"]).otherwise(inches["w"]) * 72))
    return F.when(
        shape.isNotNull(),
        F.struct(
            shape.alias("shape"), inches["x"].alias("x"), inches["y"].alias("y"),
            F.when(line & ~flat, F.lit(0.0)).otherwise(inches["w"]).alias("w"),
            F.when(line & flat, F.lit(0.0)).otherwise(inches["h"]).alias("h"),
            fill.alias("fill"), F.when(outline | line, c["colorHex"]).alias("line"),
            F.when(outline, F.lit(0.65)).when(line, thick).alias("lineWidth"),
        ),
    )
