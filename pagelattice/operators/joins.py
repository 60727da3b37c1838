"""Joins of boxes and rows within a page.

Every join has the page as its equality key, so the box test is a residual condition of a hash or merge
join and pages spread over the cluster. Inputs carry page_id and seq, their order within the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.color import median_color, rgb_hex
from ..functions.layout import MAX_FONT_PT, MAX_ICON_SHARE, MIN_FONT_PT, TEXT_ROLES, icon_key
from ..functions.numeric import half_up_1dp, upper_median_agg
from ..functions.text import character_similarity, collapsed, units

NATIVE_TYPES = ("roundRect", "rect", "ellipse", "line", "outlineRect")


def _without(left: DataFrame, right: DataFrame, test) -> DataFrame:  # noqa: ANN001
    """Rows of left for which no row of right on the same page passes test(left, right)."""
    a, b = left.alias("a"), right.alias("b")
    return a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & test(a, b), "left_anti")


def drop_covered_lines(lines: DataFrame, band_lines: DataFrame, share: float = 0.32) -> DataFrame:
    """General lines that a band's line covers by more than the share go."""
    return _without(lines, band_lines, lambda a, b: G.overlap_of_first(F.col("a.bbox"), F.col("b.bbox")) > share)


def drop_on_bands(components: DataFrame, bands: DataFrame, share: float = 0.84) -> DataFrame:
    return _without(components, bands, lambda a, b: G.overlap_of_first(F.col("a.bbox"), F.col("b.bbox")) > share)


def drop_repeats(components: DataFrame, lines: DataFrame) -> DataFrame:
    """Components on text, and those within 2 pixels of an earlier one, which counts even if it goes itself."""
    a, b = F.col("a.bbox"), F.col("b.bbox")
    kept = _without(components, lines, lambda *_: G.intersects(a, b) & (G.area(a) < G.area(b) * 1.4))
    near = F.lit(True)
    for side in ("x0", "y0", "x1", "y1"):
        near = near & (F.abs(a[side] - b[side]) < 2)
    return _without(kept, components.select("page_id", "seq", "bbox"), lambda *_: (F.col("b.seq") < F.col("a.seq")) & near)


def semantic_components(objects: DataFrame) -> DataFrame:
    """Component rows of model objects (page_id, seq, image, object); text objects give none."""
    o, image = F.col("object"), F.col("image")
    b = G.grid_to_pixels(o["bbox"], image["width"], image["height"])
    kind = F.when(o["kind"] == "icon", "semanticIcon").when(o["kind"] == "image", "picture").otherwise(o["kind"])
    rows = objects.where(o["kind"] != "text").withColumn("bbox", b)
    box = F.col("bbox")
    return rows.select(
        "page_id", "seq", "bbox", kind.alias("type"), F.lit("vision").alias("source"),
        G.width(box).alias("width"), G.height(box).alias("height"), (G.width(box) * G.height(box)).alias("count"),
        F.lit(1.0).alias("fillRatio"), (G.width(box) / F.greatest(F.lit(1.0), G.height(box))).alias("aspect"),
        (G.area(box) / (image["width"] * image["height"])).alias("areaRatio"),
        F.when(o["kind"] == "icon", o["foregroundColor"]).otherwise(o["backgroundColor"]).alias("colorHex"),
        o["label"].alias("label"), o["confidence"].alias("confidence"), o["layer"].alias("layer"),
        F.when(o["kind"] == "icon", o["iconKey"]).alias("iconKey"), o["containsText"].alias("containsText"),
    )


def merge_semantic(local: DataFrame, semantic: DataFrame) -> DataFrame:
    """Local components not covered by a semantic one, and semantic shapes not covered by a local one that stays.

    Ordered by layer (none is 0), then local before semantic, then seq: the column draw_seq.
    """
    a, b = F.col("a.bbox"), F.col("b.bbox")
    kept = _without(
        local, semantic, lambda *_: (F.coalesce(F.col("a.source"), F.lit("")) != "solidBand") & (G.overlap_of_first(a, b) > 0.56)
    )
    shapes = _without(
        semantic,
        kept.where(F.col("type").isin(*NATIVE_TYPES)),
        lambda *_: ~F.col("a.type").isin("semanticIcon", "picture") & (G.overlap_of_first(a, b) > 0.72),
    )
    both = kept.withColumn("side", F.lit(0)).unionByName(shapes.withColumn("side", F.lit(1)), allowMissingColumns=True)
    layer = F.coalesce(F.col("layer"), F.lit(0)) if "layer" in both.columns else F.lit(0)
    order = Window.partitionBy("page_id").orderBy(layer, "side", "seq")
    return both.withColumn("draw_seq", F.row_number().over(order) - 1).drop("side")


def picture_texts(pictures: DataFrame, lines: DataFrame, share: float = 0.0) -> DataFrame:
    """Pictures with the text lines on them (none unless containsText), in line order."""
    p, t = pictures.alias("p"), lines.alias("t")
    met = p.join(
        t,
        (F.col("p.page_id") == F.col("t.page_id")) & F.col("p.containsText")
        & (G.overlap_of_second(F.col("p.bbox"), F.col("t.bbox")) > share),
        "left",
    )
    found = F.sort_array(F.collect_list(F.when(F.col("t.seq").isNotNull(), F.struct("t.seq", "t.text"))))
    texts = F.transform(found, lambda x: x["text"])
    return met.groupBy(F.col("p.page_id").alias("page_id"), F.col("p.seq").alias("seq")).agg(texts.alias("texts"))


def drop_icons_on_text(icons: DataFrame, lines: DataFrame) -> DataFrame:
    a, b = F.col("a.bbox"), F.col("b.bbox")
    return _without(icons, lines, lambda *_: (G.overlap_of_second(a, b) > 0.62) & (G.area(a) < G.area(b) * 1.25))


def level_font_sizes(lines: DataFrame) -> DataFrame:
    """Lines with their size set to the upper median of their peers, if there are two at least.

    Peers, a line itself included, have like glyph height, the same weight and lie not far above or below.
    """
    a, b = lines.alias("a"), lines.select("page_id", "seq", "bbox", "style").alias("b")
    glyph = F.col("a.style.measuredGlyphHeight")
    ratio = F.col("b.style.measuredGlyphHeight") / F.greatest(F.lit(1.0), glyph)
    peer = (
        (F.col("a.page_id") == F.col("b.page_id")) & ratio.between(0.86, 1.16)
        & (F.col("a.style.bold") == F.col("b.style.bold"))
        & (F.abs(F.col("b.bbox.y0") - F.col("a.bbox.y0")) < F.greatest(F.lit(220.0), glyph * 14))
    )
    size, free = F.col("b.style.fontSize"), ~F.col("b.style.widthLimited")
    peers = a.join(b, peer).groupBy(F.col("a.page_id").alias("page_id"), F.col("a.seq").alias("seq")).agg(
        F.count("*").alias("peers"),
        F.when(F.count_if(free) > 0, upper_median_agg(F.when(free, size))).otherwise(upper_median_agg(size)).alias("target"),
    )
    style = F.col("style")
    fitted = F.greatest(F.lit(MIN_FONT_PT), F.least(F.lit(MAX_FONT_PT), F.col("target"), style["maxWidthFontPt"]))
    levelled = style.withField("fontSize", half_up_1dp(fitted))
    out = lines.join(peers, ["page_id", "seq"], "left")
    return out.withColumn("style", F.when(F.col("peers") >= 2, levelled).otherwise(style)).drop("peers", "target")


def icon_groups(icons: DataFrame, groups: DataFrame) -> DataFrame:
    """Icons rolled up into merged boxes (page_id, group_seq, bbox, image); too large a box keeps its members.

    An icon belongs to every box it touches.
    """
    i, g = icons.alias("i"), groups.alias("g")
    met = i.join(g, (F.col("i.page_id") == F.col("g.page_id")) & G.intersects(F.col("i.bbox"), F.col("g.bbox")))
    share = G.area(F.col("g.bbox")) / (F.col("g.image.width") * F.col("g.image.height"))
    met = met.withColumn("share", share)
    rolled = met.where(F.col("share") <= MAX_ICON_SHARE).groupBy(
        F.col("g.page_id").alias("page_id"), F.col("g.group_seq").alias("group_seq")
    ).agg(
        F.first("g.bbox").alias("bbox"), F.first("share").alias("areaRatio"), F.sum("i.count").alias("count"),
        F.greatest(F.lit(0.0), F.max("i.colorVariance")).alias("colorVariance"),
        median_color(F.collect_list("i.color")).alias("color"), F.count("*").alias("groupedParts"),
    )
    b = F.col("bbox")
    rolled = rolled.select(
        "page_id", "group_seq", F.lit(None).cast("bigint").alias("seq"), "bbox", "count", "colorVariance", "color",
        rgb_hex(F.col("color")).alias("colorHex"), (F.col("count") / F.greatest(F.lit(1.0), G.area(b))).alias("fillRatio"),
        "areaRatio", F.col("groupedParts").cast("bigint").alias("groupedParts"),
    )
    members = met.where(F.col("share") > MAX_ICON_SHARE).select(
        F.col("g.page_id").alias("page_id"), F.col("g.group_seq").alias("group_seq"), F.col("i.seq").cast("bigint").alias("seq"),
        F.col("i.bbox").alias("bbox"), F.col("i.count").alias("count"), F.col("i.colorVariance").alias("colorVariance"),
        F.col("i.color").alias("color"), rgb_hex(F.col("i.color")).alias("colorHex"),
        (F.col("i.count") / F.greatest(F.lit(1.0), G.area(F.col("i.bbox")))).alias("fillRatio"),
        (G.area(F.col("i.bbox")) / (F.col("g.image.width") * F.col("g.image.height"))).alias("areaRatio"),
        F.lit(None).cast("bigint").alias("groupedParts"),
    )
    return rolled.unionByName(members)


def corrected_lines(lines: DataFrame, corrections: DataFrame) -> DataFrame:
    """Lines (page_id, seq, text) with corrections (page_id, id, ord, text, role); the last one of an id wins.

    A correction must be short enough and alike enough; its role counts in either case.
    """
    last = corrections.groupBy("page_id", F.col("id").alias("seq")).agg(F.max_by(F.struct("text", "role"), "ord").alias("fix"))
    out = lines.join(last, ["page_id", "seq"], "left")
    new = collapsed(F.coalesce(F.col("fix.text"), F.lit("")))
    fits = (units(new) <= F.greatest(F.lit(16.0), units(F.col("text")) * 1.8)) & (character_similarity(F.col("text"), new) >= 0.34)
    found = F.col("fix").isNotNull()
    safe = F.when(found & (new != "") & fits, new).otherwise(F.col("text"))
    role = F.when(found, F.when(F.col("fix.role").isin(*TEXT_ROLES), F.col("fix.role")).otherwise("body"))
    out = out.withColumn("textRole", role).withColumn("textEnhanced", F.when(found, safe != F.col("text")))
    return out.withColumn("text", safe).drop("fix")


def correction_counts(lines: DataFrame) -> DataFrame:
    """How many lines of a page (as corrected_lines gives them) have another text than was recognised."""
    return lines.groupBy("page_id").agg(F.count_if(F.coalesce("textEnhanced", F.lit(False))).alias("correctionCount"))


def resolved_media(pictures: DataFrame, relations: DataFrame) -> DataFrame:
    """(page_id, seq, vector) of pictures (page_id, seq, ids array) by relations (page_id, id, ord, target), the last wins."""
    last = relations.groupBy("page_id", "id").agg(F.max_by("target", "ord").alias("target")).where("target <> ''")
    ids = pictures.select("page_id", "seq", F.explode("ids").alias("id"))
    met = ids.join(last, ["page_id", "id"]).groupBy("page_id", "seq")
    met = met.agg(F.bool_or(F.col("target").rlike(r"(?i)\.svg(?:$|\?)")).alias("vector"))
    return pictures.join(met, ["page_id", "seq"], "left").withColumn("vector", F.coalesce("vector", F.lit(False)))


def positional(left: DataFrame, right: DataFrame, key: str = "page_index") -> DataFrame:
    """Rows of equal position; raises where one side has rows that the other lacks."""
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), key, "full_outer")
    whole = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    checked = F.when(whole, F.col(key)).otherwise(F.raise_error(F.lit("the page counts differ")))
    return both.withColumn(key, checked.cast(both.schema[key].dataType)).drop("_l", "_r")


def with_icon_key(df: DataFrame, value: Column, name: str = "icon_key") -> DataFrame:
    return df.withColumn(name, icon_key(value))


def near_set_pixels(pixels: DataFrame, other: DataFrame, radius: int) -> DataFrame:
    """Pixels (page_id, x, y) with a pixel of the other mask within the radius, by a join on shifted places."""
    reach = F.sequence(F.lit(-radius), F.lit(radius))
    spread = other.select("page_id", F.col("x"), F.col("y"), F.explode(reach).alias("dx"))
    spread = spread.select("page_id", "y", (F.col("x") + F.col("dx")).alias("x"), F.explode(reach).alias("dy"))
    spread = spread.select("page_id", "x", (F.col("y") + F.col("dy")).alias("y"))
    return pixels.join(spread, ["page_id", "x", "y"], "left_semi")
