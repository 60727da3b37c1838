"""The draw list of a page: what is drawn, in which order and where. Writing files is left to others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.layout import forbidden_fallback, native_shape
from .filters import skipped_picture
from .joins import NATIVE_TYPES, drop_icons_on_text


def draw_list(components: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, draw_no, pass, kind, seq, frame): shapes, then pictures, icons and texts.

    components: page_id, seq, type, bbox, width, height, areaRatio, fillRatio, colorHex and the corner and
    interior columns; lines: page_id, seq, text, bbox; pages: page_id, image, slide.
    Fragments are never drawn; neither are large filled pictures and icons, nor icons on text.
    """
    c = components.join(pages, "page_id").withColumn("inches", G.to_inches(F.col("bbox"), F.col("image"), F.col("slide")))
    row = F.struct(*[F.col(n) for n in components.columns])
    shapes = c.where(F.col("type").isin(*NATIVE_TYPES)).select(
        "page_id", F.lit(1).alias("pass"), F.col("type").alias("kind"), "seq", native_shape(row, F.col("inches")).alias("s")
    ).select("page_id", "pass", "kind", "seq", F.struct("s.x", "s.y", "s.w", "s.h").alias("frame"))
    skipped = skipped_picture(F.col("width"), F.col("height"), F.lit(1.0), F.col("image"), F.col("areaRatio"))
    pictures = c.where((F.col("type") == "picture") & ~skipped)
    filled = forbidden_fallback(F.col("width"), F.col("height"), F.col("fillRatio"), F.col("image"))
    free = drop_icons_on_text(c.where("type = 'icon'"), lines)
    icons = free.unionByName(c.where("type = 'semanticIcon'")).where(~filled)
    part = lambda df, n: df.select("page_id", F.lit(n).alias("pass"), F.col("type").alias("kind"), "seq", F.col("inches").alias("frame"))
    t = lines.join(pages, "page_id")
    frame = G.text_frame(G.to_inches(F.col("bbox"), F.col("image"), F.col("slide")), F.col("slide"))
    texts = t.select("page_id", F.lit(4).alias("pass"), F.lit("text").alias("kind"), "seq", frame.alias("frame"))
    out = shapes.unionByName(part(pictures, 2)).unionByName(part(icons, 3)).unionByName(texts)
    order = Window.partitionBy("page_id").orderBy("pass", "seq")
    return out.withColumn("draw_no", F.row_number().over(order) - 1)
