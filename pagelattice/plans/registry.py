"""Queries of the page-analysis operators on the driver's tables, and the same in DuckDB's SQL.

Every query runs over its whole tables. Those whose result depends on the order of a fold have no SQL and are
tested against brute force on small fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import geometry as G
from ..functions import layout as L
from ..functions import text as T
from ..functions.numeric import calibrated, half_up, upper_median_agg
from ..operators import drawing, filters, folds, joins, quality, similarity, state
from .tables import AREA, BOXES, MEET, SMALL_BOXES, boxes, image, slide, small_boxes, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: F.Column) -> F.Column:
    """Six places, halves away from zero of the scaled double; F.round takes halves of the printed decimal."""
    return F.signum(c) * F.floor(F.abs(c) * 1e6 + 0.5) / 1e6


area = AREA.format
meet = MEET.format


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return b.alias("a").join(b.alias("b"), (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.seq") < F.col("b.seq")))


PAIRS = "FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.seq < b.seq"


@query(f"""WITH {BOXES} SELECT a.page_id, a.seq AS seq_a, b.seq AS seq_b, {area('a')} AS area_a, {meet('a', 'b')} AS common,
    round({meet('a', 'b')} / greatest(1, {area('a')}), 6) AS of_first, round({meet('a', 'b')} / greatest(1, {area('b')}), 6) AS of_second,
    round({meet('a', 'b')} / greatest(1, least({area('a')}, {area('b')})), 6) AS of_smaller,
    round(CASE WHEN {area('a')} + {area('b')} - {meet('a', 'b')} = 0 THEN 0 ELSE {meet('a', 'b')} / ({area('a')} + {area('b')} - {meet('a', 'b')}) END, 6) AS iou,
    a.x1 >= b.x0 AND b.x1 >= a.x0 AND a.y1 >= b.y0 AND b.y1 >= a.y0 AS touch,
    least(a.x0, b.x0) AS ux0, greatest(a.y1, b.y1) AS uy1 {PAIRS}""")
def box_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a.bbox"), F.col("b.bbox")
    u = G.bounding(a, b)
    return _pairs(spark, sf_dir).select(
        "a.page_id", F.col("a.seq").alias("seq_a"), F.col("b.seq").alias("seq_b"), G.area(a).alias("area_a"), G.intersection(a, b).alias("common"),
        r6(G.overlap_of_first(a, b)).alias("of_first"), r6(G.overlap_of_second(a, b)).alias("of_second"),
        r6(G.overlap_of_smaller(a, b)).alias("of_smaller"), r6(G.iou(a, b)).alias("iou"), G.intersects(a, b).alias("touch"),
        u["x0"].alias("ux0"), u["y1"].alias("uy1"),
    )


@query(f"""WITH {BOXES} SELECT page_id, seq, greatest(0, x0 - 3) AS ex0, least(200, x1 + 3) AS ex1, round(x0 * 13.333 / 200, 6) AS ix,
    round(greatest(0.01, (x1 - x0) * 13.333 / 200), 6) AS iw,
    round(greatest(0, x0 * 13.333 / 200 - greatest(0.025, least(0.09, greatest(0.01, (x1 - x0) * 13.333 / 200) * 0.035)) / 2), 6) AS tx,
    floor(x0 * 5 * 200 / 1000 + 0.5) AS px0, least(200, floor((x0 * 5 + 50) * 200 / 1000 + 0.5)) AS px1 FROM boxes""")
def box_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bbox")
    inches = G.to_inches(b, image(), slide())
    e = G.expanded(b, F.lit(3.0), F.lit(200.0), F.lit(200.0))
    p = G.grid_to_pixels(F.struct((b["x0"] * 5).alias("x"), (b["y0"] * 5).alias("y"), F.lit(50.0).alias("w"), F.lit(50.0).alias("h")), F.lit(200.0), F.lit(200.0))
    return boxes(spark, sf_dir).select(
        "page_id", "seq", e["x0"].alias("ex0"), e["x1"].alias("ex1"), r6(inches["x"]).alias("ix"), r6(inches["w"]).alias("iw"),
        r6(G.text_frame(inches, slide())["x"]).alias("tx"), p["x0"].alias("px0"), p["x1"].alias("px1"),
    )


@query("""SELECT p_partkey AS page_id, r.seq, r.label, r.gx AS grid_left, r.gw AS grid_width FROM (
    SELECT p_partkey, unnest([
        {'seq': 0, 'label': 'top-left', 'l': 0, 'w': least(w, mx + ceil(o / 2))}, {'seq': 1, 'label': 'top-right', 'l': greatest(0, mx - floor(o / 2)), 'w': w - greatest(0, mx - floor(o / 2))},
        {'seq': 2, 'label': 'bottom-left', 'l': 0, 'w': least(w, mx + ceil(o / 2))}, {'seq': 3, 'label': 'bottom-right', 'l': greatest(0, mx - floor(o / 2)), 'w': w - greatest(0, mx - floor(o / 2))}]) AS q, w
    FROM (SELECT p_partkey, 100.0::DOUBLE * p_size AS w, greatest(1, floor(100.0::DOUBLE * p_size * 0.08::DOUBLE + 0.5)) AS o, floor(100.0::DOUBLE * p_size / 2) AS mx FROM part)) s,
    LATERAL (SELECT q.seq AS seq, q.label AS label, CAST(greatest(0, least(999, floor((q.l + 100.0::DOUBLE / 1000 * q.w) / w * 1000 + 0.5))) AS BIGINT) AS gx,
        CAST(greatest(1, least(1000 - greatest(0, least(999, floor((q.l + 100.0::DOUBLE / 1000 * q.w) / w * 1000 + 0.5))), floor(200.0::DOUBLE / 1000 * q.w / w * 1000 + 0.5))) AS BIGINT) AS gw) r""")
def quadrant_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("p_size") * F.lit(100.0)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), w.alias("w"))
    rows = part.select("page_id", "w", F.posexplode(G.quadrants(F.col("w"), F.col("w"))).alias("seq", "r"))
    g = F.struct(F.lit(100.0).alias("x"), F.lit(100.0).alias("y"), F.lit(200.0).alias("w"), F.lit(200.0).alias("h"))
    on = G.quadrant_to_page(g, F.col("r"), F.col("w"), F.col("w"))
    return rows.select("page_id", "seq", "r.label", on["x"].alias("grid_left"), on["w"].alias("grid_width"))


@query(f"""WITH {BOXES} SELECT a.page_id, a.seq FROM boxes a WHERE a.kind <> 'R' AND NOT EXISTS (SELECT 1 FROM boxes b
    WHERE b.kind = 'R' AND a.page_id = b.page_id AND {meet('a', 'b')} / greatest(1, {area('a')}) > 0.32)""")
def overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return joins.drop_covered_lines(b.where("kind <> 'R'"), b.where("kind = 'R'")).select("page_id", "seq")


@query(f"""WITH {BOXES} SELECT a.page_id, a.seq FROM boxes a WHERE NOT EXISTS (SELECT 1 FROM boxes b
    WHERE b.kind = 'A' AND b.score > 50000 AND a.page_id = b.page_id AND b.seq <> a.seq AND {meet('a', 'b')} / greatest(1, {area('a')}) > 0.84) AND a.kind <> 'A'""")
def band_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return joins.drop_on_bands(b.where("kind <> 'A'"), b.where("kind = 'A' and score > 50000")).select("page_id", "seq")


@query(f"""WITH {SMALL_BOXES} SELECT a.page_id, a.seq FROM small_boxes a WHERE NOT EXISTS (SELECT 1 FROM small_boxes b
    WHERE a.page_id = b.page_id AND b.seq < a.seq AND abs(a.x0 - b.x0) < 2 AND abs(a.y0 - b.y0) < 2 AND abs(a.x1 - b.x1) < 2 AND abs(a.y1 - b.y1) < 2)
    AND NOT EXISTS (SELECT 1 FROM small_boxes b WHERE a.page_id = b.page_id AND b.seq = 0 AND a.x1 >= b.x0 + 6 AND b.x1 + 6 >= a.x0 AND a.y1 >= b.y0 + 6 AND b.y1 + 6 >= a.y0
        AND {area('a')} < {area('b')} * 1.4 AND a.seq > 2)""")
def earlier_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = small_boxes(spark, sf_dir)
    x = F.col("bbox")
    lines = b.where("seq = 0").withColumn("bbox", G.box(x["x0"] + 6, x["y0"] + 6, x["x1"] + 6, x["y1"] + 6))
    late = joins.drop_repeats(b, lines).select("page_id", "seq")
    early = joins.drop_repeats(b, lines.limit(0)).where("seq <= 2").select("page_id", "seq")
    return late.where("seq > 2").unionByName(early)


def _semantic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = boxes(spark, sf_dir)
    kind = F.when(F.col("seq") % 3 == 0, "icon").when(F.col("seq") % 3 == 1, "roundRect").otherwise("fragment")
    local = b.where("kind <> 'N'").select("page_id", "seq", "bbox", kind.alias("type"), F.when(F.col("kind") == "A", "solidBand").alias("source"))
    sem = b.where("kind = 'N'").select(
        "page_id", "seq", "bbox", F.when(F.col("seq") % 2 == 0, "semanticIcon").otherwise("rect").alias("type"), F.lit("vision").alias("source"),
        (F.col("seq") % 4).cast("int").alias("layer"),
    )
    return local, sem


@query(f"""WITH {BOXES}, loc AS (SELECT *, CASE seq % 3 WHEN 0 THEN 'icon' WHEN 1 THEN 'roundRect' ELSE 'fragment' END AS type FROM boxes WHERE kind <> 'N'),
    sem AS (SELECT *, CASE seq % 2 WHEN 0 THEN 'semanticIcon' ELSE 'rect' END AS type, seq % 4 AS layer FROM boxes WHERE kind = 'N'),
    kept AS (SELECT * FROM loc a WHERE kind = 'A' OR NOT EXISTS (SELECT 1 FROM sem b WHERE a.page_id = b.page_id AND {meet('a', 'b')} / greatest(1, {area('a')}) > 0.56)),
    shapes AS (SELECT * FROM sem a WHERE type = 'semanticIcon' OR NOT EXISTS (SELECT 1 FROM kept b WHERE b.type = 'roundRect' AND a.page_id = b.page_id AND {meet('a', 'b')} / greatest(1, {area('a')}) > 0.72)),
    u AS (SELECT page_id, seq, type, 0 AS layer, 0 AS side FROM kept UNION ALL SELECT page_id, seq, type, layer, 1 FROM shapes)
    SELECT page_id, seq, type, row_number() OVER (PARTITION BY page_id ORDER BY layer, side, seq) - 1 AS draw_seq FROM u""")
def semantic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.merge_semantic(*_semantic(spark, sf_dir)).select("page_id", "seq", "type", "draw_seq")


@query(f"""WITH {BOXES} SELECT p.page_id, p.seq, CAST(count(t.seq) AS BIGINT) AS n_texts, coalesce(string_agg(CAST(t.seq AS VARCHAR), ',' ORDER BY t.seq), '') AS texts
    FROM boxes p LEFT JOIN boxes t ON p.page_id = t.page_id AND t.kind = 'R' AND p.seq % 2 = 0 AND {meet('p', 't')} / greatest(1, (t.x1 - t.x0) * (t.y1 - t.y0)) > 0
    WHERE p.kind = 'N' GROUP BY p.page_id, p.seq""")
def picture_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    pictures = b.where("kind = 'N'").withColumn("containsText", F.col("seq") % 2 == 0)
    lines = b.where("kind = 'R'").withColumn("text", F.col("seq").cast("string"))
    out = joins.picture_texts(pictures, lines)
    return out.select("page_id", "seq", F.size("texts").cast("bigint").alias("n_texts"), F.array_join("texts", ",").alias("texts"))


@query(f"""WITH {BOXES} SELECT a.page_id, a.seq FROM boxes a WHERE a.kind <> 'R' AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.kind = 'R' AND a.page_id = b.page_id
    AND {meet('a', 'b')} / greatest(1, {area('b')}) > 0.62 AND {area('a')} < {area('b')} * 1.25)""")
def icon_on_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return joins.drop_icons_on_text(b.where("kind <> 'R'"), b.where("kind = 'R'")).select("page_id", "seq")


@query(f"""WITH {BOXES}, s AS (SELECT *, y1 - y0 AS glyph, 5 + (x1 - x0) / 2 AS size, score % 3 < 1 AS lim, 4 + (x1 - x0) / 1.8 AS most FROM boxes),
    p AS (SELECT a.page_id, a.seq, count(*) AS n, list_sort(list(b.size)) AS every, list_sort(list(b.size) FILTER (WHERE NOT b.lim)) AS free
        FROM s a JOIN s b ON a.page_id = b.page_id AND b.glyph / greatest(1, a.glyph) BETWEEN 0.86 AND 1.16 AND (a.kind = 'R') = (b.kind = 'R')
            AND abs(b.y0 - a.y0) < greatest(220, a.glyph * 14) GROUP BY a.page_id, a.seq)
    SELECT s.page_id, s.seq, round(CASE WHEN p.n >= 2 THEN floor(greatest(4.5, least(42, coalesce(free[len(free) // 2 + 1], every[len(every) // 2 + 1]), s.most)) * 10 + 0.5) / 10 ELSE s.size END, 6) AS font_size
    FROM s JOIN p USING (page_id, seq)""")
def font_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, wide = boxes(spark, sf_dir), G.width(F.col("bbox"))
    style = F.struct(
        G.height(F.col("bbox")).alias("measuredGlyphHeight"), (5 + wide / 2).alias("fontSize"), (F.col("kind") == "R").alias("bold"),
        (F.col("score") % 3 < 1).alias("widthLimited"), (4 + wide / 1.8).alias("maxWidthFontPt"),
    )
    out = joins.level_font_sizes(b.select("page_id", "seq", "bbox", style.alias("style")))
    return out.select("page_id", "seq", r6(F.col("style.fontSize")).alias("font_size"))


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = boxes(spark, sf_dir).where("kind <> 'N'")
    return b, folds.merge_boxes(b.select("page_id", "seq", "bbox"), gap=2.0)


@query()
def box_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[1].select("page_id", "group_seq", "bbox.*")


@query()
def icon_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, groups = _merged(spark, sf_dir)
    icons = b.select(
        "page_id", "seq", "bbox", F.col("seq").cast("bigint").alias("count"), (F.col("score") % 7).alias("colorVariance"),
        C.rgb(F.col("score") % 256, F.col("seq") * 7 % 256, F.lit(9)).alias("color"),
    )
    out = joins.icon_groups(icons, groups.withColumn("image", image()))
    return out.select("page_id", "group_seq", "seq", "count", "colorHex", r6(F.col("areaRatio")).alias("area_ratio"), "groupedParts")


@query()
def greedy_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    lines = b.select("page_id", "seq", F.col("kind").alias("text"), (F.col("score") / 1000).alias("confidence"), "bbox", F.when(F.col("seq") % 5 == 0, "FFFFFF").alias("forcedColorHex"))
    return folds.suppress_duplicate_lines(lines).select("page_id", "read_seq", "seq", "text", "confidence")


@query()
def quadrant_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, x = boxes(spark, sf_dir), F.col("bbox")
    grid = G.grid_box(x["x0"], x["y0"], F.greatest(F.lit(1.0), G.width(x)), F.greatest(F.lit(1.0), G.height(x)))
    objects = b.select("page_id", "seq", "kind", grid.alias("bbox"), F.col("kind").alias("label"), (F.col("score") / 110000).alias("confidence"), (F.col("seq") % 5).cast("int").alias("layer"))
    return folds.merge_quadrants(objects).select("page_id", "seq", "kind", "bbox.*", r6(F.col("confidence")).alias("confidence"), "layer")


_COMPONENT = f"""WITH {BOXES}, c AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, (score % 100) / 100 AS fill, (x1 - x0) / greatest(1, y1 - y0) AS aspect, {area('boxes')} / 40000 AS share, score % 500 AS n FROM boxes),
    t AS (SELECT page_id, seq, share, fill, w, h, CASE WHEN (h <= 4 OR w <= 4) AND (aspect > 5 OR aspect < 0.2) THEN 'line'
        WHEN fill > 0.72 AND share >= 0.00008 AND aspect > 0.78 AND aspect < 1.28 AND fill < 0.9 THEN 'ellipse' WHEN fill > 0.72 AND share >= 0.00008 THEN 'roundRect'
        WHEN fill < 0.28 AND n / greatest(1, 2 * (w + h)) > 0.35 AND share > 0.0004 AND w > 12 AND h > 8 THEN 'outlineRect'
        WHEN share <= 0.035 THEN 'icon' ELSE 'fragment' END AS type FROM c)"""


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, x = boxes(spark, sf_dir), F.col("bbox")
    c = F.struct(
        x.alias("bbox"), G.width(x).alias("width"), G.height(x).alias("height"), (F.col("score") % 100 / 100).alias("fillRatio"),
        (G.width(x) / F.greatest(F.lit(1.0), G.height(x))).alias("aspect"), (F.col("score") % 500).alias("count"), F.lit(0.0).alias("colorVariance"),
    )
    return b.select("page_id", "seq", "bbox", c.alias("c"), L.component_type(c, image()).alias("k")).select("page_id", "seq", "bbox", "c", "k.*")


@query(_COMPONENT + " SELECT page_id, seq, type, fill > 0.15 AND w * h / 40000 >= 0.25 AS forbidden, share >= 0.00008 AS large_enough, round(share, 6) AS area_ratio FROM t")
def component_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    forbidden = L.forbidden_fallback(F.col("c.width"), F.col("c.height"), F.col("c.fillRatio"), image())
    return _components(spark, sf_dir).select(
        "page_id", "seq", "type", forbidden.alias("forbidden"), filters.large_enough(F.col("bbox"), image()).alias("large_enough"), r6(F.col("areaRatio")).alias("area_ratio")
    )


@query(_COMPONENT + """ SELECT page_id, count(*) AS n, count(*) FILTER (WHERE type = 'line') AS n_line, count(*) FILTER (WHERE type = 'ellipse') AS n_ellipse,
    count(*) FILTER (WHERE type = 'icon') AS n_icon, round(coalesce(max(share) FILTER (WHERE type = 'fragment'), 0), 6) AS max_fragment_ratio FROM t GROUP BY page_id""")
def component_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.component_summary(_components(spark, sf_dir))
    return out.select("page_id", "n", "n_line", "n_ellipse", "n_icon", r6(F.col("max_fragment_ratio")).alias("max_fragment_ratio"))


@query("""SELECT l_orderkey AS page_id, list_sort(list(l_quantity))[count(*) // 2 + 1] AS median_quantity, list_sort(list(l_extendedprice) FILTER (WHERE l_discount > 0.05))[count(*) FILTER (WHERE l_discount > 0.05) // 2 + 1] AS median_price
    FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_discount > 0.05) > 0""")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice"))
    out = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id"))
    out = out.agg(upper_median_agg(F.col("l_quantity")).alias("median_quantity"), upper_median_agg(some).alias("median_price"), F.count(some).alias("n"))
    return out.where("n > 0").drop("n")


_PIXELS = """px AS (SELECT vec_id, label, i, floor((embedding[3 * i + 1]::DOUBLE + 0.5) * 255 + 0.5) AS r, floor((embedding[3 * i + 2]::DOUBLE + 0.5) * 255 + 0.5) AS g,
    floor((embedding[3 * i + 3]::DOUBLE + 0.5) * 255 + 0.5) AS b FROM embeddings, range(0, 21) t(i))"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of components as colours: (vec_id, label, i, c)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    at = lambda k: half_up((F.try_element_at("embedding", F.col("i") * 3 + k).cast("double") + 0.5) * 255)
    return e.select("vec_id", "label", "i", C.rgb(at(1), at(2), at(3)).alias("c"))


@query(f"""WITH {_PIXELS} SELECT vec_id, i, round(0.2126 * r + 0.7152 * g + 0.0722 * b, 6) AS lum, round(sqrt((r - 10) ** 2 + (g - 20) ** 2 + (b - 30) ** 2), 6) AS dist,
    printf('%02X%02X%02X', greatest(0, least(255, r))::INT, greatest(0, least(255, g))::INT, greatest(0, least(255, b))::INT) AS hex,
    least(255, floor(r / 24 + 0.5) * 24) AS q24, least(255, floor(g / 16 + 0.5) * 16) AS q16,
    round(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END, 6) AS sat, 0.2126 * r + 0.7152 * g + 0.0722 * b < 244 AS dark FROM px""")
def color_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")
    return _pixels(spark, sf_dir).select(
        "vec_id", F.col("i").cast("bigint").alias("i"), r6(C.luminance(c)).alias("lum"), r6(C.distance(c, C.rgb(F.lit(10), F.lit(20), F.lit(30)))).alias("dist"), C.rgb_hex(c).alias("hex"),
        C.quantized(c, 24)[0].alias("q24"), C.quantized(c, 16)[1].alias("q16"), r6(C.saturation(c)).alias("sat"), C.is_foreground(c, F.lit(255)).alias("dark"),
    )


@query(f"""WITH {_PIXELS}, h AS (SELECT label, least(255, floor(r / 16 + 0.5) * 16) AS qr, least(255, floor(g / 16 + 0.5) * 16) AS qg, count(*) AS n, min(vec_id * 100 + i) AS first_at FROM px GROUP BY ALL)
    SELECT label, qr, qg, n FROM h QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, first_at) = 1""")
def color_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent colour bin of each label, ties to the one seen first."""
    q = C.quantized(F.col("c"), 16)
    bins = _pixels(spark, sf_dir).select("label", q[0].alias("qr"), q[1].alias("qg"), (F.col("vec_id") * 100 + F.col("i")).alias("at"))
    bins = bins.groupBy("label", "qr", "qg").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    top = bins.groupBy("label").agg(F.max_by(F.struct("qr", "qg", "n"), F.struct("n", -F.col("first_at"))).alias("t"))
    return top.select("label", "t.*")


@query(f"""WITH {_PIXELS} SELECT label, list_sort(list(r))[count(*) // 2 + 1] AS med_r, list_sort(list(g))[count(*) // 2 + 1] AS med_g, list_sort(list(b))[count(*) // 2 + 1] AS med_b FROM px GROUP BY label""")
def median_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _pixels(spark, sf_dir).groupBy("label").agg(C.median_color(F.collect_list("c")).alias("m"))
    return m.select("label", F.col("m")[0].alias("med_r"), F.col("m")[1].alias("med_g"), F.col("m")[2].alias("med_b"))


@query("""WITH px AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, floor((embedding[i + 1]::DOUBLE + 0.5) * 255 + 0.5) AS v FROM embeddings, range(0, 64) t(i)),
    n AS (SELECT *, lag(v) OVER wx AS l, lead(v) OVER wx AS r, lag(v) OVER wy AS u, lead(v) OVER wy AS d FROM px WINDOW wx AS (PARTITION BY vec_id, y ORDER BY x), wy AS (PARTITION BY vec_id, x ORDER BY y))
    SELECT vec_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, abs(v - 127) * sqrt(3::DOUBLE) > 24 OR greatest(coalesce(abs(v - r), 0), coalesce(abs(v - d), 0)) * 3 > 48 AS fg,
    coalesce((abs(r - l) + abs(d - u)) * 3 > 105, false) AS edge FROM n""")
def gradient_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreground and edge masks of grey 8 x 8 images by neighbours in windows."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    v = half_up((F.col("e").cast("double") + 0.5) * 255)
    px = e.select("vec_id", (F.col("i") % 8).cast("bigint").alias("x"), F.floor(F.col("i") / 8).alias("y"), v.alias("v"))
    across, down = Window.partitionBy("vec_id", "y").orderBy("x"), Window.partitionBy("vec_id", "x").orderBy("y")
    lt, rt, up, dn = F.lag("v").over(across), F.lead("v").over(across), F.lag("v").over(down), F.lead("v").over(down)
    px = px.withColumns({"l": lt, "r": rt}).withColumns({"u": up, "d": dn})
    step = F.greatest(F.coalesce(F.abs(F.col("v") - F.col("r")), F.lit(0)), F.coalesce(F.abs(F.col("v") - F.col("d")), F.lit(0))) * 3
    edge = (F.abs(F.col("r") - F.col("l")) + F.abs(F.col("d") - F.col("u"))) * 3 > 105
    return px.select("vec_id", "x", "y", ((F.abs(F.col("v") - 127) * F.sqrt(F.lit(3.0)) > 24) | (step > 48)).alias("fg"), F.coalesce(edge, F.lit(False)).alias("edge"))


@query("""WITH p AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000 THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS run_no FROM p)
    SELECT user_id, CAST(run_no AS BIGINT) AS run_no, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us FROM r GROUP BY user_id, run_no""")
def run_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    r = folds.runs(e, ["user_id"], "at", 21_600_000_000)
    return r.groupBy("user_id", "run_no").agg(F.count("*").alias("n"), (F.max("at") - F.min("at")).alias("span_us"))


_SESSIONS = """s AS (SELECT 'user-' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS session_id, 1 + user_id % 50 AS total, min(epoch_us(ts) // 1000) AS created_at, max(epoch_us(ts) // 1000) AS updated_at FROM events GROUP BY user_id),
    w AS (SELECT 'user-' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS session_id, event_id % 50 AS idx, event_type AS name, epoch_us(ts) // 1000 AS ts, event_id AS seq FROM events),
    p AS (SELECT session_id, idx, arg_max(name, (ts, seq)) AS name FROM w GROUP BY session_id, idx)"""


def _sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    sid = F.concat(F.lit("user-"), F.lpad(F.col("user_id").cast("string"), 8, "0"))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    events = e.select(sid.alias("session_id"), (1 + F.col("user_id") % 50).cast("int").alias("total"), ms.alias("ts"), F.col("event_id").alias("seq"))
    writes = e.select(sid.alias("session_id"), (F.col("event_id") % 50).cast("int").alias("idx"), F.col("event_type").alias("name"), ms.alias("ts"), F.col("event_id").alias("seq"))
    return state.created(events), state.latest_pages(writes)


@query(f"""WITH {_SESSIONS}, d AS (SELECT s.session_id, count(*) AS n FROM p JOIN s USING (session_id) WHERE idx < total GROUP BY s.session_id)
    SELECT session_id, CAST(total AS INT) AS total, coalesce(n, 0) AS completed, floor(coalesce(n, 0) / total * 10000 + 0.5) / 100 AS progress, coalesce(n, 0) = total AS complete FROM s LEFT JOIN d USING (session_id)""")
def session_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.progress(*_sessions(spark, sf_dir))


@query(f"WITH {_SESSIONS} SELECT session_id, CAST(i AS INT) AS idx, name, CASE WHEN name IS NULL THEN 'pending' ELSE 'completed' END AS status FROM (SELECT session_id, unnest(range(0, total)) AS i FROM s) q LEFT JOIN p ON p.session_id = q.session_id AND p.idx = q.i".replace("SELECT session_id, CAST(i", "SELECT q.session_id, CAST(i"))
def session_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.ordered_pages(*_sessions(spark, sf_dir)).select("session_id", "idx", "name", "status")


@query(f"WITH {_SESSIONS}, n AS (SELECT max(updated_at) AS now FROM s) SELECT session_id, updated_at FROM s, n WHERE updated_at >= now - 21600000")
def ttl_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions, _ = _sessions(spark, sf_dir)
    now = sessions.agg(F.max("updated_at")).scalar()
    return state.alive(sessions, now, F.lit(21_600_000)).select("session_id", "updated_at")


@query(f"WITH {_SESSIONS} SELECT session_id, updated_at FROM s ORDER BY updated_at DESC, session_id LIMIT 24")
def session_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.evicted(_sessions(spark, sf_dir)[0], 24).select("session_id", "updated_at")


def _runs_of(words: F.Column, n: int) -> F.Column:
    """Hashes of all runs of n words: shifted arrays are zipped, so the words are split once a row."""
    count = F.size(words) - (n - 1)
    together = F.arrays_zip(*[F.slice(words, k + 1, count) for k in range(n)])
    return F.array_distinct(F.transform(together, lambda z: F.xxhash64(z)))


_WORDS_ONLY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH d AS (SELECT doc_id, {_WORDS_ONLY.format('text')} AS t FROM documents), b AS (SELECT item_id, {_WORDS_ONLY.format('text')} AS t FROM benchmark)
    SELECT item_id, doc_id FROM b JOIN d ON contains(d.t, b.t) WHERE b.t <> ''""")
def content_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark phrases contained in documents: only pairs that share a run of words are looked at.

    Phrases are matched as character strings, so their words inside (not at the ends) are whole words: the
    first six of them at most are the key. Phrases without words inside are compared with every document.
    """
    b = table(spark, sf_dir, "benchmark").select("item_id", T.words_only(F.col("text")).alias("phrase")).where("phrase <> ''")
    d = table(spark, sf_dir, "documents").select("doc_id", T.words_only(F.col("text")).alias("body"))
    w = F.split("phrase", " ")
    b = b.withColumn("n", F.least(F.lit(6), F.size(w) - 2))
    short = d.join(b.where("n < 1"), F.contains("body", "phrase")).select("item_id", "doc_id")
    found = [short]
    for n in sorted(r.n for r in b.where("n >= 1").select("n").distinct().collect()):  # six values at most
        inner = b.where(F.col("n") == n).withColumn("key", _runs_of(F.slice(w, 2, n), n)[0])
        v = F.split("body", " ")
        keys = d.where(F.size(v) >= n).select("doc_id", F.explode(_runs_of(v, n)).alias("key"))
        # Only hashes and ids travel; the texts of the few pairs that meet come back afterwards.
        met = keys.join(inner.select("key", "item_id"), "key").select("item_id", "doc_id").distinct()
        whole = met.join(inner.select("item_id", "phrase").distinct(), "item_id").join(d, "doc_id")
        found.append(whole.where(F.contains("body", "phrase")).select("item_id", "doc_id"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@query(r"""SELECT doc_id, CAST(len(n) AS INT) AS n_numbers, array_to_string(n, ',') AS numbers FROM (SELECT doc_id,
    regexp_extract_all(trim(regexp_replace(replace(lower(text), '&amp;', '&'), '[^a-z0-9一-鿿.%+-]+', ' ', 'g')), '\b\d+(?:[.,]\d+)?%?\b') AS n FROM documents) WHERE len(n) > 0""")
def content_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").select("doc_id", T.numbers(T.content_text(F.col("text"))).alias("n")).where(F.size("n") > 0)
    return n.select("doc_id", F.size("n").alias("n_numbers"), F.array_join("n", ",").alias("numbers"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS words_md5, md5(regexp_replace(lower(text), '[^a-z0-9一-鿿]+', '', 'g')) AS letters_md5,
    md5(trim(regexp_replace(regexp_replace(replace(lower(text), '&amp;', '&'), '[^a-z0-9一-鿿.%+-]+', ' ', 'g'), ' +', ' ', 'g'))) AS content_md5,
    md5(trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), ' +([,.;:!?])', '\1', 'g'))) AS tidy_md5,
    md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS xml_md5 FROM documents""")
def phrase_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    forms = {"words": T.words_only(t), "letters": T.letters_only(t), "content": T.content_text(t), "tidy": T.tidy_line(t), "xml": T.escaped_xml(t)}
    return table(spark, sf_dir, "documents").select("doc_id", *[F.md5(c).alias(f"{n}_md5") for n, c in forms.items()])


_LINES = """t AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS n, hash_key FROM (SELECT *, substring(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), 1, 40) AS hash_key FROM documents))"""


@query(f"""WITH {_LINES} SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, round(CASE WHEN a.n = '' OR b.n = '' THEN 0 WHEN a.n = b.n THEN 1 WHEN contains(a.n, b.n) OR contains(b.n, a.n)
    THEN least(length(a.n), length(b.n)) / greatest(length(a.n), length(b.n), 1) ELSE len(list_intersect(list_distinct(string_split(a.n, ' ')), list_distinct(string_split(b.n, ' '))))
    / greatest(len(list_distinct(string_split(a.n, ' '))), len(list_distinct(string_split(b.n, ' '))), 1) END, 6) AS similarity FROM t a JOIN t b ON a.hash_key = b.hash_key AND a.doc_id < b.doc_id""")
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of the whole texts of documents whose first 40 normalised characters are equal (the reference's own blocking key)."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), T.words_only(F.col("text")).alias("line"))
    met = similarity.similar_pairs(d.withColumn("key", F.substring("line", 1, 40)))
    return met.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "similarity")


_GATES = """p AS (SELECT d.doc_id, d.source, d.lang, CASE WHEN l.toxic = 1 THEN 0.5 ELSE 1.0 END AS content, least(1, 0.9 + d.n_chars / 50000) AS layout, CASE WHEN l.quality = 1 THEN 0.99 ELSE 0.9 END AS looks,
    (CASE WHEN d.n_chars % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN d.n_chars % 11 = 0 THEN 1 ELSE 0 END) AS fails, l.toxic FROM documents d JOIN labels l USING (doc_id)),
    q AS (SELECT *, greatest(0, 1 - fails * 0.34) AS edit FROM p), g AS (SELECT *, greatest(0, least(1, content * 0.3 + layout * 0.25 + looks * 0.25 + edit * 0.2)) AS overall FROM q),
    z AS (SELECT *, toxic = 0 AND fails = 0 AND overall >= 0.98 AND content >= 0.995 AND layout >= 0.96 AND looks >= 0.96 AND edit >= 1 AS passed FROM g)"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.col("n_chars")
    audit = F.struct(
        F.when(n % 7 == 0, 1).otherwise(0).alias("filledTextShapeCount"), F.lit(1).alias("textShapeCount"), F.lit(9.0).alias("minFontPt"),
        (n % 11 == 0).alias("imageOnlyPage"), F.lit(0).alias("rasterPictureCount"), F.lit(1).alias("shapeCount"),
    )
    layout = F.least(F.lit(1.0), 0.9 + n / 50000)
    visual = F.struct(layout.alias("layoutScore"), F.when(F.col("quality") == 1, 0.99).otherwise(0.9).alias("appearanceScore"), layout.alias("similarity"))
    model = F.lit(None).cast("struct<layoutScore:double,appearanceScore:double,contentScore:double,criticalErrors:array<struct<category:string,severity:string,description:string>>>")
    there = F.when(F.col("toxic") == 1, F.array(F.lit("total revenue"))).otherwise(F.array(F.lit("total revenue"), F.lit("42 pages")))
    pages = d.select(
        F.col("doc_id").alias("page_id"), "lang", "source", F.array(F.lit("Total Revenue"), F.lit("42 Pages")).alias("expected"), there.alias("actual"),
        audit.alias("audit"), visual.alias("visual"), model.alias("model"),
    )
    return quality.page_quality(pages)


@query(f"WITH {_GATES} SELECT doc_id AS page_id, CAST(content AS DOUBLE) AS content_score, round(layout, 6) AS layout_score, round(CAST(edit AS DOUBLE), 6) AS edit_score, round(overall, 6) AS overall_score, passed FROM z")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"contentScore": "content_score", "layoutScore": "layout_score", "editabilityScore": "edit_score", "overallScore": "overall_score"}
    return _gated(spark, sf_dir).select("page_id", *[r6(F.col(c)).alias(n) for c, n in names.items()], "passed")


@query(f"""WITH {_GATES} SELECT source, lang, count(*) AS page_count, count(*) FILTER (WHERE passed) AS passed_pages, bool_and(passed) AS all_passed, round(avg(overall), 6) AS average_score,
    round(avg(layout), 6) AS average_layout, 'local-precheck' AS validation_level FROM z GROUP BY source, lang""")
def deck_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.deck_summary(_gated(spark, sf_dir), ["source", "lang"])
    return out.select(
        "source", "lang", F.col("pageCount").alias("page_count"), F.col("passedPages").alias("passed_pages"), F.col("allPassed").alias("all_passed"),
        r6(F.col("averageScore")).alias("average_score"), r6(F.col("averageLayout")).alias("average_layout"), F.col("validationLevel").alias("validation_level"),
    )


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(html, '(?s)<p(?:\s[^>]*)?>.*?</p>')) AS INT) AS n_paragraphs, CAST(len(regexp_extract_all(html, '(?s)<a(?:\s[^>]*)?>.*?</a>')) AS INT) AS n_links,
    md5(array_to_string(list_transform(regexp_extract_all(html, '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1), lambda x: replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&')), '|')) AS texts_md5 FROM pages""")
def markup_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.size(T.blocks(h, "p")).alias("n_paragraphs"), F.size(T.blocks(h, "a")).alias("n_links"), F.md5(F.array_join(T.inner_texts(h, "p"), "|")).alias("texts_md5")
    )


_WRAP = "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'Here it is: ' || props || ' - done' ELSE 'no braces' END"


@query(f"SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE md5(props) END AS json_md5, event_id % 4 <> 3 AS parsed FROM events")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.expr(_WRAP.replace("||", "||").replace("chr(10)", "char(10)"))
    j = T.repaired_json(answer)
    return table(spark, sf_dir, "events").select("event_id", F.md5(j).alias("json_md5"), j.isNotNull().alias("parsed"))


_ICONS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in ({k: k for k in L.ICON_KEYS} | L.ICON_ALIASES).items()) + "}"
_ASKED = "['Analytics', 'growth!', 'Customer 360', 'CRM', 'Cube', 'none', 'Operations', 'unknown thing'][CAST({0} % 8 AS INT) + 1]"


@query(f"SELECT p_partkey, coalesce(({_ICONS})[regexp_replace(lower({_ASKED.format('p_partkey')} || CASE WHEN p_size > 40 THEN ' ' || p_name ELSE '' END), '[^a-z0-9]', '', 'g')], 'other') AS icon_key FROM part")
def icon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("Analytics", "growth!", "Customer 360", "CRM", "Cube", "none", "Operations", "unknown thing")])
    value = F.concat(F.get(names, (F.col("p_partkey") % 8).cast("int")), F.when(F.col("p_size") > 40, F.concat(F.lit(" "), "p_name")).otherwise(""))
    return joins.with_icon_key(table(spark, sf_dir, "part"), value).select("p_partkey", "icon_key")


@query("""WITH l AS (SELECT conv_id AS page_id, turn AS seq, text FROM conversations), f AS (SELECT page_id, seq, arg_max(fix, ord) AS fix, arg_max(role, ord) AS role FROM (
    SELECT page_id, seq, 0 AS ord, 'discarded' AS fix, 'label' AS role FROM l WHERE seq % 2 = 0 UNION ALL SELECT page_id, seq, 1, CASE WHEN seq % 4 = 0 THEN text || ' x' ELSE repeat(text, 3) END, CASE WHEN seq % 4 = 0 THEN 'title' ELSE 'odd' END FROM l WHERE seq % 2 = 0) GROUP BY page_id, seq)
    SELECT l.page_id, l.seq, f.role IS NOT NULL AS corrected, CASE WHEN f.role IS NULL THEN NULL WHEN f.role IN ('title', 'subtitle', 'body', 'label') THEN f.role ELSE 'body' END AS role FROM l LEFT JOIN f USING (page_id, seq)""")
def line_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("seq"), "text")
    even = c.where("seq % 2 = 0")
    first = even.select("page_id", F.col("seq").alias("id"), F.lit(0).alias("ord"), F.lit("discarded").alias("text"), F.lit("label").alias("role"))
    last = even.select(
        "page_id", F.col("seq").alias("id"), F.lit(1).alias("ord"), F.when(F.col("seq") % 4 == 0, F.concat("text", F.lit(" x"))).otherwise(F.repeat("text", 3)).alias("text"),
        F.when(F.col("seq") % 4 == 0, "title").otherwise("odd").alias("role"),
    )
    out = joins.corrected_lines(c, first.unionByName(last))
    return out.select("page_id", "seq", F.col("textRole").isNotNull().alias("corrected"), F.col("textRole").alias("role"))


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS iteration, o_totalprice / 500000 AS score FROM orders)
    SELECT o_custkey AS run_id, count(*) AS rounds, round(max(score), 6) AS best FROM x WHERE iteration <= 1 GROUP BY o_custkey""")
def loop_first_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.replayed_loop(_loop(spark, sf_dir), most=1)
    return out.select("run_id", F.col("iterations").cast("bigint").alias("rounds"), r6(F.col("best_score")).alias("best"))


def _loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = quality.numbered(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "run_id"), "o_orderkey", page="run_id")
    return o.select("run_id", F.col("seq").alias("iteration"), (F.col("o_totalprice") / 500000).alias("score"), (F.col("o_totalprice") > 450000).alias("passed"))


@query("""WITH RECURSIVE x AS (SELECT o_custkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_totalprice / 500000 AS score, o_totalprice > 450000 AS ok FROM orders),
    r AS (SELECT run_id, 1 AS n, score AS best, 1 AS best_at, 0 AS idle, ok AS best_ok, CASE WHEN ok THEN 'quality-gates-passed' ELSE '' END AS why FROM x WHERE pos = 1
        UNION ALL SELECT run_id, n, CASE WHEN up THEN score ELSE best END, CASE WHEN up THEN n ELSE best_at END, idle, CASE WHEN up THEN ok ELSE best_ok END,
            CASE WHEN ok THEN 'quality-gates-passed' WHEN idle >= 2 THEN 'stagnated' WHEN n >= 10 THEN 'iteration-limit' ELSE '' END
        FROM (SELECT r.run_id, r.n + 1 AS n, r.best, r.best_at, r.best_ok, x.score, x.ok, x.score > r.best + 0.0005::DOUBLE AS up, CASE WHEN x.score > r.best + 0.0005::DOUBLE THEN 0 ELSE r.idle + 1 END AS idle
            FROM r JOIN x ON x.run_id = r.run_id AND x.pos = r.n + 1 WHERE r.why = ''))
    SELECT run_id, round(best, 6) AS best, best_at AS best_iteration, n AS iterations, CASE why WHEN '' THEN 'iteration-limit' ELSE why END AS stop_reason, best_ok AS passed
    FROM r QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC) = 1""")
def loop_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.replayed_loop(_loop(spark, sf_dir)).select("run_id", r6(F.col("best_score")).alias("best"), "best_iteration", "iterations", "stop_reason", "passed")


@query(f"""WITH {_PIXELS}, d AS (SELECT label, (abs(r - 100) + abs(g - 120) + abs(b - 140)) / 3 AS e FROM px)
    SELECT label, round(avg(e), 6) AS mae, round(count(*) FILTER (WHERE e > 24) / count(*), 6) AS changed_ratio, round(greatest(0, least(1, 1 - avg(e) / 255)), 6) AS similarity FROM d GROUP BY label""")
def difference_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _pixels(spark, sf_dir).select("label", F.col("c").alias("left"), C.rgb(F.lit(100), F.lit(120), F.lit(140)).alias("right"))
    out = quality.difference_metrics(px, ["label"])
    return out.select("label", *[r6(F.col(c)).alias(c) for c in ("mae", "changed_ratio", "similarity")])


@query("SELECT c_custkey, round(CASE WHEN x <= 0.85 THEN x ELSE 0.85 + 0.15 * sqrt((x - 0.85) / 0.15) END, 6) AS similarity FROM (SELECT c_custkey, greatest(0, least(1, c_acctbal / 9000)) AS x FROM customer)")
def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", r6(calibrated(F.col("c_acctbal") / 9000)).alias("similarity"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(u, '^https://[^/?#@]+(/[^?#]*)?$') THEN regexp_replace(u, '/+$', '') END AS safe, regexp_extract(url, '([^/]+)$', 1) AS name FROM (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN replace(url, 'http://', 'https://') || '/' ELSE url || '?q=1' END AS u FROM pages)""")
def url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import file_name

    u = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.replace("url", F.lit("http://"), F.lit("https://")), F.lit("/"))).otherwise(F.concat("url", F.lit("?q=1")))
    return table(spark, sf_dir, "pages").select("page_id", filters.safe_url(u).alias("safe"), file_name(F.col("url")).alias("name"))


@query(r"""WITH t AS (SELECT conv_id, turn, trim(text) AS t, regexp_replace(trim(text), '\s', '', 'g') AS c, 40 + turn * 7 % 60 AS conf FROM conversations)
    SELECT conv_id, turn FROM t WHERE c <> '' AND conf >= 48 AND NOT regexp_matches(c, '^[^A-Za-z0-9]+$') AND NOT (conf < 72 AND regexp_matches(t, '[©®#~{}\\]')) AND NOT (regexp_matches(c, '^\d{4,}$') AND NOT regexp_matches(c, '^(19|20)\d{2}$'))
    AND NOT (regexp_matches(c, '^\d$') AND conf < 80) AND NOT (length(c) <= 3 AND NOT regexp_matches(c, '^\d{1,3}$') AND NOT regexp_matches(c, '(?i)^(AI|IoT|API|CRM|CBS|CSB|SMB|VAS)$'))""")
def plausible_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    ok = filters.plausible(F.col("text"), 40 + F.col("turn") * 7 % 60, G.box(F.lit(0), F.lit(0), F.lit(50), F.lit(50)))
    return c.where(ok).select("conv_id", "turn")


@query("""SELECT event_type AS call_id, md5(string_agg(props, '' ORDER BY event_id)) AS content_md5, arg_max(user_id, event_id) AS last_user FROM events GROUP BY event_type""")
def stream_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import streamed_answer

    delta = F.struct(F.struct(F.col("props").alias("content")).alias("delta"))
    body = F.to_json(F.struct(F.array(delta).alias("choices"), F.col("user_id").cast("string").alias("model")))
    out = streamed_answer(table(spark, sf_dir, "events").select(F.col("event_type").alias("call_id"), F.col("event_id").alias("seq"), body.alias("data")))
    return out.select("call_id", F.md5("content").alias("content_md5"), F.col("model").cast("bigint").alias("last_user"))


@query("SELECT p_partkey, p_name, lpad(CAST(p_partkey AS VARCHAR), 20, '0') AS natural_key FROM part")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", T.natural_key(F.col("p_partkey").cast("string")).alias("natural_key"))


@query()
def draw_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _components(spark, sf_dir).select(
        "page_id", "seq", "type", "bbox", "areaRatio", "c.width", "c.height", "c.fillRatio", F.lit("336699").alias("colorHex"),
        F.lit(False).alias("hasSharpCorners"), F.lit(False).alias("hasDistinctInterior"), F.lit("FFFFFF").alias("interiorColorHex"),
    )
    lines = boxes(spark, sf_dir).where("kind = 'R'").select("page_id", "seq", "kind", "bbox").withColumnRenamed("kind", "text")
    pages = c.select("page_id").distinct().select("page_id", image().alias("image"), slide().alias("slide"))
    return drawing.draw_list(c, lines, pages).select("page_id", "draw_no", "pass", "kind", "seq", r6(F.col("frame.w")).alias("w"))


_KINDS = "[" + ", ".join(f"'{k}'" for k in (*L.OBJECT_KINDS, "text")) + "]"


@query(f"""WITH {BOXES}, o AS (SELECT page_id, seq, ({_KINDS})[CAST(seq % 7 AS INT) + 1] AS k, score / 100000 AS confidence, x1 - x0 AS w, y1 - y0 AS h,
        greatest(0, least(999, floor(x0 * 9 + 0.5))) AS l, greatest(0, least(999, floor(y0 * 9 + 0.5))) AS t FROM boxes),
    g AS (SELECT *, greatest(1, least(1000 - l, floor(w + 0.5))) AS gw, greatest(1, least(1000 - t, floor(h + 0.5))) AS gh FROM o)
    SELECT page_id, seq, CASE k WHEN 'icon' THEN 'semanticIcon' WHEN 'image' THEN 'picture' ELSE k END AS type,
        CAST(greatest(0, floor(l * 200 / 1000 + 0.5)) AS DOUBLE) AS x0, CAST(greatest(0, floor(t * 200 / 1000 + 0.5)) AS DOUBLE) AS y0,
        CAST(least(200, floor((l + gw) * 200 / 1000 + 0.5)) AS DOUBLE) AS x1, CAST(least(200, floor((t + gh) * 200 / 1000 + 0.5)) AS DOUBLE) AS y1,
        CASE k WHEN 'icon' THEN '00FF00' ELSE 'FFFFFF' END AS "colorHex", CASE k WHEN 'icon' THEN ({_ICONS})['growth'] END AS "iconKey", CAST(least(20, seq) AS INT) AS layer
    FROM g WHERE k <> 'text' AND confidence >= 0.55""")
def vision_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model objects sanitised and turned into component rows."""
    b, x = boxes(spark, sf_dir), F.col("bbox")
    o = F.struct(
        F.element_at(F.array(*[F.lit(k) for k in (*L.OBJECT_KINDS, "text")]), (F.col("seq") % 7 + 1).cast("int")).alias("kind"),
        F.struct((x["x0"] * 9).alias("x"), (x["y0"] * 9).alias("y"), G.width(x).alias("w"), G.height(x).alias("h")).alias("bbox"),
        F.col("kind").alias("label"), F.lit("growth").alias("iconKey"), F.lit("00ff00").alias("foregroundColor"), F.lit("oval").alias("backgroundShape"),
        F.lit("zz").alias("backgroundColor"), (F.col("score") / 100000).alias("confidence"), F.lit(True).alias("containsText"), F.col("seq").alias("layer"),
    )
    rows = b.select("page_id", "seq", F.explode(L.sane_objects(F.array(o))).alias("object")).withColumn("image", image())
    return joins.semantic_components(rows).select("page_id", "seq", "type", "bbox.*", "colorHex", "iconKey", "layer")
