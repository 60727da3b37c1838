"""Scalar rules on hand-checked values."""

import math

import pytest
from pyspark.sql import functions as F

from pagelattice.functions import color as C
from pagelattice.functions import geometry as G
from pagelattice.functions import layout as L
from pagelattice.functions import numeric as N
from pagelattice.functions import text as T


@pytest.fixture(scope="module")
def value(spark):
    def of(*columns):
        return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())

    return of


def test_rounding_medians_and_clamping(value):
    rounded = [N.half_up(F.lit(x)) for x in (-0.5, 0.5, 2.5, 1.49)]
    assert value(*rounded) == (0, 1, 3, 1)
    array = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert value(N.upper_median(array(4, 1, 3, 2)), N.upper_median(array(5, float("nan"), 1)), N.upper_median(F.array().cast("array<double>"), 255.0)) == (3.0, 5.0, 255.0)
    assert value(*[N.clamp01(F.lit(x)) for x in (float("nan"), 2.0, -1.0, 0.4)]) == (0.0, 1.0, 0.0, 0.4)
    assert value(N.clamp01(F.lit(None).cast("double"))) == (0.0,)
    low, mid, high, top = value(*[N.calibrated(F.lit(x)) for x in (0.5, 0.9, 0.94, 2.0)])
    assert low == 0.5 and mid < high and top == 1.0


def box(*v):
    return G.box(*[F.lit(float(x)) for x in v])


def test_boxes(value):
    a, b, far, line = box(0, 0, 10, 10), box(5, 5, 15, 15), box(30, 30, 40, 40), box(10, 0, 10, 5)
    assert value(G.area(a), G.area(line), G.intersection(a, b), G.iou(a, b)) == (100.0, 0.0, 25.0, pytest.approx(25 / 175))
    assert value(G.overlap_of_smaller(a, b), G.overlap_of_first(line, a), G.iou(line, line)) == (0.25, 0.0, 0.0)
    assert value(G.intersects(a, box(10, 10, 20, 20)), G.intersects(a, far), G.intersects(a, far, 20.0)) == (True, False, True)
    grown = value(G.expanded(a, F.lit(3.0), F.lit(12.0), F.lit(50.0)))[0]
    assert tuple(grown) == (0.0, 0.0, 12.0, 13.0)


def test_quadrants_overlap_and_reach_the_corners(spark):
    q = {r.label: r for r in G.quadrant_table(spark, 1000, 600).collect()}
    assert len(q) == 4
    assert q["top-left"].left == 0 and q["top-left"].top == 0
    assert q["top-left"].width > q["top-right"].left and q["top-left"].height > q["bottom-left"].top
    assert q["bottom-right"].left + q["bottom-right"].width == 1000 and q["bottom-right"].top + q["bottom-right"].height == 600


def test_colours(value):
    rgb = lambda *v: C.rgb(*[F.lit(x) for x in v])
    assert value(C.rgb_hex(rgb(14, 103, 209)), C.distance(rgb(0, 0, 0), rgb(3, 4, 0)), C.luminance(rgb(255, 255, 255))) == ("0E67D1", 5.0, pytest.approx(255.0))
    assert value(C.quantized(rgb(250, 12, 11), 24)) == ([240.0, 24.0, 0.0],)
    assert value(C.saturation(rgb(0, 0, 0)), C.saturation(rgb(200, 100, 50))) == (0.0, 0.75)
    assert value(C.clean_hex(F.lit("00ff0a"), "333333"), C.clean_hex(F.lit("oops"), "333333")) == ("00FF0A", "333333")
    assert value(C.median_color(F.array(rgb(1, 9, 5), rgb(3, 7, 5), rgb(2, 8, 6)))) == ([2.0, 8.0, 5.0],)


def test_texts(value):
    assert value(T.words_only(F.lit("  Total—Revenue, 2026! "))) == ("total revenue 2026",)
    assert value(T.letters_only(F.lit("AI 平台 x"))) == ("ai平台x",)
    assert value(T.content_text(F.lit("R&amp;D  +50% 平台")), T.tidy_line(F.lit(" a　b , c !"))) == ("r d +50% 平台", "a b, c!")
    assert value(T.line_similarity(F.lit("Customer care"), F.lit("customer CARE")), T.line_similarity(F.lit(""), F.lit("x"))) == (1.0, 0.0)
    assert value(T.line_similarity(F.lit("abcd"), F.lit("abcdefgh")), T.line_similarity(F.lit("a b c"), F.lit("c d"))) == (0.5, pytest.approx(1 / 3))
    assert value(T.character_similarity(F.lit("Archltecture"), F.lit("Architecture")))[0] > 0.34
    assert value(T.decoded_xml(F.lit("&amp;lt; &lt;b&gt;"))) == ("&lt; <b>",)
    assert value(T.units(F.lit("a😀")), T.units(F.lit("ab"))) == (3, 2)


def test_numbers_between_ascii_word_boundaries(value):
    assert value(T.numbers(F.lit("growth 50% in 2026年 v1.5 9%x"))) == (["50", "2026", "5", "9%"],)
    assert value(T.numbers(F.lit("12ab 3.14 7%"))) == (["3.14", "7"],)


def test_json_and_answers(value):
    fenced = '```json\n{"ok": true}\n```'
    assert value(T.repaired_json(F.lit(fenced)), T.repaired_json(F.lit('so: [1, 2] end')), T.repaired_json(F.lit("nothing"))) == ('{"ok": true}', "[1, 2]", None)
    assert value(T.chat_text(F.lit('{"choices":[{"message":{"content":"hi"}}]}'))) == ("hi",)
    assert value(T.chat_text(F.lit('{"choices":[{"message":{"content":["a",{"text":"b"}]}}]}'))) == ("ab",)
    call = '{"choices":[{"message":{"tool_calls":[{"function":{"arguments":"{1}"}}]}}]}'
    assert value(T.chat_text(F.lit(call))) == ("{1}",)
    out = '{"output":[{"type":"x"},{"type":"message","content":[{"type":"output_text","text":"T"}]}]}'
    assert value(T.output_text(F.lit(out))) == ("T",)
    assert value(T.error_message(F.lit('{"error":{"message":"m"}}'), F.lit(4)), T.error_message(F.lit("{}"), F.lit(404)), T.error_message(F.lit('{"error":"e"}'), F.lit(4))) == ("m", "HTTP 404", "e")
    assert value(T.endpoint(F.lit("https://a/v1/"), "/chat"), T.endpoint(F.lit("https://a/chat"), "chat")) == ("https://a/v1/chat", "https://a/chat")


def test_relationships_and_pictures(value):
    rels = '<Relationship Id="r1" Target="a.png"/><Relationship Target="x" Id="r9"/><Relationship Id="r1" Target="b.svg"/>'
    assert value(T.relationship_targets(F.lit(rels))) == ({"r1": "b.svg"},)
    picture = '<a:xfrm><a:off x="0" y="0"/><a:ext cx="50" cy="20"/></a:xfrm>'
    assert value(T.picture_area_ratio(F.lit(picture), F.lit(100.0), F.lit(100.0)), T.picture_area_ratio(F.lit("<x/>"), F.lit(1.0), F.lit(1.0))) == (0.1, 0.0)
    assert value(T.blocks(F.lit("<p a='1'>x</p><pp>no</pp><p>\ny</p>"), "p")) == (["<p a='1'>x</p>", "<p>\ny</p>"],)


def test_natural_order(spark):
    names = ["page10.png", "page2.png", "Page1.png", "a.png"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(T.natural_key(F.col("n"))).collect()] == ["a.png", "Page1.png", "page2.png", "page10.png"]


def test_icons_and_policy(value):
    assert value(L.icon_key(F.lit("Customer 360")), L.icon_key(F.lit("growth")), L.icon_key(F.lit("none")), L.icon_key(F.lit(None).cast("string"))) == ("customer", "analytics", "none", "other")
    image = F.struct(F.lit(1000.0).alias("width"), F.lit(500.0).alias("height"))
    fallback = lambda w, h, f: L.forbidden_fallback(F.lit(float(w)), F.lit(float(h)), F.lit(f), image)
    assert value(fallback(500, 250, 0.8), fallback(800, 400, 0.04)) == (True, False)


def test_long_title_is_limited_by_its_width(spark):
    row = spark.sql(
        "SELECT struct('A very long presentation title that must not wrap' AS text, struct(10D AS x0, 10D AS y0, 210D AS x1, 60D AS y1) AS bbox,"
        " array(struct('A' AS text, 90D AS confidence, struct(10D AS x0, 10D AS y0, 20D AS x1, 55D AS y1) AS bbox)) AS words) AS line,"
        " struct(1000D AS width, 500D AS height) AS image, struct(13.333D AS width, 6.6665D AS height) AS slide"
    )
    style = row.select(L.font_style(F.col("line"), F.col("image"), F.col("slide")).alias("s")).first().s
    assert 4.5 <= style.fontSize < 20 and style.widthLimited and style.fontFace == "Arial" and style.bold
    assert math.isclose(style.measuredGlyphHeight, 45.0)


def test_width_units(value):
    assert value(L.text_width_units(F.lit("")), L.text_width_units(F.lit("iM A.x"))) == (1.0, pytest.approx(0.28 + 0.9 + 0.28 + 0.61 + 0.28 + 0.52))


def test_sane_evaluation(spark):
    df = spark.sql(
        "SELECT struct(2D AS layoutScore, double('NaN') AS contentScore, 0.5D AS appearanceScore, CAST(null AS DOUBLE) AS semanticScore,"
        " transform(sequence(1, 25), i -> struct('' AS category, 'odd' AS severity, '' AS region, repeat('x', 400) AS description)) AS criticalErrors) AS v"
    )
    got = df.select(L.sane_evaluation(F.col("v")).alias("e")).first().e
    assert (got.layoutScore, got.contentScore, got.semanticScore) == (1.0, 0.0, 0.0) and got.overallScore == pytest.approx(0.28 + 0.11)
    assert len(got.criticalErrors) == 20 and got.criticalErrors[0].severity == "major" and len(got.criticalErrors[0].description) == 300


def test_catalogue_icons(value):
    from pagelattice.functions.icons import STROKES, catalog_svg, catalog_uri

    svg, other, uri = value(
        catalog_svg(F.lit("Growth"), F.lit("00aa11"), F.lit("A & B")), catalog_svg(F.lit("?"), F.lit("x"), F.lit(None).cast("string")),
        catalog_uri(F.lit("crm"), F.lit("000000"), F.lit("")),
    )
    assert STROKES["analytics"] in svg and "#00AA11" in svg and "A &amp; B" in svg
    assert STROKES["application"] in other and "#333333" in other and uri.startswith("data:image/svg+xml;base64,PHN2Zy")
    assert len(STROKES) == 17
