"""Small operators on rows by hand: what no registered query reaches."""

import base64
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pagelattice.functions import geometry as G
from pagelattice.functions import text as T
from pagelattice.operators import filters, folds, joins, quality, state
from pagelattice.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def box(*sides):
    return G.box(*[F.lit(float(s)) for s in sides])


def word(text, confidence, x0, y0, x1, y1):
    return F.struct(F.lit(text).alias("text"), F.lit(float(confidence)).alias("confidence"), box(x0, y0, x1, y1).alias("bbox"))


def test_files_and_uploads(spark, tmp_path):
    df = spark.createDataFrame([("p10.png", "image/png", 3 << 20), ("p2.png", "image/png", 1 << 19), ("a.txt", "text/plain", 9)], "name string, mime string, size bigint")
    assert [r.name for r in filters.first_files(df).collect()] == ["p2.png", "p10.png"]
    assert [r.name for r in filters.first_files(df, 1).collect()] == ["p2.png"]
    assert filters.upload_size(df.where("mime like 'image%'")).collect() == [Row(files=2, megabytes=3.5)]
    assert filters.upload_size(df.limit(0)).collect() == [Row(files=0, megabytes=0.0)]
    for name in ("b10.png", "b9.PNG", "c.gif"):
        (tmp_path / name).write_bytes(b"1234")
    got = files.image_files(spark, f"file://{tmp_path}").orderBy("natural_key").collect()
    assert [(r.name, r.length) for r in got] == [("b9.PNG", 4), ("b10.png", 4)]
    signature = F.array(F.struct(F.lit("a").alias("name"), F.lit(5).alias("size"), F.lit(7).alias("mtime")), F.struct(F.lit("b").alias("name"), F.lit(1).alias("size"), F.lit(2).alias("mtime")))
    assert one(spark, T.file_signature(signature)) == "a:5:7|b:1:2"


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b & c", None), (1, "<a>", 0.5)], "page_id int, name string, score double")
    files.write_report(rows, f"file://{tmp_path}/r")
    assert sorted(map(tuple, spark.read.schema(rows.schema).json(f"file://{tmp_path}/r").collect())) == [(1, "<a>", 0.5), (2, "b & c", None)]
    html = files.html_report(rows, "T & U").first().html
    assert "<title>T &amp; U</title>" in html and "<tr><td>1</td><td>&lt;a&gt;</td><td>0.5</td></tr><tr><td>2</td><td>b &amp; c</td><td></td></tr></table>" in html
    assert files.html_report(rows.limit(0), "x").first().html.endswith("<th>score</th></tr></table>")
    header = files.report_header(rows.where("page_id = 1")).first().report
    assert json.loads(base64.b64decode(header)) == {"page_id": 1, "name": "<a>", "score": 0.5}
    assert one(spark, T.escaped_html(F.lit("<'\"&>"))) == "&lt;&#039;&quot;&amp;&gt;"


def test_line_filters(spark):
    image = F.struct(F.lit(100.0).alias("width"), F.lit(100.0).alias("height"))
    inside = [(t, x, y) for t, x, y in (("7", 50, 50), ("7", 2, 50), ("7", 50, 95), (" 7 ", 96, 10), ("77", 50, 50))]
    got = [one(spark, filters.lone_digit_in_margin(F.lit(t), box(x, y, x + 3, y + 3), image)) for t, x, y in inside]
    assert got == [False, True, True, True, True]
    words = F.array(word("Total", 90, 0, 0, 10, 10), word("-", 90, 12, 0, 14, 10), word("low", 30, 0, 0, 1, 1), word("x9", 60, 20, 0, 30, 40), word("growth", 80, 32, 2, 60, 30))
    line = F.struct(F.lit("raw").alias("text"), box(0, 0, 99, 99).alias("bbox"), words.alias("words"))
    out = one(spark, filters.line_from_words(line))
    assert out.text == "Total x9 growth" or out.text == "Total growth"
    assert out.bbox.x0 == 0 and out.bbox.x1 == 60
    none = F.struct(F.lit("raw").alias("text"), box(1, 2, 3, 4).alias("bbox"), F.array(word("?", 90, 0, 0, 1, 1)).alias("words"))
    assert one(spark, filters.line_from_words(none)).text == "raw"
    band = F.array(word("i", 80, 0, 0, 4, 10), word("Market", 70, 14, 0, 40, 10), word("share", 60, 44, 0, 80, 12))
    out = one(spark, filters.band_line(band, F.lit(5.0), F.lit(7.0)))
    assert (out.text, out.confidence, out.bbox.x0, out.bbox.y1) == ("Market share", 65.0, 12.0, 13.0)
    assert one(spark, filters.band_line(F.array(word("?", 99, 0, 0, 1, 1)), F.lit(0.0), F.lit(0.0))) is None
    for message, final in (("HTTP 401", True), ("Invalid API key", True), ("timeout after 60 s", False)):
        assert one(spark, filters.not_worth_a_retry(F.lit(message))) is final
    lines = spark.createDataFrame([(p, s, "t") for p in (1, 2) for s in range(0, 640, 2)], "page_id int, seq int, text string")
    kept = filters.lines_for_model(lines).groupBy("page_id").agg(F.count("*").alias("n"), F.max("seq").alias("last"), F.max("id").alias("id")).orderBy("page_id")
    assert [tuple(r) for r in kept.collect()] == [(1, 300, 598, 299), (2, 300, 598, 299)]


def test_boxes_on_the_grid(spark):
    grid = lambda *v: F.struct(*[F.lit(float(x)).alias(k) for k, x in zip("xywh", v, strict=True)])
    assert one(spark, G.grid_iou(grid(0, 0, 10, 10), grid(5, 0, 10, 10))) == pytest.approx(50 / 150)
    assert one(spark, G.grid_iou(grid(0, 0, 10, 10), grid(20, 0, 5, 5))) == 0
    out = one(spark, G.grid_bounding(grid(0, 1, 10, 10), grid(5, 0, 10, 4)))
    assert tuple(out) == (0, 0, 15, 11)
    # the column version and the one that the merge of quadrants uses
    a, b = {"x": 0, "y": 0, "w": 10, "h": 8}, {"x": 3, "y": 2, "w": 10, "h": 10}
    assert folds._grid_iou(a, b) == pytest.approx(one(spark, G.grid_iou(grid(*a.values()), grid(*b.values()))))


def test_pictures(spark):
    image = F.struct(F.lit(100.0).alias("width"), F.lit(100.0).alias("height"))
    whole = filters.skipped_picture(F.lit(95.0), F.lit(95.0), F.lit(0.9), image, F.lit(0.9))
    part = filters.skipped_picture(F.lit(95.0), F.lit(95.0), F.lit(0.9), image, F.lit(0.5))
    small = filters.skipped_picture(F.lit(5.0), F.lit(5.0), F.lit(0.9), image, F.lit(0.9))
    assert [one(spark, x) for x in (whole, part, small)] == [True, False, False]
    pictures = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["c"]), (1, 2, ["zz"]), (2, 0, [])], "page_id int, seq int, ids array<string>")
    relations = spark.createDataFrame([(1, "a", 0, "x.svg"), (1, "a", 1, "x.png"), (1, "b", 0, "y.SVG?v=1"), (1, "c", 0, "c.png"), (2, "a", 0, "q.svg")], "page_id int, id string, ord int, target string")
    got = {(r.page_id, r.seq): r.vector for r in joins.resolved_media(pictures, relations).collect()}
    assert got == {(1, 0): True, (1, 1): False, (1, 2): False, (2, 0): False}


def test_corrections_guard_the_text(spark):
    """Too long or too unlike a text is not taken; the role counts in either case."""
    lines = spark.createDataFrame([(1, 0, "Tota1 revenve"), (1, 1, "Market"), (1, 2, "Cost"), (1, 3, "same")], "page_id int, seq int, text string")
    fixes = [(1, 0, 0, "Total revenue", "title"), (1, 1, 0, "zzzz qqqq", "label"), (1, 2, 0, "Cost " * 30, "odd"), (1, 3, 0, "other", "body"), (1, 3, 1, " same ", "body")]
    out = joins.corrected_lines(lines, spark.createDataFrame(fixes, "page_id int, id int, ord int, text string, role string")).orderBy("seq").collect()
    assert [(r.text, r.textRole, r.textEnhanced) for r in out] == [("Total revenue", "title", True), ("Market", "label", False), ("Cost", "body", False), ("same", "body", False)]
    assert joins.correction_counts(spark.createDataFrame(out)).collect() == [Row(page_id=1, correctionCount=1)]


def test_sessions(spark):
    sessions = spark.createDataFrame([("s1", 2, 0, 100), ("s2", 1, 0, 50)], "session_id string, total int, created_at bigint, updated_at bigint")
    now, ttl = F.lit(120), F.lit(30)
    assert [r.total for r in state.found(sessions, "s1", now, ttl).collect()] == [2] and state.found(sessions, "s2", now, ttl).collect() == []
    assert state.required(sessions, "s1", now, ttl).collect() == state.found(sessions, "s1", now, ttl).collect()
    with pytest.raises(Exception, match="session expired"):
        state.required(sessions, "s2", now, ttl).collect()
    pages = spark.createDataFrame([("s1", 0), ("s2", 0)], "session_id string, idx int")
    left = state.deleted(sessions, pages, spark.createDataFrame([("s2",), ("zz",)], "session_id string"))
    assert [[r.session_id for r in df.collect()] for df in left] == [["s1"], ["s1"]]
    reports = spark.createDataFrame([("s1", "old", 110, 0), ("s1", "new", 110, 1)], "session_id string, report string, ts bigint, seq int")
    got = {r.session_id: (r.report, r.updated_at) for r in state.with_quality(sessions, reports).collect()}
    assert got == {"s1": ("new", 110), "s2": (None, 50)}
    results = spark.createDataFrame([(1, 0, "ok", None), (1, 1, "half", "timeout"), (1, 2, None, None)], "page_id int, seq int, value string, error string")
    got = [tuple(r.settled) for r in state.settled(results).orderBy("seq").collect()]
    assert got == [("fulfilled", "ok", None), ("rejected", None, "timeout"), ("fulfilled", None, None)]
    some = spark.createDataFrame([(1, 1, "second", None), (1, 0, "first", None), (1, 2, "lost", "timeout"), (1, 3, "", None)], "page_id int, seq int, summary string, error string")
    assert folds.page_summary(some).collect() == [Row(page_id=1, pageSummary="first second")]


def test_a_deck_at_once(spark):
    """A page without inputs counts as failed in its deck."""
    gated = "audit struct<filledTextShapeCount:int,textShapeCount:int,minFontPt:double,imageOnlyPage:boolean,rasterPictureCount:int,shapeCount:int>"
    model = "model struct<layoutScore:double,appearanceScore:double,contentScore:double,criticalErrors:array<struct<category:string,severity:string,description:string>>>"
    schema = f"page_id int, expected array<string>, actual array<string>, {gated}, visual struct<layoutScore:double,appearanceScore:double,similarity:double>, {model}"
    audit, visual = (0, 1, 9.0, False, 0, 1), (1.0, 1.0, 1.0)
    inputs = spark.createDataFrame([(1, ["total revenue"], ["total revenue"], audit, visual, None), (2, ["42 pages"], ["none"], audit, visual, None)], schema)
    items = spark.createDataFrame([(1, "d1"), (2, "d2"), (3, "d1")], "page_id int, deck string")
    pages, summary = quality.evaluated_deck(items, inputs, ["deck"])
    assert {r.page_id: r.passed for r in pages.collect()} == {1: True, 2: False, 3: False}
    got = {r.deck: (r.pageCount, r.passedPages, r.allPassed, round(r.averageScore, 3)) for r in summary.collect()}
    assert got["d1"] == (2, 1, False, 0.5) and got["d2"][:3] == (1, 0, False)
