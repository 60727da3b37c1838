"""Joins, folds, scoring, state and sources on hand-checked pages."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from pagelattice.functions import geometry as G
from pagelattice.operators import drawing, filters, folds, joins, quality, state
from pagelattice.sources import files

B = "struct<x0:double,y0:double,x1:double,y1:double>"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_the_forced_line_of_two_equal_ones_stays(spark):
    lines = spark.createDataFrame(
        [(1, 0, "Network", 86.0, (10.0, 10.0, 110.0, 30.0), None), (1, 1, "Network", 78.0, (11.0, 10.0, 111.0, 30.0), "FFFFFF"), (1, 2, "Other", 50.0, (0.0, 90.0, 9.0, 99.0), None)],
        f"page_id int, seq int, text string, confidence double, bbox {B}, forcedColorHex string",
    )
    got = folds.suppress_duplicate_lines(lines)
    assert rows(got, "read_seq", "seq", "forcedColorHex") == [(0, 1, "FFFFFF"), (1, 2, None)]


def test_a_suppressed_line_suppresses_nothing(spark):
    chain = [(1, i, "same words", 90.0 - i, (10.0 * i, 0.0, 10.0 * i + 20.0, 10.0), None) for i in range(3)]
    far = [(1, 9, "same words", 10.0, (0.0, 500.0, 20.0, 510.0), None)]
    lines = spark.createDataFrame(chain + far, f"page_id int, seq int, text string, confidence double, bbox {B}, forcedColorHex string")
    assert [r.seq for r in folds.suppress_duplicate_lines(lines).orderBy("read_seq").collect()] == [0, 9]


def test_boxes_merge_in_order_not_by_components():
    # the first box is finished before the third joins the second, so it is not looked at again
    a, b, c = (0.0, 0.0, 10.0, 10.0), (30.0, 0.0, 40.0, 10.0), (12.0, 0.0, 28.0, 10.0)
    assert folds.merged([a, b, c], 2.0) == [(0.0, 0.0, 40.0, 10.0)]
    assert folds.merged([a, (50.0, 0.0, 60.0, 10.0)], 5.0) == [a, (50.0, 0.0, 60.0, 10.0)]
    low, high, bridge = (0.0, 0.0, 4.0, 4.0), (20.0, 20.0, 24.0, 24.0), (24.0, 0.0, 25.0, 21.0)
    assert folds.merged([low, high, bridge], 0.0) == [low, (20.0, 0.0, 25.0, 24.0)]


def test_quadrant_objects_widen_the_accepted_one(spark):
    image = (F.lit(1000.0), F.lit(600.0))
    q = G.quadrant_table(spark, 1000, 600).where("label in ('top-left', 'top-right')")
    g = F.struct(F.when(F.col("seq") == 0, 800.0).otherwise(0.0).alias("x"), F.lit(100.0).alias("y"), F.lit(200.0).alias("w"), F.lit(200.0).alias("h"))
    objects = q.select(
        F.lit(1).alias("page_id"), "seq", F.lit("icon").alias("kind"), G.quadrant_to_page(g, F.struct("left", "top", "width", "height"), *image).alias("bbox"),
        F.lit("CRM").alias("label"), (0.9 - F.col("seq") * 0.1).alias("confidence"), F.col("seq").alias("layer"),
    )
    got = folds.merge_quadrants(objects).collect()
    assert len(got) == 1 and got[0].bbox.w >= 108 and got[0].confidence == 0.9 and got[0].layer == 0


def test_earlier_components_count_even_if_they_go_themselves(spark):
    c = spark.createDataFrame([(1, i, (i * 1.5, 0.0, 20.0 + i * 1.5, 10.0)) for i in range(3)], f"page_id int, seq int, bbox {B}")
    none = c.limit(0)
    assert rows(joins.drop_repeats(c, none), "seq") == [(0,)]


def test_semantic_and_local_components(spark):
    local = spark.createDataFrame(
        [(1, 0, (0.0, 0.0, 10.0, 10.0), "icon", None), (1, 1, (0.0, 0.0, 10.0, 10.0), "roundRect", "solidBand")], f"page_id int, seq int, bbox {B}, type string, source string"
    )
    sem = spark.createDataFrame(
        [(1, 0, (0.0, 0.0, 10.0, 10.0), "rect", "vision", 2), (1, 1, (0.0, 0.0, 11.0, 11.0), "semanticIcon", "vision", 1)],
        f"page_id int, seq int, bbox {B}, type string, source string, layer int",
    )
    got = joins.merge_semantic(local, sem).orderBy("draw_seq").collect()
    assert [(r.type, r.source) for r in got] == [("roundRect", "solidBand"), ("semanticIcon", "vision")]


def test_corrections_keep_the_geometry(spark):
    lines = spark.createDataFrame([(1, 0, "Network Archltecture", 5), (1, 1, "Total", 6)], "page_id int, seq int, text string, x int")
    fixes = spark.createDataFrame(
        [(1, 0, 0, "wrong", "body"), (1, 0, 1, "Network  Architecture", "title"), (1, 1, 2, "something else altogether", "shout")],
        "page_id int, id int, ord int, text string, role string",
    )
    got = rows(joins.corrected_lines(lines, fixes), "seq", "text", "textRole", "textEnhanced", "x")
    assert got == [(0, "Network Architecture", "title", True, 5), (1, "Total", "body", False, 6)]


def test_positions_must_match(spark):
    a, b = spark.createDataFrame([(0, "x"), (1, "y")], "page_index int, a string"), spark.createDataFrame([(0, "z")], "page_index int, b string")
    assert joins.positional(a.limit(1), b).count() == 1
    with pytest.raises(Exception, match="page counts differ"):
        joins.positional(a, b).collect()


def test_content_and_page_gates(spark):
    visual, none = (1.0, 1.0, 1.0), None
    audit = lambda filled: (filled, 1, 9.0, False, 0, 1)
    schema = (
        "page_id int, expected array<string>, actual array<string>, audit struct<filledTextShapeCount:int,textShapeCount:int,minFontPt:double,imageOnlyPage:boolean,rasterPictureCount:int,shapeCount:int>,"
        " visual struct<layoutScore:double,appearanceScore:double,similarity:double>, model struct<layoutScore:double,appearanceScore:double,contentScore:double,criticalErrors:array<struct<category:string,severity:string,description:string>>>"
    )
    data = [
        (1, ["Revenue 2026", "AI Platform"], ["Revenue", "Platform"], audit(0), visual, none),
        (2, ["Revenue"], ["Revenue"], audit(1), visual, none),
        (3, ["Revenue"], ["Revenue"], audit(0), visual, none),
        (4, [], [], audit(0), visual, (1.0, 1.0, 1.0, [("x", "critical", "bad arrow")])),
    ]
    got = {r.page_id: r for r in quality.page_quality(spark.createDataFrame(data, schema)).collect()}
    assert len(got[1].content.missing) >= 1 and got[1].content.criticalNumbersMissing == ["2026"] and not got[1].passed
    assert not got[2].passed and got[2].diagnostics[0].category == "editability" and got[2].editabilityScore == pytest.approx(0.66)
    assert got[3].passed and got[3].validationLevel == "local-precheck"
    assert not got[4].passed and got[4].diagnostics[0].message == "bad arrow" and got[4].content.score == 1.0
    scored = quality.page_quality(spark.createDataFrame(data, schema))
    everyone = quality.failed_page(spark.range(1, 6).select(F.col("id").cast("int").alias("page_id")), scored)
    deck = quality.deck_summary(everyone).first()
    assert deck.pageCount == 5 and deck.passedPages == 1 and not deck.allPassed
    empty = quality.deck_summary(scored.limit(0)).first()
    assert (empty.pageCount, empty.allPassed, empty.averageScore, empty.validationLevel) == (0, False, 0.0, "full-model-and-local")


def test_loops_stop_and_keep_the_best(spark):
    data = [(1, i, s, False) for i, s in enumerate([0.8, 0.9, 0.7, 0.7])] + [(2, i, 0.8, False) for i in range(9)] + [(3, i, i / 100, False) for i in range(20)] + [(4, 0, 0.99, True), (4, 1, 1.0, True)]
    got = {r.run_id: r for r in quality.replayed_loop(spark.createDataFrame(data, "run_id int, iteration int, score double, passed boolean")).collect()}
    assert (got[1].best_score, got[1].best_iteration) == (0.9, 2)
    assert (got[2].iterations, got[2].stop_reason) == (3, "stagnated")
    assert (got[3].iterations, got[3].stop_reason) == (10, "iteration-limit")
    assert (got[4].iterations, got[4].stop_reason, got[4].passed) == (1, "quality-gates-passed", True)


def test_sessions(spark):
    create = spark.createDataFrame([("session-1", 3, 1000, 0), ("session-2", 4, 900, 1)], "session_id string, total int, ts bigint, seq int")
    writes = spark.createDataFrame(
        [("session-1", i, n, 1000 + k, k) for k, (i, n) in enumerate([(2, "c"), (0, "old"), (1, "b"), (0, "a")])] + [("session-2", 0, "x", 950, 9)],
        "session_id string, idx int, name string, ts bigint, seq int",
    )
    sessions, pages = state.created(create), state.latest_pages(writes)
    assert [r.name for r in state.ordered_pages(sessions, pages).where("session_id = 'session-1'").orderBy("idx").collect()] == ["a", "b", "c"]
    assert rows(state.progress(sessions, pages), "session_id", "progress", "complete") == [("session-1", 100.0, True), ("session-2", 25.0, False)]
    touched = state.touched(sessions, writes)
    assert rows(state.alive(touched, F.lit(1100), F.lit(50)), "session_id") == []
    assert rows(state.alive(touched, F.lit(1053), F.lit(50)), "session_id") == [("session-1",)]
    assert state.evicted(touched, 1).first().session_id == "session-1" and state.oldest(touched).first().session_id == "session-2"
    with pytest.raises(Exception, match="page missing"):
        state.ordered_pages(sessions, pages, whole=True).collect()
    for bad in ([("short", 1, 1, 0)], [("session-1", 51, 1, 0)], [("session-1", 3, 1, 0), ("session-1", 4, 2, 1)]):
        with pytest.raises(Exception, match="not valid|1 to 50|changed"):
            state.created(spark.createDataFrame(bad, create.schema)).collect()


def test_sessions_over_a_stream(spark, tmp_path):
    from pagelattice.streaming.sessions import session_progress

    schema = "session_id string, total int, idx int, ts timestamp"
    spark.sql("SELECT 'session-1' session_id, 4 total, cast(null as int) idx, timestamp'2026-01-01 00:00:00' ts UNION ALL SELECT 'session-1', 4, 2, timestamp'2026-01-01 00:00:05'").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = session_progress(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("progress").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("progress").collect()
    assert [(r.session_id, r.completed, r.progress, r.complete) for r in got] == [("session-1", 1, 25.0, False)]


def test_plausible_lines_and_words(spark):
    cases = {"AI": True, "7 7 7.": False, "12345": False, "2026": True, "~x y z": False, "Hello there": True, "ab": False, "***": False, "": False}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.ok for r in df.select("t", filters.plausible(F.col("t"), F.lit(60.0), G.box(F.lit(0), F.lit(0), F.lit(99), F.lit(20))).alias("ok")).collect()}
    assert got == cases
    urls = {"https://a.b/v1/": "https://a.b/v1", "http://localhost:80/x": "http://localhost:80/x", "http://a.b": None, "https://u:p@a.b": None, "https://a.b?q=1": None, "nope": None}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.s for r in df.select("u", filters.safe_url(F.col("u")).alias("s")).collect()} == urls


def test_recognised_lines(spark):
    pages = spark.createDataFrame([("p", '[{"confidence": 50, "paragraphs": [{"lines": [{"text": " a  b ,", "bbox": {"x0":1,"y0":2,"x1":3,"y1":4}, "words": [{"text":"a"},{"text":" "}]}, {"text": " "}]}]}]')], "page_id string, json string")
    got = files.parsed_recognition(pages).collect()
    assert [(r.seq, r.text, r.confidence, len(r.words), r.words[0].confidence) for r in got] == [(0, "a b,", 50.0, 1, 0.0)]


def test_deck_audit(spark, tmp_path):
    slide = (
        '<p:sp><p:spPr><a:solidFill></a:solidFill></p:spPr><a:t>R&amp;D</a:t><a:rPr sz="1200"/></p:sp><p:sp><p:spPr></p:spPr></p:sp>'
        '<p:pic><a:blip r:embed="r1"/><a:xfrm><a:off x="0" y="0"/><a:ext cx="90" cy="100"/></a:xfrm></p:pic><p:pic><a:blip r:embed="r2"/></p:pic>'
    )
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as deck:
        deck.writestr("ppt/presentation.xml", '<p:sldSz cx="100" cy="100"/>')
        deck.writestr("ppt/slides/slide1.xml", slide)
        deck.writestr("ppt/slides/_rels/slide1.xml.rels", '<Relationship Id="r1" Target="../media/a.svg"/><Relationship Id="r2" Target="b.png"/>')
        deck.writestr("ppt/slides/slide10.xml", '<p:pic><a:xfrm><a:off x="0" y="0"/><a:ext cx="100" cy="95"/></a:xfrm></p:pic>')
    (tmp_path / "d.pptx").write_bytes(body.getvalue())
    decks = spark.read.format("binaryFile").load(str(tmp_path))
    got = files.audited_slides(files.deck_slides(decks)).orderBy("slide_no").collect()
    assert [r.slide_no for r in got] == [1, 10]
    one, ten = got
    assert (one.shapeCount, one.textShapeCount, one.filledTextShapeCount, one.vectorPictureCount, one.rasterPictureCount) == (2, 1, 1, 1, 1)
    assert one.maximumPictureAreaRatio == 0.9 and one.textValues == ["R&D"] and (one.minFontPt, one.maxFontPt) == (12.0, 12.0) and not one.imageOnlyPage
    assert ten.imageOnlyPage and ten.minFontPt is None
    flags = quality.audit_flags(files.audited_slides(files.deck_slides(decks))).first()
    assert (flags.passedTransparentText, flags.hasAppliedFontSizes, flags.passedEditablePages) == (False, True, False)


def test_streamed_answer(spark):
    events = [("c", 0, '{"model":"m","choices":[{"delta":{"content":"{\\"page"}}]}'), ("c", 1, '{"choices":[{"delta":{"content":"Summary\\":1}"},"finish_reason":"stop"}]}'), ("c", 2, "[DONE]")]
    got = files.streamed_answer(spark.createDataFrame(events, "call_id string, seq int, data string")).first()
    assert (got.content, got.model, got.finish) == ('{"pageSummary":1}', "m", "stop")


def test_draw_list(spark):
    c = spark.createDataFrame(
        [(1, i, t, (0.0, 0.0, w, 10.0), 0.01, w, 10.0, 0.9, "336699") for i, (t, w) in enumerate([("icon", 9.0), ("fragment", 9.0), ("rect", 50.0), ("picture", 30.0)])],
        f"page_id int, seq int, type string, bbox {B}, areaRatio double, width double, height double, fillRatio double, colorHex string",
    ).withColumns({"hasSharpCorners": F.lit(False), "hasDistinctInterior": F.lit(False), "interiorColorHex": F.lit("FFFFFF")})
    lines = spark.createDataFrame([(1, 0, "t", (300.0, 300.0, 400.0, 320.0))], f"page_id int, seq int, text string, bbox {B}")
    pages = spark.sql("SELECT 1 page_id, struct(1000D width, 500D height) image, struct(13.333D width, 7.5D height) slide")
    got = drawing.draw_list(c, lines, pages).orderBy("draw_no").collect()
    assert [(r["pass"], r.kind) for r in got] == [(1, "rect"), (2, "picture"), (3, "icon"), (4, "text")]
