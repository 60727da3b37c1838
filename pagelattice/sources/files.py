"""Files as tables: images, recognised lines, slide decks and model answers; reports as JSON."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

IMAGE_GLOB = "*.{png,jpg,jpeg,webp,PNG,JPG,JPEG,WEBP}"

WORD = "struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>"
LINE = f"struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>,words:array<{WORD}>>"
OCR = f"array<struct<confidence:double,paragraphs:array<struct<lines:array<{LINE}>>>>>"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """Image files (path, name, length, content) with natural_key, by which they are to be ordered."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_GLOB).load(folder)
    name = file_name(F.col("path"))
    return files.select("path", name.alias("name"), "length", "modificationTime", "content", T.natural_key(name).alias("natural_key"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images (page_id, height, width, nChannels, data), as the raster operators take them."""
    rows = spark.read.format("image").option("dropInvalid", True).load(folder)
    return rows.select(file_name(F.col("image.origin")).alias("page_id"), "image.height", "image.width", "image.nChannels", "image.data")


def recognised_lines(pages: DataFrame) -> DataFrame:
    """Lines (page_id, seq, text, confidence, bbox, words) of pages (page_id, blocks) of nested recognition results.

    Texts are tidied; empty lines and words go; a line's confidence falls back to its block's, then to 0.
    """
    tidy = lambda w: F.struct(T.tidy_line(w["text"]).alias("text"), F.coalesce(w["confidence"], F.lit(0.0)).alias("confidence"), w["bbox"].alias("bbox"))
    blocks = pages.select("page_id", F.posexplode("blocks").alias("b", "block"))
    paragraphs = blocks.select("page_id", "b", F.col("block.confidence").alias("fallback"), F.posexplode("block.paragraphs").alias("p", "par"))
    lines = paragraphs.select("page_id", "b", "p", "fallback", F.posexplode("par.lines").alias("l", "line"))
    words = F.filter(F.transform(F.coalesce("line.words", F.array()), tidy), lambda w: w["text"] != "")
    lines = lines.select(
        "page_id", "b", "p", "l", T.tidy_line(F.col("line.text")).alias("text"),
        F.coalesce("line.confidence", "fallback", F.lit(0.0)).alias("confidence"), F.col("line.bbox").alias("bbox"), words.alias("words"),
    ).where("text <> ''")
    at = F.struct("b", "p", "l")
    page = lines.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), "text", "confidence", "bbox", "words"))).alias("all"))
    return page.select("page_id", F.posexplode("all").alias("seq", "line")).select("page_id", "seq", "line.text", "line.confidence", "line.bbox", "line.words")


def parsed_recognition(pages: DataFrame, column: str = "json") -> DataFrame:
    return recognised_lines(pages.withColumn("blocks", F.from_json(column, OCR)))


def _deck_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    slide = re.compile(r"ppt/slides/slide(\d+)\.xml")
    for frame in frames:
        rows = []
        for path, content in zip(frame["path"], frame["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as deck:
                names = set(deck.namelist())
                read = lambda n: deck.read(n).decode("utf-8", "replace") if n in names else ""  # noqa: B023, E731
                size = read("ppt/presentation.xml")
                for name in names:
                    found = slide.fullmatch(name)
                    if found:
                        links = read(name.replace("ppt/slides/", "ppt/slides/_rels/") + ".rels")
                        rows.append((path, int(found[1]), name, read(name), links, size))
        yield pd.DataFrame(rows, columns=["deck_id", "slide_no", "name", "xml", "rels", "presentation"])


def deck_slides(files: DataFrame) -> DataFrame:
    """Slide parts of decks (path, content): (deck_id, slide_no, name, xml, rels, presentation)."""
    return files.select("path", "content").mapInPandas(
        _deck_parts, "deck_id string, slide_no int, name string, xml string, rels string, presentation string"
    )


def audited_slides(slides: DataFrame) -> DataFrame:
    """Structure of every slide from its XML, with column expressions only."""
    shapes, pictures = T.blocks(F.col("xml"), "p:sp"), T.blocks(F.col("xml"), "p:pic")
    side = lambda n: F.coalesce(F.regexp_extract("presentation", r'<p:sldSz\b[^>]*\bcx="(\d+)"[^>]*\bcy="(\d+)"', n).try_cast("double"), F.lit(0.0))
    df = slides.withColumns({"shapes": shapes, "pictures": pictures, "sw": side(1), "sh": side(2), "targets": T.relationship_targets(F.col("rels"))})
    texts = F.filter("shapes", lambda s: F.contains(s, F.lit("<a:t>")))
    inner = lambda s: F.regexp_extract(s, r"(?s)<p:spPr(?:\s[^>]*)?>(.*?)</p:spPr>", 1)
    filled = F.filter("texts", lambda s: inner(s).rlike("<a:(?:solidFill|gradFill|blipFill)>"))
    sizes = F.flatten(F.transform("texts", lambda s: F.transform(F.regexp_extract_all(s, F.lit(r'\bsz="(\d+)"'), 1), lambda z: z.cast("double") / 100)))
    media = lambda p: F.transform(F.regexp_extract_all(p, F.lit(r'\br:embed="([^"]+)"'), 1), lambda i: F.try_element_at(F.col("targets"), i))
    vector = F.filter("pictures", lambda p: F.exists(media(p), lambda t: F.coalesce(t.rlike(r"(?i)\.svg(?:$|\?)"), F.lit(False))))
    shares = F.transform("pictures", lambda p: T.picture_area_ratio(p, F.col("sw"), F.col("sh")))
    df = df.withColumn("texts", texts).withColumns({"sizes": sizes, "share": F.greatest(F.lit(0.0), F.coalesce(F.array_max(shares), F.lit(0.0)))})
    return df.select(
        "deck_id", "slide_no", "name",
        F.size("shapes").alias("shapeCount"), F.size("texts").alias("textShapeCount"), F.size(filled).alias("filledTextShapeCount"),
        F.size("pictures").alias("pictureCount"), F.size(vector).alias("vectorPictureCount"),
        (F.size("pictures") - F.size(vector)).alias("rasterPictureCount"), F.col("share").alias("maximumPictureAreaRatio"),
        ((F.size("pictures") > 0) & (F.size("shapes") == 0) & (F.col("share") >= 0.9)).alias("imageOnlyPage"),
        T.inner_texts(F.col("xml"), "a:t").alias("textValues"),
        F.array_min("sizes").alias("minFontPt"), F.array_max("sizes").alias("maxFontPt"),
    )


def streamed_answer(events: DataFrame) -> DataFrame:
    """An answer put together from its stream: events (call_id, seq, data), data as sent, [DONE] closes.

    Deltas are joined in order; of model, usage and finish reason the last one counts.
    """
    body = events.where("trim(data) <> '[DONE]'")
    get = lambda p: F.get_json_object("data", p)
    rows = body.select(
        "call_id", "seq", F.coalesce(get("$.choices[0].delta.content"), F.lit("")).alias("delta"), get("$.model").alias("model"),
        get("$.usage").alias("usage"), get("$.choices[0].finish_reason").alias("finish"),
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "delta"))), lambda r: r["delta"]), "")
    return rows.groupBy("call_id").agg(joined.alias("content"), last("model"), last("usage"), last("finish"))


def write_report(pages: DataFrame, path: str) -> None:
    """Pages as JSON lines, one file a partition."""
    pages.write.mode("overwrite").json(path)


def html_report(rows: DataFrame, title: str) -> DataFrame:
    """(html) of all rows as one table, in the order of their first column: a report of a page a row, not of a corpus."""
    cells = lambda tag, values: F.concat(*[F.concat(F.lit(f"<{tag}>"), v, F.lit(f"</{tag}>")) for v in values])
    line = cells("td", [T.escaped_html(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns])
    head = cells("th", [T.escaped_html(F.lit(c)) for c in rows.columns])
    body = rows.select(F.struct(F.col(rows.columns[0]).alias("at"), F.concat(F.lit("<tr>"), line, F.lit("</tr>")).alias("row")).alias("r"))
    body = body.agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["row"]), "").alias("rows"))
    begin = F.concat(F.lit('<!doctype html><meta charset="utf-8"><title>'), T.escaped_html(F.lit(title)), F.lit("</title><table><tr>"), head, F.lit("</tr>"))
    return body.select(F.concat(begin, "rows", F.lit("</table>")).alias("html"))


def report_header(summary: DataFrame) -> DataFrame:
    """A compact report as base64 of JSON, for a header."""
    return summary.select(F.regexp_replace(F.base64(F.encode(F.to_json(F.struct("*")), "UTF-8")), r"\s", "").alias("report"))
