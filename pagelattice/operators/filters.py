"""Row filters of page analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.layout import MIN_SHAPE_SHARE, forbidden_fallback
from ..functions.numeric import upper_median
from ..functions.text import SPACE, collapsed, units

#: Short lines that are kept.
ACRONYMS = ("AI", "IoT", "API", "CRM", "CBS", "CSB", "SMB", "VAS")


def plausible(text: Column, confidence: Column, bbox: Column) -> Column:
    """A recognised line that is probably text."""
    trimmed = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")
    compact = F.regexp_replace(trimmed, SPACE, "")
    is_year, digit = compact.rlike(r"^(?:19|20)\d{2}$"), compact.rlike(r"^\d$")
    weak_digit = digit & ((confidence < 80) | (G.width(bbox) < 6) | (G.height(bbox) < 8))
    known = compact.rlike(r"^\d{1,3}$") | compact.rlike("(?i)^(" + "|".join(ACRONYMS) + ")$")
    bad = (
        (compact == "")
        | (confidence < 48)
        | compact.rlike("^[^A-Za-z0-9]+$")
        | ((confidence < 72) & trimmed.rlike(r"[©®#~{}\\]"))
        | trimmed.rlike(rf"^(\d)(?:{SPACE}+\1){{2,}}\.?$")
        | (compact.rlike(r"^\d{4,}$") & ~is_year)
        | weak_digit
        | ((units(compact) <= 3) & ~known)
    )
    return ~F.coalesce(bad, F.lit(True))


def lone_digit_in_margin(text: Column, bbox: Column, image: Column) -> Column:
    """True but for a single digit away from the left, right and bottom margins."""
    margin = (bbox["x0"] < image["width"] * 0.08) | (bbox["x1"] > image["width"] * 0.92) | (bbox["y0"] > image["height"] * 0.9)
    return ~F.trim(text).rlike(r"^\d$") | margin


def large_enough(bbox: Column, image: Column) -> Column:
    return G.area(bbox) / (image["width"] * image["height"]) >= MIN_SHAPE_SHARE


def skipped_picture(w: Column, h: Column, filled: Column, image: Column, area_ratio: Column) -> Column:
    return forbidden_fallback(w, h, filled, image) & (area_ratio > 0.6)


def line_from_words(line: Column) -> Column:
    """A line whose text and box come from its credible words: confidence 42 and up, of usual height."""
    words = F.filter(F.coalesce(line["words"], F.array()), lambda w: (w["confidence"] >= 42) & w["text"].rlike("[A-Za-z0-9]"))
    high = lambda w: w["bbox"]["y1"] - w["bbox"]["y0"]
    heights = F.filter(F.transform(words, high), lambda h: h > 0)
    middle = F.when(F.size(heights) > 0, upper_median(heights)).otherwise(F.lit(1.0))
    usual = F.filter(
        words,
        lambda w: (high(w) <= middle * 1.65)
        | ((F.length(F.regexp_replace(w["text"], "[^A-Za-z0-9_]", "")) >= 4) & (w["confidence"] >= 78)),
    )
    kept = F.when(F.size(usual) > 0, usual).otherwise(words)
    side = lambda k: F.transform(kept, lambda w: w["bbox"][k])
    text = collapsed(F.array_join(F.transform(kept, lambda w: w["text"]), " "))
    bbox = G.box(F.array_min(side("x0")), F.array_min(side("y0")), F.array_max(side("x1")), F.array_max(side("y1")))
    return F.when(F.size(words) == 0, F.struct(line["text"].alias("text"), line["bbox"].alias("bbox"), line["words"].alias("words"))).otherwise(
        F.struct(text.alias("text"), bbox.alias("bbox"), kept.alias("words"))
    )


def band_line(words: Column, left: Column, top: Column, scale: float = 0.5) -> Column:
    """A line of a band read at twice its size, back on the page; null without a credible word.

    A leading word of one character goes if a gap of more than 0.7 of its height follows it.
    """
    good = F.filter(words, lambda w: (w["confidence"] >= 55) & w["text"].rlike("[A-Za-z0-9]"))
    first, second = F.try_element_at(good, F.lit(1)), F.try_element_at(good, F.lit(2))
    tall = F.greatest(F.lit(1.0), first["bbox"]["y1"] - first["bbox"]["y0"])
    stray = (F.size(good) > 2) & (F.length(first["text"]) == 1) & (second["bbox"]["x0"] - first["bbox"]["x1"] > tall * 0.7)
    kept = F.when(stray, F.slice(good, 2, F.greatest(F.size(good), F.lit(1)))).otherwise(good)
    side = lambda k: F.transform(kept, lambda w: w["bbox"][k])
    total = F.aggregate(kept, F.lit(0.0), lambda s, w: s + w["confidence"])
    return F.when(
        F.size(kept) > 0,
        F.struct(
            F.array_join(F.transform(kept, lambda w: w["text"]), " ").alias("text"),
            (total / F.size(kept)).alias("confidence"),
            F.lit("FFFFFF").alias("forcedColorHex"),
            G.box(
                left + F.array_min(side("x0")) * scale, top + F.array_min(side("y0")) * scale,
                left + F.array_max(side("x1")) * scale, top + F.array_max(side("y1")) * scale,
            ).alias("bbox"),
        ),
    )


def valid_session_id(value: Column) -> Column:
    return F.trim(value).rlike("^[A-Za-z0-9_-]{8,128}$")


def safe_url(value: Column) -> Column:
    """The address without closing slashes, or null: https (http on this machine only), no user, query or fragment."""
    url = F.trim(value)
    host = F.lower(F.regexp_extract(url, r"^(?i)https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    local = url.rlike("^(?i)http://") & host.isin("127.0.0.1", "localhost", "[::1]")
    fine = (url.rlike("^(?i)https://") | local) & (host != "") & ~url.rlike(r"^(?i)https?://[^/?#]*@") & ~url.rlike("[?#].")
    return F.when(fine, F.regexp_replace(F.regexp_replace(url, "[?#]$", ""), "/+$", ""))


def not_worth_a_retry(message: Column) -> Column:
    """Errors of access and credit, which a second attempt does not mend."""
    return message.rlike("(?i)(401|403|api key|authentication|unauthorized|forbidden|余额|欠费|无权限)")


def lines_for_model(lines: DataFrame, most: int = 300) -> DataFrame:
    """The first lines of each page (page_id, seq), which are what a model is asked about."""
    return lines.withColumn("id", F.row_number().over(Window.partitionBy("page_id").orderBy("seq")) - 1).where(F.col("id") < most)


def upload_size(files: DataFrame) -> DataFrame:
    """How many files (size in bytes) and their size in MB, with one place."""
    total = F.coalesce(F.sum(F.col("size") / 1024 / 1024), F.lit(0.0))
    return files.agg(F.count("*").alias("files"), F.round(total, 1).alias("megabytes"))


def first_files(files: DataFrame, most: int = 50) -> DataFrame:
    """The first images by natural name order."""
    from ..functions.text import natural_key

    return files.where(F.col("mime").startswith("image/")).orderBy(natural_key(F.col("name")), "name").limit(most)
