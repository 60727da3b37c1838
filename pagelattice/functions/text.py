"""Text normalisation, similarity and extraction with ASCII word classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the normalisation rules understand it (Unicode spaces and the byte-order mark included).
SPACE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Characters kept beside a-z and 0-9.
CJK = r"\x{4e00}-\x{9fff}"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def text_or_empty(t: Column) -> Column:
    return F.coalesce(t, F.lit(""))


def units(t: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.char_length(t) + F.regexp_count(t, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def collapsed(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, f"{SPACE}+", " "))


def words_only(t: Column) -> Column:
    """Lower case, everything but a-z and 0-9 a single space."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(t)), "[^a-z0-9]+", " "))


def letters_only(t: Column) -> Column:
    """Lower case, only a-z, 0-9 and CJK, without separators."""
    return F.regexp_replace(F.lower(text_or_empty(t)), f"[^a-z0-9{CJK}]+", "")


def content_text(t: Column) -> Column:
    """Lower case, with CJK and the signs . % + - kept."""
    plain = F.replace(F.lower(text_or_empty(t)), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, f"[^a-z0-9{CJK}.%+-]+", " "), " +", " "))


def tidy_line(t: Column) -> Column:
    """White space collapsed, none before , . ; : ! ?"""
    one = F.regexp_replace(text_or_empty(t), f"{SPACE}+", " ")
    return F.trim(F.regexp_replace(one, r" +([,.;:!?])", "$1"))


def _similarity(a: Column, b: Column, parts) -> Column:  # noqa: ANN001
    """Equal 1; contained: ratio of lengths; else shared parts over the larger set of parts; empty 0."""
    left, right = F.array_distinct(parts(a)), F.array_distinct(parts(b))
    most = F.greatest(F.size(left), F.size(right), F.lit(1))
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when(F.contains(a, b) | F.contains(b, a), ratio)
        .otherwise(F.size(F.array_intersect(left, right)) / most)
    )


def line_similarity(a: Column, b: Column) -> Column:
    return _similarity(words_only(a), words_only(b), lambda t: F.split(t, " +"))


def character_similarity(a: Column, b: Column) -> Column:
    return _similarity(letters_only(a), letters_only(b), lambda t: F.filter(F.split(t, ""), lambda c: c != ""))


def decoded_xml(t: Column) -> Column:
    out = text_or_empty(t)
    for entity, plain in _ENTITIES:  # the ampersand last
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return out


def escaped_xml(t: Column, apostrophe: str = "&apos;") -> Column:
    out = text_or_empty(t)
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", apostrophe)):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def escaped_html(t: Column) -> Column:
    return escaped_xml(t, "&#039;")


def blocks(xml: Column, tag: str) -> Column:
    """Whole elements of a tag, shortest first match; elements do not nest."""
    return F.regexp_extract_all(text_or_empty(xml), F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}>"), 0)


def inner_texts(xml: Column, tag: str) -> Column:
    return F.transform(F.regexp_extract_all(text_or_empty(xml), F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), 1), decoded_xml)


_RELATION = r'<Relationship\b[^>]*\bId="([^"]+)"[^>]*\bTarget="([^"]+)"[^>]*/?>'


def relationship_targets(xml: Column) -> Column:
    """Map id -> target of the elements that have Id before Target; the last of an id wins."""
    xml = text_or_empty(xml)
    pairs = F.arrays_zip(
        F.regexp_extract_all(xml, F.lit(_RELATION), 1).alias("id"), F.regexp_extract_all(xml, F.lit(_RELATION), 2).alias("target")
    )
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["id"] == p["id"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["id"], p["target"])))


_EXTENT = (
    r'(?s)<a:xfrm(?:\s[^>]*)?>.*?<a:off\b[^>]*\bx="-?\d+"[^>]*\by="-?\d+"[^>]*/>'
    r'.*?<a:ext\b[^>]*\bcx="(\d+)"[^>]*\bcy="(\d+)"[^>]*/>'
)


def picture_area_ratio(xml: Column, slide_width: Column, slide_height: Column) -> Column:
    part = lambda n: F.coalesce(F.regexp_extract(xml, _EXTENT, n).try_cast("double"), F.lit(0.0))
    return F.coalesce(F.try_divide(part(1) * part(2), slide_width * slide_height), F.lit(0.0))


def numbers(t: Column) -> Column:
    """Numbers between ASCII word boundaries, with one decimal part and a percent sign if a word follows it."""
    edge = r"(?<![A-Za-z0-9_])\d+(?:[.,]\d+)?%(?=[A-Za-z0-9_])|(?<![A-Za-z0-9_])\d+(?:[.,]\d+)?(?![A-Za-z0-9_])"
    whole = r"|(?<![A-Za-z0-9_])\d+(?![A-Za-z0-9_])"
    return F.regexp_extract_all(text_or_empty(t), F.lit(f"({edge}{whole})"), 1)


def redacted(t: Column, secret: Column) -> Column:
    return F.when(F.coalesce(secret, F.lit("")) == "", t).otherwise(F.replace(t, secret, F.lit("[hidden]")))


def file_signature(files: Column) -> Column:
    """name:size:mtime of array<struct<name, size, mtime>>, joined by |."""
    return F.array_join(F.transform(files, lambda f: F.concat_ws(":", f["name"], f["size"], f["mtime"])), "|")


def endpoint(base: Column, suffix: str) -> Column:
    root = F.regexp_replace(base, "/+$", "")
    part = "/" + suffix.lstrip("/")
    return F.when(F.endswith(root, F.lit(part)), root).otherwise(F.concat(root, F.lit(part)))


def error_message(body: Column, status: Column) -> Column:
    """error.message, message, error (if a string), HTTP status: the first that is not empty."""
    some = lambda c: F.when(c != "", c)
    plain = F.get_json_object(body, "$.error")
    return F.coalesce(
        some(F.get_json_object(body, "$.error.message")),
        some(F.get_json_object(body, "$.message")),
        F.when(~plain.rlike(r"^[\[{]"), some(plain)),
        F.concat(F.lit("HTTP "), status.cast("string")),
    )


def svg_data_uri(svg: Column) -> Column:
    encoded = F.regexp_replace(F.base64(F.encode(svg, "UTF-8")), r"\s", "")
    return F.concat(F.lit("data:image/svg+xml;base64,"), encoded)


def _valid(t: Column) -> Column:
    return F.when(F.try_parse_json(t).isNotNull(), t)


def repaired_json(t: Column) -> Column:
    """Valid JSON text out of an answer: code fences off, else the outermost brackets; null if neither parses."""
    trimmed = F.trim(F.regexp_replace(text_or_empty(t), rf"^{SPACE}+|{SPACE}+$", ""))
    bare = F.regexp_replace(F.regexp_replace(trimmed, r"^(?i)```(?:json)?\s*", ""), r"\s*```$", "")
    bare = F.trim(bare)
    return F.coalesce(_valid(bare), _valid(F.regexp_extract(bare, r"(?s)([{\[].*[}\]])", 1)))


def chat_text(response: Column) -> Column:
    """Text of a chat answer: a string, parts of text, or the arguments of the first tool call."""
    content = F.get_json_object(response, "$.choices[0].message.content")
    raw = F.from_json(response, "choices array<struct<message:struct<content:string>>>")["choices"][0]["message"]["content"]
    parts = F.from_json(raw, "array<string>")
    piece = lambda p: F.coalesce(F.get_json_object(p, "$.text"), F.when(~p.rlike(r"^\s*\{"), p))
    joined = F.array_join(F.filter(F.transform(parts, piece), lambda p: p.isNotNull()), "")
    arguments = F.get_json_object(response, "$.choices[0].message.tool_calls[0].function.arguments")
    return F.when(content.isNotNull() & ~content.rlike(r"^\s*\["), content).otherwise(
        F.coalesce(F.when(joined != "", joined), arguments)
    )


_OUTPUT = "output_text string, output array<struct<type:string,content:array<struct<type:string,text:string>>>>"


def output_text(response: Column) -> Column:
    """output_text, or the first text part of a message in output."""
    r = F.from_json(response, _OUTPUT)
    messages = F.filter(F.coalesce(r["output"], F.array()), lambda o: o["type"] == "message")
    parts = F.flatten(F.transform(messages, lambda o: F.coalesce(o["content"], F.array())))
    texts = F.filter(parts, lambda p: (p["type"] == "output_text") & p["text"].isNotNull())
    return F.coalesce(r["output_text"], F.try_element_at(texts, F.lit(1))["text"])


def natural_key(name: Column) -> Column:
    """Sort key that orders runs of digits by value: digits padded to 20 places, without case."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)
    padded = F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=\\d)", ""), 20, "0")).otherwise(p))
    return F.array_join(padded, "")
