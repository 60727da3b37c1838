"""Order-dependent folds within a page: the accepted rows decide about the next one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import geometry as G
from ..functions.text import line_similarity, words_only

_LINE = "struct<prio:double,seq:bigint,text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>,forcedColorHex:string>"


def suppress_duplicate_lines(lines: DataFrame) -> DataFrame:
    """Greedy suppression per page, by confidence (20 more with a forced colour), ties by seq.

    A line goes if an accepted one overlaps more than 0.42 of the smaller box with a text similarity of
    0.34 or more, or lies in the same band with 0.78 or more. A line that has gone suppresses nothing.
    What stays is numbered in reading order (y0, x0, then order of acceptance): read_seq.
    """
    prio = F.col("confidence") + F.when(F.coalesce("forcedColorHex", F.lit("")) != "", 20).otherwise(0)
    row = F.struct(prio.cast("double").alias("prio"), F.col("seq").cast("bigint").alias("seq"), "text", F.col("confidence").cast("double").alias("confidence"), "bbox", "forcedColorHex")
    page = lines.groupBy("page_id").agg(F.collect_list(row).alias("all"))
    ranked = F.array_sort("all", lambda a, b: F.when(a["prio"] > b["prio"], -1).when(a["prio"] < b["prio"], 1).when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0))

    def middle(b):  # noqa: ANN001, ANN202
        return (b["y0"] + b["y1"]) / 2

    def duplicate(kept, new):  # noqa: ANN001, ANN202
        a, b = kept["bbox"], new["bbox"]
        tall = F.greatest(F.lit(1.0), F.least(G.height(a), G.height(b)))
        band = F.abs(middle(a) - middle(b)) <= tall * 0.55
        alike = line_similarity(kept["text"], new["text"])
        return ((G.overlap_of_smaller(a, b) > 0.42) & (alike >= 0.34)) | (band & (alike >= 0.78))

    empty = F.from_json(F.lit("[]"), f"array<{_LINE}>")
    kept = F.aggregate(ranked, empty, lambda acc, x: F.when(F.exists(acc, lambda k: duplicate(k, x)), acc).otherwise(F.array_append(acc, x)))
    out = page.select("page_id", F.posexplode(kept).alias("accepted", "line"))
    order = Window.partitionBy("page_id").orderBy(F.col("line.bbox.y0"), F.col("line.bbox.x0"), "accepted")
    return out.select("page_id", (F.row_number().over(order) - 1).alias("read_seq"), "line.seq", "line.text", "line.confidence", "line.bbox", "line.forcedColorHex")


def _touch(a: tuple, b: tuple, gap: float) -> bool:
    return a[2] + gap >= b[0] and b[2] + gap >= a[0] and a[3] + gap >= b[1] and b[3] + gap >= a[1]


def merged(boxes: list[tuple[float, float, float, float]], gap: float) -> list[tuple[float, float, float, float]]:
    """Grow the first pending box by pending ones within the gap, last ones first, until nothing changes; then the next.

    A finished box is not looked at again, so results depend on the order: this is not a components search.
    """
    waiting, done = list(boxes), []
    while waiting:
        grown = waiting.pop(0)
        before = -1
        while before != len(waiting):
            before = len(waiting)
            for at in reversed(range(before)):
                if _touch(grown, waiting[at], gap):
                    near = waiting.pop(at)
                    grown = (min(grown[0], near[0]), min(grown[1], near[1]), max(grown[2], near[2]), max(grown[3], near[3]))
        done.append(grown)
    return done


def merge_boxes(boxes: DataFrame, gap: float = 5.0) -> DataFrame:
    """Boxes (page_id, seq, bbox) merged page by page: (page_id, group_seq, bbox)."""
    row = F.struct("seq", *[F.col("bbox")[k].cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")])
    pages = boxes.groupBy("page_id").agg(F.sort_array(F.collect_list(row)).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.column(1).to_pylist():
                got = merged([(b["x0"], b["y0"], b["x1"], b["y1"]) for b in page], gap)
                rows.append([dict(zip(("x0", "y0", "x1", "y1"), g, strict=True)) for g in got])
            kind = pa.list_(pa.struct([(k, pa.float64()) for k in ("x0", "y0", "x1", "y1")]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["page_id", "merged"])

    kind = boxes.schema["page_id"].dataType.simpleString()
    out = pages.mapInArrow(run, f"page_id {kind}, merged array<struct<x0:double,y0:double,x1:double,y1:double>>")
    return out.select("page_id", F.posexplode("merged").alias("group_seq", "bbox"))


def _grid_iou(a: dict, b: dict) -> float:
    wide = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
    high = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    both = max(0, wide) * max(0, high)
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return both / union if union > 0 else 0.0


def folded_objects(rows: list[dict]) -> list[dict]:
    """Objects of one page, most confident first; an object of like kind and place widens the one accepted before it."""
    kept: list[dict] = []
    for new in sorted(rows, key=lambda r: (-r["confidence"], r["seq"])):
        for old in kept:
            if old["kind"] == new["kind"]:
                share = _grid_iou(old, new)
                if share >= 0.42 or (new["name"] and new["name"] == old["name"] and share >= 0.08):
                    right, bottom = max(old["x"] + old["w"], new["x"] + new["w"]), max(old["y"] + old["h"], new["y"] + new["h"])
                    old["x"], old["y"] = min(old["x"], new["x"]), min(old["y"], new["y"])
                    old["w"], old["h"] = max(1, right - old["x"]), max(1, bottom - old["y"])
                    old["confidence"] = max(old["confidence"], new["confidence"])
                    old["layer"] = min(old["layer"], new["layer"])
                    break
        else:
            kept.append(dict(new))
    return kept


def merge_quadrants(objects: DataFrame) -> DataFrame:
    """Objects (page_id, seq, kind, bbox on the page grid, label, confidence, layer) of overlapping quadrants, merged."""
    names = ("seq", "kind", "x", "y", "w", "h", "label", "confidence", "layer")
    flat = objects.select("page_id", "seq", "kind", "bbox.*", "label", "confidence", "layer")
    row = F.struct(*names, words_only(F.col("label")).alias("name"))
    pages = flat.groupBy("page_id").agg(F.collect_list(row).alias("all"))
    item = ",".join(f"{n}:{flat.schema[n].dataType.simpleString()}" for n in names)
    kind = flat.schema["page_id"].dataType.simpleString()
    out_type = to_arrow_type(StructType.fromDDL(f"v array<struct<{item}>>")["v"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{n: o[n] for n in names} for o in folded_objects(page)] for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, out_type)], ["page_id", "kept"])

    out = pages.mapInArrow(run, f"page_id {kind}, kept array<struct<{item}>>").select("page_id", F.explode("kept").alias("o"))
    grid = F.struct("o.x", "o.y", "o.w", "o.h").alias("bbox")
    return out.select("page_id", "o.seq", "o.kind", grid, "o.label", "o.confidence", "o.layer")


def page_summary(results: DataFrame) -> DataFrame:
    """Summaries of the regions that answered, in order, joined and cut to 500 characters."""
    good = results.where("error is null and summary <> ''")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seq", "summary"))), lambda r: r["summary"])
    return good.groupBy("page_id").agg(F.substring(F.array_join(parts, " "), 1, 500).alias("pageSummary"))


def runs(points: DataFrame, keys: list[str], at: str, gap: float) -> DataFrame:
    """Gaps and islands: the points of a key, split where the next one is more than gap away (run_no from 0)."""
    order = Window.partitionBy(*keys).orderBy(at)
    away = F.col(at) - F.lag(at).over(order) > gap
    return points.withColumn("run_no", F.sum(F.when(away, 1).otherwise(0)).over(order))
