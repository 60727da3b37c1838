"""Deterministic projections of the driver's tables onto page tables, in DataFrames and in SQL.

The driver's tables hold no boxes or recognised text; these projections exercise the operators on them.
Orders stand for pages and order lines for boxes; (l_orderkey, l_linenumber) is not unique, so seq is a
row number over an order without ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.quality import numbered

ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, seq, bbox, score, kind): one box for each order line."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"
    )
    x0, y0 = F.col("l_partkey") % 100, F.col("l_suppkey") % 100
    bbox = G.box(x0, y0, x0 + F.col("l_quantity"), y0 + 10 * F.col("l_linenumber"))
    return numbered(lines, *ORDER).select("page_id", "seq", bbox.alias("bbox"), F.col("l_extendedprice").alias("score"), F.col("l_returnflag").alias("kind"))


BOXES = """
    boxes AS (
        SELECT l_orderkey AS page_id,
            row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS seq,
            CAST(l_partkey % 100 AS DOUBLE) AS x0, CAST(l_suppkey % 100 AS DOUBLE) AS y0,
            l_partkey % 100 + l_quantity AS x1, CAST(l_suppkey % 100 + 10 * l_linenumber AS DOUBLE) AS y1,
            l_extendedprice AS score, l_returnflag AS kind
        FROM lineitem)
"""
#: Area and intersection as DuckDB macros would write them: a and b are row aliases.
AREA = "(greatest(0, {0}.x1 - {0}.x0) * greatest(0, {0}.y1 - {0}.y0))"
MEET = (
    "(greatest(0, least({0}.x1, {1}.x1) - greatest({0}.x0, {1}.x0)) * greatest(0, least({0}.y1, {1}.y1) - greatest({0}.y0, {1}.y0)))"
)


def small_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes close to each other, so that near-equal ones occur."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), *ORDER)
    x0, y0 = F.col("l_partkey") % 8, F.col("l_suppkey") % 8
    bbox = G.box(x0, y0, x0 + 10 + F.col("l_linenumber") % 2, y0 + 8)
    return numbered(lines, *ORDER).select("page_id", "seq", bbox.alias("bbox"))


SMALL_BOXES = """
    small_boxes AS (
        SELECT l_orderkey AS page_id,
            row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS seq,
            l_partkey % 8 AS x0, l_suppkey % 8 AS y0, l_partkey % 8 + 10 + l_linenumber % 2 AS x1, l_suppkey % 8 + 8 AS y1
        FROM lineitem)
"""


def image(wide: float = 200, high: float = 200) -> F.Column:
    return F.struct(F.lit(float(wide)).alias("width"), F.lit(float(high)).alias("height"))


def slide(wide: float = 13.333, high: float = 7.5) -> F.Column:
    return F.struct(F.lit(float(wide)).alias("width"), F.lit(float(high)).alias("height"))
