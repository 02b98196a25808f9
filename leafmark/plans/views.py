"""Inputs of the catalogue's queries, derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_WIDTH, PAGE_HEIGHT = 1100, 1400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order is a page of 1100 by 1400 pixels, one line item a text line on it.

    Odd line numbers give tall boxes, even ones wide boxes.
    """
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    numbered = items.withColumn("line_idx", F.row_number().over(order).cast("bigint")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    odd = F.col("l_linenumber") % 2 == 1
    quantity = F.col("l_quantity").cast("int")
    short, long = 40 + (quantity % 5) * 10, 120 + (quantity % 10) * 20
    x1 = ((F.col("l_partkey") % 16) * 50).cast("double")
    y1 = ((F.col("l_suppkey") % 10) * 100).cast("double")
    return numbered.select(
        F.col("l_orderkey").alias("page_id"), "line_idx", F.col("p_name").alias("text"), x1.alias("x1"), y1.alias("y1"),
        (x1 + F.when(odd, short).otherwise(long)).alias("x2"), (y1 + F.when(odd, long).otherwise(short)).alias("y2"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`boxes` with the other columns of a line, which are unknown."""
    unknown = {c: F.lit(None).cast("double") for c in ("orientation", "font_size", "confidence")}
    return boxes(spark, sf_dir).withColumns(unknown)


BOXES_SQL = """boxes AS (
  SELECT l.l_orderkey AS page_id,
    CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) AS BIGINT) AS line_idx,
    p.p_name AS text,
    CAST((l.l_partkey % 16) * 50 AS DOUBLE) AS x1, CAST((l.l_suppkey % 10) * 100 AS DOUBLE) AS y1,
    CAST((l.l_partkey % 16) * 50 AS DOUBLE) + CASE WHEN l.l_linenumber % 2 = 1 THEN 40 + (CAST(l.l_quantity AS INT) % 5) * 10 ELSE 120 + (CAST(l.l_quantity AS INT) % 10) * 20 END AS x2,
    CAST((l.l_suppkey % 10) * 100 AS DOUBLE) + CASE WHEN l.l_linenumber % 2 = 1 THEN 120 + (CAST(l.l_quantity AS INT) % 10) * 20 ELSE 40 + (CAST(l.l_quantity AS INT) % 5) * 10 END AS y2
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""

PAIRS_SQL = (
    BOXES_SQL
    + """,
pairs AS (
  SELECT a.page_id, a.line_idx AS i, b.line_idx AS j, a.text AS ta, b.text AS tb,
    a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2,
    greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0.0) AS ox, greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0.0) AS oy,
    (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ab
  FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.line_idx < b.line_idx),
m AS (SELECT *, CASE WHEN aa + ab - ox * oy > 0 THEN ox * oy / (aa + ab - ox * oy) ELSE 0.0 END AS iou, ox * oy / greatest(least(aa, ab), 1.0) AS ios FROM pairs)"""
)
