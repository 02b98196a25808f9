"""Spark schemas of pages, lines, merged bubbles and the result cache."""

from __future__ import annotations

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "width", "height")])

#: A line or a merged bubble: single lines leave the last two null, merged ones leave
#: font_size and confidence null.
BUBBLE = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("tightBoundingBox", BOX),
        T.StructField("orientation", T.DoubleType()),
        T.StructField("font_size", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("isMerged", T.BooleanType()),
        T.StructField("forcedOrientation", T.StringType()),
    ]
)

#: Lines in page pixels, as the layout operators take them; line_idx is the order in the page.
LINES = "page_id bigint, line_idx bigint, text string, x1 double, y1 double, x2 double, y2 double, orientation double, font_size double, confidence double"
BUBBLES = LINES + ", isMerged boolean, forcedOrientation string"

CACHE = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("data", T.ArrayType(BUBBLE)),
        T.StructField("seq", T.LongType()),
    ]
)
