"""Recogniser results as lines, and files that recognition needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions import boxes, text
from leafmark.operators import aggregates

LENS = "struct<paragraphs:array<struct<lines:array<struct<words:array<struct<plain_text:string,text_separator:string>>,box:struct<center_x:double,center_y:double,width:double,height:double,rotation_z:double>>>>>>"
ONEOCR = "struct<lines:array<struct<text:string,bounding_rect:struct<x1:double,x2:double,x3:double,x4:double,y1:double,y2:double,y3:double,y4:double>,words:array<struct<confidence:double>>>>>"


def lens_lines(results: DataFrame, column: str = "result", keep: list[str] | None = None) -> DataFrame:
    """Lines of a word-by-word layout result (`LENS`), in shares of the page; columns named
    in `keep` go along."""
    keep = keep or []
    each = results.select("page_id", *keep, F.posexplode(F.flatten(F.transform(f"{column}.paragraphs", lambda p: p["lines"]))).alias("line_idx", "l"))
    words = F.transform("l.words", lambda w: F.concat(F.coalesce(w["plain_text"], F.lit("")), text.separator(w["text_separator"])))
    b = {c: F.coalesce(F.col(f"l.box.{c}"), F.lit(0.0)) for c in ("center_x", "center_y", "width", "height", "rotation_z")}
    return each.select(
        "page_id", *keep, F.col("line_idx").cast("bigint").alias("line_idx"),
        F.replace(text.strip(F.array_join(words, "")), F.lit("･･･"), F.lit("…")).alias("text"),
        (b["center_x"] - b["width"] / 2).alias("x"), (b["center_y"] - b["height"] / 2).alias("y"), b["width"].alias("width"), b["height"].alias("height"),
        F.bround(boxes.snapped_orientation(b["width"], b["height"]) + boxes.degrees(b["rotation_z"]), 1).alias("orientation"),
        F.lit(0.04).alias("font_size"), F.lit(0.98).alias("confidence"),
    ).where("text <> ''")


def oneocr_lines(results: DataFrame, column: str = "result") -> DataFrame:
    """Lines of a quadrilateral result (`ONEOCR`) of pages of `width` by `height` pixels."""
    each = results.where("width > 0 AND height > 0").select("page_id", "width", "height", F.posexplode(f"{column}.lines").alias("line_idx", "l"))
    corner = lambda axis: F.array(*(F.col(f"l.bounding_rect.{axis}{i}") for i in (1, 2, 3, 4)))
    x1, x2, y1, y2 = F.array_min(corner("x")), F.array_max(corner("x")), F.array_min(corner("y")), F.array_max(corner("y"))
    line = text.strip(F.coalesce("l.text", F.lit("")))
    return each.where((line != "") & F.col("l.bounding_rect").isNotNull() & (F.size("l.words") > 0)).select(
        "page_id", F.col("line_idx").cast("bigint").alias("line_idx"), line.alias("text"),
        (x1 / F.col("width")).alias("x"), (y1 / F.col("height")).alias("y"), ((x2 - x1) / F.col("width")).alias("width"), ((y2 - y1) / F.col("height")).alias("height"),
        boxes.snapped_orientation(x2 - x1, y2 - y1).alias("orientation"), F.lit(0.04).alias("font_size"),
        aggregates.mean_confidence(F.col("l.words")).alias("confidence"),
    )


def centred_boxes(frame: DataFrame) -> DataFrame:
    """Boxes given by their centre, by their top left corner."""
    return frame.withColumns({"x": F.col("center_x") - F.col("width") / 2, "y": F.col("center_y") - F.col("height") / 2})


def alphabet(spark: SparkSession, path: str) -> list[str]:
    """The recogniser's characters, one a line: `blank` first, a space last."""
    # A file of some thousand lines, whose order counts.
    whole = spark.read.text(path, wholetext=True).first()
    return ["blank", *(whole.value.splitlines() if whole else []), " "]


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of image files in any store Spark reads; empty files are left out."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


#: Recognisers by name: functions of a DataFrame of (page_id, content) that give lines in
#: shares of the page.  Recognition itself is outside this package; callers add their own.
ENGINES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def engine(name: str) -> Callable[[DataFrame], DataFrame]:
    try:
        return ENGINES[name.lower()]
    except KeyError:
        raise ValueError(f"no engine {name!r}; known: {', '.join(sorted(ENGINES)) or 'none'}") from None


def chapter_pages(urls: DataFrame, chapter: str) -> DataFrame:
    """The distinct page images of a chapter, without query strings, by page number."""
    bare = urls.select(text.bare_url(F.col("url")).alias("url")).where(text.is_page_url(F.col("url")) & (text.chapter_of(F.col("url")) == chapter))
    return bare.distinct().withColumn("page", text.page_number(F.col("url"))).orderBy("page", "url")
