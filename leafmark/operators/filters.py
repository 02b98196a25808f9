"""Row filters and clean-up projections on lines and detector boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark import profiles
from leafmark.functions import boxes, text


def sanitized(bubbles: DataFrame) -> DataFrame:
    """Every field with its type, and its default where it is missing."""
    h, w = F.coalesce(F.col("height"), F.lit(0.0)), F.coalesce(F.col("width"), F.lit(0.0))
    return bubbles.withColumns(
        {
            "text": F.coalesce(F.col("text").cast("string"), F.lit("")),
            "orientation": F.coalesce(F.col("orientation").cast("double"), F.when(h > w, 90.0).otherwise(0.0)),
            "font_size": F.coalesce(F.col("font_size").cast("double"), F.lit(0.04)),
            "confidence": F.coalesce(F.col("confidence").cast("double"), F.lit(0.95)),
        }
    )


def not_noise(width: Column, height: Column, min_area: float = 120, min_side: float = 8) -> Column:
    """Boxes that are no speck and no sliver at the page's border."""
    w, h = boxes.side("", "x"), boxes.side("", "y")
    speck = (w * h < min_area) | (F.least(w, h) < min_side)
    border = (F.col("x1") <= 3) | (F.col("y1") <= 3) | (F.col("x2") >= width - 3) | (F.col("y2") >= height - 3)
    return ~(speck | (border & ((w < 10) | (h < 10))))


def confident(score: Column, least: float = 0.44) -> Column:
    return score >= least


def widened(frame: DataFrame, width: Column) -> DataFrame:
    """Without boxes under 4 pixels; tall ones reach a tenth of their width further right."""
    w, h = boxes.side("", "x"), boxes.side("", "y")
    kept = frame.where((w >= 4) & (h >= 4))
    return kept.withColumn("x2", F.when(h > 1.2 * w, F.least(F.col("x2") + w * 0.1, width)).otherwise(F.col("x2")))


def not_rejected(line: Column, profile: str = "manga") -> Column:
    return (line != "") & ~line.isin(*profiles.REJECTED[profile])


def not_droplet(line: Column, profile: str = "manga") -> Column:
    """Lines that are not one stray character in a small box.  The `ppocr` profile never
    drops a kanji and takes smaller boxes."""
    area, side = (300, 24) if profile == "ppocr" else (400, 32)
    longest = F.greatest(boxes.side("", "x"), boxes.side("", "y"))
    doubtful = (boxes.area() < area) | (longest < side) | line.isin(*profiles.DROPLETS) | text.is_ascii(line)
    drop = (F.length(line) == 1) & doubtful
    return ~(drop & ~text.has_kanji(line)) if profile == "ppocr" else ~drop


def detected(points: Column, score: Column, width: Column, height: Column) -> Column:
    """Detector boxes with enough points, size and score."""
    return (F.size(points) >= 4) & (F.least(width, height) >= 3) & (score >= 0.25) & (width >= 6) & (height >= 6)


def clipped(frame: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes cut to the page; those outside it go."""
    cut = frame.withColumns(
        {
            "x1": F.greatest(F.col("x1"), F.lit(0.0)),
            "y1": F.greatest(F.col("y1"), F.lit(0.0)),
            "x2": F.least(F.col("x2"), width.cast("double")),
            "y2": F.least(F.col("y2"), height.cast("double")),
        }
    )
    return cut.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def first_site(url: Column, sites: Column) -> Column:
    """The first of an array of site rules whose pattern is part of the URL."""
    return F.try_element_at(F.filter(sites, lambda s: F.contains(url, s["pattern"])), F.lit(1))


def in_view(top: Column, bottom: Column, height: Column) -> Column:
    return (top < height) & (bottom > 0)
