"""Aggregates over lines: votes, boxes, medians, ordered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark import profiles
from leafmark.functions import boxes, text


def union_box() -> list[Column]:
    return [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]


def vertical_vote(is_vertical: Column) -> Column:
    """Whether at least half of the rows are vertical (a tie is vertical)."""
    return F.count_if(is_vertical) >= F.count("*") - F.count_if(is_vertical)


def strict_vertical_vote(is_vertical: Column) -> Column:
    return F.count_if(is_vertical) > F.count("*") / 2


def area_vote(page_tall: Column) -> Column:
    """Orientation by area: boxes a tenth off square count in full, the rest by half for
    the page's own orientation; a tie is vertical."""
    w, h = boxes.side("", "x"), boxes.side("", "y")
    a = w * h
    vertical = F.when(h > w * 1.1, a).when(w > h * 1.1, 0.0).when(page_tall, a * 0.5).otherwise(0.0)
    horizontal = F.when(w > h * 1.1, a).when(h > w * 1.1, 0.0).when(page_tall, 0.0).otherwise(a * 0.5)
    return F.sum(vertical) >= F.sum(horizontal)


def joined_text(line: Column, order: list[Column], separator: str = "​", skip_empty: bool = True) -> Column:
    """Texts in order with a separator between them."""
    value = text.strip(line) if skip_empty else line
    entries = F.array_sort(F.collect_list(F.struct(*(o.alias(f"k{i}") for i, o in enumerate(order)), value.alias("text"))))
    texts = F.transform(entries, lambda e: e["text"])
    return F.array_join(F.filter(texts, lambda t: t != "") if skip_empty else texts, separator)


def with_robust_median(frame: DataFrame, keys: list[str], size: str, ratio: float) -> DataFrame:
    """`frame` with `initial` and `robust`: the median of the row's keys, and that of sizes
    of at least `ratio` of it; without any (or with 0) the one before, then `DEFAULT_MEDIAN`."""
    alike = Window.partitionBy(*keys)
    first = frame.withColumn("initial", F.median(size).over(alike))
    main = F.median(F.when(F.col(size) >= F.col("initial") * ratio, F.col(size))).over(alike)
    robust = F.coalesce(F.nullif(main, F.lit(0.0)), F.nullif(F.col("initial"), F.lit(0.0)), F.lit(profiles.DEFAULT_MEDIAN))
    return first.withColumn("robust", robust).withColumn("initial", F.coalesce("initial", F.lit(0.0)))


def robust_medians(frame: DataFrame, keys: list[str], size: str, ratio: float) -> DataFrame:
    """(keys, initial, robust), a row for each value of the keys."""
    return with_robust_median(frame, keys, size, ratio).groupBy(*keys).agg(F.first("initial").alias("initial"), F.first("robust").alias("robust"))


def newest(frame: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, number): the largest number of each key, as the newest of rows numbered in
    the order they came."""
    return frame.groupBy(*keys).agg(F.max(number).alias(number))


def mean_confidence(words: Column, default: float = 0.95) -> Column:
    values = F.transform(words, lambda w: F.coalesce(w["confidence"], F.lit(default)))
    return F.coalesce(F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, v: s + v), F.size(values)), F.lit(default))
