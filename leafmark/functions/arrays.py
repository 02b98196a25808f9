"""Array expressions: decoding of recogniser output and small statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def argmax(values: Column) -> Column:
    """Index (from 0) of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def ctc_collapse(indices: Column, alphabet: Column) -> Column:
    """Characters of the indices that are not blank (0) and differ from the one before."""
    kept = F.filter(indices, lambda v, i: (v != 0) & ((i == 0) | (v != F.try_element_at(indices, F.when(i > 0, i).otherwise(1).cast("int")))))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda v: F.try_element_at(alphabet, (v + 1).cast("int"))), ""), r"^\s+|\s+\z", "")


def angle_mean(logits: Column) -> Column:
    """Mean direction, in degrees below 180, of a softmax over equal bins of a half turn."""
    doubles = F.transform(logits, lambda v: v.cast("double"))
    top = F.array_max(doubles)
    weight = F.transform(doubles, lambda v: F.exp(v - top))
    turn = lambda i: F.lit(2.0) * F.pi() * i / F.size(logits)
    part = lambda f: F.aggregate(F.transform(weight, lambda w, i: w * f(turn(i))), F.lit(0.0), lambda s, v: s + v)
    return F.pmod(F.degrees(F.atan2(part(F.sin), part(F.cos))) / 2, F.lit(180.0))


def median_or(value: Column, default: float = 0.0) -> Column:
    """Exact median as an aggregate; `default` without rows."""
    return F.coalesce(F.median(value), F.lit(default))
