"""Joins of lines with lines of the same page, as range joins bounded by the page key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark import profiles
from leafmark.functions import boxes, text


def _side(frame: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return frame.select(*keys, *(F.col(c).alias(prefix + c) for c in frame.columns if c not in keys))


def pairs(frame: DataFrame, keys: list[str] | None = None, ordered: bool = True) -> DataFrame:
    """Pairs of rows of one page (or of one group of `keys`): columns a_*, b_*; the first
    is the earlier line if `ordered`, else both orders are given."""
    keys = keys or ["page_id"]
    a, b = _side(frame, "a_", keys), _side(frame, "b_", keys)
    condition = F.col("a_line_idx") < F.col("b_line_idx") if ordered else F.col("a_line_idx") != F.col("b_line_idx")
    return a.join(b, keys).where(condition)


#: Tiles along a page's longer extent at most.
_TILES = 512


def near(frame: DataFrame, keys: list[str] | None = None, ordered: bool = True, grow: tuple[Column, Column] | None = None, anywhere: Column | None = None, dense: int | None = None) -> DataFrame:
    """As `pairs`, but of keys with over `dense` rows only the pairs that may matter: those
    whose boxes meet once each has grown by `grow` (along x and y, on both ends), and those
    with a row that is `anywhere`.  Without `dense`, as for pages of ordinary size, all.

    The rows of such a key meet in tiles about four boxes wide, and a pair is given by the
    tile that holds the start of what both boxes share, so no pair comes twice and no task
    holds all pairs of a page.  The other keys have few rows and meet directly.
    """
    keys = keys or ["page_id"]
    if dense is None:  # telling the keys apart costs more than their pairs do
        return pairs(frame, keys, ordered)
    gx, gy = grow or (F.lit(0.0), F.lit(0.0))
    flag = F.coalesce(anywhere, F.lit(False)) if anywhere is not None else F.lit(False)
    sized = frame.withColumns({"_lx": F.col("x1") - gx, "_ly": F.col("y1") - gy, "_hx": F.greatest("x1", "x2") + gx, "_hy": F.greatest("y1", "y2") + gy, "_any": flag})
    side = F.greatest(F.col("_hx") - F.col("_lx"), F.col("_hy") - F.col("_ly"))
    extent = F.greatest(F.max("_hx") - F.min("_lx"), F.max("_hy") - F.min("_ly"))
    # A row for each dense key; usually there is none, and Spark drops what hangs on it.
    crowded = sized.groupBy(*keys).agg(F.count("*").alias("_n"), F.greatest(4 * F.avg(side), extent / _TILES, F.lit(1e-6)).alias("_tile")).where(F.col("_n") > dense).drop("_n")
    order = F.col("a_line_idx") < F.col("b_line_idx") if ordered else F.col("a_line_idx") != F.col("b_line_idx")
    few = _side(frame, "a_", keys).join(crowded, keys, "left_anti").join(_side(frame, "b_", keys), keys).where(order)
    many = sized.join(crowded, keys)
    cell = lambda c: F.floor(c / F.col("_tile"))
    spread = many.where("NOT _any").withColumn("_tx", F.explode(F.sequence(cell(F.col("_lx")), cell(F.col("_hx"))))).withColumn("_ty", F.explode(F.sequence(cell(F.col("_ly")), cell(F.col("_hy")))))
    both = [*keys, "_tile", "_tx", "_ty"]
    met = _side(spread, "a_", both).join(_side(spread, "b_", both), both).where(order)
    start = [F.greatest(F.col(f"a__l{axis}"), F.col(f"b__l{axis}")) for axis in "xy"]
    inside = [start[k] <= F.least(F.col(f"a__h{axis}"), F.col(f"b__h{axis}")) for k, axis in enumerate("xy")]
    found = [met.where(inside[0] & inside[1] & (cell(start[0]) == F.col("_tx")) & (cell(start[1]) == F.col("_ty")))]
    if anywhere is not None:
        a, b = _side(many.where("_any"), "a_", keys), _side(many, "b_", keys)
        found += [a.join(b, keys).where(order), _side(many.where("NOT _any"), "a_", keys).join(_side(many.where("_any"), "b_", keys), keys).where(order)]
    return reduce(DataFrame.unionByName, [few, *(x.select(*few.columns) for x in found)])


def redundant(frame: DataFrame, profile: str, dense: int | None = None) -> DataFrame:
    """Pairs of lines of which one makes the other redundant (the test of a single step of
    the greedy suppression); `dense` as in `near`.  The text keys are worked out for each line, not each pair."""
    rule = profiles.OVERLAPS[profile]
    # Every rule asks for boxes that lie on one another.
    both = near(frame.withColumn("key", text.key(text.strip(F.col("text")), rule.key)), dense=dense)
    a, b = F.col("a_key"), F.col("b_key")
    same = (a == b) & (F.length(a) > 0)
    ios = boxes.ios()
    return both.where(
        (boxes.iou() >= rule.iou) | (ios >= rule.ios) | (same & (ios >= rule.same_ios)) | (text.one_holds_other(a, b) & (ios >= rule.sub_ios))
    ).drop("a_key", "b_key")


def hits(clicks: DataFrame, frame: DataFrame, pad: float = 15.0) -> DataFrame:
    """The clicks (page_id, click_id, x, y), each with the first line of its page whose box,
    padded, holds it, or null."""
    inside = F.col("x").between(F.col("b_x1") - pad, F.col("b_x2") + pad) & F.col("y").between(F.col("b_y1") - pad, F.col("b_y2") + pad)
    found = clicks.join(_side(frame, "b_", ["page_id"]), "page_id").where(inside)
    first = found.groupBy("page_id", "click_id").agg(F.min("b_line_idx").alias("line_idx"))
    return clicks.join(first, ["page_id", "click_id"], "left")


def crossing() -> Column:
    """Boxes of different orientation that lie on one another."""
    return (boxes.tall("a_") != boxes.tall("b_")) & ((boxes.iou() >= 0.40) | (boxes.ios() >= 0.55))


def aligned() -> Column:
    """Lines of one column (of a vertical group) or one row, not side by side."""
    column = (boxes.share("x") > 0.45) & (boxes.share("y") <= 0.25)
    row = (boxes.share("y") > 0.45) & (boxes.share("x") <= 0.25)
    return F.when(F.col("vertical"), column).otherwise(row)


def touching(frame: DataFrame, grow: float = 0.6, dense: int | None = None) -> DataFrame:
    """Links between boxes of one orientation that meet when grown; `dense` as in `near`."""
    reach = boxes.thickness() * (grow / 2)  # the smaller of two is no more than their mean
    return near(frame, grow=(reach, reach), dense=dense).where((boxes.tall("a_") == boxes.tall("b_")) & boxes.touch(grow)).select("page_id", "a_line_idx", "b_line_idx")


def _thin(p: str) -> Column:
    return F.least(boxes.side(p, "x"), boxes.side(p, "y"))


def _long(p: str) -> Column:
    return F.greatest(boxes.side(p, "x"), boxes.side(p, "y"))


def ruby_of(vertical: Column) -> Column:
    """Whether line a is ruby of line b, for pairs given in both orders."""
    a, b = text.strip(F.col("a_text")), text.strip(F.col("b_text"))
    limit = F.least(F.lit(16.0), F.greatest(F.lit(8.0), _thin("b_") * 0.35))
    small = (F.length(a) < 3) | (_long("a_") / F.greatest(F.length(a), F.lit(1)) < _long("b_") / F.greatest(F.length(b), F.lit(1)) * 0.85)
    centre = lambda p, axis: (F.col(f"{p}{axis}1") + F.col(f"{p}{axis}2")) / 2
    shared = lambda axis: boxes.overlap(axis) / F.greatest(F.least(boxes.side("a_", axis), boxes.side("b_", axis)), F.lit(0.001))
    beside = (centre("a_", "x") > centre("b_", "x")) & (shared("y") >= 0.05) & (F.greatest(F.col("a_x1") - F.col("b_x2"), F.lit(0.0)) <= limit)
    above = (centre("a_", "y") < centre("b_", "y")) & (shared("x") >= 0.05) & (F.greatest(F.col("b_y1") - F.col("a_y2"), F.lit(0.0)) <= limit)
    return (
        (F.length(a) > 0) & (F.length(b) > 0) & ~text.has_kanji(a) & ~text.has_line_mark(a) & (F.length(a) <= 8) & text.has_kanji(b)
        & (_thin("a_") <= 32) & (_thin("a_") <= _thin("b_") * 0.70) & (_long("a_") <= _long("b_") * 1.05) & small
        & F.when(vertical, beside).otherwise(above)
    )


def ruby(frame: DataFrame, vertical: Column | None = None) -> DataFrame:
    """The lines that are ruby of another line of their page (a semi-join)."""
    both = pairs(frame, ordered=False).where(ruby_of(F.lit(True) if vertical is None else vertical))
    found = both.select("page_id", F.col("a_line_idx").alias("line_idx"))
    return frame.join(found, ["page_id", "line_idx"], "left_semi")


def static_orphans(singles: DataFrame, groups: DataFrame) -> DataFrame:
    """Each single with the first group of its page whose box, padded, holds its centre.

    The static form: groups do not grow as singles are taken up (`layout.absorbed` does that).
    """
    s = _side(singles, "a_", ["page_id"])
    g = _side(groups, "g_", ["page_id"])
    inside = F.lit(True)
    for axis in "xy":
        centre = (F.col(f"a_{axis}1") + F.col(f"a_{axis}2")) / 2
        pad = (F.col(f"g_{axis}2") - F.col(f"g_{axis}1")) * profiles.ORPHAN_PAD
        inside = inside & centre.between(F.col(f"g_{axis}1") - pad, F.col(f"g_{axis}2") + pad)
    found = s.join(g, "page_id").where(inside & (F.col("a_vertical") == F.col("g_vertical")))
    return found.groupBy("page_id", F.col("a_line_idx").alias("line_idx")).agg(F.min("g_group_id").alias("group_id"))
