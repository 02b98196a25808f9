"""Box geometry as column expressions, on columns x1, y1, x2, y2 in page pixels.

Functions of two boxes take the prefixes of their columns (`a_x1`, `b_x1`).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmark import profiles
from leafmark.functions import polygons
from leafmark.functions.arrays import let


def side(p: str, axis: str) -> Column:
    return F.col(f"{p}{axis}2") - F.col(f"{p}{axis}1")


def area(p: str = "") -> Column:
    return side(p, "x") * side(p, "y")


def overlap(axis: str, a: str = "a_", b: str = "b_") -> Column:
    """Length that two boxes share along one axis."""
    return F.greatest(F.least(F.col(f"{a}{axis}2"), F.col(f"{b}{axis}2")) - F.greatest(F.col(f"{a}{axis}1"), F.col(f"{b}{axis}1")), F.lit(0.0))


def gap(axis: str, a: str = "a_", b: str = "b_") -> Column:
    """Distance between two boxes along one axis, 0 if they meet."""
    return F.greatest(F.greatest(F.col(f"{a}{axis}1"), F.col(f"{b}{axis}1")) - F.least(F.col(f"{a}{axis}2"), F.col(f"{b}{axis}2")), F.lit(0.0))


def intersection(a: str = "a_", b: str = "b_") -> Column:
    return overlap("x", a, b) * overlap("y", a, b)


def iou(a: str = "a_", b: str = "b_") -> Column:
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union > 0, F.try_divide(intersection(a, b), union)).otherwise(0.0)


def ios(a: str = "a_", b: str = "b_") -> Column:
    """Intersection over the smaller area (floored at one pixel)."""
    return intersection(a, b) / F.greatest(F.least(area(a), area(b)), F.lit(1.0))


def share(axis: str, a: str = "a_", b: str = "b_") -> Column:
    """Overlap along an axis over the smaller side, 0 for boxes without extent."""
    smaller = F.least(side(a, axis), side(b, axis))
    return F.when(smaller > 0, F.try_divide(overlap(axis, a, b), smaller)).otherwise(0.0)


def tall(p: str = "") -> Column:
    """Strictly taller than wide."""
    return side(p, "y") > side(p, "x")


def thickness(p: str = "") -> Column:
    return F.when(tall(p), side(p, "x")).otherwise(side(p, "y"))


def touch(grow: float, a: str = "a_", b: str = "b_") -> Column:
    """Whether two boxes meet after both grow by a share of the smaller thickness."""
    g = grow * F.least(thickness(a), thickness(b))
    return (gap("x", a, b) <= g) & (gap("y", a, b) <= g)


def to_pixels(width: Column, height: Column, x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    """x1, y1, x2, y2 of a box given in shares of the page."""
    return [(x * width).alias("x1"), (y * height).alias("y1"), ((x + w) * width).alias("x2"), ((y + h) * height).alias("y2")]


def to_shares(width: Column, height: Column) -> Column:
    """The box of a row as shares of the page."""
    return F.struct(
        (F.col("x1") / width).alias("x"), (F.col("y1") / height).alias("y"), (side("", "x") / width).alias("width"), (side("", "y") / height).alias("height")
    )


def snapped_orientation(width: Column, height: Column) -> Column:
    return F.when(height > width, 90.0).otherwise(0.0)


def degrees(angle: Column) -> Column:
    """Radians as degrees; a value of a whole turn or more is taken for degrees already."""
    return F.when(F.abs(angle) < F.lit(2.0) * F.pi(), F.degrees(angle)).otherwise(angle)


def is_webtoon(width: Column, height: Column, slice_height: int) -> Column:
    return (height / F.greatest(width, F.lit(1)) >= profiles.TALL_ASPECT) & (height > slice_height)


def resize_scale(width: Column, height: Column) -> Column:
    """Small images grow to 2400 (at most 2.5 times, only if by more than 5%); large ones shrink to 2560."""
    longest = F.greatest(width, height).cast("double")
    up = F.least(2400.0 / longest, F.lit(2.5))
    return F.when(longest > 2560, 2560.0 / longest).when((longest < 2400) & (up > 1.05), up).otherwise(1.0)


def detector_size(width: Column, height: Column) -> Column:
    """Input size of the detector: long pages by an area budget, others by their longest
    side of 960, never enlarged; multiples of 32, at least 64."""
    w, h = width.cast("double"), height.cast("double")
    aspect = F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1.0))
    scale = F.least(F.when(aspect > 2, F.sqrt(F.lit(0.75 * 960 * 960) / (w * h))).otherwise(960.0 / F.greatest(w, h)), F.lit(1.0))
    snap = lambda v: F.greatest(F.bround(v * scale / 32) * 32, F.lit(64.0)).cast("long")
    return F.struct(snap(w).alias("width"), snap(h).alias("height"))


def letterbox(width: Column, height: Column, size: int = 640) -> Column:
    """Scale and padding of an image centred in a square."""
    ratio = F.least(size / width.cast("double"), size / height.cast("double"))
    pad = lambda v: F.floor((size - F.bround(v * ratio)) / 2).cast("double")
    return F.struct(ratio.alias("ratio"), pad(width).alias("pad_x"), pad(height).alias("pad_y"))


def from_letterbox(box: Column, letter: Column) -> Column:
    """A box of the square, back in the image."""
    x = lambda f: (box[f] - letter["pad_x"]) / letter["ratio"]
    y = lambda f: (box[f] - letter["pad_y"]) / letter["ratio"]
    return F.struct(x("x1").alias("x1"), y("y1").alias("y1"), x("x2").alias("x2"), y("y2").alias("y2"))


def rotation(predicted: Column, width: Column, height: Column) -> Column:
    """By how many degrees a crop is off its axis, and whether that calls for turning it."""
    delta = F.when(height >= width, predicted - 90.0).otherwise(F.when(predicted <= 90.0, predicted).otherwise(predicted - 180.0))
    aspect = F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1.0))
    return F.struct(delta.alias("delta"), ((F.abs(delta) >= 0.5) & (aspect >= 1.10)).alias("tilted"))


def turned_corners(delta: Column) -> Column:
    """Corners of the row's box, 5% wider, turned by `delta` degrees about its centre."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    hw, hh = side("", "x") * 1.05 / 2, side("", "y") / 2
    cos, sin = F.cos(F.radians(delta)), F.sin(F.radians(delta))
    corner = lambda i, j: F.array(cx + i * hw * cos - j * hh * sin, cy + i * hw * sin + j * hh * cos)
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def snap_tilt(angle: Column, width: Column, height: Column) -> Column:
    """Angles near an axis, and those of stubby or small boxes, are no tilt at all."""
    off = F.least(F.abs(F.pmod(angle, F.lit(90.0))), 90.0 - F.pmod(angle, F.lit(90.0)))
    short, long = F.least(width, height), F.greatest(width, height)
    return F.when((off <= 8) | (long / F.greatest(short, F.lit(1.0)) < 1.35) | (short < 40), 0.0).otherwise(angle)


def ordered_corners(points: Column) -> Column:
    """Four points [x, y] as top left, top right, bottom right, bottom left, with the whole
    width and height of the crop they bound: the ends of x + y, and of y - x; of equal ones
    the first."""

    @F.arrow_udf(returnType="corners array<array<double>>, width long, height long")
    def ordered(points: pa.Array) -> pa.Array:
        return polygons.ordered(points)

    return ordered(points)


def crop_in_image(left: Column, top: Column, width: Column, height: Column, shown: Column, natural_width: Column, natural_height: Column) -> Column:
    """A crop on the screen as a box of the image itself; `shown` is the struct (left, top,
    width, height) where the image is shown."""
    sx, sy = natural_width / shown["width"], natural_height / shown["height"]
    return F.struct(
        F.greatest((left - shown["left"]) * sx, F.lit(0.0)).alias("x"), F.greatest((top - shown["top"]) * sy, F.lit(0.0)).alias("y"),
        F.least(width * sx, natural_width).alias("width"), F.least(height * sy, natural_height).alias("height"),
    )


def unclip_distance(points: Column, ratio: float = 1.4) -> Column:
    """Area times ratio over perimeter, of a polygon given as points [x, y]."""

    @F.arrow_udf(returnType="double")
    def distance(points: pa.Array) -> pa.Array:
        return polygons.unclip(points, ratio)

    return distance(points)


def _doubled(points: Column) -> Column:
    """Twice the signed area of a polygon."""
    after = lambda i: points[F.pmod(i + 1, F.size(points))]
    return F.aggregate(F.sequence(F.lit(0), F.size(points) - 1), F.lit(0.0), lambda s, i: s + points[i][0] * after(i)[1] - after(i)[0] * points[i][1])


def round_offset(points: Column, distance: Column, arc: int = 16) -> Column:
    """A convex polygon of points [x, y] grown by `distance` with round corners: each corner
    becomes an arc of `arc` steps from the normal of the side before to that of the side
    after.  Null for a polygon without area.  The arcs' chords leave the area short of
    A + P * d + pi * d * d by less than the share pi ** 2 / (6 * arc ** 2) of the last term."""

    @F.arrow_udf(returnType="array<array<double>>")
    def grown(points: pa.Array, distance: pa.Array) -> pa.Array:
        return polygons.offset(points, distance, arc)

    return grown(points, distance.cast("double"))


def unclipped_measures(points: Column, ratio: float = 1.4, arc: int = 16) -> Column:
    """Area, extent and number of corners of `round_offset` by `unclip_distance`, whose
    outline is not made; null for a polygon without area."""

    @F.arrow_udf(returnType="area double, left double, top double, right double, bottom double, corners int")
    def measured(points: pa.Array) -> pa.Array:
        return polygons.offset_measures(points, ratio, arc)

    return measured(points)


def polygon_area(points: Column) -> Column:
    return let(points, lambda p: F.abs(_doubled(p)) / 2)


def polygon_mean(heat: Column, width: int, height: int, points: Column, total: bool = False) -> Column:
    """Mean (or `total`) of a heat map, an array row by row, over the cells of a polygon, its
    corners cut to whole cells and its border included; 0 where it covers none.

    Each row's cells are those between the ends of the polygon's sides there (a scan line),
    so nothing larger than the map is made.  A convex polygon, as boxes are.
    """

    def ends(p: Column, y: Column) -> Column:
        """Where the sides meet the row: both ends of a level side, else the nearest cell."""

        def meet(i: Column) -> Column:
            a, b = p[i], p[F.pmod(i + 1, F.size(p))]
            rise = b[1] - a[1]
            nearest = F.floor(a[0] + (y - a[1]) * (b[0] - a[0]) / rise + 0.5)
            return F.when(~y.between(F.least(a[1], b[1]), F.greatest(a[1], b[1])), F.slice(a, 1, 0)).when(rise == 0, F.array(a[0], b[0])).otherwise(F.array(nearest))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(p) - 1), meet))

    def cells(h: Column, p: Column) -> Column:
        def row(y: Column) -> Column:
            def between(met: Column) -> Column:
                low, high = F.greatest(F.array_min(met), F.lit(0)), F.least(F.array_max(met), F.lit(width - 1))
                return F.when((F.size(met) > 0) & (high >= low), F.slice(h, (y * width + low + 1).cast("int"), (high - low + 1).cast("int"))).otherwise(F.slice(h, 1, 0))

            return let(ends(p, y), between)

        return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long")), row))

    def mean(covered: Column) -> Column:
        summed = F.aggregate(covered, F.lit(0.0), lambda s, v: s + v.cast("double"))
        return summed if total else F.when(F.size(covered) > 0, summed / F.size(covered)).otherwise(0.0)

    whole = F.transform(points, lambda p: F.array(p[0].cast("long"), p[1].cast("long")))
    return let(heat, lambda h: let(whole, lambda p: let(cells(h, p), mean)))
