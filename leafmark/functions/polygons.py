"""Polygons of many rows at once: arithmetic on Arrow lists of points [x, y].

A polygon that is null, has no points or has a null coordinate gives null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


class Corners:
    """The corners of the polygons of a batch that are whole: coordinates, the corner after
    and the one before each, its polygon's place among them (`of`) and where each starts."""

    def __init__(self, points: pa.Array):
        sizes = np.diff(points.offsets.to_numpy()).astype(np.int64)
        valid = ~points.is_null().to_numpy(zero_copy_only=False)
        sizes[~valid] = 0
        pairs = points.flatten()  # without what lies below nulls
        lengths = np.diff(pairs.offsets.to_numpy())
        values, at = pairs.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(np.where(pairs.is_null().to_numpy(zero_copy_only=False), 0, lengths))]
        sound = np.diff(at) >= 2
        each = np.repeat(np.arange(len(sizes)), sizes)
        self.whole = valid & (sizes > 0)
        self.whole[each[~sound]] = False
        x, y = np.full(len(sound), np.nan), np.full(len(sound), np.nan)
        x[sound], y[sound] = values[at[:-1][sound]], values[at[:-1][sound] + 1]
        if pairs.flatten().null_count:
            none = pairs.flatten().is_null().to_numpy(zero_copy_only=False)
            self.whole[each[sound][none[at[:-1][sound]] | none[at[:-1][sound] + 1]]] = False
        kept = self.whole[each]
        self._place(x[kept], y[kept], sizes[self.whole])

    def _place(self, x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> None:
        self.x, self.y, self.sizes = x, y, sizes
        ends = np.cumsum(sizes)
        self.start = ends - sizes
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        self.next, self.before = np.arange(1, len(x) + 1), np.arange(-1, len(x) - 1)
        self.next[ends - 1], self.before[self.start] = self.start, ends - 1

    def only(self, kept: np.ndarray) -> None:
        self.whole[np.flatnonzero(self.whole)[~kept]] = False
        inside = kept[self.of]
        self._place(self.x[inside], self.y[inside], self.sizes[kept])

    def total(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.start) if len(self.start) else values[:0]

    def doubled(self) -> np.ndarray:
        """Twice the signed areas."""
        return self.total(self.x * self.y[self.next] - self.x[self.next] * self.y)

    def filled(self, values: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
        """`values` of the whole polygons as a column, null elsewhere and where not `known`."""
        out, none = np.zeros(len(self.whole), values.dtype), ~self.whole
        out[self.whole] = values
        if known is not None:
            none[self.whole] = ~known
        return pa.array(out, mask=none)


def _distance(c: Corners, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Area times ratio over perimeter, and where that is known."""
    around = c.total(np.hypot(c.x[c.next] - c.x, c.y[c.next] - c.y))
    return np.abs(c.doubled()) / 2 * ratio / np.where(around == 0, 1.0, around), around != 0


def _arcs(c: Corners, distance: np.ndarray, arc: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The first, second and so on point of the arc of every corner."""
    way, d = np.sign(c.doubled())[c.of], distance[c.of]
    normal = np.arctan2((c.x - c.x[c.next]) * way, (c.y[c.next] - c.y) * way)
    first = normal[c.before]
    step = np.mod((normal - first) * way, 2 * np.pi) * way / arc
    # Each radius is the one before, turned by the step: four sines a corner, not two a point.
    x, y, cos, sin = d * np.cos(first), d * np.sin(first), np.cos(step), np.sin(step)
    yield c.x + x, c.y + y
    for _ in range(arc):
        x, y = x * cos - y * sin, x * sin + y * cos
        yield c.x + x, c.y + y


def unclip(points: pa.Array, ratio: float) -> pa.Array:
    """As `boxes.unclip_distance`."""
    c = Corners(points)
    return c.filled(*_distance(c, ratio))


def offset(points: pa.Array, distance: pa.Array, arc: int) -> pa.Array:
    """As `boxes.round_offset`."""
    c = Corners(points)
    by, known = distance.to_numpy(zero_copy_only=False), ~distance.is_null().to_numpy(zero_copy_only=False)
    c.only(known[c.whole] & (c.doubled() != 0))
    out = np.empty((len(c.x), arc + 1, 2))
    for k, (x, y) in enumerate(_arcs(c, by[c.whole], arc)):
        out[:, k, 0], out[:, k, 1] = x, y
    pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, 2, dtype=np.int32)), pa.array(out.ravel()))
    sizes = np.zeros(len(c.whole), np.int32)
    sizes[c.whole] = c.sizes * (arc + 1)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pairs, mask=pa.array(~c.whole))


def offset_measures(points: pa.Array, ratio: float, arc: int) -> pa.Array:
    """As `boxes.unclipped_measures`: the arcs are measured point by point, so no outline is
    put together."""
    c = Corners(points)
    distance, known = _distance(c, ratio)
    solid = known & (c.doubled() != 0)
    c.only(solid)
    left = top = right = bottom = before = None
    doubled = np.zeros(len(c.x))
    for x, y in _arcs(c, distance[solid], arc):
        if before is None:
            left, right, top, bottom, start = x, x, y, y, (x, y)
        else:
            doubled += before[0] * y - x * before[1]
            left, right, top, bottom = np.minimum(left, x), np.maximum(right, x), np.minimum(top, y), np.maximum(bottom, y)
        before = x, y
    doubled += before[0] * start[1][c.next] - start[0][c.next] * before[1]
    part = lambda f, v: f.reduceat(v, c.start) if len(c.start) else v
    found = [np.abs(c.total(doubled)) / 2, part(np.minimum, left), part(np.minimum, top), part(np.maximum, right), part(np.maximum, bottom), (c.sizes * (arc + 1)).astype(np.int32)]
    return pa.StructArray.from_arrays([c.filled(v) for v in found], names=["area", "left", "top", "right", "bottom", "corners"], mask=pa.array(~c.whole))


def ordered(points: pa.Array) -> pa.Array:
    """As `boxes.ordered_corners`."""
    c = Corners(points)

    def end(key: np.ndarray) -> np.ndarray:
        """Of each polygon, the first corner with the least key."""
        key = np.where(np.isnan(key), np.inf, key)
        least = np.minimum.reduceat(key, c.start) if len(c.start) else key
        at = np.flatnonzero(key == least[c.of])
        return at[np.r_[True, c.of[at[1:]] != c.of[at[:-1]]]] if len(at) else at

    ends = [end(key) for key in (c.x + c.y, c.y - c.x, -(c.x + c.y), -(c.y - c.x))]
    far = lambda a, b: np.floor(np.sqrt((c.x[ends[a]] - c.x[ends[b]]) ** 2 + (c.y[ends[a]] - c.y[ends[b]]) ** 2)).astype(np.int64)
    width, height = np.maximum(far(2, 3), far(1, 0)), np.maximum(far(1, 2), far(0, 3))
    flat = np.stack([v[e] for e in ends for v in (c.x, c.y)], 1).ravel()
    pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2, dtype=np.int32)), pa.array(flat))
    corners = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(4 * c.whole)].astype(np.int32)), pairs, mask=pa.array(~c.whole))
    return pa.StructArray.from_arrays([corners, c.filled(width), c.filled(height)], names=["corners", "width", "height"], mask=pa.array(~c.whole))
