import math
import random

import pytest
from pyspark.sql import functions as F

from leafmark import profiles
from leafmark.functions import boxes
from leafmark.operators import layout, pairs

SCHEMA = "page_id long, line_idx long, text string, x1 double, y1 double, x2 double, y2 double, segment long, vertical boolean, font double"


def polygons():
    rng = random.Random(1)
    rows = []
    for i in range(60):
        n = rng.choice([3, 4, 6])
        turn = rng.random() * 6
        angles = [turn + (k + 0.6 * rng.random()) * 2 * math.pi / n for k in range(n)]
        points = [[50 + 20 * math.cos(a), 60 + 20 * math.sin(a)] for a in angles]
        rows.append((i, points[:: rng.choice([1, -1])], rng.uniform(0.1, 9)))
    return rows


def test_round_offset(spark):
    frame = spark.createDataFrame(polygons(), "i long, p array<array<double>>, d double")
    p, d = F.col("p"), F.col("d")
    for r in frame.select("p", "d", boxes.polygon_area(p).alias("a"), boxes.round_offset(p, d, 24).alias("g")).withColumn("b", boxes.polygon_area(F.col("g"))).collect():
        around = sum(math.dist(a, b) for a, b in zip(r.p, r.p[1:] + r.p[:1], strict=True))
        want, disc = r.a + around * r.d + math.pi * r.d**2, math.pi * r.d**2
        assert want - disc * math.pi**2 / (6 * 24**2) <= r.b <= want + 1e-9
        # Every corner is `d` away from the polygon's corners at least, and touches one.
        assert all(abs(min(math.dist(q, c) for c in r.p) - r.d) < 1e-9 for q in r.g)
    flat = spark.createDataFrame([([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]],)], "p array<array<double>>")
    assert flat.select(boxes.round_offset(F.col("p"), F.lit(1.0)).alias("g")).first().g is None


def test_polygon_mean(spark):
    """Against every cell's distance to the row's span."""
    rng = random.Random(4)
    rows = []
    for i in range(80):
        u, v, x, y = (rng.randint(-4, 4) for _ in range(4))
        square = [[5 + x + u, 4 + y + v], [5 + x - v, 4 + y + u], [5 + x - u, 4 + y - v], [5 + x + v, 4 + y - u]]
        rows.append((i, [float(rng.randint(0, 99)) for _ in range(10 * 9)], [[float(a), float(b)] for a, b in square]))
    frame = spark.createDataFrame(rows, "i long, heat array<double>, p array<array<double>>")
    for r in frame.select("heat", "p", boxes.polygon_mean(F.col("heat"), 10, 9, F.col("p")).alias("mean")).collect():
        inside = []
        for row in range(9):
            met = []
            for (x0, y0), (x1, y1) in zip(r.p, r.p[1:] + r.p[:1], strict=True):
                if min(y0, y1) <= row <= max(y0, y1):
                    met += [x0, x1] if y0 == y1 else [math.floor(x0 + (row - y0) * (x1 - x0) / (y1 - y0) + 0.5)]
            inside += [r.heat[row * 10 + x] for x in range(10) if met and min(met) <= x <= max(met)]
        assert abs(r.mean - (sum(inside) / len(inside) if inside else 0)) < 1e-9


def scattered(n, seed, pages=2, side=3000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.randrange(side), rng.randrange(side)
        w, h = (side, 5) if rng.random() < 0.002 else (rng.randint(0, 60), rng.randint(0, 200))
        rows.append((i % pages, i, rng.choice(["a", "b", "ab"]), float(x), float(y), float(x + w), float(y + h), 0, w <= h, float(min(w, h))))
    return rows


def test_tiles_give_the_same_pairs(spark):
    frame = spark.createDataFrame(scattered(900, 7), SCHEMA).cache()
    got = lambda f: sorted((r.page_id, r.a_line_idx, r.b_line_idx) for r in f.collect())
    plain = {}
    for dense in (None, 10**9, 50):
        found = {"redundant": got(pairs.redundant(frame, "server", dense)), "touching": got(pairs.touching(frame, dense=dense)), **{f"edges {k}": got(layout.edges(frame, p, dense)) for k, p in profiles.GROUPINGS.items()}}
        plain = plain or found
        assert found == plain
    assert all(len(rows) > 20 for rows in plain.values())


def test_a_dense_page_is_many_groups(spark):
    """No tile holds more than a small share of a page of very many lines."""
    rng = random.Random(1)
    rows = [(1, i, "t", float(x := rng.randrange(9000)), float(y := rng.randrange(9000)), float(x + 20), float(y + 30), 0, True, 20.0) for i in range(20_000)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(8)
    met = pairs.near(frame, dense=1000)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "_tx" in plan and "_ty" in plan
    assert met.count() < 20_000 * 20  # all pairs would be 200 million


def test_outlines_are_measured_many_rows_at_once(spark):
    """Measures without the outline agree with the outline's own, nulls and flat polygons included, and no expression runs row by row."""
    rows = [([[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [0.0, 2.0]],), ([[0.0, 2.0], [4.0, 2.0], [4.0, 0.0], [0.0, 0.0]],), ([[1.0, 1.0], [9.0, 2.0], [5.0, 7.0]],)]
    rows += [(None,), ([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]],), ([[3.0, 3.0]],), ([],), ([[0.0, 0.0], [None, 0.0], [4.0, 2.0]],)]
    frame = spark.createDataFrame(rows, "p array<array<double>>")
    p = F.col("p")
    both = frame.select(boxes.unclipped_measures(p, arc=8).alias("m"), boxes.round_offset(p, boxes.unclip_distance(p), 8).alias("g"))
    found = both.withColumn("a", boxes.polygon_area(F.col("g"))).collect()
    for r in found[:3]:
        x, y = zip(*r.g, strict=True)
        assert tuple(r.m) == pytest.approx((r.a, min(x), min(y), max(x), max(y), len(x)))
    assert all(r.m is None and r.g is None for r in found[3:])
    assert "lambda" not in both._jdf.queryExecution().optimizedPlan().toString()
