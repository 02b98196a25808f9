import math
import random

import pytest
from pyspark.sql import functions as F

from leafmark.functions import arrays, boxes, text
from leafmark.operators import aggregates, filters, windows

Z = "​"


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("a!!b", "a‼b"), ("え??", "え⁇"), ("待 ...て", "待…て"), ("!?", "⁉"), ("?!", "⁈"), ("!!?", "‼"), ("?!!", "‼"), ("!?!", "⁉"), ("?", ""), (":", "…"),
        ("A - B", "AーB"), ("x: y", "x…y"), ("・・・", "…"), (f"a b{Z}c", f"ab{Z}c"), ("", ""),
    ],
)
def test_clean_punctuation(spark, given, expected):
    row = spark.createDataFrame([(given,)], "t string").select(text.clean_punctuation(F.col("t")).alias("c")).first()
    assert row.c == expected


def test_keys_cover_unicode_space(spark):
    row = spark.createDataFrame([("　 あ い！~\n",)], "t string").select(
        text.strip(F.col("t")).alias("s"), text.key(F.col("t"), "dedup").alias("d"), text.key(F.col("t"), "squeezed").alias("q"), text.key(F.col("t"), "plain").alias("p")
    ).first()
    assert (row.s, row.d, row.q, row.p) == ("あ い！~", "あい", "あい！~", "あい！~")


def slices(spark, height, profile):
    rows = spark.range(1).select(windows.slices(F.lit(height).cast("long"), profile).alias("s")).first().s
    return [(r["offset"], r["size"]) for r in rows]


@pytest.mark.parametrize(
    ("height", "profile", "expected"),
    [
        (6000, "engine", [(0, 2500), (2150, 2500), (4300, 1700)]),
        (6000, "lens", [(0, 2000), (1700, 2000), (3400, 2000), (5100, 900)]),
        (6000, "legacy", [(0, 1500), (1350, 1500), (2700, 1500), (4050, 1500), (5400, 600)]),
        (1500, "legacy", [(0, 1500), (1350, 150)]),
        (7000, "node", [(0, 3000), (3000, 3000), (6000, 1000)]),
        (3000, "node", [(0, 3000)]),
        (0, "engine", []),
    ],
)
def test_slices(spark, height, profile, expected):
    assert slices(spark, height, profile) == expected


@pytest.mark.parametrize("profile", ["engine", "lens", "legacy", "node"])
def test_slices_cover_every_row(spark, profile):
    for height in (1, 149, 1500, 1501, 2499, 2500, 2501, 8123):
        covered = 0
        for offset, size in slices(spark, height, profile):
            assert offset <= covered and size > 0
            covered = max(covered, offset + size)
        assert covered == height


def test_ctc_collapse(spark):
    names = F.array(*(F.lit(c) for c in ("blank", "a", "b", "c", "d", "e", "f")))
    given = spark.createDataFrame([([0, 5, 5, 0, 5, 6, 6],), ([],), ([0, 0],)], "i array<int>")
    assert [r.t for r in given.select(arrays.ctc_collapse(F.col("i"), names).alias("t")).collect()] == ["eef", "", ""]


def test_stop_rule(spark):
    rows = [(1, i, bad) for i, bad in enumerate([False, True, True, False, True, True, True, False])] + [(2, 0, True), (2, 1, True)]
    frame = spark.createDataFrame(rows, "k long, i long, bad boolean")
    found = sorted((r.k, r.i) for r in windows.before_stop(frame, "k", "i", F.col("bad")).collect())
    assert found == [(1, i) for i in range(7)] + [(2, 0), (2, 1)]


def test_median(spark):
    frame = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "v double")
    assert frame.agg(arrays.median_or(F.col("v")).alias("m")).first().m == 3.0
    assert frame.limit(0).agg(arrays.median_or(F.col("v")).alias("m")).first().m == 0.0


def test_robust_median_falls_back(spark):
    frame = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 10.0), (2, 12.0), (2, 1.0)], "g long, v double")
    found = {r.g: r.robust for r in aggregates.robust_medians(frame, ["g"], "v", 0.4).collect()}
    assert found == {1: 20.0, 2: 11.0}


def test_geometry(spark):
    row = spark.range(1).select(
        boxes.degrees(F.lit(math.pi)).alias("rad"), boxes.degrees(F.lit(45.0)).alias("deg"),
        boxes.resize_scale(F.lit(500), F.lit(800)).alias("up"), boxes.resize_scale(F.lit(5120), F.lit(800)).alias("down"), boxes.resize_scale(F.lit(2400), F.lit(2350)).alias("same"),
        boxes.detector_size(F.lit(960), F.lit(480)).alias("d"), boxes.detector_size(F.lit(800), F.lit(6000)).alias("long"),
        boxes.snap_tilt(F.lit(5.0), F.lit(100.0), F.lit(50.0)).alias("flat"), boxes.snap_tilt(F.lit(30.0), F.lit(100.0), F.lit(50.0)).alias("tilt"),
    ).first()
    assert (round(row.rad, 6), row.deg, row.up, row.down, row.same) == (180.0, 45.0, 2.5, 0.5, 1.0)
    assert (row.d.width, row.d.height) == (960, 480)
    sizes = spark.createDataFrame([(500, 400), (100, 300), (800, 6000), (1, 1)], "w int, h int").select(boxes.detector_size(F.col("w"), F.col("h")).alias("d"))
    assert [(r.d.width, r.d.height) for r in sizes.collect()] == [(512, 384), (96, 288), (288, 2272), (64, 64)]
    assert row.long.width % 32 == 0 and row.long.width * row.long.height < 960 * 960
    assert (row.flat, row.tilt) == (0.0, 30.0)


def test_droplets(spark):
    frame = spark.createDataFrame([("し", 100.0), ("漢", 100.0), ("漢", 10.0), ("しか", 10.0)], "t string, s double").selectExpr("t", "0d x1", "0d y1", "s x2", "s y2")
    found = frame.select(filters.not_droplet(F.col("t")).alias("manga"), filters.not_droplet(F.col("t"), "ppocr").alias("ppocr")).collect()
    assert [(r.manga, r.ppocr) for r in found] == [(False, False), (True, True), (False, True), (True, True)]


def test_site_rules(spark):
    row = spark.createDataFrame([(" a.org ; .page ; .img;  body ",)], "r string").select(text.site_rule(F.col("r")).alias("s")).first().s
    assert (row.pattern, row.selectors, row.container) == ("a.org", [".page", ".img"], "body")


def test_recent_and_turns(spark):
    seen = spark.createDataFrame([(1, i, x) for i, x in enumerate("abacd")], "k long, i long, x string")
    assert {r.x for r in windows.recent(seen, "k", "i", "x").collect()} == {"b", "c", "d"}
    # a goes when d comes, and comes back when it is seen again.
    back = spark.createDataFrame([(1, i, x) for i, x in enumerate("abcbda")] + [(2, 0, "z")], "k long, i long, x string")
    assert sorted((r.k, r.x, r.i) for r in windows.recent(back, "k", "i", "x").collect()) == [(1, "a", 5), (1, "c", 2), (1, "d", 4), (2, "z", 0)]
    assert windows.recent(back.limit(0), "k", "i", "x").count() == 0
    polls = spark.createDataFrame([(1, 0, ["a"]), (1, 1, ["a", "b"]), (1, 2, ["c"])], "k long, i long, items array<string>")
    assert [r.turned for r in windows.page_turns(polls, "k", "i", "items").orderBy("i").collect()] == [False, False, True]


@pytest.mark.parametrize("span", [1, 3, 4096])
def test_turns_over_stretches_and_empty_polls(spark, span):
    items = [["a"], [], ["b"], ["c"], ["c", "d"], [], [], ["e"], ["f"], ["f"]]
    rows = [(k, i * step, x) for k, step in ((1, 1), (2, 5)) for i, x in enumerate(items)]
    found = windows.page_turns(spark.createDataFrame(rows, "k long, i long, items array<string>"), "k", "i", "items", span)
    for k in (1, 2):
        turned = [r.turned for r in found.where(F.col("k") == k).orderBy("i").collect()]
        assert turned == [n > 0 and bool(x) and bool(items[n - 1]) and not set(x) & set(items[n - 1]) for n, x in enumerate(items)]


@pytest.mark.parametrize("span", [1, 7, 4096])
def test_before_stop_over_stretches(spark, span):
    rng = random.Random(span)
    rows = [(k, i, rng.choice([True, True, False, None])) for k in ("a", "b", None, "c") for i in rng.sample(range(300), 60)]
    rows += [("d", i, i % 3 < 2) for i in range(50)]
    kept = []
    for key in ("a", "b", None, "c", "d"):
        streak = 0
        for k, i, bad in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            kept.append((str(k), i))
            streak = streak if bad is None else streak + 1 if bad else 0
            if streak == 3:
                break
    frame = spark.createDataFrame(rows, "k string, i long, bad boolean").repartition(3)
    found = windows.before_stop(frame, "k", "i", F.col("bad"), 3, span)
    assert found.columns == ["k", "i", "bad"]
    assert sorted((str(r.k), r.i) for r in found.collect()) == sorted(kept)
    assert windows.before_stop(frame.limit(0), "k", "i", F.col("bad"), 3, span).count() == 0


@pytest.mark.parametrize("span", [10, 86400])
def test_idle_sessions_over_stretches(spark, span):
    rng = random.Random(span)
    rows = [(k, s) for k in ("a", None) for s in rng.choices(range(5000), k=80)] + [("a", None), ("a", None), ("b", None)]
    expected = [("a", 0, None, None, 2), ("b", 0, None, None, 1)]
    for key in ("a", None):
        sessions = []
        for s in sorted(s for k, s in rows if k == key and s is not None):
            if sessions and s - sessions[-1][1] <= 60:
                sessions[-1][1:] = [s, sessions[-1][2] + 1]
            else:
                sessions.append([s, s, 1])
        expected += [(key, n, *s) for n, s in enumerate(sessions, 1)]
    frame = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("at"))
    found = windows.idle_sessions(frame, "k", "at", 60, span).select("k", "session", F.unix_seconds("start"), F.unix_seconds("end"), "uses")
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, expected))
    assert windows.idle_sessions(frame.limit(0), "k", "at", 60, span).count() == 0
