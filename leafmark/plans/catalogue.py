"""Query catalogue: a query for each rebuilt operator, with its SQL counterpart.

Queries whose steps depend on one another (greedy suppression, absorption, conflicts,
first-fit orders) have no SQL counterpart; tests hold them against rules restated in plain
Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark import profiles, schema
from leafmark.functions import arrays, boxes, text
from leafmark.operators import aggregates, filters, layout, pairs, windows
from leafmark.plans.views import BOXES_SQL, PAGE_HEIGHT, PAGE_WIDTH, PAIRS_SQL, lines, table
from leafmark.plans.views import boxes as box_view
from leafmark.sources import adapters, cache

FLAGSHIP = "auto_merge"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
W, H = float(PAGE_WIDTH), float(PAGE_HEIGHT)
W0, H0 = f"{PAGE_WIDTH}.0", f"{PAGE_HEIGHT}.0"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _class(pattern: str) -> str:
    return pattern.replace("'", "''")


# --- boxes --------------------------------------------------------------------------------


@query(f"WITH {BOXES_SQL} SELECT page_id, line_idx, x1 / {W0} AS x, y1 / {H0} AS y, (x2 - x1) / {W0} AS width, (y2 - y1) / {H0} AS height, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x1 * (1000.0 / {W0}) AS norm_x, y2 * (1000.0 / {W0}) AS norm_bottom FROM boxes")
def box_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = 1000.0 / W
    return box_view(spark, sf_dir).withColumn("s", boxes.to_shares(W, H)).select(
        "page_id", "line_idx", "s.*", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"),
        (F.col("x1") * scale).alias("norm_x"), (F.col("y2") * scale).alias("norm_bottom"),
    )


@query(f"WITH {BOXES_SQL} SELECT page_id, line_idx, text, CASE WHEN y2 - y1 > x2 - x1 THEN 90.0 ELSE 0.0 END::DOUBLE AS orientation, 0.04::DOUBLE AS font_size, CASE WHEN line_idx % 2 = 0 THEN 0.5 ELSE 0.95 END::DOUBLE AS confidence FROM boxes")
def box_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = lines(spark, sf_dir).withColumns({"width": boxes.side("", "x"), "height": boxes.side("", "y"), "confidence": F.when(F.col("line_idx") % 2 == 0, 0.5)})
    return filters.sanitized(b).select("page_id", "line_idx", "text", "orientation", "font_size", "confidence")


@query(f"WITH {BOXES_SQL} SELECT page_id, line_idx FROM boxes WHERE NOT ((x2 - x1) * (y2 - y1) < 6000 OR least(x2 - x1, y2 - y1) < 50 OR ((x1 <= 3 OR y1 <= 3 OR x2 >= {W0} - 3 OR y2 >= {H0} - 3) AND (x2 - x1 < 10 OR y2 - y1 < 10)))")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_view(spark, sf_dir).where(filters.not_noise(W, H, 6000, 50)).select("page_id", "line_idx")


@query(f"WITH {BOXES_SQL} SELECT page_id, line_idx, x1, CASE WHEN y2 - y1 > 1.2 * (x2 - x1) THEN least(x2 + (x2 - x1) * 0.1, 800.0) ELSE x2 END AS x2 FROM boxes WHERE x2 - x1 >= 4 AND y2 - y1 >= 4")
def widen_tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.widened(box_view(spark, sf_dir), F.lit(800.0)).select("page_id", "line_idx", "x1", "x2")


@query(f"WITH {BOXES_SQL} SELECT page_id, line_idx, greatest(x1, 0.0) AS x1, least(x2, 700.0) AS x2, greatest(y1, 0.0) AS y1, least(y2, 900.0) AS y2 FROM boxes WHERE x1 < 700 AND y1 < 900")
def clip_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.clipped(box_view(spark, sf_dir), F.lit(700.0), F.lit(900.0)).select("page_id", "line_idx", "x1", "x2", "y1", "y2")


def _characters(frame: DataFrame) -> DataFrame:
    """`frame` with a row for each character `t` of its text, at `pos` from 1."""
    letters = F.filter(F.split("text", ""), lambda c: c != "")
    each = frame.select("*", F.posexplode(letters).alias("pos", "t"))
    return each.withColumn("pos", (F.col("pos") + 1).cast("long"))


# Even lines are taken character by character, odd ones whole.
@query(f"""WITH {BOXES_SQL}, t AS (SELECT *, 0::BIGINT AS pos, text AS t FROM boxes WHERE line_idx % 2 = 1 UNION ALL SELECT *, unnest(range(1, length(text) + 1)), unnest(string_split(text, '')) FROM boxes WHERE line_idx % 2 = 0)
SELECT page_id, line_idx, pos FROM t WHERE (y1 < 700) AND (y2 > 0) AND NOT (length(t) = 1 AND ((x2 - x1) * (y2 - y1) < 400 OR greatest(x2 - x1, y2 - y1) < 32 OR t IN ('S', 's', 'c', 'C', 'I', 'l', '1', '2') OR ascii(t) < 128))""")
def line_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = box_view(spark, sf_dir)
    odd = every.where("line_idx % 2 = 1").withColumns({"pos": F.lit(0).cast("long"), "t": F.col("text")})
    b = odd.unionByName(_characters(every.where("line_idx % 2 = 0")))
    seen = b.where(filters.in_view(F.col("y1"), F.col("y2"), F.lit(700.0)))
    return seen.where(filters.not_droplet(F.col("t")) & filters.not_rejected(F.col("t"))).select("page_id", "line_idx", "pos")


@query(f"""WITH {BOXES_SQL}, s AS (SELECT page_id, line_idx, x2 - x1 AS w, y2 - y1 AS h, greatest(x2 - x1, y2 - y1) AS l FROM boxes)
SELECT page_id, line_idx, CASE WHEN l > 2560 THEN 2560.0 / l WHEN l < 2400 AND least(2400.0 / l, 2.5) > 1.05 THEN least(2400.0 / l, 2.5) ELSE 1.0 END::DOUBLE AS scale,
  least(640.0 / w, 640.0 / h) AS ratio, CASE WHEN h >= w THEN (line_idx * 17 % 180) - 90.0 WHEN line_idx * 17 % 180 <= 90 THEN line_idx * 17 % 180 ELSE (line_idx * 17 % 180) - 180.0 END::DOUBLE AS delta,
  h / greatest(w, 1) >= 1.85 AND h > 200 AS webtoon FROM s""")
def box_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = boxes.side("", "x"), boxes.side("", "y")
    predicted = (F.col("line_idx") * 17 % 180).cast("double")
    return box_view(spark, sf_dir).select(
        "page_id", "line_idx", boxes.resize_scale(w, h).alias("scale"), boxes.letterbox(w, h)["ratio"].alias("ratio"),
        boxes.rotation(predicted, w, h)["delta"].alias("delta"), boxes.is_webtoon(w, h, 200).alias("webtoon"),
    )


@query(f"""WITH {BOXES_SQL}, c AS (SELECT page_id, line_idx, [[x1, y1], [x2, y1], [x2, y2], [x1, y2]] AS p, x2 - x1 AS w, y2 - y1 AS h FROM boxes)
SELECT page_id, line_idx, round(w * h * 1.4 / (2 * (w + h)), 6) AS distance FROM c""")
def unclip(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = F.array(*(F.array(F.col(x), F.col(y)) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))))
    return box_view(spark, sf_dir).select("page_id", "line_idx", F.round(boxes.unclip_distance(corners), 6).alias("distance"))


@query(f"""WITH {BOXES_SQL}, s AS (SELECT page_id, line_idx, (x2 - x1) * (page_id % 7 + 1) AS w, (y2 - y1) * (line_idx % 5 + 1) AS h FROM boxes),
k AS (SELECT *, CASE WHEN greatest(w, h) > 2 * least(w, h) THEN least(1.0, sqrt(0.75 * 960 * 960 / (w * h))) ELSE least(1.0, 960.0 / greatest(w, h)) END AS scale FROM s)
SELECT page_id, line_idx, CAST(greatest(round_even(w * scale / 32, 0) * 32, 64) AS BIGINT) AS width, CAST(greatest(round_even(h * scale / 32, 0) * 32, 64) AS BIGINT) AS height FROM k""")
def detector_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = boxes.detector_size(boxes.side("", "x") * (F.col("page_id") % 7 + 1), boxes.side("", "y") * (F.col("line_idx") % 5 + 1))
    return box_view(spark, sf_dir).select("page_id", "line_idx", size.alias("s")).select("page_id", "line_idx", "s.width", "s.height")


# Boxes leaning by some pixels, their corners given in turned order.
_LEANING = (("x1 + line_idx % 3", "y1"), ("x2", "y1 + page_id % 5"), ("x2 - line_idx % 4", "y2"), ("x1", "y2 - page_id % 2"))


@query(f"""WITH {BOXES_SQL}, p AS (SELECT page_id, line_idx, {", ".join(f"{x} AS px{i}, {y} AS py{i}" for i, (x, y) in enumerate(_LEANING))} FROM boxes),
c AS ({" UNION ALL ".join(f"SELECT page_id, line_idx, ({i} - line_idx % 4 + 4) % 4 AS nth, px{i} AS x, py{i} AS y FROM p" for i in range(4))}),
r AS (SELECT page_id, line_idx, {", ".join(f"arg_min(x, ({e}, nth)) AS x{n}, arg_min(y, ({e}, nth)) AS y{n}" for n, e in (("a", "x + y"), ("b", "y - x"), ("c", "-(x + y)"), ("d", "x - y")))} FROM c GROUP BY ALL)
SELECT page_id, line_idx, xa, ya, xb, yb, xc, yc, xd, yd, CAST(greatest(floor(sqrt((xc - xd) ** 2 + (yc - yd) ** 2)), floor(sqrt((xb - xa) ** 2 + (yb - ya) ** 2))) AS BIGINT) AS width,
  CAST(greatest(floor(sqrt((xb - xc) ** 2 + (yb - yc) ** 2)), floor(sqrt((xa - xd) ** 2 + (ya - yd) ** 2))) AS BIGINT) AS height FROM r""")
def corner_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.array(*(F.array(F.expr(x).cast("double"), F.expr(y).cast("double")) for x, y in _LEANING))
    turn = (F.col("line_idx") % 4).cast("int")
    turned = F.concat(F.slice(points, turn + 1, 4 - turn), F.slice(points, F.lit(1), turn))
    found = box_view(spark, sf_dir).select("page_id", "line_idx", boxes.ordered_corners(turned).alias("o"))
    ends = [F.col("o.corners")[i][k].alias(f"{axis}{name}") for i, name in enumerate("abcd") for k, axis in enumerate("xy")]
    return found.select("page_id", "line_idx", *ends, "o.width", "o.height")


@query(f"""WITH {BOXES_SQL} SELECT page_id, line_idx, greatest((x1 - 40) * ({W0} / 800), 0.0) AS x, greatest((y1 - 25) * ({H0} / 700), 0.0) AS y,
  least((x2 - x1) * ({W0} / 800) * 3, {W0}) AS width, least((y2 - y1) * ({H0} / 700) * 3, {H0}) AS height FROM boxes""")
def crop_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.struct(F.lit(40.0).alias("left"), F.lit(25.0).alias("top"), F.lit(800.0).alias("width"), F.lit(700.0).alias("height"))
    crop = boxes.crop_in_image(F.col("x1"), F.col("y1"), boxes.side("", "x") * 3, boxes.side("", "y") * 3, shown, F.lit(W), F.lit(H))
    return box_view(spark, sf_dir).select("page_id", "line_idx", crop.alias("c")).select("page_id", "line_idx", *(F.round(f"c.{f}", 6).alias(f) for f in ("x", "y", "width", "height")))


@query(f"""WITH {BOXES_SQL}, t AS (SELECT *, unnest(range(1, length(text) + 1)) AS pos, unnest(string_split(text, '')) AS t FROM boxes) SELECT page_id, line_idx, pos, (line_idx * 17 % 100) / 100.0 >= 0.44 AS confident,
  NOT ((x2 - x1) * (y2 - y1) < 300 OR greatest(x2 - x1, y2 - y1) < 24 OR ascii(t) < 128) AS droplet,
  x2 - x1 >= 60 AND least(x2 - x1, y2 - y1) >= 3 AND (line_idx * 17 % 100) / 100.0 >= 0.25 AND (y2 - y1) / 10 >= 6 AS detected,
  CASE WHEN least(line_idx * 7 % 90, 90 - line_idx * 7 % 90) <= 8 OR greatest(x2 - x1, y2 - y1) / greatest(least(x2 - x1, y2 - y1), 1.0) < 1.35 OR least(x2 - x1, y2 - y1) < 40 THEN 0.0 ELSE line_idx * 7 END::DOUBLE AS tilt,
  x1 + (x2 - x1) / 2 - (x2 - x1) / 2 AS x FROM t""")
def detector_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = boxes.side("", "x"), boxes.side("", "y")
    score = (F.col("line_idx") * 17 % 100) / 100.0
    b = _characters(box_view(spark, sf_dir))
    corners = F.array_repeat(F.array(F.lit(0.0), F.lit(0.0)), 4)
    centred = adapters.centred_boxes(box_view(spark, sf_dir).select("page_id", "line_idx", (F.col("x1") + w / 2).alias("center_x"), F.col("y1").alias("center_y"), w.alias("width"), h.alias("height")))
    flags = b.select(
        "page_id", "line_idx", "pos", filters.confident(score).alias("confident"), filters.not_droplet(F.col("t"), "ppocr").alias("droplet"),
        (filters.detected(corners, score, w, h / 10) & (w >= 60)).alias("detected"), boxes.snap_tilt((F.col("line_idx") * 7).cast("double"), w, h).alias("tilt"),
    )
    return flags.join(centred.select("page_id", "line_idx", "x"), ["page_id", "line_idx"])


@query(f"""WITH {BOXES_SQL}, c AS (SELECT DISTINCT page_id, page_id AS click_id, (page_id * 37 % {PAGE_WIDTH})::DOUBLE AS x, (page_id * 53 % {PAGE_HEIGHT})::DOUBLE AS y FROM boxes)
SELECT c.page_id, coalesce(min(b.line_idx), -1) AS line_idx FROM c LEFT JOIN boxes b ON b.page_id = c.page_id AND c.x BETWEEN b.x1 - 15 AND b.x2 + 15 AND c.y BETWEEN b.y1 - 15 AND b.y2 + 15 GROUP BY ALL""")
def hit_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = box_view(spark, sf_dir)
    clicks = b.select("page_id").distinct().select(
        "page_id", F.col("page_id").alias("click_id"), (F.col("page_id") * 37 % PAGE_WIDTH).cast("double").alias("x"), (F.col("page_id") * 53 % PAGE_HEIGHT).cast("double").alias("y")
    )
    return pairs.hits(clicks, b).select("page_id", F.coalesce("line_idx", F.lit(-1)).alias("line_idx"))


@query(f"""WITH {BOXES_SQL}, c AS (SELECT page_id, line_idx, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (x2 - x1) * 1.05 / 2 AS hw, (y2 - y1) / 2 AS hh, radians(line_idx * 7 % 60) AS a FROM boxes)
SELECT page_id, line_idx, round(cx - hw * cos(a) + hh * sin(a), 6) AS xa, round(cy - hw * sin(a) - hh * cos(a), 6) AS ya, round(cx + hw * cos(a) - hh * sin(a), 6) AS xc, round(cy + hw * sin(a) + hh * cos(a), 6) AS yc FROM c""")
def turned_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = box_view(spark, sf_dir).select("page_id", "line_idx", boxes.turned_corners((F.col("line_idx") * 7 % 60).cast("double")).alias("p"))
    return p.select("page_id", "line_idx", *(F.round(F.col("p")[i][k], 6).alias(f"{axis}{name}") for i, name in ((0, "a"), (2, "c")) for k, axis in enumerate("xy")))


@query(f"""WITH {BOXES_SQL}, r AS (SELECT *, least(640.0 / ((page_id % 9 + 1) * 150), 640.0 / 900) AS ratio FROM boxes),
p AS (SELECT *, floor((640 - round_even((page_id % 9 + 1) * 150 * ratio, 0)) / 2) AS px, floor((640 - round_even(900 * ratio, 0)) / 2) AS py FROM r)
SELECT page_id, line_idx, round((x1 / 2 - px) / ratio, 6) AS x1, round((y1 / 2 - py) / ratio, 6) AS y1, round((x2 / 2 - px) / ratio, 6) AS x2, round((y2 / 2 - py) / ratio, 6) AS y2 FROM p""")
def from_letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = boxes.letterbox((F.col("page_id") % 9 + 1) * 150, F.lit(900))
    box = F.struct(*((F.col(c) / 2).alias(c) for c in ("x1", "y1", "x2", "y2")))
    back = box_view(spark, sf_dir).select("page_id", "line_idx", boxes.from_letterbox(box, letter).alias("b"))
    return back.select("page_id", "line_idx", *(F.round(f"b.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


# --- pairs --------------------------------------------------------------------------------


@query(f"WITH {PAIRS_SQL} SELECT page_id, i, j, iou, ios FROM m WHERE ox * oy > 0")
def pair_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pairs.pairs(box_view(spark, sf_dir)).where(boxes.intersection() > 0)
    return both.select("page_id", F.col("a_line_idx").alias("i"), F.col("b_line_idx").alias("j"), boxes.iou().alias("iou"), boxes.ios().alias("ios"))


def _candidates(profile: str):
    rule = profiles.OVERLAPS[profile]
    key = lambda c: f"regexp_replace(regexp_replace({c}, '{_class(text.STRIP)}', '', 'g'), '{_class(text.KEYS[rule.key])}', '', 'g')"
    sql = f"""WITH {PAIRS_SQL}, k AS (SELECT *, {key("ta")} AS ka, {key("tb")} AS kb FROM m)
SELECT page_id, i, j FROM k WHERE iou >= {rule.iou} OR ios >= {rule.ios} OR (ka = kb AND length(ka) > 0 AND ios >= {rule.same_ios})
  OR ((contains(ka, kb) OR contains(kb, ka)) AND least(length(ka), length(kb)) > 0 AND ios >= {rule.sub_ios})"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        both = pairs.redundant(box_view(spark, sf_dir), profile)
        return both.select("page_id", F.col("a_line_idx").alias("i"), F.col("b_line_idx").alias("j"))

    run.__name__ = f"dedup_candidates_{profile}"
    query(sql)(run)


for _profile in profiles.OVERLAPS:
    _candidates(_profile)


@query(f"WITH {PAIRS_SQL} SELECT page_id, i, j FROM m WHERE (ay2 - ay1 > ax2 - ax1) <> (by2 - by1 > bx2 - bx1) AND (iou >= 0.40 OR ios >= 0.55)")
def cross_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pairs.pairs(box_view(spark, sf_dir)).where(pairs.crossing())
    return both.select("page_id", F.col("a_line_idx").alias("i"), F.col("b_line_idx").alias("j"))


@query(f"""WITH {PAIRS_SQL}, t AS (SELECT *, CASE WHEN ay2 - ay1 > ax2 - ax1 THEN ax2 - ax1 ELSE ay2 - ay1 END AS tha, CASE WHEN by2 - by1 > bx2 - bx1 THEN bx2 - bx1 ELSE by2 - by1 END AS thb FROM m)
SELECT page_id, i, j FROM t WHERE (ay2 - ay1 > ax2 - ax1) = (by2 - by1 > bx2 - bx1)
  AND greatest(greatest(ax1, bx1) - least(ax2, bx2), 0) <= 0.6 * least(tha, thb) AND greatest(greatest(ay1, by1) - least(ay2, by2), 0) <= 0.6 * least(tha, thb)""")
def block_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.touching(box_view(spark, sf_dir)).select("page_id", F.col("a_line_idx").alias("i"), F.col("b_line_idx").alias("j"))


@query(f"""WITH {PAIRS_SQL}, s AS (SELECT *, ox / least(ax2 - ax1, bx2 - bx1) AS sx, oy / least(ay2 - ay1, by2 - by1) AS sy FROM m)
SELECT page_id, i, j, page_id % 2 = 0 AS vertical FROM s WHERE CASE WHEN page_id % 2 = 0 THEN sx > 0.45 AND sy <= 0.25 ELSE sy > 0.45 AND sx <= 0.25 END""")
def alignment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pairs.pairs(box_view(spark, sf_dir)).withColumn("vertical", F.col("page_id") % 2 == 0).where(pairs.aligned())
    return both.select("page_id", F.col("a_line_idx").alias("i"), F.col("b_line_idx").alias("j"), "vertical")


# Lines of even index get a kanji or a kana text, so that ruby exists.
_RUBY_TEXT = "CASE WHEN line_idx % 2 = 0 THEN '漢字' WHEN line_idx % 3 = 0 THEN 'かな' ELSE text END"


@query(f"""WITH {BOXES_SQL}, r AS (SELECT page_id, line_idx, {_RUBY_TEXT} AS t, x1, y1, x1 + (x2 - x1) * CASE WHEN line_idx % 2 = 0 THEN 1 ELSE 0.25 END AS x2, y1 + (y2 - y1) * CASE WHEN line_idx % 2 = 0 THEN 1 ELSE 0.5 END AS y2 FROM boxes),
s AS (SELECT *, least(x2 - x1, y2 - y1) AS thin, greatest(x2 - x1, y2 - y1) AS long, regexp_matches(t, '{text.KANJI}') AS kanji FROM r)
SELECT DISTINCT a.page_id, a.line_idx FROM s a JOIN s b ON a.page_id = b.page_id AND a.line_idx <> b.line_idx
WHERE NOT a.kanji AND b.kanji AND NOT regexp_matches(a.t, '[「」『』！？!?…。、―ー]') AND length(a.t) BETWEEN 1 AND 8 AND a.thin <= 32 AND a.thin <= b.thin * 0.70 AND a.long <= b.long * 1.05
  AND (length(a.t) < 3 OR a.long / greatest(length(a.t), 1) < b.long / greatest(length(b.t), 1) * 0.85)
  AND (a.x1 + a.x2) / 2 > (b.x1 + b.x2) / 2 AND greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0.0) / greatest(least(a.y2 - a.y1, b.y2 - b.y1), 0.001) >= 0.05
  AND greatest(a.x1 - b.x2, 0.0) <= least(16.0, greatest(8.0, b.thin * 0.35))""")
def furigana_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("line_idx") % 2 == 0
    named = box_view(spark, sf_dir).withColumns(
        {
            "text": F.when(even, "漢字").when(F.col("line_idx") % 3 == 0, "かな").otherwise(F.col("text")),
            "x2": F.col("x1") + boxes.side("", "x") * F.when(even, 1.0).otherwise(0.25),
            "y2": F.col("y1") + boxes.side("", "y") * F.when(even, 1.0).otherwise(0.5),
        }
    )
    return pairs.ruby(named).select("page_id", "line_idx")


@query(f"""WITH {BOXES_SQL}, g AS (SELECT page_id, line_idx // 3 AS group_id, min(x1) AS x1, max(x2) AS x2, min(y1) AS y1, max(y2) AS y2, count(CASE WHEN y2 - y1 >= x2 - x1 THEN 1 END) * 2 >= count(*) AS vertical FROM boxes WHERE line_idx % 3 <> 0 GROUP BY ALL)
SELECT b.page_id, b.line_idx, min(g.group_id) AS group_id FROM boxes b JOIN g ON g.page_id = b.page_id AND (b.y2 - b.y1 >= b.x2 - b.x1) = g.vertical
  AND (b.x1 + b.x2) / 2 BETWEEN g.x1 - (g.x2 - g.x1) * 0.08 AND g.x2 + (g.x2 - g.x1) * 0.08 AND (b.y1 + b.y2) / 2 BETWEEN g.y1 - (g.y2 - g.y1) * 0.08 AND g.y2 + (g.y2 - g.y1) * 0.08
WHERE b.line_idx % 3 = 0 GROUP BY ALL""")
def orphan_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = box_view(spark, sf_dir).withColumn("vertical", boxes.side("", "y") >= boxes.side("", "x"))
    groups = b.where("line_idx % 3 <> 0").groupBy("page_id", F.expr("line_idx div 3").alias("group_id")).agg(*aggregates.union_box(), aggregates.vertical_vote(F.col("vertical")).alias("vertical"))
    return pairs.static_orphans(b.where("line_idx % 3 = 0"), groups)


# --- grouping -----------------------------------------------------------------------------


def _edges_sql(p: profiles.Grouping) -> str:
    return f"""{BOXES_SQL}, s AS (SELECT page_id, line_idx, x1 * (1000.0 / {W0}) AS x1, x2 * (1000.0 / {W0}) AS x2, y1 * (1000.0 / {W0}) AS y1, y2 * (1000.0 / {W0}) AS y2, x2 - x1 <= y2 - y1 AS v, least(x2 - x1, y2 - y1) * (1000.0 / {W0}) AS font FROM boxes),
f AS (SELECT * FROM s),
m1 AS (SELECT page_id, v, median(font) AS m FROM f GROUP BY ALL),
m2 AS (SELECT f.page_id, f.v, coalesce(nullif(median(CASE WHEN font >= m * {p.min_line_ratio} THEN font END), 0), nullif(any_value(m), 0), 20.0) AS r FROM f JOIN m1 ON f.page_id = m1.page_id AND f.v = m1.v GROUP BY ALL),
q AS (SELECT f.*, r, font >= r * {p.min_line_ratio} AS main FROM f JOIN m2 ON f.page_id = m2.page_id AND f.v = m2.v),
pr AS (SELECT a.page_id, a.line_idx AS i, b.line_idx AS j, a.font AS fa, b.font AS fb, a.main <> b.main AS mixed, a.r,
  CASE WHEN a.v THEN greatest(greatest(a.x1, b.x1) - least(a.x2, b.x2), 0.0) ELSE greatest(greatest(a.y1, b.y1) - least(a.y2, b.y2), 0.0) END AS gap,
  CASE WHEN a.v THEN greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0.0) ELSE greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0.0) END AS across,
  CASE WHEN a.v THEN least(a.y2 - a.y1, b.y2 - b.y1) ELSE least(a.x2 - a.x1, b.x2 - b.x1) END AS smaller
  FROM q a JOIN q b ON a.page_id = b.page_id AND a.v = b.v AND a.line_idx < b.line_idx),
e AS (SELECT page_id, i, j FROM pr WHERE fa <> 0 AND fb <> 0 AND greatest(fa / fb, fb / fa) <= CASE WHEN mixed THEN {p.font_ratio_for_mixed} ELSE {p.font_ratio} END
  AND gap <= {"greatest(fa, fb, r)" if p.local_font else "r"} * {p.dist_k} AND across / smaller >= {p.overlap_min} AND (NOT mixed OR across / smaller >= {p.mixed_min_overlap_ratio}))"""


def _edges(spark: SparkSession, sf_dir: str, profile: str) -> DataFrame:
    p = profiles.GROUPINGS[profile]
    measured = layout.measured(lines(spark, sf_dir), F.lit(W), p).withColumn("segment", F.lit(0).cast("bigint"))
    return layout.edges(measured, p)


@query(f"WITH {_edges_sql(profiles.PYTHON)} SELECT * FROM e")
def group_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, "python").toDF("page_id", "i", "j")


@query(f"WITH {_edges_sql(profiles.NODE)} SELECT * FROM e")
def group_edges_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, "node").toDF("page_id", "i", "j")


@query(f"""WITH RECURSIVE {_edges_sql(profiles.PYTHON)}, link AS (SELECT page_id, i, j FROM e UNION SELECT page_id, j, i FROM e),
reach AS (SELECT page_id, line_idx, line_idx AS component FROM boxes UNION SELECT b.page_id, b.j, r.component FROM reach r JOIN link b ON b.page_id = r.page_id AND b.i = r.line_idx)
SELECT page_id, line_idx, min(component) AS component FROM reach GROUP BY ALL""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = lines(spark, sf_dir)
    return layout.components(b.select("page_id", "line_idx"), _edges(spark, sf_dir, "python"))


@query(f"""WITH {BOXES_SQL}, v AS (SELECT page_id, y2 - y1 > x2 - x1 AS vertical, CASE WHEN y2 - y1 > x2 - x1 THEN x2 - x1 ELSE y2 - y1 END AS font FROM boxes),
a AS (SELECT page_id, vertical, median(font) AS initial FROM v GROUP BY ALL)
SELECT v.page_id, v.vertical, any_value(a.initial) AS initial, coalesce(nullif(median(CASE WHEN font >= initial * 0.9 THEN font END), 0), nullif(any_value(initial), 0), 20.0)::DOUBLE AS robust
FROM v JOIN a ON a.page_id = v.page_id AND a.vertical = v.vertical GROUP BY ALL""")
def robust_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = box_view(spark, sf_dir).select("page_id", boxes.tall().alias("vertical"), boxes.thickness().alias("font"))
    return aggregates.robust_medians(b, ["page_id", "vertical"], "font", 0.9)


@query(f"""WITH {BOXES_SQL} SELECT page_id, count(CASE WHEN y2 - y1 >= x2 - x1 THEN 1 END) >= count(*) - count(CASE WHEN y2 - y1 >= x2 - x1 THEN 1 END) AS vertical,
  count(CASE WHEN y2 - y1 > x2 - x1 THEN 1 END) > count(*) / 2 AS strict FROM boxes GROUP BY ALL""")
def orientation_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = boxes.side("", "x"), boxes.side("", "y")
    return box_view(spark, sf_dir).groupBy("page_id").agg(aggregates.vertical_vote(h >= w).alias("vertical"), aggregates.strict_vertical_vote(h > w).alias("strict"))


@query(f"""WITH {BOXES_SQL}, d AS (SELECT page_id, x2 - x1 AS w, y2 - y1 AS h FROM boxes)
SELECT page_id, sum(CASE WHEN h > w * 1.1 THEN w * h WHEN w > h * 1.1 THEN 0 ELSE w * h * 0.5 END) >= sum(CASE WHEN w > h * 1.1 THEN w * h ELSE 0 END) AS vertical FROM d GROUP BY ALL""")
def area_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_view(spark, sf_dir).groupBy("page_id").agg(aggregates.area_vote(F.lit(True)).alias("vertical"))


@query(f"WITH {BOXES_SQL} SELECT page_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM boxes GROUP BY ALL")
def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_view(spark, sf_dir).groupBy("page_id").agg(*aggregates.union_box())


@query(f"""WITH {BOXES_SQL}, v AS (SELECT *, page_id % 2 = 0 AS vertical, line_idx // 4 AS group_id FROM boxes)
SELECT page_id, line_idx, CAST(row_number() OVER (PARTITION BY page_id, group_id ORDER BY CASE WHEN vertical THEN -(x1 + x2) / 2 ELSE (y1 + y2) / 2 END, CASE WHEN vertical THEN (y1 + y2) / 2 ELSE (x1 + x2) / 2 END, y1, line_idx) AS INT) AS rank FROM v""")
def reading_order_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = box_view(spark, sf_dir).withColumns({"vertical": F.col("page_id") % 2 == 0, "group_id": F.expr("line_idx div 4")})
    return layout.flat_order(b).select("page_id", "line_idx", "rank")


@query("SELECT conv_id, string_agg(trim(text, ' '), chr(8203) ORDER BY turn) AS merged FROM conversations GROUP BY conv_id")
def merge_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(aggregates.joined_text(F.col("text"), [F.col("turn")]).alias("merged"))


# --- text ---------------------------------------------------------------------------------

_CLEAN_SQL = "text"
for _pattern, _put in text.PUNCTUATION:
    _CLEAN_SQL = f"regexp_replace({_CLEAN_SQL}, '{_pattern}', '{_put.replace('$1', chr(92) + '1')}', 'g')"


@query(f"SELECT doc_id, {_CLEAN_SQL} AS cleaned FROM documents UNION ALL SELECT -1 - conv_id * 100 - turn, {_CLEAN_SQL} FROM conversations")
def clean_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    talk = table(spark, sf_dir, "conversations").select((-1 - F.col("conv_id") * 100 - F.col("turn")).alias("doc_id"), "text")
    return docs.union(talk).select("doc_id", text.clean_punctuation(F.col("text")).alias("cleaned"))


@query("SELECT doc_id, " + ", ".join(f"md5(regexp_replace(text, '{_class(p)}', '', 'g')) AS {k}" for k, p in text.KEYS.items()) + f", md5(regexp_replace(text, '{_class(text.STRIP)}', '', 'g')) AS stripped FROM documents")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", *(F.md5(text.key(F.col("text"), k)).alias(k) for k in text.KEYS), F.md5(text.strip(F.col("text"))).alias("stripped")
    )


_SAMPLES = ["漢字かな", "かな　…", "カナ・", "abc", "え!", "「え」", "", "♡", "あーい", "3~4", "㐀", "é"]
_SAMPLES_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_SAMPLES)) + ") AS v(id, t)) v"


@query(f"""SELECT CAST(id AS BIGINT) AS id, regexp_matches(t, '{text.KANJI}') AS kanji, regexp_matches(t, '{text.KANA_ONLY}') AS kana,
 regexp_matches(t, '[？！!?…‥「」『』—─―♡♥♪~～。、]') AS dialogue, regexp_matches(t, '[「」『』！？!?…。、―ー]') AS mark, regexp_matches(t, '^[\\x00-\\x7F]*\\z') AS is_ascii, CAST(length(t) AS INT) AS n FROM {_SAMPLES_SQL}
 UNION ALL SELECT doc_id + 100, regexp_matches(text, '{text.KANJI}'), regexp_matches(text, '{text.KANA_ONLY}'), regexp_matches(text, '[？！!?…‥「」『』—─―♡♥♪~～。、]'), regexp_matches(text, '[「」『』！？!?…。、―ー]'), regexp_matches(text, '^[\\x00-\\x7F]*\\z'), CAST(length(text) AS INT) FROM documents""")
def char_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"({i}L, '{t}')" for i, t in enumerate(_SAMPLES))
    every = spark.sql(f"SELECT * FROM VALUES {rows} AS v(id, t)").union(table(spark, sf_dir, "documents").select(F.col("doc_id") + 100, "text"))
    t = F.col("t")
    return every.select(
        "id", text.has_kanji(t).alias("kanji"), text.is_pure_kana(t).alias("kana"), text.has_dialogue_mark(t).alias("dialogue"),
        text.has_line_mark(t).alias("mark"), text.is_ascii(t).alias("is_ascii"), F.length(t).alias("n"),
    )


@query("SELECT page_id, split_part(url, '?', 1) AS bare, sha256(url) AS digest FROM pages")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.bare_url(F.col("url")).alias("bare"), F.sha2("url", 256).alias("digest"))


@query("""SELECT page_id, 'http://ocr/ocr?url=' || replace(replace(url_encode(split_part(url, '?', 1)), '%2A', '*'), '%21', '!') || '&context=' || replace(url_encode(split_part(url, '/', 3) || ' page'), '%2A', '*') AS request,
 to_base64(encode('user' || page_id || ':pass')) AS auth, regexp_replace(replace(html, '>', chr(10)), '\n+', chr(8203), 'g') AS saved FROM pages""")
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    context = F.concat(F.element_at(F.split("url", "/"), 3), F.lit(" page"))
    return pages.select(
        "page_id", text.request_url(F.lit("http://ocr"), F.col("url"), context).alias("request"),
        F.replace(text.basic_auth(F.concat(F.lit("user"), "page_id"), F.lit("pass")), F.lit("Basic "), F.lit("")).alias("auth"),
        text.to_saved(F.replace(F.col("html"), F.lit(">"), F.lit("\n"))).alias("saved"),
    )


_SITES = ["7; .page ; .img; main", "3;.a;.b;.c; #reader", " 1 ; .only"]


@query("""WITH u AS (SELECT page_id, CASE WHEN contains(url, '7') THEN 1 WHEN contains(url, '3') THEN 2 WHEN contains(url, '1') THEN 3 END AS s FROM pages)
SELECT page_id, coalesce(['7', '3', '1'][s], 'none') AS pattern, coalesce(['.page|.img', '.a|.b|.c', ''][s], 'none') AS selectors, coalesce(['main', '#reader', '.only'][s], 'none') AS container FROM u""")
def site_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = F.array(*(text.site_rule(F.lit(s)) for s in _SITES))
    found = table(spark, sf_dir, "pages").select("page_id", filters.first_site(F.col("url"), sites).alias("s"))
    named = {"pattern": F.col("s.pattern"), "selectors": F.array_join("s.selectors", "|"), "container": F.col("s.container")}
    return found.select("page_id", *(F.coalesce(c, F.lit("none")).alias(n) for n, c in named.items()))


_PAGE_URL_SQL = "'/api/v1/manga/' || (page_id % 7) || '/chapter/' || (page_id % 3) || CASE WHEN page_id % 5 = 0 THEN '/thumbnail' ELSE '/page/' || page_id END || CASE WHEN page_id % 2 = 0 THEN '?v=' || page_id ELSE '' END"


@query(f"""WITH u AS (SELECT page_id, {_PAGE_URL_SQL} AS url FROM pages)
SELECT page_id, contains(url, '/api/v1/manga/') AND contains(url, '/page/') AND NOT contains(url, '/thumbnail') AS wanted,
  nullif(regexp_extract(url, '/manga/[0-9]+/chapter/[0-9]+'), '') AS chapter, coalesce(CAST(nullif(regexp_extract(url, 'page/([0-9]+)', 1), '') AS BIGINT), -1) AS page FROM u""")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "pages").select("page_id", F.expr(_PAGE_URL_SQL).alias("url"))
    return u.select("page_id", text.is_page_url(F.col("url")).alias("wanted"), text.chapter_of(F.col("url")).alias("chapter"), text.page_number(F.col("url")).alias("page"))


@query(f"""WITH u AS (SELECT {_PAGE_URL_SQL} AS url FROM pages), b AS (SELECT DISTINCT split_part(url, '?', 1) AS url FROM u WHERE contains(url, '/page/') AND NOT contains(url, '/thumbnail') AND regexp_extract(url, '/manga/[0-9]+/chapter/[0-9]+') = '/manga/2/chapter/1')
SELECT url, CAST(regexp_extract(url, 'page/([0-9]+)', 1) AS BIGINT) AS page FROM b""")
def export_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "pages").select(F.expr(_PAGE_URL_SQL).alias("url"))
    return adapters.chapter_pages(u, "/manga/2/chapter/1")


# --- slices, runs, streams ----------------------------------------------------------------


def _slices_sql(p: profiles.Slicing) -> str:
    step = p.height - p.overlap
    last = f"greatest(CAST(ceil((n_chars - {p.height}) / {step}.0) AS BIGINT), 0) * {step}" if p.early_stop else "n_chars - 1"
    s = f"SELECT doc_id, unnest(range(0, {last} + 1, {step})) AS o, n_chars FROM documents WHERE n_chars > {p.whole_up_to}"
    whole = f" UNION ALL SELECT doc_id, 0, n_chars FROM documents WHERE n_chars BETWEEN 1 AND {p.whole_up_to}" if p.whole_up_to else ""
    return f"SELECT doc_id, o AS \"offset\", CASE WHEN n_chars <= {p.whole_up_to} THEN n_chars ELSE least({p.height}, n_chars - o) END AS size FROM ({s}{whole})"


def _slices(profile: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
        return windows.sliced(docs, F.col("n_chars"), profile).select("doc_id", "offset", "size")

    run.__name__ = f"slices_{profile}"
    query(_slices_sql(profiles.SLICINGS[profile]))(run)


for _profile in profiles.SLICINGS:
    _slices(_profile)


@query(f"""WITH s AS ({_slices_sql(profiles.SLICINGS["engine"])}) SELECT s.doc_id, s."offset", (0.25 * s.size + s."offset") / n_chars AS y, 0.5 * s.size / n_chars AS height FROM s JOIN documents d ON d.doc_id = s.doc_id""")
def chunk_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    cut = windows.sliced(docs, F.col("n_chars"), "engine").withColumns({"y": F.lit(0.25), "height": F.lit(0.5)})
    return windows.to_page(cut, F.col("offset"), F.col("size"), F.col("n_chars")).select("doc_id", "offset", "y", "height")


@query("""WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END AS s FROM events),
l AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM e)
SELECT user_id, coalesce(string_agg(['c', 'v', 's', 'p'][s], '' ORDER BY event_id) FILTER (s <> 0 AND (p IS NULL OR s <> p)), '') AS decoded FROM l GROUP BY user_id""")
def ctc_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in ("click", 1, "view", 2, "signup", 3, "purchase", 4))), F.col("event_type")), F.lit(0))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", code.alias("s")))).alias("e"))
    names = F.array(*(F.lit(c) for c in ("blank", "c", "v", "s", "p")))
    return e.select("user_id", arrays.ctc_collapse(F.transform("e", lambda v: v["s"]), names).alias("decoded"))


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'error' AS f, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
s AS (SELECT *, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, r ORDER BY event_id) AS k FROM e),
t AS (SELECT *, coalesce(max(CASE WHEN k >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM s)
SELECT user_id, event_id FROM t WHERE stopped = 0""")
def stop_after_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return windows.before_stop(e, "user_id", "event_id", F.col("event_type") == "error").select("user_id", "event_id")


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) AS n, list_max(embedding)::DOUBLE AS m FROM embeddings),
a AS (SELECT vec_id, sum(exp(v - m) * sin(2 * pi() * i / n)) AS s, sum(exp(v - m) * cos(2 * pi() * i / n)) AS c FROM e GROUP BY vec_id)
SELECT vec_id, round(fmod(degrees(atan2(s, c)) / 2 + 180, 180), 6) AS angle FROM a""")
def angle_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(arrays.angle_mean(F.col("embedding")), 6).alias("angle"))


@query("SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT - 1 AS argmax FROM embeddings")
def argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", arrays.argmax(F.col("embedding")).alias("argmax"))


_POLLS = "floor(event_id / 5)"


# Every seventh poll sees nothing.
@query(f"""WITH p AS (SELECT event_type, CAST({_POLLS} AS BIGINT) AS poll, list(DISTINCT user_id % 20) AS seen FROM events GROUP BY ALL),
e AS (SELECT event_type, poll, CASE WHEN poll % 7 = 0 THEN [] ELSE seen END AS items FROM p),
l AS (SELECT *, lag(items) OVER (PARTITION BY event_type ORDER BY poll) AS b FROM e)
SELECT event_type, poll, b IS NOT NULL AND len(b) > 0 AND len(items) > 0 AND NOT list_has_any(items, b) AS turned FROM l""")
def page_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = table(spark, sf_dir, "events").groupBy("event_type", F.expr(f"CAST({_POLLS} AS BIGINT)").alias("poll")).agg(F.collect_set(F.col("user_id") % 20).alias("seen"))
    polls = polls.withColumn("items", F.when(F.col("poll") % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.col("seen")))
    return windows.page_turns(polls, "event_type", "poll", "items", span=64).select("event_type", "poll", "turned")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT user_id, n, [event_type] AS items, [event_id] AS ids FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.n, CASE WHEN list_contains(f.items, e.event_type) THEN f.items WHEN len(f.items) = 3 THEN list_append(f.items[2:3], e.event_type) ELSE list_append(f.items, e.event_type) END,
  CASE WHEN list_contains(f.items, e.event_type) THEN f.ids WHEN len(f.ids) = 3 THEN list_append(f.ids[2:3], e.event_id) ELSE list_append(f.ids, e.event_id) END
 FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1),
l AS (SELECT user_id, arg_max(items, n) AS items, arg_max(ids, n) AS ids FROM f GROUP BY user_id)
SELECT user_id, unnest(items) AS event_type, unnest(ids) AS event_id FROM l""")
def recent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.recent(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id", "event_type")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts)::BIGINT - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))::BIGINT <= 36000 THEN 0 ELSE 1 END AS n FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
SELECT user_id, session, epoch(min(ts))::BIGINT AS start, epoch(max(ts))::BIGINT AS "end", count(*) AS uses FROM s GROUP BY ALL""")
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.date_trunc("second", "ts").alias("ts"))
    found = windows.idle_sessions(e, "user_id", "ts", 36000)
    return found.select("user_id", "session", F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), F.unix_seconds(F.col("end").cast("timestamp")).alias("end"), "uses")


# --- cache --------------------------------------------------------------------------------


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query("SELECT o_orderkey AS url, 'old' AS context FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT DISTINCT l_orderkey, 'new' FROM lineitem WHERE l_orderkey % 3 <> 0 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def cache_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.array().cast(schema.CACHE["data"].dataType).alias("data")
    old = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("url"), F.lit("old").alias("context"), data, F.lit(1).cast("long").alias("seq"))
    new = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("url"), F.lit("new").alias("context"), data)
    return cache.imported(old, new).select("url", "context")


@query("SELECT o_orderkey AS url FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def cache_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return cache.missing(table(spark, sf_dir, "orders"), have, "o_custkey").select(F.col("o_orderkey").alias("url"))


@query("SELECT count(DISTINCT user_id) AS removed FROM events")
def cache_purge_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty, removed = cache.purged(table(spark, sf_dir, "events").select("user_id").distinct())
    return empty.agg((F.count("*") + removed).alias("removed"))


@query("SELECT turn, text FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    pages = talk.groupBy(F.concat(F.lit("c/"), "conv_id").alias("url")).agg(F.collect_list(F.struct("turn", "text")).alias("data"))
    first = talk.agg(F.min("conv_id").alias("c")).first().c  # one number
    return cache.lookup(pages, f"c/{first}")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.newest(table(spark, sf_dir, "events"), ["user_id"], "event_id")


# Conversations are pages of the cache, a turn a bubble; even ones were edited and synced.
@query(f"""SELECT 'c/' || conv_id AS url, conv_id % 2 = 0 AS edited, turn, CASE WHEN conv_id % 2 = 0 THEN {_CLEAN_SQL} ELSE text END AS text FROM conversations""")
def cache_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in schema.BUBBLE.fields if f.name not in ("text", "font_size")}
    bubble = F.struct(*(F.col("text") if f.name == "text" else F.col("turn").cast("double").alias("font_size") if f.name == "font_size" else none[f.name] for f in schema.BUBBLE.fields))
    pages = talk.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", bubble.alias("b")))).alias("v"))
    pages = pages.select("conv_id", F.concat(F.lit("c/"), "conv_id").alias("url"), F.lit("old").alias("context"), F.transform("v", lambda v: v["b"]).alias("data"), F.lit(0).cast("long").alias("seq"))
    edits = pages.where("conv_id % 2 = 0").withColumns({"url": F.concat("url", F.lit("?v=2")), "context": F.lit("new"), "seq": F.lit(1).cast("long")})
    found = cache.synced(pages.drop("conv_id"), edits.drop("conv_id"))
    each = found.select("url", (F.col("context") == "new").alias("edited"), F.explode("data").alias("b"))
    return each.select("url", "edited", F.col("b.font_size").cast("long").alias("turn"), F.col("b.text").alias("text"))


# --- adapters -----------------------------------------------------------------------------


@query(f"""WITH {BOXES_SQL} SELECT page_id, line_idx, CASE WHEN line_idx % 4 = 0 THEN trim(text, ' ') || ' …' ELSE trim(text, ' ') END AS text, ((x1 + x2) / 2) / {W0} - ((x2 - x1) / {W0}) / 2 AS x,
  ((y1 + y2) / 2) / {H0} - ((y2 - y1) / {H0}) / 2 AS y, CASE WHEN (y2 - y1) / {H0} > (x2 - x1) / {W0} THEN 90.0 ELSE 0.0 END::DOUBLE AS orientation FROM boxes""")
def lens_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = box_view(spark, sf_dir)
    word = lambda t, s: F.struct(t.alias("plain_text"), F.lit(s).alias("text_separator"))
    words = F.when(F.col("line_idx") % 4 == 0, F.array(word(F.col("text"), "SPACE"), word(F.lit("･･･"), "NEWLINE"))).otherwise(F.array(word(F.col("text"), "NEWLINE")))
    box = F.struct(((F.col("x1") + F.col("x2")) / 2 / W).alias("center_x"), ((F.col("y1") + F.col("y2")) / 2 / H).alias("center_y"), (boxes.side("", "x") / W).alias("width"), (boxes.side("", "y") / H).alias("height"), F.lit(0.0).alias("rotation_z"))
    line = F.struct(words.alias("words"), box.alias("box"))
    one = F.struct(F.array(F.struct(F.array(line).alias("lines"))).alias("paragraphs"))
    found = adapters.lens_lines(b.select("page_id", F.col("line_idx").alias("own"), one.cast(adapters.LENS).alias("result")), keep=["own"])
    return found.select("page_id", F.col("own").alias("line_idx"), "text", "x", "y", "orientation")


@query(f"""WITH {BOXES_SQL} SELECT page_id, line_idx, trim(text, ' ') AS text, x1 / {W0} AS x, y1 / {H0} AS y, (x2 - x1) / {W0} AS width, (y2 - y1) / {H0} AS height,
  CASE WHEN y2 - y1 > x2 - x1 THEN 90.0 ELSE 0.0 END::DOUBLE AS orientation, CASE WHEN line_idx % 2 = 0 THEN (0.5 + 0.95) / 2 ELSE (0.5 + 0.7) / 2 END::DOUBLE AS confidence FROM boxes""")
def oneocr_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    xs = {"x1": "x1", "x2": "x2", "x3": "x2", "x4": "x1", "y1": "y1", "y2": "y1", "y3": "y2", "y4": "y2"}
    rect = F.struct(*(F.col(c).alias(k) for k, c in xs.items()))
    words = F.array(F.struct(F.lit(0.5).alias("confidence")), F.struct(F.when(F.col("line_idx") % 2 == 1, 0.7).alias("confidence")))
    each = F.struct("line_idx", F.struct("text", rect.alias("bounding_rect"), words.alias("words")).alias("l"))
    ordered = F.array_sort(F.collect_list(each))
    result = F.struct(F.transform(ordered, lambda e: e["l"]).alias("lines")).cast(adapters.ONEOCR)
    page = box_view(spark, sf_dir).groupBy("page_id").agg(result.alias("result")).withColumns({"width": F.lit(W), "height": F.lit(H)})
    return adapters.oneocr_lines(page).select("page_id", (F.col("line_idx") + 1).alias("line_idx"), "text", "x", "y", "width", "height", "orientation", "confidence")


# --- steps that depend on one another -------------------------------------------------------


def _segment_sql(page_height: str) -> str:
    """Line by line down each page: a page over 3000 opens a segment at a line that ends more
    than 3000 below the segment's first top, unless no line has joined that segment yet."""
    return f"""WITH RECURSIVE {BOXES_SQL}, o AS (SELECT page_id, line_idx, y1 * 8 AS y1, y2 * 8 AS y2, {page_height} > 3000 AS tall, row_number() OVER (PARTITION BY page_id ORDER BY y1, line_idx) AS k FROM boxes),
f AS (SELECT page_id, line_idx, k, y1 AS top, 0::BIGINT AS segment, TRUE AS alone, FALSE AS rest FROM o WHERE k = 1
 UNION ALL SELECT o.page_id, o.line_idx, o.k, CASE WHEN o.y2 - f.top > 3000 AND NOT f.alone AND NOT f.rest THEN o.y1 ELSE f.top END,
  f.segment + CASE WHEN o.tall AND o.y2 - f.top > 3000 AND NOT f.alone AND NOT f.rest THEN 1 ELSE 0 END,
  o.y2 - f.top > 3000 AND NOT f.alone AND NOT f.rest, f.rest OR (o.y2 - f.top > 3000 AND f.alone)
 FROM f JOIN o ON o.page_id = f.page_id AND o.k = f.k + 1)
SELECT page_id, line_idx, segment FROM f"""


# Every third page is short and has one segment.
_MIXED_HEIGHT = "CASE WHEN page_id % 3 = 0 THEN 2000 ELSE 11200 END"


def _eightfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_view(spark, sf_dir).withColumns({"y1": F.col("y1") * 8, "y2": F.col("y2") * 8})


@query(_segment_sql(_MIXED_HEIGHT))
def segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.segments(_eightfold(spark, sf_dir), F.expr(_MIXED_HEIGHT)).select("page_id", "line_idx", "segment")


@query(_segment_sql("11200"))
def segment_tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.segments(_eightfold(spark, sf_dir), F.lit(H * 8)).select("page_id", "line_idx", "segment")


# A recogniser that sees one line in the middle of what it is given.
@query(f"""WITH {BOXES_SQL}, p AS (SELECT page_id, max(x2) * 4 AS w, max(y2) * 8 AS h FROM boxes GROUP BY ALL),
t AS (SELECT *, h / greatest(w, 1) >= 1.85 AND h > 2500 AS tall FROM p),
s AS (SELECT page_id, h, unnest(range(0, greatest(CAST(ceil((h - 2500) / 2150.0) AS BIGINT), 0) * 2150 + 1, 2150)) AS o, 2500 AS size FROM t WHERE tall UNION ALL SELECT page_id, h, 0, h FROM t WHERE NOT tall)
SELECT page_id, o + least(size, h - o) * 0.25 AS y1, o + least(size, h - o) * 0.75 AS y2, CASE WHEN size = 2500 AND h > 2500 THEN CASE WHEN least(size, h - o) * 0.5 > 60 THEN 90.0 ELSE 0.0 END END::DOUBLE AS orientation FROM s""")
def chunked_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = box_view(spark, sf_dir).groupBy("page_id").agg((F.max("x2") * 4).alias("width"), (F.max("y2") * 8).alias("height"))

    def middle(cut: DataFrame) -> DataFrame:
        w = 60.0 / F.col("width")
        return cut.select(
            "page_id", "offset", F.lit(0).cast("long").alias("line_idx"), F.concat(F.lit("line at "), "offset").alias("text"), F.lit(0.1).alias("x"), F.lit(0.25).alias("y"),
            w.alias("width"), F.lit(0.5).alias("height"), F.lit(None).cast("double").alias("orientation"), F.lit(0.9).alias("confidence"),
        )

    return layout.chunked(pages, middle).select("page_id", F.round("y1", 6).alias("y1"), F.round("y2", 6).alias("y2"), "orientation")


@query()
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.suppressed(lines(spark, sf_dir), "server").select("page_id", "line_idx", "text", "x1", "y1", "x2", "y2")


@query()
def greedy_dedup_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.suppressed(lines(spark, sf_dir), "chunk").select("page_id", "line_idx", "text", "x1", "y1", "x2", "y2", "orientation")


@query()
def resolve_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = lines(spark, sf_dir).withColumns({"isMerged": F.lit(None).cast("boolean"), "forcedOrientation": F.lit(None).cast("string")})
    return layout.resolved(b).select("page_id", "line_idx", "text", "x1", "y1", "x2", "y2")


@query()
def reading_order_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_order(box_view(spark, sf_dir).drop("text").withColumn("vertical", F.lit(True))).select("page_id", "line_idx", "rank")


@query()
def auto_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.auto_merge(lines(spark, sf_dir), F.lit(W), F.lit(H))


@query()
def auto_merge_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.auto_merge(lines(spark, sf_dir), F.lit(W), F.lit(H), "node")
