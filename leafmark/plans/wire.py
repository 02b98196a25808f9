"""Query of recogniser results in wire form: messages made from the tables, decoded again."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.plans.catalogue import query
from leafmark.plans.views import BOXES_SQL
from leafmark.plans.views import boxes as box_view
from leafmark.sources import adapters, wire

#: Boxes of the lines (centre, size, turn), by line number; numbers that four bytes hold exactly.
_BOXES = ((0.5, 0.25, 0.125, 0.5, 0.25), (0.25, 0.75, 0.5, 0.0625, 0.0), (0.625, 0.5, 0.25, 0.25, 8.0))


def _byte(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n), 2, "0"))


def _field(number: int, v: Column) -> Column:
    """A field of bytes shorter than 2 ** 21.  `v` is named often: a column or a literal."""
    n = F.length(v)
    more = F.when(n < 16384, F.concat(_byte(n % 128 + 128), _byte(F.floor(n / 128)))).otherwise(F.concat(_byte(n % 128 + 128), _byte(F.floor(n / 128) % 128 + 128), _byte(F.floor(n / 16384))))
    return F.concat(_byte(F.lit(8 * number + 2)), F.when(n < 128, _byte(n)).otherwise(more), v)


def _text(value: Column | str) -> Column:
    return (F.lit(value) if isinstance(value, str) else value).cast("binary")


def _box(numbers: tuple[float, ...]) -> Column:
    return F.lit(b"".join(bytes([8 * i + 5]) + struct.pack("<f", v) for i, v in enumerate(numbers, 1)))


_VALUES = ", ".join(f"({k}, {', '.join(map(str, b))})" for k, b in enumerate(_BOXES))


@query(f"""WITH {BOXES_SQL}, v(k, cx, cy, w, h, t) AS (VALUES {_VALUES})
SELECT b.page_id, row_number() OVER (PARTITION BY b.page_id ORDER BY b.line_idx) - 1 AS line_idx, b.text || ' …' AS text, v.cx - v.w / 2 AS x, v.cy - v.h / 2 AS y, v.w::DOUBLE AS width, v.h::DOUBLE AS height,
  round(CASE WHEN v.h > v.w THEN 90.0 ELSE 0.0 END + CASE WHEN abs(v.t) < 2 * pi() THEN degrees(v.t) ELSE v.t END, 1)::DOUBLE AS orientation, 0.04::DOUBLE AS font_size, 0.98::DOUBLE AS confidence
FROM boxes b JOIN v ON v.k = b.line_idx % 3""")
def lens_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.when(F.col("line_idx") % 3 == 0, _box(_BOXES[0])).when(F.col("line_idx") % 3 == 1, _box(_BOXES[1])).otherwise(_box(_BOXES[2]))
    # Each message lies in the next; field 15 of a line and field 9 of the whole are unknown to the reader.
    inside = box_view(spark, sf_dir).select("page_id", "line_idx", _text(F.col("text")).alias("text"), box.alias("box"))
    inside = inside.withColumns({"text": _field(2, F.col("text")), "box": _field(1, F.col("box"))})
    inside = inside.withColumns({"text": F.concat(F.lit(b"\x28\x01"), F.col("text"), _field(3, _text("SPACE"))), "box": _field(2, F.col("box"))})
    last = F.concat(F.lit(b"\x28\x01"), _field(2, _text("･･･")), _field(3, _text("NEWLINE")))
    inside = inside.withColumn("line", F.concat(_field(1, F.col("text")), _field(1, last), _field(15, _text("?")), F.col("box")))
    each = inside.select("page_id", F.struct("line_idx", _field(2, F.col("line")).alias("line")).alias("v"))
    pages = each.groupBy("page_id").agg(F.array_sort(F.collect_list("v")).alias("v"))
    lines = F.aggregate("v", F.lit(b"").cast("binary"), lambda s, v: F.concat(s, v["line"]))
    whole = pages.select("page_id", lines.alias("message"))
    for number in (1, 1, 3, 2):
        whole = whole.select("page_id", _field(number, F.col("message")).alias("message"))
    whole = whole.select("page_id", F.concat(F.lit(b"\x48\x96\x01"), "message").alias("message"))
    return adapters.lens_lines(wire.decoded(whole))
