import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmark import profiles, schema
from leafmark.functions import boxes
from leafmark.operators import grouped, layout, windows

NAMES = ["page_id", "line_idx", "text", "x1", "y1", "x2", "y2", "orientation", "font_size", "confidence"]


def page_rows(n, tall=1):
    rng = random.Random(n)
    for page in [*range(n), None]:
        for i in range(rng.randint(1, 7)):
            x, y = 20.0 * rng.randrange(20), 20.0 * rng.randrange(20) * tall
            yield page, i, rng.choice(["a", "漢字", "かな", "ab", None]), x, y, x + 20 * rng.randint(1, 4), y + 20 * rng.randint(1, 4), rng.choice([None, 90.0]), None, None


def test_groups_across_batches():
    keys = [1, 1, None, None, None, 2, 3, 3, 3, 3, 4]
    whole = pa.RecordBatch.from_pydict({"k": pa.array(keys), "v": pa.array(range(11))})
    for size in (1, 2, 3, 11):
        found = [(b.column("v").to_pylist(), s.tolist()) for b, s in grouped.whole_groups((whole.slice(i, size) for i in range(0, 11, size)), ["k"])]
        assert [v[a:b] for v, s in found for a, b in zip(s, s[1:], strict=False)] == [[0, 1], [2, 3, 4], [5], [6, 7, 8, 9], [10]]


@pytest.mark.parametrize("profile", ["python", "node"])
@pytest.mark.parametrize("tall", [1, 20])
def test_links_of_a_batch_are_those_of_the_join(spark, profile, tall):
    p = profiles.GROUPINGS[profile]
    frame = spark.createDataFrame([r for r in page_rows(150, tall) if r[0] is not None], schema.LINES)
    cut = windows.segments(frame, F.lit(400.0 * tall))
    links = {tuple(r) for r in layout.edges(layout.measured(cut, F.lit(1100.0), p), p).collect()}
    rows = sorted(page_rows(150, tall), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rows = [r for r in rows if r[0] is not None]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], grouped._KINDS[schema.LINES.split(", ")[i].split()[1]]) for i in range(10)] + [pa.array([1100.0] * len(rows)), pa.array([400.0 * tall] * len(rows))], names=[*NAMES, "_w", "_h"])
    starts = pa.array([0, *(i for i in range(1, len(rows)) if rows[i][0] != rows[i - 1][0]), len(rows)]).to_numpy()
    found = {(rows[a][0], rows[a][1], rows[b][1]) for x, y in layout._linked_pairs(batch, starts, layout._segmented(batch, starts), p) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert found == links and found


def test_pages_are_dealt_out_once(spark):
    """Suppression and grouping share one exchange, reading order has no join, and lines of their own are not looked at one by one."""
    frame = spark.createDataFrame(list(page_rows(40)), schema.LINES)
    plan = lambda f: f._jdf.queryExecution().optimizedPlan().toString()
    order = plan(layout.page_order(frame.withColumn("vertical", F.lit(True))))
    assert "Join" not in order and order.count("RepartitionByExpression") == 1
    both = plan(layout._in_groups(layout.suppressed(frame), F.lit(1000.0), F.lit(1000.0), "python", layout._SIZED_GROUPS, placed=True))
    assert "Join" not in both and both.count("RepartitionByExpression") == 1


def test_corners_without_a_sort(spark):
    rows = [([[5.0, 0.0], [9.0, 6.0], [4.0, 9.0], [0.0, 3.0]],), ([[1.0, 1.0], [1.0, 1.0], [4.0, 4.0], [4.0, 1.0]],), (None,)]
    found = spark.createDataFrame(rows, "p array<array<double>>").select(boxes.ordered_corners(F.col("p")).alias("o"))
    assert "array_sort" not in found._jdf.queryExecution().optimizedPlan().toString()
    first, second, none = found.collect()
    assert first.o.corners == [[0.0, 3.0], [5.0, 0.0], [9.0, 6.0], [4.0, 9.0]] and (first.o.width, first.o.height) == (5, 7)
    assert second.o.corners[0] == [1.0, 1.0] and none.o is None


def test_recognised_once(spark):
    """Pages in slices and whole ones come from one recognition, whose lines are kept."""
    seen = spark.sparkContext.accumulator(0)

    def recognise(cut):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b
        each = cut.select("page_id", "offset").mapInArrow(run, "page_id long, offset long")
        values = {"line_idx": F.lit(0).cast("long"), "text": F.lit("a"), "x": F.lit(0.1), "y": F.lit(0.2), "width": F.lit(0.3), "height": F.lit(0.4), "orientation": F.lit(None).cast("double"), "confidence": F.lit(0.9)}
        return each.withColumns(values)

    pages = spark.createDataFrame([(1, 1000.0, 6000.0), (2, 1000.0, 900.0)], "page_id long, width double, height double")
    assert layout.chunked(pages, recognise).count() == 4 and seen.value == 4
