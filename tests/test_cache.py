import json

import pytest
from pyspark.sql import functions as F

from leafmark import schema
from leafmark.sources import adapters, cache
from leafmark.streaming import cache_stream

BUBBLE = {"text": "a", "tightBoundingBox": {"x": 0.1, "y": 0.1, "width": 0.2, "height": 0.4}, "orientation": 90.0}


def write(path, content):
    path.write_text(content if isinstance(content, str) else json.dumps(content))
    return f"file://{path}"


def test_import_keeps_what_is_there(spark, tmp_path):
    old = cache.load(spark, write(tmp_path / "old.json", {"u1": {"context": "c", "data": [BUBBLE]}}))
    new = cache.load(spark, write(tmp_path / "new.json", {"u1": [], "u2": [BUBBLE], "u3": {"context": "x", "data": []}, "u4": {"x": 1}, "u5": "s"}))
    both = cache.imported(old, new)
    assert {r.url: r.context for r in both.collect()} == {"u1": "c", "u2": cache.IMPORTED, "u3": "x"}
    assert cache.imported(both, new).count() == both.count()
    assert cache.lookup(both, "u2").first().text == "a"


def test_unreadable_file_is_an_empty_cache(spark, tmp_path):
    assert cache.load(spark, write(tmp_path / "bad.json", "{ not json")).count() == 0


def test_upsert_takes_the_latest(spark):
    rows = [("u", "a", [], 1), ("u", "b", [], 3), ("u", "c", [], 2), ("v", "d", None, 9)]
    changes = spark.createDataFrame(rows, schema.CACHE)
    found = cache.upserted(changes.limit(0), changes).collect()
    assert [(r.url, r.context) for r in found] == [("u", "b")]
    assert cache.purged(changes)[1] == 4


def test_edits(spark):
    second = {**BUBBLE, "text": "b", "tightBoundingBox": {"x": 0.5, "y": 0.0, "width": 0.4, "height": 0.1}}
    rows = [("u", "c", [BUBBLE, second, {**BUBBLE, "text": "z"}], 1)]
    one = spark.createDataFrame(rows, schema.CACHE)
    texts = lambda df: [b.text for b in df.first().data]
    assert texts(cache.without_line(one, "u", 1)) == ["a", "z"]
    assert texts(cache.with_text(one, "u", 0, "q\nr")) == ["q​r", "b", "z"]
    merged = cache.with_merged(one, "u", 0, 1)
    assert texts(merged) == ["z", "a​b"]
    last = merged.first().data[-1]
    assert last.forcedOrientation == "auto" and round(last.tightBoundingBox.width, 9) == 0.8 and last.tightBoundingBox.y == 0.0


def test_maps_round_trip(spark, tmp_path):
    rows = [(f"u{i}", "c", [{**BUBBLE, "text": f"t{i}"}], 0) for i in range(25)]
    cache.save_map(spark.createDataFrame(rows, schema.CACHE), f"file://{tmp_path}/maps", urls=4)
    back = cache.load(spark, f"file://{tmp_path}/maps", lines=True)
    assert {(r.url, r.data[0].text) for r in back.collect()} == {(f"u{i}", f"t{i}") for i in range(25)}


def test_sync_normalises_and_drops_the_query(spark):
    old = spark.createDataFrame([("u", "a", [BUBBLE], 1), ("v", "a", [BUBBLE], 1)], schema.CACHE)
    edits = spark.createDataFrame([("u?x=1", "b", [{**BUBBLE, "text": "え ??!"}], 2), ("v", "b", None, 3)], schema.CACHE)
    found = {r.url: (r.context, [b.text for b in r.data]) for r in cache.synced(old, edits).collect()}
    assert found == {"u": ("b", ["え⁇"]), "v": ("a", ["a"])}


@pytest.mark.parametrize("compact", [16, 2])
def test_stream_of_changes(spark, tmp_path, compact):
    (tmp_path / "in").mkdir()
    for n, rows in enumerate([[("u", 1, "a"), ("v", 1, "b")], [("u", 5, "c")], [("u", 3, "late")]]):
        write(tmp_path / "in" / f"{n}.json", "\n".join(json.dumps({"url": u, "context": c, "data": [], "seq": s}) for u, s, c in rows))
        query = cache_stream.upsert_into(cache_stream.changes(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/table", f"file://{tmp_path}/ck", compact)
        query.awaitTermination()
    assert {r.url: r.context for r in cache_stream.current(spark, f"file://{tmp_path}/table").collect()} == {"u": "c", "v": "b"}
    assert sorted(p.name for p in (tmp_path / "table").iterdir() if "=" in p.name) == (["d=0", "d=1", "d=2"] + (["v=1"] if compact == 2 else []))


def test_compaction_keeps_what_plans_may_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path, plans = f"file://{tmp_path}/table", []
    for n in range(6):
        write(tmp_path / "in" / f"{n}.json", json.dumps({"url": f"u{n % 4}", "context": str(n), "data": [], "seq": n}))
        cache_stream.upsert_into(cache_stream.changes(spark, f"file://{tmp_path}/in"), path, f"file://{tmp_path}/ck", 2).awaitTermination()
        plans.append(cache_stream.current(spark, path))
    assert sorted(p.name for p in (tmp_path / "table").iterdir() if "=" in p.name) == ["d=4", "d=5", "v=3", "v=5"]
    assert {r.url: r.context for r in plans[3].collect()} == {"u0": "0", "u1": "1", "u2": "2", "u3": "3"}  # made before the last compaction
    assert {r.url: r.context for r in plans[5].collect()} == {"u0": "4", "u1": "5", "u2": "2", "u3": "3"}


def test_page_stream_keeps_failures(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.json", '{"page_id": 1}\n{"page_id": 2}')
    pages = spark.readStream.schema("page_id long").json(f"file://{tmp_path}/in")
    cache_stream.process_pages(pages, lambda b: b.where("page_id = 1").withColumn("text", F.lit("x")), f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination()
    found = spark.read.parquet(f"file://{tmp_path}/out/status").collect()
    assert {r.page_id: r.status for r in found} == {1: "ready", 2: "failed"}


def test_idle_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.json", "\n".join(json.dumps({"m": "x", "at": f"2024-01-01T00:{m:02d}:00Z"}) for m in (0, 5, 30)))
    uses = spark.readStream.schema("m string, at timestamp").json(f"file://{tmp_path}/in")
    cache_stream.idle_sessions(uses, "m", "at", 600).writeStream.format("memory").queryName("idle").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.uses for r in spark.table("idle").collect()) == [1, 2]


def test_adapters(spark):
    word = {"plain_text": "あ", "text_separator": "SPACE"}
    box = {"center_x": 0.5, "center_y": 0.5, "width": 0.1, "height": 0.4, "rotation_z": 0.1}
    result = {"paragraphs": [{"lines": [{"words": [word, {"plain_text": "･･･", "text_separator": "NEWLINE"}], "box": box}, {"words": [], "box": box}]}]}
    frame = spark.createDataFrame([(1, result)], f"page_id long, result {adapters.LENS}")
    (row,) = adapters.lens_lines(frame).collect()
    assert (row.text, round(row.x, 6), round(row.y, 6), row.orientation) == ("あ …", 0.45, 0.3, 95.7)
    with pytest.raises(ValueError, match="no engine"):
        adapters.engine("unknown")
