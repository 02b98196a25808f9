import json
import random

import pytest

from leafmark.sources import big_json, cache


def read(spark, path, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        return big_json._blocks(spark, path).rdd.getNumPartitions(), {r.key: r.value for r in big_json.members(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def decoded(found, like):
    return {k: v if isinstance(like.get(k), str) else json.loads(v) for k, v in found.items()}


@pytest.mark.parametrize("seed", range(3))
def test_against_a_whole_read(spark, tmp_path, seed):
    indent = 2 if seed == 1 else None
    rng = random.Random(seed)
    nasty = ["{", "}", "[", "]", ",", '"', "\\", '\\"', "},{", '":', "é", "漢", "\n", "a", " ", "\\\\"]
    text = lambda: "".join(rng.choices(nasty, k=rng.randint(0, 12)))
    value = lambda deep: rng.choice([text(), rng.randint(-9, 9), True, [value(deep - 1) for _ in range(rng.randint(0, 3))], {text(): value(deep - 1) for _ in range(rng.randint(0, 3))}]) if deep else text()
    whole = {f"u{i}{text()}": value(3) for i in range(rng.randint(1, 60))}
    (tmp_path / "x.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=bool(seed % 2)))
    for size in (37, 1 << 20):
        splits, found = read(spark, f"file://{tmp_path}/x.json", size)
        assert decoded(found, whole) == whole
        assert size > 200 or splits > (tmp_path / "x.json").stat().st_size // size // 2


BAD = ["", " ", "[]", '[{"a": 1}, {"b": 2}]', '{"a": 1', '{"a": 1}}', '{"a": 1}{"b": 2}', '{"a": 1, }', '{"a": 1,, "b": 2}', '{"a": "1, "b": 2}', '{"a": 1, "b": {]}', '{"a" 1, "b": 2}', '{"a": 1} x', '"a"', "{ not json"]


@pytest.mark.parametrize("size", [5, 1000])
def test_unreadable_files_are_empty(spark, tmp_path, size):
    for i, text in enumerate([*BAD, '{"good": 1, "b": [[], {}]}']):
        (tmp_path / f"{i}.json").write_text(text)
    assert read(spark, f"file://{tmp_path}", size)[1].keys() == {"good", "b"}


def test_small_objects_and_repeated_keys(spark, tmp_path):
    for text, size in [("{}", 1), (" {\n} ", 2), ('{"a": 1}', 3), (' {"a" :\t[ ] } \n', 4), ('{"a": 1, "b": 2, "a": 3}', 6)]:
        (tmp_path / "x.json").write_text(text)
        assert {k: json.loads(v) for k, v in read(spark, f"file://{tmp_path}/x.json", size)[1].items()} == json.loads(text)


def test_one_bad_file_of_several(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": {"data": []}, "b": [[], {}]}')
    (tmp_path / "b.json").write_text('{"c": 1, "d": ')
    (tmp_path / "c.json").write_text('{"e": 1, "f": "x,}y"}')
    assert read(spark, f"file://{tmp_path}", 9)[1].keys() == {"a", "b", "e", "f"}


def test_a_cache_of_one_object(spark, tmp_path):
    bubble = {"text": 'a "{,}\\" b', "tightBoundingBox": {"x": 0.1, "y": 0.1, "width": 0.2, "height": 0.4}}
    whole = {f"u{i}": {"context": "c", "data": [bubble] * (i % 4)} if i % 3 else [bubble] for i in range(500)}
    (tmp_path / "x.json").write_text(json.dumps(whole, indent=2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = {r.url: (r.context, [b.text for b in r.data]) for r in cache.load(spark, f"file://{tmp_path}/x.json").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {u: ("c", [bubble["text"]] * len(e["data"])) if isinstance(e, dict) else (cache.IMPORTED, [bubble["text"]]) for u, e in whole.items()}
