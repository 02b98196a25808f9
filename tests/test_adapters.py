import pytest
from pyspark.sql import functions as F

from leafmark import schema
from leafmark.sources import adapters, cache


def test_images_of_a_folder(spark, tmp_path):
    for name, content in (("a.png", b"\x89PNG\x00\xff"), ("b.jpg", b""), ("c.png", b"x" * 100_000)):
        (tmp_path / name).write_bytes(content)
    found = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in adapters.images(spark, f"file://{tmp_path}").collect()}
    assert found == {"a.png": b"\x89PNG\x00\xff", "c.png": b"x" * 100_000}
    assert adapters.images(spark, f"file://{tmp_path}/*.png").count() == 2


def test_export_is_a_line_for_each_page(spark, tmp_path):
    bubble = {"text": 'a "b"\n{', "tightBoundingBox": {"x": 0.5, "y": 0.0, "width": 0.1, "height": 0.2}, "isMerged": True}
    rows = [("u", "c", [bubble], 4), ("v", None, [], 5)]
    cache.export(spark.createDataFrame(rows, schema.CACHE), f"file://{tmp_path}/out")
    back = spark.read.schema(schema.CACHE).json(f"file://{tmp_path}/out").collect()
    assert sorted((r.url, r.context, len(r.data)) for r in back) == [("u", "c", 1), ("v", None, 0)]
    assert next(r for r in back if r.url == "u").data[0].text == 'a "b"\n{'
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "out").glob("part-*")) == 2


def test_alphabet_has_the_blank_first_and_the_space_last(spark, tmp_path):
    (tmp_path / "keys.txt").write_text("あ\nい\n字\n", encoding="utf-8")
    assert schema.BUBBLE  # the alphabet belongs to the same recognisers
    assert adapters.alphabet(spark, f"file://{tmp_path}/keys.txt") == ["blank", "あ", "い", "字", " "]
    (tmp_path / "none.txt").write_text("")
    assert adapters.alphabet(spark, f"file://{tmp_path}/none.txt") == ["blank", " "]


def test_an_engine_recognises_a_folder(spark, tmp_path, monkeypatch):
    """From files to lines by a registered engine, whatever the case of its name."""
    (tmp_path / "1.png").write_bytes(b"two words")

    def engine(pages):
        return pages.select("page_id", F.posexplode(F.split(F.col("content").cast("string"), " ")).alias("line_idx", "text"))

    monkeypatch.setitem(adapters.ENGINES, "plain", engine)
    pages = adapters.images(spark, f"file://{tmp_path}").select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("page_id"), "content")
    assert [tuple(r) for r in adapters.engine("Plain")(pages).orderBy("line_idx").collect()] == [(1, 0, "two"), (1, 1, "words")]
    with pytest.raises(ValueError, match="known: plain"):
        adapters.engine("other")
