from pathlib import Path

from leafmark.sources import stage


def test_settled_tables_and_clearing(spark):
    folder = Path(stage.shared_folder(spark).removeprefix("file://"))
    stage.clear(spark)
    first, second = stage.settle(spark.range(5)), stage.settle(spark.range(7))
    (folder / "leafmark-other-application").mkdir(exist_ok=True)
    assert first.count() == 5
    stage.release(first)
    assert second.count() == 7
    assert stage.clear(spark) == 1
    assert [p.name for p in folder.iterdir() if p.name.startswith("leafmark-")] == ["leafmark-other-application"]
    assert stage.clear(spark) == 0
