import random

import pytest
from pyspark.sql import functions as F

from leafmark.streaming import chapters


def walk(bases, cached, good, most=3):
    """(chapter, page) -> status, as one job after another would ask."""
    out = {}
    for base in bases:
        page = failures = 0
        while failures < most:
            url = f"{base}{page}"
            out[base, page] = "cached" if url in cached else "ready" if url in good else "failed"
            failures = failures + 1 if out[base, page] == "failed" else 0
            page += 1
    return out


def make(seed):
    rng = random.Random(seed)
    bases = [f"http://h/m{k}/page/" for k in range(8)] + ["http://h/m1/page/1", "http://h/"]
    urls = [f"{b}{p}" for b in bases for p in range(rng.randint(0, 25)) if rng.random() < 0.75]
    cached = set(rng.sample(urls, len(urls) // 3)) | {"http://h/m2/page/007", "other", "http://h/m3/page/x"}
    return bases, cached, {u for u in urls if rng.random() < 0.8}


@pytest.mark.parametrize("seed", range(2))
def test_job_against_a_walk(spark, seed):
    bases, cached, good = make(seed)
    one = lambda rows, name: spark.createDataFrame([(r,) for r in rows], f"{name} string")
    found = chapters.job(one([*bases, bases[0], None], "chapter"), one([*cached, None], "url"), one([*good, *list(good)[:5]], "url")).collect()
    assert {(r.chapter, r.page): r.status for r in found} == walk(bases, cached, good)
    assert len(found) == len(walk(bases, cached, good))


def test_empty(spark):
    none = spark.createDataFrame([], "chapter string, url string")
    assert chapters.job(none, none, none).count() == 0


@pytest.mark.parametrize("step", [2, 7])
def test_stream_ends_where_the_walk_does(spark, tmp_path, step):
    bases, cached, good = make(step + 3)
    run(spark, tmp_path, bases[:3], cached, good, step)
    check(spark, tmp_path, bases[:3], cached, good)


def run(spark, at, bases, cached, good, step, fail_at=None, seconds=240):
    one = lambda rows, name: spark.createDataFrame([(r,) for r in rows], f"{name} string")
    asked = []

    def recognise(urls):
        asked.append(1)
        if fail_at is not None and len(asked) > fail_at:
            raise RuntimeError("killed on purpose")
        return urls.where(F.col("url").isin(*good)).withColumns({"context": F.lit("c"), "data": F.array().cast("array<struct<text:string>>")})

    job = chapters.start(one(bases, "chapter"), one(cached, "url"), recognise, f"file://{at}/out", f"file://{at}/ck", step)
    assert job.wait(seconds)


def check(spark, at, bases, cached, good):
    asked = chapters.pages(spark, f"file://{at}/out").collect()
    expected = walk(bases, cached, good)
    assert {(r.chapter, r.page): r.status for r in asked} == expected
    assert len(asked) == len(expected)
    found = [r.url for r in chapters.found(spark, f"file://{at}/out").collect()]
    assert sorted(found) == sorted(f"{b}{p}" for (b, p), s in expected.items() if s == "ready")


def test_killed_and_started_again(spark, tmp_path):
    bases, cached, good = make(11)
    with pytest.raises(Exception, match="killed on purpose"):
        run(spark, tmp_path, bases[:4], cached, good, 3, fail_at=2)
    run(spark, tmp_path, bases[:4], cached, good, 3)
    check(spark, tmp_path, bases[:4], cached, good)
