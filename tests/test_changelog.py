import json
import random

import pytest

from leafmark import schema
from leafmark.sources import cache, changelog, generations

SCHEMA = changelog.EVENT


def replay(events, upto):
    """The cache after the events up to a number, one by one."""
    held = {}
    for seq, kind, url, context, data in sorted((e for e in events if e[0] is not None and e[0] <= upto), key=lambda e: e[0]):
        if kind == "purged":
            held = {}
        elif kind in ("recognised", "updated", "imported") and url is not None and data is not None:
            if kind != "imported" or url not in held:
                held[url] = (context, len(data), seq)
    return held


def make(seed, n=200):
    rng = random.Random(seed)
    bubble = {"text": "t"}
    events = []
    for seq in range(n):
        kind = rng.choice(["recognised", "updated", "imported", "imported", "purged" if rng.random() < 0.15 else "updated", "other"])
        events.append((seq, kind, None if kind == "purged" else rng.choice(["u", "v", "w", "x", "y", None]), f"c{seq}", rng.choice([[], [bubble], [bubble] * 2, None])))
    return [*events, (None, "updated", "u", "lost", [])]


def held(frame):
    return {r.url: (r.context, len(r.data), r.seq) for r in frame.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_every_number(spark, seed):
    events = make(seed, 60)
    frame = spark.createDataFrame(events, SCHEMA).repartition(3).cache()
    for upto in [-1, 0, *random.Random(seed).sample(range(60), 14), 59]:
        assert held(changelog.replayed(frame, upto)) == replay(events, upto)
    assert held(changelog.replayed(frame)) == replay(events, 10**9)
    assert held(changelog.replayed(frame.limit(0))) == {}


def log(spark, tmp_path, batches, snapshot=2):
    (tmp_path / "in").mkdir(exist_ok=True)
    start = len(list((tmp_path / "in").iterdir()))
    for n, rows in enumerate(batches):
        (tmp_path / "in" / f"{start + n:03}.json").write_text("\n".join(json.dumps({k: v for k, v in zip(SCHEMA.names, e, strict=True) if v is not None}) for e in rows))
        path = f"file://{tmp_path}/log"
        changelog.append_to(changelog.arriving(spark, f"file://{tmp_path}/in"), path, f"file://{tmp_path}/ck", snapshot).awaitTermination()
    return f"file://{tmp_path}/log"


def test_log_snapshots_and_late_events(spark, tmp_path):
    events = make(4, 50)
    late = [events.pop(k) for k in (41, 33, 12)]  # arrive last
    ordered = [events[i : i + 10] for i in range(0, len(events), 10)]
    path = log(spark, tmp_path, ordered)
    assert [n for n, _ in changelog.snapshots(spark, path)] == [1, 3]
    for upto in (5, 19, 20, 30, 49):
        assert held(changelog.as_of(spark, path, upto)) == replay(events, upto)
    early = changelog.as_of(spark, path)  # a reader that planned before what follows
    log(spark, tmp_path, [late])
    for upto in (5, 12, 33, 40, 49):
        assert held(changelog.as_of(spark, path, upto)) == replay(events + late, upto)
    assert held(changelog.as_of(spark, path)) == replay(events + late, 10**9)
    assert held(early) == replay(events, 10**9)


def test_forget(spark, tmp_path):
    events = [(k, "updated", f"u{k % 7}", f"c{k}", []) for k in range(60)]
    path = log(spark, tmp_path, [events[i : i + 10] for i in range(0, 60, 10)])
    changelog.forget(spark, path, 45)
    assert generations.numbers(spark, path, "d") == [4, 5] and len(changelog.snapshots(spark, path)) == 2
    assert held(changelog.as_of(spark, path, 45)) == replay(events, 45)
    assert held(changelog.as_of(spark, path)) == replay(events, 59)
    with pytest.raises(ValueError, match="shortened"):
        changelog.as_of(spark, path, 20)


def test_purge_leaves_nothing(spark, tmp_path):
    path = log(spark, tmp_path, [[(1, "updated", "u", "a", [])], [(2, "purged", None, None, None)], [(3, "imported", "u", "b", [])]])
    assert held(changelog.as_of(spark, path, 1)) == {"u": ("a", 0, 1)}
    assert held(changelog.as_of(spark, path, 2)) == {}
    assert held(changelog.as_of(spark, path)) == {"u": ("b", 0, 3)}


def test_safe_replacement(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    rows = lambda *urls: spark.createDataFrame([(u, "c", [], 1) for u in urls], schema.CACHE)
    urls = lambda frame: sorted(r.url for r in frame.collect())
    assert urls(cache.saved(spark, path)) == []
    cache.save(rows("a", "b"), path)
    early = cache.saved(spark, path)
    cache.save(early.where("url = 'b'"), path)  # over the table it was read from
    assert urls(cache.saved(spark, path)) == ["b"]
    assert urls(early) == ["a", "b"]
    with pytest.raises(Exception, match="failed on purpose"):
        cache.save(rows("x").selectExpr("raise_error('failed on purpose') AS url", "context", "data", "seq"), path)
    assert urls(cache.saved(spark, path)) == ["b"]
    cache.save(rows("y"), path)
    cache.save(rows("z"), path)
    assert urls(cache.saved(spark, path)) == ["z"]
    assert len(generations.numbers(spark, path, complete=False)) == 2
