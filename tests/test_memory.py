import json
import os
import random

import pytest
from pyspark.sql import functions as F

from leafmark.operators import memory, windows

SCHEMA = "reader string, at long, seen array<string>, item string, epoch_ string"


def fold(events, most=3):
    """reader -> [(epoch, items, since, active)] by going through the events one by one."""
    out = {}
    for reader in {e[0] for e in events}:
        visible, held, active, epochs = [], {}, None, []
        own = sorted((e for e in events if e[0] == reader), key=lambda e: e[1])
        for _, at, seen, item, *_ in own:
            if seen is not None:
                if visible and seen and not set(visible) & set(seen):
                    epochs.append((held, active))
                    held, active = {}, None
                visible = seen
            if item is not None:
                active = item
                if item not in held:
                    held[item] = at
                    if len(held) > most:
                        del held[next(iter(held))]
        out[reader] = [*epochs, (held, active)]
    return out


def make(seed, n=400):
    rng = random.Random(seed)
    events = []
    for at in rng.sample(range(5000), n):
        reader = rng.choice(["a", "b", "b", "b", None])
        kind = rng.random()
        seen = rng.sample("pqrst", rng.randint(0, 2)) if kind < 0.4 else None
        item = rng.choice("vwxyz") if kind > 0.35 else None
        events.append((reader, at, seen, item, "x"))
    return events


@pytest.mark.parametrize("span", [40, 4096])
def test_epochs_against_a_fold(spark, span):
    events = make(span)
    frame = spark.createDataFrame(events, SCHEMA).repartition(5)
    found = memory.remembered(frame, "reader", "at", "seen", "item", span=span).collect()
    expected = {}
    for reader, epochs in fold(events).items():
        for k, (held, active) in enumerate(epochs):
            for item, at in held.items():
                expected[reader, k, item] = (at, item == active, k == len(epochs) - 1)
    assert {(r.reader, r.epoch, r.item): (r["at"], r.active, r.current) for r in found} == expected
    assert len(found) == len(expected) > 50


def test_page_turns_keep_null_rows(spark):
    rows = [(None, 1, ["a"]), (None, 2, ["b"]), ("k", None, ["a"]), ("k", 5, ["c"]), ("k", 9000, None), ("k", 9001, ["d"]), ("k", 9002, [])]
    found = windows.page_turns(spark.createDataFrame(rows, "k string, at long, seen array<string>"), "k", "at", "seen").collect()
    assert {(r.k, r["at"]): r.turned for r in found} == {(None, 1): False, (None, 2): True, ("k", None): False, ("k", 5): True, ("k", 9000): False, ("k", 9001): False, ("k", 9002): False}


def test_empty(spark):
    assert memory.remembered(spark.createDataFrame([], SCHEMA), "reader", "at", "seen", "item").count() == 0


def test_running_sum(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", None]), rng.randrange(300), rng.randrange(5)) for _ in range(500)]
    found = windows.running_sum(spark.createDataFrame(rows, "k string, at long, v long"), "k", "at", F.col("v"), "sum", span=7).collect()
    assert len(found) == 500
    assert all(r["sum"] == sum(v for k, at, v in rows if k == r.k and at <= r["at"]) for r in found)


def test_stream_across_batches(spark, tmp_path):
    """Every event a batch of its own, so turns and evictions fall on batch borders; and all at once."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = sorted((e for e in make(8, 24) if e[0]), key=lambda e: e[1])
    expected = {reader: (len(epochs) - 1, list(epochs[-1][0]), list(epochs[-1][0].values()), epochs[-1][1]) for reader, epochs in fold(events).items()}
    for batches in ([events[:1], *([e] for e in events[1:12]), events[12:]], [events]):
        at = tmp_path / str(len(batches))
        (at / "in").mkdir(parents=True)
        for n, rows in enumerate(batches):
            file = at / "in" / f"{n:03}.json"
            file.write_text("\n".join(json.dumps({"reader": r, "at": a, "seen": s, "item": i}) for r, a, s, i, _ in rows))
            os.utime(file, (n, n))  # files are read by age
        stream = spark.readStream.schema("reader string, at long, seen array<string>, item string").option("maxFilesPerTrigger", 1).json(f"file://{at}/in")
        told = memory.streamed(stream, "reader", "at", "seen", "item")
        rows = []

        def keep(batch, n, rows=rows):
            rows += [(n, *r) for r in batch.collect()]

        told.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"file://{at}/ck").trigger(availableNow=True).start().awaitTermination()
        last = {r[1]: (r[2], list(r[3]), list(r[4]), r[5]) for r in sorted(rows, key=lambda r: r[0])}
        assert last == expected
