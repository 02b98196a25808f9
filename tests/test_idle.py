import datetime
import json
import os
import random

from pyspark.sql import functions as F

from leafmark.operators import windows
from leafmark.streaming import idle

ZERO = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
END = 10**6  # a use of another key that moves the watermark past all others


def run(spark, at, batches, late="0 seconds", seconds=600):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (at / "in").mkdir(parents=True)
    for n, rows in enumerate(batches):
        file = at / "in" / f"{n:03}.json"
        file.write_text("\n".join(json.dumps({"m": m, "at": (ZERO + datetime.timedelta(seconds=s)).isoformat()}) for m, s in rows))
        os.utime(file, (n, n))  # files are read by age
    uses = spark.readStream.schema("m string, at timestamp").option("maxFilesPerTrigger", 1).json(f"file://{at}/in")
    told = []
    query = idle.unloaded(uses, "m", "at", seconds, late).writeStream.foreachBatch(lambda b, n: told.extend(b.collect()))
    query.option("checkpointLocation", f"file://{at}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    base = int(ZERO.timestamp() * 1000)
    return sorted((r.key, r.load, (r.start - base) // 1000, (r.end - base) // 1000, r.uses) for r in told)


def test_equals_the_batch_form(spark, tmp_path):
    rng = random.Random(2)
    uses = sorted(((rng.choice("xyz"), s) for s in rng.sample(range(0, 20_000), 60)), key=lambda u: u[1])
    batches = [uses[:1], uses[1:20], uses[20:21], uses[21:], [("end", END)]]
    frame = spark.createDataFrame([(m, ZERO + datetime.timedelta(seconds=s)) for m, s in uses], "m string, at timestamp")
    sessions = windows.idle_sessions(frame, "m", "at", 600).select("m", "session", F.unix_seconds("start").alias("s"), F.unix_seconds("end").alias("e"), "uses").collect()
    zero = int(ZERO.timestamp())
    assert run(spark, tmp_path, batches) == sorted((r.m, r.session, r.s - zero, r.e - zero, r.uses) for r in sessions)


def test_exact_gap_and_reload(spark, tmp_path):
    told = run(spark, tmp_path, [[("x", 0), ("x", 600)], [("x", 1200)], [("y", 1801)], [("x", 1801)], [("end", END)]])
    assert [t for t in told if t[0] == "x"] == [("x", 1, 0, 1200, 3), ("x", 2, 1801, 1801, 1)]


def test_late_use_reloads(spark, tmp_path):
    """x is unloaded once the watermark has passed; a use behind the newest, but within the allowance, loads it again."""
    told = run(spark, tmp_path, [[("x", 0)], [("y", 5000)], [("y", 5001)], [("x", 4000)], [("end", END)]], late="2000 seconds")
    assert [t for t in told if t[0] == "x"] == [("x", 1, 0, 0, 1), ("x", 2, 4000, 4000, 1)]
