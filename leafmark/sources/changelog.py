"""The result cache as an ordered log of what happened to it.

An event is (seq, kind, url, context, data), of one of four kinds: a page was `recognised`
or an entry `updated` (both overwrite the entry), an entry was `imported` (which counts only
where the URL has none), or the cache was `purged` (which has no URL).  Overwrites without
data are refused, as are events without a seq, and those of other kinds or without a URL.

What the cache held at a number follows from the events up to it without replaying them one
by one: of the events since the last purge, the latest overwrite of a URL counts, else its
first import.  Both are partial aggregates, so a URL with a third of all events is one row
a task before anything is shuffled.  Of events with one seq and URL any may count.

A log table is a folder of batches `d=N`, which are only ever added, and of snapshots
`v=N-S`, the cache after the batches up to N, whose highest seq is S.  A snapshot saves
reading what it holds and decides nothing: where a later batch brings an event that
belongs before S, readers take an older one, or none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from leafmark import schema
from leafmark.sources import generations

OVERWRITES, IMPORT, PURGE = ("recognised", "updated"), "imported", "purged"
EVENT = T.StructType([T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()), *schema.CACHE.fields[:3]])


def accepted(events: DataFrame) -> DataFrame:
    """The events that change anything."""
    entry = F.col("url").isNotNull() & F.col("data").isNotNull() & F.col("kind").isin(*OVERWRITES, IMPORT)
    return events.where(F.col("seq").isNotNull() & (entry | (F.col("kind") == PURGE)))


def replayed(events: DataFrame, upto: int | None = None) -> DataFrame:
    """(url, context, data, seq): the cache after the events up to that number, or all."""
    events = accepted(events) if upto is None else accepted(events.where(F.col("seq") <= upto))
    purged = events.where(F.col("kind") == PURGE).agg(F.max("seq")).first()[0]  # one number, which prunes the scan
    since = events.where(F.col("kind") != PURGE)
    since = since if purged is None else since.where(F.col("seq") > purged)
    entry = F.struct("context", "data", "seq")
    over = F.col("kind").isin(*OVERWRITES)
    urls = since.groupBy("url").agg(F.max_by(entry, F.when(over, F.col("seq"))).alias("put"), F.min_by(entry, F.when(~over, F.col("seq"))).alias("add"))
    return urls.select("url", F.coalesce("put", "add").alias("e")).select("url", "e.context", "e.data", "e.seq")


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """Events that arrive as JSON files."""
    return spark.readStream.schema(EVENT).json(path)


def append_to(stream: DataFrame, path: str, checkpoint: str, snapshot: int = 16) -> StreamingQuery:
    """Add arriving events to the log table, a batch a folder; every `snapshot` batches the
    cache as it stands is written beside them.  A batch that is run again writes the same
    folder."""
    spark = stream.sparkSession

    def add(batch: DataFrame, n: int) -> None:
        accepted(batch).write.mode("overwrite").parquet(f"{path}/d={n}")
        if n % snapshot == snapshot - 1 and n not in {k for k, _ in snapshots(spark, path)}:
            last = _batches(spark, path).agg(F.max("seq")).first()[0]
            if last is not None:
                as_of(spark, path).write.mode("overwrite").parquet(f"{path}/v={n}-{last}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshots(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(last batch, highest seq) of the snapshots that were written in full."""
    return sorted(tuple(map(int, name.split("-", 1))) for name in generations.names(spark, path))


def _batches(spark: SparkSession, path: str, after: int = -1) -> DataFrame:
    paths = [f"{path}/d={n}" for n in generations.numbers(spark, path, "d") if n > after]
    return spark.read.schema(EVENT).parquet(*paths) if paths else spark.createDataFrame([], EVENT)


def _base(spark: SparkSession, path: str, upto: int | None) -> tuple[int, int] | None:
    """The newest snapshot that holds for `upto`: none of its events is later, and no batch
    since brought an event that it should have had."""
    for n, last in reversed(snapshots(spark, path)):
        if (upto is None or last <= upto) and _batches(spark, path, n).where(F.col("seq") <= last).isEmpty():
            return n, last
    return None


def as_of(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """(url, context, data, seq): the cache after all events up to a number, or all that
    there are.  A number before what `forget` kept raises ValueError."""
    base = _base(spark, path, upto)
    events = _batches(spark, path, base[0] if base else -1)
    if base is None and min(generations.numbers(spark, path, "d"), default=0) > 0:
        raise ValueError(f"the log at {path} has been shortened; {upto} is before what was kept")
    if base:
        held = spark.read.schema(schema.CACHE).parquet(f"{path}/v={base[0]}-{base[1]}")
        events = events.unionByName(held.withColumn("kind", F.lit(OVERWRITES[1])))
    return replayed(events, upto)


def forget(spark: SparkSession, path: str, before: int) -> None:
    """Drop batches and snapshots that no number from `before` on needs.  Plans made up to
    now may still read them: call it when those have ended."""
    base = _base(spark, path, before)
    if base:
        old = [f"d={n}" for n in generations.numbers(spark, path, "d") if n <= base[0]]
        generations.drop(spark, path, *old, *(f"v={n}-{s}" for n, s in snapshots(spark, path) if n < base[0]))
