"""Streams of pages and of cache changes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from leafmark import schema
from leafmark.sources import cache, generations
from leafmark.sources.stage import release, settle


def changes(spark: SparkSession, path: str) -> DataFrame:
    """Cache changes that arrive as JSON files of (url, context, data, seq)."""
    return spark.readStream.schema(schema.CACHE).json(path)


def upsert_into(stream: DataFrame, table_path: str, checkpoint: str, compact: int = 16) -> StreamingQuery:
    """Apply changes to the cache table in micro-batches: batch N adds the folder
    `table_path/d=N` with the latest change of each of its URLs, so its cost does not depend
    on the table.  Every `compact` batches the table is written anew as `v=N`.  What that
    replaces stays until the next time, for plans that read it already.  A batch that is run
    again writes the same folder."""
    spark = stream.sparkSession

    def apply(batch: DataFrame, n: int) -> None:
        cache.latest(batch.where("data IS NOT NULL"), "url", "seq").write.mode("overwrite").parquet(f"{table_path}/d={n}")
        whole = generations.numbers(spark, table_path)
        if n % compact == compact - 1 and n not in whole:
            current(spark, table_path).write.mode("overwrite").parquet(f"{table_path}/v={n}")
            before = (whole or [-1])[-1]
            generations.drop(spark, table_path, *(f"d={k}" for k in generations.numbers(spark, table_path, "d") if k <= before), *(f"v={k}" for k in whole if k < before))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table_path: str) -> DataFrame:
    """The cache table: the newest whole one and the batches since."""
    base = generations.numbers(spark, table_path)[-1:]
    paths = [f"{table_path}/v={n}" for n in base] + [f"{table_path}/d={n}" for n in generations.numbers(spark, table_path, "d") if n > (base or [-1])[0]]
    if not paths:
        return spark.createDataFrame([], schema.CACHE)
    rows = reduce(DataFrame.unionByName, (spark.read.schema(schema.CACHE).parquet(p) for p in paths))
    return cache.latest(rows, "url", "seq")


def latest_state(stream: DataFrame) -> DataFrame:
    """The latest change of each URL, as a streaming aggregate."""
    return stream.groupBy("url").agg(F.max_by(F.struct("context", "data"), "seq").alias("e"), F.max("seq").alias("seq")).select("url", "e.context", "e.data", "seq")


def process_pages(stream: DataFrame, recognise: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run a recogniser over arriving pages; failed pages keep a status, not an empty result."""

    def apply(batch: DataFrame, n: int) -> None:
        lines = settle(recognise(batch))  # used twice, computed once
        found = lines.groupBy("page_id").agg(F.count("*").alias("n_lines"))
        status = batch.select("page_id").distinct().join(found, "page_id", "left").withColumn("status", F.when(F.col("n_lines").isNull(), "failed").otherwise("ready"))
        status.write.mode("overwrite").parquet(f"{out}/status/batch={n}")
        lines.write.mode("overwrite").parquet(f"{out}/lines/batch={n}")
        release(lines)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def idle_sessions(uses: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Stretches of use that end when nothing came for `seconds`, with late data bounded by
    a watermark of the same length."""
    marked = uses.withWatermark(at, f"{seconds} seconds")
    grouped = marked.groupBy(F.session_window(at, f"{seconds} seconds").alias("w"), key)
    return grouped.agg(F.count("*").alias("uses")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("unloaded"), "uses")
