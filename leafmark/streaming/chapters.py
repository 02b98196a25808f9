"""Chapter jobs: recognise the pages of chapters one after another until they end.

A chapter is a base URL; its pages are that URL followed by 0, 1, 2 and so on.  Nobody says
how many there are: a chapter ends at the third page in a row that fails.  Pages that the
cache has are not asked for again, and like pages that succeed they end a run of failures.

`job` is the whole of it where what can be recognised is a table.  `start` is the stream:
a source of page numbers whose offset is in the checkpoint, and batches that ask for those
pages of all chapters that still run, and carry each chapter's run of failures on.  Killed
and started again it asks for the batch it was at once more, and ends at the same pages.

A page fails three times with those before it if it, its predecessor and that one's failed,
which is a count by page, so a chapter with a third of all pages is not one group.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.query import StreamingQuery

from leafmark import profiles, schema
from leafmark.sources import generations
from leafmark.sources.stage import release, settle

_PAGES = "chapter string, page long, url string, status string"
_STATES = "chapter string, streak long, ended long"


def page_urls(chapters: DataFrame, first, last) -> DataFrame:
    """(the columns of `chapters`, page, url) for the pages from `first` to `last`."""
    return chapters.withColumn("page", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")))).withColumn("url", F.concat("chapter", F.col("page").cast("string")))


def _ends(failed: DataFrame, most: int) -> DataFrame:
    """(chapter, ended): the first page that fails as the last of `most` in a row."""
    runs = failed.select("chapter", F.explode(F.sequence("page", F.col("page") + (most - 1))).alias("page")).groupBy("chapter", "page").count()
    return runs.where(F.col("count") == most).groupBy("chapter").agg(F.min("page").alias("ended"))


def job(chapters: DataFrame, cache: DataFrame, found: DataFrame, most: int = profiles.FAILURES_TO_STOP) -> DataFrame:
    """(chapter, page, url, status) of every page that is asked for: `cached`, `ready` or
    `failed`.  `cache` and `found` have the URLs in the cache and those that can be
    recognised.  Null chapters are left out; repeated ones count once."""
    chapters = chapters.select("chapter").where("chapter IS NOT NULL").distinct()
    urls = cache.select("url", F.lit(True).alias("cached")).unionByName(found.select("url", F.lit(False).alias("cached")))
    known = urls.where(F.col("url").isNotNull()).groupBy("url").agg(F.max("cached").alias("cached"))
    # Beyond the last known page only failures follow.
    # A base may itself end in digits, so each number that a URL ends in may be its page.
    digits = F.regexp_extract("url", "[0-9]{0,18}$", 0)
    ends = known.withColumn("n", digits).where("n <> ''").withColumn("k", F.explode(F.sequence(F.lit(1), F.length("n"))))
    ends = ends.withColumn("number", F.expr("right(n, k)")).where("k = 1 OR number NOT LIKE '0%'")
    split = ends.select(F.expr("substring(url, 1, length(url) - k)").alias("chapter"), F.col("number").cast("long").alias("page"), "cached").join(chapters, "chapter", "left_semi")
    last = split.groupBy("chapter").agg(F.max("page").alias("last"))
    asked = page_urls(chapters.join(last, "chapter", "left").withColumn("upto", F.coalesce("last", F.lit(-1)) + most), 0, F.col("upto"))
    status = F.when(F.col("cached"), "cached").when(~F.col("cached"), "ready").otherwise("failed")
    marked = asked.join(split, ["chapter", "page"], "left").select("chapter", "page", "url", status.alias("status"))
    stops = _ends(marked.where("status = 'failed'"), most)
    return marked.join(stops, "chapter").where(F.col("page") <= F.col("ended")).select("chapter", "page", "url", "status")


class PageRanges(DataSource):
    """A stream of ranges of page numbers, `step` at a time; the offset is the next page."""

    @classmethod
    def name(cls) -> str:
        return "page_ranges"

    def schema(self) -> str:
        return "first bigint, last bigint"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Ranges(int(self.options.get("step", 16)))


class _Ranges(SimpleDataSourceStreamReader):
    def __init__(self, step: int):
        self.step = step

    def initialOffset(self) -> dict:
        return {"page": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple[int, int]], dict]:
        end = {"page": start["page"] + self.step}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[int, int]]:
        return iter([(start["page"], end["page"] - 1)])


class Job:
    """A running chapter job."""

    def __init__(self, query: StreamingQuery, over: threading.Event):
        self.query, self._over = query, over

    def wait(self, seconds: float | None = None) -> bool:
        """Until all chapters have ended (True), or the time is up; then the stream stops."""
        waited = 0.0
        while not self._over.wait(0.1) and self.query.isActive and (seconds is None or waited < seconds):
            waited += 0.1
        failure = self.query.exception()
        self.query.stop()
        if failure:
            raise failure
        return self._over.is_set()


def start(chapters: DataFrame, cache: DataFrame, recognise: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, step: int = 16, most: int = profiles.FAILURES_TO_STOP) -> Job:
    """Run chapter jobs as a stream of batches of `step` pages of each chapter.

    `recognise` takes (url) and gives (url, context, data), one row for each page that
    succeeds, empty ones too.  Below `out` come `pages` (what was asked for), `found`
    (entries for the cache) and `chapters` (runs of failures), a folder a batch."""
    spark = chapters.sparkSession
    spark.dataSource.register(PageRanges)
    chapters = chapters.select("chapter").where("chapter IS NOT NULL").distinct()
    over = threading.Event()

    def apply(batch: DataFrame, n: int) -> None:
        at = batch.agg(F.min("first").alias("first"), F.max("last").alias("last")).first()
        if at.first is None:
            return
        states = _read(spark, f"{out}/chapters", _STATES, n).where(F.col("_batch") < n)
        ended = states.where("ended IS NOT NULL").select("chapter")
        streak = states.groupBy("chapter").agg(F.max_by("streak", "_batch").alias("streak"))
        live = settle(chapters.join(ended, "chapter", "left_anti").join(streak, "chapter", "left").select("chapter", F.coalesce("streak", F.lit(0)).alias("streak")))
        asked = page_urls(live, at.first, at.last)
        have = asked.join(cache.select("url").distinct(), "url", "left_semi").select("url", F.lit("cached").alias("status"))
        found = settle(recognise(asked.join(cache.select("url"), "url", "left_anti").select("url")).select("url", "context", "data"))
        good = have.unionByName(found.select("url", F.lit("ready").alias("status")).distinct())
        marked = settle(asked.join(good, "url", "left").select("chapter", "page", "url", F.coalesce("status", F.lit("failed")).alias("status"), "streak"))
        # Failures that a chapter brings along are those of the pages before.
        brought = F.sequence(F.lit(at.first) - F.col("streak"), F.lit(at.first - 1).cast("long"))
        before = live.where("streak > 0").select("chapter", F.explode(brought).alias("page"))
        ends = _ends(marked.where("status = 'failed'").select("chapter", "page").unionByName(before), most)
        kept = marked.join(ends, "chapter", "left").where(F.col("ended").isNull() | (F.col("page") <= F.col("ended")))
        kept.select("chapter", "page", "url", "status").write.mode("overwrite").parquet(f"{out}/pages/batch={n}")
        found.join(kept.where("status = 'ready'").select("url"), "url", "left_semi").write.mode("overwrite").parquet(f"{out}/found/batch={n}")
        last = marked.groupBy("chapter").agg(F.max(F.when(F.col("status") != "failed", F.col("page"))).alias("good"), F.first("streak").alias("streak"))
        run = F.when(F.col("good").isNull(), F.col("streak") + (at.last - at.first + 1)).otherwise(at.last - F.col("good"))
        last.join(ends, "chapter", "left").select("chapter", F.when(F.col("ended").isNull(), run).otherwise(most).cast("long").alias("streak"), "ended").write.mode("overwrite").parquet(f"{out}/chapters/batch={n}")
        if last.join(ends, "chapter", "left_anti").isEmpty():
            over.set()
        release(live, found, marked)

    ranges = spark.readStream.format("page_ranges").option("step", step).load()
    return Job(ranges.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start(), over)


def _read(spark: SparkSession, path: str, columns: str, before: int | None = None) -> DataFrame:
    """The rows of all batches, or those before one, with `_batch`."""
    done = [k for k in generations.numbers(spark, path, "batch") if before is None or k < before]
    rows = spark.read.schema(columns).option("basePath", path).parquet(*(f"{path}/batch={k}" for k in done)) if done else spark.createDataFrame([], columns)
    return rows.withColumn("_batch", F.regexp_extract(F.col("_metadata.file_path"), "/batch=([0-9]+)/", 1).cast("long") if done else F.lit(-1).cast("long"))


def pages(spark: SparkSession, out: str) -> DataFrame:
    """(chapter, page, url, status) of all pages that a job has asked for."""
    return _read(spark, f"{out}/pages", _PAGES).drop("_batch")


def found(spark: SparkSession, out: str) -> DataFrame:
    """(url, context, data) of the pages that it recognised."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.CACHE.fields[:3])
    return _read(spark, f"{out}/found", kinds).drop("_batch")
