"""The keyed result cache: a table (url, context, data, seq), one row for each URL.

Changes never rewrite a file in place: an update is a new DataFrame, and `save` writes it as
a new generation beside the old one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmark import schema
from leafmark.functions import text
from leafmark.sources import big_json, generations

IMPORTED = "Imported Data"
_DATA = schema.CACHE["data"].dataType


def entries(raw: DataFrame) -> DataFrame:
    """(url, context, data) of rows (url, entry) with each entry as JSON text: an object
    with `data`, or a bare list from an older file.  Others are left out."""
    head = F.substring(F.regexp_replace("entry", r"^\s+", ""), 1, 1)
    listed = F.when(head == "[", F.from_json("entry", _DATA))
    wrapped = F.when(head == "{", F.from_json("entry", T.StructType([schema.CACHE["context"], schema.CACHE["data"]])))
    data = F.coalesce(listed, wrapped["data"])
    context = F.when(head == "[", F.lit(IMPORTED)).otherwise(wrapped["context"])
    return raw.select("url", context.alias("context"), data.alias("data")).where("data IS NOT NULL")


def load(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A cache file of one JSON object, url to entry, or a folder of such files.  A large
    file is read by many tasks (`big_json`); with `lines`, each line is such an object (as
    `save_map` writes them).  Unreadable JSON is an empty cache."""
    if lines:
        pairs = spark.read.text(path).select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.StringType()))).alias("url", "entry"))
    else:
        pairs = big_json.members(spark, path).select(F.col("key").alias("url"), F.col("value").alias("entry"))
    return entries(pairs).withColumn("seq", F.lit(0).cast("long"))


def save(cache: DataFrame, path: str) -> None:
    """Make `cache` the table at `path`, which may be the one it was read from.  Where the
    write fails the table stays as it was; plans that read it already end well."""
    generations.replace(cache.select(*schema.CACHE.names), path)


def saved(spark: SparkSession, path: str) -> DataFrame:
    """The table that `save` wrote last; an empty one if there is none."""
    return generations.read(spark, path, schema.CACHE)


def save_map(cache: DataFrame, path: str, urls: int = 1000) -> None:
    """Write the cache in the form `load` reads: JSON objects, url to entry, of about `urls`
    entries each, one a line."""
    parts = max(1, -(-cache.count() // urls))
    entry = F.struct("url", F.struct("context", "data").alias("entry"))
    maps = cache.groupBy(F.pmod(F.xxhash64("url"), F.lit(parts)).alias("part")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    maps.select(F.to_json("m").alias("value")).write.mode("overwrite").text(path)


def export(cache: DataFrame, path: str) -> None:
    """One JSON line for each URL; readable by `spark.read.json`."""
    cache.select("url", "context", "data").write.mode("overwrite").json(path)


def imported(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with those entries of `new` (url, context, data) whose URL it lacks."""
    first = new.groupBy("url").agg(F.min_by(F.struct("context", "data"), F.coalesce("context", F.lit(""))).alias("e"))
    lacking = first.join(cache, "url", "left_anti").select("url", "e.context", "e.data", F.lit(0).cast("long").alias("seq"))
    return cache.unionByName(lacking)


def upserted(cache: DataFrame, changes: DataFrame) -> DataFrame:
    """The cache after changes (url, context, data, seq): the latest of each URL wins.
    Changes whose data is no list (null here) are refused."""
    return latest(cache.unionByName(changes.where("data IS NOT NULL")), "url", "seq")


def cleaned(cache: DataFrame) -> DataFrame:
    """The cache with the punctuation of every bubble's text normalised."""
    tidy = F.transform("data", lambda b: b.withField("text", text.clean_punctuation(b["text"])))
    return cache.withColumn("data", tidy)


def synced(cache: DataFrame, edits: DataFrame) -> DataFrame:
    """The cache after pages (url, context, data, seq) were normalised and written back:
    the URL counts without its query string, and pages without data are refused."""
    return upserted(cache, cleaned(edits.withColumn("url", text.bare_url(F.col("url")))))


def latest(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of each key with the highest `seq`, by a partial aggregate, not a sort."""
    others = [c for c in changes.columns if c != key]
    best = changes.groupBy(key).agg(F.max_by(F.struct(*others), seq).alias("_row"))
    return best.select(key, *(F.col(f"_row.{c}").alias(c) for c in others)).select(*changes.columns)


def missing(requests: DataFrame, cache: DataFrame, key: str = "url") -> DataFrame:
    """The requests that the cache cannot answer."""
    return requests.join(cache.select(key), key, "left_anti")


def lookup(cache: DataFrame, url: str) -> DataFrame:
    return cache.where(F.col("url") == url).select(F.explode("data").alias("b")).select("b.*")


def purged(cache: DataFrame) -> tuple[DataFrame, int]:
    """An empty cache, and how many entries are gone."""
    return cache.limit(0), cache.count()


def without_line(cache: DataFrame, url: str, index: int) -> DataFrame:
    """The cache without one bubble of a page; later bubbles move up."""
    kept = F.filter("data", lambda b, i: i != index)
    return cache.withColumn("data", F.when(F.col("url") == url, kept).otherwise(F.col("data")))


def with_text(cache: DataFrame, url: str, index: int, new_text: str) -> DataFrame:
    """The cache with one bubble's text replaced; it counts as merged if it has a join."""
    new = new_text.replace("\n", "​")
    edit = F.transform("data", lambda b, i: F.when(i == index, b.withField("text", F.lit(new)).withField("isMerged", F.lit("​" in new))).otherwise(b))
    return cache.withColumn("data", F.when(F.col("url") == url, edit).otherwise(F.col("data")))


def with_merged(cache: DataFrame, url: str, target: int, source: int, separator: str = "​") -> DataFrame:
    """The cache with two bubbles of a page as one, at the end: texts joined, boxes united,
    vertical only if both are."""
    a, b = F.element_at("data", target + 1), F.element_at("data", source + 1)
    box = lambda v: v["tightBoundingBox"]
    x, y = F.least(box(a)["x"], box(b)["x"]), F.least(box(a)["y"], box(b)["y"])
    right = F.greatest(box(a)["x"] + box(a)["width"], box(b)["x"] + box(b)["width"])
    bottom = F.greatest(box(a)["y"] + box(a)["height"], box(b)["y"] + box(b)["height"])
    vertical = lambda v: F.coalesce(v["forcedOrientation"] == "vertical", box(v)["height"] > box(v)["width"])
    both = F.struct(
        F.concat(a["text"], F.lit(separator), b["text"]).alias("text"),
        F.struct(x.alias("x"), y.alias("y"), (right - x).alias("width"), (bottom - y).alias("height")).alias("tightBoundingBox"),
        a["orientation"].alias("orientation"),
        F.lit(None).cast("double").alias("font_size"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(True).alias("isMerged"),
        F.when(vertical(a) & vertical(b), "vertical").otherwise("auto").alias("forcedOrientation"),
    )
    rest = F.filter("data", lambda v, i: ~i.isin(target, source))
    return cache.withColumn("data", F.when(F.col("url") == url, F.concat(rest, F.array(both))).otherwise(F.col("data")))
