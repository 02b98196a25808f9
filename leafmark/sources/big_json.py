"""The members of one huge JSON object, read by many tasks.

Spark's text reader splits a file at any separator.  Read with a comma as separator, every
split is a run of whole stretches between commas, and a comma is never the second half of an
escape.  What is not known at a split's start is whether it lies within a string and how
deep it is nested, so:

1. each split tells what it does to both, once for either start (within a string or not);
2. from those few numbers, in the order of the splits, follows the state at each start;
3. with it each split finds the commas between members (outside strings, at depth 1), gives
   the members that it holds whole, and its first and last stretch, which are put together
   with those of its neighbours.

A member is in one task as a whole; nothing else is.  As with a plain JSON reader, of equal
keys the last counts.  A file that is not one object, ends within one or has a member that
cannot be read has no members at all.  Empty files have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PAIR = T.MapType(T.StringType(), T.StringType())
_WHITE = b" \t\r\n"
#: Bytes of a split that are looked at together.
_STRETCH = 4 << 20


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, stretch): the stretches between commas, those of a split in order."""
    read = spark.read.option("lineSep", ",").text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("stretch"))


class Scanner:
    """Follows quotes and brackets through the bytes of a split."""

    def __init__(self, inside: bool = False, depth: int = 0):
        self.inside, self.depth, self.shallowest = inside, depth, depth

    def feed(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the brackets and commas outside strings, and the depth behind each.
        `data` starts where no escape is pending and ends with a comma, or the split."""
        raw = np.frombuffer(data, np.uint8)
        quote = np.flatnonzero(raw == 34)
        if len(quote):
            slash = raw == 92
            if slash.any():  # quotes behind an odd number of backslashes are text
                last = np.maximum.accumulate(np.where(slash, -1, np.arange(len(raw), dtype=np.int64)))
                before = np.where(quote > 0, last[quote - 1], -1)
                quote = quote[(quote - 1 - before) % 2 == 0]
        at = np.flatnonzero((raw == 44) | (raw == 91) | (raw == 93) | (raw == 123) | (raw == 125))
        at = at[(np.searchsorted(quote, at) + self.inside) % 2 == 0]
        sign = raw[at]
        step = ((sign == 91) | (sign == 123)).astype(np.int64) - ((sign == 93) | (sign == 125))
        depth = self.depth + np.cumsum(step)
        self.inside = bool((self.inside + len(quote)) % 2)
        if len(depth):
            self.depth = int(depth[-1])
            self.shallowest = min(self.shallowest, int(depth.min()))
        return at, depth


def _split_by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, bytes]]:
    """(file, start, first of its split, bytes with the commas that followed), in order."""
    now, first, held, size = None, True, [], 0
    for batch in batches:
        for file, start, stretch in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            if now is not None and (now != (file, start) or size >= _STRETCH):
                yield *now, first, b",".join(held) + b","
                first, held, size = now != (file, start), [], 0
            now = file, start
            held.append(stretch)
            size += len(stretch) + 1
    if now is not None:
        yield *now, first, b",".join(held) + b","


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "start", "inside0", "depth0", "low0", "inside1", "depth1", "low1"]
    rows, both = [], None

    def told() -> None:
        rows.append((*key, *(x for s in both for x in (s.inside, s.depth, s.shallowest))))

    for file, start, first, data in _split_by_split(batches):
        if first:
            if both:
                told()
            key, both = (file, start), (Scanner(False), Scanner(True))
        for scanner in both:
            scanner.feed(data)
    if both:
        told()
    kinds = [pa.string(), pa.int64(), *[pa.bool_(), pa.int64(), pa.int64()] * 2]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _states(told: DataFrame) -> tuple[dict[tuple[str, int], tuple[bool, int]], set[str]]:
    """The state at each split's start, and the files that are one whole object as far as
    quotes and brackets tell.  A row for each split of the files: as many as read tasks."""
    states, whole, file = {}, set(), None
    for r in told.orderBy("file", "start").toLocalIterator():
        if r.file != file:
            file, inside, depth, sound = r.file, False, 0, True
        states[r.file, r.start] = inside, depth
        low, inside, change = (r.low1, r.inside1, r.depth1) if inside else (r.low0, r.inside0, r.depth0)
        sound = sound and depth + low >= 0
        depth += change
        (whole.add if sound and not inside and depth == 0 else whole.discard)(file)
    return states, whole


def _cut(states: dict[tuple[str, int], tuple[bool, int]]):
    """Members and pieces of members: kind 0 a whole member, 1 what ends one that an earlier
    split began, 2 what begins one, 3 a split within one; 4 marks what closes the object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        scanner = key = None
        nth, held, opened = 0, [], False

        def end() -> None:
            # The comma behind a split's last stretch stands in the file, or the file has ended.
            if key is not None:
                out.append((*key, nth, 2 if opened else 3, b"".join(held)))

        for file, start, first, data in _split_by_split(batches):
            if first:
                end()
                key, nth, held, opened = (file, start), 0, [], False
                if key not in states:
                    raise ValueError(f"the splits of {file} changed while it was read; read it again")
                scanner = Scanner(*states[key])
            at, depth = scanner.feed(data)
            was = 0
            for i in at[depth == 1].tolist():
                if data[i] == 44:
                    held.append(data[was:i])
                    out.append((*key, nth, 0 if opened else 1, b"".join(held)))
                    nth, held, opened, was = nth + 1, [], True, i + 1
            out += [(file, start, nth, 4, b"")] * int(((depth == 0) & (np.frombuffer(data, np.uint8)[at] != 44)).sum())
            held.append(data[was:])
            if len(out) >= 1000 or sum(len(r[4]) for r in out) > 4 << 20:
                yield _rows(out)
                out.clear()
        end()
        yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["file", "start", "nth", "kind", "piece"])


def members(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value): the members of the object in each file, values as JSON text, but
    strings as they are."""
    blocks = _blocks(spark, path)
    states, whole = _states(blocks.mapInArrow(_tell, "file string, start long, inside0 boolean, depth0 long, low0 long, inside1 boolean, depth1 long, low1 long"))
    if not whole:
        return spark.createDataFrame([], "file string, key string, value string")
    found = blocks.mapInArrow(_cut(states), "file string, start long, nth long, kind int, piece binary").where(F.col("file").isin(*whole))
    # At most two pieces a split: one that begins a member opens a group of those that end it.
    line = Window.partitionBy("file").orderBy("start", "nth")
    begins = F.sum((F.col("kind") == 2).cast("long"))
    edges = found.where("kind IN (1, 2, 3)").withColumn("member", begins.over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    edges = edges.groupBy("file", "member").agg(F.array_sort(F.collect_list(F.struct("start", "nth", "piece"))).alias("p"))
    every = Window.partitionBy("file")
    edges = edges.withColumns({"first": F.col("member") == 0, "last": F.col("member") == F.max("member").over(every)})
    joined = F.aggregate("p", F.lit("").cast("binary"), lambda a, v: F.concat(a, v["piece"])).cast("string")
    edges = edges.select("file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["nth"].alias("nth"), joined.alias("text"), "first", "last")
    inner = found.where("kind = 0").select("file", "start", "nth", F.col("piece").cast("string").alias("text"), F.lit(False).alias("first"), F.lit(False).alias("last"))
    white = F.lit(" \t\r\n")
    # The object's own brackets: the comma behind the last one is the reader's.
    tail = F.rtrim(F.regexp_replace(F.col("text"), ",$", ""), white)
    closed = F.when(F.col("last"), F.when(tail.endswith("}"), F.substring(tail, F.lit(1), F.length(tail) - 1))).otherwise(F.col("text"))
    head = F.ltrim(closed, white)
    opened = F.when(F.col("first"), F.when(head.startswith("{"), F.substring(head, F.lit(2), F.length(head)))).otherwise(closed)
    each = inner.unionByName(edges).withColumn("text", opened)
    empty = (F.trim("text", white) == "") & ~(F.col("first") & F.col("last"))
    each = each.select("file", "start", "nth", F.when(~empty, F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), _PAIR)).alias("pair"))
    # What closes the object stands once, at its end.
    again = found.where("kind = 4").groupBy("file").count().where("count > 1").select("file")
    bad = each.where("pair IS NULL").select("file").union(again).distinct()
    pairs = each.join(bad, "file", "left_anti").select("file", "start", "nth", F.explode("pair").alias("key", "value"))
    return pairs.groupBy("file", "key").agg(F.max_by("value", F.struct("start", "nth")).alias("value"))
