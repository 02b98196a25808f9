"""Operators on ordered rows: slices, runs, stop rules, recency."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark import profiles


def slices(height: Column, profile: str = "engine") -> Column:
    """Array of (offset, size) of the overlapping slices of a page."""
    p = profiles.SLICINGS[profile]
    step = p.height - p.overlap
    last = F.greatest(height - 1, F.lit(0))
    if p.early_stop:  # up to the first that reaches the end
        last = F.greatest(F.ceil((height - p.height) / step), F.lit(0)) * step
    cut = F.transform(
        F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long")),
        lambda o: F.struct(o.alias("offset"), F.least(F.lit(p.height).cast("long"), height.cast("long") - o).alias("size")),
    )
    cut = F.filter(cut, lambda s: s["size"] > 0)
    if p.whole_up_to:
        whole = F.array(F.struct(F.lit(0).cast("long").alias("offset"), height.cast("long").alias("size")))
        cut = F.when(height <= p.whole_up_to, whole).otherwise(cut)
    return F.when(height > 0, cut).otherwise(F.array().cast("array<struct<offset:bigint,size:bigint>>"))


def sliced(pages: DataFrame, height: Column, profile: str = "engine") -> DataFrame:
    return pages.withColumn("slice", F.explode(slices(height, profile))).select(
        *pages.columns, F.col("slice.offset").alias("offset"), F.col("slice.size").alias("size")
    )


def to_page(frame: DataFrame, offset: Column, size: Column, height: Column) -> DataFrame:
    """Boxes given in shares of a slice, as shares of the page."""
    return frame.withColumns({"y": (F.col("y") * size + offset) / height, "height": F.col("height") * size / height})


def segments(lines: DataFrame, height: Column | None = None) -> DataFrame:
    """`lines` with `segment`, from 0 down each page: a segment takes lines, by their top,
    while their bottom is within 3000 pixels of its first top.  Pages no taller than that
    are one segment, and a segment whose second line does not fit takes all that is left."""
    tall = F.max(F.lit(True) if height is None else height > profiles.SEGMENT_HEIGHT)
    state = "struct<n:bigint,top:double,alone:boolean,rest:boolean,of:array<bigint>>"

    def step(s: Column, v: Column) -> Column:
        fits = v["y2"] - s["top"] <= profiles.SEGMENT_HEIGHT
        opens = ~s["rest"] & ~fits & ~s["alone"]
        rest = s["rest"] | (~fits & s["alone"])
        n = F.when(opens, s["n"] + 1).otherwise(s["n"])
        return F.struct(
            n.alias("n"),
            F.when(opens, v["y1"]).otherwise(s["top"]).alias("top"),
            F.when(opens, True).otherwise(False).alias("alone"),
            rest.alias("rest"),
            F.concat(s["of"], F.array(n)).alias("of"),
        ).cast(state)

    others = [c for c in lines.columns if c not in ("page_id", "line_idx", "y1")]
    ordered = F.array_sort(F.collect_list(F.struct("y1", "line_idx", *others)))
    pages = lines.groupBy("page_id").agg(ordered.alias("v"), tall.alias("tall"))
    first = F.col("v")[0]
    zero = F.lit(0).cast("long")
    start = F.struct(
        zero.alias("n"), first["y1"].alias("top"), F.lit(True).alias("alone"), F.lit(False).alias("rest"), F.array(zero).alias("of")
    ).cast(state)
    folded = F.aggregate(F.slice("v", F.lit(2), F.size("v")), start, step)["of"]
    numbers = F.when(F.col("tall"), folded).otherwise(F.transform("v", lambda v: zero))
    zipped = F.explode(F.transform("v", lambda v, i: F.struct(v.alias("v"), F.get(F.col("numbers"), i).alias("segment"))))
    found = pages.withColumn("numbers", numbers).select("page_id", zipped.alias("s"))
    return found.select(*(F.col("page_id") if c == "page_id" else F.col(f"s.v.`{c}`").alias(c) for c in lines.columns), F.col("s.segment").alias("segment"))


def running_sum(rows: DataFrame, key: str, order: str, value: Column, name: str, span: int = 4096) -> DataFrame:
    """`rows` with the sum of `value` (a long) over the rows of the key up to this one and
    those of equal order.  Stretches of `span` of the order are summed in parallel, and the
    sums of the stretches before, a row each, are added."""
    part = F.floor(F.col(order) / span)
    cut = rows.withColumns({"_part": part, "_value": value})
    inside = Window.partitionBy(key, "_part").orderBy(F.asc_nulls_first(order)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(key).orderBy(F.asc_nulls_first("_part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(key, "_part").agg(F.sum("_value").alias("_total"))
    totals = totals.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_earlier"))
    summed = cut.withColumn("_inside", F.sum("_value").over(inside))
    joined = summed.join(totals, summed[key].eqNullSafe(F.col("_key")) & F.col("_part").eqNullSafe(F.col("_of")))
    return joined.select(*rows.columns, (F.col("_inside") + F.col("_earlier")).cast("long").alias(name))


def with_previous(rows: DataFrame, key: str, order: str, value: str, name: str, span: int = 4096) -> DataFrame:
    """`rows` with the `value` of the row before in the key.  Null keys are a key; rows
    with a null order come first.

    `order` is a number.  Stretches of `span` of it are looked through in parallel, however
    few keys there are; a stretch's first row gets the last of the stretch before.
    """
    cut = rows.withColumn("_part", F.floor(F.col(order) / span))
    inside = Window.partitionBy(key, "_part").orderBy(F.asc_nulls_first(order))
    marked = cut.withColumns({"_nth": F.row_number().over(inside), "_before": F.lag(value).over(inside)})
    ends = cut.groupBy(key, "_part").agg(F.max_by(F.struct(value), F.coalesce(F.col(order), F.lit(0)))[value].alias("_end"))
    line = Window.partitionBy(key).orderBy(F.asc_nulls_first("_part"))
    carried = ends.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), F.lag("_end").over(line).alias("_end"))
    joined = marked.join(carried, marked[key].eqNullSafe(F.col("_key")) & F.col("_part").eqNullSafe(F.col("_of")))
    return joined.select(*rows.columns, F.when(F.col("_nth") == 1, F.col("_end")).otherwise(F.col("_before")).alias(name))


def before_stop(attempts: DataFrame, key: str, order: str, failed: Column, most: int = profiles.FAILURES_TO_STOP, span: int = 4096) -> DataFrame:
    """The attempts of each key up to and including the one that makes `most` failures in
    a row; all of them where that never happens.  Attempts whose `failed` is null neither
    fail nor end a row of failures; those of equal order stay or go together.

    `order` is a number.  Rows of failures are numbered by running sums, and only the first
    `most` of each are looked at, so a key with very many attempts is not one task's.
    """
    marked = attempts.select(key, order, failed.alias("_failed"))
    runs = running_sum(marked, key, order, F.coalesce((~F.col("_failed")).cast("long"), F.lit(0)), "_run", span)
    nth = F.row_number().over(Window.partitionBy(key, "_run").orderBy(F.asc_nulls_first(order)))
    ends = runs.where("_failed").withColumn("_nth", nth).where(F.col("_nth") == most)
    stops = ends.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(order)).alias("_stop"))
    joined = attempts.join(stops, attempts[key].eqNullSafe(F.col("_key")), "left")
    return joined.where(F.col("_stop").isNull() | (F.struct(order) <= F.col("_stop"))).select(*attempts.columns)


def page_turns(polls: DataFrame, key: str, order: str, items: str, span: int = 4096) -> DataFrame:
    """`polls` with `turned`: this poll and the one before of the key both saw something,
    and nothing in common.  Null keys are a key; polls with a null order come first."""
    before = F.col("_previous")
    turned = (F.size(before) > 0) & (F.size(items) > 0) & ~F.arrays_overlap(F.col(items), before)
    return with_previous(polls, key, order, items, "_previous", span).withColumn("turned", F.coalesce(turned, F.lit(False))).drop("_previous")


def recent(seen: DataFrame, key: str, order: str, item: str, most: int = profiles.RECENT) -> DataFrame:
    """(key, item, order): what a memory of `most` items holds for each key in the end, and
    when each came in.  Seeing a remembered item changes nothing; another one comes in and,
    if there are too many, the one that came in first goes (and may come back later).

    Each step depends on all before, so a key's rows stream in order through one task, which
    remembers `most` items; keys are spread over the cluster.
    """
    kept = seen.select(key, item, order)
    schema = kept.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, memory, first = None, {}, True

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{key: now, item: i, order: o} for i, o in memory.items()], schema=kind)

        for batch in batches:
            kind = batch.schema
            for k, i, o in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first or k != now:
                    if memory:
                        yield rows()
                    now, memory, first = k, {}, False
                if i not in memory:
                    memory[i] = o
                    if len(memory) > most:
                        del memory[next(iter(memory))]
        if memory:
            yield rows()

    return kept.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def idle_sessions(uses: DataFrame, key: str, at: str, seconds: int = profiles.IDLE_SECONDS, span: int = 86400) -> DataFrame:
    """(key, session, start, end, uses): stretches of use with no pause over `seconds`.

    Pauses and numbers of sessions are found for stretches of `span` seconds in parallel,
    so a key with very many uses is not one task's.  Uses without a time are session 0.
    """
    timed = uses.select(key, at, F.unix_seconds(F.col(at).cast("timestamp")).alias("_second"))
    before = with_previous(timed, key, "_second", "_second", "_previous", span)
    starts = F.coalesce(F.col("_second") - F.col("_previous") > seconds, F.col("_second").isNotNull())
    numbered = running_sum(before, key, "_second", starts.cast("long"), "session", span)
    return numbered.groupBy(key, "session").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("uses"))
