"""A reader's memory of recent items, which a page turn clears.

Events of a reader are of two kinds: a poll tells what is visible (`seen`, an array), and a
visit names an `item`.  A visit to a remembered item changes nothing but which item is the
active one; another one comes in and, if there are too many, the one that came in first
goes.  A poll that shares nothing with the poll before, both of them seeing something, is a
page turn: nothing is remembered or active any more.

So turns cut a reader's events into epochs that do not depend on each other, and those are
what is spread over the cluster: a reader with a third of all events is as many groups as
there were turns.  `streamed` does the same over a stream, with the state carried on.

Rows with a null reader or order are events of the null reader, or come first.  A row with
both `seen` and `item` is a poll first.  Repeated rows change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leafmark import profiles
from leafmark.operators import windows


def epochs(events: DataFrame, key: str, order: str, seen: str, span: int = 4096) -> DataFrame:
    """`events` with `epoch`: how many page turns the key has had, this row's included."""
    polls = windows.page_turns(events.where(F.col(seen).isNotNull()), key, order, seen, span)
    visits = events.where(F.col(seen).isNull()).withColumn("turned", F.lit(False))
    return windows.running_sum(polls.unionByName(visits), key, order, F.col("turned").cast("long"), "epoch", span).drop("turned")


def remembered(events: DataFrame, key: str, order: str, seen: str, item: str, most: int = profiles.RECENT, span: int = 4096) -> DataFrame:
    """(key, epoch, item, order, active, current): what was remembered when each epoch ended,
    since when, which item was the active one, and whether the epoch still lasts."""
    cut = epochs(events, key, order, seen, span).withColumn("_k", F.struct(F.col(key).alias("key"), "epoch"))
    visits = cut.where(F.col(item).isNotNull())
    held = windows.recent(visits, "_k", order, item, most)
    last = visits.groupBy("_k").agg(F.max_by(item, order).alias("_last"))
    newest = cut.groupBy(key).agg(F.max("epoch").alias("_newest")).withColumnRenamed(key, "_key")
    found = held.join(last, "_k").select(F.col("_k.key").alias(key), F.col("_k.epoch").alias("epoch"), item, order, F.col(item).eqNullSafe(F.col("_last")).alias("active"))
    return found.join(newest, found[key].eqNullSafe(F.col("_key"))).withColumn("current", F.col("epoch") == F.col("_newest")).drop("_key", "_newest")


class Memory(StatefulProcessor):
    """The memory of one reader, carried from batch to batch."""

    def __init__(self, order: str, seen: str, item: str, most: int):
        self.order, self.seen, self.item, self.most = order, seen, item, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("memory", "visible array<string>, items array<string>, since array<bigint>, active string, epoch bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        visible, items, since, active, epoch = self.state.get() if self.state.exists() else ([], [], [], None, 0)
        visible, held, since = list(visible), list(items), list(since)
        events = pd.concat(rows).sort_values(self.order, kind="stable")
        for order, seen, item in zip(events[self.order], events[self.seen], events[self.item], strict=True):
            if seen is not None:
                seen = list(seen)
                if visible and seen and not set(visible) & set(seen):
                    held, since, active, epoch = [], [], None, epoch + 1
                visible = seen
            if item is not None:
                active = item
                if item not in held:
                    held, since = [*held, item][-self.most :], [*since, int(order)][-self.most :]
        self.state.update((visible, held, since, active, epoch))
        yield pd.DataFrame({"key": [key[0]], "epoch": [epoch], "items": [held], "since": [since], "active": [active]})

    def close(self) -> None:
        pass


def streamed(events: DataFrame, key: str, order: str, seen: str, item: str, most: int = profiles.RECENT) -> DataFrame:
    """A stream of (key, epoch, items, since, active): what each reader remembers after each
    batch that brings events of it.  The session must use the RocksDB state store.  A batch
    has to be ordered after the one before; within it the order column counts."""
    out = T.StructType.fromDDL("key string, epoch bigint, items array<string>, since array<bigint>, active string")
    cast = events.select(F.col(key).cast("string").alias(key), F.col(order).cast("long").alias(order), F.col(seen).cast("array<string>").alias(seen), F.col(item).cast("string").alias(item))
    return cast.groupBy(key).transformWithStateInPandas(Memory(order, seen, item, most), out, "Update", "None")
