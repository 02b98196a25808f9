"""Models that are unloaded when nobody used them for a while, as a stream with timers.

The first use of a key loads it.  Each use sets its timer anew; when the watermark passes
the last use by more than the time to idle, the key is unloaded and the stretch of use is
told.  A use after that loads it again, also one that arrives late but is not yet behind the
watermark.  On uses that arrive in order this tells what `windows.idle_sessions` finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leafmark import profiles

_OUT = "key string, load bigint, start bigint, end bigint, uses bigint"


class Loaded(StatefulProcessor):
    """Whether a key is loaded, since when, and how often it was used; times in milliseconds."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.use = handle.getValueState("use", "load bigint, start bigint, last bigint, uses bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        load, start, last, uses = self.use.get() if self.use.exists() else (0, None, None, 0)
        told = []
        for at in sorted(int(x) for part in rows if len(part) for x in part["ms"]):
            if uses and at - last > self.idle:
                told.append((key[0], load, start, last, uses))
                uses = 0
            if not uses:
                load, start, last = load + 1, at, at
            start, last, uses = min(start, at), max(last, at), uses + 1
        if uses:
            self._wake(last + self.idle + 1)
            self.use.update((load, start, last, uses))
        yield self._rows(told)

    def _wake(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        told = []
        if self.use.exists():
            load, start, last, uses = self.use.get()
            if uses and expiredTimerInfo.getExpiryTimeInMs() > last + self.idle:
                told.append((key[0], load, start, last, uses))
                self.use.update((load, start, last, 0))
        yield self._rows(told)

    @staticmethod
    def _rows(told: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(told, columns=["key", "load", "start", "end", "uses"])

    def close(self) -> None:
        pass


def unloaded(uses: DataFrame, key: str, at: str, seconds: int = profiles.IDLE_SECONDS, late: str = "0 seconds") -> DataFrame:
    """A stream of (key, load, start, end, uses): each stretch of use, told when its key is
    unloaded; times in milliseconds, `load` counts the key's loads.  Uses more than `late`
    behind the newest are dropped.  The session must use the RocksDB state store."""
    marked = uses.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", late)
    grouped = marked.withColumn("ms", F.unix_millis("at")).groupBy("key")
    return grouped.transformWithStateInPandas(Loaded(1000 * seconds), T.StructType.fromDDL(_OUT), "Append", "EventTime")
