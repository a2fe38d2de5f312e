"""Running streams: periodic and single-flight queries, changed files, idle caches."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

#: Hours between flushes of the counters, and seconds between looks at idle caches.
FLUSH_HOURS = 24
POLL_SECONDS = 30


def periodic(writer: DataStreamWriter, hours: int = FLUSH_HOURS) -> DataStreamWriter:
    return writer.trigger(processingTime=f"{hours} hours")


def changed_files(spark: SparkSession, path: str, pattern: str = "*.sql") -> DataFrame:
    """A stream of (path, text): each file below ``path`` that is new since the last batch."""
    found = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.selectExpr("_metadata.file_path AS path", "value AS text")


def single_flight(spark: SparkSession, name: str, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """The running query of this name is stopped before the new one starts, so that one runs at most."""
    for q in spark.streams.active:
        if q.name == name:
            q.stop()
    return start()


class IdleCache:
    """Cached DataFrames by key; those that nobody asked for within ``minutes`` are unpersisted by ``expire``."""

    def __init__(self, minutes: float) -> None:
        self.minutes, self._held, self._lock = minutes, {}, threading.Lock()

    def get(self, key: str, make: Callable[[], DataFrame], now: float) -> DataFrame:
        """``now`` in seconds; a missing entry is made and cached."""
        with self._lock:
            df = self._held[key][0] if key in self._held else make().cache()
            self._held[key] = (df, now)
            return df

    def invalidate(self, key: str) -> None:
        """After a write: the next reader makes the entry anew."""
        with self._lock:
            if key in self._held:
                self._held.pop(key)[0].unpersist()

    def expire(self, now: float) -> list[str]:
        """Keys that went; with 0 minutes or less nothing expires."""
        with self._lock:
            old = [k for k, (_, at) in self._held.items() if self.minutes > 0 and now - at >= 60 * self.minutes]
            for k in old:
                self._held.pop(k)[0].unpersist()
            return old
