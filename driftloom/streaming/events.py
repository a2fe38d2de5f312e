"""Event counters, debouncing and expiry, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days after which a counter expires.
TTL_DAYS = 132
DEBOUNCE_MS = 500


def last_per_key(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The value of each key's latest event: one partial aggregation, no sort."""
    return events.groupBy(key).agg(F.max_by(F.col(value), F.struct(*order)).alias(f"last_{value}"))


def daily_counts(events: DataFrame, keys: list[str], time: str = "ts") -> DataFrame:
    return events.groupBy(*keys, F.to_date(time).alias("day")).agg(F.count("*").alias("n"))


def current_counters(events: DataFrame, keys: list[str], time: str = "ts") -> DataFrame:
    """Counters reset on each new day: those of each key's latest day."""
    return daily_counts(events, keys, time).groupBy(*keys).agg(F.max(F.struct("day", "n")).alias("x")).select(*keys, "x.day", "x.n")


def rollover(events: DataFrame, value: str, time: str = "ts") -> DataFrame:
    """Each day's sum, sent only if positive."""
    return events.groupBy(F.to_date(time).alias("day")).agg(F.sum(value).alias("total")).where("total > 0")


def unexpired(events: DataFrame, now: Column, days: int = TTL_DAYS, time: str = "ts") -> DataFrame:
    return events.where(F.col(time) >= now - F.make_interval(days=F.lit(days)))


def debounce(events: DataFrame, key: str, gap_ms: int = DEBOUNCE_MS, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last event of each burst: no other follows within the gap."""
    after = F.lead(time).over(Window.partitionBy(key).orderBy(time, tie))
    quiet = (F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))) >= gap_ms * 1000
    return events.where(F.col(time).isNotNull()).withColumn("__q", F.coalesce(quiet, F.lit(True))).where("__q").drop("__q")


def debounce_stream(stream: DataFrame, key: str, value: str, gap_ms: int = DEBOUNCE_MS, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """The same over a stream: session windows close when the watermark passes the gap."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, f"{gap_ms} milliseconds"), key).agg(F.max_by(value, time).alias(value))


def daily_counts_stream(stream: DataFrame, keys: list[str], late: str = f"{TTL_DAYS} days", time: str = "ts") -> DataFrame:
    """Counts by tumbling day; the watermark is the counters' time to live."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day"), *keys).agg(F.count("*").alias("n"))


def tumbling(events: DataFrame, width: str, keys: list[str], time: str = "ts") -> DataFrame:
    return events.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def distinct_types(events: DataFrame) -> DataFrame:
    """Types are equal by component and action, whatever their version."""
    return events.dropDuplicates(["component", "action"])


def status_flags(changes: DataFrame, path: str, kind: str, changed: list[str], untracked: str) -> DataFrame:
    """Per path whether it changed and whether it is untracked; untracked paths count as changed."""
    flag = F.col(kind).isin([*changed, untracked])
    return changes.groupBy(path).agg(F.bool_or(flag).alias("changed"), F.bool_or(F.col(kind) == untracked).alias("untracked"))
