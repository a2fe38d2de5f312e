"""Keyed index maintenance, range lookups and positional rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(index: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All of a key's rows are replaced by the new ones."""
    return index.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(index: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return index.join(keys.select(key).distinct(), key, "left_anti")


def incremental(index: DataFrame, changed: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Removed keys go, changed keys' rows are replaced."""
    return upsert(delete(index, removed, key), changed, key)


def range_join(points: DataFrame, ranges: DataFrame, group: str, point: str, start: str, length: str, width: int = 64) -> DataFrame:
    """Points with the ranges of their group that hold them (start <= point < start + length).

    Both sides are bucketed by ``width``, so this is an equi-join on (group, bucket): a range stands in each bucket it
    touches, a point in one, so no match is found twice.
    """
    last = F.greatest(F.col(start), F.col(start) + F.col(length) - 1)
    r = ranges.where(F.col(length) > 0).withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))
    p = points.withColumn("__b", F.floor(F.col(point) / width))
    return p.join(r, [group, "__b"]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(start) + F.col(length))).drop("__b")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def rewrite(texts: DataFrame, edits: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replaces [offset, offset + length) by new_text for each edit of a key; edits of a key must not overlap.

    The pieces between the edits are taken from the original, so the order of application doesn't matter.
    """
    own = edits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("offset", "length", "new_text"))).alias("__e"))
    body = F.aggregate(
        "__e",
        F.struct(F.lit("").alias("s"), F.lit(0).cast("long").alias("at")),
        lambda a, e: F.struct(F.concat(a["s"], F.substr(F.col(text), (a["at"] + 1).cast("int"), (e["offset"] - a["at"]).cast("int")), e["new_text"]).alias("s"), (e["offset"] + e["length"]).cast("long").alias("at")),
    )
    done = F.concat(body["s"], F.substr(F.col(text), (body["at"] + 1).cast("int")))
    return texts.join(own, key, "left").withColumn(text, F.when(F.col("__e").isNotNull(), done).otherwise(F.col(text))).drop("__e")


def nth_line(text: Column, n: int) -> Column:
    """Line n, from 0; null beyond the end."""
    return F.get(F.split(text, "\n"), F.lit(n))


def result_tree(matches: DataFrame, path: str) -> DataFrame:
    """(parent, children): every match under each of its ancestors, without repeats."""
    parts = F.split(path, "/")
    pairs = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("parent"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("child")))
    return matches.select(F.explode(pairs).alias("p")).select("p.parent", "p.child").distinct()


def unchanged(snapshot: DataFrame, current: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Keys whose text differs from the snapshot: an update must be given up if there are any."""
    digest = lambda df, n: df.select(key, F.sha2(F.col(text), 256).alias(n))
    return digest(snapshot, "a").join(digest(current, "b"), key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(key)


def first_range(points: DataFrame, ranges: DataFrame, group: str, point: str, start: str, length: str, keys: list[str], width: int = 64) -> DataFrame:
    """For each point (named by ``keys``) the start of the first range that holds it; points in none are left out."""
    return range_join(points, ranges, group, point, start, length, width).groupBy(*keys).agg(F.min(start).alias(start))


def lookup(index: DataFrame, keys: DataFrame, key: str, value: str) -> DataFrame:
    """Each key with its sorted values, an empty list where the index has none."""
    lists = index.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"))
    empty = F.array().cast(lists.schema["values"].dataType)
    return keys.select(key).distinct().join(lists, key, "left").withColumn("values", F.coalesce("values", empty))
