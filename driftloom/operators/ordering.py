"""Sort stacks, ranks and recency lists."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclasses.dataclass
class SortStack:
    """The column chosen last is the first key; choosing it again flips it, an older one moves up ascending."""

    keys: list[tuple[str, bool]] = dataclasses.field(default_factory=list)

    def choose(self, column: str) -> SortStack:
        if self.keys and self.keys[0][0] == column:
            return SortStack([(column, not self.keys[0][1]), *self.keys[1:]])
        return SortStack([(column, False), *(k for k in self.keys if k[0] != column)])

    def columns(self, true_first: tuple[str, ...] = ()) -> list[Column]:
        """Missing values come first ascending; boolean keys in ``true_first`` put true first."""
        return [F.col(c).desc_nulls_last() if desc != (c in true_first) else F.col(c).asc_nulls_first() for c, desc in self.keys]

    def sort(self, df: DataFrame, true_first: tuple[str, ...] = ()) -> DataFrame:
        return df.orderBy(*self.columns(true_first))


def ranked(ordered: DataFrame, name: str = "position") -> DataFrame:
    """All rows of an ordered DataFrame with their place from 1 on, numbered in each partition and shifted by those before."""
    spark = ordered.sparkSession
    kept = ordered.withColumn("__at", F.monotonically_increasing_id()).persist()  # numbers and sizes must be of one run
    sizes = kept.groupBy(F.shiftright("__at", 33).alias("p")).count().orderBy("p").collect()
    rows, before = [], 0
    for r in sizes:
        rows.append((r["p"], before))
        before += r["count"]
    shift = F.broadcast(spark.createDataFrame(rows, "__p long, __before long"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(shift, F.shiftright("__at", 33) == F.col("__p")).withColumn(name, inside + F.col("__before") + 1).drop("__at", "__p", "__before")


def default_stack() -> SortStack:
    out = SortStack()
    for c in ("name", "change", "type", "location"):
        out = out.choose(c)
    return out


def most_recent(events: DataFrame, entry: str, time: str, most: int) -> DataFrame:
    """Entries by latest use, at most ``most``: partial aggregation, then a top-n without a full sort."""
    return events.groupBy(entry).agg(F.max(time).alias("last_used")).orderBy(F.desc("last_used"), entry).limit(most)


def newest_per_group(df: DataFrame, group: str, order: Column, most: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("__r") <= most).drop("__r")


def rank_of(kind: Column) -> Column:
    """SCHEMA, TABLE, VIEW, then the rest."""
    return F.when(kind == "SCHEMA", 0).when(kind == "TABLE", 1).when(kind == "VIEW", 2).otherwise(3)


def group_lists(df: DataFrame, group: str, position: str, value: str) -> DataFrame:
    """Values per group in order of position."""
    lists = F.sort_array(F.collect_list(F.struct(position, value)))
    return df.groupBy(group).agg(F.transform(lists, lambda x: x[value]).alias("values"))


def group_flatten_order(df: DataFrame, group: str, position: str) -> DataFrame:
    """Contiguous groups in order of first appearance; ``group_pos`` is the group's first position."""
    first = df.groupBy(group).agg(F.min(position).alias("group_pos"))
    return df.join(first, group)


def by_directory(df: DataFrame, is_dir: Column, *path: str) -> DataFrame:
    """Directories first, then by path."""
    return df.orderBy(is_dir.desc(), *path)
