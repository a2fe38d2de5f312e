"""Two-sided snapshot diff, change labels and set logic over object trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEFT, RIGHT, BOTH = "LEFT", "RIGHT", "BOTH"


def two_sided_diff(left: DataFrame, right: DataFrame, keys: list[str], edits_only: bool = True) -> DataFrame:
    """Keys, ``side``, and each other column as ``<name>_left`` and ``<name>_right``; one shuffle per side on the keys.

    ``edits_only`` drops the pairs that are equal in all other columns (null equals null).
    """
    values = [c for c in left.columns if c not in keys]
    mark = lambda df, s: df.select(*[F.col(k) for k in keys], *[F.col(c).alias(f"{c}_{s}") for c in values], F.lit(True).alias(f"in_{s}"))
    both = mark(left, "left").join(mark(right, "right"), keys, "full_outer")
    side = F.when(F.col("in_right").isNull(), LEFT).when(F.col("in_left").isNull(), RIGHT).otherwise(BOTH)
    out = both.withColumn("side", side)
    if edits_only:
        differs = reduce(lambda a, b: a | b, [~F.col(f"{c}_left").eqNullSafe(F.col(f"{c}_right")) for c in values], F.lit(False))
        out = out.where((F.col("side") != BOTH) | differs)
    return out.select(*keys, "side", *[f"{c}_{s}" for c in values for s in ("left", "right")])


def change_label(side: Column, to_database: bool = False) -> Column:
    """What applying the change does to the project, or to the database."""
    names = {BOTH: "ALTER", LEFT: "CREATE", RIGHT: "DROP"} if to_database else {BOTH: "edit", LEFT: "delete", RIGHT: "add"}
    return reduce(lambda c, kv: c.when(side == kv[0], kv[1]), names.items(), F)


def apply_diff(left: DataFrame, diff: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` brought to the state of the right side: diffing the result again gives no rows."""
    values = [c for c in left.columns if c not in keys]
    kept = left.join(diff.select(*keys), keys, "left_anti")
    return kept.unionByName(diff.where(F.col("side") != LEFT).select(*keys, *[F.col(f"{c}_right").alias(c) for c in values]))


def changed_columns(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, column) for each differing value of the rows in both."""
    values = [c for c in left.columns if c not in keys]
    diff = two_sided_diff(left, right, keys).where(F.col("side") == BOTH)
    names = F.array_compact(F.array(*[F.when(~F.col(f"{c}_left").eqNullSafe(F.col(f"{c}_right")), F.lit(c)) for c in values]))
    return diff.select(*keys, F.explode(names).alias("column"))


def duplicates(objects: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several sources define, with their number."""
    return objects.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def promote_to_root(nodes: DataFrame) -> DataFrame:
    """Distinct roots: a sub-element stands for its parent."""
    return nodes.select(F.coalesce("parent_id", "id").alias("id")).distinct()


def children_in_input(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Children of the chosen nodes that were chosen too."""
    picked = chosen.select(F.col("id").alias("c"))
    return nodes.join(picked, F.col("id") == F.col("c"), "left_semi").join(picked, F.col("parent_id") == F.col("c"), "left_semi")


def expand_fragments(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen nodes with their children and the namesakes under the same parent."""
    ids = chosen.select(F.col("id").alias("c"))
    own = nodes.join(ids, F.col("id") == F.col("c"), "left_semi")
    children = nodes.join(ids, F.col("parent_id") == F.col("c"), "left_semi")
    names = own.select(F.col("parent_id").alias("p"), F.col("name").alias("m")).distinct()
    same = nodes.join(names, F.col("parent_id").eqNullSafe(F.col("p")) & (F.col("name") == F.col("m")), "left_semi")
    return own.unionByName(children).unionByName(same).dropDuplicates(["id"])


def tri_state(children: DataFrame, parent: str, checked: Column, parent_checked: Column | None = None) -> DataFrame:
    """Per parent: total, selected and gray (mixed children, or all alike but unlike the parent)."""
    agg = children.groupBy(parent).agg(F.count("*").alias("total"), F.count_if(checked).alias("selected"))
    mixed = (F.col("selected") > 0) & (F.col("selected") < F.col("total"))
    own = F.lit(None).cast("boolean") if parent_checked is None else parent_checked
    return agg.withColumn("gray", mixed | F.coalesce((F.col("selected") > 0) != own, F.lit(False)))


def by_path(elements: DataFrame, paths: DataFrame) -> DataFrame:
    """Elements with each changed path that they are written to; those of libraries or only on the right have none."""
    own = elements.where(F.col("library").isNull() & (F.col("side") != "RIGHT"))
    return own.join(paths.select("path").distinct(), "path")
