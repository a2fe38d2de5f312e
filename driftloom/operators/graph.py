"""Dependency closure and ordering over edge tables (src, dst)."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def closure(edges: DataFrame, roots: DataFrame, depth: int | None = 10, reverse: bool = False) -> DataFrame:
    """(id, depth) reachable from the roots within ``depth`` steps (None: until nothing new is found), with the smallest depth.

    Breadth-first: a step joins only the newest nodes with the edges, and nodes already reached drop out.
    """
    src, dst = ("dst", "src") if reverse else ("src", "dst")
    edges = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct()
    seen = new = roots.select("id").distinct().withColumn("depth", F.lit(0))
    for step in itertools.count(1) if depth is None else range(1, depth + 1):
        new = new.join(edges, F.col("id") == F.col("s")).select(F.col("d").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(step))
        new = cut(new)
        if not new.limit(1).count():
            break
        seen = seen.unionByName(new)
    return seen


def closure_sql(table: str, roots: str, depth: int = 10) -> str:
    """The same as a recursive query, for graphs where paths are few."""
    return f"""WITH RECURSIVE r(id, depth) AS (SELECT id, 0 FROM {roots} UNION ALL SELECT e.dst, r.depth + 1 FROM r JOIN {table} e ON e.src = r.id WHERE r.depth < {depth})
SELECT id, min(depth) AS depth FROM r GROUP BY id"""


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst").distinct()


def required_by_selection(edges: DataFrame, selected: DataFrame, depth: int | None = None) -> DataFrame:
    """What the selection depends on and doesn't contain."""
    return closure(edges, selected, depth).join(selected.select("id"), "id", "left_anti")


def layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, layer): a node's layer is above those it depends on (src depends on dst); cycles have no layer."""
    left = cut(nodes.select("id").distinct())
    rest, out = cut(edges.select("src", "dst").distinct()), None
    for layer in itertools.count():
        free = left.join(rest.select(F.col("src").alias("id")), "id", "left_anti")
        free = cut(free)
        if not free.limit(1).count():
            break
        done = free.withColumn("layer", F.lit(layer))
        out = done if out is None else out.unionByName(done)
        left = cut(left.join(free, "id", "left_anti"))
        rest = cut(rest.join(free.select(F.col("id").alias("dst")), "dst", "left_anti"))
    return out if out is not None else left.withColumn("layer", F.lit(0)).limit(0)


def propagate_down(nodes: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """All descendants of the roots over parent_id, the roots included."""
    return closure(nodes.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("id").alias("dst")), roots, depth)


def dependants_on_side(edges: DataFrame, roots: DataFrame, side: DataFrame, depth: int | None = None) -> DataFrame:
    """What depends on the roots, themselves left out, as far as it exists on the chosen side."""
    return closure(edges, roots, depth).where("depth > 0").select("id").join(side.select("id").distinct(), "id", "left_semi")


def unselected_dependents(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """Nodes (id, parent_id, side, selected) to warn of: unselected ones being deleted under a selected parent, or being created above a selected node."""
    chosen, rest = nodes.where("selected").select(F.col("id").alias("c")), nodes.where("NOT selected")
    edges = nodes.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"))
    above = closure(edges, chosen.select(F.col("c").alias("id")), depth, reverse=True).where("depth > 0").select(F.col("id").alias("c"))
    deleted = rest.where("side = 'LEFT'").join(chosen, F.col("parent_id") == F.col("c"), "left_semi")
    created = rest.where("side = 'RIGHT'").join(above, F.col("id") == F.col("c"), "left_semi")
    return deleted.unionByName(created).select("id", "side")


def lines(edges: DataFrame) -> DataFrame:
    """Each edge once, as a line of text."""
    return edges.select(F.concat_ws(" -> ", "src", "dst").alias("line")).distinct()
