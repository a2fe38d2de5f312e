"""Predicates over hierarchical records."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_match(column: Column, pattern: str, use_regex: bool = False) -> Column:
    """Case-insensitive regex search, or substring; an invalid regex is taken as a substring."""
    if use_regex:
        try:
            re.compile(pattern)
            return F.coalesce(column.rlike(f"(?i){pattern}"), F.lit(False))
        except re.error:
            pass
    return F.coalesce(F.contains(F.lower(column), F.lit(pattern.lower())), F.lit(False))


def name_match(name: Column, qualified: Column, pattern: str, use_regex: bool = False) -> Column:
    """Matches the qualified name if the pattern has a dot and isn't a regex."""
    return text_match(F.lower(qualified if "." in pattern and not use_regex else name), pattern, use_regex)


def matches_self_parent_or_child(nodes: DataFrame, predicate: Column) -> DataFrame:
    """Nodes that match, or whose parent or any child does: two semi-joins on ids, no fan-out."""
    hit = nodes.where(predicate)
    own = nodes.withColumn("__own", F.coalesce(predicate, F.lit(False)))
    parents = hit.select(F.col("id").alias("__p")).distinct()
    with_child = hit.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("__c")).distinct()
    out = own.join(parents, F.col("parent_id") == F.col("__p"), "left").join(with_child, F.col("id") == F.col("__c"), "left")
    return out.where(F.col("__own") | F.col("__p").isNotNull() | F.col("__c").isNotNull()).drop("__own", "__p", "__c")


def matches_self_or_child(nodes: DataFrame, predicate: Column) -> DataFrame:
    """Nodes that match, or any child of which does."""
    parents = nodes.where(predicate & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("__c")).distinct()
    out = nodes.withColumn("__own", F.coalesce(predicate, F.lit(False))).join(parents, F.col("id") == F.col("__c"), "left")
    return out.where(F.col("__own") | F.col("__c").isNotNull()).drop("__own", "__c")


def in_container(nodes: DataFrame, pattern: str, use_regex: bool = False) -> DataFrame:
    """Nodes whose container's name matches; a root is its own container, a node without a known container never matches."""
    names = nodes.select(F.col("id").alias("__p"), F.col("name").alias("__container")).dropDuplicates(["__p"])
    both = nodes.join(names, F.col("parent_id") == F.col("__p"), "left")
    container = F.when(F.col("parent_id").isNull(), F.col("name")).otherwise(F.col("__container"))
    return both.where(text_match(container, pattern, use_regex)).drop("__p", "__container")


def any_of(column: Column, allowed: list[str]) -> Column:
    """Empty means all."""
    return column.isin(allowed) if allowed else F.lit(True)


def conjunction(*predicates: Column | None) -> Column:
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def ignored(objects: DataFrame, rules: DataFrame, name: str, kind: str) -> DataFrame:
    """Objects that no rule (pattern, is_regex, types) covers; rules are a short, user-kept list."""
    covers = F.when(F.col("is_regex"), F.expr(f"`{name}` RLIKE pattern")).otherwise(F.col(name) == F.col("pattern"))
    types = (F.size("types") == 0) | F.array_contains("types", F.col(kind))
    return objects.join(rules, covers & types, "left_anti")


def ignore_lists(*lists: DataFrame | None) -> DataFrame:
    """The union of the lists that are given (built in, of the project, of the connection), each rule once."""
    return reduce(DataFrame.unionByName, [x for x in lists if x is not None]).dropDuplicates()


def pick_connection(connections: DataFrame, dialect: str, name: str) -> DataFrame:
    """The first connection, in list order, of this dialect and name."""
    return connections.where((F.col("dialect") == dialect) & (F.col("name") == name)).orderBy("position").limit(1)


def not_blank(*names: Column) -> Column:
    """Neither null nor only white space."""
    return conjunction(*[F.coalesce(F.length(F.trim(n)) > 0, F.lit(False)) for n in names])


def is_outline(action: Column, length: Column) -> Column:
    return action.isNotNull() & (length >= 0)


def starts_in(path: Column, directories: list[str]) -> Column:
    """First path segment is one of the known directories."""
    return F.split(path, "/")[0].isin(directories)


def is_schema_file(path: Column, directory: str) -> Column:
    parts = F.split(path, "/")
    return (F.size(parts) == 3) & (parts[0] == directory) & path.endswith(".sql")


def complete(candidates: DataFrame, typed: str, types: list[str]) -> DataFrame:
    """Completion list: allowed types whose name contains what was typed, prefixes first."""
    at = F.instr(F.upper("name"), typed.upper())
    return candidates.where(any_of(F.col("type"), types) & (at > 0)).withColumn("at", at).orderBy(F.col("at") > 1, "name")


def insert_unless_present(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New entries equal to an existing one are rejected, the others prepended."""
    return new.join(existing, existing.columns, "left_anti").unionByName(existing)


def danger_gate(statements: DataFrame, allowed: list[str]) -> DataFrame:
    """Statements of a kind that isn't allowed; the script may run if there are none."""
    kind = (
        F.when(F.col("sql").rlike(r"(?i)^\s*drop\s+table"), "DROP TABLE").when(F.col("sql").rlike(r"(?i)^\s*alter\b.*\bdrop\s+column"), "DROP COLUMN")
        .when(F.col("sql").rlike(r"(?i)^\s*alter\b.*\brestart\b"), "RESTART").when(F.col("sql").rlike(r"(?i)^\s*update\b"), "UPDATE")
        .when(F.col("sql").rlike(r"(?i)^\s*alter\b.*\btype\b"), "ALTER COLUMN").when(F.col("sql").rlike(r"(?i)^\s*alter\b"), "ALTER")
    )
    return statements.withColumn("danger", kind).where(F.col("danger").isNotNull() & ~F.col("danger").isin(allowed or [""]))
