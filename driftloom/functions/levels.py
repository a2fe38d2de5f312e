"""Levels of database objects: which types stand at the top, in a schema, or inside a container."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The object types at each level of each dialect; all others are UNKNOWN.
LEVELS = {
    "PG": {
        "SCHEMA": "SCHEMA SERVER CAST EVENT_TRIGGER EXTENSION FOREIGN_DATA_WRAPPER USER_MAPPING",
        "CONTAINER": "AGGREGATE COLLATION DOMAIN FTS_CONFIGURATION FTS_DICTIONARY FTS_TEMPLATE FTS_PARSER OPERATOR TABLE VIEW FUNCTION PROCEDURE TYPE SEQUENCE STATISTICS",
        "SUB_ELEMENT": "INDEX CONSTRAINT RULE TRIGGER POLICY",
    },
    "MS": {
        "SCHEMA": "SCHEMA ROLE USER ASSEMBLY",
        "CONTAINER": "TABLE VIEW FUNCTION PROCEDURE TYPE SEQUENCE",
        "SUB_ELEMENT": "INDEX CONSTRAINT TRIGGER STATISTICS",
    },
    "CH": {
        "SCHEMA": "SCHEMA ROLE USER FUNCTION POLICY",
        "CONTAINER": "TABLE VIEW DICTIONARY",
        "SUB_ELEMENT": "INDEX CONSTRAINT",
    },
}

#: What a dangerous statement is called in a warning.
WARNINGS = {
    "ALTER COLUMN": "ALTER COLUMN ... TYPE statement",
    "DROP COLUMN": "DROP COLUMN statement",
    "DROP TABLE": "DROP TABLE statement",
    "RESTART": "ALTER SEQUENCE ... RESTART WITH statement",
    "UPDATE": "UPDATE statement",
}


def level_rows() -> list[tuple[str, str, str]]:
    return [(d, t, level) for d, levels in LEVELS.items() for level, types in levels.items() for t in types.split()]


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def object_level(dialect: Column, kind: Column) -> Column:
    """A literal map, so no join; null dialects or types are UNKNOWN."""
    return F.coalesce(_lookup({f"{d}.{t}": level for d, t, level in level_rows()}, F.concat(dialect, F.lit("."), kind)), F.lit("UNKNOWN"))


def types_at(spark: SparkSession, dialect: str, *levels: str) -> DataFrame:
    """(type, level) of the dialect at these levels, by name."""
    return spark.createDataFrame([(t, level) for d, t, level in level_rows() if d == dialect and level in levels], "type string, level string").orderBy("type")


def danger_text(danger: Column) -> Column:
    """Null for what has no warning."""
    return _lookup(WARNINGS, danger)
