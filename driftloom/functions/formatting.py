"""Rendering of values and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def render(value: Column, kind: T.DataType) -> Column:
    """NULL for null, [a, b] for arrays, {k=v} for maps, recursively."""
    if isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: render(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(value), lambda e: F.concat(render(e["key"], kind.keyType), F.lit("="), render(e["value"], kind.valueType)))
        text = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def cell(value: Column, kind: T.DataType) -> Column:
    """A result grid's cell: its own mark for null."""
    return F.when(value.isNull(), "<NULL>").otherwise(render(value, kind))


def quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(value.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))


def csv_value(value: Column) -> Column:
    return F.when(value.isNull(), "NULL").otherwise(quoted(value))


def csv_line(*values: Column) -> Column:
    return F.concat_ws(",", *[csv_value(v) for v in values])


def preview(query: Column, length: int = 60) -> Column:
    """One line, cut with a mark."""
    flat = F.trim(F.regexp_replace(query, r"[ \t\n\x0B\f\r]+", " "))
    return F.when(F.length(flat) > length, F.concat(F.substring(flat, 1, length), F.lit(" <...> "))).otherwise(flat)


def user_label(user: Column, changed: Column) -> Column:
    return F.concat(F.when(changed, "*").otherwise(""), F.coalesce(user, F.lit("")))


def selection_pattern(names: Column) -> Column:
    """^name$ alternatives of an array of names, with metacharacters quoted."""
    quote = lambda n: F.when(n.rlike(r"[\\^$.|?*+()\[\]{}]"), F.concat(F.lit("\\Q"), n, F.lit("\\E"))).otherwise(n)
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("^"), quote(n), F.lit("$"))), "|")


#: URL forms of the three dialects.
URLS = {"PG": "jdbc:postgresql://%s:%d/%s", "MS": "jdbc:sqlserver://%s:%d;databaseName=%s", "CH": "jdbc:clickhouse://%s:%d/%s"}


def connection_url(dialect: str, host: Column, port: Column, database: Column) -> Column:
    if dialect == "MS":
        database = F.when(F.contains(database, F.lit("}")), database).otherwise(F.concat(F.lit("{"), database, F.lit("}")))
    return F.format_string(URLS[dialect], host, port, database)


def sanitise(name: Column) -> Column:
    return F.regexp_replace(name, r"\s", "-")


#: Label prefixes of graph nodes.
PREFIXES = {"TABLE": "TBL", "VIEW": "VIEW", "FOREIGN_KEY": "FK", "FUNCTION": "FUNC", "SEQUENCE": "SEQ", "INDEX": "IDX", "TRIGGER": "TRG"}


def node_label(kind: Column, name: Column) -> Column:
    prefix = F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])[kind]
    return F.concat_ws(" ", F.coalesce(prefix, kind), name)


def fill_placeholders(command: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        command = F.replace(command, F.lit(f"%{name}%"), value)
    return command


def outline_label(action: Column, name: Column) -> Column:
    return F.concat_ws(" ", action, name)


def entries(properties: DataFrame, key: str, column: str) -> DataFrame:
    """A map column as (key, name, value) rows."""
    return properties.select(key, F.explode(column).alias("name", "value"))
