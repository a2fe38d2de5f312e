"""Scripts of statements run on the session, and query templates."""

from __future__ import annotations

import re
from string import Template

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

_PIECE = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/|\$(\w*)\$.*?\$\1\$|;|[^;'\"$/-]+|.", re.S)

_LEAD = re.compile(r"(?:\s+|--[^\n]*(?:\n|$)|/\*.*?\*/)*", re.S)


def split_script(script: str) -> list[tuple[int, str]]:
    """(offset, statement) at semicolons outside quotes, comments and dollar quotes; leading comments are left out."""
    out, start = [], 0
    for m in _PIECE.finditer(script):
        if m[0] == ";":
            out.append((start, script[start : m.start()]))
            start = m.end()
    out.append((start, script[start:]))
    skip = [len(_LEAD.match(s)[0]) for _, s in out]
    return [(a + n, s[n:].rstrip()) for (a, s), n in zip(out, skip, strict=True) if s[n:].strip()]


def run_script(spark: SparkSession, script: str) -> DataFrame | None:
    """Runs all statements; the last one's result."""
    result = None
    for _, sql in split_script(script):
        result = spark.sql(sql)
    return result


#: Query templates.
TEMPLATES = {
    "select": "SELECT ${columns} FROM ${table}",
    "insert": "INSERT INTO ${table} (${columns}) VALUES (${values})",
    "update": "UPDATE ${table} SET ${column} = ${value} WHERE ${condition}",
    "delete": "DELETE FROM ${table} WHERE ${condition}",
    "group": "SELECT ${column}, count(*) AS n FROM ${table} GROUP BY ${column}",
    "order": "SELECT ${columns} FROM ${table} ORDER BY ${column}",
    "case": "CASE WHEN ${condition} THEN ${value} ELSE ${other} END",
}


def fill(template: str, **values: str) -> str:
    return Template(TEMPLATES.get(template, template)).safe_substitute(values)


#: Where a template fits: a whole statement or a part of one.
CONTEXTS = {"case": "expression"}


def templates_for(typed: str, context: str | None = None) -> list[str]:
    """Names that contain what was typed and fit the context, if one is given; a leading < is left out."""
    return [n for n in TEMPLATES if typed.lower().lstrip("<") in n and context in (None, CONTEXTS.get(n, "statement"))]


def too_long_to_parse(script: str, limit: int) -> bool:
    """0 means no limit."""
    return 0 < limit < script.count("\n") + 1


def run_batches(spark: SparkSession, script: str, stop: bool = True) -> list[tuple[int, str, str | None]]:
    """(offset, statement, error) of what was run; the first failure ends the run unless ``stop`` is off."""
    report = []
    for at, sql in split_script(script):
        error = None
        try:
            spark.sql(sql)
        except PySparkException as e:
            error = e.getCondition() or type(e).__name__
        report.append((at, sql, error))
        if error and stop:
            break
    return report
