"""Functions that mean something else in other SQL dialects than in Spark, under that meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pg_log(x: Column) -> Column:
    """Base 10; raises for values that aren't positive."""
    return F.log10(_positive(x, "log"))


def pg_ln(x: Column) -> Column:
    return F.ln(_positive(x, "ln"))


def _positive(x: Column, name: str) -> Column:
    return F.when(x > 0, x).when(x.isNull(), x).otherwise(F.raise_error(F.lit(f"{name} of a number that is not positive")).cast("double"))


def pg_sqrt(x: Column) -> Column:
    return F.sqrt(F.when((x >= 0) | x.isNull(), x).otherwise(F.raise_error(F.lit("sqrt of a negative number")).cast("double")))


def pg_concat(*xs: Column) -> Column:
    """Nulls are skipped."""
    return F.concat_ws("", *xs)


def pg_trunc(x: Column) -> Column:
    """Toward zero."""
    return F.sign(x) * F.floor(F.abs(x))


def pg_initcap(x: Column) -> Column:
    """A letter after anything but a letter or digit is a capital."""
    runs = F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))), "")


def pg_regexp_replace(x: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """The first match, or all with flag g; groups are written \\1."""
    import re

    java = re.sub(r"\\(\d)", r"$\1", replacement.replace("$", "\\$"))
    pattern = f"(?i){pattern}" if "i" in flags else pattern
    if "g" in flags:
        return F.regexp_replace(x, pattern, java)
    hidden = len(re.findall(r"(?<!\\)\((?!\?)", pattern))
    shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", java)
    return F.regexp_replace(x, f"(?s)^(.*?){pattern}(.*)$", f"$1{shifted}${hidden + 2}")


def pg_dow(x: Column) -> Column:
    """0 for Sunday to 6."""
    return F.dayofweek(x) - 1


def pg_chr(n: Column) -> Column:
    """Any code point."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def pg_encode(x: Column, how: str) -> Column:
    return F.base64(x) if how == "base64" else F.lower(F.hex(x))


def pg_decode(x: Column, how: str) -> Column:
    return F.unbase64(x) if how == "base64" else F.unhex(x)


def pg_array_agg(x: Column) -> Column:
    """Nulls are kept."""
    return F.transform(F.collect_list(F.struct(x.alias("x"))), lambda s: s["x"])


def pg_array_prepend(element: Column, array: Column) -> Column:
    return F.array_prepend(array, element)


def pg_substr(x: Column, start: Column, length: Column) -> Column:
    """Places before the first are empty, not counted from the end."""
    end = start + length
    first = F.greatest(start, F.lit(1))
    return F.substr(x, first, F.greatest(F.lit(0), end - first))


def pg_sum(x: Column) -> Column:
    return F.sum(x.cast("decimal(38,0)"))


def pg_avg(x: Column) -> Column:
    return F.avg(x.cast("decimal(38,10)"))


def pg_div(a: Column, b: Column) -> Column:
    """Integers divide to integers, toward zero."""
    return F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("bigint")).otherwise(pg_trunc(a / b).cast("bigint"))


def nulls_last(x: Column, descending: bool = False) -> Column:
    """The dialect's default: nulls are the largest."""
    return x.desc_nulls_first() if descending else x.asc_nulls_last()
