"""Typed synthetic rows: column specs become expressions over ``spark.range``, without Python in the rows."""

from __future__ import annotations

import dataclasses
import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANDOM, INCREMENT, CONSTANT, ANY = "RANDOM", "INCREMENT", "CONSTANT", "ANY"
INT_MAX, LONG_MAX = 2**31 - 1, 2**63 - 1
DAY_US = 86_400_000_000
_EPOCH, _END = dt.datetime(1970, 1, 1), dt.datetime(2070, 1, 1)

#: Fixed values: (value family, start, end, step, SQL type) of each column type.
TYPES = {
    "bigint": ("integer", 0, LONG_MAX, 1, "bigint"),
    "bit": ("bit", "01", None, None, "string"),
    "bit_ms": ("integer", 0, 1, 1, "tinyint"),
    "boolean": ("boolean", True, None, None, "boolean"),
    "date": ("date", _EPOCH.date(), _END.date(), 1, "date"),
    "double": ("real", 0.0, 1000.0, 1.0, "double"),
    "integer": ("integer", 0, INT_MAX, 1, "int"),
    "json": ("json", '{"a": "b"}', None, None, "string"),
    "numeric": ("real", 0.0, 1000.0, 1.0, "double"),
    "real": ("real", 0.0, 1000.0, 1.0, "float"),
    "smallint": ("integer", 0, 32767, 1, "smallint"),
    "tinyint": ("integer", 0, 255, 1, "smallint"),
    "text": ("text", "text", None, None, "string"),
    "time": ("time", 0, 86_399_000_000, 1_000_000, "bigint"),
    "timestamp": ("timestamp", _EPOCH, _END, 1000, "timestamp_ntz"),
    "timestamptz": ("timestamptz", (_EPOCH - dt.timedelta(hours=1), "+01:00"), (_END - dt.timedelta(hours=1), "+01:00"), 1000, "struct<instant:timestamp_ntz,offset:string>"),
    "datetime2": ("timestamp", _EPOCH, _END, 1000, "timestamp_ntz"),
    "datetime": ("timestamp", _EPOCH, _END, 1000, "timestamp_ntz"),
    "other": ("custom", None, None, None, "string"),
}
WITHOUT_INCREMENT = {"bit", "bit_ms", "json", "text"}
#: Types on offer per dialect.
OFFERED = {
    "PG": ["bigint", "bit", "boolean", "date", "double", "integer", "json", "numeric", "real", "smallint", "text", "time", "timestamp", "timestamptz"],
    "MS": ["bigint", "bit_ms", "date", "datetime", "datetime2", "integer", "numeric", "real", "smallint", "text", "time", "tinyint"],
    "CH": ["boolean", "date", "integer", "json", "real", "text", "timestamp"],
}


def generators(kind: str) -> list[str]:
    if kind == "other":
        return [ANY]
    return [g for g in (RANDOM, INCREMENT, CONSTANT, ANY) if g != INCREMENT or kind not in WITHOUT_INCREMENT]


@dataclasses.dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str = "integer"
    generator: str | None = None
    start: object = None
    end: object = None
    step: object = None
    length: int = 255
    unique: bool = False
    not_null: bool = False
    any_text: str = "data"

    def __post_init__(self):
        family, start, end, step, _ = TYPES[self.kind]
        for name, default in (("start", start), ("end", end), ("step", step), ("generator", generators(self.kind)[0])):
            if getattr(self, name) is None:
                object.__setattr__(self, name, default)
        if self.generator not in generators(self.kind) and not self._null():
            raise ValueError(f"{self.kind} has no generator {self.generator}")

    def _null(self) -> bool:
        """INCREMENT isn't on offer for these types, but has a value where it is asked for: null."""
        return self.generator == INCREMENT and self.kind in ("bit", "json", "text")

    @property
    def family(self) -> str:
        return TYPES[self.kind][0]

    def retype(self, kind: str) -> ColumnSpec:
        """Another type; length, unique, not_null, name and text stay, and the generator if it is allowed."""
        keep = self.generator if self.generator in generators(kind) else None
        return ColumnSpec(self.name, kind, keep, length=self.length, unique=self.unique, not_null=self.not_null, any_text=self.any_text)

    def domain(self) -> int:
        """Number of different values; the timestamp's is in seconds."""
        f, a, b = self.family, self.start, self.end
        if f == "integer":
            return min(int(b) - int(a) + 1, INT_MAX)
        if f == "date":
            return min((b - a).days + 1, INT_MAX)
        if f == "time":
            return min((b - a) // 1000 + 1, INT_MAX)
        if f == "timestamp":
            return min(int((b - a).total_seconds()) + 1, INT_MAX)
        if f == "timestamptz":
            return min(int((b[0] - a[0]).total_seconds() * 1000) + 1, INT_MAX)
        if f in ("text", "json"):
            return min(26**self.length, INT_MAX) if self.length else 0
        return {"boolean": 2, "bit": min(2**self.length, INT_MAX) if self.length else 0, "real": INT_MAX, "custom": 1}[f]

    def _units(self) -> tuple[int, int] | None:
        """(number of values, scale) for families that are integers underneath."""
        f = self.family
        if f == "integer":
            return int(self.end) - int(self.start) + 1, 1
        if f == "date":
            return (self.end - self.start).days + 1, 1
        if f == "time":
            return (self.end - self.start) // 1000 + 1, 1000
        if f == "timestamp":
            return int((self.end - self.start).total_seconds() * 1000) + 1, 1
        if f == "timestamptz":
            return int((self.end[0] - self.start[0]).total_seconds() * 1000) + 1, 1
        return None

    def _from_offset(self, x: Column) -> Column:
        """The value at an offset (in the family's own unit) from the start."""
        f, sql = self.family, TYPES[self.kind][4]
        if f == "integer":
            wide = (F.lit(int(self.start)).cast("decimal(38,0)") + x).cast("decimal(38,0)")
            return wide if self.generator == INCREMENT else wide.cast(sql)
        if f == "date":
            return F.date_add(F.lit(self.start), x.cast("int"))
        if f == "time":
            return F.pmod(F.lit(int(self.start)) + x, F.lit(DAY_US))
        at = self.start[0] if f == "timestamptz" else self.start
        seconds = (x.cast("decimal(20,0)") / F.lit(1000)).cast("decimal(18,6)")
        moved = F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
        if f == "timestamptz":
            return F.struct(moved.alias("instant"), F.lit(self.start[1]).alias("offset"))
        return moved

    def column(self, i: Column, seed: int, rows: int) -> Column:
        """The expression of the value in row ``i``."""
        f, sql = self.family, TYPES[self.kind][4]
        if self.generator == ANY:
            return F.lit(self.any_text)
        if self.generator == CONSTANT:
            if f in ("text", "json", "bit", "boolean", "real"):
                return F.lit(self.start).cast(sql)
            return self._from_offset(F.lit(0))
        if self._null():
            return F.lit(None).cast(sql)
        if self.generator == INCREMENT:
            if f == "boolean":
                return F.when(i == 0, bool(self.start)).otherwise(not self.start)
            if f == "real":
                return (F.lit(float(self.start)) + i * float(self.step)).cast(sql)
            return self._from_offset(i.cast("decimal(38,0)") * int(self.step) if f == "integer" else i * int(self.step))
        value = self._random(i, seed, rows)
        if not self.unique and not self.not_null:
            value = F.when(F.rand(seed + 1) < 0.05, F.lit(None)).otherwise(value)
        return value

    def _random(self, i: Column, seed: int, rows: int) -> Column:
        f, sql, units = self.family, TYPES[self.kind][4], self._units()
        if units:
            n, scale = units
            if self.unique:  # a permutation of 0..n-1 instead of drawing again
                offset = permuted(i, n, seed)
            else:
                high, low = F.rand(seed), F.rand(seed + 7)
                wide = F.floor(high * float(min(n, 2**53))).cast("decimal(38,0)")
                if n > 2**53:  # two draws where one double is too coarse
                    wide = F.pmod(F.floor(high * float(2**32)).cast("decimal(38,0)") * F.lit(2**32).cast("decimal(38,0)") + F.floor(low * float(2**32)).cast("decimal(38,0)"), F.lit(n).cast("decimal(38,0)"))
                offset = wide
            return self._from_offset(offset if f == "integer" else offset.cast("bigint") * scale)
        if f == "real":
            u = (permuted(i, INT_MAX, seed) + 0.5) / float(INT_MAX) if self.unique else F.rand(seed)
            return (F.lit(float(self.start)) + u * (float(self.end) - float(self.start))).cast(sql)
        if f == "boolean":
            return (i % 2 == 0) if self.unique else F.rand(seed) < 0.5
        if f == "bit":
            if self.unique:
                return F.lpad(F.conv(permuted(i, 2 ** min(self.length, 62), seed).cast("string"), 10, 2), self.length, "0")
            return symbols(F.lit(self.length), "01", seed, i, spaces=False)
        size = F.lit(1) + F.floor(F.rand(seed + 2) * self.length).cast("int")
        if self.unique and self.length:
            width = next(w for w in range(1, self.length + 1) if 26**w >= rows or w == self.length)
            text = letters(permuted(i, min(26**width, 2**62), seed), width)
            return text if f == "text" else F.to_json(F.create_map(text, text))
        text = symbols(size, "abcdefghijklmnopqrstuvwxyz", seed + 3, i, spaces=True)
        return text if f == "text" else F.to_json(F.create_map(symbols(size, "abcdefghijklmnopqrstuvwxyz", seed + 4, i, spaces=False), text))


def permuted(i: Column, n: int, seed: int) -> Column:
    """The image of i under an affine permutation of 0..n-1."""
    import math

    a = next(x for x in range(2 * int(0.381966 * n) // 2 + 1 + seed % 97, 4 * n + 100) if math.gcd(x, n) == 1) if n > 2 else 1
    wide = i.cast("decimal(38,0)") * F.lit(a % n or 1).cast("decimal(19,0)") + F.lit(seed % n).cast("decimal(19,0)")
    return F.pmod(wide, F.lit(n).cast("decimal(38,0)"))


def letters(x: Column, width: int) -> Column:
    """x (below 2**63) in base 26, as ``width`` letters; from the 14th on from the right they are all the first letter."""
    digit = lambda p: F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.pmod(F.floor(x / F.lit(26**p).cast("decimal(19,0)")), F.lit(26)) + 1).cast("int"), F.lit(1))
    return F.concat(F.lit("a" * max(0, width - 13)), *[digit(p) for p in range(min(width, 13))][::-1])


def symbols(size: Column, alphabet: str, seed: int, i: Column, spaces: bool) -> Column:
    """Uniform symbols; a blank with 10 %, never first nor after another."""
    draw = lambda k: F.pmod(F.xxhash64(i, k, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    pick = lambda k: F.substr(F.lit(alphabet), (F.floor(draw(k) * len(alphabet)) + 1).cast("int"), F.lit(1))
    places = F.sequence(F.lit(1), size)
    if not spaces:
        return F.when(size > 0, F.array_join(F.transform(places, pick), "")).otherwise("")
    add = lambda s, k: F.concat(s, F.when((F.length(s) > 0) & ~s.endswith(" ") & (draw(-k) < 0.1), " ").otherwise(pick(k)))
    return F.when(size > 0, F.aggregate(places, F.lit(""), add)).otherwise("")


def validate(table: str, rows: object, specs: list[ColumnSpec]) -> int:
    """The row count; raises before any job if the request can't be met."""
    if not table:
        raise ValueError("table name is empty")
    count = int(str(rows))
    if not specs:
        raise ValueError("there are no columns")
    for s in [s for s in specs if s.unique and s.generator == RANDOM and s.domain() < count][-1:]:
        raise ValueError(f"column {s.name} has fewer than {count} values")
    return count


def generate(spark: SparkSession, specs: list[ColumnSpec], rows: int = 20, seed: int = 0) -> DataFrame:
    """``rows`` rows; equal for equal seeds and partitioning."""
    validate("t", rows, specs)
    return spark.range(rows).select(*[s.column(F.col("id"), seed + 101 * k, rows).alias(s.name) for k, s in enumerate(specs)])


#: Beginnings of type names, by dialect, with the type they stand for.
PREFIXES = {
    "PG": [("character", "text"), ("varchar", "text"), ("int", "integer"), ("timestamp with time", "timestamptz"), ("timestamp", "timestamp"), ("time", "time"), ("bit", "bit"), ("double", "double"), ("numeric", "numeric"), ("decimal", "numeric"), ("float", "double"), ("bool", "boolean")],
    "MS": [("bit", "bit_ms"), ("nvarchar", "text"), ("varchar", "text"), ("nchar", "text"), ("char", "text"), ("int", "integer"), ("decimal", "numeric"), ("float", "real"), ("datetime2", "datetime2"), ("time", "time")],
    "CH": [("int", "integer"), ("uint", "integer"), ("float", "real"), ("decimal", "real"), ("string", "text"), ("fixedstring", "text"), ("bool", "boolean"), ("datetime", "timestamp"), ("date", "date")],
}


def kind_of(type_name: str, dialect: str = "PG") -> tuple[str, int | None]:
    """(kind, length) of a dialect's type name; the length for text and bit only."""
    name = type_name.lower().strip()
    kind = name if name in TYPES and name not in ("bit", "other", "bit_ms") else next((k for p, k in PREFIXES[dialect] if name.startswith(p)), "other")
    m = re.search(r"\((\d+)\)", name)
    return kind, int(m[1]) if m and kind in ("text", "bit") else None


def specs_from_ddl(ddl: str, dialect: str = "PG") -> list[ColumnSpec]:
    """Columns of a CREATE TABLE body; a primary key makes its columns unique."""
    body = re.search(r"\((.*)\)", ddl, re.S)
    out, keys = [], set()
    for part in re.split(r",(?![^()]*\))", body[1]) if body else []:
        part = part.strip()
        if m := re.match(r"(?:constraint\s+\S+\s+)?primary\s+key\s*\(([^)]*)\)", part, re.I):
            keys |= {k.strip() for k in m[1].split(",")}
            continue
        m = re.match(r"(\S+)\s+(.+?)(\s+(?:not\s+null|null|default|primary|unique|check|references|generated).*)?$", part, re.I | re.S)
        if not m or re.match(r"(constraint|unique|check|foreign)$", m[1], re.I):
            continue
        rest = (m[3] or "").lower()
        kind, length = kind_of(m[2], dialect)
        if "primary key" in rest:
            keys.add(m[1])
        out.append(ColumnSpec(m[1], kind, length=length or 255, not_null="not null" in rest, unique="unique" in rest))
    out = [dataclasses.replace(s, unique=s.unique or s.name in keys, not_null=s.not_null or s.name in keys) for s in out]
    return out or [ColumnSpec("id", "integer")]


def drop_optional(specs: list[ColumnSpec]) -> list[ColumnSpec]:
    return [s for s in specs if s.not_null]


def delete(specs: list[ColumnSpec], name: str) -> list[ColumnSpec]:
    """Without a column; the last one stays."""
    out = [s for s in specs if s.name != name]
    if not out:
        raise ValueError("the last column can't be deleted")
    return out


def retype(specs: list[ColumnSpec], name: str, kind: str) -> list[ColumnSpec]:
    return [s.retype(kind) if s.name == name else s for s in specs]


def swap(specs: list[ColumnSpec], i: int, j: int) -> list[ColumnSpec]:
    out = list(specs)
    out[i], out[j] = out[j], out[i]
    return out


def parse_bound(kind: str, text: str) -> object:
    """ISO dates, HH:MM:SS, ISO instants."""
    family = TYPES[kind][0]
    try:
        if family == "date":
            return dt.date.fromisoformat(text)
        if family == "time":
            t = dt.time.fromisoformat(text)
            return ((t.hour * 60 + t.minute) * 60 + t.second) * 1_000_000 + t.microsecond
        at = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
        utc = at.astimezone(dt.timezone.utc).replace(tzinfo=None) if at.tzinfo else at
        return (utc, at.strftime("%z")[:3] + ":" + at.strftime("%z")[3:]) if family == "timestamptz" else utc
    except ValueError as e:
        raise ValueError(f"{text!r}: expected an ISO {family}") from e


def parse_step(text: str) -> dt.timedelta:
    """ISO-8601 durations of days to seconds."""
    m = re.fullmatch(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", text)
    if not m or text.endswith(("P", "T")):
        raise ValueError(f"{text!r}: expected an ISO duration such as PT1M")
    d, h, mi, s = (float(x or 0) for x in m.groups())
    return dt.timedelta(days=d, hours=h, minutes=mi, seconds=s)


def literal(value: Column, kind: T.DataType, bits: bool = False) -> Column:
    """As SQL text: strings and temporal values quoted, null as null; ``bits`` writes them as B'...'."""
    quoted = isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))
    text = value.cast("string")
    return F.coalesce(F.concat(F.lit("B'" if bits else "'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")) if quoted else text, F.lit("null"))


def insert_rows(df: DataFrame, casts: dict[str, str] | None = None) -> Column:
    """A row of values as ``(a, b)``; with casts ``value::type``."""
    parts = []
    for f in df.schema.fields:
        x = literal(F.col(f.name), f.dataType, (casts or {}).get(f.name, "").startswith("bit"))
        parts.append(F.concat(x, F.lit(f"::{casts[f.name]}")) if casts and f.name in casts else x)
    return F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")"))


def insert_script(df: DataFrame, table: str, order: str, casts: dict[str, str] | None = None) -> DataFrame:
    """One multi-row INSERT; meant for small tables, as a statement is one string."""
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), insert_rows(df, casts).alias("r")))), lambda x: x["r"]), ",\n")
    return df.agg(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(df.columns)})\nVALUES\n"), rows, F.lit(";")).alias("script"))
