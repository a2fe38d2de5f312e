"""Projects, dumps, libraries and lists as DataFrames, and the sinks that match them."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Driver class of each dialect, and the one that checks a connection by a query.
DRIVERS = {"PG": "org.postgresql.Driver", "MS": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "CH": "com.clickhouse.jdbc.ClickHouseDriver"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each SQL file below a directory, in the order of a listing: at each level directories first, by name."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.sql").text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).orderBy(listing_order(F.col("path")))


def listing_order(path: Column) -> Column:
    """A sort key of file paths: at each level what is in directories comes first, then files, both by name."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda name, i: F.struct((i == F.size(parts) - 1).alias("file"), name.alias("name")))


def dump(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def stream_of(spark: SparkSession, text: str, name: str = "input") -> DataFrame:
    return spark.createDataFrame([(name, text)], "path string, text string")


def archive(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the SQL files inside zip archives."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    inner = [n for n in z.namelist() if n.endswith(".sql")]
                    yield pd.DataFrame({"path": [f"{name}!{n}" for n in inner], "text": [z.read(n).decode() for n in inner]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzip, "path string, text string")


def jdbc_options(dialect: str, url: str, user: str = "", password: str = "", read_only: bool = True, timeout: int = 10, more: dict[str, str] | None = None) -> dict[str, str]:
    """Options for ``spark.read.format("jdbc")``."""
    out = {"url": url, "driver": DRIVERS[dialect], "loginTimeout": str(timeout)} | ({"user": user} if user else {}) | ({"password": password} if password else {})
    if dialect == "PG" and read_only:
        out["readOnly"] = "true"
    if dialect == "CH":
        out["sessionInitStatement"] = "SELECT 1"
    return out | (more or {})


def jdbc(spark: SparkSession, options: dict[str, str], query: str) -> DataFrame:
    return spark.read.format("jdbc").options(**options).option("query", query).load()


def kind_of_source(path: str) -> str:
    if path.startswith("jdbc:"):
        return "JDBC"
    return "URL" if re.match(r"https?://", path) else "LOCAL"


#: The catalog table of each dialect that a schema load reads, and its statement.
CATALOGS = {
    "PG": "SELECT table_schema, table_name, column_name, ordinal_position, data_type, is_nullable, column_default FROM information_schema.columns",
    "MS": "SELECT table_schema, table_name, column_name, ordinal_position, data_type, is_nullable, column_default FROM information_schema.columns",
    "CH": "SELECT database AS table_schema, table AS table_name, name AS column_name, position AS ordinal_position, type AS data_type, CASE WHEN type LIKE 'Nullable(%' THEN 'YES' ELSE 'NO' END AS is_nullable, default_expression AS column_default FROM system.columns",
}


def catalog_query(dialect: str, schemas: list[str] | None = None) -> str:
    """The statement that reads a live schema; system schemas are left out unless asked for."""
    own = "database" if dialect == "CH" else "table_schema"
    quoted = lambda names: ", ".join("'" + n.replace("'", "''") + "'" for n in names)
    if schemas is not None:
        return f"{CATALOGS[dialect]} WHERE {own} IN ({quoted(schemas) or 'NULL'})"
    system = {"PG": ["information_schema", "pg_catalog"], "MS": ["INFORMATION_SCHEMA", "sys"], "CH": ["INFORMATION_SCHEMA", "information_schema", "system"]}[dialect]
    return f"{CATALOGS[dialect]} WHERE {own} NOT IN ({quoted(system)})"


def live_schema(spark: SparkSession, dialect: str, options: dict[str, str], schemas: list[str] | None = None, load: Callable[..., DataFrame] = jdbc) -> DataFrame:
    """One row per column of a live database."""
    return load(spark, options, catalog_query(dialect, schemas))


def schema_ddl(columns: DataFrame) -> DataFrame:
    """(table_schema, table_name, ddl): the columns of each table as a CREATE TABLE body, in their order."""
    column = F.concat_ws(" ", "column_name", "data_type", F.when(F.upper("is_nullable") == "NO", "NOT NULL"), F.concat(F.lit("DEFAULT "), F.col("column_default")))
    rows = F.sort_array(F.collect_list(F.struct("ordinal_position", column.alias("c"))))
    return columns.groupBy("table_schema", "table_name").agg(F.array_join(F.transform(rows, lambda r: r["c"]), ", ").alias("ddl"))


def ms_url(host: str, port: int, database: str, integrated: bool = False, domain: str | None = None) -> str:
    """Connection string of the MS dialect; a database name is put in braces unless it holds a closing one."""
    name = database if "}" in database else f"{{{database}}}"
    url = f"jdbc:sqlserver://{host}:{port};databaseName={name}"
    if integrated:
        url += ";integratedSecurity=true;authenticationScheme=NTLM" + (f";domain={domain}" if domain else "")
    return url


def stub(df: DataFrame) -> Callable[[], DataFrame]:
    """A source of what has been loaded already; nothing is read again."""
    return lambda: df


def library_plan(paths: list[str], nested: Callable[[str], list[str]] | None = None) -> list[tuple[str, str]]:
    """(kind, path) of all libraries in the order they are met, each path once; ``nested`` names those of a local library."""
    seen: dict[str, str] = {}
    todo = list(reversed(paths))
    while todo:
        path = todo.pop()
        if path not in seen:
            seen[path] = kind_of_source(path)
            if nested and seen[path] == "LOCAL":
                todo += reversed(nested(path))
    return [(kind, path) for path, kind in seen.items()]


def libraries(
    spark: SparkSession,
    paths: list[str],
    nested: Callable[[str], list[str]] | None = None,
    fetch: Callable[[str], str] | None = None,
    connect: Callable[[SparkSession, str], DataFrame] | None = None,
) -> DataFrame:
    """(path, text) of all libraries, each path once.

    ``fetch`` brings a URL's file into a folder that all executors see and returns its path; ``connect`` reads a JDBC
    library as (path, text).  A kind without its reader raises: no library is left out silently.
    """
    out = stream_of(spark, "").limit(0)
    for kind, path in library_plan(paths, nested):
        if kind == "JDBC":
            if connect is None:
                raise ValueError(f"{path}: a JDBC library needs connect")
            frame = connect(spark, path)
        else:
            if kind == "URL" and fetch is None:
                raise ValueError(f"{path}: a URL library needs fetch")
            local = fetch(path) if kind == "URL" else path
            frame = archive(spark, local) if local.endswith(".zip") else project(spark, local)
        out = out.unionByName(frame)
    return out.dropDuplicates(["path"])


def version_gate(marker: str | None, current: tuple[int, ...]) -> bool:
    """Whether a project opens: not without a marker, nor with a higher version; what can't be read opens."""
    if marker is None:
        return False
    try:
        return tuple(int(x) for x in marker.strip().split(".")) <= current
    except ValueError:
        return True


def directory_order(path: Column, is_dir: Column) -> list[Column]:
    return [is_dir.desc(), path.asc()]


def count_files(df: DataFrame) -> DataFrame:
    """Files below each ancestor directory."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return df.select(F.explode(up).alias("directory")).groupBy("directory").count()


def write_csv_lines(df: DataFrame, path: str) -> None:
    """Quoted values, NULL bare, a line per row."""
    from ..functions.formatting import csv_line

    df.select(csv_line(*[F.col(c) for c in df.columns]).alias("value")).write.text(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A snapshot of the expected columns; one of other names or types is refused, as it would be another class's."""
    found, want = spark.read.parquet(path), spark.createDataFrame([], schema).schema
    if [(f.name, f.dataType) for f in found.schema.fields] != [(f.name, f.dataType) for f in want.fields]:
        raise ValueError(f"{path} holds {found.schema.simpleString()}, not {want.simpleString()}")
    return found


def write_temporary_sql(df: DataFrame, folder: str, text: str = "text") -> str:
    """Writes scripts as UTF-8 text to a new folder below ``folder``; its path."""
    path = f"{folder.rstrip('/')}/sql-{uuid.uuid4().hex}"
    df.select(F.col(text).alias("value")).write.option("encoding", "UTF-8").text(path)
    return path


def write_objects(df: DataFrame, path: str, by: str, partial: bool = False) -> None:
    """One folder per value of ``by``; partial replaces only the folders that occur."""
    df.write.option("partitionOverwriteMode", "dynamic" if partial else "static").mode("overwrite").partitionBy(by).parquet(path)


def export_connections(df: DataFrame, with_passwords: bool) -> DataFrame:
    return df if with_passwords else df.withColumn("pass", F.lit(""))


def write_xml(df: DataFrame, path: str, row: str) -> None:
    df.write.format("xml").option("rowTag", row).mode("overwrite").save(path)


def read_xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def encrypt(column: Column, key: Column) -> Column:
    return F.base64(F.aes_encrypt(column, key, F.lit("GCM")))


def decrypt(column: Column, key: Column) -> Column:
    """Null where neither the cipher nor the key fit."""
    return F.try_aes_decrypt(F.unbase64(column), key, F.lit("GCM")).cast("string")


def read_stored(column: Column, key: Column) -> Column:
    """An entry under the present cipher, else under the older one (ECB), else as it stands if it is plain XML; null if it is none."""
    raw = F.try_to_binary(column, F.lit("base64"))
    plain = F.when(F.ltrim(column).startswith("<"), column)
    return F.coalesce(F.try_aes_decrypt(raw, key, F.lit("GCM")).cast("string"), F.try_aes_decrypt(raw, key, F.lit("ECB")).cast("string"), plain)


def event_file_name(action: Column, label: Column) -> Column:
    """``action-label``, URL-encoded; the name-based UUID (version 3) of that where it is longer than 40."""
    name = F.url_encode(F.concat_ws("-", action, label))
    h = F.md5(name)
    part = lambda at, n: F.substring(h, at, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    uuid = F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
    return F.when(F.length(name) > 40, uuid).otherwise(name)


def ping(values: dict[str, Column]) -> Column:
    """k=v pairs joined by &."""
    return F.concat_ws("&", *[F.concat(F.lit(f"{k}="), v) for k, v in values.items()])
