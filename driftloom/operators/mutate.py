"""INSERT, UPDATE, DELETE and TRUNCATE over Parquet, copy-on-write.

A table is a folder of parts (Parquet folders, written once) and of versions, each a short list of the parts it has.
An insert writes the new rows alone; an update or delete rewrites the parts that hold a row it applies to and keeps the
others.  A version appears by one rename, which fails if another writer was first; readers keep the version they opened.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class StaleVersion(RuntimeError):
    """Another writer has made the next version."""


class ParquetTable:
    """A table of the given schema at ``path``, a folder that all executors see; created without rows if it isn't there."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not self._fs.exists(self._path(f"{self.path}/versions")):
            self._fs.mkdirs(self._path(f"{self.path}/versions"))
            self._commit(-1, [])

    def version(self) -> int:
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(self._path(f"{self.path}/versions")) if f.getPath().getName().isdigit()), default=-1)

    def parts(self, version: int | None = None) -> list[str]:
        at = self.version() if version is None else version
        stream = self._fs.open(self._path(f"{self.path}/versions/{at}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.parts(version))

    def _rows(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in parts])

    def _commit(self, base: int, parts: list[str]) -> None:
        draft = self._path(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        target = self._path(f"{self.path}/versions/{base + 1}")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise StaleVersion(f"version {base + 1} of {self.path} is there already")

    def _write(self, rows: DataFrame) -> list[str]:
        part = f"part-{uuid.uuid4().hex}"
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields]).write.parquet(f"{self.path}/{part}")
        return [part]

    def insert(self, rows: DataFrame, columns: list[str] | None = None) -> None:
        """Columns go by position, or by the names given; those left out are null."""
        base = self.version()
        names = columns or self.schema.names[: len(rows.columns)]
        if len(names) != len(rows.columns):
            raise ValueError("as many columns as values are needed")
        rows = rows.toDF(*names)
        for f in self.schema.fields:
            if f.name not in names:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        self._commit(base, self.parts(base) + self._write(rows))

    def _touched(self, parts: list[str], condition: Column) -> list[str]:
        hit = F.regexp_extract(F.col("_metadata.file_path"), r"(part-[0-9a-f]+)/[^/]*$", 1)
        found = {r[0] for r in self._rows(parts).where(condition).select(hit.alias("part")).distinct().collect()} if parts else set()  # a row a part
        return [p for p in parts if p in found]

    def update(self, sets: dict[str, Column], condition: Column | None = None, returning: bool = False) -> DataFrame | None:
        """Rows for which the condition holds (null doesn't) get the new values, computed from the old row."""
        where = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
        base = self.version()
        parts = self.parts(base)
        touched = self._touched(parts, where)
        if not touched:
            return self._rows([]) if returning else None
        old = self._rows(touched)
        changed = [F.when(where, sets[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in sets else F.col(f.name) for f in self.schema.fields]
        self._commit(base, [p for p in parts if p not in touched] + self._write(old.select(*changed)))
        new = [sets[f.name].cast(f.dataType).alias(f.name) if f.name in sets else F.col(f.name) for f in self.schema.fields]
        return old.where(where).select(*new) if returning else None

    def delete(self, condition: Column | None = None, returning: bool = False) -> DataFrame | None:
        """Without rows for which the condition holds; all rows without a condition."""
        where = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
        base = self.version()
        parts = self.parts(base)
        touched = self._touched(parts, where)
        if not touched:
            return self._rows([]) if returning else None
        old = self._rows(touched)
        self._commit(base, [p for p in parts if p not in touched] + self._write(old.where(~where)))
        return old.where(where) if returning else None

    def truncate(self) -> None:
        self._commit(self.version(), [])

    def vacuum(self) -> int:
        """Deletes the parts that the newest version doesn't have and older versions; their number."""
        last = self.version()
        keep, gone = set(self.parts(last)), 0
        for f in self._fs.listStatus(self._path(self.path)):
            if f.getPath().getName().startswith("part-") and f.getPath().getName() not in keep:
                self._fs.delete(f.getPath(), True)
                gone += 1
        for f in self._fs.listStatus(self._path(f"{self.path}/versions")):
            if f.getPath().getName() != str(last):
                self._fs.delete(f.getPath(), False)
        return gone
