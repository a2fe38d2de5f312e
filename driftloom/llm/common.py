"""Helpers shared by the training-data operators: shared storage and vectorised word hashing."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that the vectorised helpers turn into arrays at once (a longer text is taken whole).
BLOCK_BYTES = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, or one of our own where it is unset on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="driftloom-"))
        root = sc._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet to the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores after it as no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts stay small: the session's limit of rows is lowered to ``rows`` if it is higher.

    Batches are cut by rows when a plan runs, so this is a setting of the session, not of one DataFrame.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def release(*frames: DataFrame | None) -> None:
    """Deletes what ``materialize`` wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_written_at", None)
        if path:
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def partitions(spark: SparkSession, weight: int, per_task: int) -> int:
    """Partitions for ``weight`` units at ``per_task`` each, at least what the session is set to."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-weight // per_task), 1)


# ---- hashing -----------------------------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240607))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_BYTES."""
    a, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t) + 1
        if total >= BLOCK_BYTES:
            yield a, i + 1
            a, total = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


#: Places in a word whose bytes' values are looked up; beyond, they are computed.
PLACES = 64


@functools.cache
def _values(seed: int) -> tuple[np.uint64, np.ndarray]:
    """The salt of a seed and the values of (place, byte)."""
    salt = np.uint64((seed + 1) * 0xD1342543DE82EF95 & (2**64 - 1))
    with np.errstate(over="ignore"):
        table = mix64(np.arange(PLACES << 8, dtype=np.uint64) + salt)
    table.reshape(PLACES, 256)[:, _SPACE] = 0
    return salt, table


def _segments(buf: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK_BYTES that end at white space (a longer word is taken whole)."""
    a = 0
    while a < len(buf):
        b = min(len(buf), a + BLOCK_BYTES)
        while b < len(buf) and not len(gap := np.flatnonzero(_SPACE[buf[b : b + BLOCK_BYTES]])):
            b = min(len(buf), b + BLOCK_BYTES)
        if b < len(buf):
            b += int(gap[0]) + 1
        yield a, b
        a = b


def hash_words(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs outside 0x20, 0x09-0x0D) of all texts; bounds[i]:bounds[i+1] are text i's.

    A word's hash is the sum of a mixed value for each of its bytes at its place in the word.  These values don't follow
    from each other as the terms of a polynomial do, so no family of words is known to collide.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    salt, table = _values(seed)
    hashes, starts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for a, b in _segments(buf):
        part = buf[a:b]
        space = _SPACE[part]
        first = ~space
        first[1:] &= space[:-1]
        at = np.flatnonzero(first)
        if not len(at):
            continue
        size = np.diff(np.concatenate(([0], at, [len(part)])))
        place = np.arange(len(part), dtype=np.int32)
        place -= np.repeat(np.concatenate(([0], at)).astype(np.int32), size)
        with np.errstate(over="ignore"):
            value = table.take((np.minimum(place, PLACES - 1) << 8) | part, mode="clip")
            if size[1:].max() > PLACES:
                far = np.flatnonzero(place >= PLACES)
                value[far] = np.where(space[far], np.uint64(0), mix64(((place[far].astype(np.uint64) << np.uint64(8)) | part[far]) + salt))
            hashes.append(mix64(np.add.reduceat(value, at)))
        starts.append(at + a)
    return np.concatenate(hashes), np.concatenate(([0], np.searchsorted(np.concatenate(starts), ends)))


def hash_grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbouring word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:m] * _STEP[0]
        for j in range(1, n):
            out = out + words[j : j + m] * _STEP[j]
    return mix64(out + np.uint64(n))
