"""Best-fit packing of token sequences by patterns fitted with non-negative least squares.

1. One pass tokenizes and cuts each document into pieces of at most ``capacity`` tokens.
2. The histogram of piece lengths (at most ``capacity`` rows, whatever the input) goes to the driver, where
   patterns of two to four lengths that fill a sequence are enumerated, their repeat counts fitted to the
   histogram by non-negative least squares, rounded down and what is left packed best-fit decreasing.
   The plan lists runs of equal sequences, so its size depends on ``capacity`` alone.
3. Each piece takes the place of its rank among the pieces of its length.  Ranks are counted within
   (length, hash bucket), with the buckets' totals added, so a very common length isn't ranked in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, small_batches
from .tokenized import tokenizer

CAPACITY, END_ID = 2048, 0
#: Patterns that are fitted at most, and rounds of coordinate descent.
PATTERNS, SWEEPS = 6000, 60


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document; a null text is empty and has the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer(vocabulary).encode, np.array([end_id], "<u4").tobytes()
        for b in batches:
            of, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = encode(text or "") + end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    of.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "crc"],
            )

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, crc long")
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"))


def fit_patterns(patterns: list[tuple[int, ...]], have: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Repeats x >= 0 that minimise |A x - have|^2 by cyclic coordinate descent; A counts lengths by pattern."""
    rest, x = have.astype(float).copy(), np.zeros(len(patterns))
    columns = [tuple(Counter(p).items()) for p in patterns]
    norms = [sum(m * m for _, m in c) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, c in enumerate(columns):
            step = max(-x[j], sum(m * rest[v] for v, m in c) / norms[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for v, m in c:
                    rest[v] -= m * step
        if moved < 0.25:
            break
    return x


def enumerate_patterns(have: np.ndarray, capacity: int, most: int = PATTERNS) -> list[tuple[int, ...]]:
    """Patterns of two to four lengths that occur and fill the capacity, or come closest; the likeliest first."""
    lengths = [int(v) for v in np.flatnonzero(have) if v < capacity]
    if not lengths:
        return []
    weight = {v: have[v] / max(1, have.sum()) for v in lengths}
    found: dict[tuple[int, ...], float] = {}

    def below(room: int) -> int | None:
        i = bisect.bisect_right(lengths, room)
        return lengths[i - 1] if i else None

    def add(p: tuple[int, ...]) -> None:
        waste = capacity - sum(p)
        found[tuple(sorted(p, reverse=True))] = float(np.prod([weight[v] for v in p])) ** (1 / len(p)) / (1 + waste)

    common = sorted(lengths, key=lambda v: -have[v])[:160]
    for a in lengths:
        if (b := below(capacity - a)) is not None:
            add((a, b))
        for b in common[:80]:
            if a + b < capacity and (c := below(capacity - a - b)) is not None:
                add((a, b, c))
    for i, a in enumerate(common[:40]):
        for b in common[i:40]:
            for c in common[:40]:
                if a + b + c < capacity and (d := below(capacity - a - b - c)) is not None:
                    add((a, b, c, d))
    return sorted(found, key=lambda p: (-found[p], p))[:most]


def plan_sequences(have: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that together hold each length exactly as often as ``have`` says."""
    rest = have.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = [((capacity,), int(rest[capacity]))] if rest[capacity] else []
    rest[capacity] = 0
    patterns = enumerate_patterns(rest, capacity)
    for p, x in sorted(zip(patterns, fit_patterns(patterns, rest), strict=True), key=lambda q: (capacity - sum(q[0]), -q[1], q[0])):
        times = min(int(x), *(int(rest[v]) // m for v, m in Counter(p).items()))
        if times > 0:
            plan.append((p, times))
            for v in p:
                rest[v] -= times
    return plan + best_fit(rest, capacity)


def best_fit(rest: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: equal sequences are handled together."""
    open_at: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]  # by room left
    for v in range(capacity, 0, -1):
        n = int(rest[v])
        while n:
            room = next((r for r in range(v, capacity) if open_at[r]), None)
            if room is None:
                fill = capacity // v if n >= capacity // v else 1  # equal pieces fill new sequences together
                bins = n // fill
                key = (v,) * fill
                left = capacity - v * fill
                open_at[left][key] = open_at[left].get(key, 0) + bins
                n -= bins * fill
                continue
            key, bins = next(iter(open_at[room].items()))
            m = min(n, bins)
            if bins == m:
                del open_at[room][key]
            else:
                open_at[room][key] = bins - m
            open_at[room - v][(*key, v)] = open_at[room - v].get((*key, v), 0) + m
            n -= m
    return [(p, n) for at in open_at for p, n in at.items()]


def pack(found: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces (id, piece, length, ...); ``found`` is read several times, so have it written."""
    spark = found.sparkSession
    rows = found.groupBy("length").count().collect()  # at most ``capacity`` rows
    have = np.zeros(capacity + 1, np.int64)
    for r in rows:
        have[r["length"]] = r["count"]
    runs, next_id, used = [], 0, Counter()
    for p, times in plan_sequences(have, capacity):
        offset = 0
        for v in p:
            runs.append((v, used[v], used[v] + times, next_id, offset))
            used[v] += times
            offset += v
        next_id += times
    table = spark.createDataFrame(pa.table([pa.array([r[i] for r in runs], pa.int64()) for i in range(5)], names=["length", "lo", "hi", "base", "offset"]))
    buckets = partitions(spark, int(have.max()), 20_000)
    salted = found.withColumn("__salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)))
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = counts.select("length", "__salt", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "__salt").orderBy(id_col, "piece", "start")) - 1
    ranked = salted.withColumn("rank", rank).join(totals, ["length", "__salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    # the runs of a length are sorted and don't overlap: an array by length is searched, one row per length
    slots = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "base", "offset"))).alias("runs"))
    out = ranked.join(F.broadcast(slots), "length")  # at most ``capacity`` rows, runs bounded by the plan
    own = F.filter("runs", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"]))[0]
    out = out.withColumn("run", own)
    keep = [c for c in found.columns]
    return out.select(*keep, (F.col("run.base") + F.col("rank") - F.col("run.lo")).alias("sequence_id"), F.col("run.offset").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of the end id alone; rows that repeat are packed as often as they stand;
    an empty table gives no rows.
    """
    return pack(materialize(pieces(docs, vocabulary, id_col, text_col, capacity), "pieces"), capacity, id_col)
