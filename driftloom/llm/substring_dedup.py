"""Substring dedup: repeated passages go wherever they stand, their earliest occurrence stays.

Lines and paragraphs are too coarse as units, since a repeated passage may begin and end inside of them.  Units here are
runs of ``UNIT_WORDS`` normalised words (A-Z in lower case, whatever white space between).  Which runs are units depends
on their words alone: of each ``REACH`` neighbouring runs those with the lowest hash, so texts that share a passage share
the units inside it, and neighbouring units of a text leave no word between them uncovered.

1. A filter of bounded size tells which units may occur twice; a full one costs time only.
2. Digests of those units are grouped globally; every occurrence but the earliest by (id, position) is repeated.
3. Repeated units of a document that touch or overlap are one run; runs of ``MIN_RUN`` words or more go.  A passage of
   ``PASSAGE_WORDS`` words or more always leaves such a run, shorter repeats (a license line, a heading) do not.
4. A run is widened on both sides, by ``REACH - 1`` words at most, as far as the words agree with those around the
   earliest occurrence of its outermost unit: the ends of a passage that stand outside its units.

Only digests and positions are shuffled until the runs are known; texts are joined with them at the end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _STEP, blocks, materialize, mix64, release, small_batches

#: Words of a unit, neighbouring runs of which the lowest is a unit, words of a passage that is always found.
UNIT_WORDS, REACH, PASSAGE_WORDS = 12, 10, 50
#: Words of a run that goes: what a passage's units cover at least.
MIN_RUN = PASSAGE_WORDS - 2 * (REACH - 1)
#: Factors and modulus of the order of units.
FACTORS = [(7919 * (j + 1) ** 5 + 104729 * j + 1) % (1 << 28) | 1 for j in range(UNIT_WORDS)]
MODULUS = (1 << 31) - 1
#: 64-bit words (a power of 2, at most 2**26) of the filter of repeated units, and words that a worker remembers.
FILTER_WORDS, CACHE_WORDS = 1 << 20, 1_000_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class _Words(dict):
    """Word -> the first 64 bits of its MD5."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:8], "big")
        return out

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts; bounds[i]:bounds[i+1] are those of text i."""
        parts = [np.fromiter(map(self.__getitem__, w), np.uint64, len(w)) for w in (t.lower().split() for t in texts)]
        return np.concatenate([np.empty(0, np.uint64), *parts]), np.cumsum([0, *map(len, parts)])


_words = _Words()


def _sliding(x: np.ndarray, n: int, op: np.ufunc) -> np.ndarray:
    """``op`` over each n neighbours."""
    have = 1
    while have * 2 <= n:
        x, have = op(x[:-have], x[have:]), have * 2
    return op(x[: -(n - have)], x[n - have :]) if have < n else x


def unit_positions(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where units of all texts begin.  The order of a run is a linear form of the first 28 bits of its words' hashes."""
    span = UNIT_WORDS + REACH - 1
    if len(words) < span:
        return np.empty(0, np.int64)
    m = len(words) - UNIT_WORDS + 1
    order = (words >> np.uint64(36)).astype(np.int64)
    key = np.ones(m, np.int64)
    for j, f in enumerate(FACTORS):
        key += order[j : j + m] * f
    key = key % MODULUS + 1
    ends = np.repeat(bounds[1:], np.diff(bounds))
    starts = len(words) - span + 1
    inside = np.arange(starts) + span <= ends[:starts]
    low = np.where(inside, _sliding(key, REACH, np.minimum), 0)
    edge = np.zeros(REACH - 1, np.int64)
    return np.flatnonzero(_sliding(np.concatenate((edge, low, edge)), REACH, np.maximum) == key)


def _digests(words: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    out = np.full(len(at), UNIT_WORDS + salt, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(UNIT_WORDS):
            out += (words[at + j] if not salt else mix64(words[at + j] + np.uint64(salt))) * _STEP[j + salt]
    return mix64(out)


def _units_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words, bounds, unit positions) of a batch, some rows at a time."""
    texts = [(t or "").encode() for t in column.to_pylist()]
    for a, b in blocks(texts):
        words, bounds = _words.of(texts[a:b])
        yield a, words, bounds, unit_positions(words, bounds)


def _repeated(docs: DataFrame, text_col: str) -> np.ndarray:
    """A filter with the bits of all units that occur more than once (and, rarely, of others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, words, _, at in _units_of(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(_digests(words, at, 0).astype(np.uint32).view(np.int32))], names=["k"])

    shift = FILTER_WORDS.bit_length() - 1
    twice = docs.select(text_col).mapInArrow(run, "k int").groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    bits = twice.groupBy(F.col("k").bitwiseAND(FILTER_WORDS - 1).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, shiftrightunsigned(k, {shift}) & 63))").alias("b")).toArrow()
    out = np.zeros(FILTER_WORDS, np.uint64)
    out[bits.column("w").to_numpy()] = bits.column("b").to_numpy().view(np.uint64)
    return out


def units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, pos, d1, d2): units that may occur twice; pos: the first word's number, th tells rows that share an id apart."""
    shared = docs.sparkSession.sparkContext.broadcast(_repeated(docs, text_col))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("th", T.LongType()), T.StructField("pos", T.IntegerType()), *(T.StructField(k, T.LongType()) for k in ("d1", "d2"))])
    shift = np.uint64(FILTER_WORDS.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            for row, words, bounds, at in _units_of(b.column(2)):
                d = _digests(words, at, 0)
                hit = (bits[(d & np.uint64(FILTER_WORDS - 1)).astype(np.int64)] >> (d >> shift & np.uint64(63))) & np.uint64(1) > 0
                at, d = at[hit], d[hit]
                of = np.searchsorted(bounds, at, "right") - 1
                take = pa.array(of + row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array((at - bounds[of]).astype(np.int32)), pa.array(d.view(np.int64)), pa.array(_digests(words, at, 1).view(np.int64))], names=schema.names)

    return _keyed(docs, id_col, text_col).mapInArrow(run, schema)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


def runs(found: DataFrame) -> DataFrame:
    """(id, th, a, b, left, right, lq, rq): runs [a, b) of words to cut, the earliest occurrences (id, th, pos) of their
    outermost units, and where these units begin in the text.  What overlaps its own first occurrence loses what lies beyond that."""
    rank = F.struct(F.col("id").isNull().alias("null"), "id", "th", "pos")
    earliest = found.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(rank).alias("first")).where("n > 1").select("d1", "d2", "first")
    later = found.join(earliest, ["d1", "d2"]).where(rank != F.col("first"))
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    later = later.select("id", "th", "pos", "first", F.when(own, F.greatest("pos", F.col("first.pos") + UNIT_WORDS)).otherwise(F.col("pos")).alias("s"), (F.col("pos") + UNIT_WORDS).alias("e"))
    order = Window.partitionBy("id", "th").orderBy("pos")
    later = later.withColumn("before", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    later = later.withColumn("run", F.count_if(F.col("before").isNull() | (F.col("s") > F.col("before"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = later.groupBy("id", "th", "run").agg(
        F.min("s").alias("a"), F.max("e").alias("b"), F.min(F.struct("pos", "first")).alias("l"), F.max(F.struct("pos", "first")).alias("r")
    )
    out = out.where(F.col("b") - F.col("a") >= MIN_RUN)
    place = lambda c: F.struct(*[F.col(f"{c}.first.{k}").alias(k) for k in ("id", "th", "pos")])
    return out.select("id", "th", "a", "b", place("l").alias("left"), place("r").alias("right"), F.col("l.pos").alias("lq"), F.col("r.pos").alias("rq"))


def _around(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(id, th, pos, before, after): hashes of the words around the wanted units, the nearest first."""
    asked = wanted.groupBy("id", "th").agg(F.collect_set("pos").alias("at")).select(F.col("id").alias("wid"), F.col("th").alias("wth"), "at")
    rows = _keyed(docs, id_col, text_col).join(asked, F.col("id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth"))).select("id", "th", "text", "at")
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("th", T.LongType()), T.StructField("pos", T.IntegerType()), *(T.StructField(k, T.ArrayType(T.LongType())) for k in ("before", "after"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, pos, before, after = [], [], [], []
            for i, (text, at) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                words = _words.of([text.encode()])[0].view(np.int64)
                for p in at:
                    of.append(i)
                    pos.append(p)
                    before.append(words[max(0, p - REACH + 1) : p][::-1])
                    after.append(words[p + UNIT_WORDS : p + UNIT_WORDS + REACH - 1])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), b.column(1).take(pa.array(of, pa.int64())), pa.array(pos, pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in (before, after))], names=schema.names)

    return rows.mapInArrow(run, schema).dropDuplicates(["id", "th", "pos"])


def cut_words(text: str, cuts: list[tuple[int, int]]) -> tuple[str, list[dict]]:
    """The text without runs [a, b) of words, and the spans cut from the original (code points).

    A span goes from a run's first word to its last; white space around it stays.
    """
    at = [m.span() for m in _WORD.finditer(text)]
    merged: list[list[int]] = []
    for a, b in sorted(cuts):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    kept, done, spans = [], 0, []
    for a, b in merged:
        start, end = at[a][0], at[b - 1][1]
        kept.append(text[done:start])
        spans.append({"start": start, "length": end - start})
        done = end
    return "".join([*kept, text[done:]]), spans


def _agree(own: np.ndarray, other: list[int] | None) -> int:
    n = min(len(own), len(other or ()))
    apart = np.flatnonzero(own[:n] != np.array(other[:n], np.int64)) if n else ()
    return int(apart[0]) if len(apart) else n


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` cut, plus n_removed (spans) and removed (their offsets in the original, in code points).

    The earliest occurrence by (id, word number) stays, within a document too; null ids rank last.  Null texts stay null,
    with nothing removed; texts without words and an empty table stay as they are.  Rows that repeat an id and a text are
    one document and are cut alike; texts that share an id rank by a hash.  Columns named n_removed or removed are replaced;
    any other name may occur, these of the work columns included.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_removed", "removed")
    found = materialize(units(docs, id_col, text_col), "units")
    cuts = runs_ = materialize(runs(found), "runs")
    release(found)
    own = F.col("left.id").eqNullSafe(F.col("id")) & (F.col("left.th") == F.col("th"))
    cuts = cuts.withColumn("floor", F.when(own, F.col("left.pos") + UNIT_WORDS).otherwise(0))  # the first occurrence stays
    sides = cuts.select("left.*").unionByName(cuts.select("right.*")).distinct()
    around = materialize(_around(docs, id_col, text_col, sides), "around")
    for side, name in (("left", "before"), ("right", "after")):
        own = around.select(F.struct("id", "th", "pos").alias("place"), F.col(name))
        cuts = cuts.join(own, cuts[side].eqNullSafe(own["place"]), "left").drop("place")
    cuts = cuts.groupBy("id", "th").agg(F.collect_list(F.struct("a", "b", "lq", "floor", "before", "after")).alias("cuts"))
    cuts = materialize(cuts, "cuts")
    release(runs_, around)
    names = docs.columns
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own_th"))
    both = packed.join(cuts, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_th") == F.col("th")), "left").select("row", "cuts")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_removed", T.IntegerType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])))])
    spans, k = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])), names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column(0)
            texts, removed = row.field(k).to_pylist(), [[]] * b.num_rows
            for i, own in enumerate(b.column(1).to_pylist()):
                if own:
                    words, wide = _words.of([texts[i].encode()])[0].view(np.int64), []
                    for c in own:
                        left = _agree(words[c["floor"] : c["a"]][::-1], c["before"]) if c["a"] == c["lq"] else 0
                        wide.append((c["a"] - left, c["b"] + _agree(words[c["b"] :], c["after"])))
                    texts[i], removed[i] = cut_words(texts[i], wide)
            columns = [row.field(j) if j != k else pa.array(texts, pa.string()) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(r) for r in removed], pa.int32()), pa.array(removed, spans)], names=[*names, "n_removed", "removed"])

    return both.mapInArrow(run, schema)
