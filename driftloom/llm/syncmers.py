"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the smallest hash among its s-mers is the first or the last.  Whether it
is one depends on the k-mer alone, so two texts share the anchors of every passage that they share, wherever it stands.
A fingerprint is all distinct anchors (``kept`` None) or the bottom-m of them by hash, each with its first position; m is
a share of them, so long texts keep more.  Likeness matches by position: of the union of all anchors, or of the union's
bottom-m (the smaller m of the two), it counts the longest chain of anchors that both texts hold in the same order, hence
an insertion or a cut costs only what it changes.  A bottom-m is a sample: its likeness is an estimate, and a change
that touches none of its anchors doesn't show.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, small_batches

K, S = 16, 6
#: Anchors that a bottom-m keeps at least (all, if fewer), and of how many distinct anchors it keeps one beyond that.
KEPT, SHARE = 32, 32
#: Characters of fingerprints that a task holds before it hands them on (a longer one is taken whole).
HELD = 8_000_000

Marks = tuple[np.ndarray, np.ndarray]


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the closed syncmers in order of position; a text shorter than k is one anchor, an empty one none."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(c):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k, n = min(k, len(c)), len(c)
    s = min(s, k)
    with np.errstate(over="ignore"):
        h = np.zeros(n - s + 1, np.uint64)
        for j in range(s):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[j : n - s + 1 + j]
        h = mix64(h)
        width = k - s + 1
        low, have = h, 1
        while have < width:  # minimum over windows of doubling width
            step = min(have, width - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        at = np.flatnonzero((low == h[: len(low)]) | (low == h[width - 1 :]))
        x = np.zeros(len(at), np.uint64)
        for j in range(k):
            x = x * np.uint64(0x9E3779B97F4A7C15) + c[at + j]
    return mix64(x + np.uint64(k)), at


def marks(text: str, kept: int | None = KEPT, share: int = SHARE) -> Marks:
    """(hashes ascending, first positions) of the distinct anchors that a fingerprint holds; all of them if ``kept`` is None."""
    h, at = anchors(text)
    h, first = np.unique(h >> np.uint64(24), return_index=True)
    n = len(h) if kept is None else max(kept, len(h) // share)
    return h[:n], at[first[:n]]


def written(m: Marks) -> str:
    """``hash:position`` in hexadecimal, ascending by hash, comma-separated."""
    both = np.empty((len(m[0]), 2), np.int64)
    both[:, 0], both[:, 1] = m
    return (",%010x:%x" * len(both) % tuple(both.ravel().tolist()))[1:]


def fingerprint(text: str, kept: int | None = KEPT, share: int = SHARE) -> str:
    """The anchors as ``written``; empty for an empty text."""
    return written(marks(text, kept, share))


def longest_chain(places: list[int]) -> int:
    """Length of the longest strictly ascending subsequence."""
    ends: list[int] = []
    for p in places:
        i = bisect_left(ends, p)
        ends[i : i + 1] = [p]
    return len(ends)


def alike(a: Marks, b: Marks, kept: int | None = KEPT) -> float:
    """``likeness`` of what two fingerprints hold."""
    (x, p), (y, q) = a, b
    if np.array_equal(x, y) and np.array_equal(p, q):
        return 1.0
    if kept is not None:
        top = np.union1d(x, y)[: max(kept, min(len(x), len(y)))][-1]
        x, y = x[: np.searchsorted(x, top, "right")], y[: np.searchsorted(y, top, "right")]
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = np.flatnonzero(y[at] == x)
    places = q[at[both]][np.argsort(p[both])]
    chain = len(places) if (places[1:] > places[:-1]).all() else longest_chain(places.tolist())
    return chain / (len(x) + len(y) - len(both))


def likeness(a: str, b: str, kept: int | None = KEPT) -> float:
    """0 to 1; 1 for equal fingerprints.  None: both hold all anchors, and all of the union count.  Otherwise fewer than
    ``kept`` anchors are all that a text has, so they don't bound the union."""
    if a == b:
        return 1.0
    x, y = ([p.split(":") for p in f.split(",") if p] for f in (a, b))
    return alike(*((np.array([int(h, 16) for h, _ in f], np.uint64), np.array([int(p, 16) for _, p in f], np.int64)) for f in (x, y)), kept)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (pid, id, text, tail) dealt into ranges of ids; each range also gets the head of the next (tail), the last
    range that of the first.  Texts are shuffled once.  Null ids sort first."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = base.select("id")
    low = ids.agg(F.min("id").alias("low"), F.count("*").alias("n"), F.count("id").alias("ids"), F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 100 * n).alias("cuts")).first()
    cuts = sorted({c for c in low["cuts"] or [] if c > low["low"]})  # ids that occur
    at = F.when(F.col("id").isNull(), 0)
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")
    at = at.otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("id").cast("long")))) if cuts else F.lit(0)
    is_first = F.col("id").isNull() if low["ids"] < low["n"] else F.col("id") == F.lit(low["low"])
    heads = F.array(F.when(is_first, len(cuts)), F.when(F.col("id").isin(cuts), at - 1) if cuts else F.lit(None).cast("int"))
    targets = F.concat(F.array(F.struct(at.alias("pid"), F.lit(False).alias("tail"))), F.transform(F.filter(heads, lambda p: p.isNotNull()), lambda p: F.struct(p.alias("pid"), F.lit(True).alias("tail"))))
    rows = base.select("id", "text", F.explode(targets).alias("t")).select(F.col("t.pid").alias("pid"), F.col("t.tail").alias("tail"), "id", "text")
    return rows.repartition(max(n, len(cuts) + 1), "pid").sortWithinPartitions("pid", "tail", "id", "text")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points (rounded down) replaced by as many of the following text, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: int | None = KEPT) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    ``kept`` None: whole fingerprints, about 2.6 times as long as their texts, and exact likeness of them.
    A null text is empty.  "Next" is the row after in order of (id, text), nulls first, so rows that repeat follow each
    other; the last is followed by the first, a single row by itself.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def row(one, two) -> tuple:
        (i, text, own), other = one, edited(one[1], two[1])
        changed = marks(other, kept) if other != text else own
        return i, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), written(own), written(changed), alike(own, changed, kept), alike(own, two[2], kept)

    def batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_pid, ended, out, held = None, None, False, [], 0
        for b in batches:
            for pid, tail, i, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if pid != last_pid:
                    last, last_pid, ended = None, pid, False
                if ended:
                    continue
                ended = tail
                one = (i, text, marks(text, kept))
                if last is not None:
                    out.append(row(last, one))
                    held += len(out[-1][3]) + len(out[-1][4])
                    if held >= HELD:
                        yield batch(out, b.schema.field(2).type)
                        out, held = [], 0
                last = one
            if out:
                yield batch(out, b.schema.field(2).type)
                out, held = [], 0

    small_batches(docs.sparkSession)
    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
