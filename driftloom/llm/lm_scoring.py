"""Stupid-backoff language-model scores, computed relationally over packed columns.

Relations, all keyed and joined by Spark; only what is inside a cell is packed, sorted arrays instead of a row a token:

* ``records`` (chunk, ids, sizes, words, tokens): the corpus as word numbers, some million tokens a chunk.
* requests (level, part, chunk, grams, counts): each chunk's n-grams, exploded and counted in it, dealt by hash range.
  An n-gram that is everywhere costs one entry a chunk.  Cells without an n-gram don't exist, so there are never more
  cells than distinct n-grams of the chunks, however many parts there are; no number of parts is a cap.
* the count tables, one per (level, part): counts of all chunks added up, answered as totals (chunk, level, part).
* the answers joined to their chunk's record, where each document's n-gram scores are looked up and summed.

Score of w after h: ``c(h w) / c(h)`` if ``c(h w) >= min_count``, else ``backoff`` times the score of w after the
shorter history; of a word alone ``c(w) / tokens``.  N-grams don't cross documents; counts cover all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _STEP, blocks, hash_words, materialize, mix64, partitions, small_batches

ORDER, BACKOFF, MIN_COUNT = 2, 0.4, 2
#: Tokens of a chunk, about, and distinct n-grams of a part of the count tables, about.
CHUNK_TOKENS, PART_GRAMS = 1_000_000, 2_000_000


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, as many as the largest needs, after a byte with their number."""
    x = x.astype("<u8")
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : b[0]] = planes.T
    return out.view("<u8").reshape(-1)


def pack_sorted(x: np.ndarray) -> bytes:
    """The first value, then the packed differences."""
    return x[:1].astype("<u8").tobytes() + pack(np.diff(x)) if len(x) else b""


def unpack_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.empty(0, np.uint64)
    return np.cumsum(np.concatenate((np.frombuffer(b, "<u8", 1), unpack(b[8:]))), dtype=np.uint64)


def _levels(words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, place of the last word, hash) of all n-grams of 1 to ``order`` words within documents."""
    w = words[tokens]
    ends = np.repeat(np.cumsum(sizes), sizes)
    yield 1, np.arange(len(w)), w
    for n in range(2, order + 1):
        m = len(w) - n + 1
        if m <= 0:
            yield n, np.empty(0, np.int64), np.empty(0, np.uint64)
            continue
        at = np.flatnonzero(ends[:m] == ends[n - 1 :])
        with np.errstate(over="ignore"):
            h = np.full(len(at), n, np.uint64)
            for j in range(n):
                h = h + w[at + j] * _STEP[j]
        yield n, at + n - 1, mix64(h)


def records(docs: DataFrame, id_col: str, text_col: str, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, ids, sizes, hashes, have = TaskContext.get().partitionId(), 0, [], [], [], 0
        type_ = None

        def flush() -> pa.RecordBatch:
            words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{task}-{k}"]), pa.array([ids], pa.list_(type_)), pa.array([sizes], pa.list_(pa.int64())), pa.array([pack_sorted(words)]), pa.array([pack(tokens.reshape(-1))])],
                names=["chunk", "ids", "sizes", "words", "tokens"],
            )

        for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            type_ = b.schema.field(0).type
            own, texts = b.column(0).to_pylist(), [(t or "").encode().lower() for t in b.column(1).to_pylist()]
            for a, z in blocks(texts):
                h, at = hash_words(texts[a:z])
                hashes.append(h)
                ids += own[a:z]
                sizes += np.diff(at).tolist()
                have += len(h)
                if have >= chunk_tokens:
                    yield flush()
                    k, ids, sizes, hashes, have = k + 1, [], [], [], 0
        if ids:
            yield flush()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"chunk string, ids array<{kind}>, sizes array<long>, words binary, tokens binary")


def requests(corpus: DataFrame, order: int, bits: int) -> DataFrame:
    """Each chunk's distinct n-grams by level and part, which is given by a hash's first ``bits`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, sizes, words, tokens in zip(*(b.column(c).to_pylist() for c in ("chunk", "sizes", "words", "tokens")), strict=True):
                for level, _, h in _levels(unpack_sorted(words), unpack(tokens).astype(np.uint32), np.array(sizes, np.int64), order):
                    grams, counts = np.unique(h, return_counts=True)
                    part = (grams >> np.uint64(1)) >> np.uint64(63 - bits)
                    cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(grams)]
                    spans = [(int(part[x]), x, y) for x, y in zip(cut[:-1], cut[1:], strict=True) if y > x]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([level] * len(spans), pa.int32()), pa.array([p for p, _, _ in spans], pa.int64()), pa.array([chunk] * len(spans), pa.string()), pa.array([pack_sorted(grams[x:y]) for _, x, y in spans], pa.binary()), pa.array([pack(counts[x:y]) for _, x, y in spans], pa.binary())],
                        names=["level", "part", "chunk", "grams", "counts"],
                    )

    return corpus.select("chunk", "sizes", "words", "tokens").mapInArrow(run, "level int, part long, chunk string, grams binary, counts binary")


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    """The count table of one (level, part), and from it each chunk's answer."""
    grams = [unpack_sorted(g) for g in rows["grams"]]
    every = np.concatenate(grams)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    counts = np.concatenate([unpack(c) for c in rows["counts"]])[order].astype(np.int64)
    totals, keys = np.add.reduceat(counts, first), every[first]
    return pd.DataFrame({"chunk": rows["chunk"], "level": rows["level"], "part": rows["part"], "totals": [pack(totals[np.searchsorted(keys, g)]) for g in grams]})


def _score(order: int, backoff: float, min_count: int, all_tokens: int):
    def run(key, corpus: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, sizes, words, tokens in zip(corpus["ids"], corpus["sizes"], corpus["words"], corpus["tokens"], strict=True):
            sizes, tokens = np.asarray(sizes, np.int64), unpack(tokens).astype(np.uint32)
            total = {}
            for level, own in answers.sort_values(["level", "part"]).groupby("level"):
                total[level] = np.concatenate([unpack(t) for t in own["totals"]]).astype(np.float64)
            score, history = np.full(len(tokens), -math.inf), np.zeros(len(tokens))
            for level, at, h in _levels(unpack_sorted(words), tokens, sizes, order):
                count = np.zeros(len(tokens))
                if len(at):
                    count[at] = total[level][np.unique(h, return_inverse=True)[1].reshape(-1)]
                if level == 1:
                    score = np.log(count / all_tokens)
                else:
                    seen = np.zeros(len(tokens), bool)
                    seen[at] = count[at] >= min_count
                    longer = np.zeros(len(tokens), bool)
                    longer[at] = True
                    past = np.concatenate(([1.0], history[:-1]))  # count of the words before
                    with np.errstate(divide="ignore", invalid="ignore"):
                        score = np.where(seen, np.log(count / past), np.where(longer, math.log(backoff) + score, score))
                history = count
            of = np.repeat(np.arange(len(sizes)), sizes)
            out.append(pd.DataFrame({"id": list(ids), "n_tokens": sizes, "log_score": np.bincount(of, score, len(sizes)) if len(of) else np.zeros(len(sizes))}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "n_tokens": [], "log_score": []})

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """Per row: id, n_tokens, log_score (sum of natural logs over the document), mean_log_score (null without tokens).

    Words are runs outside 0x20 and 0x09-0x0D, A-Z in lower case.  Null and wordless texts have 0 tokens and a score of
    0; rows that repeat count, and are scored, as often as they stand; an empty table gives no rows.
    """
    spark = docs.sparkSession
    corpus = materialize(records(docs, id_col, text_col), "corpus")
    tokens = corpus.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    asked = requests(corpus, order, (partitions(spark, tokens, PART_GRAMS) - 1).bit_length())
    answers = asked.groupBy("level", "part").applyInPandas(_count, "chunk string, level int, part long, totals binary")
    kind = docs.schema[id_col].dataType.simpleString()
    found = corpus.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_score(order, backoff, min_count, max(1, tokens)), f"id {kind}, n_tokens long, log_score double")
    return found.select(F.col("id").alias(id_col), "n_tokens", "log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")).alias("mean_log_score"))
