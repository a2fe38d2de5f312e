"""Language identification with bit-sliced Bloom filters over character n-grams.

Training counts letter n-grams by language on a bounded sample (``SAMPLE_PER_LANGUAGE``) and keeps, for each language,
the n-grams that are clearly its own share of the counts.  All languages' filters have the same bits; they are stored
bit-sliced: word i of the table holds, as one bit per language, bit i of every filter.  A lookup ANDs the words at an
n-gram's positions and so returns all languages that contain it at once.  A document's hits per language, less the
false positives expected from the filter's fill, decide.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix64, release, small_batches

N, BITS, HASHES = 4, 1 << 19, 3
#: Training rows per language, about, at most; chosen by a hash of their text.
SAMPLE_PER_LANGUAGE = 3_000
#: N-grams per language, at most, the most frequent first.
MOST_GRAMS = 40_000
#: A language keeps an n-gram of which it has at least this share of the sum of the languages' relative frequencies.
LEAST_SHARE = 0.3
BLOCK_CHARS = 1_000_000
UNKNOWN = "und"


@functools.cache
def _fold() -> np.ndarray:
    """For each code point: 32 for anything but a letter, else the lower-case letter."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def grams(texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, document index, has a letter): n-grams of letters and single word edges, no edge inside."""
    joined = " " + "  ".join(t or "" for t in texts) + " "
    c = _fold()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    size = np.array([len(t or "") + 2 for t in texts], np.int64)
    ends = np.cumsum(size)
    letter = c != 32
    doc_of = np.repeat(np.arange(len(texts)), size)
    has = np.bincount(doc_of, letter[: len(doc_of)], len(texts)) > 0
    m = len(c) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), has
    ok = letter[1:][:m].copy()
    for j in range(1, n - 1):
        ok &= letter[j : j + m]
    at = np.flatnonzero(ok)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + c[at + j]
    return mix64(h), np.searchsorted(ends, at, "right"), has


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= BLOCK_CHARS:
            yield a, i + 1
            a, total = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


@dataclasses.dataclass(frozen=True)
class LanguageFilters:
    """languages in order of code points; table: (BITS, words of 64 languages)."""

    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray

    @staticmethod
    def positions(h: np.ndarray) -> list[np.ndarray]:
        step = h >> np.uint64(40) | np.uint64(1)
        with np.errstate(over="ignore"):
            return [((h + np.uint64(j) * step) % np.uint64(BITS)).astype(np.int64) for j in range(HASHES)]

    @classmethod
    def build(cls, by_language: dict[str, np.ndarray]) -> LanguageFilters:
        languages = sorted(by_language)
        table, rate = np.zeros((BITS, max(1, -(-len(languages) // 64))), np.uint64), np.zeros(len(languages))
        for i, name in enumerate(languages):
            filled = np.zeros(BITS, bool)
            for p in cls.positions(by_language[name]):
                filled[p] = True
            table[filled, i // 64] |= np.uint64(1 << (i % 64))
            rate[i] = filled.mean() ** HASHES
        return cls(languages, table, rate)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (share of the corrected hits) of each text."""
        h, doc, has = grams(texts)
        words = self.table[self.positions(h)[0]] if len(h) else np.empty((0, self.table.shape[1]), np.uint64)
        for p in self.positions(h)[1:]:
            words = words & self.table[p]
        total = np.bincount(doc, minlength=len(texts))
        hits = np.zeros((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            bit = (words[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(float)
            hits[:, i] = np.bincount(doc, bit, len(texts))
        real = np.maximum(0, hits - total[:, None] * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = real.argmax(1)
        score = real[np.arange(len(texts)), best] / np.maximum(real.sum(1), 1e-9)
        return [self.languages[b] if x else UNKNOWN for b, x in zip(best, has, strict=True)], np.where(has, np.clip(score, 0, 1), 0.0)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageFilters:
    """Fits the filters to a bounded sample of the rows with a text and a language."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return LanguageFilters.build({})
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, SAMPLE_PER_LANGUAGE / n))])
    rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), object)
            for lang in dict.fromkeys(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for a, z in _slices(own):
                    h, c = np.unique(grams(own[a:z])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(c, pa.int64())], names=["lang", "gram", "c"])

    counts = rows.mapInArrow(count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    counts = materialize(counts, "grams")  # read twice, written once
    sums = {r["lang"]: r["s"] for r in counts.groupBy("lang").agg(F.sum("c").alias("s")).collect()}
    weight = F.create_map(*[F.lit(x) for k, s in sums.items() for x in (k, 1.0 / max(1, s))])
    freq = counts.withColumn("f", F.col("c") * weight[F.col("lang")])
    whole = freq.groupBy("gram").agg(F.sum("f").alias("total"), F.collect_list(F.struct("lang", "f")).alias("by"))
    own = whole.select("gram", "total", F.explode("by").alias("x")).where(F.col("x.f") >= LEAST_SHARE * F.col("total")).select("gram", F.col("x.lang").alias("lang"), F.col("x.f").alias("f"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("f"), "gram"))
    top = own.withColumn("rank", rank).where(F.col("rank") <= MOST_GRAMS).select("lang", "gram").toPandas()  # MOST_GRAMS rows a language
    by = {lang: np.sort(top["gram"][top["lang"] == lang].to_numpy(np.int64).view(np.uint64)) for lang in sizes}
    release(counts)
    return LanguageFilters.build(by)


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def identify(docs: DataFrame, model: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row.  Null texts and texts without a letter are ``und``; ties go to the first language
    by code points; with no language learned all are ``und``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BITS words per 64 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs, scores = b.column(1).to_pylist(), [], []
            for a, z in _slices(texts):
                x, y = shared.value.predict(texts[a:z])
                langs += x
                scores.append(y)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate([np.empty(0), *scores]))], names=["id", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
