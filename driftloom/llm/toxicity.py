"""Toxicity with a subsequence string-kernel support vector machine and Nystroem landmarks.

The kernel of two words counts their common subsequences of three characters within five places and of four with one
skipped, each weighted by ``DECAY`` per character skipped, so an insult with characters inserted or left out stays close to itself.
Landmarks are words; the Nystroem map turns a word into its kernel values with them, whitened, and a squared-hinge
SVM is fitted there.  The kernel is an inner product of subsequence counts, hence the machine is linear in these too:
its landmarks and weights collapse exactly into one weight per (hashed) subsequence, and a word is scored by summing
them, whatever the number of landmarks.

Labels are given by row, not by word.  Training takes sentences' words from a bounded sample of labelled rows, starts
from words and stems that significantly more toxic than clean rows hold, adds their corrupted variants, and
alternates between fitting and picking what it finds in toxic rows and wrongly finds in clean ones.  A row's score is
that of its worst word or window of a long word, calibrated.
"""

from __future__ import annotations

import dataclasses
import itertools
import math
import random
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, small_batches

BUCKETS, WINDOW, DECAY = 1 << 20, 5, 0.6
#: Places of the characters after the first: three within WINDOW, and four with one skipped at most.
COMBOS = [(j, k) for k in range(2, WINDOW) for j in range(1, k)] + [(1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4)]
#: Labelled rows of each class, about, that training reads at most; characters of them kept on the driver at most.
SAMPLE_ROWS, SAMPLE_CHARS = 1_200, 16_000_000
LANDMARKS, ROUNDS, CACHE_WORDS = 480, 4, 400_000
#: Words of the sampled rows that the machine is fitted to, at most: insults to begin with and more in each round; those
#: among them that get corrupted variants; frequent and (at random) rare words of clean rows; hard ones more in each round.
INSULTS, VARIED, FREQUENT, RARE, HARD = 4_000, 400, 4_000, 12_000, 4_000
#: Words of more than LONG characters (joined runs, URLs, text without blanks) are read as windows, (characters, step): in
#: training those of the first size, in scoring all, as an insult counts for less the more stands beside it in its window.
LONG, WINDOWS = 64, ((64, 16), (24, 4), (12, 2))
STRIP = ".,;:!?\"'()[]{}<>*_-~`"


def windows_of(word: str, sizes: tuple[tuple[int, int], ...] = WINDOWS) -> Iterator[str]:
    """Overlapping parts of a word, in each size from its first to its last character."""
    for n, step in sizes:
        for a in range(0, max(1, len(word) - n + step), step):
            yield word[a : a + n]


def words_of(text: str | None, whole: bool = False) -> list[str]:
    """Lower-case words without outer punctuation; three or more single characters in a row count as one word too.

    Words of more than ``LONG`` characters stand as windows of that size unless ``whole``.
    """
    out = [w.strip(STRIP) or w for w in (text or "").lower().split()]
    if sum(1 for w in out if len(w) == 1) > 2:
        run, extra = [], []
        for w in [*out, ""]:
            if len(w) == 1:
                run.append(w)
            else:
                if len(run) > 2:
                    extra.append("".join(run))
                run = []
        out += extra
    if not whole and any(len(w) > LONG for w in out):
        out = [part for w in out for part in (windows_of(w, WINDOWS[:1]) if len(w) > LONG else (w,))]
    return out


def _occurrences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, weight, word) of every subsequence; words are framed by ^ and $."""
    framed = [f"^{w}$" for w in words]
    c = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(f) for f in framed], np.int64)
    of = np.repeat(np.arange(len(words)), size)
    ends = np.repeat(np.cumsum(size), size)
    at = np.arange(len(c))
    buckets, weights, word = [], [], []
    with np.errstate(over="ignore"):
        for places in COMBOS:
            i = np.flatnonzero(at + places[-1] < ends)
            h = c[i] + np.uint64(len(places))
            for j in places:
                h = h * np.uint64(0x100000001B3) + c[i + j]
            buckets.append((mix64(h) & np.uint64(BUCKETS - 1)).astype(np.int64))
            weights.append(np.full(len(i), DECAY ** (places[-1] - len(places)), np.float32))
            word.append(of[i])
    return np.concatenate(buckets), np.concatenate(weights), np.concatenate(word)


def _norms(words: list[str]) -> np.ndarray:
    """Root of the sum of squared weights: a rescaling by the word's length."""
    n = np.array([len(w) + 2 for w in words], float)
    return np.sqrt(np.maximum(1e-6, sum(np.maximum(0, n - p[-1]) * DECAY ** (2 * (p[-1] - len(p))) for p in COMBOS)))


class Landmarks:
    """Kernel values with a list of words, whitened: the Nystroem map."""

    def __init__(self, words: list[str]):
        self.words = words
        bucket, weight, word = _occurrences(words)
        used, own = np.unique(bucket, return_inverse=True)
        self.index = np.full(BUCKETS, len(used), np.int32)
        self.index[used] = np.arange(len(used))
        self.used = used
        self.table = np.zeros((len(used) + 1, len(words)), np.float32)
        np.add.at(self.table, (own, word), weight / _norms(words)[word])
        gram = self.kernel(words)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2 + 1e-3 * np.eye(len(words)))
        self.white = (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)), np.float32)
        for a in range(0, len(words), 1000):
            part = words[a : a + 1000]
            bucket, weight, word = _occurrences(part)
            at = self.index[bucket]
            hit = at < len(self.used)
            np.add.at(out[a : a + 1000], word[hit], self.table[at[hit]] * weight[hit, None])
            out[a : a + 1000] /= _norms(part)[:, None]
        return out

    def map(self, words: list[str]) -> np.ndarray:
        return self.kernel(words) @ self.white.astype(np.float32)

    def collapse(self, w: np.ndarray) -> np.ndarray:
        """Weight of each bucket for the SVM weights w in the landmarks' space."""
        out = np.zeros(BUCKETS, np.float32)
        out[self.used] = self.table[: len(self.used)] @ (self.white @ w)
        return out


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM in the primal by Newton steps over the support vectors; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    w = np.zeros(x.shape[1])
    eye = ridge * np.eye(len(w))
    eye[-1, -1] = 1e-6
    for _ in range(30):
        active = np.flatnonzero(y * (x @ w.astype(np.float32)) < 1)
        gram, rhs = eye.copy(), np.zeros(len(w))
        for a in range(0, len(active), 4000):
            part = x[active[a : a + 4000]].astype(np.float64)
            own = part * weight[active[a : a + 4000], None]
            gram += own.T @ part
            rhs += own.T @ y[active[a : a + 4000]]
        new = np.linalg.solve(gram, rhs)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


@dataclasses.dataclass
class ToxicityModel:
    table: np.ndarray
    bias: float
    slope: float
    offset: float

    def __post_init__(self):
        self.cache: dict[str, float] = {}

    def __getstate__(self):
        return self.table, self.bias, self.slope, self.offset

    def __setstate__(self, s):
        self.table, self.bias, self.slope, self.offset = s
        self.cache = {}

    def word_scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.empty(0)
        bucket, weight, word = _occurrences(words)
        return np.bincount(word, self.table[bucket] * weight, len(words)) / _norms(words) + self.bias

    def worst(self, text: str | None) -> float:
        """Margin of the worst word, or window of a long one; -9 for no words."""
        words, most = words_of(text, True), -9.0
        parts = (part for w in words if len(w) > LONG for part in windows_of(w))
        while some := list(itertools.islice(parts, 20_000)):
            most = max(most, float(self.word_scores(some).max()))
        words = [w for w in words if len(w) <= LONG]
        for a in range(0, len(words), CACHE_WORDS // 2):
            part = words[a : a + CACHE_WORDS // 2]
            new = list(set(part).difference(self.cache))
            if new:
                if len(self.cache) + len(new) > CACHE_WORDS:
                    self.cache.clear()
                    new = list(set(part))
                for z in range(0, len(new), 20_000):
                    self.cache.update(zip(new[z : z + 20_000], self.word_scores(new[z : z + 20_000]).tolist(), strict=True))
            most = max(most, max(map(self.cache.__getitem__, part)))
        return most

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.worst(text) + self.offset))))


def corrupted(word: str, rng: random.Random, n: int = 8) -> Iterable[str]:
    """Variants with a character inserted or doubled, or separators between all."""
    for _ in range(n):
        i = rng.randrange(1, len(word)) if len(word) > 1 else 0
        yield rng.choice([word[:i] + rng.choice("abcdefghijklmnopqrstuvwxyz0123456789.-_*") + word[i:], word[:i] + word[max(0, i - 1)] + word[i:], rng.choice(".-_*").join(word)])


def _units(word: str) -> list[str]:
    """The word and its stems (beginnings, marked with +), by which words that only share their beginning count together."""
    return [word, *(f"{word[:k]}+" for k in (4, 5, 6) if len(word) > k)]


def fit_rows(rows: list[tuple[str | None, int]], prior: float | None = None, seed: int = 7) -> ToxicityModel:
    """Fits the model to (text, label) rows; ``prior``: share of label 1 among all labelled rows."""
    rng = random.Random(seed)
    every, apart_rows = rows, [r for r in rows if zlib.crc32((r[0] or "").encode()) % 4 == 0]
    if sum(y for _, y in apart_rows) >= 5 and sum(1 - y for _, y in apart_rows) >= 5:  # these only calibrate
        rows = [r for r in rows if zlib.crc32((r[0] or "").encode()) % 4]
    else:
        apart_rows = rows
    n1, n0 = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    none = ToxicityModel(np.zeros(BUCKETS, np.float32), -1.0, 1.0, -4.0)
    if not n1 or not n0:
        return none
    toxic, clean = Counter(), Counter()
    for t, _ in (r for r in rows if r[1]):
        toxic.update({u for w in set(words_of(t)) for u in _units(w)})
    for t, _ in (r for r in rows if not r[1]):
        clean.update({u for w in set(words_of(t)) for u in _units(w) if u == w or u in toxic})
    # rows that are copies of each other are one piece of evidence: a unit counts once for equal neighbours
    doubtful = {u for u, n in toxic.items() if n > 2 and n > 4 * clean[u]}
    seen: set[tuple[str, str, str]] = set()
    apart = Counter()
    for t, _ in (r for r in rows if r[1]):
        words, own = ["", *words_of(t), ""], set()
        for i in range(1, len(words) - 1):
            for u in _units(words[i]):
                if u in doubtful and (key := (u, words[i - 1], words[i + 1])) not in seen:
                    seen.add(key)
                    own.add(u)
        apart.update(own)
    share = n1 / (n1 + n0)
    tests = max(100, len(toxic))

    def surprise(u: str) -> float:
        """Log of a bound (Chernoff) on the chance that so many of the rows that hold u are toxic."""
        a, b = apart[u], clean[u]
        if not a:
            return 0.0
        p = a / (a + b)
        if p <= max(share, 0.9):
            return 0.0
        return (a + b) * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0))

    limit = math.log(tests / 0.05)
    seeds = sorted((u for u in doubtful if surprise(u) > limit), key=lambda u: (-surprise(u), u))
    stems = {u[:-1] for u in seeds if u.endswith("+")}
    seeds = [u for u in seeds if not u.endswith("+")]
    seeds += [w for w in sorted(toxic, key=lambda w: (-toxic[w], w)) if not w.endswith("+") and w not in set(seeds) and clean[w] == 0 and any(w[:k] in stems for k in (4, 5, 6))]
    seeds = [w for w in seeds if len(w) > 2]
    if not seeds:
        return none
    plain = [w for w in clean if not w.endswith("+")]
    plain.sort(key=lambda w: (-clean[w], w))
    common, rare = plain[:FREQUENT], plain[FREQUENT:]
    rng.shuffle(rare)
    positive, negative = list(dict.fromkeys(seeds))[:INSULTS], common + rare[:RARE]
    half = LANDMARKS // 2
    variety = list(dict.fromkeys([*seeds[: half // 2], *rng.sample(positive, min(len(positive), half // 2))]))
    marks = Landmarks(variety + rng.sample(negative, min(len(negative), LANDMARKS - half)))
    model = none
    for turn in range(ROUNDS):
        extra = [v for w in positive[:VARIED] for v in corrupted(w, rng, 4)]
        words = positive + extra + negative
        y = np.array([1.0] * (len(positive) + len(extra)) + [-1.0] * len(negative))
        per = np.array([1.0 + min(20.0, apart[w] / 5) for w in positive] + [0.2] * len(extra) + [1.0] * len(negative))
        per[y > 0] *= max(1.0, 0.25 * len(negative) / max(1, len(positive) + len(extra)))
        w, b = fit_svm(marks.map(words), y, per)
        model = ToxicityModel(marks.collapse(w), b, 1.0, 0.0)
        if turn == ROUNDS - 1:
            break
        # what the machine finds in toxic rows that no clean row holds, and what it wrongly finds in clean ones
        known = set(positive) | set(negative)
        candidates = [u for u in toxic if not u.endswith("+") and clean[u] == 0 and u not in known]
        s = np.concatenate([model.word_scores(candidates[a : a + 20_000]) for a in range(0, len(candidates), 20_000)] or [np.empty(0)])
        positive += [candidates[i] for i in np.flatnonzero(s > 0.5)][:INSULTS]
        s = np.concatenate([model.word_scores(rare[a : a + 20_000]) for a in range(0, len(rare), 20_000)] or [np.empty(0)])
        hard = [rare[i] for i in np.argsort(-s)[:HARD] if s[i] > -0.9]
        hard = [h for h in hard if h not in known]
        negative += hard
        if hard:  # what is hard to tell apart makes the best landmarks
            marks = Landmarks(variety + hard[: (LANDMARKS - half) * 2 // 3] + rng.sample(negative, min(len(negative), (LANDMARKS - half) // 3)))
    # calibration on rows apart, weighted to the prior of all labelled rows; a weak prior keeps the slope near 3
    margin = np.clip([model.worst(t) for t, _ in apart_rows], -3, 3)
    label = np.array([y for _, y in apart_rows], float)
    n1, n0 = label.sum(), (1 - label).sum()
    prior = sum(y for _, y in every) / len(every) if prior is None else min(max(prior, 1e-4), 1 - 1e-4)
    per = np.where(label > 0, prior / n1, (1 - prior) / n0)
    mean, weak = np.array([3.0, -3.0]), np.array([2e-3, 1e-4])
    fit = mean.copy()
    x = np.column_stack([margin, np.ones(len(margin))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        hess = (x * (per * p * (1 - p))[:, None]).T @ x + np.diag(weak)
        step = np.linalg.solve(hess, x.T @ (per * (label - p)) - weak * (fit - mean))
        step *= min(1.0, 2 / max(1e-9, abs(step).max()))
        fit = fit + step
        if abs(step).max() < 1e-6:
            break
    a, c = fit
    model.slope, model.offset = float(a), float(c)
    model.cache.clear()
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fits to a bounded sample (``SAMPLE_ROWS`` a class, chosen by a hash of the id) of labelled rows of ``docs``."""
    lab = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__y"))
    sizes = {r["__y"]: r["count"] for r in lab.groupBy("__y").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return fit_rows([])
    share = F.when(F.col("__y") == 1, min(1.0, SAMPLE_ROWS / sizes[1])).otherwise(min(1.0, 2 * SAMPLE_ROWS / sizes[0]))
    picked = lab.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.select(id_col, F.col(text_col).alias("__t")).join(F.broadcast(picked), id_col)  # 3 * SAMPLE_ROWS small rows
    rows = rows.select("__t", "__y", F.xxhash64(F.col(id_col).cast("string")).alias("__h")).repartition(8, "__h").sortWithinPartitions("__h")
    got, chars = [], 0
    for r in rows.toLocalIterator():
        text = r[0] or ""
        if len(text) > SAMPLE_CHARS // 16:  # a passage of a long text, so that no text takes the place of all others
            at = random.Random(r["__h"]).randrange(len(text) - SAMPLE_CHARS // 16)
            text = text[at : at + SAMPLE_CHARS // 16]
        if chars + len(text) <= SAMPLE_CHARS:
            chars += len(text)
            got.append((text, r[1]))
    return fit_rows(got, sizes[1] / (sizes[0] + sizes[1]))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``: 0 to 1, higher for likelier toxic.  Null, empty and wordless texts score low;
    rows that repeat score alike; an empty table stays empty; a column called ``name`` is replaced, all others stay as they are."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    @F.pandas_udf("double")
    def rate(texts):
        import pandas as pd

        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return docs.withColumn(name, rate(F.col(text_col)))
