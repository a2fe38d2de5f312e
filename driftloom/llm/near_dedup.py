"""MinHash near-duplicate detection with bottom-k sketches of one hash function.

Stages, all of them distributed:

1. ``signatures``: per document the number of distinct shingles, a 64-bit identity of the shingle set
   (equal sets become one *node*), a digest of the words in order and the bottom-64 sketch.  Members of a node whose
   words differ are compared on their full sets; should they differ, another hash function is taken.
2. Frequent shingles, counted over all documents' retained values, are put last in the order of the hash.
   The number that is broadcast is bounded (``HOT_VALUES``); any choice of them leaves the result the same,
   it only decides how long the inverted lists get.
3. ``postings``: what each node retains in that order.  A node retains its first ``|A| - ceil(t|A|) + 1``
   values, of which two linked sets share at least one (pigeonhole); where most of its values are
   infrequent, the first 32 of these do (two linked sets miss each other with probability below 1e-7).
4. Inverted lists of the retained values generate candidate pairs.  Each list has a hub.  In rounds, each node meets one
   hub of its lists (the one of most lists first) that is not in its component yet; those that are linked fall into
   one component, pairs within which need no comparison.  Then what is outside a list's
   largest component meets the rest of the list: pair by pair in short lists, in long ones block by block as a matrix
   of overlaps of which only links come out.  An entry's place in its node's order tells whether enough of the set
   is left for the overlap (positional filter).  No list is expanded into all its pairs, and none is cut.
5. The estimate from the union's sketch drops pairs that are far below the threshold (over 6 standard
   deviations); the rest are confirmed on the full sets of shingle strings.

Defined results: null or wordless texts have no shingles and are linked with nothing; rows with a null id
take no part (component null, kept); rows that repeat are copies; ties go to the smallest id.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, hash_grams, hash_words, materialize, mix64, release, small_batches

SHINGLE, SKETCH, RETAIN, SEEN_NODES = 5, 64, 32, 200_000
#: Lists up to this length are compared pair by pair, longer ones in blocks of so many members.
SHORT_LIST, BLOCK_NODES = 32, 256
#: Frequent shingles that are broadcast at most (8 bytes each).
HOT_VALUES = 1 << 20
#: A value counts as frequent from so many nodes that have it among their 16 lowest.
HOT_LEAST = 6


def shingles(text: str | None, k: int = SHINGLE) -> set[bytes]:
    """The distinct word k-grams of a text; the whole sequence if it is shorter."""
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def _sets(texts: list[str | None], k: int, seed: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = [(t or "").encode().lower() for t in texts]
    salt = np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
    for a, b in blocks(data):
        words, at = hash_words(data[a:b], seed)
        grams = mix64(hash_grams(words, k) ^ salt)
        for i in range(b - a):
            lo, n = int(at[i]), int(at[i + 1] - at[i])
            if n >= k:
                yield np.unique(grams[lo : lo + n - k + 1])
            else:
                yield mix64(hash_grams(words[lo : lo + n], n) ^ salt) if n else np.empty(0, np.uint64)


def _identity(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix64(np.array([s.sum(dtype=np.uint64) + np.uint64(len(s))])).view(np.int64)[0])


def _words_digest(text: str | None) -> bytes:
    """Equal for texts of equal words in equal order, whose shingle sets are equal too."""
    return hashlib.blake2b(b" ".join((text or "").encode().lower().split()), digest_size=16).digest()


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int = SHINGLE, seed: int = 0) -> DataFrame:
    """(id, n, node, words, sketch) for each row; sketch in ascending order of the unsigned hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, node, sketch, texts = [], [], [], b.column(1).to_pylist()
            for s in _sets(texts, k, seed):
                n.append(len(s))
                node.append(_identity(s))
                sketch.append(s[:SKETCH].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(map(_words_digest, texts), pa.binary()), pa.array(sketch, pa.list_(pa.int64()))],
                names=["id", "n", "node", "words", "sketch"],
            )

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n long, node long, words binary, sketch array<long>")


def _unequal_members(own: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> bool:
    """Whether a node holds two different sets: its members of other words are held against those of the lowest digest."""
    mixed = reps.where("lo != hi").select("node", "lo")
    if not mixed.limit(1).count():
        return False
    members = own.join(mixed, "node").groupBy("node", "lo", "words").agg(F.min("id").alias("mid"))

    def keep_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # an id may stand on several rows
            yield b.filter(pa.array([_words_digest(t) == w for t, w in zip(b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True)], pa.bool_()))

    rows = docs.select(F.col(id_col).alias("did"), F.col(text_col).alias("text")).join(members, F.col("did") == F.col("mid")).select("node", "lo", "words", "text")
    rows = materialize(rows.mapInArrow(keep_own, rows.schema).dropDuplicates(["node", "words"]), "members")
    low = rows.where("words = lo").select("node", F.col("text").alias("other"))

    def unequal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(["node"]).filter(pa.array([shingles(x, k) != shingles(y, k) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], pa.bool_()))

    found = rows.where("words != lo").join(low, "node").select("node", "text", "other").mapInArrow(unequal, "node long").limit(1).count()
    release(rows)
    return found > 0


def _postings(docs: DataFrame, id_col: str, text_col: str, k: int, seed: int, threshold: tuple[int, int], hot) -> DataFrame:
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = hot.value, set()
        for b in batches:
            values, nodes, sizes, places = [], [], [], []
            for s in _sets(b.column(0).to_pylist(), k, seed):
                if not len(s):
                    continue
                node = _identity(s)
                if node in seen:  # a copy within this task
                    continue
                if len(seen) < SEEN_NODES:
                    seen.add(node)
                at = np.searchsorted(frequent, s)
                is_hot = frequent[np.minimum(at, len(frequent) - 1)] == s if len(frequent) else np.zeros(len(s), bool)
                cold = s[~is_hot]
                r = len(s) - -(-num * len(s) // den) + 1
                if len(cold) >= 0.6 * len(s):
                    kept = cold[: min(r, RETAIN)]
                else:
                    kept = np.concatenate((cold, s[is_hot]))[:r]
                values.append(kept.view(np.int64))
                nodes.append(np.full(len(kept), node, np.int64))
                sizes.append(np.full(len(kept), len(s), np.int64))
                places.append(np.arange(len(kept), dtype=np.int64))
            if values:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (values, nodes, sizes, places)], names=["value", "node", "n", "pos"])

    return docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text")).mapInArrow(run, "value long, node long, n long, pos long")


def _contract(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges between the labels of their ends, once each and without those within one label; an end without one is its own."""
    for end in ("a", "b"):
        own = labels.select(F.col("node").alias(end), "label")
        edges = edges.join(own, end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    return edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, label) for each node of the undirected edges (a, b) and of ``known``, earlier labels that the edges extend.

    Each node is hooked to its least neighbour, the trees are flattened by pointer jumping and the edges contracted to
    those between trees, of which few are left; so the rows handled stay near the number of edges.
    """
    edges = edges.select("a", "b")
    rest = materialize(_contract(edges, known) if known is not None else edges.where("a != b").distinct(), "edges")
    ends = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = materialize(ends.select("node", F.col("node").alias("label")), "labels")
    while rest.limit(1).count():
        hooks = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        hooks = materialize(hooks.select("node", F.least("node", "b").alias("label")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("label"), F.col("label").alias("top"))
            step = materialize(hooks.join(up, "label").select("node", F.col("top").alias("label"), (F.col("top") != F.col("label")).alias("moved")), "hooks")
            release(hooks)
            hooks = step
            if not hooks.where("moved").limit(1).count():
                break
        hooks, old = hooks.select("node", "label"), hooks
        joined = labels.join(hooks.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left")
        step = materialize(joined.select("node", F.coalesce("top", "label").alias("label")), "labels")
        fewer = materialize(_contract(rest, hooks), "edges")
        release(labels, rest, old)
        labels, rest = step, fewer
    release(rest)
    if known is None:
        return labels
    moved = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
    whole = known.join(moved, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    out = materialize(whole.unionByName(labels.join(known.select("node"), "node", "left_anti")), "labels")
    release(labels)
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def _estimate(pairs: DataFrame, threshold: float) -> DataFrame:
    """Drops pairs whose union sketch puts them over 6 standard deviations below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            col = {n: b.column(n) for n in ("sa", "sb")}
            for i in range(b.num_rows):
                x, y = (np.asarray(col[n][i].values, dtype=np.int64).view(np.uint64) for n in ("sa", "sb"))
                union = np.union1d(x, y)[:SKETCH]
                both = np.isin(union, x, assume_unique=True) & np.isin(union, y, assume_unique=True)
                least = threshold - 6 * math.sqrt(threshold * (1 - threshold) / len(union))
                keep[i] = both.mean() >= least
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, k: int, threshold: tuple[int, int]) -> DataFrame:
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            ta, tb = b.column("ta"), b.column("tb")
            for i, a in enumerate(b.column("a").to_pylist()):
                if a != last:
                    last, left = a, shingles(ta[i].as_py(), k)
                right = shingles(tb[i].as_py(), k)
                common = len(left & right)
                keep[i] = den * common >= num * (len(left) + len(right) - common)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (smallest id reachable over links), kept, node.

    ``threshold``: a fraction (numerator, denominator) that the Jaccard similarity must reach.
    """
    spark = docs.sparkSession
    for seed in range(8):
        sig = materialize(signatures(docs, id_col, text_col, k, seed), "signatures")
        own = sig.where((F.col("n") > 0) & F.col("id").isNotNull())
        reps = materialize(own.groupBy("node").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("words").alias("lo"), F.max("words").alias("hi")), "nodes")
        if not _unequal_members(own, reps, docs, id_col, text_col, k):
            break  # else two different sets got one identity; another hash function parts them
        release(sig, reps)
    else:
        raise RuntimeError("shingle sets could not be told apart by 8 hash seeds")

    # frequent values: a histogram of the counts (few rows) gives the cut that keeps the broadcast bounded
    low = own.select("node", F.explode(F.slice("sketch", 1, 16)).alias("value")).distinct()
    counts = low.groupBy("value").count().where(F.col("count") >= HOT_LEAST)
    counts = materialize(counts, "frequent")
    cut, total = HOT_LEAST, 0
    for c, n in counts.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).limit(HOT_VALUES).collect():
        total += n
        if total > HOT_VALUES:
            cut = c + 1
            break
    found = np.sort(np.array([r[0] for r in counts.where(F.col("count") >= cut).select("value").toLocalIterator()], np.int64).view(np.uint64))
    hot = spark.sparkContext.broadcast(found)
    release(counts)

    base = _postings(docs, id_col, text_col, k, seed, threshold, hot).repartition(F.col("value")).dropDuplicates(["value", "node"])
    order = F.xxhash64("node")
    stats = base.groupBy("value").agg(F.count("*").alias("size"), F.min(F.struct((F.col("pos") * 7 > F.col("n")).alias("far"), order.alias("h"), "node", "n", "pos")).alias("hub"))
    lists = base.join(stats.where("size > 1"), "value").select("value", "node", "n", "pos", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.pos").alias("hub_pos"))
    lists = materialize(lists, "lists")
    fits = _may_link(threshold)
    pair = (F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    sketches = own.join(reps.select("node", F.col("rep").alias("id")), ["node", "id"]).select("node", "sketch").dropDuplicates(["node"])
    source = (docs, id_col, text_col, reps, sketches, k, seed, threshold)
    meets = materialize(lists.where("node != hub").where(fits).groupBy("node", "hub").agg(F.count("*").alias("c")), "meets")
    taken, labels = [], None
    n_nodes, left = reps.count(), meets.count()
    while left:
        if left > n_nodes // 2:  # one hub a node, so that no group's pairs outgrow its rows
            one = meets.groupBy("node").agg(F.max(F.struct("c", F.xxhash64("hub").alias("h"), "hub")).alias("m")).select("node", F.col("m.hub").alias("hub"))
        else:
            one = meets.select("node", "hub")
        checked, star = _confirm(one.select(*pair), *source)
        taken.append(checked)
        old, labels = labels, connected_components(star, labels)
        release(old, star)
        other = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
        rest = meets.join(labels, "node", "left").join(other, "hub", "left")
        rest = rest.where(F.coalesce("label", "node") != F.coalesce("hub_label", "hub")).select("node", "hub", "c", *pair)
        rest = materialize(rest.join(_union(taken), ["a", "b"], "left_anti").select("node", "hub", "c"), "meets")
        release(meets)
        meets, left = rest, rest.count()
    release(meets)
    if labels is None:
        nothing = spark.createDataFrame([], "a long, b long")
        taken, labels = [nothing], spark.createDataFrame([], "node long, label long")
    entries = lists.where("node != hub").join(labels, "node", "left").select("value", "node", "n", "pos", "hub", F.coalesce("label", "node").alias("comp"))
    per = entries.groupBy("value", "comp").agg(F.count("*").alias("c"))
    major = per.groupBy("value").agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("comps"), F.sum("c").alias("size"))
    major = major.where("comps > 1").select("value", F.col("m.comp").alias("major"), "size")
    entries = materialize(entries.join(major, "value"), "entries")
    release(lists)
    outside = F.col("comp") != F.col("major")
    short = entries.where(F.col("size") <= SHORT_LIST)
    ones = short.where(outside).select("value", F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("pos").alias("hub_pos"), F.col("comp").alias("hub_comp"))
    near = short.drop("hub").withColumnRenamed("value", "__v").join(ones, (F.col("__v") == F.col("value")) & (F.col("comp") != F.col("hub_comp")) & fits)
    pairs = near.select(*pair).unionByName(_block_links(entries.where(F.col("size") > SHORT_LIST), outside, source))
    met, more = _confirm(pairs.join(_union(taken), ["a", "b"], "left_anti"), *source)
    old, labels = labels, connected_components(more, labels)
    release(entries, met, more, old, *taken)

    lowest = labels.join(reps.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("component"))
    moved = labels.join(lowest, "label").select("node", "component")
    whole = reps.select("node", "rep").join(moved, "node", "left").select("node", F.coalesce("component", "rep").alias("component"))
    at = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    out = sig.join(whole, "node", "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), at).alias("component_id"), "node"
    )
    kept: Column = F.col("id").eqNullSafe(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"), "node")


def _may_link(threshold: tuple[int, int]) -> Column:
    """Whether two entries of a list, (n, pos) and (hub_n, hub_pos), may be those of the first value that a linked pair
    has in common: their sizes fit, and what follows in the order is enough for the overlap."""
    num, den = threshold
    sizes = F.least("n", "hub_n") * den >= F.greatest("n", "hub_n") * num
    left = F.least(F.col("n") - F.col("pos"), F.col("hub_n") - F.col("hub_pos"))
    return sizes & (left * (num + den) >= (F.col("n") + F.col("hub_n")) * num)


def _own_texts(texts: DataFrame, k: int, seed: int) -> DataFrame:
    """The rows (node, text) whose text has the identity ``node``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_identity(s) for s in _sets(b.column(1).to_pylist(), k, seed)]
            yield b.filter(pa.array([x == y for x, y in zip(got, b.column(0).to_pylist(), strict=True)], pa.bool_()))

    return texts.select("node", "text").mapInArrow(run, "node long, text string")


def _texts(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, reps: DataFrame, k: int, seed: int) -> DataFrame:
    """(node, text) of the wanted nodes, one row each."""
    wanted = wanted.distinct().join(reps.select("node", F.col("rep").alias("__id")), "node")
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    texts = materialize(own.join(wanted.hint("merge"), "__id").select("node", "text"), "texts")  # one plan at every size
    # an id that stands on several rows brings other texts along: only one that has the node's identity stays
    if texts.groupBy("node").count().where("count > 1").limit(1).count():
        own = materialize(_own_texts(texts, k, seed).dropDuplicates(["node"]), "texts")
        release(texts)
        texts = own
    return texts


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set."""
    flat = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x])) for x in (left, right)]
    common = np.intersect1d(flat[0][0], flat[1][0])
    at = []
    for values, rows in flat:
        col = np.searchsorted(common, values)
        hit = common[np.minimum(col, len(common) - 1)] == values if len(common) else np.zeros(len(values), bool)
        order = np.argsort(col[hit], kind="stable")
        at.append((col[hit][order], rows[hit][order]))
    out = np.zeros((len(left), len(right)), np.float64)
    for a in range(0, len(common), 4096):
        dense = []
        for (col, rows), x in zip(at, (left, right), strict=True):
            lo, hi = np.searchsorted(col, [a, a + 4096])
            m = np.zeros((len(x), min(4096, len(common) - a)), np.float32)
            m[rows[lo:hi], col[lo:hi] - a] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _block_links(entries: DataFrame, outside: Column, source: tuple) -> DataFrame:
    """Links (a, b) between what is outside the largest component of a long list and all of the list.

    Members are compared in blocks of BLOCK_NODES by BLOCK_NODES as a matrix of overlaps; only links that join two
    components are returned, at most one per member of the two blocks.  Lists of one hub are handled together.
    """
    docs, id_col, text_col, reps, _, k, seed, (num, den) = source
    members = materialize(entries.groupBy("hub", "node").agg(F.max(outside).alias("out"), F.max("comp").alias("comp")), "members")
    size = members.groupBy("hub").agg(F.count("*").alias("n"), F.count_if("out").alias("m"))
    blocks_of = lambda c: F.ceil(F.col(c) / BLOCK_NODES).cast("int")
    size = size.select(F.col("hub").alias("g"), blocks_of("n").alias("all_blocks"), blocks_of("m").alias("out_blocks"))
    texts = _texts(members.select("node"), docs, id_col, text_col, reps, k, seed)
    rows = members.select(F.col("hub").alias("g"), "node", "out", "comp").join(texts, "node").join(size, "g")
    own = lambda c: F.pmod(F.xxhash64("node", F.lit(3)), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = rows.where("out").select("g", "node", "comp", "text", own("out_blocks").alias("i"), every("all_blocks").alias("j"))
    right = rows.select(F.col("g").alias("h"), F.col("node").alias("node_y"), F.col("comp").alias("comp_y"), F.col("text").alias("text_y"), every("out_blocks").alias("p"), own("all_blocks").alias("q"))

    def run(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        if len(x) and len(y):
            sx, sy = list(_sets(x["text"].tolist(), k, seed)), list(_sets(y["text_y"].tolist(), k, seed))
            both = overlaps(sx, sy)
            nx, ny = np.array([len(s) for s in sx]), np.array([len(s) for s in sy])
            linked = den * both >= num * (nx[:, None] + ny[None, :] - both)
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while root.setdefault(c, c) != c:
                    c = root[c]
                return c

            xn, yn, xc, yc = x["node"].tolist(), y["node_y"].tolist(), x["comp"].tolist(), y["comp_y"].tolist()
            for i, j in zip(*np.nonzero(linked), strict=True):
                p, q = find(xc[i]), find(yc[j])
                if p != q:
                    root[p] = q
                    found.append((min(xn[i], yn[j]), max(xn[i], yn[j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return left.groupBy("g", "i", "j").cogroup(right.groupBy("h", "p", "q")).applyInPandas(run, "a long, b long")


def _confirm(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, reps: DataFrame, sketches: DataFrame, k: int, seed: int, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """The distinct pairs (a, b), and those of them that are linked."""
    pairs = pairs.distinct()
    pairs = materialize(pairs, "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sketches = materialize(sketches.join(nodes, "node"), "sketches")
    side = lambda c: sketches.select(F.col("node").alias(c), F.col("sketch").alias(f"s{c}"))
    likely = materialize(_estimate(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb"), threshold[0] / threshold[1]), "likely")
    release(sketches)
    texts = _texts(likely.select(F.explode(F.array("a", "b")).alias("node")), docs, id_col, text_col, reps, k, seed)
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}"))
    both = likely.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb")
    links = materialize(_verify(both, k, threshold), "links")
    release(likely, texts)
    return pairs, links
