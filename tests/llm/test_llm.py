"""The training-data operators against brute force, and their defined results for odd rows."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm import chat, language_id, lm_scoring, mixing, near_dedup, packing, queries, substring_dedup, syncmers, topk, toxicity
from driftloom.llm.common import mix64

SF = "/root/testdata/sf0.001"
ODD = [(1, ""), (2, None), (None, "a b c d e f g"), (3, "same words here in this line"), (3, "same words here in this line"), (4, "x " * 30_000), (5, "\t\n")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, "clash", 9) for i, t in ODD], "doc_id long, text string, node string, n int")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randrange(3, 120))] for _ in range(25)]
    rows = []
    for i in range(220):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    sets = [near_dedup.shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    old = near_dedup.SHORT_LIST
    for near_dedup.SHORT_LIST in (old, 3):  # also with lists in blocks
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == dict(enumerate(root))
    near_dedup.SHORT_LIST = old


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_near_duplicates_of_long_texts_equal_brute_force(spark):
    """Texts of 200 to 900 words keep more shingles than the lists do; words over which polynomial hashes collide stay apart."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(rng.randrange(200, 900))] for _ in range(40)]
    rows = []
    for i in range(300):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(0, 1 + len(t) // 22)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    for n in (1024, 4096):
        t = thue_morse(n)
        rows += [(len(rows), t), (len(rows) + 1, t.translate(str.maketrans("ab", "ba")))]
    rows += [(len(rows), "p q r s t p q r s t p q r s t u"), (len(rows) + 1, "P q r s t  p q r s t u")]  # equal sets, other words
    sets = [near_dedup.shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if root[i] != root[j] and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {i: (root[i], len(sets[i])) for i in range(len(rows))} and len(set(root)) < 250


def test_connected_components_equal_brute_force(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    root = {n: n for e in edges for n in e}
    for a, b in edges:
        x, y = root[a], root[b]
        root = {n: min(x, y) if r in (x, y) else r for n, r in root.items()}
    frame = lambda part: spark.createDataFrame(part, "a long, b long")
    first = near_dedup.connected_components(frame(edges[:140]))
    for labels in (near_dedup.connected_components(frame(edges)), near_dedup.connected_components(frame(edges[140:]), first)):
        got = {r.node: r.label for r in labels.collect()}
        members = {}
        for n, label in got.items():
            members.setdefault(label, set()).add(n)
        want = {}
        for n, r in root.items():
            want.setdefault(r, set()).add(n)
        drop = {e[0] for e in edges if e[0] == e[1]}
        assert sorted(map(sorted, members.values())) == sorted(sorted(m) for m in want.values() if len(m) > 1 or not m <= drop)


def test_members_of_a_node_are_confirmed(spark):
    """Two sets with one identity are noticed."""
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    sig = spark.createDataFrame([(i, 2, 7, near_dedup._words_digest(t)) for i, t in ((1, "a b c d e f"), (2, "g h i j k l"))], "id long, n long, node long, words binary")
    reps = sig.groupBy("node").agg(F.min("id").alias("rep"), F.min("words").alias("lo"), F.max("words").alias("hi"))
    assert near_dedup._unequal_members(sig, reps, docs, "doc_id", "text", 5)
    same = spark.createDataFrame([(1, "a b c d e"), (2, "A  b c d e")], "doc_id long, text string")
    assert not near_dedup._unequal_members(sig.withColumn("words", F.lit(near_dedup._words_digest("a b c d e"))), reps.withColumn("hi", F.col("lo")), same, "doc_id", "text", 5)


def test_near_duplicates_of_odd_rows(odd, empty):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.near_duplicates(odd).collect())
    assert got == [("1", 0, "1", True), ("2", 0, "2", True), ("3", 2, "3", True), ("3", 2, "3", True), ("4", 1, "4", True), ("5", 0, "5", True), ("None", 3, "None", True)]
    assert near_dedup.near_duplicates(empty).count() == 0


def test_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 9000, 6000).astype(np.uint64)) for _ in range(4)]
    assert (near_dedup.overlaps(sets[:2], sets[2:]) == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:2]]).all()


def test_packing_round_trip(spark, odd, empty):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.vocabulary())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = packing.pack_documents(docs, queries.vocabulary()).toPandas()
    for i, own in got.sort_values("piece").groupby("doc_id"):
        ids = np.array([*model.encode(text[i] or "", add_special_tokens=False).ids, 0], "<u4")
        assert own["length"].tolist() == [len(ids[a : a + 2048]) for a in range(0, len(ids), 2048)]
        assert own["ids_crc32"].tolist() == [zlib.crc32(ids[a : a + 2048].tobytes()) for a in range(0, len(ids), 2048)]
    by = got.sort_values(["sequence_id", "offset"])
    assert (by.groupby("sequence_id")["length"].cumsum() - by["length"] == by["offset"]).all()
    assert by.groupby("sequence_id")["length"].sum().max() <= 2048
    assert got["sequence_id"].nunique() <= 1.02 * -(-got["length"].sum() // 2048) + 1
    assert packing.pack_documents(odd, queries.vocabulary()).count() >= 7 and packing.pack_documents(empty, queries.vocabulary()).count() == 0


def test_plan_holds_each_length_as_often_as_it_occurs():
    rng = np.random.default_rng(1)
    have = np.bincount(np.minimum(2048, rng.geometric(0.003, 5000)), minlength=2049)
    used = np.zeros_like(have)
    for p, n in packing.plan_sequences(have, 2048):
        assert sum(p) <= 2048
        np.add.at(used, list(p), n)
    assert (used == have).all()


def plain_targets(totals, weights=(5, 2, 1), most=3):
    """Each source's words, by loops over exact fractions."""
    order = [*sorted((s for s in totals if s is not None), key=lambda s: s.encode()), *[None] * (None in totals)]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(totals.values()) - most * sum(totals[s] for s in capped)
        share = Fraction(left, max(1, sum(weight[s] for s in order if s not in capped)))
        above = {s for s in order if s not in capped and weight[s] * share > most * totals[s]}
        if not above:
            return {s: Fraction(most * totals[s]) if s in capped else weight[s] * share for s in order}
        capped |= above


def check_mix(got, rows):
    """``got``: rows of mix(); ``rows``: (id, source, size).  Targets, epochs and words taken as plain loops find them."""
    totals = {}
    for _, s, n in rows:
        totals[s] = totals.get(s, 0) + n
    goal, by = plain_targets(totals), {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    assert sorted((repr(r.doc_id), repr(r.source), r.size) for r in got) == sorted((repr(i), repr(s), n) for i, s, n in rows)
    for s, own in by.items():
        epochs = int(goal[s] // totals[s]) if totals[s] else 0
        missing = int(goal[s] - epochs * totals[s])
        for r in sorted(own, key=lambda r: (r.key, r.doc_id is not None, r.doc_id, r.size)):
            part = min(r.size, missing)
            missing -= part
            assert (r.taken, r.epochs, r.source_size) == (epochs * r.size + part, epochs, totals[s]) and r.target == pytest.approx(float(goal[s]), rel=1e-12)


def test_mixing_equals_brute_force(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    rng = random.Random(6)
    few = {"a": [5, 3, 9], "b": [100, 1], "c": [40], "\U0001f600": [2], "\uffee": [50, 60], "": [0, 0], None: [7, 7, 7, 0]}
    rows = [(k, s, n) for k, (s, n) in enumerate((s, n) for s, ns in few.items() for n in ns)]
    rows += [(3, "b", 8), (3, "b", 9), (3, "b", 9)]  # an id that repeats, with another size and with the same
    many = [(i, f"s{rng.randrange(700)}" if i % 3 else "hot", int(10 ** rng.uniform(0, 3))) for i in range(4000)]  # a third in one source
    shrunk = [(i, f"s{i}", 2**i) for i in range(12)]  # capped one after the other
    for some in (rows, many, shrunk):
        df = spark.createDataFrame(some, "doc_id long, source string, n long").selectExpr("*", "'clash' AS size", "1 AS key", "2 AS epochs", "3 AS weight", "4 AS rank", "5 AS w").repartition(5)
        got = mixing.mix(df, words_col="n", weight=F.when(F.col("doc_id") % 7 == 0, 2.0)).collect()
        check_mix(got, some)
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(2), words_col="n", weight=F.when(F.col("doc_id") % 7 == 0, 2.0)).collect()), key=repr)
    assert [float(x) for x in plain_targets({"a": 10, "b": 1000, None: 1}).values()] == [30.0, 978.0, 3.0]
    check_mix(mixing.mix(odd.withColumn("source", F.lit("s"))).collect(), [(i, "s", len((t or "").split())) for i, t in ODD])
    assert mixing.mix(empty).count() == 0
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")).collect()] == [0, 0]


def test_mixing_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    source = {i: s for i, s, _ in docs}
    goal, totals = plain_targets({s: sum(n for _, x, n in docs if x == s) for s in set(source.values())}), {}
    got = queries.op6_mixing(spark, SF).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, n) for i, _, n in docs)
    for r in got:
        s = source[r.doc_id]
        totals[s] = totals.get(s, 0) + r.taken
        assert r.taken <= 3 * r.size and r.target == pytest.approx(float(goal[s]))
    assert totals == {s: int(g) for s, g in goal.items()}


def cut_by_brute_force(rows):
    """The words of each text that stay, by the rule as it is stated, with plain loops."""
    n, reach = substring_dedup.UNIT_WORDS, substring_dedup.REACH
    words = {i: t.translate({x: x + 32 for x in range(65, 91)}).split(" ") for i, t in rows}

    def order(run):
        h = [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) for w in run]
        return sum(x * f for x, f in zip(h, substring_dedup.FACTORS, strict=True)) % substring_dedup.MODULUS

    first, later = {}, {}
    for i, w in words.items():
        keys = [order(w[k : k + n]) for k in range(len(w) - n + 1)]
        at = sorted({k for a in range(len(keys) - reach + 1) for k in range(a, a + reach) if keys[k] == min(keys[a : a + reach])})
        for k in at:
            j, p = first.setdefault(tuple(w[k : k + n]), (i, k))
            if (j, p) != (i, k):
                later.setdefault(i, []).append((k, j, p))
    kept = {}
    for i, w in words.items():
        runs, cut = [], set()
        for k, j, p in later.get(i, []):
            s = max(k, p + n) if j == i else k
            if runs and s <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], k + n)
                runs[-1][0] = min(runs[-1][0], s)
                runs[-1][3] = (k, j, p)
            else:
                runs.append([s, k + n, (k, j, p), (k, j, p)])
        for a, b, (k, j, p), (_, y, z) in runs:
            if b - a < substring_dedup.MIN_RUN:
                continue
            if a == k:
                for d in range(1, reach):
                    if p - d < 0 or k - d < (p + n if j == i else 0) or words[j][p - d] != w[k - d]:
                        break
                    a = k - d
            for d in range(reach - 1):
                if b >= len(w) or z + n + d >= len(words[y]) or words[y][z + n + d] != w[b]:
                    break
                b += 1
            cut.update(range(a, b))
        kept[i] = [x for k, x in enumerate(dict(rows)[i].split(" ")) if k not in cut]
    return kept


def test_dedup_passages_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared = [[word() for _ in range(k)] for k in (50, 50, 63, 90, 31, 200)]
    rows = []
    for i in range(90):
        w = [word() for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            k = rng.randrange(len(w) + 1)
            w[k:k] = p[rng.randrange(20) :] if rng.random() < 0.4 else p
        rows.append((i, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    loop = [word() for _ in range(17)]
    rows += [(90, "x " * 3000 + "x"), (91, " ".join(loop * 9)), (92, " ".join(shared[5] + loop * 4 + shared[5])), (93, rows[3][1]), (94, rows[3][1].upper())]
    want = cut_by_brute_force(rows)
    spaced = [(i, "".join(x + rng.choice([" ", "\n", "  ", "\t\x0b"]) for x in t.split(" "))) for i, t in rows]
    df = spark.createDataFrame(spaced, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r for r in substring_dedup.dedup_passages(df).collect()}
    assert {i: r.text.split() for i, r in got.items()} == want and sum(r.n_removed > 0 for r in got.values()) > 30
    n, seen = substring_dedup.PASSAGE_WORDS, set()
    for i, t in spaced:  # the spans say what went, and no passage of 50 words is left twice
        for s in reversed(got[i].removed):
            t = t[: s.start] + t[s.start + s.length :]
        assert t == got[i].text
        w = t.lower().split()
        for k in range(len(w) - n + 1):
            if i not in (90, 91, 92):
                assert (key := " ".join(w[k : k + n])) not in seen
                seen.add(key)


def test_dedup_passages_of_odd_rows(spark, empty):
    p, q = (" ".join(f"{c}{k}" for k in range(70)) for c in "pq")
    rows = [(1, f"a line\n{p} end", "c"), (2, f"start {p}", "c"), (2, f"start {p}", "c"), (None, p, None), (None, None, "c"), (3, "", "c"), (4, "\t\n", "c"), (5, "a line\nshort", "c"), (6, f"{q}\n" * 3, "c"), (7, "w" * 3_000_000, "c")]
    clash = spark.createDataFrame(rows, "doc_id long, text string, id string").selectExpr("*", "1 AS th", "2 AS cuts", "'x' AS n_removed", "3 AS pos", "4 AS removed", "'y' AS row")
    out = substring_dedup.dedup_passages(clash)
    assert out.columns == ["doc_id", "text", "id", "th", "cuts", "pos", "row", "n_removed", "removed"]
    got = [(r.doc_id, r.text if r.doc_id != 7 else len(r.text), r.n_removed) for r in out.collect()]
    want = [(1, f"a line\n{p} end", 0), (2, "start ", 1), (2, "start ", 1), (None, "", 1), (None, None, 0), (3, "", 0), (4, "\t\n", 0), (5, "a line\nshort", 0), (6, f"{q}\n\n", 1), (7, 3_000_000, 0)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert substring_dedup.dedup_passages(empty).count() == 0


def plain_mix(x):
    return int(mix64(np.array([x % (1 << 64)], np.uint64))[0])


def plain_hash(part):
    h = 0
    for c in part:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) % (1 << 64)
    return h


def plain_anchors(text):
    """{hash: first position} of all closed syncmers, by their definition."""
    k = min(syncmers.K, len(text))
    s = min(syncmers.S, k)
    out = {}
    for p in range(len(text) - k + 1 if text else 0):
        inner = [plain_mix(plain_hash(text[q : q + s])) for q in range(p, p + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.setdefault(plain_mix(plain_hash(text[p : p + k]) + k) >> 24, p)
    return out


def plain_kept(text):
    found = plain_anchors(text)
    return {h: found[h] for h in sorted(found)[: max(syncmers.KEPT, len(found) // syncmers.SHARE)]}


def plain_fingerprint(text):
    return ",".join(f"{h:010x}:{p:x}" for h, p in plain_kept(text).items())


def plain_likeness(a, b):
    x, y = plain_kept(a), plain_kept(b)
    if x == y:
        return 1.0
    union = sorted(x.keys() | y.keys())[: max(syncmers.KEPT, min(len(x), len(y)))]
    both = sorted((x[h], y[h]) for h in union if h in x and h in y)
    best = []
    for i, (_, q) in enumerate(both):
        best.append(1 + max([best[j] for j in range(i) if both[j][1] < q], default=0))
    return max(best, default=0) / len(union)


def test_a_long_text_keeps_more_anchors():
    rng = random.Random(11)
    text = "".join(rng.choice("abcdefghijkl ") for _ in range(40_000))
    f = syncmers.fingerprint(text)
    assert len(f.split(",")) > 4 * syncmers.KEPT
    parts = [text[a : a + 1000] for a in range(0, 40_000, 1000)]
    assert syncmers.likeness(f, syncmers.fingerprint("--".join(parts))) > 0.8  # an insertion every 1,000 characters
    assert syncmers.likeness(f, syncmers.fingerprint("".join(parts[::-1]))) < 0.3  # the same anchors in another order
    assert syncmers.likeness(f, "") == 0 and syncmers.longest_chain([3, 1, 2, 2, 5, 4]) == 3


def test_syncmers(spark, odd, empty):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    at = {p: h for h, p in zip(*(x.tolist() for x in syncmers.anchors(text)), strict=True)}
    moved = {p - 50: h for h, p in zip(*(x.tolist() for x in syncmers.anchors("z" * 50 + text)), strict=True)}
    assert len(at) > 100 and all(moved[p] == h for p, h in at.items())  # free of context
    f = syncmers.fingerprint(text)
    assert syncmers.likeness(f, f) == 1 and syncmers.likeness(f, syncmers.fingerprint(text[:2400])) > 0.5 > syncmers.likeness(f, syncmers.fingerprint(text[::-1]))
    docs = [(i, "".join(rng.choice("xyz äß") for _ in range(40 * i))) for i in range(9)]
    docs[7] = (7, docs[8][1][:150] + "inserted" + docs[8][1][150:])
    got = {r.doc_id: r for r in syncmers.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, (i, t) in enumerate(docs):
        n, after = len(t) // 4, docs[(k + 1) % 9][1]
        changed = t[: len(t) - n] + after[:n]
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and got[i].n_chars == len(t)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (plain_fingerprint(t), plain_fingerprint(changed))
        assert got[i].near_edited == pytest.approx(plain_likeness(t, changed)) and got[i].near_next == pytest.approx(plain_likeness(t, after))
    assert got[7].near_next > 0.7
    assert syncmers.fingerprints(odd).count() == 7 and syncmers.fingerprints(empty).count() == 0


def plain_whole_likeness(a, b):
    x, y = plain_anchors(a), plain_anchors(b)
    if x == y:
        return 1.0
    chain = []
    for q in (y[h] for _, h in sorted((p, h) for h, p in x.items()) if h in y):
        chain.append((q, 1 + max([n for r, n in chain if r < q], default=0)))
    return max([n for _, n in chain], default=0) / len(x.keys() | y.keys())


def test_op9_holds_and_counts_all_anchors(spark):
    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in queries.op9_document_fingerprints(spark, SF).collect()}
    assert len(got) == len(texts)
    seen = 0
    for (i, t), (_, after) in zip(texts, texts[1:] + texts[:1], strict=True):
        if len(t) + len(after) < 1500:
            changed = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
            assert [got[i].fingerprint, got[i].edited_fingerprint] == [",".join(f"{h:010x}:{p:x}" for h, p in sorted(plain_anchors(x).items())) for x in (t, changed)]
            assert got[i].near_edited == pytest.approx(plain_whole_likeness(t, changed)) and got[i].near_next == pytest.approx(plain_whole_likeness(t, after))
            seen += len(plain_anchors(t)) > syncmers.KEPT
    assert seen > 5


def test_whole_fingerprints_show_any_changed_word(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(600)]
    f = syncmers.fingerprint(" ".join(words), None)
    for k in range(3, 597, 9):
        near = syncmers.likeness(f, syncmers.fingerprint(" ".join([*words[:k], "zzz", *words[k + 1 :]]), None), None)
        assert 0.95 < near < 1
    part = syncmers.fingerprint(" ".join(words[:60]), None)  # a tenth of the text: all of the union counts
    assert syncmers.likeness(f, part, None) == syncmers.likeness(part, f, None) == pytest.approx(part.count(":") / f.count(":"), rel=0.05)
    assert syncmers.likeness(f, "", None) == syncmers.likeness("", f, None) == 0 and syncmers.likeness("", "", None) == 1
    big = [(i, "".join(rng.choices("abcdefgh ", k=600_000)) if i % 2 else None) for i in range(10)] + [(9, "x"), (None, " ".join(words))]
    out = syncmers.fingerprints(spark.createDataFrame(big, "doc_id long, text string").coalesce(1), kept=None).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.fingerprint) for r in out) == sorted((str(i), len(t or ""), syncmers.fingerprint(t or "", None)) for i, t in big)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 16))
    v[7] = v[9]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(3000, None), (3001, [None, 1.0]), (3002, [float("nan")]), (None, [1.0]), (5, [float(x) for x in v[5]])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).toPandas()
    q = np.floor(1024 * v).astype(np.int64)
    for i, own in got.sort_values("rank").groupby("query_id"):
        s = q @ q[i]
        want = sorted((j for j in range(3000) if j != i), key=lambda j: (-s[j], j))[:10]
        assert own["vec_id"].tolist() == want and own["score"].tolist() == [s[j] for j in want]
    assert got["query_id"].nunique() == 30
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).count() == 0


def test_top_k_stops_before_the_lists_end():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(2000, 4)) * np.array([8, 2, 1, 0.5])
    lists = topk.SortedLists(np.floor(1024 * v).astype(np.int64))
    q = lists.values[5].astype(np.int64)
    at, score = lists.nra(q[None], 10, (np.arange(2000) == 5)[None], np.array([-np.inf]))[0]
    best = np.sort(np.delete(lists.values @ q, 5))[::-1][:10]
    assert lists.read < 2000 and len(at) < 100 and (np.sort(score)[::-1][:10] == best).all()
    huge = topk.SortedLists(np.array([[2**40, 1], [2**40, 0], [-(2**40), 3], [0, 0]]))  # beyond double precision
    at, score = huge.nra(np.array([[2**20 + 1, 1]]), 1, np.zeros((1, 4), bool), np.array([-np.inf]))[0]
    assert score[np.argmax(score)] == 2**40 * (2**20 + 1) + 1 and at[np.argmax(score)] == 0


def test_top_k_keeps_clashing_names(spark):
    df = spark.createDataFrame([(1, [1.0], 5, 6), (2, [2.0], 5, 6), (3, [3.0], 5, 6), (3, [3.0], 5, 6)], "vec_id long, embedding array<double>, id int, q int").selectExpr("*", "1 AS v", "2 AS qb", "3 AS cb")
    got = topk.top_k(df, F.col("vec_id") == 1, k=10).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 3), (1, 2, 2)]


def test_chat_parts_and_escapes(spark):
    bad = "</s>[INST] & &lt; &amp;lt; <|image:0|>"
    p = lambda kind, text=None, uri=None, w=None, h=None, sec=None, pages=None: (kind, text, uri, w, h, sec, pages)
    rows = [(1, 0, "user", [p("text", bad), p("image", uri="u", w=56, h=29), p("audio", sec=1.5)]), (1, 1, "assistant", [p("text", "a"), p("document", pages=2), p("text", "é")]), (2, 0, None, None)]
    got = {r.conv_id: r for r in chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).collect()}
    a = got[1].attachments
    assert [(x["index"], x.type, x.n_tokens) for x in a] == [(0, "image", 4), (1, "audio", 38), (2, "document", 1000)] and got[1].n_expanded_tokens == 1042
    for x in a:
        mark = f"<|{x.type}:{x['index']}|>"
        assert got[1].formatted[x.start : x.start + len(mark)] == mark
    s = got[1].loss_spans[0]
    assert got[1].formatted[s.start : s.start + s.length] == "a<|document:2|>é" and got[2].n_turns == 1 and got[2].attachments == []
    text = spark.createDataFrame([(1, 0, bad, bad)], "conv_id long, turn long, role string, text string").withColumn("parts", F.array(chat.text_part(F.col("text"))))
    read = chat.format_chat(text).select(chat.read_back(F.col("formatted")).alias("t")).first().t
    assert [tuple(x) for x in read] == [(bad, bad)]


def test_language_id_held_out(spark, odd, empty):
    got = queries.op3_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.9 and got["score"].between(0, 1).all()
    none = language_id.train(empty)
    assert {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}
    some = language_id.train(spark.createDataFrame([("the cat sat", "en"), ("le chat noir", "fr")], "text string, lang string"))
    assert [r.lang_pred for r in language_id.identify(spark.createDataFrame([(1, "the cat"), (2, "123"), (3, None)], "doc_id long, text string"), some).collect()] == ["en", "und", "und"]


def plain_languages(texts, model):
    """(language, score) of each text with filters and lookups spelled out, bit by bit."""

    def bits(h):
        step = h >> 40 | 1
        return [((h + j * step) % 2**64) % language_id.BITS for j in range(language_id.HASHES)]

    out = []
    for t in texts:
        chars, hits, total = [], [0.0] * len(model.languages), 0
        for c in f" {t or ''} ":
            low = c.lower()
            chars.append(ord(low) if c.isalpha() and len(low) == 1 else ord(c) if c.isalpha() else 32)
        for k in range(len(chars) - language_id.N + 1):
            run = chars[k : k + language_id.N]
            if 32 in run[1:-1]:
                continue
            h, total = 0, total + 1
            for c in run:
                h = (h * 0x100000001B3 + c) % 2**64
            words = [model.table[b] for b in bits(plain_mix(h))]
            for i in range(len(hits)):
                hits[i] += all(int(w[i // 64]) >> (i % 64) & 1 for w in words)
        real = [max(0.0, x - total * float(f)) / max(1e-9, 1 - float(f)) for x, f in zip(hits, model.false_rate, strict=True)]
        if all(c == 32 for c in chars) or not real:
            out.append(("und", 0.0))
        else:
            out.append((model.languages[real.index(max(real))], max(real) / max(1e-9, sum(real))))
    return out


def test_language_id_equals_brute_force(spark):
    rng = random.Random(9)
    letters = {f"l{i:02}": "".join(rng.sample("abcdefghijklmnopqrstuvwxyzäößçé", 9)) for i in range(70)}  # two words of the table
    text = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randrange(2, 7))) for _ in range(n))
    rows = [(text(lang, 40), lang) for lang in letters for _ in range(4)]
    model = language_id.train(spark.createDataFrame([*rows, (None, "l00"), ("abc", None)], "text string, lang string"))
    assert model.languages == sorted(letters) and model.table.shape[1] == 2
    texts = [*(text(rng.choice(list(letters)), rng.randrange(1, 30)) for _ in range(60)), None, "", "12 !", "é", "İa bc", "z" * 300, "ab\nCD\tEF", rows[0][0], rows[0][0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS lang_pred", "0 AS score", "1 AS id")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs.repartition(3), model).collect()}
    for i, (lang, score) in enumerate(plain_languages(texts, model)):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score)


def plain_word_score(word, model):
    """Margin of one word: its weighted subsequences' weights, over the root of the sum of squared weights."""
    c, total, norm = [ord(x) for x in f"^{word}$"], 0.0, 0.0
    for places in toxicity.COMBOS:
        w = toxicity.DECAY ** (places[-1] - len(places))
        for i in range(len(c) - places[-1]):
            h = (c[i] + len(places)) % 2**64
            for j in places:
                h = (h * 0x100000001B3 + c[i + j]) % 2**64
            total += float(model.table[plain_mix(h) % toxicity.BUCKETS]) * w
            norm += w * w
    return total / math.sqrt(max(norm, 1e-6)) + model.bias


def test_toxicity_scores_equal_brute_force(spark):
    rng = random.Random(4)
    table = np.random.default_rng(4).normal(size=toxicity.BUCKETS).astype(np.float32)
    model = toxicity.ToxicityModel(table, -0.3, 2.0, 0.5)
    word = lambda n: "".join(rng.choice("abcdeé😀-") for _ in range(n))
    texts = [" ".join(word(rng.randrange(1, 12)) for _ in range(rng.randrange(1, 20))) for _ in range(30)]
    texts += [word(65), f"x {word(300)} y", "a b c d", "!!! ...", "A\u00a0B", texts[0], texts[0].upper()]

    def plain(text):
        margins = []
        for w in toxicity.words_of(text, True):
            parts = [w]
            if len(w) > toxicity.LONG:
                parts = [w[a : a + n] for n, step in toxicity.WINDOWS for a in range(0, max(1, len(w) - n + step), step)]
            margins += [plain_word_score(p, model) for p in parts]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, 2.0 * max(margins, default=-9.0) + 0.5))))

    rows = [*enumerate(texts), (100, None), (101, ""), (None, "a bc"), (102, " \t\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'kept' AS __score", "9 AS score").repartition(3)
    got = toxicity.score(docs, model).collect()
    assert sorted(repr((r.doc_id, round(r.score, 4), r["__score"])) for r in got) == sorted(repr((i, round(plain(t), 4), "kept")) for i, t in rows)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_the_collapsed_machine_equals_the_one_over_landmarks():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12)))
    marks, words = toxicity.Landmarks(sorted({word() for _ in range(60)})), [word() for _ in range(200)]
    w = np.random.default_rng(5).normal(size=len(marks.words))
    model = toxicity.ToxicityModel(marks.collapse(w), 0.25, 1.0, 0.0)
    assert np.allclose(model.word_scores(words), marks.map(words) @ w + 0.25, atol=1e-3)


def test_toxicity_query(spark):
    got = queries.op8_toxicity(spark, SF).collect()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(got) == n and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_toxicity_learns_planted_insults():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "re", "st"]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(500):
        t = [word() for _ in range(40)]
        if i % 5 == 0:
            t.insert(rng.randrange(40), rng.choice(["gloomwit", "zaddlepip"]))
        rows.append((" ".join(t), int(i % 5 == 0)))
    m = toxicity.fit_rows(rows)
    assert all((m.score(t) >= 0.5) == bool(y) for t, y in rows)
    assert m.score("an gloomxwit er") > m.score("an er onre") and m.score(None) < 0.5 and m.score("") < 0.5
    assert toxicity.fit_rows([]).score("anything") < 0.5
    for sep in ("", "-", "_"):  # runs without blanks are read to their end
        for _ in range(20):
            t = [word() for _ in range(60)]
            assert m.score(sep.join(t)) < 0.5
            t.insert(rng.randrange(40, 61), rng.choice(["gloomwit", "zaddlepip"]))
            assert m.score(sep.join(t)) >= 0.5
    long = "".join(chr(97 + i % 26) for i in range(1001))
    assert toxicity.words_of(long)[-1].endswith(long[-40:])


def test_toxicity_trains_past_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 200_000)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "re", "st"]) for _ in range(rng.randrange(1, 4)))
    texts = [" ".join([word() for _ in range(40)] + (["gloomwit"] if i % 5 == 1 else [])) for i in range(500)]
    texts[0] = "an er " * 50_000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(500)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).score("an er gloomwit on") >= 0.5


def test_lm_scores(spark, odd, empty):
    import math

    df = spark.createDataFrame([(1, "a b a b c"), (2, "A b"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.lm_scores(df).collect()}
    want = math.log(3 / 7) + math.log(3 / 3)
    assert math.isclose(got[2].log_score, want) and got[2].n_tokens == 2 and got[3].mean_log_score is None and got[3].log_score == 0
    for n in (1, 3):
        assert lm_scoring.lm_scores(df, order=n).count() == 3
    assert lm_scoring.lm_scores(odd).count() == 7 and lm_scoring.lm_scores(empty).count() == 0
    x = np.array([0, 1, 255, 256, 2**40, 2**64 - 1], np.uint64)
    assert len(lm_scoring.unpack_sorted(lm_scoring.pack_sorted(x[:0]))) == 0
    assert (lm_scoring.unpack(lm_scoring.pack(x)) == x).all() and (lm_scoring.unpack_sorted(lm_scoring.pack_sorted(x)) == x).all()


def test_lm_scores_equal_brute_force(spark, monkeypatch):
    """Trigrams over many small chunks and more parts than a chunk has n-grams."""
    import math
    from collections import Counter

    monkeypatch.setattr(lm_scoring, "PART_GRAMS", 3)
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(40)))) for i in range(60)]
    words = [t.split() for _, t in docs]
    count = Counter(tuple(w[k : k + n]) for w in words for n in (1, 2, 3) for k in range(len(w) - n + 1))
    total = sum(map(len, words))

    def score(g):
        if len(g) == 1:
            return math.log(count[g] / total)
        return math.log(count[g] / count[g[:-1]]) if count[g] >= 2 else math.log(0.4) + score(g[1:])

    got = {r.doc_id: r.log_score for r in lm_scoring.lm_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), order=3).collect()}
    for i, w in enumerate(words):
        assert math.isclose(got[i], sum(score(tuple(w[max(0, k - 2) : k + 1])) for k in range(len(w))), abs_tol=1e-9)


def test_pipeline_stages_equal_plain_code(spark):
    """Each stage on what the one before kept, held against plain code on the same rows."""
    from collections import Counter

    import corpus_pipeline as c
    from tokenizers import Tokenizer

    from driftloom.llm.common import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd_rows = [(10_001, None, None, None, None), (10_002, "", "en", "src1", 0), (10_003, "\t \n", "en", None, 3), (None, "no id here at all", "en", "src1", 17)]
    docs = docs.unionByName(spark.createDataFrame(odd_rows, docs.schema)).selectExpr("*", "1 AS score", "2 AS kept_id", "3 AS place", "4 AS own_id", "5 AS times")
    held = lambda df: {(r.doc_id, r.text) for r in df.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    one = materialize(c.toxicity_stage(spark, docs, SF), "one")
    assert one.columns == docs.columns and held(one) <= held(docs)  # with so few labels nothing may go
    gone = {i for i, _ in held(docs) - held(one)}
    assert sum(labels.get(i) == 0 for i in gone) <= 1 and not gone & {10_001, 10_002, 10_003, None}

    two = materialize(c.near_dedup_stage(spark, one, SF), "two")
    texts = sorted(((i, t) for i, t in held(one) if i is not None), key=lambda r: r[0])
    sets, root = {i: near_dedup.shingles(t) for i, t in texts}, {i: i for i, _ in texts}
    for i, _ in texts:
        for j, _ in texts:
            n = len(sets[i] & sets[j]) if j < i else 0
            if n and root[i] != root[j] and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    assert two.columns == docs.columns and {i for i, _ in held(two)} == {i for i in root if root[i] == i} | {None}

    three = materialize(c.substring_dedup_stage(spark, two, SF), "three")
    ranked = sorted(((i, t) for i, t in held(two) if i is not None and t and t.split()), key=lambda r: r[0])
    want = cut_by_brute_force([(i, " ".join(t.encode().decode().split())) for i, t in ranked])
    got = {r.doc_id: r for r in three.collect()}
    assert three.columns == docs.columns and {i: got[i].text.split() for i in want} == want
    assert all(r.n_chars == len(r.text) for r in got.values() if r.text is not None and r.doc_id in want and r.text != dict(ranked)[r.doc_id])

    four = materialize(c.mixing_stage(spark, three, SF), "four")
    size = {i: len((r.text or "").split()) for i, r in got.items()}
    totals = Counter()
    for i, r in got.items():
        totals[r.source] += size[i]
    goal, most, taken, times = plain_targets(dict(totals)), Counter(), Counter(), Counter()
    for r in four.collect():
        taken[r.source] += size[r.doc_id]
        times[r.doc_id] += 1
    for i, r in got.items():
        most[r.source] = max(most[r.source], size[i])
    assert four.columns == docs.columns and all(abs(goal[s] - taken[s]) <= most[s] for s in totals) and max(times.values()) <= 3
    assert all(times[i] == 1 for i in size if not size[i])

    model, pieces = Tokenizer.from_file(queries.vocabulary()), Counter()
    for r in four.collect():
        ids = np.array([*model.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            pieces[r.doc_id, k, a, zlib.crc32(ids[a : a + 2048].tobytes())] += 1
    five = c.packing_stage(spark, four, SF).toPandas()
    assert Counter((None if np.isnan(i) else int(i), k, a, x) for i, k, a, x in five[["doc_id", "piece", "start", "ids_crc32"]].itertuples(index=False)) == pieces
    by = five.sort_values(["sequence_id", "offset"])
    assert (by.groupby("sequence_id")["length"].cumsum() - by["length"] == by["offset"]).all() and by.groupby("sequence_id")["length"].sum().max() <= 2048


def test_pipeline_stages_of_an_empty_table(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in c.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
