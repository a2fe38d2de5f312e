"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

A document's key is exponential with its quality weight as rate, drawn from a hash of its id: equal on reruns.
Within a source the documents are taken in ascending order of the key until the words reach the source's budget.
Keys are split into quantile buckets whose sums are enough to tell which buckets are taken whole; only the one bucket
per source in which the budget ends is sorted, so a source with most of the rows isn't handled by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, release

#: Documents per bucket of keys, on average, at most.
BUCKET_ROWS = 2_000


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(per: DataFrame) -> DataFrame:
    """``per`` with the column ``rank``, from 0, of its sources by code point, null last; no task sees all of them."""
    order = F.col("source").isNull(), F.col("source")
    n = partitions(per.sparkSession, 0, 1)
    rows = materialize(per.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "sources")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    held = rows.groupBy(part.alias("part")).agg(F.count("*").alias("held"))  # a row a partition
    ahead = held.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("ahead"))
    out = materialize(rows.withColumn("part", part).join(ahead, "part").withColumn("rank", F.col("ahead") + place).drop("at", "part", "ahead"), "ranks")
    release(rows)
    return out


def targets(per: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``per`` (source, size, ...) with ``target`` and ``words`` (it rounded down): the sum of all sizes shared by weight,
    dealt to the sources in order, none above ``most`` times its own size; what is above is shared again.

    A word of weight 1 is worth ``left / free``; raising it only caps more sources, so the sums over the capped and the
    free ones, two numbers a round, are all that the rounds pass on.
    """
    per = ranked(per).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    whole, every = per.agg(F.sum("size"), F.sum("weight")).first()
    left, free = whole or 0, every or 1
    cap = F.col("size") * most
    while True:
        full = F.expr(f"(weight * {left} + {free} - 1) div {free}") > cap
        capped, rest = per.agg(F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        now = (whole or 0) - (capped or 0), rest or 1
        if now == (left, free):
            break
        left, free = now
    share = (F.col("weight") * left).cast("double") / float(free)
    return per.withColumn("target", F.when(full, cap.cast("double")).otherwise(share)).withColumn("words", F.when(full, cap).otherwise(F.expr(f"weight * {left} div {free}")))


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__s")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", words_col: str | None = None, weight: Column | None = None, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 0) -> DataFrame:
    """Per row: id, source, size, source_size, target, taken, epochs, key.  ``words_col``: sizes that are known already.

    Whole epochs come first: ``floor(target / source_size)`` times every document.  The rest of the target is filled in
    order of the key; the last document gives only the words that are still missing, so a source's words are its target
    rounded down.  ``weight`` (positive; null or not positive: 1) makes a document likelier to be taken.
    Null or wordless texts have size 0 and nothing is taken from them; null sources are a source of their own;
    rows that repeat count as often as they stand; ties of the key go to the smaller id, then the smaller size; an empty table gives no rows.
    """
    spark = docs.sparkSession
    w = F.lit(1.0) if weight is None else F.when(weight > 0, weight.cast("double")).otherwise(1.0)
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), (F.coalesce(F.col(words_col), F.lit(0)).cast("long") if words_col else word_count(F.col(text_col))).alias("size"), w.alias("w"), uniform.alias("u"))
    rows = rows.select("id", "source", "size", (-F.log("u") / F.col("w")).alias("key"))
    rows = materialize(rows, "sizes")
    per = targets(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), weights, most)
    epochs = F.expr("CASE WHEN size > 0 THEN words div size ELSE 0 END")
    plan = per.select(
        _key(), F.col("size").alias("source_size"), "target", epochs.cast("int").alias("epochs"), (F.col("words") - epochs * F.col("size")).alias("budget"),
        F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS)).cast("long").alias("buckets"),
    )
    rows = rows.withColumn("__s", _key()).join(plan, "__s")  # Spark broadcasts the plan if its written size allows it
    # for rate w the key is exponential: exp(-key) is uniform for w = 1 and keeps the order for all
    rows = rows.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")), F.col("buckets") - 1))
    sums = rows.groupBy("__s", "bucket").agg(F.sum("size").alias("in_bucket"), F.max("budget").alias("budget"))
    before = F.sum("in_bucket").over(Window.partitionBy("__s").orderBy("bucket")) - F.col("in_bucket")
    sums = sums.select("__s", "bucket", "in_bucket", before.alias("before"))
    rows = rows.join(sums, ["__s", "bucket"])
    cut = (F.col("before") < F.col("budget")) & (F.col("before") + F.col("in_bucket") > F.col("budget"))
    run = F.sum("size").over(Window.partitionBy("__s", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    whole = rows.where(~cut).withColumn("part", F.when(F.col("before") < F.col("budget"), F.col("size")).otherwise(0))
    edge = rows.where(cut).withColumn("run", run)
    edge = edge.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("budget") - F.col("before") - F.col("run") + F.col("size")))).drop("run")
    out = whole.unionByName(edge)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), "epochs", "key")
