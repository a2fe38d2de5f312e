"""A training corpus from ``documents``: five stages, each over all that the one before kept.

1. toxicity: documents scored 0.5 or more go.
2. near-duplicates: one document of each group stays, the one with the smallest id.
3. substring dedup: repeated passages of 50 words or more are cut, the first occurrence stays; n_chars is that of the new text.
4. mixing: documents are repeated or left out so that each source comes near its target.
5. packing: the mix as token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.llm import language_id, mixing, near_dedup, packing, queries, substring_dedup, toxicity
from driftloom.llm.common import free_name, materialize, release


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go; the model learns from the labels outside the held-out fold.

    Null, empty and wordless texts score low and stay; rows without an id stay or go by their text; rows that repeat fare
    alike; without labels of both kinds nothing goes; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels.where(~language_id.held_out(F.col("doc_id"))))
    score = free_name(docs, "score")
    return toxicity.score(docs, model, name=score).where(F.col(score) < 0.5).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest id.

    Null and wordless texts are linked with nothing and stay; rows without an id take no part and stay; of rows that
    share an id the first by text stays; an empty table stays empty.
    """
    found = near_dedup.near_duplicates(docs.select("doc_id", "text"))
    own, place = free_name(docs, "kept_id"), free_name(docs, "place")
    kept = materialize(found.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(own)), "kept")
    out = docs.join(kept.dropDuplicates([own]), F.col("doc_id") == F.col(own), "left_semi")
    if kept.groupBy(own).count().where("count > 1").limit(1).count():
        out = out.withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(place) == 1)
    out = out.select(*docs.columns)
    if docs.where("doc_id IS NULL").limit(1).count():
        out = out.unionByName(docs.where("doc_id IS NULL"))
    return out


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, without the passages of 50 words or more that an earlier one has; null texts stay null."""
    cut = substring_dedup.dedup_passages(docs)
    size = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", size).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one where a source's budget ends counts from half its words on.

    Null and wordless texts add no words and stay once; null sources are a source; rows that repeat an id count as
    often as they stand, each as often as the id's largest share; an empty table stays empty.
    """
    sized = queries.quality_weight(spark, sf_dir, docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("__n")))
    plan = mixing.mix(sized, words_col="__n", weight=F.col("__w"))
    times, own, nth = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int"), free_name(docs, "own_id"), free_name(docs, "times")
    plan = plan.groupBy(F.col("doc_id").alias(own)).agg(F.max(times).alias(nth)).where(F.col(nth) > 0)
    both = docs.join(plan, F.col("doc_id").eqNullSafe(F.col(own)))
    return both.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(nth)))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset; null and empty texts are a piece of the end id, rows that repeat are packed
    as often as they stand, an empty table gives no rows."""
    return packing.pack_documents(docs.select("doc_id", "text"), queries.vocabulary())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A learned classifier, iterated linking and a tokenizer are beyond SQL; tests/llm run the stages one after the other and hold each against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
