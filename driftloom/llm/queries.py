"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, language_id, lm_scoring, mixing, near_dedup, packing, substring_dedup, syncmers, topk, toxicity

VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def quality_weight(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, source, text) with the column __w: 2 for labelled good, 0.5 for labelled bad, else 1."""
    labels = _table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("__q"))
    return docs.join(labels, "doc_id", "left").withColumn("__w", F.when(F.col("__q") == 1, 2.0).when(F.col("__q") == 0, 0.5).otherwise(1.0)).drop("__q")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scoring.lm_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_tokens", F.round("mean_log_score", 4).alias("mean_log_score"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.explode(F.array(F.lit("user"), F.lit("assistant"))).alias("role")).select(F.lit(-7).cast("long").alias("conv_id"), F.when(F.col("role") == "user", 0).otherwise(1).cast("long").alias("turn"), "role", F.lit(said).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    made = chat.format_chat(turns.withColumn("parts", F.array(chat.text_part(F.col("text")))))
    read = made.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.under_mask(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "n_expanded_tokens", F.size("attachments").cast("long").alias("n_attachments"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~out).select("text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("node")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality_weight(spark, sf_dir, _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words")))
    return mixing.mix(docs, words_col="words", weight=F.col("__w")).select("doc_id", "size", "source_size", "target", "taken")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = language_id.held_out(F.col("doc_id"))
    model = toxicity.train(docs, labels.where(~out))
    found = toxicity.score(docs, model).drop("text")
    return found.select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"), kept=None)


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_lm_scoring, op2_chat_formatting, op3_language_id, op4_minhash_near_dedup, op5_best_fit_packing, op6_mixing, op7_substring_dedup, op8_toxicity, op9_document_fingerprints, op10_exact_topk, pipeline)
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_BLANK, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
_UNIT, _REACH = substring_dedup.UNIT_WORDS, substring_dedup.REACH
_ORDER = " + ".join(f"lead(h, {j}) OVER o * {f}" for j, f in enumerate(substring_dedup.FACTORS))

ORACLE_SQL: dict[str, str] = {
    "op1_lm_scoring": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS w2, unnest([NULL] || w[:-2]) AS w1 FROM d),
u AS (SELECT w2 AS w, count(*) AS c FROM t GROUP BY 1),
b AS (SELECT w1, w2, count(*) AS c FROM t WHERE w1 IS NOT NULL GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM t),
s AS (SELECT t.doc_id, CASE WHEN t.w1 IS NULL THEN ln(u2.c / n.n) WHEN b.c >= 2 THEN ln(b.c / u1.c) ELSE ln(0.4) + ln(u2.c / n.n) END AS s
  FROM t CROSS JOIN n JOIN u u2 ON u2.w = t.w2 LEFT JOIN u u1 ON u1.w = t.w1 LEFT JOIN b ON b.w1 = t.w1 AND b.w2 = t.w2),
a AS (SELECT doc_id, sum(s) AS s FROM s GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_tokens, round(a.s / nullif(len(d.w), 0), 4) AS mean_log_score FROM d LEFT JOIN a USING (doc_id)""",
    "op2_chat_formatting": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, 9 + length(role) + 1 + 11 + length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;')) AS n FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS s,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(n) AS n FROM e GROUP BY 1)
SELECT conv_id, n_turns, sha256(s) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, n::BIGINT AS formatted_chars,
  0::BIGINT AS n_expanded_tokens, 0::BIGINT AS n_attachments FROM g""",
    "op10_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10""",
    "op7_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '{_BLANK}*{_WORD}') AS p FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, unnest(range(len(p)))::INT AS k, unnest(p) AS p FROM d),
v AS (SELECT *, regexp_extract(p, '{_WORD}') AS own FROM t),
w AS (SELECT *, translate(own, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM v),
h AS (SELECT *, ('0x' || md5(w)[1:7])::BIGINT AS h FROM w),
g AS (SELECT doc_id, k, 1 + ({_ORDER}) % {substring_dedup.MODULUS} AS key FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
l AS (SELECT *, CASE WHEN count(key) OVER r = {_REACH} THEN min(key) OVER r END AS low FROM g
  WINDOW r AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND {_REACH - 1} FOLLOWING)),
m AS (SELECT *, max(low) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN {_REACH - 1} PRECEDING AND CURRENT ROW) AS lows FROM l),
ws AS (SELECT doc_id, list(w ORDER BY k) AS ws FROM w GROUP BY 1),
u AS (SELECT doc_id, k, array_to_string(ws[k + 1:k + {_UNIT}], ' ') AS unit FROM m JOIN ws USING (doc_id) WHERE lows = key),
f AS (SELECT doc_id, k, first_value(doc_id) OVER x AS fd, first_value(k) OVER x AS fk, row_number() OVER x AS n FROM u
  WINDOW x AS (PARTITION BY unit ORDER BY doc_id, k)),
e AS (SELECT *, CASE WHEN fd = doc_id THEN greatest(k, fk + {_UNIT}) ELSE k END AS s, k + {_UNIT} AS e FROM f WHERE n > 1),
b AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
r AS (SELECT *, count(*) FILTER (before IS NULL OR s > before) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM b),
c AS (SELECT doc_id, min(s) AS a, max(e) AS b, min(k) AS lq, arg_min(fd, k) AS ld, arg_min(fk, k) AS lk, arg_max(fd, k) AS rd, arg_max(fk, k) AS rk
  FROM r GROUP BY doc_id, run HAVING max(e) - min(s) >= {substring_dedup.MIN_RUN}),
x AS (SELECT c.doc_id,
  a - list_max(list_filter(range({_REACH}), lambda n: n = 0 OR (a = lq AND n <= lk AND a - n >= CASE WHEN ld = c.doc_id THEN lk + {_UNIT} ELSE 0 END
    AND own.ws[a - n + 1:a] = l.ws[lk - n + 1:lk]))) AS a,
  b + list_max(list_filter(range({_REACH}), lambda n: b + n <= len(own.ws) AND rk + {_UNIT} + n <= len(r.ws)
    AND own.ws[b + 1:b + n] = r.ws[rk + {_UNIT} + 1:rk + {_UNIT} + n])) AS b
  FROM c JOIN ws own ON own.doc_id = c.doc_id JOIN ws l ON l.doc_id = ld JOIN ws r ON r.doc_id = rd),
cut AS (SELECT DISTINCT doc_id, unnest(range(a, b))::INT AS k, true AS cut FROM x),
y AS (SELECT w.*, coalesce(cut, false) AS cut, sum(length(p)) OVER (PARTITION BY w.doc_id ORDER BY k) AS stop FROM w LEFT JOIN cut USING (doc_id, k)),
z AS (SELECT *, cut AND NOT lag(cut, 1, false) OVER (PARTITION BY doc_id ORDER BY k) AS head FROM y),
i AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY doc_id ORDER BY k) AS span FROM z),
kept AS (SELECT doc_id, string_agg(CASE WHEN NOT cut THEN p WHEN head THEN p[:length(p) - length(own)] ELSE '' END, '' ORDER BY k) AS kept FROM z GROUP BY 1),
spans AS (SELECT doc_id, min(stop - length(own))::INT AS start, (max(stop) - min(stop - length(own)))::INT AS length FROM i WHERE cut GROUP BY doc_id, span),
rem AS (SELECT doc_id, list({{'start': start, 'length': length}} ORDER BY start) AS removed FROM spans GROUP BY 1)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') || regexp_extract(text, '{_BLANK}*$') END AS text,
  coalesce(len(removed), 0)::INT AS n_removed, coalesce(removed, []) AS removed
FROM documents LEFT JOIN kept USING (doc_id) LEFT JOIN rem USING (doc_id)""",
}
