"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common, language, lm, ngram_join, packing, quality, sentencepieces, sharding, topk, toxicity, vector_join

QUALITY_CUT = 0.7
TOXIC_CUT = 0.3


#: Files of public tokenizers; they are read where they are installed.
VOCABULARY = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, value: int):
    return (common.remainder(F.col("doc_id"), modulus) == value).alias("held_out")


def learnable(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """The labels that may be learned from."""
    labels = common.only(table(spark, sf_dir, "labels"), "doc_id", label)
    return labels.where(common.remainder(F.col("doc_id"), 4) != 2)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = common.only(table(spark, sf_dir, "documents"), "doc_id", "text")
    return sentencepieces.digests(rows, public_tokenizers.path(PIECES))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.only(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    model = language.train(rows.where(common.remainder(F.col("doc_id"), 4) != 2), tie=("doc_id",))
    return language.identify(rows.drop("lang"), model).select("doc_id", held_out(4, 2), "lang_pred", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.only(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = topk.top_k(rows, F.col("id") % 50 == 0, 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.only(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = lm.score(rows, common.remainder(F.col("doc_id"), 5) != 1)
    return found.select(F.col("id").alias("doc_id"), (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.only(table(spark, sf_dir, "documents"), "doc_id", "text")
    linked = ngram_join.link(rows, ngram_join.Threshold(words=3, under=90, over=100))
    return linked.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.only(table(spark, sf_dir, "documents"), "doc_id", "text")
    network = quality.train(rows, learnable(spark, sf_dir, "quality"))
    return quality.score(rows, network).select("doc_id", held_out(4, 2), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = common.only(table(spark, sf_dir, "documents"), "doc_id", "text")
    packed = packing.pack(packing.pieces(rows, public_tokenizers.path(VOCABULARY)))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.only(table(spark, sf_dir, "documents"), "doc_id", "text")
    lexicon = toxicity.train(rows, learnable(spark, sf_dir, "toxic"))
    return toxicity.score(rows, lexicon).select("doc_id", held_out(4, 2), "score", (F.col("score") >= TOXIC_CUT).cast("int").alias("predicted"))


def op9_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.only(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    linked = vector_join.link(rows, 0.93)
    return linked.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.only(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source")
    placed = sharding.shard(rows, 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language_id": op2_language_id,
    "op3_top_k": op3_top_k,
    "op4_lm_score": op4_lm_score,
    "op5_ngram_join": op5_ngram_join,
    "op6_quality": op6_quality,
    "op7_best_fit": op7_best_fit,
    "op8_toxicity": op8_toxicity,
    "op9_vector_join": op9_vector_join,
    "op10_sharding": op10_sharding,
}

#: Queries that SQL can express; the others are tested against brute force, round trips or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op3_top_k": r"""
        WITH able AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
            FROM able q JOIN able c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5""",
    "op9_vector_join": r"""
        WITH RECURSIVE able AS (
            SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
        links AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.93),
        reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY 1),
        counted AS (SELECT x, count(*) AS n FROM links GROUP BY 1)
        SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
        FROM embeddings e JOIN least m ON m.x = e.vec_id LEFT JOIN counted c ON c.x = e.vec_id""",
    "op5_ngram_join": r"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingled AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[][]) WHEN len(w) < 3 THEN [w]
                   ELSE list_distinct([[w[i], w[i + 1], w[i + 2]] FOR i IN range(1, len(w) - 1)]) END AS s FROM worded),
        sized AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s FROM shingled),
        flat AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
        pairs AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS met, any_value(a.n) AS nx, any_value(b.n) AS ny
            FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY 1, 2),
        links AS (SELECT x, y FROM pairs WHERE 100 * met >= 90 * (nx + ny - met)),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT d.doc_id, d.n AS n_shingles, m.component_id
        FROM sized d JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY 1) m ON m.x = d.doc_id""",
}
