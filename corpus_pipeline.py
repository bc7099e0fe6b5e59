"""The corpus pipeline: documents are identified, judged, rid of near-copies and packed.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns a
DataFrame; run() writes each stage's result and reads it back as the next one's
docs.  All stages but the last return the columns of documents.

Null texts have no letter and go with the first stage, as do texts without one;
rows of equal text are one group; empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common, language, ngram_join, packing, quality

#: Below this probability of the likeliest language a document has none.
LANGUAGE_CUT = 0.35
QUALITY_CUT = 0.7
#: Ids that are broadcast at most when rows are taken out; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a letter, or in no language that was learned, go."""
    model = language.train(common.only(docs, "text", "lang"))
    lang, score = common.fresh(docs, "__lang"), common.fresh(docs, "__score")
    found = language.identify(docs, model, lang_out=lang, score_out=score)
    return found.where((F.col(lang) != language.UNDETERMINED) & (F.col(score) >= LANGUAGE_CUT)).select(*common.columns_of(docs))


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score is too low go."""
    labels = common.only(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "quality")
    network = quality.train(common.only(docs, "doc_id", "text"), labels.where(common.remainder(F.col("doc_id"), 4) != 2))
    if network is None:  # nothing to judge by
        return docs
    score = common.fresh(docs, "__score")
    return quality.score(docs, network, score_out=score).where(F.col(score) >= QUALITY_CUT).select(*common.columns_of(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of rows that share 80 % of their five-word shingles, directly or in a chain, the first stays."""
    row = common.fresh(docs, "__row")
    held = common.materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    linked = ngram_join.link(held.select(row, "text"), ngram_join.Threshold(words=5, under=80, over=100), id=row)
    copies = common.materialise(linked.where("id != component").select(F.col("id").alias(row)), "copies")
    few = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return held.join(F.broadcast(copies) if few else copies, row, "left_anti").select(*common.columns_of(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's token ids, cut and packed into sequences."""
    import public_tokenizers

    return packing.pack(packing.pieces(common.only(docs, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", identify_language),
    ("quality", judge_quality),
    ("ngram_join", drop_near_copies),
    ("best_fit", pack_sequences),
]

#: The classifiers and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
