"""From raw documents to encoded training text: five stages, each by an operator of shoplens.llm.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of docs. run() writes each stage's result to the shared folder and reads it again, so a lost executor costs one stage's
work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoplens.llm import exact_dedup, mixing, quality_model, sentencepiece_unigram, simhash
from shoplens.llm.shared import shared_folder, table

#: Words per shingle and differing bits of near-duplicates.
SHINGLE_WORDS, MOST_BITS = 4, 4


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects; it learns from the table labels, outside the held-out bucket."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_model.accepted(docs, quality_model.train(docs, labels))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one of the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs, keep="largest")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, directly linked or not, the one of the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs, width=SHINGLE_WORDS, radius=MOST_BITS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their weights; a document stands as often as the mix takes it."""
    return mixing.repeated(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds pieces, n_pieces, n_fallback and restored (decoding gives the text again)."""
    return sentencepiece_unigram.encoded(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece", encoding_stage),
]

#: Learned scores and XXH64 fingerprints are beyond SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
