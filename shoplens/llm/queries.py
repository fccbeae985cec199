"""Registered queries of this subpackage: the operators on their whole tables, with the columns of their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm import (
    archives,
    exact_dedup,
    html_text,
    language_id,
    licenses,
    merkle,
    mixing,
    phrases,
    quality_model,
    quality_rules,
    sentencepiece_unigram,
    sharding,
    simhash,
)
from shoplens.llm.oracles import oracle_table
from shoplens.llm.shared import shared_folder, table

#: Names of the shards of the placement query.
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def labels(matches):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    found = licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    score = F.array_max(F.transform("matches", lambda m: m["coverage"]))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
                        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
                        F.coalesce(score, F.lit(0.0)).alias("score"), "matches")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, SHARDS).select("doc_id", "slot", "shard", "shard_name")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="largest")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return archives.archived(pages, shared_folder(spark, "archives")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_record",
        "verified")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return docs.withColumn("base_failed", base_failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (F.col("kept") & ~F.col("base_failed")).alias("kept"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality_model.scored(docs, model).select(
        "doc_id", (quality_model.bucket() == 0).alias("held_out"), "score", "predicted")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_unigram.encoded(docs).select("doc_id", "n_pieces", "n_fallback", "restored", "pieces")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extracted(pages).select("page_id", "url", "text", "n_chars")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("doc_id").isNotNull()
    return merkle.manifest(docs, tampered).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "lang")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    dicts = language_id.dictionaries(language_id.training_rows(docs, F.coalesce(held_out, F.lit(False))))
    return language_id.predicted(docs.select("doc_id", "text"), dicts).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return phrases.collocations(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_license_scan, op2_sharding, op3_source_mixing, op4_exact_dedup, op5_warc, op6_quality_rules,
             op7_quality_classifier, op8_simhash_near_dedup, op9_sentencepiece, op10_html_extraction,
             op11_merkle_manifest, op12_language_id, op13_phrase_collocations)
    return {f.__name__: f for f in found}


def llm_oracles() -> dict[str, str]:
    return oracle_table()
