"""One query an operator, over whole tables, as __spark_entry__ registers them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fill_in_middle, line_dedup, near_dedup, paragraph_dedup, quality_classifier, quality_rules, simhash, source_audit, substring_exact, token_counts, toxicity
from .common import row_key, shared_folder, table

RANKS = "byte_bpe_50k.tiktoken"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded=True, memo=250_000)
    return out.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = quality_classifier.labelled(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), "quality", _remainder(5) != 0, quality_classifier.SAMPLE)
    out = quality_classifier.apply(docs, quality_classifier.fit(rows))
    return out.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = paragraph_dedup.report(docs)
    every = docs.select("doc_id", row_key().alias("key")).join(found, "key", "left")
    spans = F.coalesce("removed", F.array().cast("array<struct<a:int,b:int>>"))
    words = F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    places = F.array_join(F.transform(spans, lambda x: F.concat_ws("-", x["a"].cast("string"), x["b"].cast("string"))), ",")
    return every.select("doc_id", F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"), F.size(spans).cast("long").alias("n_removed"), words.alias("n_words_removed"), places.alias("removed"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_exact.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<first:bigint,stop:bigint>>")), F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["first"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive, English ones are revised to another tokenizer version (a batch that is sent twice), short other ones go."""
    docs = table(spark, sf_dir, "documents")
    rollup = token_counts.Rollup(spark, f"{shared_folder(spark)}/strataq/{uuid.uuid4().hex}-rollup")
    english, other = docs.where("lang = 'en'"), docs.where("lang is null or lang != 'en'")
    rollup.commit("arrivals", token_counts.counts(docs, "words-1"))
    for _ in range(2):
        rollup.commit("revision", token_counts.revised(english, english, "words-1", "words-2"))
    rollup.commit("departures", token_counts.counts(other.where(token_counts.few_words(20)), "words-1", -1))
    return rollup.totals()


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.coalesce(F.array_sort(F.col("items").cast("array<string>")), F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"), 2)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), _remainder(3) != 1)
    out = toxicity.apply(docs, model)
    return out.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "flagged")


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = fill_in_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}
