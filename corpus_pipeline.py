"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept, written as Parquet and read again. All but the last return the columns of
``documents``; n_chars follows the text.

Cases that are alike in all stages: rows are treated by their text and doc_id
alone, so that nulls in lang, source and n_chars stay nulls; an empty table gives
an empty one; texts of any length are read whole; further columns of docs, of
any name, are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import bpe, decontaminate, line_dedup, near_dedup, quality_rules
from strataq.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
RANKS = "byte_bpe_50k.tiktoken"
#: Pre-tokens in each half of what a worker remembers: fewer than op2's, as executors have grown in the stages before.
MEMO = 40_000


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learnt decision list keep.

    Null, empty and short texts (under 20 words) fail the base rule and go; rows that repeat are judged alike; labels of
    a null doc_id don't train; without labels the base rule decides alone.
    """
    return quality_rules.apply(docs, table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of windows that occurred earlier; no document goes, its text may become empty.

    Null texts stay null (n_chars too), texts of fewer than three lines stay as they are; the first occurrence is that of the
    least doc_id (null first) and place; rows equal in doc_id and text are one occurrence.
    """
    return line_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least doc_id, of each group of near copies (five-word shingles, a similarity of 0.8 or more).

    Null and wordless texts are no copies of each other and stay; rows that share a doc_id are one document and stay or go
    together; a null doc_id is linked with nothing and stays.
    """
    return near_dedup.dedup(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark; null and wordless texts have none and stay, rows that repeat are judged alike."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text: a row a row; a null text is the empty one."""
    # the workers compare, so that neither texts nor decoded bytes come back
    out = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"), round_trip=True, memo=MEMO)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality_rules", reject_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The learnt rules and the merges of the tokenizer can't be written in SQL; tests hold the run against plain Python.
ORACLE_SQL = None
