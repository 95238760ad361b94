"""Phrase counts and classification of arriving texts.

Both work row by row, so the batch operators run unchanged; counts are kept by
a streaming aggregation, with a watermark where there are event times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.classify import phrases_of


def phrase_counts(stream: DataFrame, text: str = "raw_text", time: str | None = None, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """phrase, count (and the window, if there is a time column) of core phrases."""
    each = stream if time is None else stream.withWatermark(time, late)
    keep = [time] if time else []
    rows = each.select(*keep, F.explode(tx.lines(text)).alias("line")).withColumn("core", tx.strip_context_tail("line"))
    rows = rows.where(~tx.is_noise("core")).withColumn("tokens", tx.tokenize_phrase("core")).where(F.size("tokens") >= 2)
    grams = rows.select(*keep, F.explode(F.filter(tx.ngrams(F.col("tokens"), 2, 4), lambda g: tx.valid_ngram(g))).alias("gram")).select(*keep, F.array_join("gram", " ").alias("phrase"))
    by = [F.window(time, window), "phrase"] if time else ["phrase"]
    return grams.groupBy(*by).agg(F.count("*").alias("count"))


def code_hits(stream: DataFrame, synonyms: DataFrame, text: str = "raw_text") -> DataFrame:
    """The stream's rows with code and phrase of each dictionary phrase found: a stream-static join, no state."""
    own = stream.withColumn("search_text", tx.search_form(text))
    return own.join(F.broadcast(phrases_of(synonyms).select("code", "phrase", "contribution")), F.contains("search_text", "phrase")).drop("search_text")
