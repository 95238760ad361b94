"""Line dedup over overlapping windows of three lines, with DataFrame functions only.

Every window of three consecutive lines is hashed (128 bits). Hashes that occur
more than once in the corpus are found with a partial aggregation, so a window
that stands in a third of all documents costs a row a task. Every occurrence
but the first, in the order of (doc_id, position), loses the lines it covers;
covered positions of a document are merged.

Cases: texts of fewer than three lines, empty and null texts have no window and
stay; windows whose lines are all blank don't count; a null doc_id sorts first;
rows equal in doc_id and text count as one occurrence and are treated alike;
an empty table gives an empty table; other columns pass through, but
``n_lines`` and ``n_removed`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let, others, ref, row_key

LINES = 3


def windows(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", lines: int = LINES) -> DataFrame:
    """h1, h2, at (struct of doc_id, row_key, i): a row a window with something in it."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\n")

    def of(x):
        n = F.size(x) - (lines - 1)
        own = F.slice(x, F.lit(1), n)
        for k in range(1, lines):
            own = F.zip_with(own, F.slice(x, F.lit(k + 1), n), lambda a, b: F.concat(a, F.lit("\n"), b))
        return F.when(n > 0, own).otherwise(F.array().cast("array<string>"))

    each = docs.select(F.struct(F.col(doc).alias("doc"), row_key(doc, text).alias("row_key")).alias("d"), let(parts, of).alias("w"))
    each = each.select("d", F.posexplode("w").alias("i", "window")).where(F.col("window").rlike(r"[^\s]"))
    return each.select(F.xxhash64("window").alias("h1"), F.xxhash64(F.lit("second"), "window").alias("h2"), F.struct(F.col("d.doc"), F.col("d.row_key"), F.col("i")).alias("at"))


def later(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", lines: int = LINES) -> DataFrame:
    """row_key, starts: sorted positions of the windows of a document that occur earlier in the corpus."""
    every = windows(docs, doc=doc, text=text, lines=lines)
    first = every.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last")).where(F.col("first") != F.col("last")).select("h1", "h2", "first")
    repeats = every.join(first, ["h1", "h2"]).where(F.col("at") != F.col("first"))
    return repeats.groupBy(F.col("at.row_key").alias("row_key")).agg(F.sort_array(F.collect_set("at.i")).alias("starts"))


def dedup(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", lines: int = LINES) -> DataFrame:
    """docs with the lines left in ``text``, plus n_lines and n_removed (long)."""
    tagged = docs.select(F.struct(*others(docs, text, "n_lines", "n_removed")).alias("row"), ref(text).alias("text"), row_key(doc, text).alias("key"))
    gone = later(docs, doc=doc, text=text, lines=lines).select(F.col("row_key").alias("key"), F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + (lines - 1))))).alias("gone"))
    both = tagged.join(gone, "key", "left")
    left = let(
        F.split("text", "\n"),
        lambda x: let(
            F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")),
            lambda own: F.array_join(F.transform(own, lambda i: F.get(x, i)), "\n"),
        ),
    )
    out = both.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.coalesce(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
    return out.select("row.*", F.col("text").alias(text), "n_lines", "n_removed")
