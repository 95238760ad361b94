"""Token counts kept by deltas: additive totals by source, language and tokenizer version.

A batch is a set of changes: a document arrives (+), goes (-), or its count is
revised (- the old, + the new one, as after a new text or a new tokenizer
version). A batch is reduced to one signed row a (source, language, version)
by a partial aggregation, so a source with a third of all rows costs a row a
task, and committed under its id by one rename: a batch that was committed
already, whole or by a run that was lost, changes nothing. Totals are sums over
committed batches. The rename of a folder must be atomic in the folder's file
system, as in HDFS or a local one; in object stores that copy instead, a batch
id needs a single writer, and a writer that is lost half way may leave a part.

Cases: null text has no tokens; a null source or language is a group of its
own; rows that repeat count as often; groups whose documents and tokens have
all gone leave no row; an empty batch commits and changes nothing; very long
texts are counted whole; other columns are ignored; a batch id has any characters
and at most 120 bytes (a longer one is refused).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions of tokenizers: a count of a text, as a Spark expression.
TOKENIZERS = {
    "words-1": lambda text: F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")),
    "words-2": lambda text: F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")),
}
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def counts(docs: DataFrame, tokenizer: str, sign: int = 1, *, text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """Signed rows of documents: +1 arrives, -1 goes."""
    n = F.coalesce(TOKENIZERS[tokenizer](F.col(text)), F.lit(0)).cast("long")
    return docs.select(F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("n_docs"), (n * sign).alias("n_tokens"))


def revised(before: DataFrame, after: DataFrame, old: str, new: str, **columns: str) -> DataFrame:
    """Signed rows of documents that get another text, source, language or tokenizer version."""
    return counts(before, old, -1, **columns).unionByName(counts(after, new, 1, **columns))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "lang", "tokenizer").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


@dataclass
class Rollup:
    """Totals in a folder that all executors share; one writer a batch id."""

    spark: SparkSession
    folder: str

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _batch(self, batch: str) -> str:
        """Its folder: the hex form of the id, so that an id of any characters is one name, not hidden and no path."""
        raw = batch.encode()
        if len(raw) > 120:
            raise ValueError("a batch id has at most 120 bytes")
        return f"{self.folder}/batches/b{raw.hex()}"

    def committed(self) -> list[str]:
        """Ids of batches (the ledger is the listing of their folder)."""
        fs, at = self._fs(f"{self.folder}/batches")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(bytes.fromhex(n[1:]).decode() for n in names)

    def commit(self, batch: str, *changes: DataFrame) -> bool:
        """Adds the signed rows of a batch; False if it was there already."""
        to_path = self._batch(batch)
        if batch in self.committed():
            return False
        staged = f"{self.folder}/staged/{uuid.uuid4().hex}"
        summed(reduce(DataFrame.unionByName, changes)).coalesce(1).write.parquet(staged)
        fs, to = self._fs(to_path)
        fs.mkdirs(to.getParent())
        _, at = self._fs(staged)
        if fs.exists(to) or not fs.rename(at, to):  # another run of the same batch was faster
            fs.delete(at, True)
            return False
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens: only groups that have documents or tokens."""
        batches = self.committed()
        if not batches:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*map(self._batch, batches))
        return summed(rows).where("n_docs != 0 or n_tokens != 0")


def few_words(least: int, text: str = "text") -> Column:
    return F.coalesce(TOKENIZERS["words-2"](F.col(text)), F.lit(0)) < least
