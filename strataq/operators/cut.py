"""Cuts the lineage of a table that several parts of a plan read, so that it is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: list[str] = []


def _folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only in a session without other machines that names none."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and context._jsc.sc().getCheckpointDir().isDefined():
        named = context._jsc.sc().getCheckpointDir().get()
    if not named and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not named and not _own:
        _own.append(tempfile.mkdtemp(prefix="strataq-"))
    return named.rstrip("/") if named else f"file://{_own[0]}"


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: columns that aren't asked for aren't read, and it can be deleted (``drop``)."""
    at = f"{_folder(df.sparkSession)}/strataq/{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._stored_at = at
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
