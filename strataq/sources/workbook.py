"""A dictionary as a folder of tables, one a sheet; written as a new version each time.

Sheets are Parquet, CSV or JSON tables, or those of an .xlsx file
(``from_spreadsheet``). Each has row_ord, the order of its rows, which versions
keep: "first" and "last" rows are the same after any number of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.dictionary import SHEETS
from . import spreadsheet
from .ordinals import numbered

REQUIRED = ("Elements", "Synonyms", "NegativeSynonyms")


class DictionaryError(ValueError):
    """The dictionary or one of its sheets is missing."""


def empty(spark: SparkSession, sheet: str) -> DataFrame:
    return spark.createDataFrame([], SHEETS[sheet])


def template(spark: SparkSession) -> dict[str, DataFrame]:
    return {sheet: empty(spark, sheet) for sheet in SHEETS}


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Names of complete versions, oldest first."""
    fs, at = _fs(spark, folder)
    if not fs.exists(at):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("v"))


def load(spark: SparkSession, folder: str, required: tuple[str, ...] = REQUIRED, format: str = "parquet") -> dict[str, DataFrame]:
    """The newest version's sheets, with row_ord; optional ones that are missing are empty."""
    known = versions(spark, folder)
    if not known:
        raise DictionaryError(f"no dictionary in {folder}")
    fs, at = _fs(spark, f"{folder}/{known[-1]}")
    there = {s.getPath().getName() for s in fs.listStatus(at)}
    if missing := [s for s in required if s not in there]:
        raise DictionaryError(f"sheets missing: {', '.join(missing)}")
    out = {sheet: numbered(df) for sheet, df in template(spark).items()}
    for sheet in sorted(there):
        options = {"header": "true", "inferSchema": "true"} if format == "csv" else {}
        out[sheet] = numbered(spark.read.format(format).options(**options).load(f"{folder}/{known[-1]}/{sheet}"))
    return out


def save(spark: SparkSession, folder: str, sheets: dict[str, DataFrame]) -> str:
    """A new version beside the old ones, which are the backups; it shows when it is complete."""
    staged = f"{folder}/.staged-{uuid.uuid4().hex}"
    for sheet, df in sheets.items():
        df.write.parquet(f"{staged}/{sheet}")
    known = versions(spark, folder)
    name = f"v{int(known[-1][1:]) + 1 if known else 1:06d}"  # old versions may have been deleted
    fs, at = _fs(spark, staged)
    if not fs.rename(at, _fs(spark, f"{folder}/{name}")[1]):
        raise DictionaryError(f"{name} was written meanwhile")
    return name


def import_accepted(spark: SparkSession, folder: str, candidates: DataFrame, confirm=None) -> int:
    """Accepted candidates into the Synonyms of a new version; how many rows that added. Without a callback, or if it declines, nothing happens."""
    from ..operators import dictionary

    sheets = load(spark, folder, required=("Synonyms",))
    if confirm is None or not confirm(f"update {folder}"):
        return 0
    old = sheets["Synonyms"]
    new = dictionary.import_accepted(old, numbered(candidates), keep_order=True)
    sheets["Synonyms"] = new
    before = old.count()
    save(spark, folder, {k: v for k, v in sheets.items() if k != "Synonyms"} | {"Synonyms": new})
    return load(spark, folder)["Synonyms"].count() - before


def from_spreadsheet(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED) -> dict[str, DataFrame]:
    """The sheets of an .xlsx file, with row_ord; optional ones of a dictionary that are missing are empty."""
    found = spreadsheet.sheets(spark, path)
    if missing := [s for s in required if s not in found]:
        raise DictionaryError(f"sheets missing: {', '.join(missing)}")
    return {sheet: numbered(df) for sheet, df in template(spark).items()} | found
