"""Text files, page lists, settings, recognition by an outside program, and the tables of a run."""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import signal
import subprocess
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OCR_TIMEOUT = 30
# Settings and their defaults.
SETTINGS = {"tesseract_path": "", "tessdata_path": "", "ocr_language": "pol+eng"}


def texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), text: whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def page_numbers(pages: str | Iterable[int] | None, total: int) -> tuple[list[int], list[str]]:
    """(numbers, warnings): all pages, or those named that exist, each once."""
    if pages is None or pages == "":
        return list(range(1, total + 1)), []
    named = [p.strip() for p in pages.split(",") if p.strip()] if isinstance(pages, str) else list(pages)
    out, warnings = [], []
    for p in map(int, named):
        if not 1 <= p <= total:
            warnings.append(f"page {p} is not among 1 to {total}")
        elif p not in out:
            out.append(p)
    return out, warnings


def load_settings(path: str) -> dict:
    """Settings of a file over the defaults; a missing or broken file gives the defaults."""
    try:
        with open(path, encoding="utf-8") as f:
            return SETTINGS | json.load(f)
    except (OSError, ValueError):
        return dict(SETTINGS)


def save_settings(path: str, settings: dict) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(settings, f, ensure_ascii=False, indent=2)


def find_program(settings: dict, name: str = "tesseract", portable: str = "") -> str | None:
    """The program's path: from the settings, the environment, a folder beside, or PATH."""
    tried = [settings.get(f"{name}_path"), os.environ.get(f"{name.upper()}_PATH"), portable]
    return next((p for p in tried if p and os.path.exists(p)), None) or shutil.which(name)


def program_state(program: str | None, language: str = "eng+pol", data: str | None = None) -> dict[str, str]:
    """state (available, missing_tesseract or missing_tessdata), message, program, data (folder of the languages), languages."""
    found = bool(program) and os.path.isfile(program)
    data = data or (os.path.join(os.path.dirname(program), "tessdata") if found else "")
    out = {"program": program or "", "data": data, "languages": language}
    if not found:
        return {"state": "missing_tesseract", "message": "missing program"} | out
    if not os.path.isdir(data):
        return {"state": "missing_tessdata", "message": "missing tessdata"} | out
    missing = [x for x in map(str.strip, language.split("+")) if x and not os.path.exists(os.path.join(data, f"{x}.traineddata"))]
    if missing:
        return {"state": "missing_tessdata", "message": f"missing language data: {'/'.join(missing)}"} | out
    return {"state": "available", "message": "ready"} | out


def recognise(image: str, program: str, language: str = "pol+eng", timeout: float = OCR_TIMEOUT, data: str | None = None) -> tuple[str, str | None]:
    """(text, error): what the program prints for an image file; errors are returned, not raised."""
    command = [program, image, "stdout", "-l", language, *(["--tessdata-dir", data] if data else [])]
    try:
        child = subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, encoding="utf-8", errors="replace", start_new_session=True)
    except FileNotFoundError:
        return "", f"missing executable: {program}"
    except OSError as x:
        return "", str(x)
    with child:
        try:
            out, err = child.communicate(timeout=timeout)
        except subprocess.TimeoutExpired:
            with contextlib.suppress(ProcessLookupError):
                os.killpg(child.pid, signal.SIGKILL)  # what it started too, or its pipes would stay open
            return "", f"timeout after {timeout} s"
    if child.returncode:
        return "", f"exit code {child.returncode}: {(err or '').strip()}"
    return (out or "").strip(), None


def recognised(images: Column, program: str, *, at_once: int = 4, **options) -> Column:
    """struct(text, error) of a column of image paths that the executors can open; null and empty paths have no text and no error.

    A task runs at most ``at_once`` programs at a time (a cluster gives it as many cores by spark.task.cpus). One that hangs
    holds its place until its timeout, the others go on. A path that repeats in a batch is recognised once.
    """

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for paths in batches:
                paths = [p or "" for p in paths]
                waiting = {p: pool.submit(recognise, p, program, **options) for p in dict.fromkeys(paths) if p}
                yield pd.DataFrame([waiting[p].result() if p else ("", None) for p in paths], columns=["text", "error"])

    return run(images)


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for CSV."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def save_tables(tables: dict[str, DataFrame], folder: str, formats: tuple[str, ...] = ("parquet", "json", "csv")) -> None:
    """Each table in each format: folder/name.format."""
    for name, df in tables.items():
        for kind in formats:
            out = flat(df) if kind == "csv" else df
            out.write.mode("overwrite").options(**({"header": "true"} if kind == "csv" else {})).format(kind).save(f"{folder}/{name}.{kind}")


def save_crops(crops: DataFrame, folder: str, *, name: str = "base_name", text: str = "raw_text") -> None:
    """A folder a crop, by its base name: text/base_name=.../ holds its text, text_meta/base_name=.../ its other columns as JSON.

    The rows of a crop meet in one task, so that each has one file; null texts give empty ones.
    """
    own = crops.withColumn(name, F.col(name).cast("string")).repartition(name)
    own.select(name, F.coalesce(F.col(text), F.lit("")).alias("value")).write.mode("overwrite").partitionBy(name).text(f"{folder}/text")
    own.drop(text).write.mode("overwrite").partitionBy(name).json(f"{folder}/text_meta")
