"""Export metadata: extraction rows with their classification and file names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_filename

STATUS = "Do weryfikacji"


def export_metadata(extraction: DataFrame, classification: DataFrame, project: str, compat_nan_code: bool = False) -> DataFrame:
    """Left join by crop_id (none there: extraction alone); FileName and export_status. No match is UNCLASSIFIED, or "nan" if asked for."""
    both = extraction.join(classification, "crop_id", "left") if "crop_id" in extraction.columns else extraction
    code = F.coalesce("proposed_code", F.lit("nan" if compat_nan_code else "UNCLASSIFIED")) if "proposed_code" in both.columns else F.lit("UNCLASSIFIED")
    page = next((F.col(c) for c in ("page_number", "page") if c in both.columns), F.lit(0))
    crop = F.coalesce(F.col("crop_id").cast("string"), F.lit("nan")) if "crop_id" in both.columns else F.lit("NA")
    name = F.concat(F.lit("DET_"), code, F.lit(f"_REF-{project}_S"), page.cast("string"), F.lit("_"), crop, F.lit(".pdf"))
    return both.withColumns({"FileName": safe_filename(name), "export_status": F.lit(STATUS)})
