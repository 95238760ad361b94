"""Annotations of pages to extraction rows: type, colour and clip filters, text fallback, names, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx

# Colours of areas, in the order of trial, and the tolerance of a channel.
AREA_COLORS = {"detail": (0, 85, 0), "titleblock": (0, 0, 139), "ignore": (255, 255, 0)}
TOLERANCE = 3
MIN_NATIVE_TEXT, MIN_NATIVE_ROWS, MIN_CONFIDENCE = 10, 3, 30.0


def area_type(stroke: Column, fill: Column, tolerance: int = TOLERANCE) -> Column:
    """Name of the stroke's colour, else of the fill's, else unknown; colours are struct(r, g, b) or null."""

    def named(color: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, rgb in reversed(AREA_COLORS.items()):
            close = None
            for channel, value in zip("rgb", rgb):
                ok = F.abs(color[channel] - value) <= tolerance
                close = ok if close is None else close & ok
            out = F.when(close, name).otherwise(out)
        return out

    return F.coalesce(named(stroke), named(fill), F.lit("unknown"))


def hybrid_text(native: Column, ocr: Column, ocr_available: Column | bool = True, least: int = MIN_NATIVE_TEXT) -> Column:
    """struct(text, source): recognised text only where the native one is short; both if both are there."""
    n = F.coalesce(F.btrim(native), F.lit(""))
    use = (F.length(n) < least) & (ocr_available if isinstance(ocr_available, Column) else F.lit(ocr_available))
    o = F.when(use, F.coalesce(F.btrim(ocr), F.lit(""))).otherwise("")
    text = F.when((n != "") & (o != ""), F.concat(n, F.lit("\n\n"), o)).when(o != "", o).otherwise(n)
    source = F.when((n != "") & (o != ""), "native_pdf_text+ocr_text").when(o != "", "ocr_text").when(n != "", "native_pdf_text").otherwise("empty")
    return F.struct(text.alias("text"), source.alias("source"))


def text_source(native: DataFrame, recognised: DataFrame, least: int = MIN_NATIVE_ROWS) -> DataFrame:
    """Native text rows of pages that have enough of them or nothing else, recognised ones of the other pages."""
    page = Window.partitionBy("page")
    both = native.withColumn("origin", F.lit("native")).unionByName(recognised.withColumn("origin", F.lit("ocr")))
    count = lambda o: F.sum((F.col("origin") == o).cast("int")).over(page)
    use_native = (F.col("n_native") >= least) | (F.col("n_ocr") == 0)
    return both.withColumns({"n_native": count("native"), "n_ocr": count("ocr")}).where((F.col("origin") == "native") == use_native).drop("n_native", "n_ocr")


def text_lines(spans: DataFrame, min_width: int = 6, min_height: int = 4) -> DataFrame:
    """page, line_id, x0 ... y1, text: lines of spans that are large enough; texts joined by a blank in order."""
    own = spans.where((g.width() >= min_width) & (g.height() >= min_height) & (F.btrim("text") != ""))
    return own.groupBy("page", "line_id").agg(*g.union(), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", F.btrim("text").alias("t")))), lambda s: s["t"]), " ").alias("text"))


def recognised_words(words: DataFrame, min_width: int = 6, min_height: int = 4, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Words with text, confidence (none: -1) and size."""
    sure = F.coalesce(F.expr("try_cast(confidence AS double)"), F.lit(-1.0)) >= confidence
    return words.where((F.btrim(F.coalesce("text", F.lit(""))) != "") & sure & (g.width() >= min_width) & (g.height() >= min_height))


def extract(annotations: DataFrame, project: str, padding: float = 10.0, ocr_available: bool = True) -> tuple[DataFrame, DataFrame]:
    """(crops, report) of annotations: page_index, order, kind, rect, bound, page (structs), stroke, fill (arrays), native_text, ocr_text.

    The cheap tests come first: kind, clip, colour; the index counts every annotation of the document.
    """
    w = Window.partitionBy("source_pdf").orderBy("page_index", "order")
    numbered = annotations.withColumn("annotation_index", F.row_number().over(w))
    square = numbered.where(F.col("kind") == "Square").withColumn("crop", g.crop_rect("bound", "rect", "page", padding))
    skipped = square.where("crop is null").select("source_pdf", "page_index", "annotation_index", F.lit("skipped").alias("status"), F.lit("invalid_clip").alias("reason"))
    kept = square.where("crop is not null").withColumns({"stroke_rgb": g.rgb255(F.col("stroke")), "fill_rgb": g.rgb255(F.col("fill"))})
    kept = kept.withColumn("area_type", area_type(F.col("stroke_rgb"), F.col("fill_rgb"))).where("area_type = 'detail'")
    kept = kept.withColumn("t", hybrid_text(F.col("native_text"), F.col("ocr_text"), ocr_available)).withColumn("page_number", F.col("page_index") + 1)
    name = base_name(F.lit(project), F.col("page_number"), F.col("annotation_index"))
    crops = kept.select(
        name.alias("crop_id"), name.alias("base_name"), "source_pdf", "page_index", "page_number", "annotation_index", "area_type", F.col("crop").alias("bbox_pdf_coords"), F.col("t.text").alias("raw_text"), F.length("t.text").alias("text_length"),
        F.col("t.source").isin("ocr_text", "native_pdf_text+ocr_text").alias("ocr_used"), F.col("t.source").alias("text_source"), "stroke_rgb", "fill_rgb",
        (F.col("crop.x1") - F.col("crop.x0")).alias("width"), (F.col("crop.y1") - F.col("crop.y0")).alias("height"), F.lit("ok").alias("status"),
    ).withColumn("area", F.col("width") * F.col("height"))
    done = crops.select("source_pdf", "page_index", "annotation_index", "status", F.col("crop_id").alias("base_name"))
    return crops, done.unionByName(skipped, allowMissingColumns=True)


def base_name(project: Column, page_number: Column, index: Column) -> Column:
    return tx.safe_filename(F.format_string("%s_page_%03d_detail_%03d", project, page_number.cast("int"), index.cast("int")))


def run_counters(crops: DataFrame) -> DataFrame:
    return crops.agg(F.count_distinct("page_number").alias("pages"), F.count("*").alias("boxes"))
