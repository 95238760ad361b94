"""Numbers rows in the order in which files hold them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.cut import stored

ROW_ORD = "row_ord"
_PLACE = ("_ord_file", "_ord_start", "_ord_at")


def numbered(df: DataFrame, name: str = ROW_ORD) -> DataFrame:
    """df with ``name``: 0, 1, 2 and so on by file name, then by place in the file; as it is if it has that column.

    For tables as read, before anything shuffles or filters them. Spark packs stretches of files into tasks by size, so a
    row's number within its stretch (rows of one come together) is added to the number of rows before that stretch: a sum
    over one row a stretch. Rows aren't sorted. Tables that don't come from files are numbered as they stand.
    """
    if name in df.columns:
        return df
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias(_PLACE[0]), F.col("_metadata.file_block_start").alias(_PLACE[1]), F.monotonically_increasing_id().alias(_PLACE[2]))
    except AnalysisException:
        return df.withColumn(name, F.monotonically_increasing_id())
    placed = stored(placed)
    stretches = placed.groupBy(*_PLACE[:2]).agg(F.min(_PLACE[2]).alias("_ord_low"), F.count("*").alias("_ord_n"))
    earlier = Window.orderBy(*_PLACE[:2]).rowsBetween(Window.unboundedPreceding, -1)  # over stretches, of which a table has few
    stretches = stretches.withColumn("_ord_before", F.coalesce(F.sum("_ord_n").over(earlier), F.lit(0)))
    own = placed.join(stretches, list(_PLACE[:2]))
    return own.select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns], (F.col("_ord_before") + F.col(_PLACE[2]) - F.col("_ord_low")).alias(name))
