"""Small dictionaries, the same in Spark and in SQL, and tables derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYNONYMS = [
    ("BLT", "Bolt", 1.0, "exact", True, 0), ("BLT", "red bolt", 0.5, "exact", True, 1), ("GER", "gear", 0.75, "fuzzy", True, 2), ("WID", "widget", 0.5, "exact", True, 3),
    ("RNG", "ring", 0.5, "exact", True, 4), ("PLT", "Płate", 1.0, "exact", True, 5), ("PLT", "plate", 0.5, "exact", True, 6), ("ROD", "rod", 1.0, "exact", False, 7),
    ("COL", "cold", 0.25, "exact", True, 8), ("HOT", "hot", 0.5, "fuzzy", True, 9), ("BLT", "Bolt", 1.0, "exact", True, 10), ("SML", "small", 0.75, "exact", True, 11),
    ("NEW", "new", 1.5, "exact", True, 12), ("ANV", "anvil", 1.0, "exact", True, 13), ("GIZ", "gizmo", 0.5, "exact", True, 14), ("LRG", "large", 1.0, "fuzzy", True, 15),
]
NEGATIVES = [("BLT", "old", 0.25, 0), ("WID", "cold", 0.5, 1), ("XXX", "blue", 0.75, 2), ("ANV", "hot", 2.0, 3)]
PRIORITIES = [("BLT", 90.0, 0), ("GER", 30.0, 1), ("WID", 100.0, 2), ("RNG", 20.0, 3), ("PLT", 50.0, 4), ("COL", 10.0, 5), ("NEW", 80.0, 6), ("BLT", 95.0, 7)]
ELEMENTS = [("A1", "Śruba", "bolt", "metal", 100.0, 0), ("A2", "Koło", "gear ", "metal", 90.0, 1), ("A3", None, "widget", "gizmo", 80.0, 2), ("A4", "nan", "Ring", "Small", 70.0, 3), ("A5", "", "plate", None, 60.0, 4)]
CANDIDATES = [("Red Bolt", "BLT", "accept", 0), ("red bolt", "BLT", " Accept ", 1), ("gear", "GER", "pending", 2), ("rod end", "ROD", "accept", 3), ("rod end", "ROD", "ACCEPT", 4), ("", "ROD", "accept", 5), ("anvil", None, "accept", 6), ("Bolt", "BLT", "accept", 7)]
MATCHER = [
    ("W1", 10.0, "wall", "masonry", "ext", 40.0, "base", 20.0, "yes", 40.0, "brick wall", "ściana murowana", 0), ("W2", 20.0, "wall", "rc", "zewnętrzny", 60.0, "", 0.0, "no", 0.0, "concrete wall", "wall", 1),
    ("S1", 30.0, "floor", "steel", "both", 30.0, "mid", 50.0, "tak", 20.0, "steel plate", "plate", 2), ("S2", 5.0, "floor", None, "int", 80.0, "top", 60.0, "1", 10.0, "large gear", None, 3), ("S3", 7.0, None, "mixed", None, None, "any", None, None, None, "small ring", "ring", 4),
]
KEYWORDS = [("outside", "ext", 50.0, "any", 0.0, "hot", "red", 0), ("inside", "int", 45.0, "dół", 30.0, "cold", None, 1), ("above", None, None, "góra", 55.0, "new", "small", 2)]

SCHEMAS = {
    "SYNONYMS": "ElementCode string, Phrase string, Weight double, MatchType string, Active boolean, row_ord int",
    "NEGATIVES": "ElementCode string, Phrase string, Penalty double, row_ord int",
    "PRIORITIES": "ElementCode string, Priority double, row_ord int",
    "ELEMENTS": "ElementCode string, NamePL string, NameEN string, Category string, Priority double, row_ord int",
    "CANDIDATES": "Phrase string, SuggestedElementCode string, Decision string, row_ord int",
    "MATCHER": "ElementCode string, Priority double, ContextGroup string, MaterialGroup string, SideSignal string, SideWeight double, PositionSignal string, PositionWeight double, IsStrongAnchor string, AnchorWeight double, Phrase1 string, Phrase2 string, row_ord int",
    "KEYWORDS": "ContextSignal string, SideSignal string, SideWeight double, PositionSignal string, PositionWeight double, Word1 string, Word2 string, row_ord int",
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(globals()[name], SCHEMAS[name])


def values(name: str, alias: str) -> str:
    """The same rows as a named SQL relation."""

    def cell(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"{x}::DOUBLE" if isinstance(x, float) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    columns = ", ".join(c.split()[0] for c in SCHEMAS[name].split(", "))
    return f"{alias}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in globals()[name])})"


_SIDE, _PLACE = "CASE p_size % 4 WHEN 0 THEN 'ext' WHEN 1 THEN 'wewnętrzny' WHEN 2 THEN 'both' END", "CASE p_size % 5 WHEN 0 THEN 'dół' WHEN 1 THEN 'mid' WHEN 2 THEN 'Top' WHEN 3 THEN 'any' END"
_SIZE, _PLACED = "cast(p_size AS double)", "cast(100 + p_partkey AS int)"
#: Rows of the dictionaries from the parts, by expressions that Spark and SQL share: behind the small ones, growing with the table.
FROM_PARTS = {
    "SYNONYMS": ["p_brand", "p_name", f"{_SIZE} / 50", "CASE WHEN p_size % 3 = 0 THEN 'fuzzy' ELSE 'exact' END", "p_size % 7 <> 0", _PLACED],
    "ELEMENTS": ["p_brand", "CASE WHEN p_size % 6 <> 0 THEN p_name END", "concat(p_name, ' ', p_type)", "p_type", _SIZE, _PLACED],
    "CANDIDATES": ["CASE WHEN p_size % 9 = 0 THEN ' ' ELSE concat(p_name, ' ') END", "CASE WHEN p_size % 8 <> 0 THEN p_brand END", "CASE p_size % 3 WHEN 0 THEN 'accept' WHEN 1 THEN ' Accept ' ELSE 'pending' END", _PLACED],
    "MATCHER": ["p_brand", _SIZE, "p_type", "CASE p_size % 3 WHEN 0 THEN 'Steel' WHEN 1 THEN 'rc' END", _SIDE, _SIZE, _PLACE, f"{_SIZE} / 2", "CASE WHEN p_size % 5 = 0 THEN 'Tak' ELSE 'no' END", _SIZE, "p_name", "CASE WHEN p_size % 2 = 0 THEN p_type END", _PLACED],
    "KEYWORDS": ["p_type", _SIDE, _SIZE, _PLACE, f"{_SIZE} / 4", "p_name", "CASE WHEN p_size % 2 = 0 THEN p_brand END", _PLACED],
}


def grown(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A small dictionary and rows from the parts."""
    small = frame(spark, name)
    return small.unionByName(table(spark, sf_dir, "part").selectExpr(*[f"{x} AS {c}" for x, c in zip(FROM_PARTS[name], small.columns)]))


def grown_values(name: str, alias: str) -> str:
    """The same rows as a named SQL relation."""
    return f"{values(name, alias)[:-1]} UNION ALL SELECT {', '.join(FROM_PARTS[name])} FROM part)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Pages of about 256 boxes, however many rows there are.
ORDERS_A_PAGE = 64
PAGE_WIDTH, PAGE_HEIGHT = 1800, 2400
_BOX = """floor(l_orderkey / 64)::BIGINT AS page, (l_orderkey * 8 + l_linenumber)::BIGINT AS id,
  ((l_partkey * 37 + l_linenumber * 101) % 1800)::INT AS x0, ((l_suppkey * 53 + l_partkey * 17) % 2400)::INT AS y0,
  ((l_partkey * 37 + l_linenumber * 101) % 1800 + l_partkey * 7 % 160 + 10)::INT AS x1, ((l_suppkey * 53 + l_partkey * 17) % 2400 + l_suppkey * 11 % 140 + 10)::INT AS y1"""
SQL_BOXES = f"boxes AS (SELECT {_BOX}, (l_partkey % 400)::BIGINT AS pixel_area, (l_suppkey % 10 / 10.0)::DOUBLE AS text_overlap_ratio, (l_partkey % 20 / 20.0)::DOUBLE AS fill_ratio, l_linenumber FROM lineitem)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = "(l_partkey * 37 + l_linenumber * 101) % 1800", "(l_suppkey * 53 + l_partkey * 17) % 2400"
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"cast(floor(l_orderkey / {ORDERS_A_PAGE}) as long) AS page", "cast(l_orderkey * 8 + l_linenumber as long) AS id", f"cast({x} as int) AS x0", f"cast({y} as int) AS y0",
        f"cast({x} + l_partkey * 7 % 160 + 10 as int) AS x1", f"cast({y} + l_suppkey * 11 % 140 + 10 as int) AS y1", "cast(l_partkey % 400 as long) AS pixel_area",
        "cast(l_suppkey % 10 / 10.0 as double) AS text_overlap_ratio", "cast(l_partkey % 20 / 20.0 as double) AS fill_ratio", "l_linenumber",
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("crop_id"), F.col("p_name").alias("raw_text"), F.col("p_partkey").alias("row_ord"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_text"))
