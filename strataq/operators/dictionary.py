"""Dictionaries: open tables of elements, synonyms and keywords as long ones, and the review of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Names that a column may have, in the order of preference.
CODE = ("ElementCode", "Code")
NAME_PL = ("NamePL", "PolishName", "Name_PL", "nazwa polska")
NAME_EN = ("NameEN", "EnglishName", "Name_EN", "nazwa angielska")
CATEGORY = ("Category", "Family", "Group")
TITLES = ("TitlePL", "TitleEN", "NamePL", "NameEN")
# Columns of the matcher's tables that are no phrases.
ELEMENT_META = ("ElementCode", "Priority", "ContextGroup", "MaterialGroup", "SideSignal", "SideWeight", "PositionSignal", "PositionWeight", "IsStrongAnchor", "AnchorWeight", "Notes")
KEYWORD_META = ("ContextSignal", "SideSignal", "SideWeight", "PositionSignal", "PositionWeight", "Notes")
# Weights of phrases made from names.
FALLBACK_WEIGHTS = (1.0, 1.0, 0.35)
SYNONYMS = "ElementCode string, Phrase string, Weight double, MatchType string, Active boolean"
# Sheets of a dictionary and their columns.
SHEETS = {
    "Elements": "ElementCode string, TitlePL string, TitleEN string, Category string, Priority double",
    "Synonyms": "ElementCode string, Language string, Phrase string, Weight double, MatchType string, Active boolean",
    "NegativeSynonyms": "ElementCode string, Phrase string, Penalty double",
    "StopWords": "Phrase string",
    "FrequencyAnalysis": "Phrase string, Count long, ExampleCropIDs string",
}


def find_column(df: DataFrame, *names: str) -> str | None:
    """The column that has one of the names, case and outer blanks aside; the first name that fits wins."""
    own = {c.strip().lower(): c for c in reversed(df.columns)}
    return next((own[n.strip().lower()] for n in names if n.strip().lower() in own), None)


def _ref(name: str) -> Column:
    return F.col(f"`{name}`")


def _phrase(c: Column, compat_nan_text: bool) -> Column:
    """Normalised; "nan" (a blank cell's text elsewhere) is no phrase unless asked for."""
    out = tx.normalize_text(c)
    return out if compat_nan_text else F.when(out != "nan", out).otherwise("")


def unpivoted(df: DataFrame, columns: list[str], order: str = "row_ord") -> DataFrame:
    """df's other columns, column (its number), value: a row a cell, by row and then column."""
    rest = [c for c in df.columns if c not in columns]
    cells = F.array(*[F.struct(F.lit(i).alias("column"), _ref(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    return df.select(*[_ref(c) for c in rest], F.explode(cells).alias("cell")).select(*[_ref(c) for c in rest], "cell.column", "cell.value")


def synonyms_from_elements(elements: DataFrame, order: str = "row_ord") -> DataFrame:
    """Phrases of names (weight 1) and categories (0.35) of each element, the first of equal (code, phrase)."""
    code = find_column(elements, *CODE)
    named = [(c, w) for c, w in zip((find_column(elements, *NAME_PL), find_column(elements, *NAME_EN), find_column(elements, *CATEGORY)), FALLBACK_WEIGHTS) if c]
    if code is None or not named:
        return elements.sparkSession.createDataFrame([], SYNONYMS)
    rows = F.array(*[F.struct(F.lit(i).alias("column"), _phrase(_ref(c), False).alias("Phrase"), F.lit(w).alias("Weight")) for i, (c, w) in enumerate(named)])
    each = elements.select(F.btrim(_ref(code).cast("string")).alias("ElementCode"), _ref(order).alias("o"), F.explode(rows).alias("s"))
    each = each.where("ElementCode != '' and s.Phrase != ''").groupBy("ElementCode", "s.Phrase").agg(F.min_by("s.Weight", F.struct("o", "s.column")).alias("Weight"), F.min(F.struct("o", "s.column")).alias("o"))
    return each.select("ElementCode", "Phrase", "Weight", F.lit("exact").alias("MatchType"), F.lit(True).alias("Active"), F.col("o.o").alias("o1"), F.col("o.column").alias("o2"))


def effective_synonyms(synonyms: DataFrame, elements: DataFrame | None, order: str = "row_ord") -> DataFrame:
    """The synonyms; where there are none, those made from the elements' names."""
    if elements is None or not synonyms.isEmpty():
        return synonyms
    return synonyms_from_elements(elements, order).withColumn(order, F.struct("o1", "o2"))


def reference_terms(elements: DataFrame, synonyms: DataFrame, order: str = "row_ord") -> DataFrame:
    """code, term, term_ord: titles by row and column, then synonyms."""
    parts = []
    code = find_column(elements, *CODE)
    titles = [c for c in (find_column(elements, t) for t in TITLES) if c]
    if code and titles:
        cells = unpivoted(elements.select(F.btrim(_ref(code).cast("string")).alias("code"), _ref(order).alias("o"), *[_ref(t) for t in titles]), titles)
        parts.append(cells.select("code", _phrase(F.col("value"), False).alias("term"), F.lit(0).alias("part"), "o", "column"))
    s_code, s_phrase = find_column(synonyms, "ElementCode"), find_column(synonyms, "Phrase")
    if s_code and s_phrase:
        parts.append(synonyms.select(F.btrim(_ref(s_code).cast("string")).alias("code"), _phrase(_ref(s_phrase), False).alias("term"), F.lit(1).alias("part"), _ref(order).alias("o"), F.lit(0).alias("column")))
    if not parts:
        return elements.sparkSession.createDataFrame([], "code string, term string, term_ord struct<part:int,o:int,column:int>")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.where("code != '' and term != ''").select("code", "term", F.struct("part", F.col("o").cast("long").alias("o"), "column").alias("term_ord"))


def import_accepted(synonyms: DataFrame, candidates: DataFrame, order: str = "row_ord", keep_order: bool = False) -> DataFrame:
    """Synonyms and accepted candidates (weight 1, exact, active), the first of equal (code, phrase); with an order if asked for, in which candidates follow synonyms."""
    own = candidates.where((F.lower(F.btrim(F.coalesce("Decision", F.lit("")))) == "accept") & (F.btrim(F.coalesce("SuggestedElementCode", F.lit(""))) != "") & (F.btrim(F.coalesce("Phrase", F.lit(""))) != ""))
    new = own.select(F.btrim("SuggestedElementCode").alias("ElementCode"), F.btrim("Phrase").alias("Phrase"), F.lit(1.0).alias("Weight"), F.lit("exact").alias("MatchType"), F.lit(True).alias("Active"), F.lit(1).alias("part"), _ref(order).alias("o"))
    defaults = {"Weight": F.lit(1.0), "MatchType": F.lit("exact"), "Active": F.lit(True)}
    old = synonyms.withColumns({c: v for c, v in defaults.items() if c not in synonyms.columns}).withColumnRenamed(order, "o").withColumn("part", F.lit(0))
    both = old.unionByName(new, allowMissingColumns=True)
    first = Window.partitionBy("ElementCode", "Phrase").orderBy("part", "o")
    kept = both.withColumn("k", F.row_number().over(first)).where("k = 1")
    if not keep_order:
        return kept.drop("k", "part", "o")
    behind = (synonyms.agg(F.max(_ref(order).cast("long"))).first()[0] or 0) + 1
    return kept.withColumn(order, F.col("o").cast("long") + F.when(F.col("part") == 1, behind).otherwise(0)).drop("k", "part", "o")


def matcher_elements(df: DataFrame, order: str = "row_ord") -> DataFrame:
    """Long form of the matcher's elements: every column that is no meta column holds phrases."""
    meta = {m.lower() for m in ELEMENT_META} | {order}
    phrases = [c for c in df.columns if c.strip().lower() not in meta]
    col = lambda n: _ref(c) if (c := find_column(df, n)) else F.lit(None).cast("string")
    # a plain number cell reads as "1 0", which is none of these
    base = df.select(
        F.btrim(col("ElementCode").cast("string")).alias("code"), tx.to_float(col("Priority").cast("string")).alias("priority"), tx.matcher_form(col("ContextGroup")).alias("context_group"), tx.matcher_form(col("MaterialGroup")).alias("material_group"),
        tx.canonical_side(col("SideSignal")).alias("side_signal"), tx.to_float(col("SideWeight").cast("string")).alias("side_weight"), tx.canonical_position(col("PositionSignal")).alias("position_signal"), tx.to_float(col("PositionWeight").cast("string")).alias("position_weight"),
        tx.matcher_form(col("IsStrongAnchor")).isin("yes", "true", "1", "tak").alias("is_strong_anchor"), tx.to_float(col("AnchorWeight").cast("string")).alias("anchor_weight"), _ref(order).alias("o"), *[_ref(c) for c in phrases],
    )
    return _entries(base, phrases)


def context_keywords(df: DataFrame, order: str = "row_ord") -> DataFrame:
    """Long form of the matcher's context keywords."""
    meta = {m.lower() for m in KEYWORD_META} | {order}
    phrases = [c for c in df.columns if c.strip().lower() not in meta]
    col = lambda n: _ref(c) if (c := find_column(df, n)) else F.lit(None).cast("string")
    base = df.select(
        tx.matcher_form(col("ContextSignal")).alias("context_signal"), tx.canonical_side(col("SideSignal")).alias("side_signal"), tx.to_float(col("SideWeight").cast("string")).alias("side_weight"),
        tx.canonical_position(col("PositionSignal")).alias("position_signal"), tx.to_float(col("PositionWeight").cast("string")).alias("position_weight"), _ref(order).alias("o"), *[_ref(c) for c in phrases],
    )
    return _entries(base, phrases)


def _entries(base: DataFrame, phrases: list[str]) -> DataFrame:
    each = unpivoted(base, phrases).withColumn("value", tx.matcher_form("value")).where("value != ''")
    return each.withColumn("kind", tx.entry_kind("value")).withColumn("entry_ord", F.struct(F.col("o").cast("long").alias("o"), "column")).drop("o", "column")
