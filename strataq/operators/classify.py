"""Dictionary classification: phrases found in texts score codes; the best codes name the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .dictionary import effective_synonyms
from .patterns import contains_few

THRESHOLD, MULTI_WORD, FUZZY, PRIORITY, SPLIT = 0.5, 1.3, 0.7, 100.0, 40.0
HIGH, LOW = 2, 1
#: Phrases up to which the dictionary is broadcast; larger ones meet the texts by three letters that both have.
BROADCAST_PHRASES = 20_000
UNMATCHED = "UNMATCHED"


def phrases_of(synonyms: DataFrame, negatives: DataFrame | None = None, order: str = "row_ord") -> DataFrame:
    """code, phrase (in search form), contribution, positive, ord: active synonyms, then penalties."""
    columns = {c.lower(): c for c in synonyms.columns}
    col = lambda n, d: F.coalesce(F.col(columns[n]), d) if n in columns else d
    phrase = tx.search_form("Phrase")
    weight = F.nanvl(col("weight", F.lit(1.0)).cast("double"), F.lit(0.0))
    boost = weight * F.when(F.contains(phrase, F.lit(" ")), MULTI_WORD).otherwise(1.0) * F.when(F.lower(col("matchtype", F.lit(""))) == "fuzzy", FUZZY).otherwise(1.0)
    # synonyms made from elements are ordered by row and then column
    place = F.col(f"{order}.o1").cast("long") * 10 + F.col(f"{order}.o2") if synonyms.schema[order].dataType.typeName() == "struct" else F.col(order).cast("long")
    out = synonyms.where(col("active", F.lit(True)).cast("boolean")).select(F.col("ElementCode").cast("string").alias("code"), phrase.alias("phrase"), boost.alias("contribution"), F.lit(True).alias("positive"), F.struct(F.lit(0).alias("part"), place.alias("o")).alias("ord"))
    if negatives is not None:
        penalty = F.coalesce(F.nanvl(F.col("Penalty").cast("double"), F.lit(0.0)), F.lit(0.0))
        out = out.unionByName(negatives.select(F.col("ElementCode").cast("string").alias("code"), tx.search_form("Phrase").alias("phrase"), (-penalty).alias("contribution"), F.lit(False).alias("positive"), F.struct(F.lit(1).alias("part"), F.col(order).cast("long").alias("o")).alias("ord")))
    return out.where("phrase != ''")


def contains_join(texts: DataFrame, phrases: DataFrame, broadcast_phrases: int = BROADCAST_PHRASES) -> DataFrame:
    """Inner join where ``search_text`` contains ``phrase``.

    A dictionary of a counted, small size is broadcast as an automaton, which finds all phrases in one pass over the texts
    (``patterns``). A larger one is joined by a trigram: each phrase is dealt by one of its own, each text by its different
    ones, and meetings are verified.
    """
    if phrases.limit(broadcast_phrases + 1).count() <= broadcast_phrases:
        return contains_few(texts, phrases)
    short, long = phrases.where(F.length("phrase") < 3), phrases.where(F.length("phrase") >= 3)  # short ones: bounded by the alphabet
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(F.col(c), i, F.lit(3))))
    # each phrase is dealt by its trigram that the fewest phrases have; sizes that Spark estimates don't know how many
    # trigrams a text has, so joins are told to sort: a side taken for small would go through the driver
    each = long.select("phrase").distinct().withColumn("gram", F.explode(grams("phrase")))
    rare = each.groupBy("gram").agg(F.count("*").alias("n"))
    own = each.join(rare.hint("merge"), "gram").groupBy("phrase").agg(F.min(F.struct("n", "gram")).alias("own")).select("phrase", F.col("own.gram").alias("gram"))
    keyed = long.join(own.hint("merge"), "phrase")
    dealt = texts.where(F.length("search_text") >= 3).withColumn("gram", F.explode(grams("search_text")))
    met = dealt.join(keyed.hint("merge"), "gram").where(F.contains("search_text", "phrase")).drop("gram")
    return met.unionByName(texts.join(F.broadcast(short), F.contains("search_text", "phrase")))


def hits(texts: DataFrame, phrases: DataFrame, row_id: str = "crop_id", text: str = "raw_text", **limits: int) -> DataFrame:
    """row_id, code, phrase, contribution, positive, ord: a row a phrase found."""
    own = texts.select(row_id, tx.search_form(text).alias("search_text"))
    return contains_join(own, phrases, **limits).drop("search_text")


def scores(found: DataFrame, row_id: str = "crop_id") -> DataFrame:
    """row_id, code, score, first_ord, best_phrase, phrases: sums of contributions (rounded, so that no order of addition shows)."""
    return found.groupBy(row_id, "code").agg(
        F.round(F.sum("contribution"), 9).alias("score"), F.min("ord").alias("first_ord"),
        F.max_by(F.when(F.col("positive"), F.col("phrase")), F.when(F.col("positive"), F.struct("contribution", (-F.col("ord.o")).alias("o")))).alias("best_phrase"),
        F.array_sort(F.collect_set(F.when(F.col("positive"), F.col("phrase")))).alias("phrases"),
    )


def weighted(scored: DataFrame, elements: DataFrame | None, order: str = "row_ord") -> DataFrame:
    """With priority (100 unless the dictionary has one; the last row of a code counts) and weighted score."""
    if elements is None:
        return scored.withColumn("priority", F.lit(PRIORITY)).withColumn("weighted", F.col("score"))
    own = elements.groupBy(F.col("ElementCode").cast("string").alias("code")).agg(F.max_by(F.nanvl(F.col("Priority").cast("double"), F.lit(None)), F.col(order)).alias("own_priority"))
    out = scored.join(own, "code", "left").withColumn("priority", F.coalesce("own_priority", F.lit(PRIORITY))).drop("own_priority")
    return out.withColumn("weighted", F.round(F.col("score") * F.col("priority") / 100, 9))


def ranked(weights: DataFrame, row_id: str = "crop_id", threshold: float = THRESHOLD) -> DataFrame:
    """The best codes: at most two of high and one of low priority, each over the threshold; place: their order."""
    w = Window.partitionBy(row_id, F.col("priority") >= SPLIT).orderBy(F.desc("weighted"), "first_ord")
    top = weights.where(F.col("weighted") >= threshold).withColumn("k", F.row_number().over(w))
    top = top.where(F.col("k") <= F.when(F.col("priority") >= SPLIT, HIGH).otherwise(LOW))
    return top.withColumn("place", F.when(F.col("priority") >= SPLIT, F.col("k")).otherwise(HIGH + F.col("k"))).drop("k")


def classify(texts: DataFrame, synonyms: DataFrame, negatives: DataFrame | None = None, elements: DataFrame | None = None, *, row_id: str = "crop_id", text: str = "raw_text", threshold: float = THRESHOLD, **limits: int) -> DataFrame:
    """A row a text: code, elements, confidence, keywords, tags, search text, status. Without synonyms those made from the elements are taken."""
    found = hits(texts, phrases_of(effective_synonyms(synonyms, elements), negatives), row_id, text, **limits)
    weights = weighted(scores(found, row_id), elements).withColumn("total", F.sum(F.greatest("weighted", F.lit(0.0))).over(Window.partitionBy(row_id)))
    top = ranked(weights, row_id, threshold).groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("place", "code", "weighted", "phrases"))).alias("top"), F.first("total").alias("total"))
    normal = tx.normalize_text(text)
    joined = texts.join(top, row_id, "left")
    n = F.size(F.coalesce("top", F.array()))
    codes = F.coalesce(F.transform("top", lambda t: t["code"]), F.array().cast("array<string>"))
    keywords = F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("top", lambda t: t["phrases"])))), F.array().cast("array<string>"))
    best = F.coalesce(F.col("top")[0]["weighted"], F.lit(0.0))
    out = joined.select(row_id, normal.alias("normalized_text"), codes.alias("detected_elements"), keywords.alias("keywords"), best.alias("match_score"), F.when(n > 0, F.round(best / F.when(F.col("total") > 0, F.col("total")).otherwise(1.0), 9)).otherwise(0.0).alias("confidence"))
    code = F.when(F.size("detected_elements") > 0, F.array_join("detected_elements", "-")).otherwise(UNMATCHED)
    tags = F.filter("keywords", lambda k: (F.length(k) > 2) & ~k.rlike(r"^\d+$"))
    out = out.withColumns({"classification_code": code, "search_tags": tags})
    return out.withColumns({
        "technical_phrases": F.col("keywords"),
        "sharepoint_tags": F.array_join("search_tags", "; "),
        "search_text": F.btrim(F.concat("classification_code", F.lit(" "), F.array_join("search_tags", " "), F.lit(" "), F.substring("normalized_text", 1, 120))),
        "status": F.when(F.size("detected_elements") > 0, "matched").otherwise("unmatched"),
        "matched_dictionary_key": F.coalesce(F.get("detected_elements", F.lit(0)), F.lit("")),
    })


def text_element_matches(classified: DataFrame, row_id: str = "crop_id") -> DataFrame:
    """The short report: a row a text with its code, the dictionary's key, score and normalised text."""
    return classified.select(F.col(row_id).cast("string").alias("crop_id"), "classification_code", "matched_dictionary_key", "match_score", "normalized_text")


def classification_report(classified: DataFrame, source_file: str, row_id: str = "crop_id") -> DataFrame:
    """The long report. A plan of columns has no failing rows of its own, so that error_message is empty; a failing read fails as a whole."""
    return classified.select(
        F.lit(source_file).alias("source_file"), F.col(row_id).cast("string").alias("extracted_text_file"), "normalized_text", "matched_dictionary_key", "classification_code", "match_score", "confidence", "status", F.lit("").alias("error_message")
    )
