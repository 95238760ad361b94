"""Fuzzy matching of texts with dictionaries, context inference and final selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.similarity import rounded
from .classify import contains_join
from .cut import cut
from .fuzzy_join import similar

# Fixed values of the matcher.
MIN_SCORE, CONTEXT_MIN_SCORE, LIMIT, CONTEXT_LIMIT = 75.0, 80.0, 50, 20
PASS_BONUS = {1: 0.0, 2: 10.0, 3: 15.0}
GENERIC_PENALTY, ANCHOR_FACTOR, CONTEXT_FACTOR = 15.0, 0.15, 0.25
NO_MATERIAL = ["", "none", "mixed", "unknown"]
FINAL_SCORE, STRONG_SCORE, SIDE_MIN, SIDE_APART, GROUP_LIMIT = 100.0, 95.0, 30.0, 20.0, 1
FUZZY_ACCEPT = 90.0
#: Terms or entries of which a task has an index at once, and phrases up to which an automaton is broadcast.
AT_ONCE = 20_000


# --- suggestions ---------------------------------------------------------------------------------


def _refs(terms: DataFrame) -> DataFrame:
    """t (folded), first: code and term_ord of the first term of that form."""
    folded = terms.select("code", tx.ascii_fold(tx.normalize_text("term")).alias("t"), "term_ord").where("t != ''")
    return folded.groupBy("t").agg(F.min(F.struct("term_ord", "code")).alias("first"))


def suggest_substring(candidates: DataFrame, terms: DataFrame, phrase: str = "Phrase", at_once: int = AT_ONCE) -> DataFrame:
    """candidate (in folded form), code: of the first term that contains the candidate or is contained in it.

    Each side in turn is the texts and the phrases of a ``contains_join``, so that neither way is a join of all with all.
    """
    own = cut(candidates.select(tx.ascii_fold(tx.normalize_text(phrase)).alias("candidate")).distinct())
    refs = cut(_refs(terms))
    within = contains_join(own.select("candidate", F.col("candidate").alias("search_text")), refs.select("first", F.col("t").alias("phrase")), at_once)
    around = contains_join(refs.select("first", F.col("t").alias("search_text")), own.select("candidate", F.col("candidate").alias("phrase")), at_once)
    met = within.select("candidate", "first").unionByName(around.select("candidate", "first"))
    return met.groupBy("candidate").agg(F.min("first").alias("first")).select("candidate", F.col("first.code").alias("code"))


def suggest_codes(candidates: DataFrame, terms: DataFrame, phrase: str = "Phrase", scorer: str = "token_set", accept: float = FUZZY_ACCEPT, at_once: int = AT_ONCE) -> DataFrame:
    """candidates with SuggestedElementCode, SuggestedBy, Confidence: by substring, else by the best similarity if it is accepted.

    Only candidates without a substring hit are scored, each different text once, with the terms that could be accepted.
    """
    keyed = candidates.withColumn("candidate", tx.ascii_fold(tx.normalize_text(phrase)))
    general = (F.size(F.split("candidate", " ")) == 1) & F.col("candidate").isin(tx.GENERIC_WORDS)
    different = cut(keyed.where(~general).select("candidate").distinct())
    first = cut(suggest_substring(different.withColumnRenamed("candidate", phrase), terms, phrase, at_once))
    refs = cut(_refs(terms))
    scored = similar(different.join(first, "candidate", "left_anti"), refs, scorer, accept, query="candidate", value="t", block=at_once)
    scored = scored.join(refs.withColumnRenamed("t", "value"), "value").withColumnRenamed("query", "candidate")
    # the highest score, of equal ones the first term
    best = scored.groupBy("candidate").agg(F.min(F.struct((-F.col("raw")).alias("below"), "first")).alias("best")).select("candidate", F.struct((-F.col("best.below")).alias("score"), F.col("best.first.code").alias("code")).alias("best"))
    found = first.select("candidate", "code", F.lit("substring").alias("by"), F.lit(1.0).alias("confidence")).unionByName(best.select("candidate", F.col("best.code").alias("code"), F.lit("fuzzy").alias("by"), F.round(F.col("best.score") / 100, 3).alias("confidence")))
    out = keyed.join(found, "candidate", "left")
    return out.select(*candidates.columns, F.coalesce("code", F.lit("")).alias("SuggestedElementCode"), F.coalesce("by", F.lit("")).alias("SuggestedBy"), F.coalesce("confidence", F.lit(0.0)).alias("Confidence"))


# --- matches -------------------------------------------------------------------------------------


def material_conflict(query: Column, material: Column) -> Column:
    """The query names materials, the entry has a definite one, and it isn't among them."""
    named = tx.material_groups(query)
    own = tx.matcher_form(material)
    return (F.size(named) > 0) & ~own.isin(NO_MATERIAL) & ~F.array_contains(named, own)


def valid_match(query: Column, value: Column, material: Column) -> Column:
    q, v = F.split(tx.matcher_form(query), " "), F.split(tx.matcher_form(value), " ")
    return ~material_conflict(query, material) & (~((F.size(q) > 1) & (F.size(v) == 1)) | F.array_contains(q, v[0]))


def final_score(score: Column, pass_no: Column, kind: Column, strong: Column, anchor_weight: Column) -> Column:
    bonus = F.coalesce(*[F.when(pass_no == k, F.lit(b)) for k, b in PASS_BONUS.items()], F.lit(0.0))
    penalty = F.when((kind == "generic") & (pass_no > 1), GENERIC_PENALTY).otherwise(0.0)
    return rounded(score + bonus - penalty + F.when(strong, anchor_weight * ANCHOR_FACTOR).otherwise(0.0))


def top_matches(queries: DataFrame, entries: DataFrame, *, query: str = "query", limit: int = LIMIT, least: float = MIN_SCORE, scorer: str = "weighted", at_once: int = AT_ONCE) -> DataFrame:
    """The ``limit`` entries most like each different query, of those of enough score: query, score, the entry's columns.

    The limit goes by the same score as the least, so entries below that can't take another's place, and only pairs that
    could reach it are scored (``fuzzy_join``). Ranks natively: the limit is applied in each task before the shuffle.
    """
    different = queries.select(query, F.coalesce(tx.matcher_form(query), F.lit("")).alias("_form")).distinct()
    pairs = similar(different, entries, scorer, least - 0.0501, query="_form", block=at_once)  # scores are rounded to one digit
    scored = different.join(pairs.withColumnRenamed("query", "_form"), "_form").drop("_form").join(entries, "value")
    first = Window.partitionBy(query).orderBy(F.desc("raw"), "entry_ord")
    best = scored.withColumn("k", F.row_number().over(first)).where(F.col("k") <= limit)
    return best.withColumn("score", rounded(F.col("raw"))).where(F.col("score") >= least).drop("raw", "k")


def element_hits(queries: DataFrame, entries: DataFrame, *keys: str, limit: int = LIMIT, scorer: str = "weighted") -> DataFrame:
    """keys, line_index, token_index, pass, query and the valid matches of each query with score and final_score."""
    best = top_matches(queries, entries, limit=limit, scorer=scorer)
    best = best.where(valid_match(F.col("query"), F.col("value"), F.col("material_group")))
    out = queries.select(*keys, "line_index", "token_index", "pass", "query").join(best, "query")
    return out.withColumn("final_score", final_score(F.col("score"), F.col("pass"), F.col("kind"), F.col("is_strong_anchor"), F.col("anchor_weight")))


def match_documents(lines: DataFrame, entries: DataFrame, *keys: str, limit: int = LIMIT, scorer: str = "weighted") -> DataFrame:
    """Three passes over the tokens of text lines: single words, then windows of one and two neighbours around those that hit (words of a material count as hits without being matched)."""
    own = lines.where("kind = 'text'").select(*keys, "line_index", "tokens", F.posexplode("tokens").alias("token_index", "token"))
    material = tx.is_material_token(F.col("token"))
    ones = own.where(~material).select(*keys, "line_index", "token_index", F.lit(1).alias("pass"), F.col("token").alias("query"))
    first = cut(element_hits(ones, entries, *keys, limit=limit, scorer=scorer))
    spots = first.select(*keys, "line_index", "token_index").unionByName(own.where(material).select(*keys, "line_index", "token_index")).distinct()
    near = own.join(spots, [*keys, "line_index", "token_index"])

    def window(radius: int) -> DataFrame:
        start = F.greatest(F.lit(0), F.col("token_index") - radius)
        text = F.array_join(F.slice("tokens", start + 1, F.col("token_index") + radius - start + 1), " ")
        return near.select(*keys, "line_index", "token_index", F.lit(radius + 1).alias("pass"), text.alias("query"))

    later = element_hits(window(1).unionByName(window(2)), entries, *keys, limit=limit, scorer=scorer)
    return first.unionByName(later)


def best_per_code(hits: DataFrame, *keys: str, score: str = "final_score") -> DataFrame:
    """Of each code the hit with the best final score, then raw score, then the earliest token; ties by pass and line."""
    w = Window.partitionBy(*keys, "code").orderBy(F.desc(score), F.desc("score"), "token_index", "pass", "line_index", "entry_ord")
    return hits.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def context_hits(lines: DataFrame, keywords: DataFrame, *keys: str, limit: int = CONTEXT_LIMIT, scorer: str = "weighted") -> DataFrame:
    """Best hit of each (line, signal, phrase) of text lines with context keywords."""
    own = lines.where("kind = 'text'").select(*keys, "line_index", F.col("normalized").alias("query"))
    found = own.join(top_matches(own, keywords, limit=limit, least=CONTEXT_MIN_SCORE, scorer=scorer), "query")
    return best_context(found, *keys)


def best_context(hits: DataFrame, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys, "line_index", "context_signal", "value").orderBy(F.desc("score"), "entry_ord")
    return hits.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


# --- context -------------------------------------------------------------------------------------


def infer_context(elements: DataFrame, context: DataFrame, *keys: str) -> DataFrame:
    """A row a document: side, position (or unresolved), their scores, and scores of groups in falling order."""
    parts = ["side_signal", "side_weight", "position_signal", "position_weight"]
    signals = elements.select(*keys, *parts, F.col("final_score").alias("s"), F.col("context_group").alias("group")).unionByName(context.select(*keys, *parts, F.col("score").alias("s"), F.col("context_signal").alias("group")))
    factor = F.col("s") / 100
    side = lambda x: F.round(F.sum(F.when(F.col("side_signal") == x, F.col("side_weight") * factor).when(F.col("side_signal") == "both", F.col("side_weight") * 0.5 * factor).otherwise(0.0)), 6).alias(x)
    place = lambda x: F.round(F.sum(F.when(F.col("position_signal") == x, F.col("position_weight") * factor).otherwise(0.0)), 6).alias(x)
    sums = signals.groupBy(*keys).agg(side("external"), side("internal"), place("base"), place("middle"), place("top"))
    groups = signals.where("coalesce(group, '') != ''").groupBy(*keys, "group").agg(F.round(F.sum("s"), 6).alias("s"))
    groups = groups.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("n"), "group"))).alias("g"))
    best_side = F.when(F.col("external") >= F.col("internal"), "external").otherwise("internal")
    unclear = (F.greatest("external", "internal") < SIDE_MIN) | (F.abs(F.col("external") - F.col("internal")) < SIDE_APART)
    most = F.greatest("base", "middle", "top")
    best_place = F.when(F.col("base") == most, "base").when(F.col("middle") == most, "middle").otherwise("top")
    out = sums.join(groups, list(keys), "left")
    return out.select(
        *keys, F.when(unclear, "unresolved").otherwise(best_side).alias("side"), F.when(most < SIDE_MIN, "unresolved").otherwise(best_place).alias("position"),
        "external", "internal", "base", "middle", "top",
        F.coalesce(F.transform("g", lambda x: F.struct(x["group"].alias("group"), (-x["n"]).alias("score"))), F.array().cast("array<struct<group:string,score:double>>")).alias("context_groups"),
    )


def context_boost(hits: DataFrame, context: DataFrame, *keys: str) -> DataFrame:
    """hits with the context's side and position, context_boost and final_score_context. One context row a document: broadcast is left to the optimizer."""
    both = hits.join(context.select(*keys, F.col("side").alias("detail_side"), F.col("position").alias("detail_position")), list(keys), "left")
    side = F.when(F.col("detail_side") == "unresolved", 0.0).when(F.col("side_signal") == F.col("detail_side"), F.col("side_weight") * CONTEXT_FACTOR).when(F.col("side_signal") == "both", F.col("side_weight") * CONTEXT_FACTOR * 0.5).otherwise(0.0)
    place = F.when((F.col("detail_position") != "unresolved") & (F.col("position_signal") == F.col("detail_position")), F.col("position_weight") * CONTEXT_FACTOR).otherwise(0.0)
    boost = F.coalesce(side, F.lit(0.0)) + F.coalesce(place, F.lit(0.0))
    return both.withColumns({"context_boost": rounded(boost), "final_score_context": rounded(F.col("final_score") + boost)})


def fit_score() -> Column:
    """Score in the context, more for what agrees with its side and position, less for what contradicts."""
    side = F.when(F.col("detail_side") == "unresolved", 0.0).when(F.col("side_signal") == F.col("detail_side"), 20.0).when(~F.col("side_signal").isin("both", "unknown"), -30.0).otherwise(0.0)
    place = F.when(F.col("detail_position") == "unresolved", 0.0).when(F.col("position_signal") == F.col("detail_position"), 20.0).when(~F.col("position_signal").isin("any", "unknown"), -15.0).otherwise(0.0)
    return rounded(F.col("final_score_context") + side + place)


def final_candidates(boosted: DataFrame, *keys: str, limit: int = GROUP_LIMIT) -> DataFrame:
    """The best of each context group among strong hits; order them by detail_fit_score."""
    one_word = (F.col("pass") == 1) & (F.size(F.split("query", " ")) == 1) & (F.col("kind") == "specific")
    strong = (F.col("final_score_context") >= FINAL_SCORE) & ~(((F.col("kind") == "generic") | one_word) & (F.col("score") < STRONG_SCORE))
    own = boosted.where(strong).withColumn("detail_fit_score", fit_score()).withColumn("group", F.when(F.coalesce("context_group", F.lit("")) == "", "unknown").otherwise(F.col("context_group")))
    w = Window.partitionBy(*keys, "group").orderBy(F.desc("detail_fit_score"), F.desc(F.col("kind") == "specific"), F.desc("final_score_context"), F.desc("score"), F.desc("priority"), "code")
    return own.withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit).drop("k")


def match(texts: DataFrame, elements: DataFrame, keywords: DataFrame, doc: str = "doc_id", text: str = "text", scorer: str = "weighted") -> DataFrame:
    """The whole matcher: texts to final candidates, a document at a time in meaning, all at once in the plan."""
    from .mining import parsed_lines

    lines = cut(parsed_lines(texts, doc, text=text))
    best = cut(best_per_code(match_documents(lines, elements, doc, scorer=scorer), doc))
    context = infer_context(best, context_hits(lines, keywords, doc, scorer=scorer), doc)
    return final_candidates(best_per_code(context_boost(best, context, doc), doc, score="final_score_context"), doc).orderBy(doc, F.desc("detail_fit_score"), F.desc("score"), F.desc("priority"))
