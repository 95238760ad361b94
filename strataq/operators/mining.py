"""Phrases of texts: counts over the corpus, core phrases a row, and their rollup."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import grams
from .cut import stored

#: Characters of a text up to which its phrases are counted in its row.
LONG = 1 << 22
LINE_PREFIX, EXAMPLE_IDS, EXAMPLE_LINES = 160, 5, 3


def ngram_frequency(df: DataFrame, text: str = "raw_text", most: int = 3) -> DataFrame:
    """Phrase, Count of runs of 1 to ``most`` tokens (across lines, never across rows), most frequent first. Counted some rows at a time in the task, then shuffled once."""
    rows = df.select(tx.frequency_tokens(text).alias("tokens")).where(F.size("tokens") > 0)
    return grams.frequencies(rows, most).groupBy("Phrase").agg(F.sum("n").alias("Count")).orderBy(F.desc("Count"), "Phrase")


def _line_tokens(line: Column) -> Column:
    # in one expression, each step once: a filter on the way would make the optimizer evaluate the steps before it again
    return tx.let(tx.strip_context_tail(line), lambda c: F.when(tx.is_noise(c), F.array().cast("array<string>")).otherwise(tx.tokenize_phrase(c)))


def _core_shuffled(df: DataFrame, keys: tuple[str, ...], text: str) -> DataFrame:
    """``core_phrases`` with a row a phrase on the way: for rows of one key, and texts too long to be counted at once."""
    each = df.select(*keys, F.posexplode(tx.lines(text)).alias("line_no", "line"))
    pairs = F.transform(_line_tokens(F.col("line")), lambda t: F.struct(t.alias("t"), tx.ascii_fold(t).alias("f")))

    def grams_of(p):
        whole = F.when((F.size(p) >= 2) & (F.size(p) <= 6), F.array(p)).otherwise(F.array().cast("array<array<struct<t:string,f:string>>>"))
        return F.filter(F.concat(whole, tx.ngrams(p, 2, 4)), lambda g: tx.valid_ngram(g["t"], folded=F.array_join(g["f"], " ")))

    out = each.select(*keys, "line_no", "line", F.explode(F.transform(tx.let(pairs, grams_of), lambda g: F.array_join(g["t"], " "))).alias("phrase"))
    out = out.groupBy(*keys, "phrase").agg(F.count("*").alias("occurrence_count"), F.min_by("line", "line_no").alias("line"))
    return out.select(*keys, "phrase", tx.ascii_fold(tx.normalize_text("phrase")).alias("normalized_phrase"), "occurrence_count", "line")


def core_phrases(df: DataFrame, *keys: str, text: str = "raw_text", source_line: bool = True) -> DataFrame:
    """keys, phrase, normalized_phrase, occurrence_count, source_line (the first line with it, unless not asked for).

    A line of 2 to 6 words gives itself and its runs of 2 to 4 words (so that of 2 to 4 words counts twice), longer ones only runs.
    Rows whose key is theirs alone, which is counted first, are counted in the row; only rows of a shared key, and texts of
    over ``LONG`` characters, become a row a phrase that is shuffled.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    shared = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).count().where("count > 1")
    long = F.length(F.coalesce(F.col(text).cast("string"), F.lit(""))) > LONG
    apart, alone = df.where(long), df.where(~long)
    if not keys or not shared.isEmpty():
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)], F.lit(True))
        whole = df.select(F.struct(*df.columns).alias("_row"), *keys)
        taken = lambda how: whole.join(shared, same, how).select("_row.*")
        apart, alone = (taken("left_semi").unionByName(taken("left_anti").where(long)), taken("left_anti").where(~long)) if keys else (df, df.limit(0))
    tokens = F.transform("lines", _line_tokens)
    rows = alone.select(*keys, tx.lines(text).alias("lines")).select(*keys, "lines", tokens.alias("tokens"))
    rest = _core_shuffled(apart, keys, text)
    out = grams.core_phrases(rows, keys, source_line).unionByName(rest if source_line else rest.drop("line"))
    columns = [*keys, "phrase", "normalized_phrase", "occurrence_count"]
    return out.select(*columns, *[tx.normalize_text("line").alias("source_line")] * source_line)


def phrase_rollup(phrases: DataFrame, row_id: str = "crop_id", row_order: str = "row_ord") -> DataFrame:
    """A row a normalised phrase: sums, distinct sources, first ids and lines, the surface form seen first.

    A phrase's rows meet once, sorted by source, so that sources are numbered as they stream by; ids and lines that a phrase
    gathers are bounded, so a phrase of a third of all rows is no group in memory. Without source_line no ExampleTexts.
    """
    seen = F.struct(F.col(row_order), (-F.col("occurrence_count")).alias("c"), F.col("phrase"))
    source = F.btrim(F.coalesce(F.col(row_id).cast("string"), F.lit("")))
    with_lines = "source_line" in phrases.columns
    columns = ["normalized_phrase", "phrase", "occurrence_count", *["source_line"] * with_lines, row_id, row_order]
    phrases = phrases.select(*dict.fromkeys(columns))
    if with_lines:
        phrases = stored(phrases)  # two aggregations, each reads some columns
    # dealt by its first two words, so that a phrase and what goes on from it are shuffled and written side by side
    begins = F.substring_index("normalized_phrase", " ", 2)
    surface = F.when(~F.col("phrase").eqNullSafe(F.col("normalized_phrase")), F.col("phrase"))
    rest = F.expr("substring(normalized_phrase, length(substring_index(normalized_phrase, ' ', 2)) + 1)")
    met = phrases.select(begins.alias("_begins"), rest.alias("_rest"), surface.alias("phrase"), "occurrence_count", *dict.fromkeys([row_id, row_order])).repartition("_begins")
    met = met.select("_begins", "_rest", F.coalesce("phrase", F.concat("_begins", "_rest")).alias("phrase"), "occurrence_count", row_order, F.when(source != "", source).alias("source"))
    met = met.withColumn("k", F.dense_rank().over(Window.partitionBy("_begins", "_rest").orderBy(F.col("source").asc_nulls_last())))
    named = F.col("source").isNotNull()
    out = met.groupBy("_begins", "_rest").agg(
        F.min_by("phrase", seen).alias("Phrase"), F.max(F.when(named, F.col("k"))).alias("SourceCount"), F.sum("occurrence_count").alias("OccurrenceCount"),
        F.array_join(F.array_sort(F.collect_set(F.when(named & (F.col("k") <= EXAMPLE_IDS), F.col("source")))), ";").alias("ExampleCropIDs"),
    ).withColumn("normalized_phrase", F.concat("_begins", "_rest"))
    own = [F.col("Phrase"), F.col("normalized_phrase").alias("NormalizedPhrase"), F.coalesce("SourceCount", F.lit(0)).cast("long").alias("SourceCount"), F.col("OccurrenceCount").cast("long"), F.col("ExampleCropIDs")]
    if not with_lines:
        return out.select(*own)
    # a stored prefix never equals a longer line, so lines beyond the prefix may repeat
    rows = phrases.select("normalized_phrase", "source_line", seen.alias("seen"))
    key = F.when(F.length("source_line") <= LINE_PREFIX, F.col("source_line")).otherwise(F.concat("source_line", F.col("seen").cast("string")))
    lines = rows.where("source_line != ''").groupBy("normalized_phrase", key.alias("key")).agg(F.min(F.struct("seen", F.substring("source_line", 1, LINE_PREFIX).alias("line"))).alias("own"))
    lines = lines.withColumn("k", F.row_number().over(Window.partitionBy("normalized_phrase").orderBy("own"))).where(F.col("k") <= EXAMPLE_LINES)
    first_lines = lines.groupBy("normalized_phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list("own")), lambda x: x["line"]), " | ").alias("ExampleTexts"))
    return out.join(first_lines, "normalized_phrase", "left").select(*own, F.coalesce("ExampleTexts", F.lit("")).alias("ExampleTexts"))


def synonym_candidates(df: DataFrame, terms: DataFrame, *, row_id: str = "crop_id", row_order: str = "row_ord", text: str = "raw_text", scorer: str = "token_set") -> DataFrame:
    """Rolled-up phrases with a suggested code, for review: most sources, then most occurrences first."""
    from .matching import suggest_codes

    rolled = phrase_rollup(core_phrases(df, row_id, row_order, text=text), row_id, row_order)
    out = suggest_codes(rolled, terms, phrase="Phrase", scorer=scorer)
    return out.withColumns({"Decision": F.lit("pending"), "Notes": F.lit("")}).orderBy(F.desc("SourceCount"), F.desc("OccurrenceCount"), "Phrase")


def analyze_text(texts: DataFrame, sheets: dict[str, DataFrame], *, row_id: str = "crop_id", text: str = "raw_text") -> tuple[dict[str, DataFrame], DataFrame]:
    """A dictionary's sheets with FrequencyAnalysis of the texts and with synonyms (made from the elements where there are none), and the texts' classification."""
    from . import classify, dictionary

    elements = sheets["Elements"]
    out = dict(sheets) | {"Synonyms": dictionary.effective_synonyms(sheets["Synonyms"], elements), "FrequencyAnalysis": ngram_frequency(texts, text)}
    negatives = sheets.get("NegativeSynonyms")
    return out, classify.classify(texts, out["Synonyms"], negatives, elements, row_id=row_id, text=text)


def token_windows(df: DataFrame, *keys: str, tokens: str = "tokens", radius: int = 1) -> DataFrame:
    """keys, token_index (from 0), token, window: each token with its neighbours, clamped at the ends."""
    each = df.select(*keys, tokens, F.posexplode(tokens).alias("token_index", "token"))
    first = F.greatest(F.lit(0), F.col("token_index") - radius)
    own = F.slice(tokens, first + 1, F.col("token_index") + radius - first + 1)
    return each.select(*keys, "token_index", "token", F.array_join(own, " ").alias("window"))


def parsed_lines(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, line_index (blank lines count), raw, normalized, tokens, kind: lines that aren't blank."""
    each = df.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\R")).alias("line_index", "raw"))
    return each.select(*keys, "line_index", tx.squeezed(F.col("raw")).alias("raw"), tx.matcher_form("raw").alias("normalized"), tx.matcher_tokens("raw").alias("tokens"), tx.line_kind("raw").alias("kind")).where("normalized != ''")


def line_segments(lines: DataFrame, *keys: str, most: int = 3) -> DataFrame:
    """Runs of 1 to ``most`` neighbouring text lines of a document: segment_type, start_line, end_line, text, raw."""
    w = Window.partitionBy(*keys).orderBy("line_index")
    at = lambda c, k: F.lead(c, k).over(w)
    own = lines.where("kind = 'text'").withColumns({f"{c}_{k}": at(c, k) for k in range(1, most) for c in ("line_index", "normalized", "raw")})
    parts = []
    for n in range(1, most + 1):
        last = "line_index" if n == 1 else f"line_index_{n - 1}"
        names = lambda c, n=n: [c, *[f"{c}_{k}" for k in range(1, n)]]
        parts.append(F.when(F.col(last).isNotNull(), F.struct(F.lit(f"{n}_line").alias("segment_type"), F.col("line_index").alias("start_line"), F.col(last).alias("end_line"), F.concat_ws(" ", *names("normalized")).alias("text"), F.concat_ws(" / ", *names("raw")).alias("raw"))))
    return own.select(*keys, F.explode(F.array_compact(F.array(*parts))).alias("s")).select(*keys, "s.*")
