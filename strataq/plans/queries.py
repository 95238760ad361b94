"""A query an operator over the whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx
from ..operators import boxes as bx
from ..operators import classify as cl
from ..operators import dictionary as dc
from ..operators import export as ex
from ..operators import extraction as xt
from ..operators import ink as ik
from ..operators import matching as mt
from ..operators import mining as mn
from .fixtures import PAGE_HEIGHT, PAGE_WIDTH, boxes, documents, frame, grown, parts, table

TAILED = " D=40 mm, gr. 12 mm; 3 mm thick acc. to specification"


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", tx.normalize_text("raw_text").alias("normalized"))


def ascii_fold(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", tx.ascii_fold("raw_text").alias("folded"))


def strip_tail(spark: SparkSession, d: str) -> DataFrame:
    lines = documents(spark, d).select("doc_id", F.posexplode(tx.lines("raw_text")).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("long"), tx.strip_context_tail(F.concat("line", F.lit(TAILED))).alias("core"))


def noise_filter(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    forms = F.array(size, F.concat(size, F.lit(" mm")), F.concat(F.lit("D = "), size, F.lit(",5 cm")), F.concat(F.lit("REI"), size), F.concat(size, F.lit(" x "), size, F.lit(" mm")), F.col("p_name"), F.substring("p_name", 1, 3), F.concat(F.lit("gr. "), size, F.lit(" mm")))
    each = table(spark, d, "part").select("p_partkey", F.posexplode(forms).alias("form", "text"))
    return each.select("p_partkey", F.col("form").cast("long"), tx.is_noise("text").alias("noise"))


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    own = documents(spark, d).select("doc_id", tx.words(tx.normalize_text("raw_text")).alias("w"))
    return own.select("doc_id", F.size("w").cast("long").alias("tokens"), F.size(F.array_distinct("w")).cast("long").alias("different"), F.array_join("w", "|").alias("joined"))


def safe_filename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", tx.safe_filename(F.concat(F.lit(" Żółć: "), F.col("p_name"), F.lit(' /#1*"? '), F.col("p_partkey").cast("string"), F.lit(" "))).alias("name"))


def line_kind(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    each = table(spark, d, "part").select("p_partkey", F.posexplode(F.array(size, F.concat(F.lit("+"), size, F.lit(".56")), F.col("p_name"), F.concat(size, F.lit(" "), F.col("p_name")), F.concat(size, F.lit(" 1 2 3 "), F.col("p_name")))).alias("form", "text"))
    return each.select("p_partkey", F.col("form").cast("long"), tx.matcher_form("text").alias("normalized"), tx.line_kind("text").alias("kind"))


def _dictionary(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return frame(spark, "SYNONYMS"), frame(spark, "NEGATIVES"), frame(spark, "PRIORITIES")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("crop_id", "classification_code", F.array_join("detected_elements", ",").alias("elements"), "match_score", "confidence", F.array_join("keywords", ",").alias("keywords"), "sharepoint_tags", "search_text", "status", "matched_dictionary_key", "normalized_text")


def classify(spark: SparkSession, d: str) -> DataFrame:
    synonyms, negatives, elements = _dictionary(spark)
    return _shown(cl.classify(parts(spark, d), synonyms, negatives, elements))


def classify_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _shown(cl.classify(parts(spark, d), frame(spark, "SYNONYMS").limit(0), None, frame(spark, "ELEMENTS")))


def classify_scores(spark: SparkSession, d: str) -> DataFrame:
    synonyms, negatives, elements = _dictionary(spark)
    found = cl.weighted(cl.scores(cl.hits(parts(spark, d), cl.phrases_of(synonyms, negatives))), elements)
    return found.select("crop_id", "code", "score", "priority", "weighted", "best_phrase", F.array_join("phrases", ",").alias("phrases"))


def classify_large_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """The trigram join, which a dictionary beyond the broadcast limit takes."""
    synonyms, negatives, _ = _dictionary(spark)
    found = cl.hits(parts(spark, d), cl.phrases_of(synonyms, negatives), broadcast_phrases=0)
    return found.groupBy("crop_id", "code").agg(F.round(F.sum("contribution"), 9).alias("score"), F.count("*").alias("hits"))


def ngram_frequency(spark: SparkSession, d: str) -> DataFrame:
    return mn.ngram_frequency(documents(spark, d)).select(F.col("Phrase").alias("phrase"), F.col("Count").alias("n"))


def core_phrases(spark: SparkSession, d: str) -> DataFrame:
    return mn.core_phrases(documents(spark, d), "doc_id", source_line=False).select("doc_id", "phrase", "normalized_phrase", "occurrence_count")


def phrase_rollup(spark: SparkSession, d: str) -> DataFrame:
    found = mn.phrase_rollup(mn.core_phrases(documents(spark, d), "doc_id", source_line=False), "doc_id", "doc_id")
    return found.select(F.col("NormalizedPhrase").alias("normalized_phrase"), F.col("Phrase").alias("surface"), F.col("SourceCount").alias("sources"), F.col("OccurrenceCount").alias("occurrences"), F.col("ExampleCropIDs").alias("ids"))


def token_window(spark: SparkSession, d: str) -> DataFrame:
    own = parts(spark, d).select("crop_id", tx.matcher_tokens(F.concat_ws(" ", "raw_text", "raw_text", F.lit("end"), "raw_text")).alias("tokens"))
    both = mn.token_windows(own, "crop_id", radius=1).withColumn("radius", F.lit(1)).unionByName(mn.token_windows(own, "crop_id", radius=2).withColumn("radius", F.lit(2)))
    return both.select("crop_id", F.col("token_index").cast("long"), "radius", "window")


def line_segments(spark: SparkSession, d: str) -> DataFrame:
    lines = mn.parsed_lines(documents(spark, d), "doc_id", text="raw_text")
    return mn.line_segments(lines, "doc_id").select("doc_id", "segment_type", F.col("start_line").cast("long"), F.col("end_line").cast("long"), "text")


def unpivot_elements(spark: SparkSession, d: str) -> DataFrame:
    own = dc.matcher_elements(grown(spark, d, "MATCHER"))
    return own.select("code", "priority", "context_group", "material_group", "side_signal", "side_weight", "position_signal", "position_weight", "is_strong_anchor", "anchor_weight", "value", "kind")


def context_keywords(spark: SparkSession, d: str) -> DataFrame:
    return dc.context_keywords(grown(spark, d, "KEYWORDS")).select("context_signal", "side_signal", "side_weight", "position_signal", "position_weight", "value", "kind")


def reference_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = dc.reference_terms(grown(spark, d, "ELEMENTS"), grown(spark, d, "SYNONYMS"))
    return terms.select("code", "term", (F.col("term_ord.part") * 1000 + F.col("term_ord.o") * 10 + F.col("term_ord.column")).cast("long").alias("ord"))


def synonyms_from_elements(spark: SparkSession, d: str) -> DataFrame:
    return dc.synonyms_from_elements(grown(spark, d, "ELEMENTS")).select(F.col("ElementCode").alias("code"), F.col("Phrase").alias("phrase"), F.col("Weight").alias("weight"))


def suggest_substring(spark: SparkSession, d: str) -> DataFrame:
    terms = dc.reference_terms(frame(spark, "ELEMENTS"), frame(spark, "SYNONYMS"))
    own = parts(spark, d).select(F.col("raw_text").alias("Phrase"))
    return mt.suggest_substring(own, terms)


def suggest_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    terms = dc.reference_terms(frame(spark, "ELEMENTS"), frame(spark, "SYNONYMS"))
    own = parts(spark, d).select("crop_id", F.regexp_replace("raw_text", "([a-z])l", "$1").alias("Phrase"))
    return mt.suggest_codes(own, terms, accept=60.0)


def import_accepted(spark: SparkSession, d: str) -> DataFrame:
    out = dc.import_accepted(grown(spark, d, "SYNONYMS"), grown(spark, d, "CANDIDATES"))
    return out.select(F.col("ElementCode").alias("code"), F.col("Phrase").alias("phrase"), F.col("Weight").alias("weight"), F.col("MatchType").alias("match_type"), F.col("Active").alias("active"))


def canonical_maps(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("EXT", "zewnętrzny ", "int", "oba", "any", "", "left", "dół", "Góra", "mid")])
    own = table(spark, d, "part").select("p_partkey", F.get(words, (F.col("p_partkey") % 10).cast("int")).alias("w"))
    return own.select("p_partkey", tx.canonical_side("w").alias("side"), tx.canonical_position("w").alias("position"))


def material_conflict(spark: SparkSession, d: str) -> DataFrame:
    materials = F.array(*[F.lit(w) for w in ("steel", "rc", "masonry", "mixed", "", "plasterboard")])
    queries = F.array(F.lit("steel "), F.lit("concrete brick "), F.lit(""), F.lit("murowana "))
    own = table(spark, d, "part").select("p_partkey", F.concat(F.get(queries, (F.col("p_partkey") % 4).cast("int")), "p_name").alias("q"), F.get(materials, (F.col("p_partkey") % 6).cast("int")).alias("m"))
    return own.select("p_partkey", F.array_join(tx.material_groups("q"), ",").alias("materials"), mt.material_conflict(F.col("q"), F.col("m")).alias("conflict"), mt.valid_match(F.col("q"), F.lit("steel"), F.col("m")).alias("valid"))


def numbers(spark: SparkSession, d: str) -> DataFrame:
    texts = F.array(F.lit("12.5"), F.lit("abc"), F.lit("NaN"), F.lit(None).cast("string"), F.lit(" 7 "))
    return table(spark, d, "part").select("p_partkey", tx.to_float(F.get(texts, (F.col("p_partkey") % 5).cast("int")), 1.5).alias("n"))


# --- extraction and export -----------------------------------------------------------------------


def _colors(n):
    shift = (n % 9 - 4).cast("int")
    one = F.struct(F.lit(0).alias("r"), (85 + shift).alias("g"), F.lit(1).alias("b"))
    two = F.struct(F.lit(2).alias("r"), F.lit(0).alias("g"), (139 + shift).alias("b"))
    return F.when(n % 4 == 0, one).when(n % 4 == 1, two).when(n % 4 == 2, F.struct(F.lit(255).alias("r"), F.lit(254).alias("g"), F.lit(0).alias("b")))


def area_type(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", xt.area_type(_colors(n), _colors(n + 1)).alias("area_type"))


def clip_sanitize(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey")
    odd = F.when(n % 11 == 0, F.lit(float("nan"))).when(n % 13 == 0, F.lit(float("inf")))
    rect = F.struct(F.coalesce(odd, (n * 7 % 300).cast("double")).alias("x0"), (n * 3 % 250).cast("double").alias("y0"), (n * 11 % 300).cast("double").alias("x1"), (n * 5 % 250).cast("double").alias("y1"))
    bound = F.when(n % 3 == 0, F.struct(*[(rect[s] - 5).alias(s) for s in g.SIDES]))
    page = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(200.0).alias("x1"), F.lit(200.0).alias("y1"))
    own = table(spark, d, "part").select("p_partkey", rect.alias("rect"), bound.alias("bound"), page.alias("page"))
    own = own.select("p_partkey", g.sanitized("rect", "page").alias("s"), g.crop_rect("bound", "rect", "page").alias("c"))
    return own.select("p_partkey", *[F.col(f"s.{x}").alias(f"s_{x}") for x in g.SIDES], *[F.col(f"c.{x}").alias(f"c_{x}") for x in g.SIDES])


def extraction_report(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey")
    rect = F.struct(*[((n * k) % 180).cast("double").alias(s) for s, k in zip(g.SIDES, (7, 3, 7 + 2, 5))])
    page = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(200.0).alias("x1"), F.lit(200.0).alias("y1"))
    green = F.array(F.lit(0.0), F.lit(85 / 255), F.lit(0.0))
    own = table(spark, d, "part").select(
        F.lit("a.pdf").alias("source_pdf"), F.floor(n / 50).cast("int").alias("page_index"), n.alias("order"), F.when(n % 5 == 0, "Circle").otherwise("Square").alias("kind"), rect.alias("rect"), F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>").alias("bound"), page.alias("page"),
        F.when(n % 3 != 0, green).alias("stroke"), F.lit(None).cast("array<double>").alias("fill"), F.when(n % 2 == 0, F.col("p_name")).alias("native_text"), F.lit("read text").alias("ocr_text"),
    )
    crops, report = xt.extract(own, "My Project")
    texts = crops.select(F.col("crop_id").alias("base_name"), F.col("raw_text"), "text_source")
    return report.join(texts, "base_name", "left").select(F.col("page_index").cast("long"), F.col("annotation_index").cast("long"), "status", "reason", "base_name", "raw_text", "text_source")


def export_metadata(spark: SparkSession, d: str) -> DataFrame:
    synonyms, negatives, elements = _dictionary(spark)
    classes = cl.classify(parts(spark, d), synonyms, negatives, elements).select("crop_id", F.col("classification_code").alias("proposed_code")).where("crop_id % 7 != 0")
    rows = parts(spark, d).withColumn("page_number", (F.col("row_ord") % 40).cast("long"))
    return ex.export_metadata(rows, classes, "PROJECT").select("crop_id", "page_number", "proposed_code", F.col("FileName").alias("file_name"), "export_status")


# --- boxes ---------------------------------------------------------------------------------------


def box_metrics(spark: SparkSession, d: str) -> DataFrame:
    big = g.expanded(35, F.lit(PAGE_WIDTH), F.lit(PAGE_HEIGHT))
    return boxes(spark, d).select("page", "id", g.width().cast("long").alias("w"), g.height().cast("long").alias("h"), g.area().alias("area"), big["x0"].cast("long").alias("ex0"), big["y1"].cast("long").alias("ey1"), F.round(g.to_points(150)["x1"], 4).alias("px1"))


def component_kind(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("page", "id", bx.component_kind().alias("kind"))


def geometry_role(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("page", "id", bx.geometry_role().alias("role"))


def fallback_cores(spark: SparkSession, d: str) -> DataFrame:
    own = boxes(spark, d).withColumn("role", F.when(F.col("page") % 3 == 0, "small").otherwise(bx.geometry_role()))
    return bx.fallback_cores(own).select("page", "id", "role")


def touch_pairs(spark: SparkSession, d: str) -> DataFrame:
    return bx.touch_pairs(boxes(spark, d), 6)


def absorb_pairs(spark: SparkSession, d: str) -> DataFrame:
    return bx.absorb_pairs(boxes(spark, d), 8, 0.25)


def box_components(spark: SparkSession, d: str) -> DataFrame:
    return bx.touch_components(boxes(spark, d), 6)


def absorb_boxes(spark: SparkSession, d: str) -> DataFrame:
    out = bx.absorb_merged(boxes(spark, d), 8, 0.25)
    return out.select("page", "id", *[F.col(s).cast("long").alias(s) for s in g.SIDES])


def attach_small(spark: SparkSession, d: str) -> DataFrame:
    own = boxes(spark, d)
    return bx.attach_small(own.where("l_linenumber = 1"), own.where("l_linenumber > 1"))


def attach_text(spark: SparkSession, d: str) -> DataFrame:
    own = boxes(spark, d)
    return bx.attach_text(own.where("l_linenumber = 1"), own.where("l_linenumber > 1"))


def side_knn(spark: SparkSession, d: str) -> DataFrame:
    own = boxes(spark, d)
    return bx.side_texts(own.where("l_linenumber = 1"), own.where("l_linenumber > 1"), 45, 25, 4).select("page", "core", "side", "text_id", F.col("dx").cast("long"))


def percentile_split(spark: SparkSession, d: str) -> DataFrame:
    return bx.percentile_split(boxes(spark, d)).select("page", "id", "part")


def unique_texts(spark: SparkSession, d: str) -> DataFrame:
    own = boxes(spark, d).withColumns({s: (F.floor(F.col(s) / 400) * 400).cast("int") for s in g.SIDES}).withColumn("text", (F.col("id") % 3).cast("string"))
    return bx.unique_texts(own).select("page", "id")


def greedy_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return bx.suppressed(boxes(spark, d).select(*bx.COLUMNS), 0.8).select("page", "id")


def detail_candidates(spark: SparkSession, d: str) -> DataFrame:
    own = boxes(spark, d)
    grown = own.withColumns({"x1": F.col("x1") + F.when(F.col("l_linenumber") == 1, 120).otherwise(0), "y1": F.col("y1") + F.when(F.col("l_linenumber") == 1, 120).otherwise(0)})
    comps = grown.where("l_linenumber in (1, 2)").withColumns({"kind": F.lit("geometry"), "text_overlap_ratio": F.lit(0.0), "fill_ratio": F.lit(0.2)})
    texts = own.where("l_linenumber > 2").withColumn("text", F.col("id").cast("string"))
    pages = own.select("page").distinct().withColumns({"w": F.lit(PAGE_WIDTH), "h": F.lit(PAGE_HEIGHT)})
    out = bx.detail_candidates(comps, texts, pages, bx.CATALOGUE)
    return out.select("page", "id", *g.SIDES, F.array_join(F.col("text_ids").cast("array<string>"), ",").alias("text_ids"))


# --- matcher -------------------------------------------------------------------------------------


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Hits with given scores: parts stand for documents' tokens, entries for what they match."""
    entries = dc.matcher_elements(frame(spark, "MATCHER")).where("entry_ord.column = 0")
    own = table(spark, d, "part").select((F.floor(F.col("p_partkey") / 20)).cast("long").alias("doc_id"), F.col("p_partkey").alias("n"), "p_name")
    hits = own.join(F.broadcast(entries), F.pmod(F.col("n"), F.lit(5)) == F.col("entry_ord.o"))
    hits = hits.withColumns({"score": (75 + F.col("n") % 26).cast("double"), "pass": (F.col("n") % 3 + 1).cast("int"), "token_index": (F.col("n") % 4).cast("int"), "line_index": (F.col("n") % 20).cast("int"), "query": F.col("p_name")})
    return hits.withColumn("final_score", mt.final_score(F.col("score"), F.col("pass"), F.col("kind"), F.col("is_strong_anchor"), F.col("anchor_weight")))


def _context(spark: SparkSession, d: str) -> DataFrame:
    words = dc.context_keywords(frame(spark, "KEYWORDS")).where("entry_ord.column = 0")
    own = table(spark, d, "part").select((F.floor(F.col("p_partkey") / 20)).cast("long").alias("doc_id"), F.col("p_partkey").alias("n"))
    hits = own.join(F.broadcast(words), F.pmod(F.col("n"), F.lit(6)) == F.col("entry_ord.o"))
    return mt.best_context(hits.withColumns({"score": (80 + F.col("n") % 21).cast("double"), "line_index": (F.col("n") % 5).cast("int")}), "doc_id")


def dedupe_elements(spark: SparkSession, d: str) -> DataFrame:
    return mt.best_per_code(_scored(spark, d), "doc_id").select("doc_id", "code", "n", "score", "final_score")


def infer_context(spark: SparkSession, d: str) -> DataFrame:
    out = mt.infer_context(mt.best_per_code(_scored(spark, d), "doc_id"), _context(spark, d), "doc_id")
    return out.select("doc_id", "side", "position", "external", "internal", "base", "middle", "top", F.array_join(F.transform("context_groups", lambda x: x["group"]), ",").alias("groups"))


def _boosted(spark: SparkSession, d: str) -> DataFrame:
    best = mt.best_per_code(_scored(spark, d), "doc_id")
    return mt.context_boost(best, mt.infer_context(best, _context(spark, d), "doc_id"), "doc_id")


def context_boost(spark: SparkSession, d: str) -> DataFrame:
    return _boosted(spark, d).select("doc_id", "code", "context_boost", "final_score_context", mt.fit_score().alias("fit"))


def final_candidates(spark: SparkSession, d: str) -> DataFrame:
    return mt.final_candidates(_boosted(spark, d), "doc_id").select("doc_id", "group", "code", "detail_fit_score")


def fuzzy_topk(spark: SparkSession, d: str) -> DataFrame:
    entries = dc.matcher_elements(frame(spark, "MATCHER"))
    own = parts(spark, d).select(F.col("raw_text").alias("query"))
    return mt.top_matches(own, entries).select("query", "code", "value", "score")


def _named_types(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary from the parts: type and name in small letters, with the brand and the number of its first part."""
    own = table(spark, d, "part").groupBy(F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("value")).agg(F.min("p_partkey").alias("entry_ord"), F.min_by("p_brand", "p_partkey").alias("code"))
    return own.select("code", "value", "entry_ord")


def fuzzy_topk_indel(spark: SparkSession, d: str) -> DataFrame:
    own = parts(spark, d).select(F.col("raw_text").alias("query"))
    return mt.top_matches(own, _named_types(spark, d), limit=5, least=60.0, scorer="indel").select("query", "code", "value", "score")


def suggest_indel(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions for names with their words turned round, out of the names; those of one word, and their inverses, are found by substring."""
    turned = F.array_join(F.reverse(F.split("p_name", " ")), " ")
    own = table(spark, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(turned).alias("Phrase")).distinct()
    terms = table(spark, d, "part").groupBy(F.col("p_name").alias("term")).agg(F.min("p_partkey").alias("k"), F.min_by("p_brand", "p_partkey").alias("code"))
    terms = terms.select("code", "term", F.struct(F.lit(0).alias("part"), F.col("k").alias("o"), F.lit(0).alias("column")).alias("term_ord"))
    out = mt.suggest_codes(own, terms, scorer="indel", accept=60.0)
    return out.select(F.col("Phrase").alias("phrase"), F.col("SuggestedElementCode").alias("code"), F.col("SuggestedBy").alias("by"), F.col("Confidence").alias("confidence"))


def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    own = parts(spark, d).groupBy((F.floor(F.col("row_ord") / 20)).cast("long").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_ord", "raw_text"))), lambda x: x["raw_text"]), "\n").alias("text"))
    return mt.match(own, dc.matcher_elements(frame(spark, "MATCHER")), dc.context_keywords(frame(spark, "KEYWORDS"))).select("doc_id", "group", "code", "value", "pass", "score", "final_score_context", "detail_fit_score")


def synonym_candidates(spark: SparkSession, d: str) -> DataFrame:
    terms = dc.reference_terms(frame(spark, "ELEMENTS"), frame(spark, "SYNONYMS"))
    return mn.synonym_candidates(parts(spark, d), terms)


def analyze_text(spark: SparkSession, d: str) -> DataFrame:
    """The frequency sheet that the analysis adds to a dictionary without synonyms."""
    sheets = {"Elements": frame(spark, "ELEMENTS"), "Synonyms": frame(spark, "SYNONYMS").limit(0)}
    return mn.analyze_text(parts(spark, d), sheets)[0]["FrequencyAnalysis"].select(F.col("Phrase").alias("phrase"), F.col("Count").alias("n"))


def detect_details(spark: SparkSession, d: str) -> DataFrame:
    """From pixel counts and two sources of texts: line 1 and 2 of an order are components, line 3 native texts, others recognised ones."""
    own = boxes(spark, d)
    first = F.when(F.col("l_linenumber") == 1, 120).otherwise(0)
    comps = own.where("l_linenumber <= 2").withColumns({"x1": F.col("x1") + first, "y1": F.col("y1") + first}).withColumn("pixel_area", F.floor(g.area() / 5)).withColumn("text_pixels", F.lit(0))
    texts = own.withColumn("text", F.col("id").cast("string"))
    pages = own.select("page").distinct().withColumns({"w": F.lit(PAGE_WIDTH), "h": F.lit(PAGE_HEIGHT)})
    out = bx.detect_details(comps, texts.where("l_linenumber = 3"), texts.where("l_linenumber > 3"), pages, bx.CATALOGUE)
    return out.select("page", "id", *g.SIDES, F.array_join(F.col("text_ids").cast("array<string>"), ",").alias("text_ids"))


def ink_components(spark: SparkSession, d: str) -> DataFrame:
    """Boxes as ink on a raster of a tenth of the size; those of line 3 are text zones."""
    own = boxes(spark, d).select("page", "l_linenumber", *[F.floor(F.col(s) / 10).cast("long").alias(s) for s in g.SIDES])
    return ik.ink_components(ik.rows_of(own.where("l_linenumber != 3")), own.where("l_linenumber = 3"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_text, ascii_fold, strip_tail, noise_filter, tokenize, safe_filename, line_kind, classify, classify_fallback, classify_scores, classify_large_dictionary, ngram_frequency, core_phrases, phrase_rollup, token_window, line_segments,
        unpivot_elements, context_keywords, reference_terms, synonyms_from_elements, suggest_substring, suggest_fuzzy, import_accepted, canonical_maps, material_conflict, numbers, area_type, clip_sanitize, extraction_report, export_metadata,
        box_metrics, component_kind, geometry_role, fallback_cores, touch_pairs, absorb_pairs, box_components, absorb_boxes, attach_small, attach_text, side_knn, percentile_split, unique_texts, greedy_dedupe, detail_candidates,
        dedupe_elements, infer_context, context_boost, final_candidates, fuzzy_topk, fuzzy_topk_indel, suggest_indel, fuzzy_match, synonym_candidates, analyze_text, detect_details, ink_components,
    )
}
