"""The matcher end to end on a small text."""

from strataq.operators import dictionary, matching

ELEMENTS = "ElementCode string, Priority double, ContextGroup string, MaterialGroup string, SideSignal string, SideWeight double, PositionSignal string, PositionWeight double, IsStrongAnchor string, AnchorWeight double, A string, B string, row_ord int"


def test_match(spark):
    rows = [("W", 1.0, "wall", "masonry", "ext", 60.0, "base", 40.0, "yes", 40.0, "brick wall", None, 0), ("F", 1.0, "floor", "rc", "int", 10.0, "top", 10.0, "no", 0.0, "concrete floor", "floor", 1)]
    elements = dictionary.matcher_elements(spark.createDataFrame(rows, ELEMENTS))
    keywords = dictionary.context_keywords(spark.createDataFrame([("outside", "ext", 50.0, "any", 0.0, "outer face", 0)], "ContextSignal string, SideSignal string, SideWeight double, PositionSignal string, PositionWeight double, Word string, row_ord int"))
    texts = spark.createDataFrame([(1, "thick brick wall\nouter face\n150"), (2, "nothing here"), (3, None)], "doc_id int, text string")
    out = matching.match(texts, elements, keywords).collect()
    assert [(r["doc_id"], r["code"]) for r in out] == [(1, "W")] and out[0]["score"] >= 95


def test_suggestions_fall_back_to_similarity(spark):
    terms = spark.createDataFrame([("E1", "fire door"), ("E2", "steel beam")], "code string, term string").selectExpr("code", "term", "struct(0 as part, cast(0 as bigint) as o, 0 as column) as term_ord")
    own = spark.createDataFrame([("internal fire door",), ("door fire",), ("door",), ("unrelated text",)], "Phrase string")
    got = {r["Phrase"]: (r["SuggestedElementCode"], r["SuggestedBy"]) for r in matching.suggest_codes(own, terms).collect()}
    assert got == {"internal fire door": ("E1", "substring"), "door fire": ("E1", "fuzzy"), "door": ("", ""), "unrelated text": ("", "")}


def test_dictionaries_in_blocks(spark):
    """More entries than are broadcast at once give the same rows."""
    words = [f"{a} {b}" for a in ("steel", "brick", "timber", "glass") for b in ("door", "wall", "roof", "beam", "plate")]
    terms = spark.createDataFrame([(f"E{k}", w, k) for k, w in enumerate(words)], "code string, term string, k long").selectExpr("code", "term", "struct(0 as part, k as o, 0 as column) as term_ord")
    own = spark.createDataFrame([(w,) for w in ("old steel door", "door steel", "brik wall", "roof", "glas beams")], "Phrase string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(matching.suggest_codes(own, terms, accept=60.0, at_once=3)) == rows(matching.suggest_codes(own, terms, accept=60.0))
    entries = terms.selectExpr("code", "term as value", "term_ord as entry_ord")
    queries = own.withColumnRenamed("Phrase", "query")
    assert rows(matching.top_matches(queries, entries, limit=4, least=10.0, at_once=3)) == rows(matching.top_matches(queries, entries, limit=4, least=10.0))
