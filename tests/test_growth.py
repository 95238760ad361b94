"""What must not grow with the tables: sides that go through the driver, rows that are shuffled or written more often than needed."""

import random

import pytest
from pyspark.sql import functions as F

from strataq.functions import text as tx
from strataq.operators import boxes, classify, grams, ink, mining


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_of_a_large_dictionary_are_not_broadcast(spark, tmp_path):
    spark.range(2000).select(F.col("id").cast("string").alias("crop_id"), F.concat(F.lit("red bolt "), F.col("id").cast("string")).alias("raw_text")).write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))
    phrases = spark.createDataFrame([("A", "bolt", 1.0), ("B", "red bolt 19", 1.0), ("C", "1", 1.0)], "code string, phrase string, contribution double")
    found = classify.hits(texts, phrases, broadcast_phrases=0)
    assert "BroadcastHashJoin" not in plan(found)
    assert {r["code"]: r["count"] for r in found.groupBy("code").count().collect()} == {"A": 2000, "B": 111, "C": sum("1" in str(i) for i in range(2000))}


ODD = ["Żółta śruba M8 stalowa\nbolt\nred bolt\nred bolt\nred bolt plate\n12 12 x 12\n\n", None, "", "a b c d e f\na b c d e f g\na b c d e\nof the red bolt of\nREI 60\nna na na na", "½ kg ﬁrst ²² two\r\nred  bolt; red bolt -x- _y_", "x\n" * 5, "wg list 12 mm gr. 12 mm steel plate"]


def test_phrases_of_a_row_are_counted_without_a_shuffle(spark, monkeypatch):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(3, "red bolt\na b c d e f"), (None, "red bolt"), (None, "red bolt")], "id int, raw_text string")
    seen = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    want = mining._core_shuffled(rows, ("id",), "raw_text").withColumnRenamed("line", "source_line")
    want = want.withColumn("source_line", tx.normalize_text("source_line"))
    # the first line of rows that share a key is open
    assert seen(mining.core_phrases(rows, "id").drop("source_line")) == seen(want.drop("source_line"))
    own = rows.where("id != 3")
    assert seen(mining.core_phrases(own, "id")) == seen(want.where("id != 3"))
    apart = []
    shuffled = mining._core_shuffled
    monkeypatch.setattr(mining, "_core_shuffled", lambda df, *a: apart.append(df) or shuffled(df, *a))
    assert seen(mining.core_phrases(own, "id", source_line=False)) == seen(want.where("id != 3").drop("source_line"))
    assert apart[0].count() == 0
    monkeypatch.setattr(mining, "LONG", 40)
    monkeypatch.setattr("strataq.operators.grams.TOGETHER", 3)
    assert seen(mining.core_phrases(own, "id")) == seen(want.where("id != 3"))
    assert 0 < apart[1].count() < own.count()


def test_ngrams_are_counted_in_the_task_first(spark):
    rows = spark.createDataFrame([("red bolt red bolt red",)] * 50 + [("red",), ("and",), (None,), ("wąż i bolt 123",)], "raw_text string").coalesce(1)
    tokens = rows.select(tx.frequency_tokens("raw_text").alias("tokens"))
    assert grams.frequencies(tokens, 3).count() == 2 + 1 + 2 + 1 + 2  # with wąż, wąż bolt
    got = {r["Phrase"]: r["Count"] for r in mining.ngram_frequency(rows).collect()}
    assert got == {"red": 151, "bolt": 101, "red bolt": 100, "bolt red": 100, "red bolt red": 100, "bolt red bolt": 50, "wąż": 1, "wąż bolt": 1}


def test_a_rollup_without_lines_stores_nothing(spark, monkeypatch):
    rows = spark.createDataFrame([("b", 1, "Red bolt"), (" b ", 2, "red bolt"), (None, 3, "red bolt"), ("", 4, "red bolt"), ("a", 5, "réd bolt red bolt"), *[(f"c{i}", 6 + i, "red bolt") for i in range(5)], (None, 99, "blue gear")], "crop_id string, row_ord int, raw_text string")
    phrases = mining.core_phrases(rows, "crop_id", "row_ord")
    whole = mining.phrase_rollup(phrases).drop("ExampleTexts")
    want = sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(mining, "stored", lambda df: 1 / 0)
    got = sorted(map(tuple, mining.phrase_rollup(phrases.drop("source_line")).collect()))
    assert got == want
    assert ("red bolt", "red bolt", 7, 20, "a;b;c0;c1;c2") in [tuple(r) for r in got]
    assert ("blue gear", "blue gear", 0, 2, "") in [tuple(r) for r in got]

@pytest.mark.parametrize("dx, dy", [(4086, 250), (-10, -6), (8180, 3)])
def test_parts_at_the_edges_of_tiles_are_linked(spark, dx, dy):
    rng = random.Random(dx)
    runs = [(p, dy + rng.randrange(12), x, x + rng.choice((1, 1, 2, 4))) for p in (1, 2) for _ in range(50 + 20 * p) for x in [dx + rng.randrange(20)]]
    zones = [(1, dx + 5, dy + 2, dx + 14, dy + 9), (1, dx + 8, dy, dx + 12, dy + 12), (2, dx, dy + 5, dx + 20, dy + 7)]
    pixels = {(p, y, x) for p, y, x0, x1 in runs for x in range(x0, x1)}
    text = {(p, y, x) for p, x0, y0, x1, y1 in zones for y in range(y0, y1) for x in range(x0, x1)}
    want, left = set(), set(pixels)
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            p, y, x = here = todo.pop()
            part.add(here)
            near = {(p, y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        first, ys, xs = min(part), [c[1] for c in part], [c[2] for c in part]
        want.add((first[0], (first[1] << 32) + first[2], min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(part), len(part & text)))
    got = ink.ink_components(spark.createDataFrame(runs, "page long, y long, x0 long, x1 long").repartition(5), spark.createDataFrame(zones, "page long, x0 long, y0 long, x1 long, y1 long"))
    assert {tuple(r) for r in got.collect()} == want


def test_ink_inside_a_tile_makes_no_links_that_are_shuffled(spark, monkeypatch):
    links, closed = [], ink.graph.components
    monkeypatch.setattr(ink.graph, "components", lambda df, *keys: links.append(df.count()) or closed(df, *keys))
    runs = spark.createDataFrame([(1, y, x, x + 2) for y in range(3, 50) for x in range(5, 60, 4)], "page long, y long, x0 long, x1 long")
    zones = spark.createDataFrame([], "page long, x0 long, y0 long, x1 long, y1 long")
    assert ink.ink_components(runs, zones).count() == 14
    assert links == [0]


def test_pages_are_not_sorted_to_find_cores(spark):
    rng = random.Random(1)
    rows = [(p, i, 0, 0, rng.randrange(1, 9), 2, "core" if p == 2 and i == 3 else None if p == 4 else "small") for p, n in ((1, 1), (2, 30), (3, 9), (4, 50), (None, 8)) for i in range(n)]
    df = spark.createDataFrame(rows, "page long, id long, x0 int, y0 int, x1 int, y1 int, role string")
    want = []
    for page in (1, 2, 3, 4, None):
        own = sorted((r for r in rows if r[0] == page), key=lambda r: (-r[4], r[1]))
        has = any(r[6] == "core" for r in own)
        want += [(*r[:6], r[6] if has else "core" if k < max(1, min(5, len(own) // 4)) else "small") for k, r in enumerate(own)]
    got = boxes.fallback_cores(df)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert "WindowGroupLimit" in plan(got)


def test_sizes_of_pages_meet_the_components_once(spark, monkeypatch):
    """Cores are sought in a table, not in a join that is made again for each reader; final boxes, which are large, are dealt to coarse cells."""
    read, cells = [], []
    cores, near = boxes.fallback_cores, boxes.near_pairs
    monkeypatch.setattr(boxes, "fallback_cores", lambda df: read.append(df) or cores(df))
    monkeypatch.setattr(boxes, "near_pairs", lambda *a, **k: cells.append(k.get("cell")) or near(*a, **k))
    rng = random.Random(5)
    comps = [(p, i, x, y, x + rng.choice((9, 150, 700)), y + rng.choice((9, 150, 900)), 9000, 0) for p in (1, 2, 3) for i in range(12) for x, y in [(rng.randrange(1500), rng.randrange(1500))]]
    comps = spark.createDataFrame(comps, "page long, id long, x0 int, y0 int, x1 int, y1 int, pixel_area long, text_pixels long")
    none = spark.createDataFrame([], "page long, id long, x0 int, y0 int, x1 int, y1 int, text string")
    pages = spark.createDataFrame([(1, 1800, 2400), (2, 1800, 2400), (3, 0, 2400)], "page long, w int, h int")
    got = sorted(map(tuple, boxes.detect_details(comps, none, none, pages, boxes.CATALOGUE).collect()))
    assert "Join" not in read[0]._jdf.queryExecution().optimizedPlan().toString()
    assert cells[-1] == boxes.COARSE
    assert {r[0] for r in got} == {1, 2}
    # the rows don't hang on the cells
    monkeypatch.setattr(boxes, "COARSE", boxes.CELL)
    assert got == sorted(map(tuple, boxes.detect_details(comps, none, none, pages, boxes.CATALOGUE).collect()))


def test_of_boxes_that_tie_for_the_last_place_only_so_many_are_cores(spark):
    rows = [(1, i, 0, 0, 4, 4, "small") for i in range(10)] + [(1, i, 0, 0, 5, 5, "small") for i in (9, 3)] + [(2, 7, 0, 0, 3, 3, "small")] * 9
    rows += [(3, 7, i, 0, i + 3, 3, None) for i in range(30)] + [(3, 1, 0, 0, 9, 9, None)] + [(4, 7, 0, 0, 3, 3, "core")] * 6 + [(None, 7, 0, 0, 3, 3, "small")] * 8
    own = boxes.fallback_cores(spark.createDataFrame(rows, "page long, id long, x0 int, y0 int, x1 int, y1 int, role string").repartition(5))
    got = {(r["page"], r["role"]): r["count"] for r in own.groupBy("page", "role").count().collect()}
    assert got == {(1, "core"): 3, (1, "small"): 9, (2, "core"): 2, (2, "small"): 7, (3, "core"): 5, (3, "small"): 26, (4, "core"): 6, (None, "core"): 2, (None, "small"): 6}
    assert sorted(r["x0"] for r in own.where("page = 3 and role = 'core'").collect()) == [0, 0, 1, 2, 3]


def test_phrases_of_a_place_stand_together(spark, monkeypatch):
    """Output is many times the text: a phrase is written just behind the one that has its words."""
    text = "red bolt steel plate gear\nblue ring"
    rows = spark.createDataFrame([(1, text), (2, "red bolt")], "id int, raw_text string").coalesce(1)
    want = ["red bolt steel plate gear", "red bolt steel plate", "red bolt steel", "red bolt", "bolt steel plate gear", "bolt steel plate", "bolt steel", "steel plate gear", "steel plate", "plate gear", "blue ring"]
    for together in (1 << 17, 2):  # rows are given on in slices
        monkeypatch.setattr("strataq.operators.grams.TOGETHER", together)
        got = mining.core_phrases(rows, "id").collect()
        assert [r["phrase"] for r in got] == [*want, "red bolt"]
        assert [r["source_line"] for r in got] == ["red bolt steel plate gear"] * 10 + ["blue ring", "red bolt"]


def test_phrases_of_two_beginning_words_are_rolled_up_side_by_side(spark):
    rows = [(i, f"{begin} {x}ab{i % 3} tail\n{begin} únd {x}") for i, begin in enumerate(["red bolt", "blue gear", "old ring", "réd bolt"] * 2) for x in "xyz"]
    rows = spark.createDataFrame([(i, "\n".join(t for k, t in rows if k == i)) for i in range(8)], "id int, raw_text string")
    phrases = mining.core_phrases(rows, "id", source_line=False)
    want = {}
    for r in phrases.collect():
        want.setdefault(r["normalized_phrase"], []).append((r["id"], -r["occurrence_count"], r["phrase"]))
    want = {k: (min(v)[2], len({x[0] for x in v}), -sum(x[1] for x in v), ";".join(sorted({str(x[0]) for x in v})[:5])) for k, v in want.items()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = mining.phrase_rollup(phrases, "id", "id").withColumn("at", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["NormalizedPhrase"]: (r["Phrase"], r["SourceCount"], r["OccurrenceCount"], r["ExampleCropIDs"]) for r in got} == want and len(got) == len(want)
    assert want["red bolt"][:2] == ("red bolt", 4)
    places = {}
    for r in got:
        places.setdefault(" ".join(r["NormalizedPhrase"].split(" ")[:2]), []).append(r["at"])
    assert max(map(len, places.values())) > 9 and all(len(set(x)) == 1 for x in places.values())
