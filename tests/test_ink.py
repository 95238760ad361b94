"""Ink components from runs against flood fill on rasters."""

import random
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from strataq.operators import boxes as bx
from strataq.operators import ink
from strataq.plans.fixtures import boxes

RUN, BOX = "page long, y long, x0 long, x1 long", "page long, x0 long, y0 long, x1 long, y1 long"


def flood(runs, zones):
    """By pixels, eight neighbours each."""
    pixels, text = defaultdict(set), defaultdict(set)
    for page, y, x0, x1 in runs:
        if None not in (page, y, x0, x1):
            pixels[page].update((y, x) for x in range(x0, x1))
    for page, x0, y0, x1, y1 in zones:
        text[page].update((y, x) for y in range(y0, y1) for x in range(x0, x1))
    out = []
    for page, left in pixels.items():
        for first in sorted(left):
            if first not in left:
                continue
            left.discard(first)
            todo, own = [first], []
            while todo:
                y, x = todo.pop()
                own.append((y, x))
                for p in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                    if p in left:
                        left.discard(p)
                        todo.append(p)
            ys, xs = [p[0] for p in own], [p[1] for p in own]
            out.append((page, (first[0] << 32) + first[1], min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(own), len(text[page].intersection(own))))
    return sorted(out)


@pytest.mark.parametrize("stretch", [256, 4])
def test_same_as_flood_fill(spark, monkeypatch, stretch):
    monkeypatch.setattr(ink, "STRETCH", stretch)
    r = random.Random(stretch)
    runs = []
    for page, density in ((1, 0.1), (2, 0.45), (3, 0.7)):
        for y in range(30):
            runs += [(page, y, x, x + r.choice([1, 1, 2, 9])) for x in range(40) if r.random() < density / 3]
    runs += [(4, 0, 0, 1), (4, 1, 1, 2), (4, 2, 3, 4), (5, 7, 3, 3), (5, 7, 9, 2), (5, None, 1, 2), (6, 0, 0, 900), (6, 1, 899, 901), (6, 2, 901, 902), (4, 0, 0, 1)]
    zones = [(p, x, y, x + 7, y + 5) for p in (1, 2, 3) for x, y in ((0, 0), (3, 2), (20, 11), (20, 11))] + [(6, 250, 0, 600, 1), (4, 5, 5, 5, 9)]
    got = ink.ink_components(spark.createDataFrame(runs, RUN).repartition(3), spark.createDataFrame(zones, BOX))
    assert sorted(map(tuple, got.collect())) == flood(runs, zones)
    assert ink.ink_components(spark.createDataFrame([], RUN), spark.createDataFrame(zones, BOX)).count() == 0


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in boxes(spark, d).selectExpr("page", "l_linenumber", "x0 div 10", "y0 div 10", "x1 div 10", "y1 div 10").collect()]
    runs = [(p, y, x0, x1) for p, n, x0, y0, x1, y1 in rows if n != 3 for y in range(y0, y1)]
    got = entry.queries()["ink_components"](spark, d).collect()
    assert sorted(map(tuple, got)) == flood(runs, [(p, x0, y0, x1, y1) for p, n, x0, y0, x1, y1 in rows if n == 3])


def test_components_go_on_to_details(spark):
    runs = ink.rows_of(spark.createDataFrame([(1, 100, 100, 400, 102), (1, 100, 100, 102, 300), (1, 100, 298, 400, 300), (1, 398, 100, 400, 300)], BOX))
    found = ink.ink_components(runs, spark.createDataFrame([], BOX))
    assert found.count() == 1
    texts = spark.createDataFrame([(1, 10, 150, 150, 180, 160, "inside")], "page long, id long, x0 long, y0 long, x1 long, y1 long, text string")
    pages = spark.createDataFrame([(1, 1000, 1000)], "page long, w int, h int")
    got = bx.detect_details(found, texts, texts.limit(0), pages, bx.CATALOGUE).collect()
    assert len(got) == 1 and got[0]["text_ids"] == [10]
