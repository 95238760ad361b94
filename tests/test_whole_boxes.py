"""Components and merged boxes of whole tables against union-find over all pairs in plain Python."""

from collections import defaultdict

import pytest

import __spark_entry__ as entry
from strataq.plans.fixtures import boxes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in boxes(spark, SF).select("page", "id", "x0", "y0", "x1", "y1").collect()]


def area(b):
    return max(0, b[4] - b[2]) * max(0, b[5] - b[3])


def touch(a, b):
    return a[2] < b[4] + 6 and b[2] < a[4] + 6 and a[3] < b[5] + 6 and b[3] < a[5] + 6


def absorbs(a, b):
    within = lambda p, q: q[2] >= p[2] - 8 and q[3] >= p[3] - 8 and q[4] <= p[4] + 8 and q[5] <= p[5] + 8
    shared = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
    return within(a, b) or within(b, a) or shared / max(1, min(area(a), area(b))) >= 0.25


def brute(rows, linked):
    least = {b[1]: b[1] for b in rows}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    pages = defaultdict(list)
    for b in rows:
        pages[b[0]].append(b)
    for page in pages.values():
        for k, a in enumerate(page):
            for b in page[k + 1 :]:
                if linked(a, b) and (x := root(a[1])) != (y := root(b[1])):
                    least[max(x, y)] = min(x, y)
    return {b[1]: root(b[1]) for b in rows}


def test_components_of_all_boxes(spark, rows):
    found = brute(rows, touch)
    got = [tuple(r) for r in entry.queries()["box_components"](spark, SF).collect()]
    assert len(got) == len(rows) == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert sorted(got) == sorted((b[0], b[1], found[b[1]]) for b in rows)


def test_merged_of_all_boxes(spark, rows):
    found, groups = brute(rows, absorbs), defaultdict(list)
    for b in rows:
        groups[b[0], found[b[1]]].append(b)
    want = [(*k, min(b[2] for b in m), min(b[3] for b in m), max(b[4] for b in m), max(b[5] for b in m)) for k, m in groups.items()]
    assert sorted(tuple(r) for r in entry.queries()["absorb_boxes"](spark, SF).collect()) == sorted(want)
