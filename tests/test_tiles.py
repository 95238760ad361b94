"""Boxes linked by place against plain Python: pages in one tile, pages of many, tiles of more boxes than a task has before it."""

import random

import pytest

from strataq.operators import boxes as bx
from strataq.operators import tiles

BOX = "page long, id long, x0 int, y0 int, x1 int, y1 int"


def touch(a, b):
    return a[2] < b[4] + 6 and b[2] < a[4] + 6 and a[3] < b[5] + 6 and b[3] < a[5] + 6


def area(b):
    return max(0, b[4] - b[2]) * max(0, b[5] - b[3])


def absorbs(a, b):
    within = lambda p, q: q[2] >= p[2] - 8 and q[3] >= p[3] - 8 and q[4] <= p[4] + 8 and q[5] <= p[5] + 8
    shared = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
    return within(a, b) or within(b, a) or shared / max(1, min(area(a), area(b))) >= 0.25


def least(rows, linked):
    """Of each page and id the least id reachable; boxes of one id are one node."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, a in enumerate(rows):
        if a[0] is None or a[1] is None:
            continue
        find(a[:2])
        for b in rows[k + 1 :]:
            if a[0] == b[0] and b[1] is not None and None not in (*a, *b) and linked(a, b):
                x, y = find(a[:2]), find(b[:2])
                root[max(x, y)] = min(x, y)
    return lambda b: b[1] if b[0] is None or b[1] is None else find(b[:2])[1]


def random_rows(seed, wide):
    r = random.Random(seed)
    rows = []
    for page in range(4):
        for i in range(70):
            x, y = r.randrange(-50 if wide else 0, 1500), r.randrange(-50 if wide else 0, 1200)
            rows.append((page, i * 7 % 70, x, y, x + r.choice([0, 5, 60, 60, 90, 300]), y + r.choice([0, 5, 60, 60, 90, 300])))
    rows += [(1, 5, 1400, 1100, 1460, 1160), (1, 5, 1400, 1100, 1460, 1160), (2, 80, 30, None, 50, 60), (2, 3, 30, 40, None, 60), (None, 1, 0, 0, 5, 5), (None, 1, 0, 0, 9, 5), (3, None, 0, 0, 5, 5)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile, strip, held", [(4096, 256, 1 << 17), (256, 64, 1 << 17), (4096, 256, 16), (512, 32, 24)])
def test_linked_boxes(spark, monkeypatch, tile, strip, held):
    for k, v in (("TILE", tile), ("STRIP", strip), ("HELD", held), ("PAIRS", 50)):
        monkeypatch.setattr(tiles, k, v)
    rows = random_rows(held, tile < 4096)
    table = spark.createDataFrame(rows, BOX).repartition(3)
    key = lambda r: str(r)
    of = least(rows, touch)
    got = bx.touch_components(table, 6)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((b[0], b[1], of(b)) for b in rows), key=key)
    for linked, found in ((touch, bx.touch_merged(table, 6)), (absorbs, bx.absorb_merged(table, 8, 0.25))):
        of, groups = least(rows, linked), {}
        for b in rows:
            groups.setdefault((b[0], of(b)), []).append(b)
        around = lambda m, f, i: f((b[i] for b in m if b[i] is not None), default=None)
        want = [(*k, around(m, min, 2), around(m, min, 3), around(m, max, 4), around(m, max, 5)) for k, m in groups.items()]
        assert found.dtypes == table.dtypes
        assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)


def test_no_pair_is_a_row(spark, monkeypatch):
    """Pages that fit in a tile need neither a table of pairs nor rounds of links."""
    monkeypatch.setattr(bx, "near_pairs", lambda *a, **k: 1 / 0)
    monkeypatch.setattr(tiles.graph, "components", lambda *a: 1 / 0)
    import __spark_entry__ as entry

    for name, n in (("box_components", 6000), ("absorb_boxes", None)):
        got = entry.queries()[name](spark, "/root/testdata/sf0.001")
        assert n in (None, got.count())


def test_copies_of_a_box_in_a_full_tile(spark, monkeypatch):
    """More boxes at one place than a task has before it: one row a group goes on, and all are one component."""
    monkeypatch.setattr(tiles, "HELD", 64)
    table = spark.range(2000).selectExpr("1L page", "id + 1 id", "10 x0", "cast(id % 3 as int) y0", "20 x1", "30 y1").repartition(2)
    got = bx.touch_components(table, 6)
    assert got.count() == 2000 and [r["component"] for r in got.select("component").distinct().collect()] == [1]
    assert [tuple(r) for r in bx.absorb_merged(table, 8, 0.25).collect()] == [(1, 1, 10, 0, 20, 30)]
    assert bx.touch_components(table.limit(0), 6).count() == 0


def test_candidates_are_found_once(spark, monkeypatch):
    """Cores and texts meet once, cores among themselves without pairs, and what is suppressed is read from a table; an id may have several boxes."""
    calls, seen = [], []
    near, suppressed = bx.near_pairs, bx.suppressed
    monkeypatch.setattr(bx, "near_pairs", lambda *a, **k: calls.append(a) or near(*a, **k))
    monkeypatch.setattr(bx, "suppressed", lambda df, *a: seen.append(df) or suppressed(df, *a))
    comps = spark.createDataFrame([(1, 1, 100, 100, 400, 300, "geometry", 0.2, 0.0), (1, 2, 405, 150, 430, 170, "geometry", 0.5, 0.0), (1, 2, 600, 150, 620, 170, "geometry", 0.5, 0.0)], BOX + ", kind string, fill_ratio double, text_overlap_ratio double")
    texts = spark.createDataFrame([(1, 10, 640, 200, 670, 210, "beside"), (1, 11, 150, 150, 180, 160, "inside"), (1, 12, 150, 150, 180, 160, "inside"), (1, 13, 800, 800, 830, 810, "far"), (1, 11, 700, 100, 710, 110, "of 11 too")], BOX + ", text string")
    pages = spark.createDataFrame([(1, 1000, 1000)], "page long, w int, h int")
    r = bx.detail_candidates(comps, texts, pages, bx.CATALOGUE).collect()
    # box 2 beside the core brings the other box of its id along, text 11 likewise
    assert [(x["x0"], x["y0"], x["x1"], x["y1"], x["text_ids"]) for x in r] == [(90, 90, 720, 310, [10, 11, 11])]
    assert len(calls) == 3
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_details_make_no_pairs_of_cores(spark, monkeypatch):
    """Page detection takes the same steps: near boxes are joined for small ones, texts and what is suppressed only."""
    near, calls = bx.near_pairs, []
    monkeypatch.setattr(bx, "near_pairs", lambda *a, **k: calls.append(a) or near(*a, **k))
    comps = spark.createDataFrame([(1, 1, 100, 100, 300, 300, 9000, 0), (1, 2, 301, 100, 500, 300, 9000, 0), (2, 1, 100, 100, 400, 300, 9000, 0)], BOX + ", pixel_area long, text_pixels long")
    native = spark.createDataFrame([(1, 10, 510, 200, 540, 210, "beside"), (2, 10, 150, 150, 180, 160, "inside")], BOX + ", text string")
    pages = spark.createDataFrame([(1, 1000, 1000), (2, 1000, 1000)], "page long, w int, h int")
    got = bx.detect_details(comps, native, native.limit(0), pages, bx.CATALOGUE).select("page", "id", "x0", "x1", "text_ids").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 90, 550, [10]), (2, 1, 90, 410, [10])]
    assert len(calls) == 3
