"""What is written and moved on the way to links, and that no way loses one."""

import random

import pytest
from pyspark.sql import functions as F

from strataq.llm import linking, near_dedup

from test_near_dedup import brute


def family(members, edits, seed=3):
    """Copies of one text, each with so many words of its own: near each other, and most pairs not linked."""
    r = random.Random(seed)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(members):
        own = list(base)
        for k in r.sample(range(200), r.choice(edits)):
            own[k] = f"e{i}x{k}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.fixture
def counted(monkeypatch):
    """(name, rows) of the tables that are written."""
    out = []

    def spied(module):
        own = module.written

        def written(df, name):
            t = own(df, name)
            out.append((name, t.count()))
            return t

        monkeypatch.setattr(module, "written", written)

    spied(linking)
    spied(near_dedup)
    return out


@pytest.mark.parametrize("direct", [0, 16, 10_000])
def test_few_pairs_of_a_family_are_confirmed(spark, monkeypatch, counted, direct):
    """60 copies with 13 or 14 words of their own of 200: 1,770 pairs of a similarity near 0.6, which the order of their shingles tells without their texts."""
    monkeypatch.setattr(near_dedup, "DIRECT", direct, raising=False)
    rows = family(60, [13, 14])
    got = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert {tuple(x) for x in got.collect()} == brute(rows, 2)
    if direct < 60:
        assert sum(n for name, n in counted if name == "pairs") <= 60
    if not direct:  # keys of few nodes, if they are taken alone, go by the signatures only
        assert sum(n for name, n in counted if name == "confirmed") <= 300


@pytest.mark.parametrize("direct", [0, 4, 10_000])
@pytest.mark.parametrize("rare", [linking.RARE, 4])
def test_no_way_loses_a_link(spark, monkeypatch, direct, rare):
    """Copies near the limit, cut at their ends too; keys of few nodes alone, none of them, and both."""
    monkeypatch.setattr(near_dedup, "DIRECT", direct, raising=False)
    monkeypatch.setattr(linking, "RARE", rare)
    r = random.Random(8)
    rows = []
    for i, t in family(90, range(4, 16), seed=6):
        w = t.split()
        rows.append((i, " ".join(w[: 200 - r.randrange(30) * (i % 3 == 0)])))
    got = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    want = brute(rows, 2)
    assert {tuple(x) for x in got.collect()} == want
    assert 1 < len({x[2] for x in want}) < 90


def test_texts_only_of_plausible_pairs(spark, counted):
    """Texts that meet under a key by chance, far apart, are not fetched."""
    r = random.Random(4)
    rows = []
    for k in range(150):  # a third of the shingles in common: some of 48 keys are shared, no pair is within the distance
        rows.append((k, " ".join([f"c{j}" for j in range(60)] + [f"o{k}x{j}" for j in range(60 + r.randrange(5))])))
    rows += [(1000 + k, rows[k][1] + " more") for k in range(5)]
    got = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert {tuple(x) for x in got.collect()} == brute(rows, 2)
    fetched = [n for name, n in counted if name == "texts"]
    assert fetched[0] < 50


def test_likely_in(spark):
    """All rows that are wanted stay, and few others, whatever the hash's sign."""
    from strataq.llm.common import likely_in

    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h"), F.lit("x").alias("block"))
    wanted = rows.where("id % 10 = 3").select("h", "id")
    got = likely_in(rows, "h", wanted)
    assert got.columns == ["id", "h", "block"]
    ids = {x["id"] for x in got.select("id").collect()}
    assert {i for i in range(20_000) if i % 10 == 3} <= ids
    assert len(ids) < 5_000 and got.count() == len(ids)
    assert {x["block"] for x in got.select("block").collect()} == {"x"}
    assert likely_in(rows, "h", wanted.where("id < 0")).count() == 0
