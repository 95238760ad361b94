"""The similarity join gives the rows of all pairs, and scores few of them."""

import random

import pytest

from strataq.functions.similarity import SCORERS
from strataq.operators import fuzzy_join as fj


def words(r, alphabet, n, most=4):
    return [" ".join("".join(r.choices(alphabet, k=r.randint(1, 7))) for _ in range(r.randint(0, most))) for _ in range(n)]


def variants(r, texts):
    """Texts with characters changed, words moved, doubled or dropped, and stretches of them."""
    out = []
    for t in texts:
        x = list(t)
        for _ in range(r.randint(0, 3)):
            if x:
                i = r.randrange(len(x))
                x[i : i + r.randint(0, 1)] = r.choice(["", "q", " ", "ab"])
        own = "".join(x).split(" ")
        r.shuffle(own)
        out += ["".join(x), " ".join(own), t[r.randint(0, 3) : r.randint(3, 12)], t + " " + r.choice(texts), f"{t} {t}"]
    return out


SAMPLES = [("ab ", 3), ("abcdef", 4), ("abcdefghijklmnoprstuwyz", 3), ("aéß日🎉", 3)]


@pytest.mark.parametrize("scorer", sorted(SCORERS))
@pytest.mark.parametrize("least", [0.0, 40.0, 60.0, 74.95, 85.0, 90.0, 100.0])
def test_no_pair_is_lost(scorer, least):
    for k, (alphabet, most) in enumerate(SAMPLES):
        r = random.Random(f"{k} {least}")
        texts = ["", " ", "a", "b", "a b", "b a", "  a   b ", "\ta\nb"] + words(r, alphabet, 14, most)
        texts = sorted(set(texts + variants(r, texts)))
        index = fj.Index(texts)
        for q in r.sample(texts, 25):
            want = {(v, s) for v in texts if (s := SCORERS[scorer](q, v)) >= least}
            assert set(index.search(q, scorer, least)) == want, (q, scorer, least)


@pytest.mark.parametrize("scorer,least,percent", [("weighted", 75.0, 2), ("token_set", 90.0, 0.2), ("indel", 75.0, 0.02), ("sequence", 75.0, 0.02)])
def test_few_pairs_are_scored(scorer, least, percent):
    """Of 20,000 entries of two or three invented words, for queries that are near some of them, with short ones of 2 to 6 letters among them."""
    r = random.Random(7)
    vocabulary = ["".join(r.choices("abcdefghijklmnoprstuwyz", k=r.randint(3, 9))) for _ in range(20_000)]
    entries = sorted({" ".join(r.sample(vocabulary, r.randint(2, 3))) for _ in range(20_000)})
    index = fj.Index(entries)
    queries = variants(r, r.sample(entries, 20))
    tried = sum(len(index.candidates(q, scorer, least)) for q in queries)
    assert tried < len(queries) * len(entries) * percent / 100


@pytest.mark.parametrize("scorer,block", [("weighted", 20_000), ("indel", 7), ("token_set", 20)])
def test_blocks_and_slices(spark, scorer, block):
    r = random.Random(3)
    values = words(r, "abcdef", 60) + [None, ""]
    queries = variants(r, [v or "" for v in values])[:150] + [None]
    own = spark.createDataFrame([(q, 1) for q in queries + queries[:5]], "q string, n int").repartition(3)
    table = spark.createDataFrame([(v, 2) for v in values + values[:9]], "v string, n int").repartition(2)
    got = sorted((x["query"], x["value"], x["raw"]) for x in fj.similar(own, table, scorer, 70.0, query="q", value="v", block=block).collect())
    want = sorted({(q or "", v or "", s) for q in queries for v in values if (s := SCORERS[scorer](q or "", v or "")) >= 70.0})
    assert got == want
    assert fj.similar(own.limit(0), table, query="q", value="v").count() == fj.similar(own, table.limit(0), query="q", value="v").count() == 0


def test_plan_has_no_join_of_all_pairs(spark):
    own = spark.createDataFrame([("brick wall",)], "query string")
    plan = fj.similar(own, spark.createDataFrame([("brick",)], "value string"))._jdf.queryExecution().toString()
    assert "Join" not in plan and "Cartesian" not in plan and "Broadcast" not in plan
