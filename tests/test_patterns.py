"""Many phrases in one pass: the rows of a join on contains."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strataq.operators import patterns
from strataq.operators.classify import contains_join


def by_hand(phrases, texts):
    return sorted((i, p) for i, t in enumerate(texts) for p in set(phrases) if p in t)


@pytest.mark.parametrize("alphabet", ["ab", "abc ", "aé日🎉", "abcdefghij "])
@pytest.mark.parametrize("stretch,cells", [(1 << 10, 1 << 24), (3, 1 << 24), (1, 40)])
def test_automaton(monkeypatch, alphabet, stretch, cells):
    monkeypatch.setattr(patterns, "STRETCH", stretch)
    monkeypatch.setattr(patterns, "CELLS", cells)
    r = random.Random(f"{alphabet} {stretch}")
    make = lambda most: "".join(r.choices(alphabet, k=r.randint(1, most))).encode()
    phrases = [make(6) for _ in range(60)] + [make(40) for _ in range(5)]
    texts = [b"", b"zzz"] + [make(60) for _ in range(60)] + [make(4000), phrases[0], phrases[-1] + phrases[3]]
    got = sorted((int(i), names[k]) for names, a in patterns.automata(phrases) for i, k in zip(*a.found(texts)))
    assert got == by_hand(phrases, texts)
    if cells == 40:
        assert len(patterns.automata(phrases)) > 10


def test_nothing_to_find():
    assert patterns.automata([]) == patterns.automata([b""]) == []
    a = patterns.Automaton([b"x"])
    for texts in ([], [b""], [b"", b"abc"]):
        assert [len(x) for x in a.found(texts)] == [0, 0]


@pytest.mark.parametrize("few", [1_000, 0])
def test_join_with_repeats_short_phrases_and_nulls(spark, few):
    r = random.Random(5)
    phrases = [("x", "a"), ("x", "a"), ("y", "ab"), ("z", "abcd"), ("n", None), ("é", "é日"), *[(f"p{k}", "".join(r.choices("abcd ", k=r.randint(1, 5)))) for k in range(80)]]
    texts = [(1, "abcd"), (1, "abcd"), (2, None), (3, ""), (4, "é日本 ab"), *[(k, "".join(r.choices("abcd ", k=r.randint(0, 60)))) for k in range(5, 80)]]
    own = spark.createDataFrame(texts, "id int, search_text string").withColumn("a.b", F.col("id"))
    table = spark.createDataFrame(phrases, "code string, phrase string")
    got = sorted((x["id"], x["code"], x["phrase"], x["a.b"]) for x in contains_join(own, table, few).collect())
    assert got == sorted((i, c, p, i) for i, t in texts if t is not None for c, p in phrases if p is not None and p in t)


def test_empty_phrase_is_everywhere(spark):
    own = spark.createDataFrame([("q",), ("",), (None,)], "search_text string")
    got = patterns.contains_few(own, spark.createDataFrame([("",), ("q",)], "phrase string")).collect()
    assert sorted(map(tuple, got)) == [("", ""), ("q", ""), ("q", "q")]


def test_time_is_nearly_flat_in_the_number_of_phrases():
    r = random.Random(9)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(4, 10))).encode() for _ in range(40_000)]
    texts = [b" ".join(r.choices(words[20_000:], k=40)) for _ in range(2_000)]
    took = []
    for n in (20, 20_000):
        built = patterns.automata([w + b"q" for w in words[:n]])
        began = time.perf_counter()
        for _, a in built:
            a.found(texts)
        took.append(time.perf_counter() - began)
    assert took[1] < 4 * took[0] + 0.2, took
