"""Near-dedup against all pairs in plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.llm import linking, near_dedup
from strataq.llm.components import components


def sets(rows, width):
    out = {}
    for i, t in rows:
        w = tuple((t or "").encode().lower().split())
        out[i] = frozenset(w[k : k + width] for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    return out


def brute(rows, width):
    own = sets(rows, width)
    least = {i: i for i in own}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(own)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]) and (x := root(a)) != (y := root(b)):
                least[max(x, y)] = min(x, y)
    return {(i, len(own[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_groups(docs, rows, width):
    unique = {i: t for i, t in rows if i is not None}
    got = near_dedup.groups(docs, width).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got if r["doc_id"] is not None} == brute(unique.items(), width)
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]


@pytest.mark.parametrize("rare", [linking.RARE, 4])
def test_chains_and_crowds(spark, monkeypatch, rare):
    """Copies edited at random and of different lengths, so that many pairs are near the limit, and a chain whose ends are far apart; with shingles that count as rare, and nearly without."""
    monkeypatch.setattr(linking, "RARE", rare)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, base = [], [word() for _ in range(120)]
    for i in range(160):
        own = list(base)
        for _ in range(r.randint(0, 16)):
            own[r.randrange(120)] = word()
        for _ in range(r.randint(0, 14) * (i % 3 == 0)):
            del own[r.randrange(len(own))]
        rows.append((i, " ".join(own)))
    own = [word() for _ in range(100)]
    for i in range(200, 240):
        own = list(own)
        own[r.randrange(100)] = word()
        own[r.randrange(100)] = word()
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.groups(docs, 2)
    assert {tuple(x) for x in got.collect()} == brute(rows, 2)
    assert near_dedup.dedup(docs, 2).count() == got.where("kept").count()


def test_keys_hold_the_guarantee(spark):
    """Any two signatures at most 23 lanes apart share a key."""
    r = np.random.default_rng(1)
    a = r.integers(0, 2**16, (40, 48), np.uint64)
    b = a.copy()
    for k in range(40):
        for x in r.permutation(48)[:23]:
            b[k, x] ^= np.uint64(1 + r.integers(2**16 - 1))
    pack = lambda m: np.bitwise_or.reduce(m.reshape(-1, 12, 4) << (np.arange(4, dtype=np.uint64) * np.uint64(16)), axis=2).view(np.int64)
    rows = [(*map(int, x), *map(int, y)) for x, y in zip(pack(a), pack(b))]
    df = spark.createDataFrame(rows, ", ".join(f"{p}{c} long" for p in "pq" for c in range(12)))
    keys = lambda p: F.array(*near_dedup._keys(lambda c: F.col(f"{p}{c}")))
    assert df.where(F.arrays_overlap(keys("p"), keys("q"))).count() == 40
    split = df.select(F.struct(*[F.col(f"p{c}").alias(f"s{c}") for c in range(12)]).alias("p"), F.struct(*[F.col(f"q{c}").alias(f"s{c}") for c in range(12)]).alias("q"))
    assert {x[0] for x in split.select(near_dedup._lanes_apart("p", "q")).collect()} == {23}


def test_empty(empty):
    assert near_dedup.groups(empty).count() == 0


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5, 5)]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for i in sorted(near):
        if i not in want:
            todo = [i]
            while todo:
                if (x := todo.pop()) not in want:
                    want[x] = i
                    todo += near[x]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {k: v for k, v in want.items() if len(near[k] - {k})} == got


def test_tables_go_when_used(spark):
    """Of the tables on the way only those stay that the result is read from."""
    import os

    from strataq.llm.common import shared_folder

    r = random.Random(12)
    rows = []
    for k in range(60):  # groups, some of whose members stay apart from the pivot
        own = [f"w{r.randrange(3_000)}" for _ in range(60)]
        for j in range(4):
            own[r.randrange(60)] = f"o{r.randrange(3_000)}"
            rows.append((4 * k + j, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = f"{shared_folder(spark).removeprefix('file://')}/strataq"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = sorted(tuple(x) for x in near_dedup.groups(docs, 2).collect())
    left = {x.split("-", 1)[1] for x in set(os.listdir(folder)) - before}
    assert left <= {"named", "stars", "links", "versions"}
    assert got == sorted(tuple(x) for x in brute(rows, 2))
