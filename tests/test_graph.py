"""Closures and greedy choices against plain Python."""

import random

import numpy as np
import pytest

from strataq.operators import graph


def least_reachable(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for page, a, b in links:
        x, y = find((page, a)), find((page, b))
        root[max(x, y)] = min(x, y)
    return {k: find(k)[1] for k in list(root)}


@pytest.mark.parametrize("held", [1 << 18, 8])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(graph, "HELD", held)
    r = random.Random(held)
    links = [(p, r.randrange(60), r.randrange(60)) for p in range(4) for _ in range(40)]
    links += [(9, k, k + 1) for k in range(200)] + [(8, 500, k) for k in range(300)]  # a chain and a star
    r.shuffle(links)
    table = spark.createDataFrame(links, "page long, a long, b long").repartition(7)
    want = {k: v for k, v in least_reachable([x for x in links if x[1] != x[2]]).items()}
    got = {(x["page"], x["id"]): x["component"] for x in graph.components(table, "page").collect()}
    assert got == want
    plain = graph.components(table.where("page = 9").select("a", "b")).collect()
    assert {(x["id"], x["component"]) for x in plain} == {(k, 0) for k in range(201)}
    assert graph.components(table.limit(0), "page").count() == 0


def test_contracted_keeps_groups_apart():
    keys, a, b = np.array([1, 1, 2]), np.array([5, 7, 5]), np.array([6, 6, 9])
    assert sorted(zip(*(x.tolist() for x in graph._contracted([keys, a, b])))) == [(1, 6, 5), (1, 7, 5), (2, 9, 5)]


def test_beaten(spark):
    r = random.Random(2)
    conflicts = {(p, *sorted(r.sample(range(40), 2))) for p in range(3) for _ in range(80)}  # low numbers are looked at first
    gone = set()
    for p in range(3):
        chosen = []
        for k in range(40):
            if any((p, c, k) in conflicts for c in chosen):
                gone.add((p, k))
            else:
                chosen.append(k)
    table = spark.createDataFrame([(p, b, a) for p, a, b in conflicts], "page long, low long, high long")
    assert {tuple(x) for x in graph.beaten(table, "page").collect()} == gone
    assert graph.beaten(table.limit(0), "page").count() == 0
