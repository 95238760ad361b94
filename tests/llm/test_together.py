"""Texts are hashed and held against each other many at a time, with the rows that each gives alone."""

import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from strataq.llm import common, linking, near_dedup
from strataq.llm import paragraph_dedup as op

ODD = [None, "", " ", "\n\n\n", "one", "x" * 5000, "long " * 4000, "a b c\n" * 40, "tie\ntie\ntie\ntie", "é   ſ İ 日本語 🎉🎉", "\t\x0b\x0c\r|#*"]


class Captured:
    """Stands for a DataFrame: gives the function that a map would run."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))]), pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "h", "text"])


def prose(n, seed=1):
    r = random.Random(seed)
    return ["\n".join(" ".join(f"w{r.randrange(50)}" for _ in range(r.choice([3, 20, 90]))) for _ in range(r.randrange(1, 4))) for _ in range(n)]


def paragraphs(texts):
    out = [x for b in op.paragraphs(Captured(), shortest=1)(iter([batch(texts)])) for x in b.to_pylist()]
    return sorted(out, key=lambda r: (r["h"], r["rep"] is None, r["a"], r["b"]))


@pytest.mark.parametrize("together", [1, 700, 1 << 18])
def test_paragraphs_as_of_each_text(monkeypatch, together):
    texts = ODD + prose(60) + ["", None, " a b " * 40, "end"]
    alone = [{**row, "id": str(i), "h": i} for i, x in enumerate(texts) for row in paragraphs([x])]
    monkeypatch.setattr(common, "TOGETHER", together)
    assert paragraphs(texts) == alone and len(alone) > 200


@pytest.mark.parametrize("width", [2, 5])
def test_sizes_of_pairs(width):
    r = random.Random(3)
    texts = [x or "" for x in ODD] + prose(40) + ["one", "one two", "Two one", "  "]
    texts += [x.upper() + " more" for x in texts[:30]]
    p, q = ([r.choice(texts).encode() for _ in range(500)] for _ in range(2))
    common_, either = linking.sizes_of(p, q, lambda x: near_dedup.shingle_sets(x, width))

    def own(x):
        w = x.lower().split()
        return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()

    assert list(zip(common_.tolist(), either.tolist())) == [(len(own(x) & own(y)), len(own(x) | own(y))) for x, y in zip(p, q)]
    every, rank, sizes = near_dedup.shingle_sets([x.encode() for x in texts], width)
    for x, values in zip(texts, np.split(every[rank], np.cumsum(sizes)[:-1])):
        assert (values == near_dedup.shingles(x, width)).all() and len(values) == len(near_dedup.shingles(x, width))


def test_no_steps_a_text():
    """Calls that the map makes for 500 texts: a few each (their bytes, their slots in lists), not hundreds."""
    run, rows, calls = op.paragraphs(Captured()), batch(prose(500)), 0
    list(run(iter([rows])))  # tables of powers grow

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        list(run(iter([rows])))
    finally:
        sys.setprofile(None)
    assert calls < 20 * 500


def test_spans_merge(spark):
    rows = [(0, [(0, 5), (5, 7), (9, 12)]), (1, [(0, 20), (3, 4), (19, 30), (31, 32)]), (2, [(7, 8)]), (3, [(0, 1)])]
    df = spark.createDataFrame(rows, "k int, spans array<struct<a:int,b:int>>")
    got = {r["k"]: [tuple(s) for s in r["out"]] for r in df.select("k", op._merged(df["spans"]).alias("out")).collect()}
    assert got == {0: [(0, 7), (9, 12)], 1: [(0, 30), (31, 32)], 2: [(7, 8)], 3: [(0, 1)]}
