"""Suffix-array dedup against counting every window in plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from strataq.llm import substring_exact as op


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    n = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - length + 1):
            if n[r[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        edge = np.diff(gone.astype(np.int8))
        spans = tuple(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        kept = bytes(b for b, g in zip(r, gone[1:]) if not g)
        out.append((len(r), spans, kept))
    return out


def check(spark, rows, length=400, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_bytes"], tuple((s["first"], s["stop"]) for s in r["spans"] or ()), bytes(r["kept"])) for r in op.dedup(df, length, **more).collect())
    want = Counter((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], length)))
    assert got == want
    return want


def test_documents(spark, docs, rows):
    want = check(spark, rows)
    assert sum(len(k[2]) for k in want) > 30


@pytest.mark.parametrize("more", [{}, {"crowd": 3}, {"together": 2}, {"crowd": 0}])
def test_shared_passages(spark, more):
    """A passage of 300 bytes in all, longer ones in some, periodic texts, texts just at the length."""
    r = random.Random(7)
    word = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    common, longer, rows = word(260), word(900), []
    for i in range(40):
        t = word(r.randrange(600)) + common + word(r.randrange(500))
        if i % 3 == 0:
            a = r.randrange(300)
            t += longer[a : a + r.randrange(350, 600)]
        rows.append((i, t))
    rows += [(50, "ab" * 500), (51, "x" * 900), (52, "abc" * 134), (53, common), (54, rows[0][1]), (None, rows[0][1][:500]), (55, None), (55, "y" * 399), (56, "y" * 400), (57, "line one and two\n" * 60)]
    check(spark, rows, **more)


def test_slices_of_long_texts(monkeypatch):
    r = random.Random(3)
    raw = bytes(r.choice(b"abcdefgh") for _ in range(5000))
    whole = op.runs_of(raw)
    monkeypatch.setattr(op, "SLICE", 700)
    parts = op.runs_of(raw)
    spread = lambda x: [(s + k, s + lead, a) for s, n, lead, a in zip(*map(np.ndarray.tolist, x)) for k in range(n)]
    assert spread(whole) == spread(parts) and len(parts[0]) > len(whole[0])


def test_empty(empty):
    assert op.dedup(empty).count() == 0
