"""Paragraph dedup against all pairs in plain Python, and the tuning of its bands."""

import random

from strataq.llm import paragraph_dedup as op
from strataq.llm.common import hashed_words


def units(text):
    words = op.split_words(text)
    if not words:
        return []
    a = op.cut(*hashed_words(text)).tolist()
    return [(i, p, q, tuple(words[p:q])) for i, (p, q) in enumerate(zip(a, [*a[1:], len(words)])) if q - p >= op.LEAST]


def windows(rows):
    """(row, word) of all words in windows that stand somewhere before."""
    first, gone = {}, set()
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        words = op.split_words(text)
        for p in range(len(words) - op.PASSAGE + 1):
            j, q = first.setdefault(tuple(words[p : p + op.PASSAGE]), (i, p))
            if j != i or p >= q + op.PASSAGE:
                gone |= {(i, k) for k in range(p, p + op.PASSAGE)}
    return gone


def brute(rows):
    """(row, word) of all words of paragraphs that aren't the first of their group."""
    every = [(i, (p, q), w) for (i, t) in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)) for _, p, q, w in units(t)]
    grams = [frozenset(w[j : j + 5] for j in range(len(w) - 4)) for *_, w in every]
    least = list(range(len(every)))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in range(len(every)):
        for b in range(a + 1, len(every)):
            if 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]) and (x := root(a)) != (y := root(b)):
                least[max(x, y)] = min(x, y)
    return {(every[x][0], k) for x in range(len(every)) if root(x) != x for k in range(*every[x][1])}


def found(df):
    out = set()
    for r in df.collect():
        i = None if r["key"]["id"] is None else int(r["key"]["id"])
        out |= {(i, k) for s in r["removed"] or () for k in range(s["a"], s["b"])}
    return out


def test_tuning():
    assert 1 - (1 - 0.8**op.ROWS) ** op.BANDS >= op.RECALL
    assert op.tuned(0.8, 0.999, 0.5)[0] >= op.tuned(0.8, 0.9, 0.5)[0]


def test_passages_are_cut_alike():
    r = random.Random(2)
    word = lambda: f"{r.choice('abcd')}{r.randrange(3000)}"
    caught = 0
    for _ in range(400):
        passage = [word() for _ in range(150)]
        both = [[w for *_, w in units(" ".join([word() for _ in range(r.randrange(80))] + passage + [word() for _ in range(r.randrange(80))]))] for _ in range(2)]
        caught += bool(set(map(tuple, both[0])) & set(map(tuple, both[1])))
    assert caught >= 396
    assert len(units("x " * 500)) == 1
    assert all(q - p >= op.LEAST for _ in range(20) for _, p, q, _ in units(" ".join(word() for _ in range(400))))


def test_against_all_pairs_and_windows(spark, docs, rows):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(90)]
    more = []
    for i in range(60):
        own = list(passage)
        if i % 3:
            own[r.randrange(90)] = word()
        more.append((20_000 + i, " ".join([word() for _ in range(r.randrange(50))]) + "\n" + " ".join(own) + (" " if i % 2 else "\n") + " ".join([word() for _ in range(20)])))
    extra = spark.createDataFrame(more, "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    pieces, whole = brute([*rows, *more]), windows([*rows, *more])
    got = found(op.report(both, passages=False))
    # the bands find 99 % of links; groups are larger than pairs
    assert len(got ^ pieces) <= 0.01 * len(pieces), (len(got - pieces), len(pieces - got), len(pieces))
    assert found(op.report(both)) == got | whole and len(whole - got) > 100
    left = op.dedup(both)
    assert left.count() == len(rows) + len(more)
    for r in left.where("doc_id >= 20000").collect():
        lost = sum(i == r["doc_id"] for i, _ in got | whole)
        assert len(r["text"].split()) == len(dict(more)[r["doc_id"]].split()) - lost and (r["n_removed"] > 0) == (lost > 0)


def test_empty(empty):
    assert op.report(empty).count() == 0 and op.dedup(empty).count() == 0
