"""Near-dedup where rows share a doc_id and differ in their text."""

import random

import pytest

from strataq.llm import near_dedup


def brute(rows):
    own = []
    for i, t in rows:
        w = t.split()
        own.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))))
    least = {i: i for i, _ in own}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for k, (a, p) in enumerate(own):
        for b, q in own[k + 1 :]:
            if 100 * len(p & q) >= 80 * len(p | q) and (x := root(a)) != (y := root(b)):
                least[max(x, y)] = min(x, y)
    return sorted((i, len(p), root(i), root(i) == i) for i, p in own)


@pytest.mark.parametrize("seed", [3, 4])
def test_versions_count_together(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    bases, rows = [[word() for _ in range(120)] for _ in range(12)], []
    for i in range(90):
        for _ in range(r.choice([1, 1, 1, 1, 2])):
            own = list(r.choice(bases)) if r.random() < 0.5 else [word() for _ in range(100)]
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = word()
            rows.append((100 - i, " ".join(own)))
    # a document that is no set's first joins the sets of its versions
    one, two = (" ".join(word() for _ in range(60)) for _ in range(2))
    rows += [(201, one), (202, two), (203, one), (203, two), (203, two)]
    got = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(rows)
