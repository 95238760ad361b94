"""SimHash near-dedup against fingerprints made bit by bit and components over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strataq.llm import simhash

LONG = 1 << 63


def by_hand(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components_by_hand(prints, docs):
    """Of (doc_id, fingerprint) rows: the least doc_id reachable."""
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    owner = {}
    for d, f in docs:
        join(d, owner.setdefault(f, d))
    different = list(owner)
    for i, a in enumerate(different):
        for b in different[:i]:
            if (a ^ b).bit_count() <= 2:
                join(owner[a], owner[b])
    return {d: find(d) for d in root}


def scattered(n, seed=1):
    """Random fingerprints, and for some of them others that are up to four bits away; few and many bits set too."""
    r = random.Random(seed)
    out = {0, 2**64 - 1, 1, 3, 7, 15, LONG, LONG | 1}
    while len(out) < n:
        x = r.getrandbits(64) & (r.getrandbits(64) if r.random() < 0.3 else 2**64 - 1)
        out.add(x)
        for _ in range(r.choice([0, 0, 1, 5])):
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.randrange(64)
            out.add(x)
    return sorted(out)


def pairs_by_hand(prints, distance=2):
    x = np.array(prints, np.uint64)
    return {tuple(sorted((int(a), int(b)))) for k, a in enumerate(x) for b in x[k + 1 :][np.bitwise_count(x[k + 1 :] ^ a) <= distance]}


def test_gray_ranks_are_those_of_the_gray_code(spark):
    codes = [k ^ (k >> 1) for k in (0, 1, 2, 3, 1000, 2**40 + 17, LONG - 1, LONG, 2**64 - 1)]
    signed = [c - 2**64 if c >= LONG else c for c in codes]
    ranks = [r["r"] for r in spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "f long, i int").orderBy("i").select(simhash.gray_rank(F.col("f")).alias("r")).collect()]
    assert ranks == sorted(ranks)
    assert simhash.from_rank(np.array(ranks, np.int64)).tolist() == codes


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 700])
@pytest.mark.parametrize("distance", [0, 2, 5])
def test_index_finds_all_pairs(n, distance):
    prints = sorted(random.Random(n).sample(scattered(900), n), key=lambda g: _rank(g))
    index = simhash.GrayIndex(np.array(prints, np.uint64))
    got = {tuple(sorted((prints[q], prints[k]))) for a, b in index.near(np.array(prints, np.uint64), distance) for q, k in zip(a, b) if q < k}
    assert got == pairs_by_hand(prints, distance)


def _rank(g):
    for k in (1, 2, 4, 8, 16, 32):
        g ^= g >> k
    return g


def test_upper_nodes_prune():
    prints = np.array(sorted(scattered(4000), key=_rank), np.uint64)
    index = simhash.GrayIndex(prints)
    # every bit of a leaf is in exactly one node on the way to it
    for leaf in (0, 17, 1234, len(prints) - 1):
        masks = [int(mask[leaf // simhash.FAN ** (len(index.levels) - 1 - k)]) for k, (_, mask) in enumerate(index.levels)]
        assert sum(masks) == 2**64 - 1 and sum(m.bit_count() for m in masks) == 64
    assert sum(len(bits) for bits, _ in index.levels[:-1]) < len(prints) / 4


@pytest.mark.parametrize("part,thin", [(50, False), (50, True), (10**6, False)])
def test_links_over_many_parts(spark, part, thin):
    prints = scattered(1500, 5)
    table = spark.createDataFrame([(p - 2**64 if p >= LONG else p,) for p in prints], "fingerprint long")
    dealt = simhash.in_gray_order(table, part)
    if part == 50:
        assert dealt.select("stretch").distinct().count() > 20
    rows = simhash.links(dealt, part=part, thin=thin).collect()
    got = [tuple(sorted((r["a"] % 2**64, r["b"] % 2**64))) for r in rows]
    want = pairs_by_hand(prints)
    if not thin:
        assert len(got) == len(set(got)) and set(got) == want
        return

    def classes(links):
        root = {p: p for p in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        out = {}
        for p in prints:
            out.setdefault(find(p), set()).add(p)
        return sorted(map(sorted, out.values()))

    assert classes(got) == classes(want)


def test_forest():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 300, 400), r.integers(0, 300, 400)
    x, y = simhash.forest(a, b)
    assert len(x) < len(set(a) | set(b)) and (x > y).all()
    assert components_by_hand(None, []) == {}
    root = {k: k for k in range(300)}
    for p, q in zip(a.tolist(), b.tolist()):
        old, new = root[p], root[q]
        root = {k: new if v == old else v for k, v in root.items()}
    mine = {k: k for k in range(300)}
    for p, q in zip(x.tolist(), y.tolist()):
        old, new = mine[p], mine[q]
        mine = {k: new if v == old else v for k, v in mine.items()}
    same = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert same(root) == same(mine)


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_fingerprints(monkeypatch, block):
    monkeypatch.setattr(simhash, "_BLOCK", block)
    monkeypatch.setattr(simhash, "_COUNTED", 1 << 16 if block > 7 else 3)
    texts = [None, "", " \n", "one", "One TWO", "a b c", "a b c d", "É ſ İ x 日本 y\x0bz", "w " * 50, "x" * 3000 + " y z", " \t lead and trail \r\n"]
    texts += [" ".join(random.Random(k).choices("a bb ccc Dd  ".split(" "), k=k)) for k in range(40)]
    got = simhash.fingerprints_of([t if t is None else t.encode() for t in texts])
    assert got.tolist() == [by_hand(t) for t in texts]
    assert simhash.fingerprint("a b c d e", 2) == by_hand("a b c d e", 2)


def test_groups(docs, rows):
    own = {(d, by_hand(t)) for d, t in rows}
    want = components_by_hand(None, [x for x in own if x[0] is not None])
    got = simhash.groups(docs, part=40).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == sorted((str(d), f"{by_hand(t):016x}", str(want.get(d))) for d, t in rows)
    assert len(set(want.values())) < len(want) - 10  # there is something to find


def test_versions_and_other_columns(spark):
    rows = [("b", "q w e r t y"), ("a", "q w e r t y"), ("c", "1 2 3 4 5"), ("c", "q w e r t y"), ("d", None), ("e", ""), (None, "q w e r t y"), ("f", "else where is it")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumns({"fingerprint": F.lit("own"), "Component_ID": F.lit(1), "row": F.lit(2), "a.b": F.lit(3)})
    got = {(r["doc_id"], r["component_id"]) for r in simhash.groups(docs).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), (None, None), ("f", "f")}
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or "", r["fingerprint"], r["a.b"]) for r in kept.collect()) == [(x, "own", 3) for x in ("", "a", "d", "f")]


def test_empty_table(empty):
    assert simhash.groups(empty).count() == 0 and simhash.dedup(empty).count() == 0
