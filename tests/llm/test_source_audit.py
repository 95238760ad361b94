"""The source audit against plain Python with whole numbers of any size."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.llm import source_audit

SF = "/root/testdata/sf0.001"


def by_hand(rows, least=3, best=200):
    """rows: lang, source, text."""
    n, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        groups[lang].add(source)
        n[lang, source].update(words)
        in_docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in in_docs[lang].items() if k >= least]
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (n[lang, s][t] + 1) // (total[s] + len(kept)) for t in kept} for s in sources}
        whole = {t: sum(n[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 1) // (sum(total.values()) + len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(sorted(found), 1) if part == "pair" or k <= best]
    return sorted(out)


def report(df):
    return sorted(map(tuple, df.collect()))


ODD = [
    ("en", "s", None), ("en", None, "odd odd"), (None, "s", ""), (None, None, None), ("xx", "a", "lonely words"), ("xx", "b", "other words"), ("yy", "only", "same same same"), ("yy", "only", "same"), ("yy", "only", "same"),
    ("en", "s", "É é ſ İ 日本語 🎉🎉 it's Word2vec under_score"), ("en", "s", "é ſ 日本語 🎉🎉"), ("en", "t", "é ſ 日本語 🎉🎉 word"), ("en", "t", "x" * 5000), ("zz", "v", "tie tow"), ("zz", "w", "tie tow"), ("zz", "v", "tie tow"),
]


@pytest.fixture(scope="module")
def rows(spark):
    known = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "source", "text").collect()
    return [tuple(r) for r in known] + ODD + ODD[:3]


@pytest.mark.parametrize("settings", [{}, {"chunk": 50}, {"least_docs": 1, "best": 3}])
def test_same_as_by_hand(spark, rows, settings):
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"n": F.lit(1), "Term": F.lit("x"), "docs": F.lit(0), "a.b": F.lit(2), "doc_id": F.lit(None)}).repartition(5)
    assert report(source_audit.audit(docs, **settings)) == by_hand(rows, settings.get("least_docs", 3), settings.get("best", 200))


def test_blocks_and_flushes(spark, rows, monkeypatch):
    monkeypatch.setattr(source_audit, "DENSE", 60)
    monkeypatch.setattr(source_audit, "HELD", 100)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(2)
    assert report(source_audit.audit(docs)) == by_hand(rows)


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_terms_are_never_cut(monkeypatch, block):
    monkeypatch.setattr(source_audit, "_BLOCK", block)
    text = "It's É ſ İ  日本語🎉Word2vec [under_score] " * 9
    got = [t.decode() for some in source_audit.terms_of(text.encode()) for t in some]
    assert got == "it s É ſ İ 日本語🎉word vec under score".split() * 9


def test_exact_beyond_64_bits():
    r = np.random.default_rng(2)
    n = r.integers(2**40, 2**53, 1000)
    count = (n * r.random(1000)).astype(np.int64) - 1
    assert source_audit.share(count, n).tolist() == [1 + 10**9 * (c + 1) // m for c, m in zip(count.tolist(), n.tolist())]
    assert source_audit.share(np.array([4]), np.int64(5)).tolist() == [1 + 10**9]


def test_empty_table(spark):
    assert report(source_audit.audit(spark.createDataFrame([], "lang string, source string, text string"))) == []
