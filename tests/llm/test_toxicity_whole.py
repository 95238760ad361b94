"""The toxicity model learns and calibrates on all labelled texts, however they lie."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.llm import toxicity


def test_every_labelled_text_teaches(spark):
    """A word that only toxic texts behind the first 1,666 by hash have (what a sample of 5,000 would take) is learnt."""
    r = random.Random(3)
    ids = [x[0] for x in spark.range(6_600).orderBy(F.xxhash64("id"), "id").collect()]
    toxic = ids[:2_200]
    late = set(toxic[1_700:])
    rows = []
    for k, i in enumerate(ids):
        own = [f"plain{r.randrange(300)}" for _ in range(8)]
        if k < len(toxic):
            own[r.randrange(8)] = "vexbane" if i in late else "grimword"
        rows.append((i, " ".join(own), "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(k < len(toxic))) for k, i in enumerate(ids)], "doc_id long, toxic int")
    m = toxicity.fit(docs.repartition(5), labels, F.lit(True))
    plain = " ".join(f"plain{k}" for k in range(7))
    assert m.score(toxicity.words(plain)) < 0.3 and all(m.score(toxicity.words(f"{plain} {w}")) > 0.7 for w in ("vexbane", "grimword"))


def test_order_and_partitions_do_not_show(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, f"{'mean' if i % 5 == 0 else 'kind'} " + " ".join(f"w{r.randrange(50)}" for _ in range(5)), "de" if i % 2 else None) for i in range(600)] + [(601, None, "en"), (602, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(601, 0), (602, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    a = toxicity.fit(docs.repartition(2), labels, F.lit(True), shard=100)
    monkeypatch.setattr(toxicity, "BROADCAST", 10)
    b = toxicity.fit(docs.orderBy(F.desc("doc_id")).repartition(7), labels, F.lit(True), shard=100)
    assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("embed", "filters", "bias", "top"))
    assert (a.top_bias, a.threshold, a.thresholds) == (b.top_bias, b.threshold, b.thresholds) and set(a.thresholds) == {"", "de"}
    assert a.score(toxicity.words("mean w1 w2")) > 0.7 > 0.3 > a.score(toxicity.words("kind w1 w2"))


def test_without_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "c", None)], "doc_id long, text string, lang string")
    for rows in ([], [(1, 1), (2, 1)]):
        m = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"), F.lit(True))
        assert m.score(toxicity.words("a b")) == 0.5 and m.threshold == 0.5 and not m.thresholds


def test_best_cuts(spark):
    """Against all thresholds one by one."""
    r = random.Random(5)
    rows = [(lang, round(min(1.0, max(0.0, r.gauss(0.3 + 0.4 * y, 0.2))), 2), y) for lang in ("a", "b") for y in (0, 0, 0, 1) * 40] + [("c", 0.5, 1), ("c", 0.1, 1), ("d", 0.5, 0), ("d", 0.5, 1)]

    def best(own):
        s, y = np.array([x[1] for x in own]), np.array([x[2] for x in own])
        each = np.unique(s)
        f1 = {c: 2 * ((s >= c) & (y == 1)).sum() / ((s >= c).sum() + y.sum()) for c in (each[1:] + each[:-1]) / 2}
        return float(np.median([c for c, v in f1.items() if v == max(f1.values())]))

    scored = spark.createDataFrame(rows, "lang string, score double, label int")
    got = {x["lang"]: x["cut"] for x in toxicity.best_cuts(scored, "lang").collect()}
    assert got == {lang: pytest.approx(best([x for x in rows if x[0] == lang])) for lang in ("a", "b")}
    assert [x["cut"] for x in toxicity.best_cuts(scored).collect()] == [pytest.approx(best(rows))]
