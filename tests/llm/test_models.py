"""Classifiers by held-out accuracy, token counts by hand, the pipeline by its parts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.llm import quality_classifier, token_counts, toxicity
from strataq.llm import queries as q

SF = "/root/testdata/sf0.01"


def auc(rows):
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    return float(np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]))


def scored(spark, name, label, fold, rest):
    out = {r["doc_id"]: r for r in q.queries()[name](spark, SF).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % fold == rest) and 0 <= r["score"] <= 1 for i, r in out.items())
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return [(out[i]["score"], y, out[i]["predicted"]) for i, y in labels.items() if out[i]["held_out"]]


def test_quality(spark):
    rows = scored(spark, "op3_quality_classifier", "quality", 5, 0)
    assert auc([r[:2] for r in rows]) > 0.95 and np.mean([p for _, y, p in rows if y]) > 0.97


def test_toxicity(spark):
    rows = scored(spark, "op10_toxicity", "toxic", 3, 1)
    assert auc([r[:2] for r in rows]) > 0.95 and np.mean([p for _, y, p in rows if not y]) < 0.03
    assert np.mean([p for _, y, p in rows if y]) > 0.8  # the rest bear no toxic word


def test_odd_texts(spark, docs, rows, empty):
    w = quality_classifier.train([(quality_classifier.features("good words here"), 1), (quality_classifier.features("### ###"), 0)] * 20)
    assert quality_classifier.score(w, "good words") > 0.5 > quality_classifier.score(w, "### ###")
    assert quality_classifier.apply(docs, w).count() == len(rows) and quality_classifier.apply(empty, w).count() == 0
    assert not quality_classifier.train([(quality_classifier.features("one kind"), 1)]).any() and quality_classifier.score(w, None) == quality_classifier.score(w, "")
    m = toxicity.train([(toxicity.words("a mean word"), 1), (toxicity.words("a kind word"), 0)] * 40)
    assert m.score(toxicity.words("mean")) > m.score(toxicity.words("kind"))
    out = toxicity.apply(docs.withColumn("lang", F.lit(None).cast("string")), m)
    assert out.count() == len(rows) and out.where("score is null or flagged is null").count() == 0
    assert toxicity.train([(toxicity.words("x"), 0)]).score(toxicity.words("x")) == 0.5


def test_stretches_miss_nothing():
    """A long text scores as if it were read at once."""
    r = random.Random(1)
    m = toxicity.train([(toxicity.words("bad thing"), 1), (toxicity.words("fine thing"), 0)] * 30)
    x = toxicity.words(" ".join(r.choice(["fine", "thing", "other", "bad"]) for _ in range(3 * toxicity.STRETCH + 5)))
    whole = m.pooled(x)[0]
    assert m.score(x) == pytest.approx(1 / (1 + np.exp(-(np.maximum(whole, 0) @ m.top + m.top_bias))), abs=1e-6)


def test_rollup(spark, tmp_path):
    r = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    docs = spark.createDataFrame([("a", "en", "one two"), ("a", "en", "one two"), (None, "de", "x-y z"), ("b", None, None), ("b", "en", "")], "source string, lang string, text string")
    c = token_counts.counts
    assert r.commit("1", c(docs, "words-1")) and not r.commit("1", c(docs, "words-1"))
    gone = docs.where("source = 'a'").limit(1)
    assert r.commit("2", c(gone, "words-1", -1), token_counts.revised(docs.where("lang = 'de'"), docs.where("lang = 'de'"), "words-1", "words-2")) and r.commit("3", c(docs.where("false"), "words-1"))
    got = {(x["source"], x["lang"], x["tokenizer"]): (x["n_docs"], x["n_tokens"]) for x in r.totals().collect()}
    assert got == {("a", "en", "words-1"): (1, 2), (None, "de", "words-2"): (1, 3), ("b", None, "words-1"): (1, 0), ("b", "en", "words-1"): (1, 0)}
    assert r.committed() == ["1", "2", "3"]


def test_pipeline(spark):
    """Each stage on what the stage before kept, held against plain Python."""
    import corpus_pipeline as p
    from test_near_dedup import brute
    from test_native import brute_hits

    from strataq.llm.common import table, written

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {}
    for name, stage in p.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), name)
        assert docs.columns == p.COLUMNS
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.where("n_chars != length(text)").count() == 0
    good = [i for i in before if labels.get(i) == 1 and len(before[i].split()) >= 40]
    assert sum(i in kept["quality_rules"] for i in good) >= 0.95 * len(good)
    assert set(kept["line_dedup"]) == set(kept["quality_rules"])
    assert set(kept["near_dedup"]) == {i for i, _, _, first in brute(kept["line_dedup"].items(), 5) if first}
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    assert set(kept["decontamination"]) == {i for (i, _, hit, _) in brute_hits(kept["near_dedup"].items(), items) if not hit}
    out = p.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} == set(kept["decontamination"]) and all(r["round_trip"] for r in out)


def test_stages_on_odd_documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, empty tables: each stage has a row or none, as its docstring says."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    good = " ".join(f"word{k % 7}x{k}" for k in range(60))
    rows = [(1, good, "en", "s", 5), (1, good, "en", "s", 5), (2, good, None, None, None), (None, good + " more", None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, "tie\n" * 50, "en", "s", 1), (6, " ".join(f"long{k}" for k in range(50_000)), "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    out = {name: sorted((str(r["doc_id"]) for r in stage(spark, docs, sf).collect())) for name, stage in p.STAGES}
    assert set(out["quality_rules"]) <= {"1", "2", "None", "6"} and out["line_dedup"] == sorted(str(r[0]) for r in rows)
    assert out["near_dedup"] == ["1", "1", "3", "4", "5", "6", "None"] and out["decontamination"] == out["byte_bpe"] == out["line_dedup"]
    assert all(stage(spark, none, sf).count() == 0 for _, stage in p.STAGES)


def test_near_copies_of_the_stage(spark):
    """Copies with a few other words, of a similarity of 0.8 or more by five-word shingles: one of each group stays."""
    import corpus_pipeline as p

    r = random.Random(8)
    rows = []
    for k in range(120):
        own = [f"w{r.randrange(10_000)}" for _ in range(200)]
        rows.append((2 * k, " ".join(own)))
        for at in r.sample(range(20), 1 + k % 3):  # 5 shingles of 196 a word
            own[10 * at] = "other"
        rows.append((2 * k + 1, " ".join(own)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {x["doc_id"] for x in p.keep_one_of_near_copies(spark, docs, "").collect()}
    assert {2 * k for k in range(120)} <= left and len(left) <= 132
