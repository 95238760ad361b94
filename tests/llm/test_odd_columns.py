"""Columns with names that operators use themselves, and doc_ids of text."""

import pytest
from pyspark.sql import functions as F

from strataq.llm import decontaminate, line_dedup, near_dedup, paragraph_dedup, quality_classifier, quality_rules

CLASHING = ["n_words", "Kept", "rule", "_gone", "_row_key", "row", "key", "gone", "hits", "n_lines", "n_removed", "component_id", "rep", "_t", "base_failed", "m_digits", "a.b"]
MADE = {"n_words", "kept", "rule", "base_failed", "m_digits", "n_lines"}
LONG = " ".join(f"w{k}" for k in range(60))
ROWS = [("b", LONG), ("a", LONG), ("c", "x y z\nx y\nlast\n" + LONG), ("d", "x y z\nx y\nlast\nother"), ("e", None), ("f", ""), ("f", "")]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, "doc_id string, text string")


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


def same(made, want, extra, columns=("doc_id", "text")):
    """The same rows as without those columns, which stay as they were."""
    key = lambda r: tuple(map(str, r))
    got = made.select(*columns, *[f"`{c}`" for c in extra]).collect()
    assert sorted(key(r[: len(columns)]) for r in got) == sorted(map(key, want.select(*columns).collect()))
    assert all(r[len(columns) + k] == f"own {c}" for r in got for k, c in enumerate(extra))


def test_quality_rules(spark, plain, clashing):
    labels = spark.createDataFrame([], "doc_id string, quality int")
    extra = [c for c in CLASHING if c.lower() not in MADE]
    same(quality_rules.apply(clashing, labels), quality_rules.apply(plain, labels), extra, ("doc_id", "text", "n_words", "kept", "base_failed"))


def test_line_dedup(plain, clashing):
    same(line_dedup.dedup(clashing), line_dedup.dedup(plain), [c for c in CLASHING if c not in ("n_lines", "n_removed")], ("doc_id", "text", "n_removed"))


@pytest.mark.parametrize("remove", ["documents", "spans"])
def test_decontaminate(spark, plain, clashing, remove):
    benchmark = spark.createDataFrame([(1, "x y z x y last")], "item_id int, text string")
    out = decontaminate.decontaminate(clashing, benchmark, remove=remove)
    assert out.columns == clashing.columns
    same(out, decontaminate.decontaminate(plain, benchmark, remove=remove), CLASHING)


def test_near_dedup_and_text_ids(plain, clashing):
    out = near_dedup.dedup(clashing)
    assert out.columns == clashing.columns
    same(out, near_dedup.dedup(plain), CLASHING)
    assert sorted(r["doc_id"] for r in out.collect()) == ["a", "d", "e", "f", "f"]
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.groups(plain).collect()}["b"] == "a"


def test_paragraph_dedup(plain, clashing):
    same(paragraph_dedup.dedup(clashing), paragraph_dedup.dedup(plain), [c for c in CLASHING if c != "n_removed"], ("doc_id", "text", "n_removed"))


def test_quality_classifier(spark):
    rows = [(k, f"word{k % 2} other", "own", "own", 7.0, "own") for k in range(6)] + [(9, None, "own", "own", 7.0, "own"), (None, "", "own", "own", 7.0, "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _label string, label string, Score double, `a.b` string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)] + [(9, 1), (None, 1), (3, None)], "doc_id long, quality int")
    known = quality_classifier.labelled(docs, labels, "quality", F.lit(True), 100, more=("_label", "label", "a.b"))
    assert known.columns == ["text", "label", "_label", "a.b"]
    assert sorted((str(r["text"]), r["label"]) for r in known.collect()) == sorted([*[(f"word{k % 2} other", k % 2) for k in range(6)], ("None", 1)])
    out = quality_classifier.apply(docs, quality_classifier.fit(known), keep=("doc_id", "text", "_label", "Score", "a.b"))
    assert out.columns == ["doc_id", "text", "_label", "a.b", "score"]
    assert sorted(map(str, [(r["doc_id"], r["text"], r["_label"], r["a.b"]) for r in out.collect()])) == sorted(map(str, [(r[0], r[1], r[2], r[5]) for r in rows]))
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    # another column may be the text
    assert quality_classifier.apply(docs.withColumnRenamed("text", "_text"), quality_classifier.fit(known), text="_text", keep=("_text",)).count() == len(rows)
