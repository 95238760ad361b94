"""Fill-in-middle against slices of Python strings, and the exact way back."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.llm import fill_in_middle as fim


def by_hand(doc, text, salt="1:", cut=90, spm=20):
    text = text or ""
    digest = hashlib.sha256(f"{salt}{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= cut:
        return n, "plain", None, None, text
    p, m, s = text[:i], text[i:j], text[j:]
    return (n, "spm", i, j - i, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", i, j - i, f"<P>{p}<S>{s}<M>{m}")


TEXTS = ["", "a", "é", "日本語", "🎉", "aé日🎉", "🎉a🎉a", "plain <P> text", "< P > <S", "<M", "x" * 999 + "é" * 999 + "日" * 999 + "🎉" * 999, "\x00\n\t", "é combined ‍"]


def mixed(k):
    r = random.Random(k)
    return "".join(r.choice("aZ \n") * r.randint(0, 5) + r.choice(["é", "ß", "日", "🎉", "", "퟿", "￿"]) * r.randint(0, 3) for _ in range(k))


@pytest.mark.parametrize("block", [1 << 20, 1, 5])
def test_cuts_by_runs(monkeypatch, block):
    monkeypatch.setattr(fim, "_BLOCK", block)
    texts = TEXTS + [mixed(k) for k in range(40)]
    r = np.random.default_rng(1)
    h1, h2 = (r.integers(0, 2**32, len(texts)) for _ in range(2))
    n, low, low_at, high, high_at = fim.pieces_of([t.encode() for t in texts], h1, h2)
    for t, a, b, c, d, e, x, y in zip(texts, n, low, low_at, high, high_at, h1.tolist(), h2.tolist()):
        i, j = sorted((x % (len(t) + 1), y % (len(t) + 1)))
        assert (a, b, d) == (len(t), i, j)
        assert (c, e) == (len(t[:i].encode()), len(t[:j].encode()))


def test_runs_are_maximal():
    runs = fim.Runs(np.frombuffer("abcéé日a".encode(), np.uint8))
    assert runs.unit.tolist() == [0, 3, 5, 6] and runs.byte.tolist() == [0, 3, 7, 10] and runs.width.tolist() == [1, 2, 3, 1]
    assert len(fim.Runs(np.full(3 << 20, 97, np.uint8)).unit) == 1


def test_same_as_slices_and_back(spark, docs, rows):
    out = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted(tuple(map(str, (r["doc_id"], *[r[c] for c in fim.MADE], r["back"]))) for r in out.collect())
    assert got == sorted(tuple(map(str, (d, *by_hand(d, t), t or ""))) for d, t in rows)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_texts_that_hold_parts_of_sentinels(spark):
    rows = [(k, "".join(random.Random(k).choices(["<", "P", ">", "S", "M", "P>", "<S", "é"], k=k % 40))) for k in range(400)]
    out = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), salt="x", cut_percent=100, spm_percent=50)
    out = out.withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in out.collect())
    assert got == sorted((d, *by_hand(d, t, "x", 100, 50), t) for d, t in rows)


def test_other_columns(spark):
    docs = spark.createDataFrame([("k", "some text", 1, 2, 3, 4, 5)], "doc_id string, text string, N int, Form int, made int, row int, `a.b` int")
    out = fim.transform(docs)
    assert out.columns == ["doc_id", "text", "made", "row", "a.b", *fim.MADE]
    r = out.first()
    assert (r["made"], r["row"], r["a.b"], r["text"]) == (3, 4, 5, "some text")
    assert tuple(r[c] for c in fim.MADE) == by_hand("k", "some text")


def test_bytes_that_are_no_text_and_empty_table(spark, empty):
    docs = spark.createDataFrame([(k, bytes(random.Random(k).randbytes(k))) for k in range(60)], "doc_id long, b binary").select("doc_id", "b", F.col("b").cast("string").alias("text"))
    for r in fim.transform(docs).select("b", "form", F.col("output").cast("binary").alias("o")).collect():
        assert len(r["o"]) == len(r["b"]) + (0 if r["form"] == "plain" else 9)
    assert fim.transform(empty).count() == 0
