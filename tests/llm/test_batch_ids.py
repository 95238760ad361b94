"""Batch ids of any characters: none is lost, hidden or taken for another."""

import pytest

from strataq.llm import token_counts

IDS = ["a/b", "a/c", "a", "_hidden", ".x", "", "q=1", "sp ace", "%2F", "{x,y}*[z]", "é日", "A", "..", "x" * 120]


def test_any_id_counts_once(spark, tmp_path):
    docs = spark.createDataFrame([("one two three", "en", "s")], "text string, lang string, source string")
    ledger = token_counts.Rollup(spark, str(tmp_path / "r"))
    for k, name in enumerate(IDS):
        assert ledger.commit(name, token_counts.counts(docs, "words-1")), name
        assert not ledger.commit(name, token_counts.counts(docs, "words-1")), name
        assert ledger.totals().first()["n_docs"] == k + 1
    assert ledger.committed() == sorted(IDS)
    assert tuple(ledger.totals().first()) == ("s", "en", "words-1", len(IDS), 3 * len(IDS))
    with pytest.raises(ValueError, match="120 bytes"):
        ledger.commit("é" * 61, token_counts.counts(docs, "words-1"))


def test_what_is_lost_before_the_rename_is_not_counted(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([("one two", "en", "s")], "text string, lang string, source string")
    ledger = token_counts.Rollup(spark, str(tmp_path / "r"))
    real = token_counts.Rollup._fs
    calls = []

    def lost(self, path):
        calls.append(path)
        if "/batches/b" in path:
            raise RuntimeError("lost")
        return real(self, path)

    monkeypatch.setattr(token_counts.Rollup, "_fs", lost)
    with pytest.raises(RuntimeError):
        ledger.commit("n", token_counts.counts(docs, "words-1"))
    monkeypatch.undo()
    assert any("/staged/" not in c for c in calls) and ledger.committed() == [] and ledger.totals().count() == 0
    assert ledger.commit("n", token_counts.counts(docs, "words-1")) and ledger.totals().first()["n_tokens"] == 2
