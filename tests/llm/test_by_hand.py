"""Learnt operators against plain Python: the decision list, a pass of the online learner, the network's answer."""

import math
import random
import re

import numpy as np
import pytest

from strataq.llm import quality_classifier as qc
from strataq.llm import quality_rules as qr
from strataq.llm import toxicity as tx


def ratios(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    chars, lines = sum(map(len, w)), t.count("\n") + 1
    own = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    again = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in range(i, i + 8)} if len(set(windows)) < len(windows) else set()
    n, count = max(1, len(w)), lambda s: sum(c in s for c in t)
    return {
        "m_mean_word": chars / n, "m_symbols": count("#*$%&|<>") / n, "m_dup_lines": (len(own) - len(set(own))) / lines, "m_repeats": len(again) / n,
        "m_upper": sum("A" <= c <= "Z" for c in t) / max(1, chars), "m_digits": sum("0" <= c <= "9" for c in t) / max(1, chars), "m_shouts": count("!?") / n, "m_stops": count(".,") / n, "m_different": len(set(w)) / n, "m_words_a_line": len(w) / lines,
    }, len(w) < 20 or 100 * len(again) > 30 * len(w)


def test_decision_list(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))
    rows = []
    for i in range(400):
        w = [word() for _ in range(r.randrange(10, 60))]
        if bad := i % 3 == 0:
            w = [x.upper() if i % 2 else x + "!!" for x in w]
        rows.append((i, " ".join(w), int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").cache()
    labels, texts = docs.select("doc_id", "quality"), docs.select("doc_id", "text")
    rules = qr.learn(qr.labelled(texts, labels))
    assert rules and all(1 <= len(x) <= qr.CONDITIONS for x in rules)
    out = {x["doc_id"]: x for x in qr.apply(texts, labels).collect()}
    for i, text, _ in rows:
        m, failed = ratios(text)
        assert all(out[i][k] == pytest.approx(v) for k, v in m.items()) and out[i]["base_failed"] == failed
        first = next((k for k, own in enumerate(rules, 1) if all((out[i][c.measure] > c.threshold) == c.above for c in own)), None)
        assert (out[i]["kept"], out[i]["rule"]) == (not failed and first is None, first)


def test_online_learner():
    """A pass of follow-the-regularised-leader, a coordinate at a time; the score is a sum over words."""
    r = random.Random(5)
    texts = [(qc.features(" ".join(r.choice(["good", "fine", "bad", "odd", "plain"]) for _ in range(r.randrange(1, 9)))), k % 2) for k in range(30)]
    alpha, beta, l1, l2 = 0.7, 1.3, 0.03, 0.01
    got = qc.train(texts, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=1, seed=9)
    z, n = {}, {}

    def weight(i):
        return 0.0 if abs(z.get(i, 0.0)) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for k in np.random.default_rng(9).permutation(len(texts)):
        x, y = texts[k]
        value = {qc.BUCKETS: 1.0}
        for i in x.tolist():
            value[i] = value.get(i, 0.0) + qc.SCALE / len(x)
        w = {i: weight(i) for i in value}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in value.items())))
        for i, v in value.items():
            g = (p - y) * v
            s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
            z[i] = z.get(i, 0.0) + g - s * w[i]
            n[i] = n.get(i, 0.0) + g * g
    assert {i for i in np.flatnonzero(got).tolist()} == {i for i in z if weight(i)}
    assert all(got[i] == pytest.approx(weight(i), abs=1e-6) for i in z)
    x = qc.features("good odd good")
    logit = sum(float(got[i]) for i in x.tolist()) * qc.SCALE / len(x) + float(got[-1])
    assert qc.score(got, "good odd good") == pytest.approx(1 / (1 + math.exp(-logit)))


def test_network_answer():
    """The convolution by loops: each filter's largest answer over all windows, then one layer."""
    m = tx.train([(tx.words("a mean mean word"), 1), (tx.words("a kind word here"), 0)] * 20, epochs=2)
    for text in ("", "word", "a mean", "some kind of mean word in a longer text"):
        x = tx.words(text)
        rows = [[float(m.embed[a >> 32][d]) + float(m.embed[a & 0xFFFFFFFF][d]) for d in range(tx.DEPTH)] for a in x.tolist()]
        rows += [[0.0] * tx.DEPTH for _ in range(max(tx.WIDTHS) - len(rows))]
        logit, column, f = m.top_bias, 0, 0
        for width in tx.WIDTHS:
            for j in range(tx.FILTERS):
                best = max(sum(rows[i + k][d] * float(m.filters[d][column + k * tx.FILTERS + j]) for k in range(width) for d in range(tx.DEPTH)) for i in range(len(rows) - width + 1))
                logit += max(0.0, best + float(m.bias[f])) * float(m.top[f])
                f += 1
            column += width * tx.FILTERS
        assert m.score(x) == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-4)
