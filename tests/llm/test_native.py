"""Quality rules, line dedup and decontamination against plain Python."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from strataq.llm import decontaminate, line_dedup, quality_rules
from strataq.llm.common import let, window_hashes


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def covered(starts, width):
    return {p for s in starts for p in range(s, s + width)}


def base(text):
    w = words_of(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    repeat = len(covered([i for i, x in enumerate(windows) if n[x] > 1], 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeat, len(w) < 20 or 100 * repeat > 30 * len(w)


def test_window_hashes_tell_windows_apart(spark):
    for width in range(1, 13):
        words = [random.Random(1).choice("abc") for _ in range(60)]
        got = spark.createDataFrame([(words,)], "w array<string>").select(window_hashes(F.col("w"), width)).first()[0]
        own = [tuple(words[i : i + width]) for i in range(60 - width + 1)]
        assert len(got) == len(own) and len(set(zip(own, got))) == len(set(own)) == len(set(got))
    assert spark.range(1).select(let(F.col("id") + 1, lambda x: x * x)).first()[0] == 1


def test_measures(docs, rows):
    got = quality_rules.measures(docs.select("doc_id", "text"))
    found = Counter((r["doc_id"], r["text"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got.collect())
    assert found == Counter((i, t, *base(t)) for i, t in rows)


def test_rules_are_learnt(spark, docs, empty):
    good = [(i, "plain words that go on and on number " + " ".join(f"w{i}x{k}" for k in range(30)), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(f"W{i}X{k}!!" for k in range(30)), 0) for i in range(60)] + [(2000 + i, " ".join(f"w{i}x{k}###" for k in range(30)), 0) for i in range(60)]
    both = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    out = quality_rules.apply(both.select("doc_id", "text"), both.select("doc_id", "quality")).collect()
    assert {r["doc_id"] for r in out if r["kept"]} == {i for i, *_ in good}
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.apply(empty, labels).count() == 0
    kept = quality_rules.apply(docs.select("doc_id", "text"), labels)
    assert kept.where(F.col("kept") == F.col("base_failed")).count() == 0


def test_line_dedup(docs, rows, empty):
    place = lambda r: (r[0] is not None, r[0] or 0)  # noqa: E731  nulls first
    first, gone = {}, defaultdict(set)
    unique = sorted(set(rows), key=place)
    for i, t in unique:
        lines = (t or "").split("\n")
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if not re.search(r"[^\s]", "\n".join(w), re.ASCII):
                continue
            if w in first:
                gone[i, t] |= {k, k + 1, k + 2}
            else:
                first[w] = (i, t, k)
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        own = gone[i, t]
        want[i, t if not own else "\n".join(x for k, x in enumerate(lines) if k not in own), 0 if t is None else len(lines), len(own)] += 1
    got = line_dedup.dedup(docs)
    assert got.columns == ["doc_id", "n_words", "row_key", "text", "n_lines", "n_removed"]
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()) == want
    assert sum(k[3] for k in want) > 20
    assert line_dedup.dedup(empty).count() == 0


def normal(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(rows, items):
    windows = defaultdict(set)
    for k, t in items:
        w = normal(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(k)
    out = []
    for i, t in rows:
        w, hit, own = normal(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    own |= windows[x]
        out.append((i, len(w), len(hit), tuple(sorted(own))))
    return Counter(out)


def test_decontamination(spark, docs, rows, empty):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items += [(900, "tie tie"), (901, "One"), (902, None), (903, ""), (900, "tie tie"), (904, "long " * 12), (905, "A b, c! A b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(rows, items)
    for limit in (10**6, 0):  # broadcast, and the shuffled join
        got = decontaminate.report(docs, bench, broadcast_rows=limit)
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(r["items"] or ()))) for r in got.collect()) == want
    assert sum(k[2] > 0 for k in want) >= 5
    left = decontaminate.decontaminate(docs, bench)
    assert left.count() == sum(n for k, n in want.items() if not k[2]) and left.columns == docs.columns
    spans = decontaminate.decontaminate(docs, bench, remove="spans")
    assert spans.count() == len(rows)
    n = {k[:1] + k[1:2]: 0 for k in want}
    assert sum(len(normal(r["text"])) for r in spans.collect()) == sum((k[1] - k[2]) * c for k, c in want.items()) and n
    assert decontaminate.report(empty, bench).count() == 0
    assert decontaminate.report(docs, empty.withColumnRenamed("doc_id", "item_id")).where("n_hit > 0").count() == 0
