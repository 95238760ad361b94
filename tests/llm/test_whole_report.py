"""What pieces don't stand for: lines below the least size, passages of just over 50 words."""

import random

from strataq.llm import paragraph_dedup as op

SCHEMA = "doc_id long, text string"


def word(r):
    return f"{r.choice('abcdefgh')}{r.randrange(100_000)}"


def left(spark, rows):
    return {r["doc_id"]: r["text"].split() for r in op.dedup(spark.createDataFrame(rows, SCHEMA), shortest=1).collect()}


def test_short_and_long_lines_go_whole(spark):
    r = random.Random(7)
    short = [" ".join(word(r) for _ in range(n)) for n in range(1, 9)]
    long = [" ".join(word(r) for _ in range(r.randrange(25, 45))) for _ in range(40)]
    own = [" ".join(word(r) for _ in range(12)) for _ in range(4)]
    rows = [(i, "\n".join([own[i], *(short + long)[:: 1 if i % 2 else -1]])) for i in range(4)]
    got = left(spark, rows)
    assert got[0] == rows[0][1].split()
    assert all(got[i] == own[i].split() for i in (1, 2, 3))


def test_shorter_lines_stay_by_default(spark):
    r = random.Random(5)
    line = {n: " ".join(word(r) for _ in range(n)) for n in (op.LEAST - 1, op.LEAST)}
    got = {x["doc_id"]: x["text"].split() for x in op.dedup(spark.createDataFrame([(i, "\n".join(line.values())) for i in range(2)], SCHEMA)).collect()}
    assert got[1] == line[op.LEAST - 1].split()


def test_null_ids_and_equal_rows(spark):
    rows = [(None, "a b c\nd e"), (1, "a b c\nx"), (1, "a b c\nx"), (2, None), (3, "")]
    got = sorted((str(r["doc_id"]), (r["text"] or "").split()) for r in op.dedup(spark.createDataFrame(rows, SCHEMA), shortest=1).collect())
    assert got == [("1", ["x"]), ("1", ["x"]), ("2", []), ("3", []), ("None", ["a", "b", "c", "d", "e"])]


def test_passages_of_just_over_50_words_go_whole(spark):
    """51 and more words inside other text, in one line or across lines: every word of the later ones goes."""
    r = random.Random(11)
    rows, keep = [], {}
    for k in range(150):
        n = 51 + k % 10
        passage = [word(r) for _ in range(n)]
        for j in range(3):
            before, after = ([word(r) for _ in range(r.randrange(60))] for _ in range(2))
            i = 3 * k + j
            inner = passage if k % 2 else [w + "\n" if q % 17 == j else w for q, w in enumerate(passage)]
            rows.append((i, " ".join([*before, *inner, *after])))
            keep[i] = before + passage + after if j == 0 else before + after
    got = left(spark, rows)
    assert all(got[i] == keep[i] for i in keep if i % 3 == 0)
    assert all(set(got[i]) <= set(keep[i]) for i in keep)
    # a nearly equal piece may reach a word or two out of a passage
    assert sum(len(keep[i]) - len(got[i]) for i in keep) <= 0.005 * sum(map(len, keep.values()))


def test_fifty_words_stay_where_no_piece_repeats(spark):
    r = random.Random(13)
    passage = [word(r) for _ in range(50)]
    rows = [(i, "\n".join(" ".join(x) for x in ([word(r) for _ in range(4)], [*[word(r) for _ in range(3)], *passage[:8]], passage[8:16], passage[16:]))) for i in range(2)]
    assert left(spark, rows)[0] == rows[0][1].split()


def test_stretches_against_all_windows(spark):
    """Windows of a few words of which many repeat, in themselves too: those that occurred before and apart go, no others of 51 words."""
    r = random.Random(17)
    base = [[r.choice("abc") + str(r.randrange(40)) for _ in range(120)] for _ in range(4)]
    rows = []
    for i in range(30):
        words = []
        for _ in range(3):
            own, a = base[r.randrange(4)], r.randrange(70)
            words += [word(r) for _ in range(r.randrange(4))] + own[a : a + r.randrange(40, 90)]
        rows.append((i, words))
    rows.append((30, ["x"] * 500))
    first, gone = {}, {}
    for i, words in rows:
        gone[i] = set()
        for p in range(len(words) - op.PASSAGE + 1):
            j, q = first.setdefault(tuple(words[p : p + op.PASSAGE]), (i, p))
            if (j, q) != (i, p) and (j != i or p >= q + op.PASSAGE):
                gone[i] |= set(range(p, p + op.PASSAGE))
    found = op.report(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], SCHEMA)).collect()
    spans = {int(f["key"]["id"]): {k for s in f["removed"] or () for k in range(s["a"], s["b"])} for f in found}
    assert all(gone[i] <= spans.get(i, set()) for i in gone) and sum(map(len, gone.values())) > 1000
