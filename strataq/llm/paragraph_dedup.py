"""Substring dedup: paragraphs that repeat, exactly or nearly, are removed but for the first of each group.

A paragraph is a line; a line of more than ``LONG`` words is cut further where
the content says so (at local minima of the hashes of word pairs), so that a
passage which stands inside different texts is cut at the same places. Of
paragraphs of ``LEAST`` words or more, five-word shingles give a few minima,
grouped into bands that are tuned for the wanted recall. Paragraphs that share
a band meet (``linking``), exact Jaccard similarity confirms them, connected
components are the groups, and all but a group's first paragraph, by doc_id and
place, are removed. Shorter paragraphs, from ``shortest`` words on, go where
they repeat exactly.

A passage that stands inside other text needn't hold a whole paragraph. So
every window of ``PASSAGE`` words that repeats, within lines or across, goes as
well. Windows meet under their least run of ``RUN`` words: runs that occur once
are left out, stretches of windows with the same run are held against each
other as a whole, and window by window where a run has different stretches.

Cases: texts without words, empty and null ones have no paragraphs; paragraphs that repeat in a text count as any other; rows
equal in doc_id and text count as one place; a null doc_id sorts first; an
empty table gives an empty one; very long texts are cut and held whole; other columns pass through
``dedup``, but ``n_paragraphs`` and ``n_removed`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY_PERCENT, drop_written, hashed_ranges, hashed_texts, hashed_windows, others, ref, release, row_key, texts_in, written
from .linking import link, shared_keys
from .near_dedup import shingle_sets
from .substring_exact import sliding_least

#: Words up to which a line is never cut, half the stretch in which a cut is the least, words that a paragraph has at least.
#: The lines that thousands of documents share have up to 16 words; from 17 on they are 2 % of the documents without a repeated passage.
LONG, RADIUS = 64, 16
LEAST = RADIUS + 1
RECALL, APART = 0.99, 0.2
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = np.random.default_rng(20240611).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_MOST = np.uint64(2**64 - 1)
#: Words of a passage that goes wherever it repeats, and of the runs in it of which one, chosen by content, brings equal passages together.
PASSAGE, RUN = 51, 12


def tuned(similarity: float = SIMILARITY_PERCENT / 100, recall: float = RECALL, apart: float = APART, most: int = 64) -> tuple[int, int]:
    """(bands, rows): the fewest bands that find pairs of the similarity with the recall; among equally many, the one that least often brings together pairs of ``apart``."""
    fits = [(b, 1 - (1 - apart**r) ** b, r) for r in range(1, 9) for b in range(1, most // r + 1) if 1 - (1 - similarity**r) ** b >= recall]
    b, _, r = min(fits)
    return b, r


BANDS, ROWS = tuned()


def cut(words: np.ndarray, lines: np.ndarray, radius: int = RADIUS, long: int = LONG) -> np.ndarray:
    """First words of paragraphs: of all lines, and places within long ones whose pair hash is the least around them."""
    starts = (np.cumsum(lines) - lines).astype(np.int64)
    if not (lines > long).all():
        own = np.flatnonzero(np.repeat(lines > long, lines))
        return np.union1d(starts, own[cut(words[own], lines[lines > long], radius, long)]) if len(own) else starts
    if not len(lines):
        return starts
    pair = np.full(len(words), _MOST)
    pair[1:] = ((words[:-1] * _MIX) ^ words[1:]) * _MIX >> np.uint64(1)
    pair[starts] = _MOST
    place = np.arange(len(words)) + np.repeat(np.arange(1, len(lines) + 1), lines) * radius
    spread = np.full(len(words) + (len(lines) + 1) * radius + radius, _MOST)
    spread[place] = pair
    least = spread.copy()
    width, have = 2 * radius + 1, 1
    while have < width:  # the least of 2, 4, ... neighbours, then of the width
        step = min(have, width - have)
        least[: len(least) - step] = np.minimum(least[: len(least) - step], least[step:])
        have += step
    own = np.flatnonzero((least[place - radius] == pair) & (pair != _MOST))
    tie = np.diff(place[own], prepend=-radius - 1) <= radius  # of equal ones in a stretch the first
    own = own[~tie]
    line = np.searchsorted(starts, own, "right") - 1
    inside = (own - starts[line] > radius) & (starts[line] + lines[line] - own > radius)  # no piece at an end is shorter than others
    return np.union1d(starts, own[inside])


def split_words(text: str | None) -> list[bytes]:
    """Words in lower case, as ``hashed_words`` takes them."""
    return (text or "").encode().lower().split()


def _stretches(h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each run of ``RUN`` words that is the least (the first of equal ones) of some window of ``PASSAGE``: place p, hash, and the words from a to b of all windows whose least it is.

    Of texts one after the other, with so many words each.
    """
    none = np.empty(0, np.int64)
    if len(h) < PASSAGE:
        return none, none.view(np.uint64), none, none
    own = hashed_windows(h, RUN)
    low = np.uint64(2**32 - 1)  # half of the hash tells which is the least, the other half is its place
    at = (sliding_least((own & ~low) | np.arange(len(own), dtype=np.uint64), PASSAGE - RUN + 1) & low).astype(np.int64)
    n = np.maximum(words - PASSAGE + 1, 0)
    windows = np.arange(n.sum()) + np.repeat(np.cumsum(words) - words - np.cumsum(n) + n, n)  # none reaches into the next text
    at = at[windows]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return at[first], own[at[first]], windows[first], windows[last] + PASSAGE


def _binary(table: np.ndarray) -> pa.Array:
    """Rows of two 64-bit numbers as values of 16 bytes."""
    ends = np.arange(0, 16 * len(table) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(ends), pa.py_buffer(table.tobytes())])


def paragraphs(docs: DataFrame, *, text: str = "text", width: int = SHINGLE_WORDS, shortest: int = LEAST, passages: bool = True) -> DataFrame:
    """id, h (key of the row) and a, b (first word, and the one behind the last) of two kinds of rows.

    Paragraphs: i (place), rep (128-bit hash of the words), k0, ... (hashes of bands; null below ``LEAST`` words, for paragraphs of
    ``shortest`` words on that only their equals meet). Stretches of all windows of ``PASSAGE`` words that share their
    least run (rep is null): p (of the run), x (its hash), y (of all words).
    """
    bands = [f"k{j}" for j in range(BANDS)]
    schema = "id string, h long, i int, p int, a int, b int, rep binary, x long, y long, " + ", ".join(f"{k} long" for k in bands)
    names = ["id", "h", "i", "p", "a", "b", "rep", "x", "y", *bands]

    def minima(own: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        edges = np.stack([a, b - width + 1], axis=1).ravel()
        least = [np.minimum.reduceat(np.append(own * m, _MOST), edges)[0::2] for m in _MULTIPLIERS[: BANDS * ROWS]]
        table = np.array(least).reshape(BANDS, ROWS, len(a))
        key = np.zeros((BANDS, len(a)), np.uint64) + np.arange(BANDS, dtype=np.uint64)[:, None]
        for j in range(ROWS):
            key = (key ^ table[:, j]) * _MIX
            key ^= key >> np.uint64(29)
        return (key >> np.uint64(16)).view(np.int64)  # 48 bits are enough to meet

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"rep": pa.binary(), **dict.fromkeys(["x", "y", *bands], pa.int64())}
        for batch in batches:
            for row, (texts,) in texts_in(batch.column(2)):
                h, words, lines = hashed_texts(texts)
                start = np.cumsum(words) - words

                def rows_of(ints: dict[str, np.ndarray], columns: dict[str, pa.Array]) -> pa.RecordBatch:
                    """Places are counted in their texts."""
                    whose = np.searchsorted(start, ints["a"], "right") - 1
                    columns = columns | {c: pa.array((v - start[whose]).astype(np.int32)) for c, v in ints.items()}
                    if "rep" in columns:
                        columns["i"] = pa.array((keep - np.searchsorted(pieces, start)[whose]).astype(np.int32))
                    rest = [columns[c] if c in columns else pa.nulls(len(whose), kinds.get(c, pa.int32())) for c in names[2:]]
                    at = pa.array(whose + row)
                    return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *rest], names)

                pieces = cut(h, lines)
                ends = np.append(pieces, len(h))[1:]
                keep = np.flatnonzero(ends - pieces >= shortest)
                if len(keep):
                    a, b = pieces[keep], ends[keep]
                    keys = np.zeros((BANDS, len(a)), np.int64)
                    if len(long := np.flatnonzero(b - a >= LEAST)):
                        keys[:, long] = minima(hashed_windows(h, width), a[long], b[long])
                    reps = np.stack([hashed_ranges(h, a, b, kind) for kind in (0, 1)], axis=1)
                    yield rows_of({"a": a, "b": b}, {"rep": _binary(reps), **{k: pa.array(v, mask=b - a < LEAST) for k, v in zip(bands, keys)}})
                if passages:
                    p, x, a, b = _stretches(h, words)
                    if len(p):
                        yield rows_of({"p": p, "a": a, "b": b}, {"x": pa.array(x.view(np.int64)), "y": pa.array(hashed_ranges(h, a, b, 1).view(np.int64))})
        release()

    return docs.select("id", "h", text).mapInArrow(run, schema)


def _texts(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """rep, text of the paragraphs needed (id, h, a, b, rep): their texts are met once and cut."""
    spots = needed.groupBy("id", "h").agg(F.collect_list(F.struct("rep", "a", "b")).alias("spots"))
    both = rows.select(F.coalesce("id", F.lit("")).alias("id"), "h", "text").join(spots, ["id", "h"]).select("text", "spots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            own = batch.column(1).flatten()
            a, b = (own.field(k).to_pylist() for k in ("a", "b"))
            at = 0
            for x, n in zip(batch.column(0).cast(pa.large_binary()).to_pylist(), pc.list_value_length(batch.column(1)).to_pylist()):
                words = (x or b"").lower().split()
                found += [b" ".join(words[a[j] : b[j]]) for j in range(at, at + n)]
                at += n
            yield pa.RecordBatch.from_arrays([own.field("rep"), pa.array(found, pa.binary()).cast(pa.string())], ["rep", "text"])

    return both.mapInArrow(run, "rep binary, text string").dropDuplicates(["rep"])


def _windows(rows: DataFrame, stretches: DataFrame) -> DataFrame:
    """id, h, a, w: hashes of all windows of ``PASSAGE`` words in each of the stretches (id, h, a, b), the first at word a."""
    spots = stretches.groupBy("id", "h").agg(F.collect_list(F.struct("a", "b")).alias("spots")).select(F.struct("id", "h").alias("key"), "spots")
    both = rows.select(F.struct("id", "h").alias("key"), "text").join(spots, "key").select("key.id", "key.h", "text", "spots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (texts,) in texts_in(batch.column(2)):
                h, words, _ = hashed_texts(texts)
                own = hashed_windows(h, PASSAGE).view(np.int64)
                spots = batch.column(3).slice(row, len(texts))
                whose = np.repeat(np.arange(len(texts)), pc.list_value_length(spots).to_numpy())
                a, b = (spots.flatten().field(k).to_numpy() for k in ("a", "b"))
                n = b - a - PASSAGE + 1
                place = np.repeat(a + (np.cumsum(words) - words)[whose] - np.cumsum(n) + n, n) + np.arange(n.sum())
                at = pa.array(whose + row)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(own[place]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(a), lists], ["id", "h", "a", "w"])
        release()

    return both.mapInArrow(run, "id string, h long, a int, w array<long>")


def _merged(spans: Column) -> Column:
    """Spans (sorted) of words as the fewest that cover the same words."""

    @F.arrow_udf("array<struct<a:int,b:int>>")
    def fewest(column: pa.Array) -> pa.Array:
        n = pc.list_value_length(column).to_numpy()
        own = column.flatten()
        far = np.repeat(np.arange(len(n), dtype=np.int64) << 32, n)  # each row's words behind those of the row before
        a, b = (own.field(k).to_numpy() + far for k in ("a", "b"))
        upto = np.maximum.accumulate(b)
        first = np.flatnonzero(a > np.append(-1, upto)[:-1])
        last = np.append(first, len(a))[1:] - 1
        parts = [pa.array((x & (2**32 - 1)).astype(np.int32)) for x in (a[first], upto[last])]
        ends = np.searchsorted(first, np.append(0, np.cumsum(n)))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(parts, ["a", "b"]))

    return fewest(spans)


def _pieces(docs: DataFrame, rows: DataFrame, every: DataFrame, percent: int, width: int, doc: str) -> DataFrame:
    """id, h, a, b of the paragraphs that aren't the first of their group."""
    own = every.where("rep is not null")
    met = shared_keys(own.where("k0 is not null").select("rep", F.explode(F.array(*[f"k{j}" for j in range(BANDS)])).alias("key")))
    nodes = met.select("rep").distinct()
    spots = own.select("rep", F.struct(F.coalesce("id", F.lit("")).alias("id"), "h", "a", "b").alias("at"), *[f"k{j}" for j in range(BANDS)]).join(nodes, "rep", "left_semi")
    traits = written(spots.groupBy("rep").agg(F.min("at").alias("at"), *[F.first(f"k{j}").alias(f"k{j}") for j in range(BANDS)]), "nodes")
    texts = written(_texts(rows, traits.select("rep", "at.*")), "texts")
    found = link(met, traits.drop("at"), lambda _: texts, lambda x: shingle_sets(x, width), lambda p, q: F.lit(True), percent)
    often = own.groupBy("rep").agg(F.count("*").alias("n"), F.min("id").alias("_")).where("n > 1").select(F.col("rep").alias("node"), F.col("rep").alias("component"))
    groups = written(found.unionByName(often.join(found, "node", "left_anti")), "groups").withColumnRenamed("node", "rep")
    drop_written(met, traits, texts)
    place = F.struct(F.col("id").cast(docs.schema[doc].dataType).alias("doc"), "h", "i", "a", "b")  # a and b follow from the others
    members = written(own.join(groups, "rep").select("component", place.alias("at")), "members")
    first = members.groupBy("component").agg(F.min("at").alias("first"))
    return members.join(written(first, "first"), "component").where("at != first").select(F.col("at.doc").cast("string").alias("id"), "at.h", "at.a", "at.b")


def _passages(docs: DataFrame, rows: DataFrame, every: DataFrame, doc: str) -> DataFrame:
    """id, h, a, b of words in windows of ``PASSAGE`` words that stand somewhere before; a window that repeats in its own text goes if it doesn't reach into the first."""
    at = F.struct(F.col("id").cast(docs.schema[doc].dataType).alias("doc"), "h", "p", "a", "b")  # a and b follow from the others; id from doc
    own = (F.col("at.doc").cast("string").alias("id"), "at.h", "at.a", "at.b")
    apart = (F.col("at.doc").eqNullSafe(F.col("first.doc")) & (F.col("at.h") == F.col("first.h")) & (F.col("at.p") < F.col("first.p") + PASSAGE)) == F.lit(False)
    runs = every.where("rep is null").select("id", "h", "p", "a", "b", "x", "y")
    often = written(runs.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").select("x"), "often")
    runs = written(runs.join(often, "x"), "runs")  # a run that occurs once has no window that repeats
    spots = runs.select("x", "y", at.alias("at"))
    classes = written(spots.groupBy("x", "y").agg(F.min("at").alias("first"), F.max("at").alias("last")), "classes")
    repeated = written(classes.where("first != last").select("x", "y", "first"), "repeated")
    again = written(spots.join(repeated, ["x", "y"]).where("at != first").select("x", *own, apart.alias("apart")), "again")
    drop_written(often, runs, repeated)
    # windows of different stretches around the same run
    shared = written(classes.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").select("x"), "shared")
    stretches = classes.select(F.col("first.doc").cast("string").alias("id"), "first.h", "x", "first.a", "first.b").unionByName(again.where("not apart").drop("apart"))  # reaching into the first with its neighbours doesn't keep a window apart from an earlier one
    each = written(_windows(rows, stretches.join(shared, "x")), "windows")
    drop_written(classes, shared)
    place = F.struct(F.col("id").cast(docs.schema[doc].dataType).alias("doc"), "h", (F.col("a") + F.col("k")).alias("p"))
    each = each.select("id", "h", "a", F.posexplode("w").alias("k", "w")).select("w", place.alias("at"))  # a window's run is that of its equals
    least = written(each.groupBy("w").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first != last").drop("last"), "least")
    within = each.join(least, "w").where("at != first").where(apart).select(F.col("at.doc").cast("string").alias("id"), "at.h", F.col("at.p").alias("a"), (F.col("at.p") + PASSAGE).alias("b"))
    return again.where("apart").select("id", "h", "a", "b").unionByName(within)


def report(docs: DataFrame, percent: int = SIMILARITY_PERCENT, width: int = SHINGLE_WORDS, *, doc: str = "doc_id", text: str = "text", shortest: int = LEAST, passages: bool = True) -> DataFrame:
    """key (row_key), n_paragraphs, removed (array of struct(a, b), words from a to b, apart and sorted; null: none): a row a document with paragraphs.

    shortest: words of the shortest paragraphs that go where they repeat exactly. passages: repeated windows go as well.
    """
    key = row_key(doc, text)
    rows = docs.select(key["id"].alias("id"), key["h"].alias("h"), F.col(text).alias("text"))
    every = written(paragraphs(rows, width=width, shortest=shortest, passages=passages), "paragraphs")
    gone = _pieces(docs, rows, every, percent, width, doc)
    if passages:
        gone = gone.unionByName(_passages(docs, rows, every, doc))
    gone = gone.groupBy("id", "h").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("removed"))
    gone = gone.select(F.struct("id", "h").alias("key"), _merged(F.col("removed")).alias("removed"))
    counted = every.where("rep is not null").groupBy("id", "h").agg(F.count_distinct("i").alias("n_paragraphs"))
    return counted.select(F.struct("id", "h").alias("key"), "n_paragraphs").join(gone, "key", "full").select("key", F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"), "removed")


def dedup(docs: DataFrame, percent: int = SIMILARITY_PERCENT, width: int = SHINGLE_WORDS, *, doc: str = "doc_id", text: str = "text", shortest: int = LEAST, passages: bool = True) -> DataFrame:
    """docs with ``text`` without the words that ``report`` removes, plus n_paragraphs and n_removed (spans).

    The words left of texts that lose some keep their case, their lines and the white space between them.
    """
    import re

    found = report(docs, percent, width, doc=doc, text=text, shortest=shortest, passages=passages)
    tagged = docs.select(F.struct(*others(docs, text, "n_paragraphs", "n_removed")).alias("row"), ref(text).alias("text"), row_key(doc, text).alias("key"))
    both = tagged.join(found, "key", "left")
    words_at = re.compile(rb"[^ \t\n\r\x0b\x0c]+")

    @F.pandas_udf("string")
    def left(texts, removed):
        out = []
        for x, spots in zip(texts, removed):
            if spots is None or x is None:
                out.append(x)
                continue
            raw = x.encode()
            spans = [m.span() for m in words_at.finditer(raw)]
            at, parts = 0, []
            for s in spots:
                parts.append(raw[at : spans[s["a"]][0]])
                at = spans[s["b"] - 1][1]
            out.append((b"".join(parts) + raw[at:]).decode())
        import pandas as pd

        return pd.Series(out)

    out = both.select(
        "row",
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(left(F.col("text"), F.col("removed"))).alias("text"),
        F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
    )
    return out.select("row.*", F.col("text").alias(text), "n_paragraphs", "n_removed")
