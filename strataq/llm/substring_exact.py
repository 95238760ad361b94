"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts elsewhere go.

Construction is column-wise over many strings at once: each round inserts one
symbol per string, from right to left, and updates the order of the strings'
suffixes (the collection's positional Burrows-Wheeler order) and the common
prefixes of neighbours in it. A window repeats if a neighbour shares its first
``length`` symbols. The symbols of a round are read from a file that is written
column by column and read once, in sequence.

To construct in parts of bounded size, each window is dealt by its minimiser:
the ``GRAM``-byte string in it with the least hash, leftmost first. Equal windows
have the same one at the same place, so runs of windows with one minimiser,
aligned at it, hold equal windows in the same column; different minimisers never
share a window. Runs whose minimiser occurs once are left out, equal runs
(copies) are counted and represented once, and a minimiser with more than
``CROWD`` different runs isn't held in one task: its windows are counted by their
128-bit hashes in a partial aggregation.

Cases: null text is the empty string; texts shorter than ``length`` lose
nothing; rows that repeat are copies and lose all (from ``length`` bytes on);
doc_id may be null or repeat; an empty table gives an empty one; spans may cut
characters, so what is kept is binary.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, written

LENGTH, GRAM = 400, 24
#: Different runs of a minimiser that one task constructs at most; runs that are constructed together; bytes of a text looked at together.
CROWD, TOGETHER, SLICE = 50_000, 20_000, 1 << 22
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _gram_hashes(raw: bytes) -> np.ndarray:
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    h = (words[:-16] * _C1) ^ ((words[8:-8] ^ np.uint64(0x5851F42D4C957F2D)) * _C2)
    h ^= h >> np.uint64(29)
    h = (h ^ words[16:]) * _C3
    return h ^ (h >> np.uint64(32))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours (at least as many as there are)."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[:n] = x
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start (of the first window), run (windows), lead (from there to the minimiser), anchor (its hash): the runs of a text."""
    width, parts = length - GRAM + 1, []
    for at in range(0, max(0, len(raw) - length + 1), SLICE):
        h = _gram_hashes(raw[at : at + SLICE + length - 1])
        tagged = (h & np.uint64(2**64 - 2**24)) | np.arange(len(h), dtype=np.uint64)
        place = (sliding_least(tagged, width) & np.uint64(2**24 - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        parts.append((first + at, np.diff(np.append(first, len(place))), place[first] - first, h[place[first]].view(np.int64)))
    if not parts:
        none = np.empty(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """id (of the row), anchor, c1, c2 (of the run's bytes), start, run, lead."""
    source = docs.select("id", "h", "text")
    schema = "id string, h long, anchor long, c1 long, c2 long, start long, run int, lead int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "h", "anchor", "c1", "c2", "start", "run", "lead"]
        for b in batches:
            rows, cols, digests, total = [], [], [], 0

            def out() -> pa.RecordBatch:
                at = pa.array(np.repeat(*map(np.array, zip(*rows))))
                start, n, lead, anchor = (np.concatenate(x) for x in zip(*cols))
                c = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *map(pa.array, (anchor, c[:, 0].copy(), c[:, 1].copy(), start, n.astype(np.int32), lead.astype(np.int32)))], names)

            for i, x in enumerate(b.column(2)):
                raw = (x.as_py() or "").encode()
                if len(raw) < length:
                    continue
                found = runs_of(raw, length)
                rows.append((i, len(found[0])))
                cols.append(found)
                digests += [xxhash.xxh3_128_digest(raw[s : s + n - 1 + length]) for s, n in zip(found[0].tolist(), found[1].tolist())]
                total += len(found[0])
                if total >= 200_000:
                    yield out()
                    rows, cols, digests, total = [], [], [], 0
            if rows:
                yield out()

    return source.mapInArrow(run, schema)


def repeated(strings: list[bytes], lead: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows of which strings repeat in another string of the group, as a table of booleans.

    Strings are aligned at their minimiser (``lead`` bytes in), groups ascend. Each
    round inserts the symbol of one column: the order is sorted stably by
    (group, symbol), and the common prefix of two new neighbours is one more than
    the least one between their former places.
    """
    m = len(strings)
    size = np.array([len(s) for s in strings], np.int64)
    left, right = int(lead.max()), int((size - lead).max())
    end, columns = size - lead, left + right
    seen = np.zeros((m, int(size.max()) - length + 1), bool)
    with tempfile.TemporaryFile() as spool:  # a column after the other, from the right
        step = max(1, (1 << 24) // m)
        for top in range(columns, 0, -step):
            low = max(0, top - step)
            block = np.zeros((top - low, m), np.uint8)
            for i, s in enumerate(strings):
                a = left - int(lead[i])  # the string's first column
                p, q = max(low, a), min(top, a + len(s))
                if p < q:
                    block[p - low : q - low, i] = np.frombuffer(s, np.uint8, q - p, p - a)
            spool.write(block[::-1].tobytes())
        spool.seek(0)
        order, common = np.arange(m), np.zeros(m, np.int32)
        for c in range(right - 1, -left - 1, -1):
            symbol = np.frombuffer(spool.read(m), np.uint8).astype(np.int64)
            inside = (c < end) & (c >= -lead)
            key = group * 512 + np.where(inside, symbol, 256)
            own = key[order]
            if m > 1 and not (own[1:] >= own[:-1]).all():
                place = np.argsort(own, kind="stable")
                own = own[place]
            else:
                place = np.arange(m)
            same = np.empty(m, bool)
            same[0] = False
            same[1:] = own[1:] == own[:-1]
            same &= (own & 511) != 256
            fresh = np.zeros(m, np.int32)
            near = np.flatnonzero(same)
            was, now = place[near - 1], place[near]
            value = common[now] + 1
            far = np.flatnonzero(now - was > 1)
            if len(far):
                at = np.empty(2 * len(far), np.int64)
                at[0::2], at[1::2] = was[far] + 1, now[far] + 1
                value[far] = np.minimum.reduceat(np.append(common, 0), at)[0::2] + 1
            fresh[near] = value
            order, common = order[place], fresh
            hit = common >= length
            if hit.any():
                hit[:-1] |= hit[1:]
                who = order[hit]
                seen[who, c + lead[who]] = True
    return seen


def _construct(runs: DataFrame, length: int, together: int) -> DataFrame:
    """anchor, c1, c2, o, n: runs of repeated windows; the input is dealt by anchor and sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            anchor, c1, c2, lead, data = zip(*rows)
            anchors = np.array(anchor, np.int64)
            seen = repeated(list(data), np.array(lead, np.int64), np.cumsum(np.concatenate([[0], anchors[1:] != anchors[:-1]])), length)
            edge = np.diff(np.pad(seen, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            who, first = np.nonzero(edge == 1)
            n = np.nonzero(edge == -1)[1] - first
            return pa.RecordBatch.from_arrays([pa.array(anchors[who]), pa.array(np.array(c1, np.int64)[who]), pa.array(np.array(c2, np.int64)[who]), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], ["anchor", "c1", "c2", "o", "n"])

        for b in batches:
            for r in zip(*[x.to_pylist() for x in b.columns]):
                if len(rows) >= together and rows[-1][0] != r[0]:
                    yield out()
                    rows = []
                rows.append(r)
        if rows:
            yield out()

    return runs.mapInArrow(run, "anchor long, c1 long, c2 long, o int, n int")


def _counted(runs: DataFrame, length: int) -> DataFrame:
    """The same for crowds: windows by their hashes; c1, c2 tell the runs apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for anchor, c1, c2, _, data in zip(*[x.to_pylist() for x in b.columns]):
                count = len(data) - length + 1
                w = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[j : j + length]) for j in range(count)), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(count, x)) for x in (anchor, c1, c2)] + [pa.array(np.arange(count, dtype=np.int32)), pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy())], ["anchor", "c1", "c2", "o", "w1", "w2"])

    every = written(runs.mapInArrow(run, "anchor long, c1 long, c2 long, o int, w1 long, w2 long"), "crowds")
    often = every.groupBy("w1", "w2").agg(F.count("*").alias("times")).where("times > 1").select("w1", "w2")
    return every.join(often, ["w1", "w2"]).select("anchor", "c1", "c2", "o", F.lit(1).alias("n"))


def spans(docs: DataFrame, length: int = LENGTH, *, doc: str = "doc_id", text: str = "text", crowd: int = CROWD, together: int = TOGETHER) -> DataFrame:
    """id, h (of row_key), spans: sorted array of struct(first, stop), in bytes, of what a row loses; they don't touch."""
    key = row_key(doc, text)
    rows = docs.select(key["id"].alias("id"), key["h"].alias("h"), F.col(text).alias("text"))
    every = written(_runs(rows, length), "runs")
    often = written(every.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "often")
    every = written(every.join(often, "anchor"), "candidates")  # of two plain exchanges, so that a hot anchor is split at run time
    place = F.struct("id", "h", "start")
    runs = every.groupBy("anchor", "c1", "c2").agg(F.count("*").alias("times"), F.min(place).alias("at"), F.first("run").alias("run"), F.first("lead").alias("lead"))
    runs = written(runs, "different")
    kinds = runs.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    needed = runs.join(kinds, "anchor").select("anchor", "c1", "c2", "run", "lead", "kinds", F.coalesce("at.id", F.lit("")).alias("id"), "at.h", "at.start")
    texts = rows.where(F.octet_length("text") >= length).select(F.coalesce("id", F.lit("")).alias("id"), "h", F.col("text").cast("binary").alias("raw"))
    with_bytes = needed.join(texts, ["id", "h"]).select("anchor", "c1", "c2", "lead", F.expr(f"substring(raw, cast(start + 1 as int), run - 1 + {length})").alias("data"), "kinds")
    with_bytes = written(with_bytes, "strings")
    columns = ["anchor", "c1", "c2", "lead", "data"]
    few = with_bytes.where(F.col("kinds") <= crowd).select(*columns).repartition("anchor").sortWithinPartitions("anchor", "c1", "c2")
    found = _construct(few, length, together).unionByName(_counted(with_bytes.where(F.col("kinds") > crowd).select(*columns), length))
    copies = runs.where("times > 1").select("anchor", "c1", "c2", F.lit(0).alias("o"), F.col("run").alias("n"))
    found = written(found.unionByName(copies), "repeated")
    lost = every.join(found, ["anchor", "c1", "c2"]).select("id", "h", (F.col("start") + F.col("o")).alias("first"), (F.col("start") + F.col("o") + F.col("n") - 1 + length).alias("stop"))
    return lost.groupBy("id", "h").agg(_united(F.sort_array(F.collect_set(F.struct("first", "stop")))).alias("spans"))


def _united(ranges: Column) -> Column:
    """Maximal spans of sorted (first, stop): the last one grows while ranges begin within it or at its end."""
    pair = F.struct(F.lit(-1).cast("long").alias("first"), F.lit(-1).cast("long").alias("stop"))
    start = F.struct(F.array().cast("array<struct<first:bigint,stop:bigint>>").alias("done"), pair.alias("last"))

    def closed(s: Column) -> Column:
        return F.when(s["last"]["stop"] >= 0, F.concat(s["done"], F.array(s["last"]))).otherwise(s["done"])

    def step(s: Column, r: Column) -> Column:
        longer = F.struct(s["last"]["first"].alias("first"), F.greatest(s["last"]["stop"], r["stop"]).alias("stop"))
        return F.when(r["first"] <= s["last"]["stop"], F.struct(s["done"].alias("done"), longer.alias("last"))).otherwise(F.struct(closed(s).alias("done"), r.alias("last")))

    return F.aggregate(ranges, start, step, closed)


def dedup(docs: DataFrame, length: int = LENGTH, *, doc: str = "doc_id", text: str = "text", crowd: int = CROWD, together: int = TOGETHER) -> DataFrame:
    """doc_id, n_bytes, spans (removed; null: none), kept (binary): a row a document."""
    lost = spans(docs, length, doc=doc, text=text, crowd=crowd, together=together).select(F.struct("id", "h").alias("key"), "spans")
    rows = docs.select(F.col(doc).alias("doc_id"), row_key(doc, text).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    both = rows.join(lost, "key", "left").select("doc_id", "raw", "spans")
    schema = f"doc_id {docs.schema[doc].dataType.simpleString()}, n_bytes long, spans array<struct<first:bigint,stop:bigint>>, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, sizes = [], []
            for x, s in zip(b.column(1), b.column(2)):
                raw, own = x.as_py(), s.as_py() or ()
                at, left = 0, []
                for r in own:
                    left.append(raw[at : r["first"]])
                    at = r["stop"]
                kept.append(b"".join(left) + raw[at:])
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), b.column(2), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return both.mapInArrow(run, schema)
