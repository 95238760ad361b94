"""SimHash near-dedup by a hierarchical index in Gray order.

A text's fingerprint has 64 bits: a bit is 1 if it is set in over half the
hashes of the text's word shingles. Different fingerprints, in the order of
their rank among Gray codes, are cut into parts of neighbours. In that order
neighbours agree in most of their leading bits, also across the border of two
parts. A node over some neighbours takes over the bits in which they all agree
(a mask and a pattern); below it only the others are left. A search goes down
from the root and adds up the differing bits of the patterns that it passes, so
that a whole group goes as soon as the sum is too large, and each bit is
compared once on a way.

The upper nodes, over the parts, are one small table (a mask and a pattern each
``PART`` fingerprints) that every task has. By it a fingerprint visits
its own part and the later ones that it may have neighbours in; each part's own
index is built and searched in one task, which holds the part's fingerprints
(visitors go by in batches). So all pairs within the distance are found, each in
one place, whatever the parts are. A fingerprint has at most 2,080 others within
two bits; links are thinned to a spanning forest a batch before they leave.

Cases: null, empty and wordless texts have fingerprint zero, linked like any
other; with fewer words than a shingle has, the whole sequence is one; rows that
share a doc_id are versions of one document, whose links count together; a null
doc_id is linked with nothing (null component, kept by ``dedup``); doc_ids of
any type that has an order will do; other columns, whatever their names, are
left out of the report and kept by ``dedup``; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, others, ref, release, texts_in, written
from .components import components

SHINGLE, DISTANCE, SEED = 3, 2, 42
#: Fingerprints of a part, about; stretches that make one; children of a node; queries that are searched together.
PART, STRETCHES, FAN, TOGETHER = 1 << 16, 4, 8, 1 << 10
#: Bytes of a text that are taken apart at once; shingles whose bits are counted at once.
_BLOCK, _COUNTED = 1 << 20, 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_TOP = 1 << 63
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- fingerprints --------------------------------------------------------------------------------


def _shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, repeats included, a block at a time: words without ASCII white space, A-Z lowered, joined by a space."""
    held: list[bytes] = []  # the last words of the blocks before
    at, made = 0, False
    while at < len(text):
        end = at + _BLOCK
        gap = _SPACE.search(text, end) if end < len(text) else None
        end = gap.start() if gap else len(text)
        words = held + text[at:end].lower().split()
        at = end
        if len(words) < width:
            held = words
            if at < len(text) or made or not words:
                continue
            yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
            return
        joined = memoryview(b" ".join(words))
        stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        first = np.append(0, stop[:-1] + 1)[: len(words) - width + 1]
        digest = xxhash.xxh64_intdigest
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first.tolist(), stop[width - 1 :].tolist())), np.uint64, len(first))
        held, made = words[len(words) - width + 1 :] if width > 1 else [], True


def _bits(hashes: np.ndarray) -> np.ndarray:
    """A row a hash, a column a bit, the lowest first."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _majority(set_in: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints from how many of n hashes each bit is set in."""
    return np.packbits(2 * set_in > n[:, None], axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def fingerprint(text: str | bytes | None, width: int = SHINGLE) -> int:
    """Of one text."""
    return int(fingerprints_of([text.encode() if isinstance(text, str) else text], width)[0])


def fingerprints_of(texts: list[bytes | None], width: int = SHINGLE) -> np.ndarray:
    """Of many texts: the bits of their shingles are counted together."""
    n, set_in = np.zeros(len(texts), np.int64), np.zeros((len(texts), 64), np.int64)
    held: list[np.ndarray] = []
    whose: list[int] = []

    def count() -> None:
        if held:
            sizes = [len(h) for h in held]
            np.add.at(set_in, whose, np.add.reduceat(_bits(np.concatenate(held)), np.cumsum([0] + sizes[:-1]), axis=0, dtype=np.int64))
            held.clear()
            whose.clear()

    waiting = 0
    for i, text in enumerate(texts):
        for hashes in _shingle_hashes(text or b"", width):
            n[i] += len(hashes)
            for k in range(0, len(hashes), _COUNTED):
                held.append(hashes[k : k + _COUNTED])
                whose.append(i)
                waiting += len(held[-1])
                if waiting >= _COUNTED:
                    count()
                    waiting = 0
    count()
    return _majority(set_in, n)


def fingerprints(docs: DataFrame, width: int = SHINGLE, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (a long whose bits they are): a narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, (own,) in texts_in(b.column(1)):
                found = fingerprints_of(own, width)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(own)), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])
        release()

    return docs.select(ref(doc), ref(text)).mapInArrow(run, f"doc_id {docs.schema[doc].dataType.simpleString()}, fingerprint long")


# --- the index -----------------------------------------------------------------------------------


def gray_rank(fingerprint: Column) -> Column:
    """Place of a fingerprint among the Gray codes, as a long in the order of signed numbers."""
    rank = fingerprint
    for k in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, k))
    return rank.bitwiseXOR(F.lit(-_TOP))


def from_rank(rank: np.ndarray) -> np.ndarray:
    """Fingerprints of places that ``gray_rank`` gave."""
    place = rank.view(np.uint64) ^ np.uint64(_TOP)
    return place ^ (place >> np.uint64(1))


class GrayIndex:
    """Nodes over patterns in Gray order, ``FAN`` neighbours each, level by level; a node has the bits that all below it share and no node above has."""

    def __init__(self, bits: np.ndarray, mask: np.ndarray | None = None) -> None:
        mask = np.full(len(bits), _ALL) if mask is None else mask
        levels = [[bits & mask, mask]]
        while len(levels[-1][0]) > 1:
            low, own = levels[-1]
            starts = np.arange(0, len(low), FAN)
            differ = np.bitwise_or.reduceat(low, starts) ^ np.bitwise_and.reduceat(low, starts)
            shared = np.bitwise_and.reduceat(own, starts) & ~differ
            above = np.repeat(shared, FAN)[: len(low)]
            levels.append([low[starts] & shared, shared])
            levels[-2] = [low & ~above, own & ~above]
        self.levels = levels[::-1]
        self.n = len(bits)

    def near(self, queries: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of queries and of the leaves whose patterns differ from them in at most ``distance`` bits, some queries at a time."""
        for at in range(0, len(queries) if self.n else 0, TOGETHER):
            some = queries[at : at + TOGETHER]
            query, node, differing = np.arange(len(some)), np.zeros(len(some), np.int64), np.zeros(len(some), np.uint8)
            for k, (bits, mask) in enumerate(self.levels):
                if k:
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    query, differing = np.repeat(query, FAN), np.repeat(differing, FAN)
                    if (there := node < len(bits)).sum() < len(node):  # the last node of a level has fewer children
                        query, node, differing = query[there], node[there], differing[there]
                differing = differing + np.bitwise_count((some[query] ^ bits[node]) & mask[node])
                stay = differing <= distance
                query, node, differing = query[stay], node[stay], differing[stay]
            yield query + at, node


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as a-b do, at most one a node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], least)
        np.minimum.at(new, root[y], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _parts(spark: SparkSession, n: int, part: int) -> int:
    """As few parts as ``part`` allows, but one a task that can run at once: visits grow with the square of the number's logarithm."""
    return max(spark.sparkContext.defaultParallelism, -(-n // part))


def in_gray_order(prints: DataFrame, part: int = PART) -> DataFrame:
    """rank, stretch of different fingerprints (column ``fingerprint``, each once): written, stretches of neighbours, several a part."""
    stretches = STRETCHES * _parts(prints.sparkSession, prints.count(), part)
    ranks = prints.select(gray_rank(F.col("fingerprint")).alias("rank"))
    return written(ranks.repartitionByRange(stretches, "rank").withColumn("stretch", F.spark_partition_id()), "gray")


def links(dealt: DataFrame, distance: int = DISTANCE, *, part: int = PART, thin: bool = False) -> DataFrame:
    """a, b (longs): pairs of the fingerprints of ``in_gray_order`` with at most ``distance`` differing bits.

    Neighbouring stretches make a part of about ``part`` fingerprints, or as many parts as tasks run at once.
    thin: fewer links, at most one a fingerprint and batch, that connect the same ones (they need not be near themselves).
    """
    code = F.col("rank").bitwiseXOR(F.lit(-_TOP))
    code = code.bitwiseXOR(F.shiftrightunsigned(code, 1))
    # one row a stretch: their number grows with the table, a 16,384th as fast
    rows = dealt.groupBy("stretch").agg(F.bit_and(code).alias("low"), F.bit_or(code).alias("high"), F.count("*").alias("n")).orderBy("stretch").collect()
    low, high = (np.array([r[c] for r in rows], np.int64).view(np.uint64) for c in ("low", "high"))
    sizes, stretches = np.array([r["n"] for r in rows], np.int64), np.array([r["stretch"] for r in rows], np.int64)
    n, parts = int(sizes.sum()), _parts(dealt.sparkSession, int(sizes.sum()), part)
    own_part = (np.cumsum(sizes) - sizes) * parts // max(1, n)
    numbers, first = np.unique(own_part, return_index=True)
    if len(rows):
        low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
    upper = GrayIndex(low, ~(low ^ high))
    part_of = np.zeros(int(stretches.max(initial=0)) + 1, np.int32)
    part_of[stretches] = own_part

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranks, own = b.column(0).to_numpy(), part_of[b.column(1).to_numpy()]
            for query, node in upper.near(from_rank(ranks), distance):
                to = numbers[node].astype(np.int32)
                later = to >= own[query]
                query, to = query[later], to[later]
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(to != own[query]), pa.array(ranks[query])], ["part", "visitor", "rank"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, members, index = None, [], None

        def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            a, b = forest(a, b) if thin and len(a) else (a, b)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

        def among() -> Iterator[pa.RecordBatch]:
            """Builds the part's index and searches it for its own members."""
            nonlocal members, index
            members = np.concatenate(members)
            index = GrayIndex(members)
            for query, node in index.near(members, distance):
                once = query < node
                yield pairs(members[query[once]], members[node[once]])

        for b in batches:
            to, visitor, prints = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), from_rank(b.column(2).to_numpy())
            edges = np.flatnonzero((to[1:] != to[:-1]) | (visitor[1:] != visitor[:-1])) + 1
            for first, stop in zip([0, *edges], [*edges, len(to)]):
                if to[first] != part:
                    if part is not None and index is None:
                        yield from among()
                    part, members, index = to[first], [], None
                if not visitor[first]:
                    members.append(prints[first:stop])
                    continue
                if index is None:
                    yield from among()
                own = prints[first:stop]
                for query, node in index.near(own, distance):
                    yield pairs(own[query], members[node])
        if part is not None and index is None:
            yield from among()
        release()

    met = dealt.select("rank", "stretch").mapInArrow(visits, "part int, visitor boolean, rank long")
    met = met.repartition(max(1, len(numbers)), "part").sortWithinPartitions("part", "visitor", "rank")
    return met.mapInArrow(found, "a long, b long")


# --- groups --------------------------------------------------------------------------------------


def groups(docs: DataFrame, width: int = SHINGLE, distance: int = DISTANCE, *, doc: str = "doc_id", text: str = "text", part: int = PART) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (null for a null doc_id): a row a document."""
    every = written(fingerprints(docs, width, doc=doc, text=text), "fingerprints")
    known = every.where(F.col("doc_id").isNotNull())
    classes = written(known.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "classes")
    dealt = in_gray_order(classes, part)
    near = written(links(dealt, distance, part=part, thin=True), "near")
    drop_written(dealt)
    # versions of a document count together
    versions = known.groupBy("doc_id").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("z")).where("a != z").select("doc_id", "a")
    same = known.join(versions, "doc_id").select("a", F.col("fingerprint").alias("b")).where("a != b").distinct()
    found = components(near.unionByName(same))
    named = classes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    named = written(named, "named")
    drop_written(near, classes)
    component = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = named.join(component, "component").select("fingerprint", "component_id")
    out = every.join(of_class, "fingerprint", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def dedup(docs: DataFrame, width: int = SHINGLE, distance: int = DISTANCE, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents whose group has a smaller doc_id."""
    gone = groups(docs, width, distance, doc=doc, text=text).where("doc_id != component_id").select("doc_id").distinct()
    return docs.select(F.struct(*others(docs)).alias("row"), ref(doc).alias("doc_id")).join(gone, "doc_id", "left_anti").select("row.*")
