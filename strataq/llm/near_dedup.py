"""MinHash near-dedup by a multi-index Hamming join.

A set of word shingles has a signature of 48 minima, of b = 16 bits each: 12
chunks of 4 lanes. Two signatures that differ in at most ``DISTANCE`` = 23 lanes
have, by the pigeonhole principle, a chunk with at most one different lane. The
allowed error is enumerated: each chunk gives four keys, each without one lane,
and every pair within the distance meets under one of the 48 keys. (Sets of a
similarity of 0.8 differ in 9.6 lanes on average; more than 23 has a chance of
about 4 in a million.) Pairs that meet are held against the signature distance,
and links are confirmed on the full sets.

Equal sets are one class and take part once; ``linking`` says how the pairs of
a key are held against each other without being all emitted.

Cases: documents without words or text have an empty set and are linked with
nothing; with fewer words than a shingle has, the whole sequence is one; rows
that share a doc_id are versions of one document, whose links count together;
a null doc_id is linked with nothing (null component, kept); doc_ids of any type
that has an order will do, texts too; other columns, whatever their names, are
left out of the report and kept by ``dedup``; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY_PERCENT, drop_written, hashed_ranges, hashed_texts, hashed_windows, hashed_words, likely_in, others, ref, release, written
from .components import components
from .linking import link, shared_keys

CHUNKS, LANES = 12, 4
DISTANCE = 2 * CHUNKS - 1
#: Nodes of a key up to which all its pairs are held against the signature distance.
DIRECT = 16
SIGNATURE = [f"s{c}" for c in range(CHUNKS)]
_MULTIPLIERS = np.random.default_rng(20240607).integers(0, 2**63, CHUNKS * LANES, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles: words without ASCII white space, A-Z lowered."""
    h, _ = hashed_words(text)
    return np.unique(hashed_windows(h, min(width, len(h)))) if len(h) else h


def shingle_sets(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``shingles`` of many texts: all different ones, sorted; the places there of each text's own, one text after the other; how many each has."""
    h, words, _ = hashed_texts(texts)
    if not len(h):
        return h, words[:0], words
    stop = np.cumsum(words)
    n = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
    whose = np.repeat(np.arange(len(words)), n)
    first = np.arange(len(whose)) + np.repeat(stop - words - np.cumsum(n) + n, n)
    every, rank = np.unique(hashed_ranges(h, first, np.minimum(first + width, stop[whose])), return_inverse=True)
    whose, rank = np.divmod(np.unique(whose * len(every) + rank), len(every))
    return every, rank, np.bincount(whose, minlength=len(words))


def signature(own: np.ndarray) -> np.ndarray:
    """12 chunks of four 16-bit lanes."""
    least = np.array([(own * m).min() for m in _MULTIPLIERS], np.uint64)
    lanes = (((least ^ (least >> np.uint64(31))) * _MIX) >> np.uint64(48)).reshape(CHUNKS, LANES)
    return np.bitwise_or.reduce(lanes << (np.arange(LANES, dtype=np.uint64) * np.uint64(16)), axis=1)


def fingerprints(docs: DataFrame, width: int, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h (of the text), n_shingles, set_hash (128 bits), s0 to s11 (null for empty sets): a narrow map."""
    schema = f"doc_id {docs.schema[doc].dataType.simpleString()}, h long, n_shingles long, set_hash binary, " + ", ".join(f"{s} long" for s in SIGNATURE)
    names = ["doc_id", "h", "n_shingles", "set_hash", *SIGNATURE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, hashes, found = [], [], []
            for x in b.column(2):
                own = shingles(x.as_py(), width)
                sizes.append(len(own))
                hashes.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                found.append(signature(own).view(np.int64) if len(own) else np.zeros(CHUNKS, np.int64))
            empty = np.array(sizes, np.int64) == 0
            table = np.array(found, np.int64).reshape(-1, CHUNKS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), *[pa.array(table[:, c].copy(), mask=empty) for c in range(CHUNKS)]], names)
        release()

    return docs.select(ref(doc), F.xxhash64(ref(text)), ref(text)).mapInArrow(run, schema)


def _keys(s) -> list[Column]:
    """The 48 keys of a signature: three lanes of a chunk (48 bits) under the number of chunk and lane left out."""
    out = []
    for c in range(CHUNKS):
        x = s(c)
        for lane in range(LANES):
            low = x.bitwiseAND(F.lit((1 << 16 * lane) - 1))
            high = F.shiftleft(F.shiftrightunsigned(x, 16 * (lane + 1)), 16 * lane) if lane < 3 else F.lit(0).cast("long")
            out.append(low.bitwiseOR(high).bitwiseOR(F.lit((c * LANES + lane) << 48)))
    return out


def _lanes_apart(p: str, q: str) -> Column:
    def apart(c: int) -> Column:
        x = F.col(f"{p}.s{c}").bitwiseXOR(F.col(f"{q}.s{c}"))
        for k in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))

    return reduce(lambda a, b: a + b, [apart(c) for c in range(CHUNKS)])


def _plausible(p: str, q: str, percent: int) -> Column:
    a, b = F.col(f"{p}.n_shingles"), F.col(f"{q}.n_shingles")
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (_lanes_apart(p, q) <= DISTANCE)


def groups(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row a document."""
    every = written(fingerprints(docs, width, doc=doc, text=text), "signatures")
    known = every.where(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
    # nodes are the sets, each with the text of one row, as rows that share a doc_id may differ
    sets = written(known.groupBy("set_hash").agg(F.min(F.struct("doc_id", "h")).alias("of"), F.first("n_shingles").alias("n_shingles"), *[F.first(s).alias(s) for s in SIGNATURE]), "classes")
    classes = sets.withColumnRenamed("set_hash", "rep")
    met = shared_keys(classes.select("rep", F.col("of.doc_id").alias("ord"), F.explode(F.array(*_keys(lambda c: F.col(f"s{c}")))).alias("key")))
    read: list[DataFrame] = []

    def texts(nodes: DataFrame) -> DataFrame:
        spots = written(classes.join(nodes, "rep", "left_semi").select("rep", "of.doc_id", "of.h"), "spots")
        all_texts = docs.select(ref(doc).alias("doc_id"), F.xxhash64(ref(text)).alias("h"), F.coalesce(ref(text), F.lit("")).alias("text"))
        read.append(written(likely_in(all_texts, "h", spots).join(spots, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("rep", "text"), "texts"))
        drop_written(spots)
        return read[-1]

    found = written(link(met, classes.select("rep", "n_shingles", *SIGNATURE), texts, lambda x: shingle_sets(x, width), lambda p, q: _plausible(p, q, percent), percent, DIRECT), "found")
    drop_written(met, *read)
    named = classes.select("rep", "of.doc_id").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "doc_id", F.coalesce("component", "rep").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(least, "component").select(F.col("rep").alias("set_hash"), "component_id")
    out = written(every.select("doc_id", "n_shingles", "set_hash").join(of_class, "set_hash", "left"), "named")
    drop_written(every, sets, found)
    # a document with versions in several components joins them
    versions = out.where(F.col("component_id").isNotNull()).groupBy("doc_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).where("a != b").select("doc_id", "a")
    links = written(out.join(versions, "doc_id").select("a", F.col("component_id").alias("b")).where("a != b").distinct(), "versions")
    if not links.isEmpty():
        out = out.join(components(links).select(F.col("node").alias("component_id"), "component"), "component_id", "left").withColumn("component_id", F.coalesce("component", "component_id"))
    # versions of a document count together; an empty set is a group of its own
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents whose group has a smaller doc_id."""
    gone = groups(docs, width, percent, doc=doc, text=text).where("not kept").select("doc_id").distinct()
    return docs.select(F.struct(*others(docs)).alias("row"), ref(doc).alias("doc_id")).join(gone, "doc_id", "left_anti").select("row.*")
