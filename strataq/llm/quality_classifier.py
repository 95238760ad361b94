"""Quality classifier: logistic regression on hashed word n-grams, trained by following the regularised leader.

Features of a text are its words and marks and their pairs, hashed; a pair of
equal words is one feature whatever the word. Their shares of the text are the
sparse vector; its dot product with the weights is the score. FTRL-proximal
keeps a sum of gradients and of their squares a weight and is run over at most
``SAMPLE`` labelled texts (the only sample: the first by hash of the doc_id,
whole texts); scoring is a narrow map over all rows with the weights broadcast
(4 bytes times ``BUCKETS``).

Cases: null and empty texts have no features and get the bias's score; labels
that repeat count as their least; null labels don't train; without labels of
both kinds every score is 0.5; very long texts are scored whole; other columns
are kept if named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HashMemo, ref, release

BUCKETS, SAMPLE, SCALE = 1 << 19, 8_000, 20.0
_TOKENS = re.compile(r"\w+|[^\w\s]+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)
_memo = HashMemo()


def features(text: str | None) -> np.ndarray:
    """Indices of words and pairs, with repetition."""
    tokens = _TOKENS(text or "")
    h = np.fromiter(map(_memo.__getitem__, tokens), np.uint64, len(tokens))
    pairs = ((h[:-1] * _MIX) ^ h[1:]) * _MIX
    pairs[h[:-1] == h[1:]] = 1 << 63
    return (np.concatenate([h, pairs]) >> np.uint64(45)).astype(np.int32) & (BUCKETS - 1)


def train(texts: list[tuple[np.ndarray, int]], *, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001, epochs: int = 4, seed: int = 7) -> np.ndarray:
    """Weights, the bias last, from (indices, label)."""
    z, n, w = (np.zeros(BUCKETS + 1) for _ in range(3))
    if len({y for _, y in texts}) < 2:
        return w.astype(np.float32)
    rows = []
    for x, y in texts:
        at, times = np.unique(x, return_counts=True)
        rows.append((np.append(at, BUCKETS), np.append(times * (SCALE / max(1, len(x))), 1.0), y))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            own = z[at]
            # weights follow from the sums: none where they don't exceed l1
            now = np.where(np.abs(own) <= l1, 0.0, (np.sign(own) * l1 - own) / ((beta + np.sqrt(n[at])) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(now @ x, -35, 35))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * now
            n[at] += g * g
    keep = np.abs(z) > l1
    w[keep] = ((np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))[keep]
    return w.astype(np.float32)


def score(w: np.ndarray, text: str | None) -> float:
    x = features(text)
    return float(1 / (1 + np.exp(-np.clip((w[x].sum(dtype=np.float64) * SCALE / len(x) if len(x) else 0.0) + w[-1], -35, 35))))


def labelled(docs: DataFrame, labels: DataFrame, label: str, train_on: Column, sample: int, *, doc: str = "doc_id", text: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """text, label (and more, but for columns of those names) of the first ``sample`` labelled rows by hash of the doc_id."""
    known = labels.where(F.col(doc).isNotNull() & F.col(label).isNotNull()).groupBy(doc).agg(F.min(label).cast("int").alias("label")).where(train_on)
    known = known.orderBy(F.xxhash64(doc), doc).limit(sample).select(F.col(doc).alias("_of"), "label")
    rows = docs.select(F.col(doc).alias("_doc"), ref(text).alias("text"), F.struct(*[ref(c).alias(f"c{k}") for k, c in enumerate(more)], F.lit(0).alias("_")).alias("_more"))
    both = rows.join(F.broadcast(known), F.col("_doc") == F.col("_of"))  # at most ``sample`` short rows
    return both.select("text", "label", *[F.col("_more")[f"c{k}"].alias(c) for k, c in enumerate(more) if c.lower() not in ("text", "label")])


def fit(rows: DataFrame) -> np.ndarray:
    """rows: text and label, a bounded number; their features come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(x.as_py()).tobytes() for x in b.column(0)], pa.binary()), b.column(1)], ["x", "label"])

    found = rows.select("text", "label").mapInArrow(run, "x binary, label int").toArrow()
    both = sorted(zip(found.column("x").to_pylist(), found.column("label").to_pylist()))  # whatever order they came in
    return train([(np.frombuffer(x, np.int32), y) for x, y in both])


def apply(docs: DataFrame, w: np.ndarray, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and score (0 to 1) of every row; a kept column named score, in any case, gives way to it."""
    keep = tuple(c for c in keep if c.lower() != "score")
    source = docs.select(*[ref(c).alias(f"c{k}") for k, c in enumerate(keep)], ref(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(w)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            found = pa.array([score(own, x.as_py()) for x in b.column(len(keep))], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], found], [*keep, "score"])
        release(_memo)

    return source.mapInArrow(run, schema)
