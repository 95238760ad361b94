"""Toxicity: a convolutional text classifier in numpy, with thresholds by language.

A word is the sum of two hashed embeddings, of itself and of its beginning.
Filters of several widths slide over the words, each keeps its largest answer
in the text, and a logistic layer weighs these. Training is by gradients with
per-weight rates over all labelled texts, whole: they are dealt by doc_id into
shards of about ``SHARD`` texts (at most ``SHARDS``, then larger ones), each
shard goes on from the same model for a round, and what the shards changed is
averaged, an embedding over those that changed it. A sixth of the texts, by
doc_id, is left out of this to calibrate a threshold for each language. Language
decides thresholds only and is never an input of a score. Scoring is a narrow map.
Tasks hold one model and a batch of texts, the driver one model; the order of
rows and the number of partitions don't show.

Cases: null and empty texts score as a text without words; texts of fewer words
than a filter is wide are padded; very long texts are read whole, in stretches
that overlap; a label that repeats counts as its most toxic; without labels of
both kinds every score is 0.5; a language without calibration has the overall
threshold; other columns are kept if named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HashMemo, drop_written, release, written

ROWS, DEPTH, FILTERS, WIDTHS, BEGINNING = 1 << 16, 16, 12, (1, 2, 3), 4
SHARD, SHARDS, STRETCH = 10_000, 64, 4_096
#: Rows of the embeddings that are averaged together.
BLOCK = 1 << 10
#: Labels that are broadcast to the texts; of more (counted first) both are shuffled, with the same rows.
BROADCAST = 1_000_000
_WORDS = re.compile(r"\w+").findall


class _Pairs(HashMemo):
    """Row numbers of a word and of its beginning, in one number."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        whole, begin = HashMemo.hash(word), HashMemo.hash("^" + word[:BEGINNING])
        h = self[word] = (whole % ROWS) << 32 | begin % ROWS
        return h


_pairs = _Pairs()


def words(text: str | None) -> np.ndarray:
    """A number a word: two rows of the embeddings."""
    own = _WORDS((text or "").lower())
    return np.fromiter(map(_pairs.__getitem__, own), np.int64, len(own))


@dataclass
class Model:
    """Embeddings (the last row is the padding), filters of all widths side by side, and the last layer."""

    embed: np.ndarray
    filters: np.ndarray  # DEPTH x (FILTERS for each place of each width)
    bias: np.ndarray
    top: np.ndarray
    top_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def embedded(self, x: np.ndarray) -> np.ndarray:
        out = self.embed[x >> 32] + self.embed[x & 0xFFFFFFFF]
        short = max(WIDTHS) - len(x)
        return np.concatenate([out, np.zeros((short, DEPTH), np.float32)]) if short > 0 else out

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest answer of each filter, where it is, and the embedded words."""
        e = self.embedded(x)
        each = e @ self.filters
        best, at, c = [], [], 0
        for width in WIDTHS:
            n = len(e) - width + 1
            answer = each[:n, c : c + FILTERS].copy()
            for k in range(1, width):
                answer += each[k : k + n, c + k * FILTERS : c + (k + 1) * FILTERS]
            c += width * FILTERS
            where = answer.argmax(axis=0)
            best.append(answer[where, np.arange(FILTERS)])
            at.append(where)
        return np.concatenate(best) + self.bias, np.concatenate(at), e

    def score(self, x: np.ndarray) -> float:
        most = None
        for i in range(0, max(1, len(x)), STRETCH):
            now = self.pooled(x[i : i + STRETCH + max(WIDTHS) - 1])[0]
            most = now if most is None else np.maximum(most, now)
        return float(1 / (1 + np.exp(-np.clip(np.maximum(most, 0) @ self.top + self.top_bias, -35, 35))))


def _fresh(seed: int, scale: float) -> Model:
    r = np.random.default_rng(seed)
    normal = lambda *shape: (r.standard_normal(shape) * 0.1).astype(np.float32)
    embed = normal(ROWS, DEPTH) * np.float32(10 * scale)
    return Model(embed, normal(DEPTH, FILTERS * sum(WIDTHS)) * 3, np.zeros(FILTERS * len(WIDTHS), np.float32), normal(FILTERS * len(WIDTHS)) * 3, 0.0)


class Learner:
    """A model in training: with sums of squared gradients, which set the rate of each weight."""

    def __init__(self, m: Model) -> None:
        self.m, self.top_sum = m, 1e-3
        self.sums = {k: np.full_like(getattr(m, k), 1e-3) for k in ("embed", "filters", "bias", "top")}

    def learn(self, x: np.ndarray, y: int, weight: float, order: np.random.Generator, *, rate: float = 0.05, shrink: float = 1e-5, keep: float = 0.5) -> None:
        """A step on one text."""
        m, sums, firsts = self.m, self.sums, _FIRSTS
        x = x[order.random(len(x)) < keep]  # other words must do for those left out
        best, at, e = m.pooled(x)
        up = np.maximum(best, 0)
        p = 1 / (1 + np.exp(-np.clip(up @ m.top + m.top_bias, -35, 35)))
        g = np.float32((p - y) * weight)
        if abs(g) < 1e-3:
            return
        below = np.where(best > 0, g * m.top, 0).astype(np.float32)
        # only the windows that answered most pass gradients on
        filters, embed_at, embed_g = np.zeros_like(m.filters), [], []
        for j, width in enumerate(WIDTHS):
            own = below[j * FILTERS : (j + 1) * FILTERS]
            for k in range(width):
                rows = at[j * FILTERS : (j + 1) * FILTERS] + k
                cols = firsts[j] + k * FILTERS + np.arange(FILTERS)
                embed_at.append(rows)
                embed_g.append(own[:, None] * m.filters[:, cols].T)
                filters[:, cols] += e[rows].T * own
        for name, grad in (("filters", filters + shrink * m.filters), ("bias", below), ("top", g * up + shrink * m.top)):
            sums[name] += grad * grad
            getattr(m, name)[...] -= rate * grad / np.sqrt(sums[name])
        self.top_sum += float(g * g)
        m.top_bias -= rate * float(g) / self.top_sum**0.5
        rows, grad = np.concatenate(embed_at), np.concatenate(embed_g)
        real = rows < len(x)
        if real.any():
            two = np.concatenate([x[rows[real]] >> 32, x[rows[real]] & 0xFFFFFFFF])
            which, back = np.unique(two, return_inverse=True)
            total = np.zeros((len(which), DEPTH), np.float32)
            np.add.at(total, back, np.concatenate([grad[real], grad[real]]))
            sums["embed"][which] += total * total
            m.embed[which] -= rate * total / np.sqrt(sums["embed"][which])

    def dense(self) -> np.ndarray:
        """All weights and sums but those of the embeddings, in a row."""
        own = [a.ravel() for k in ("filters", "bias", "top") for a in (getattr(self.m, k), self.sums[k])]
        return np.concatenate([*own, [self.m.top_bias, self.top_sum]]).astype(np.float64)

    def add(self, dense: np.ndarray) -> None:
        at = 0
        for k in ("filters", "bias", "top"):
            for a in (getattr(self.m, k), self.sums[k]):
                a += dense[at : at + a.size].reshape(a.shape).astype(np.float32)
                at += a.size
        self.m.top_bias += float(dense[at])
        self.top_sum += float(dense[at + 1])


_FIRSTS = np.cumsum([0, *WIDTHS]) * FILTERS


def _epochs(n: int) -> int:
    """Few texts are gone over more often."""
    return min(40, max(6, 12_000 // max(1, n)))


def _weights(n: int, toxic: int) -> tuple[float, float]:
    """Of the labels 0 and 1: both kinds weigh alike."""
    return n / (2 * (n - toxic)), n / (2 * toxic)


def train(texts: list[tuple[np.ndarray, int]], *, rate: float = 0.05, epochs: int | None = None, shrink: float = 1e-5, keep: float = 0.5, scale: float = 0.1, seed: int = 11) -> Model:
    """From (words, label) in memory; kinds of labels weigh alike, few texts are gone over more often."""
    m = _fresh(seed, scale)
    toxic = sum(y for _, y in texts)
    if not 0 < toxic < len(texts):
        m.top[:] = 0
        return m
    weigh, learner, order = _weights(len(texts), toxic), Learner(m), np.random.default_rng(seed)
    for _ in range(epochs or _epochs(len(texts))):
        for i in order.permutation(len(texts)):
            x, y = texts[i]
            learner.learn(x, y, weigh[y], order, rate=rate, shrink=shrink, keep=keep)
    return m


def _packed(x: np.ndarray) -> bytes:
    """Words in four bytes each."""
    return (x >> 16 | x & 0xFFFF).astype(np.uint32).tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    own = np.frombuffer(x, np.uint32).astype(np.int64)
    return own >> 16 << 32 | own & 0xFFFF


_CHANGES, _CHANGE_NAMES = "block int, shard int, rows binary, weights binary, sums binary", ["block", "shard", "rows", "weights", "sums"]


def _changes(learner: Learner, was: Learner, shard: int) -> pa.RecordBatch:
    """What a shard changed: rows of each block of the embeddings, and the rest as block -1."""
    out = [(-1, shard, b"", (learner.dense() - was.dense()).tobytes(), b"")]
    touched = np.flatnonzero((learner.sums["embed"] != was.sums["embed"]).any(axis=1))
    cuts = np.searchsorted(touched, np.arange(0, ROWS + 1, BLOCK))
    for block, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
        if j > i:
            own = touched[i:j]
            out.append((block, shard, own.astype(np.int32).tobytes(), (learner.m.embed[own] - was.m.embed[own]).tobytes(), (learner.sums["embed"][own] - was.sums["embed"][own]).tobytes()))
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], _CHANGE_NAMES)


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a block, from those of all shards, which come together: means over the shards that changed a row."""

    def mean(block: int, total: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        if block < 0:
            rows, own = b"", [(total[0] / n[0]).tobytes(), b""]
        else:
            at = np.flatnonzero(n)
            rows, own = (at + block * BLOCK).astype(np.int32).tobytes(), [(t[at] / n[at, None]).astype(np.float32).tobytes() for t in total]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([0], pa.int32()), *[pa.array([v], pa.binary()) for v in (rows, *own)]], _CHANGE_NAMES)

    now, total, n = None, [], np.empty(0)
    for b in batches:
        for block, _, rows, *both in zip(*[c.to_pylist() for c in b.columns]):
            if block != now:
                if now is not None:
                    yield mean(now, total, n)
                size = len(both[0]) // 8
                now, total, n = block, [np.zeros(size)] if block < 0 else [np.zeros((BLOCK, DEPTH)), np.zeros((BLOCK, DEPTH))], np.zeros(1 if block < 0 else BLOCK)
            if block < 0:
                total[0] += np.frombuffer(both[0])
                n += 1
            else:
                at = np.frombuffer(rows, np.int32) - block * BLOCK
                n[at] += 1
                for t, v in zip(total, both):
                    t[at] += np.frombuffer(v, np.float32).reshape(-1, DEPTH)
    if now is not None:
        yield mean(now, total, n)


def _round(learner: Learner, texts: DataFrame, weigh: tuple[float, float], number: int, seed: int) -> None:
    """Each shard of ``texts`` (shard, id, x, label; a shard's rows in one partition) goes over its texts once, in an order of this round."""
    shared = texts.sparkSession.sparkContext.broadcast(learner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was, now = shared.value, None
        for b in batches:
            for shard, x, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                if shard != now:
                    if now is not None:
                        yield _changes(own, was, now)
                    now, own, order = shard, deepcopy(was), np.random.default_rng([seed, number, shard])
                own.learn(_unpacked(x.as_py()), y, weigh[y], order)
        if now is not None:
            yield _changes(own, was, now)
        release()

    ordered = texts.sortWithinPartitions("shard", F.xxhash64("id", F.lit(number)), "id", "label", "x").select("shard", "x", "label")
    changes = ordered.mapInArrow(run, _CHANGES)
    averaged = changes.repartition(8, "block").sortWithinPartitions("block", "shard").mapInArrow(_averaged, _CHANGES).toArrow()
    for block, _, rows, weights, sums in zip(*[averaged.column(c).to_pylist() for c in _CHANGE_NAMES]):
        if block < 0:
            learner.add(np.frombuffer(weights))
        else:
            at = np.frombuffer(rows, np.int32)
            learner.m.embed[at] += np.frombuffer(weights, np.float32).reshape(-1, DEPTH)
            learner.sums["embed"][at] += np.frombuffer(sums, np.float32).reshape(-1, DEPTH)
    shared.destroy()


def best_cuts(scored: DataFrame, *by: str) -> DataFrame:
    """``by`` and cut, from ``by``, score and label: the threshold with the best F1, of equal ones the middle; none for rows of one kind."""
    each = scored.groupBy(*by, "score").agg(F.count("*").alias("n"), F.sum("label").alias("y"))
    all_rows = Window.partitionBy(*by)
    down = all_rows.orderBy(F.desc("score"))
    above = down.rowsBetween(Window.unboundedPreceding, 0)
    n, y = F.sum("n").over(all_rows), F.sum("y").over(all_rows)
    cuts = each.select(*by, ((F.col("score") + F.lead("score").over(down)) / 2).alias("cut"), (2 * F.sum("y").over(above) / (F.sum("n").over(above) + y)).alias("f1"), ((y > 0) & (y < n)).alias("both"))
    good = cuts.where("both and cut is not null").withColumn("most", F.max("f1").over(all_rows)).where("f1 = most")
    return good.groupBy(*by).agg(F.percentile("cut", F.lit(0.5)).alias("cut"))


def calibrated(m: Model, texts: DataFrame) -> Model:
    """With thresholds from texts left out (x, label, lang)."""
    shared = texts.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shared.value.score(_unpacked(x.as_py())) for x in b.column(0)], pa.float64()), *b.columns[1:]], ["score", "label", "lang"])

    scored = written(texts.select("x", "label", "lang").mapInArrow(run, "score double, label int, lang string"), "scored")
    m.threshold = next((r["cut"] for r in best_cuts(scored).collect()), None) or 0.5
    m.thresholds = {r["lang"]: r["cut"] for r in best_cuts(scored, "lang").collect()}
    drop_written(scored)
    shared.destroy()
    return m


def fit(docs: DataFrame, labels: DataFrame, train_on: Column, *, label: str = "toxic", doc: str = "doc_id", text: str = "text", lang: str = "lang", shard: int = SHARD, scale: float = 0.1, seed: int = 11) -> Model:
    """A model from all labelled texts of which ``train_on`` is true: a sixth of them calibrates, the others train."""
    known = labels.where(F.col(doc).isNotNull() & F.col(label).isNotNull()).groupBy(doc).agg(F.max(label).cast("int").alias("label")).where(train_on).where("label in (0, 1)").withColumnRenamed(doc, "id")
    own = docs.select(F.col(doc).alias("id"), F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("lang")).join(F.broadcast(known) if known.count() <= BROADCAST else known, "id")
    rows = own.select("id", "text", "label", "lang", (F.pmod(F.xxhash64("id", F.lit("part")), F.lit(6)) == 0).alias("left_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_packed(words(x.as_py())) for x in b.column(1)], pa.binary()), *b.columns[2:]], ["id", "x", "label", "lang", "left_out"])
        release(_pairs)

    kind = rows.schema["id"].dataType.simpleString()
    every = written(rows.mapInArrow(run, f"id {kind}, x binary, label int, lang string, left_out boolean"), "labelled")
    n, toxic = every.where("not left_out").agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    learner = Learner(_fresh(seed, scale))
    if 0 < toxic < n:
        shards = min(SHARDS, -(-n // shard))
        number = F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int")
        dealt = every.where("not left_out").select(number.alias("shard"), "id", "x", "label").repartition(shards, "shard").persist(StorageLevel.DISK_ONLY)
        for k in range(_epochs(n)):
            _round(learner, dealt, _weights(n, toxic), k, seed)
        dealt.unpersist()
    else:
        learner.m.top[:] = 0
    m = calibrated(learner.m, every.where("left_out"))
    drop_written(every)
    return m


def apply(docs: DataFrame, model: Model, *, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score (0 to 1), threshold (of the language) and flagged of every row."""
    source = docs.select(*keep, F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    more = [("score", T.DoubleType()), ("threshold", T.DoubleType()), ("flagged", T.BooleanType())]
    schema = T.StructType([*[source.schema[c] for c in keep], *[T.StructField(*x) for x in more]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [m.score(words(x.as_py())) for x in b.column(len(keep))]
            limits = [m.thresholds.get(x.as_py(), m.threshold) for x in b.column(len(keep) + 1)]
            yield pa.RecordBatch.from_arrays([*b.select(list(keep)).columns, pa.array(found, pa.float64()), pa.array(limits, pa.float64()), pa.array([s >= t for s, t in zip(found, limits)], pa.bool_())], [*keep, *[x for x, _ in more]])
        release(_pairs)

    return source.mapInArrow(run, schema)
