"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash finds whole pre-tokens that are in the
vocabulary; the others are merged with a heap over linked bytes. Results of
both are remembered per worker, in a table of bounded size.

Cases: null text is empty text and gives no ids; an empty table gives an empty
table; repeated rows give repeated rows; texts of any length are encoded whole
(the heap keeps a pre-token of n bytes at O(n log n)); other columns are kept
only if named in ``keep``.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release

#: Pre-tokens in each half of what a worker remembers, and ids in an outgoing batch.
MEMO, BATCH_IDS = 120_000, 1_000_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, of a rank file: a base64 token and its rank a line."""
    with open(path, "rb") as f:
        found = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [found[i] for i in range(len(found))]


class PerfectHash:
    """Minimal perfect hash (hash and displace): n keys in n slots, one probe and one comparison a look-up."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, n // 4 + 1
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            groups[(h >> 40) % self.buckets].append(i)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot = np.full(n, -1, np.int32)
        free = n - 1
        for g in sorted(range(self.buckets), key=lambda g: -len(groups[g])):
            own = groups[g]
            if len(own) == 1:  # any free slot: its number is kept, negated
                while self.slot[free] >= 0:
                    free -= 1
                self.slot[free], self.shift[g] = own[0], -free - 1
            elif own:
                for d in range(1, 1 << 22):
                    at = {self._mixed(hashes[i], d) for i in own}
                    if len(at) == len(own) and all(self.slot[a] < 0 for a in at):
                        break
                else:
                    raise ValueError("keys repeat")
                for i in own:
                    self.slot[self._mixed(hashes[i], d)] = i
                self.shift[g] = d
        self.keys = keys

    def _mixed(self, h: int, d: int) -> int:
        return ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 >> 24 & 0xFFFFFFFF) % self.n

    def get(self, key: bytes) -> int:
        """The key's number, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = int(self.shift[(h >> 40) % self.buckets])
        i = int(self.slot[-d - 1 if d < 0 else self._mixed(h, d)])
        return i if i >= 0 and self.keys[i] == key else -1


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: pairs of neighbours merge by rank, leftmost first; a heap holds the pairs, links hold the order.

    A part begins at i and ends at after[i]; rank[i] is that of the pair which it begins, so that older entries of the heap are known as such.
    """
    n, get, pop, push = len(piece), ranks.get, heapq.heappop, heapq.heappush
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    rank = [get(piece[i : i + 2], -1) for i in range(n - 1)]
    rank.append(-1)
    heap = [r * n + i for i, r in enumerate(rank) if r >= 0]
    heapq.heapify(heap)
    while heap:
        r, i = divmod(pop(heap), n)
        if rank[i] != r:
            continue
        j = after[i]
        stop = after[i] = after[j]
        rank[i] = rank[j] = -1
        if stop < n:
            before[stop] = i
            rank[i] = r = get(piece[i : after[stop]], -1)
            if r >= 0:
                push(heap, r * n + i)
        h = before[i]
        if h >= 0:
            rank[h] = r = get(piece[h:stop], -1)
            if r >= 0:
                push(heap, r * n + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec(dict):
    """Encodes and decodes; as a dict it remembers the ids of pre-tokens."""

    def __init__(self, tokens: list[bytes], pattern: str):
        super().__init__()
        self.tokens, self.index, self.split = tokens, PerfectHash(tokens), regex.compile(pattern).findall
        self.most = MEMO
        self.older: dict[str, tuple[int, ...]] = {}
        self.ranks = {t: i for i, t in enumerate(tokens)}  # of the parts that merges make

    def __missing__(self, piece: str) -> tuple[int, ...]:
        out = self.older.get(piece)
        if out is None:
            raw = piece.encode()
            i = self.index.get(raw)
            out = (i,) if i >= 0 else tuple(merged(raw, self.ranks))
        if len(self) >= self.most:  # what was asked for of late stays: half of the table is older
            self.older = dict(self)
            self.clear()
        if len(piece) < 64:
            self[piece] = out
        return out

    def forget(self) -> None:
        """At the end of a task: a third stays, that which was asked for first, as frequent words are."""
        first = dict(islice(self.items(), self.most // 3))
        self.older = {}
        release(self)
        self.update(first)

    def encode(self, text: str | None) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.__getitem__, self.split(text or ""))), np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_codecs: dict[int, Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """One a worker process and vocabulary, built when first needed."""
    tokens = shared.value
    if id(tokens) not in _codecs:
        _codecs.clear()
        _codecs[id(tokens)] = Codec(tokens, pattern)
    return _codecs[id(tokens)]


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False, round_trip: bool = False, memo: int = MEMO) -> DataFrame:
    """``keep``, n_tokens, ids (array of int) and, if asked for, the bytes that the ids decode to, and whether these are the text's.

    A narrow map: no shuffle. The vocabulary is the only broadcast; its size is that of the rank file.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    source = docs.select(*keep, F.col(text).alias("_text"))  # which ``keep`` may name too
    fields = [source.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.BinaryType())] * decoded + [T.StructField("round_trip", T.BooleanType())] * round_trip

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        codec.most = memo  # more is faster and takes about 300 bytes each, twice

        def batch(kept: pa.RecordBatch, found: list[np.ndarray], same: list[bool]) -> pa.RecordBatch:
            sizes = np.array([len(x) for x in found], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            flat = pa.array(np.concatenate(found) if found else np.empty(0, np.int32))
            columns = [*kept.columns, pa.array(sizes), pa.ListArray.from_arrays(offsets, flat)]
            if decoded:
                columns.append(pa.array([codec.decode(x) for x in found], pa.binary()))
            if round_trip:
                columns.append(pa.array(same, pa.bool_()))
            return pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

        for b in batches:
            kept, at, found, same, total = b.select(list(keep)), 0, [], [], 0
            for i, x in enumerate(b.column(len(keep))):
                own = x.as_py()
                found.append(codec.encode(own))
                if round_trip:
                    same.append(codec.decode(found[-1]) == (own or "").encode())
                total += len(found[-1])
                if total >= BATCH_IDS:
                    yield batch(kept.slice(at, i + 1 - at), found, same)
                    at, found, same, total = i + 1, [], [], 0
            if found:
                yield batch(kept.slice(at), found, same)
        codec.forget()

    return source.mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, ranks_path: str, *, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and decoded (binary): the bytes of each list of ids; null ids give no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    source = encoded.select(*keep, ids)
    fields = [source.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for b in batches:
            texts = [b"".join(tokens[i] for i in x.as_py() or ()) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.select(list(keep)).columns, pa.array(texts, pa.binary())], [f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields))
