"""What the operators share: tables, written intermediates and small expressions."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Five words a shingle and a similarity of 0.8 wherever a contract fixes neither.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80

#: Of a table of hashes that is broadcast: at most 2**27 bits, 16 MB; Spark's bitmaps have 2**15.
MOST_BITS, _BITMAP = 27, 15

_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where the session names none and has no other machines (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="strataq-"))
    return f"file://{_own_folder[0]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strataq/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more: what was made of them is written itself, so that no lost executor needs them again."""
    for t in tables:
        spark = t.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(t._written_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def likely_in(rows: DataFrame, h: str, wanted: DataFrame) -> DataFrame:
    """Rows whose hash ``h`` (a long) may be among those of wanted: all that are, and about one in sixteen of the others, so that few go on into a join.

    A bit a hash, in a table that is broadcast: 16 bits a row of wanted, ``MOST_BITS`` at most (beyond, more of the others stay).
    """
    bits = 1 << min(MOST_BITS, max(_BITMAP, (16 * wanted.count() - 1).bit_length()))
    place = F.col(h).bitwiseAND(F.lit(bits - 1).cast("long"))
    block, at = F.shiftright(place, _BITMAP), place.bitwiseAND(F.lit((1 << _BITMAP) - 1).cast("long"))
    set_bits = wanted.groupBy(block.alias("set_block")).agg(F.bitmap_construct_agg(at).alias("set_bits"))
    byte = F.conv(F.hex(F.substring(F.col("set_bits"), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(set_bits), block == F.col("set_block"))
    return found.where(F.getbit(byte, at.bitwiseAND(F.lit(7).cast("long")).cast("int")) == 1).drop("set_block", "set_bits")


def ref(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(docs: DataFrame, *made: str) -> list[Column]:
    """The columns of docs but those that have the name, in any case, of one that is made."""
    names = {m.lower() for m in made}
    return [ref(c) for c in docs.columns if c.lower() not in names]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is. Texts without other letters take the quick way."""
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(slow)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """struct(id, h): tells rows apart even if a doc_id is null or repeats with another text; equal rows have equal keys."""
    return F.struct(F.col(doc_id).cast("string").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit("\x00"))).alias("h"))


def in_groups(positions: Column, width: int) -> Column:
    """How many places the runs [p, p + width) cover together; positions: sorted, distinct."""
    n = F.size(positions)
    steps = F.zip_with(F.slice(positions, 1, n - 1), F.slice(positions, 2, n - 1), lambda a, b: F.least(b - a, F.lit(width)))
    return F.when(n > 0, F.aggregate(steps, F.lit(width).cast("long"), lambda s, x: s + x)).otherwise(F.lit(0).cast("long"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, as an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def window_hashes(words: Column, width: int) -> Column:
    """Hash of each window of ``width`` consecutive words (an empty array if there are fewer).

    By doubling: the hash of 2n words is made of those of n, so a window costs log(width) steps.
    """
    none = F.array().cast("array<bigint>")

    def joined(left: Column, right: Column, gap: int) -> Column:
        n = F.size(right) - gap
        return F.when(n > 0, F.zip_with(F.slice(left, 1, n), F.slice(right, F.lit(gap + 1), n), lambda a, b: F.xxhash64(a, b))).otherwise(none)

    def grow(got: Column, have: int, left: int, out: Column | None, done: int) -> Column:
        if left & have:
            own = got if out is None else joined(out, got, done)
            return own if left == have else let(own, lambda o: let(joined(got, got, have), lambda g: grow(g, 2 * have, left - have, o, done + have)))
        return let(joined(got, got, have), lambda g: grow(g, 2 * have, left, out, done))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: grow(h, 1, width, None, 0))


class _Powers:
    """Powers of an odd number modulo 2**64, and those of its inverse: tables that grow when they are asked for more."""

    def __init__(self, base: int) -> None:
        self.base, self.n = base, 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 12)
            self.table = [np.cumprod(np.array([1] + [b] * (self.n - 1), np.uint64)) for b in (self.base, pow(self.base, -1, 2**64))]
        return self.table[0][:n], self.table[1][:n]


_random = np.random.default_rng(20240601)
_BYTE = _random.integers(0, 2**64 - 1, 256, np.uint64, endpoint=True)
_INSIDE = np.array([not (x == 32 or 9 <= x <= 13) for x in range(256)])
_MIX = np.uint64(0x9E3779B97F4A7C15)
_IN_WORD, _IN_TEXT = _Powers(0xD1342543DE82EF95), (_Powers(0xAF251AF3B0F025B5), _Powers(0xC6BC279692B5CC83))
#: Bytes of a text whose words are hashed together; bytes of several texts that are.
_BLOCK, TOGETHER = 1 << 20, 1 << 18


def hashed_words(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text (without ASCII white space, A-Z lowered), and how many words each line with words has.

    Sums of random values of the bytes times powers of an odd number, over whole arrays: no step a word.
    """
    h, _, lines = _hashed(b" %b " % (text or "").encode().lower())
    return h, lines


def hashed_texts(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``hashed_words`` gives of many texts, one after the other, and how many words each text has: hashes, words a text, words a line."""
    whole = [x or b"" for x in texts]
    h, first, lines = _hashed(b"\n%b\n" % b"\n".join(whole).lower())
    begin = np.cumsum([1] + [len(x) + 1 for x in whole])
    return h, np.diff(np.searchsorted(first, begin)), lines


def texts_in(column: pa.Array, *more: pa.Array) -> Iterator[tuple[int, list[list[bytes | None]]]]:
    """The column's texts (and those of others, as long) as bytes, in stretches of rows with about ``TOGETHER`` bytes: the first row, and a list a column."""
    columns = [c.cast(pa.large_binary()) for c in (column, *more)]
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False) for c in columns))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
        yield at, [c.slice(at, to - at).to_pylist() for c in columns]
        at = to


def _hashed(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of lowered bytes that begin and end with white space, their first bytes, and how many words each line with words has."""
    raw = np.frombuffer(text, np.uint8)
    inside = _INSIDE.take(raw)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # of a word's first byte, and of the one behind it
    if not len(edges):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    first = edges[0::2]
    parts, at = [], 0
    while at < len(first):
        low = first[at]
        to = max(at + 1, int(np.searchsorted(first, low + _BLOCK)))
        own = edges[2 * at : 2 * to] - low
        power, inverse = _IN_WORD.upto(int(own[-1]) + 1)
        sums = np.add.reduceat(_BYTE.take(raw[low : low + own[-1] + 1]) * power, own)[0::2]
        parts.append(sums * inverse[own[0::2]])
        at = to
    h = parts[0] if len(parts) == 1 else np.concatenate(parts)
    h = (h ^ (h >> np.uint64(32))) * _MIX
    breaks = np.searchsorted(first, np.flatnonzero(raw == 10))
    lines = np.diff(np.concatenate([[0], breaks, [len(first)]]))
    return h ^ (h >> np.uint64(29)), first, lines[lines > 0]


def hashed_ranges(h: np.ndarray, first: np.ndarray | slice, stop: np.ndarray | slice, kind: int = 0) -> np.ndarray:
    """64-bit hashes of the ranges [first, stop) of words, whose hashes are h; two kinds, independent of each other. A slice stands for its numbers."""
    power, inverse = _IN_TEXT[kind].upto(len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum((h if not kind else (h ^ (h >> np.uint64(31))) * _MIX) * power, out=sums[1:])
    own = (sums[stop] - sums[first]) * inverse[first]
    own = (own ^ (own >> np.uint64(32))) * _MIX
    return own ^ (own >> np.uint64(29))


def hashed_windows(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each window of ``width`` words (at least as many as there are)."""
    n = len(h) - width + 1
    return hashed_ranges(h, slice(0, n), slice(width, width + n))


class HashMemo(dict):
    """64-bit hashes of words (str or bytes), remembered up to a bound."""

    def __missing__(self, word: str | bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = self.hash(word)
        return h

    hash = staticmethod(xxhash.xxh3_64_intdigest)


def release(*memos: dict) -> None:
    """At the end of a task: an idle worker keeps no tables, and the freed memory goes back, Arrow's and where the C library can do that."""
    for m in memos:
        m.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
