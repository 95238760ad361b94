"""Source divergence audit by integer-dictionary encoding.

Which sources of a language use its words unlike the others, and which words
mark a source. Terms are counted once a (language, source, term), first within
batches and tasks. Counts are dealt by a hash of language and term into chunks
of about ``CHUNK`` counts, so that no language and no source is in one task. A
chunk keeps the terms that occur in enough documents as sorted arrays, one a
language, so that a term's id is its place there (by searchsorted) and ids have
the order of UTF-8. Chunks are written as such arrays of ids and counts; sums
over them give each group's N and each language's V. Then each chunk is read
once more: bincount makes a dense vector a group, from which exact integer
divergences follow, summed a pair of sources over all chunks, and each chunk's
best terms a source, in the order of value and id, go on to one ranking. What
one task holds is a chunk and one row a source of its language.

Cases: null text, lang and source are empty ones; doc_id isn't looked at, so
rows that repeat are documents of their own; empty texts have no terms, but their
groups take part; a language that keeps no term gives pairs of value 0 and no
terms; equal values are ranked by item in the order of UTF-8; other columns are
left out whatever their names; a very long text is taken apart a block at a time;
an empty table gives an empty report.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, ref, release, texts_in, written

#: Documents of a language that a kept term has, at least; best terms a source that are reported.
LEAST_DOCS, BEST = 3, 200
#: Counts a chunk has, about; numbers of a dense block; counts that a task holds before it sends them on; groups that are broadcast.
CHUNK, DENSE, HELD, BROADCAST = 1 << 17, 1 << 20, 200_000, 50_000
_BLOCK = 1 << 20
#: Bytes of terms as they are, A-Z lowered; all others are spaces.
_TERM_BYTES = bytes(x + 32 if 0x41 <= x <= 0x5A else x if 0x61 <= x <= 0x7A or x >= 0x80 else 0x20 for x in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, a block at a time."""
    at = 0
    while at < len(text):
        end = min(len(text), at + _BLOCK)
        while end < len(text) and _TERM_BYTES[text[end]] != 0x20:  # not inside a term
            end += 1
        yield text[at:end].translate(_TERM_BYTES).split()
        at = end


def term_counts(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it)."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = {}
        in_docs: dict[tuple[str, str], Counter] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (own_lang, own_source), own in n.items():
                size = len(own)
                columns = [pa.repeat(own_lang, size), pa.repeat(own_source, size), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64()), pa.array([in_docs[own_lang, own_source][t] for t in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)
            n.clear()
            in_docs.clear()

        for b in batches:
            for first, (own,) in texts_in(b.column(2)):
                groups = zip(b.column(0).slice(first, len(own)).to_pylist(), b.column(1).slice(first, len(own)).to_pylist())
                for group, x in zip(groups, own):
                    if group not in n:
                        n[group], in_docs[group] = Counter(), Counter()
                    count, different = n[group], set()
                    was = len(count)
                    for words in terms_of(x or b""):
                        count.update(words)
                        different.update(words)
                    in_docs[group].update(different)
                    held += len(count) - was
                    if held >= HELD:
                        yield from out()
                        held = 0
        yield from out()
        release()

    own = docs.select(F.coalesce(ref(lang).cast("string"), F.lit("")), F.coalesce(ref(source).cast("string"), F.lit("")), ref(text))
    found = own.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _encoded(counts: DataFrame, least_docs: int, chunk: int) -> DataFrame:
    """lang, terms (sorted), groups: a row a chunk and language in it that keeps a term; groups: source with ids and counts of its terms."""
    chunks = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // chunk))
    dealt = counts.withColumn("chunk", F.pmod(F.xxhash64("lang", "term"), F.lit(chunks)).cast("int"))
    kind = "lang string, terms array<binary>, groups array<struct<source:string,ids:array<int>,counts:array<bigint>>>"
    groups_type = pa.list_(pa.struct([("source", pa.string()), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]))

    def of_lang(term: pa.Array, source: pa.Array, n: np.ndarray, docs: np.ndarray) -> tuple[list[bytes], list[dict]]:
        encoded = term.dictionary_encode()
        own, at = np.array([*encoded.dictionary.to_pylist(), None], object)[:-1], encoded.indices.to_numpy()
        enough = np.bincount(at, docs, len(own)) >= least_docs
        kept = np.sort(own[enough])  # as bytes are
        ids = np.full(len(own), -1, np.int32)
        ids[enough] = np.searchsorted(kept, own[enough])
        stay = np.flatnonzero(enough[at])
        sources = source.take(pa.array(stay)).dictionary_encode()
        order = np.argsort(sources.indices.to_numpy(), kind="stable")
        ends = np.cumsum(np.bincount(sources.indices.to_numpy(), minlength=len(sources.dictionary)))[:-1]
        each = zip(sources.dictionary.to_pylist(), np.split(ids[at[stay]][order], ends), np.split(n[stay][order], ends))
        return list(kept), [{"source": s, "ids": i, "counts": c} for s, i, c in each] if len(kept) else []

    def encode(rows: pa.Table) -> pa.Table:
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        whose, found = langs.indices.to_numpy(), {}
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            some = rows.take(pa.array(np.flatnonzero(whose == k)))
            term, source, n, docs = (some.column(c).combine_chunks() for c in ("term", "source", "n", "docs"))
            found[lang] = of_lang(term, source, n.to_numpy(), docs.to_numpy())
        found = {lang: x for lang, x in found.items() if x[0]}
        return pa.table({"lang": pa.array(list(found), pa.string()), "terms": pa.array([x[0] for x in found.values()], pa.list_(pa.binary())), "groups": pa.array([x[1] for x in found.values()], groups_type)})

    return dealt.groupBy("chunk").applyInArrow(encode, kind)


def share(count: np.ndarray, n: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 (count + 1) / n) by long division, three digits at a time: the product may exceed 64 bits; count < n < 2**53."""
    out, rest = np.zeros(np.broadcast(count, n).shape, np.int64), count + 1
    for _ in range(3):
        out, rest = out * 1_000 + rest * 1_000 // n, rest * 1_000 % n
    return 1 + out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / q); both are at most 1 + 10**9, so that nothing exceeds 64 bits."""
    return (p - q) * (p - q) // q


def audit(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, best: int = BEST, chunk: int = CHUNK) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: how far each source is from each other of its language, and the terms it has more of than the language."""
    counts = written(term_counts(docs, lang=lang, source=source, text=text), "counts")
    encoded = written(_encoded(counts, least_docs, chunk), "encoded")
    groups = docs.select(F.coalesce(ref(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(ref(source).cast("string"), F.lit("")).alias("source")).distinct()
    each = encoded.select("lang", F.explode("groups").alias("g")).select("lang", "g.source", F.aggregate("g.counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    n = each.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = written(groups.join(n, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "groups")
    drop_written(counts)
    kept = encoded.groupBy("lang").agg(F.sum(F.size("terms").cast("long")).alias("v"))
    totals = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("all")).join(kept, "lang")
    met = encoded.join(F.broadcast(totals) if groups.count() <= BROADCAST else totals, "lang").select("lang", "terms", "groups", "all", "v")
    names = ["lang", "source", "part", "item", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                own_lang, v = b.column(0)[r].as_py(), b.column(4)[r].as_py()
                terms, every = b.column(1)[r].values, b.column(3)[r].values
                sources, n = every.field(0), every.field(1).to_numpy()
                total = (n + v)[:, None]
                place = {s: i for i, s in enumerate(sources.to_pylist())}
                own = b.column(2)[r].values
                ids, own_counts = own.field(1), own.field(2)
                sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
                whose = np.repeat([place[s] for s in own.field(0).to_pylist()], sizes)
                ids, own_counts = ids.flatten().to_numpy(), own_counts.flatten().to_numpy()
                order = np.argsort(ids, kind="stable")
                ids, own_counts, whose = ids[order], own_counts[order], whose[order]
                apart = np.zeros((len(n), len(n)), np.int64)
                marks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                step = max(1, DENSE // len(n))
                for low in range(0, len(terms), step):  # a block of ids, dense a group
                    wide = min(step, len(terms) - low)
                    here = slice(*np.searchsorted(ids, [low, low + wide]))
                    count = np.zeros((len(n), wide), np.int64)
                    count.ravel()[whose[here] * wide + ids[here] - low] = own_counts[here]  # a source and term has one count
                    p, q = share(count, total), share(count.sum(0), np.int64(n.sum() + v))
                    for i in range(len(n)):
                        apart[i] += divergence(p[i], p).sum(1)
                    for i in range(len(n)):
                        more = np.flatnonzero((count[i] > 0) & (p[i] > q))
                        value = divergence(p[i][more], q[more])
                        first = np.argsort(-value, kind="stable")[:best]  # of equal values the lesser id
                        marks.append((np.full(len(first), i), more[first] + low, value[first]))
                to = ~np.eye(len(n), dtype=bool)
                p, q = np.nonzero(to)
                yield pa.RecordBatch.from_arrays([pa.repeat(own_lang, len(p)), sources.take(pa.array(p)), pa.repeat("pair", len(p)), sources.take(pa.array(q)).cast(pa.binary()), pa.array(apart[to])], names)
                p, t, value = (np.concatenate(x) for x in zip(*marks))
                yield pa.RecordBatch.from_arrays([pa.repeat(own_lang, len(p)), sources.take(pa.array(p)), pa.repeat("term", len(p)), terms.take(pa.array(t)), pa.array(value)], names)
        release()

    found = written(met.mapInArrow(run, "lang string, source string, part string, item binary, value long"), "found")
    # all pairs of sources of a language are what is asked for
    ordered = groups.alias("a").join(groups.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source"))).select("a.lang", "a.source", F.lit("pair").alias("part"), F.col("b.source").alias("item"))
    sums = found.where("part = 'pair'").groupBy("lang", "source", F.col("item").cast("string").alias("item")).agg(F.sum("value").alias("value"))
    pairs = ordered.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "part", "item", F.coalesce("value", F.lit(0)).alias("value"))
    terms = found.where("part = 'term'").withColumn("item", F.col("item").cast("string"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= best))
