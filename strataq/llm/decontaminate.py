"""Benchmark decontamination with DataFrame functions only.

Windows of ``width`` normalised words of the benchmark make a hash set. It is
broadcast if its size, which is counted first, is under ``broadcast_rows``;
beyond that the same join is a shuffled one. Windows of the documents probe it
by hash, each hit is verified on the words, and spans or documents go.

Cases: null or wordless texts have no windows and no hits; an item shorter than
``width`` words is one window, compared with windows of its own length; items
and rows may repeat, a doc_id may repeat or be null; an empty benchmark hits nothing; other columns, whatever
their names, are kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii, others, ref, row_key, window_hashes

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
#: Windows of the benchmark up to which their set is broadcast (about 100 bytes each).
BROADCAST_ROWS = 500_000
#: Bits of the table that texts hold their windows' hashes against before anything is joined (16 a window, fewer beyond this).
MOST_BITS = 1 << 20
#: Longest words of the windows up to which texts are told apart by them first.
MARKS = 5_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, *, item: str = "item_id", text: str = "text") -> DataFrame:
    """n_window, words (joined by one blank), hash, items: each different window with the items that it is of."""
    rows = benchmark.select(F.col(item).alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("n_window", F.least(F.size("w"), F.lit(width)))
    at = rows.select("item", "w", "n_window", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n_window") + 1)).alias("i"))
    each = at.select("item", "n_window", F.slice("w", F.col("i"), F.col("n_window")).alias("own"))
    return each.groupBy("n_window", F.array_join("own", " ").alias("words")).agg(F.sort_array(F.collect_set("item")).alias("items"))


def _maybe(own: DataFrame, total: int) -> tuple[Column, int]:
    """An array of 64-bit words with a bit a hash of ``own``, and the mask of a hash's place: at most ``MOST_BITS`` bits, however many windows there are."""
    bits = min(MOST_BITS, max(64, 1 << (16 * total - 1).bit_length()))
    place = F.col("hash").bitwiseAND(F.lit(bits - 1))
    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    found = own.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("block")).agg(F.bit_or(one).alias("set")).collect()  # MOST_BITS / 64 rows at most
    words = [0] * (bits // 64)
    for r in found:
        words[r["block"]] = r["set"]
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>"), bits - 1


def _windows(docs: DataFrame, benchmark: DataFrame, width: int, doc: str, text: str, broadcast_rows: int) -> DataFrame:
    """row (a number of the row, unique), key, doc_id, n_words, hit (null: none), items: a row a document at least, one a hit; what is broadcast is counted first.

    Inside the row a bit table of the windows' hashes leaves the windows of a text that may be theirs; only these become rows, each with its own words.
    """
    windows = benchmark_windows(benchmark, width)
    sizes = {r["n_window"]: r["n"] for r in windows.groupBy("n_window").agg(F.count("*").alias("n")).collect()}  # a row a width, ten at most
    rows = docs.select(F.monotonically_increasing_id().alias("row"), row_key(doc, text).alias("key"), F.col(doc).alias("doc_id"), words_of(F.col(text)).alias("w"))
    rows = rows.withColumn("n_words", F.size("w").cast("long"))
    if not sizes:
        return rows.select("row", "key", "doc_id", "n_words", F.lit(None).cast("struct<i:bigint,n:int>").alias("hit"), F.lit(None).cast("array<bigint>").alias("items"))
    lists = windows.withColumn("list", F.split("words", " "))
    longest = F.array_max(F.transform("list", lambda w: F.struct(F.length(w), w.alias("w"))))["w"]
    marks = [r[0] for r in lists.select(longest).distinct().limit(MARKS + 1).collect()]  # bounded by MARKS
    own = lists.select("n_window", "words", "items", F.coalesce(*[F.when(F.col("n_window") == n, window_hashes(F.col("list"), n)[0]) for n in sorted(sizes)]).alias("hash"))
    table, mask = _maybe(own, sum(sizes.values()))

    def candidates(n: int, bits: Column) -> Column:
        def may(h: Column) -> Column:
            place = h.bitwiseAND(F.lit(mask))
            return F.getbit(F.get(bits, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1

        def some(hashes: Column) -> Column:
            at = F.array_compact(F.transform(hashes, lambda h, i: F.when(may(h), i)))
            return F.transform(at, lambda i: F.struct(F.lit(n).alias("n"), i.cast("long").alias("i"), F.get(hashes, i).alias("hash"), F.array_join(F.slice("w", i + 1, n), " ").alias("words")))

        return let(window_hashes(F.col("w"), n), some)

    found = let(table, lambda bits: F.concat(*[candidates(n, bits) for n in sorted(sizes)]))
    if len(marks) <= MARKS:
        # a text with none of the windows' longest words holds no window: its windows needn't be hashed
        found = F.when(F.arrays_overlap("w", F.array(*[F.lit(m) for m in marks])), found)
    probes = rows.select("row", "key", "doc_id", "n_words", found.alias("found")).select("row", "key", "doc_id", "n_words", F.explode_outer("found").alias("x"))
    # documents without such windows have no hash; their own row numbers deal them evenly in a shuffled join
    probes = probes.withColumn("at", F.coalesce("x.hash", "row")).withColumn("wide", F.coalesce("x.n", F.lit(0)))
    own = F.broadcast(own) if sum(sizes.values()) <= broadcast_rows else own
    met = probes.join(own, (F.col("at") == F.col("hash")) & (F.col("wide") == F.col("n_window")) & (F.col("x.words") == F.col("words")), "left")
    hit = F.struct(F.col("x.i").alias("i"), F.col("x.n").alias("n"))
    return met.select("row", "key", "doc_id", "n_words", F.when(F.col("words").isNotNull(), hit).alias("hit"), "items")


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, *, doc: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, items (that have a window in it), hits (sorted array of struct(i, n): first word and words), key: a row a document.

    One scan; a task holds whole documents, so that its partial aggregation leaves a row a document to shuffle.
    """
    found = _windows(docs, benchmark, width, doc, text, broadcast_rows)
    rows = found.groupBy("row", "key", "doc_id", "n_words").agg(F.sort_array(F.collect_set("hit")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return rows.select("doc_id", "n_words", hit_words(F.col("hits")).alias("n_hit"), "items", "hits", "key")


def hit_words(hits: Column) -> Column:
    """How many words the runs [i, i + n) cover together; hits: sorted."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(s: Column, h: Column) -> Column:
        stop = h["i"] + h["n"]
        return F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), stop - F.greatest(s["end"], h["i"]))).alias("n"), F.greatest(s["end"], stop).alias("end"))

    return F.aggregate(hits, start, step, lambda s: s["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, *, doc: str = "doc_id", text: str = "text", remove: str = "documents") -> DataFrame:
    """docs without contaminated documents, or (``remove="spans"``) without the words hit; the words left are joined by one blank in texts with hits, other texts stay as they are."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove: documents or spans")
    found = report(docs, benchmark, width, doc=doc, text=text).where("n_hit > 0").groupBy("key").agg(F.first("hits").alias("hits"))
    tagged = docs.select(F.struct(*others(docs)).alias("row"), ref(text).alias("text"), row_key(doc, text).alias("key"))
    if remove == "documents":
        return tagged.join(found.select("key"), "key", "left_anti").select("row.*")
    gone = F.flatten(F.transform("hits", lambda h: F.sequence(h["i"], h["i"] + h["n"] - 1)))
    both = tagged.join(found.select("key", F.array_distinct(gone).alias("gone")), "key", "left")
    left = let(words_of(F.col("text")), lambda w: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0).cast("long"), F.size(w).cast("long") - 1), F.col("gone")), lambda i: F.get(w, i.cast("int"))), " "))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    both = both.select("row", kept.alias("text"))
    return both.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
