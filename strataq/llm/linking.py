"""Links between sets that meet under shared keys, without all pairs of a group.

A node has some keys. First each node of a key is held against the key's first
node, and linked ones make components. Where nodes of a key are in different
components still, every pair of such nodes that could be linked is held against
each other. Of keys with few nodes these are all pairs that are plausible; of
others, pairs that share one of their rarest shingles (an exact prefix filter,
in the order of frequency among these nodes), early enough in that order that
what follows could suffice, without those that the triangle inequality of the
Jaccard distance rules out (distances to a node that both were held against are
known by then). So pairs grow with the members of a group, and no link that
could join two components is lost. Texts are fetched of the nodes that need it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, release, texts_in, written
from .components import components

#: From texts, all different shingles, sorted; the places there of each text's own, sorted, one text after the other; how many each has.
Sets = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: Nodes up to which a shingle is rare.
RARE = 1_000
#: Shingles, the first in the order, by which repetitions of a pair are known early.
FIRST = 10


def shared_keys(keys: DataFrame) -> DataFrame:
    """key, rep, pivot (the first node of the key): only keys that several nodes have, from (key, rep) or (key, rep, ord).

    Nodes come in the order of ord, if there is one; those of an equal ord needn't meet each other. Where the first is
    what the others were copied from, it is nearer to each of them than they are to one another, and leaves few apart.

    What is shuffled is a key and two longs, aggregated partially; long nodes stand for themselves, others are told apart by 40 bits of a hash.
    """
    own = F.col("ord") if "ord" in keys.columns else F.col("rep") if keys.schema["rep"].dataType.simpleString() == "bigint" else F.shiftrightunsigned(F.xxhash64("rep"), 24)
    shared = keys.groupBy("key").agg(F.min(own).alias("least"), F.max(own).alias("most")).where("least != most").select("key", "least")
    shared = written(shared, "shared")
    met = written(keys.join(shared, "key").distinct(), "met")
    pivots = met.where(own == F.col("least")).select("key", F.col("rep").alias("pivot")).dropDuplicates(["key"])
    out = written(met.select("key", "rep").join(pivots, "key"), "pivots")
    drop_written(shared, met)
    return out


def sizes_of(p: list[bytes], q: list[bytes], shingles: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of intersection and union of the sets of p[0] and q[0], p[1] and q[1] and so on; a text that occurs again is taken apart once."""
    place: dict[bytes, int] = {}
    a, b = (np.array([place.setdefault(x, len(place)) for x in own]) for own in (p, q))
    every, rank, sizes = shingles(list(place))
    table = np.repeat(np.arange(len(sizes)), sizes) * len(every) + rank  # ascends, as each set does
    a, b = np.where(sizes[a] <= sizes[b], a, b), np.where(sizes[a] <= sizes[b], b, a)
    n = sizes[a]
    ends = np.cumsum(n)
    own = table[np.arange(n.sum()) + np.repeat((np.cumsum(sizes) - sizes)[a] - ends + n, n)]
    sought = own + np.repeat((b - a) * len(every), n)
    at = np.searchsorted(table, sought)
    at[at == len(table)] = 0
    hits = np.append(0, np.cumsum(table[at] == sought))
    common = hits[ends] - hits[ends - n]
    return common, n + sizes[b] - common


def confirm(pairs: DataFrame, texts: DataFrame, shingles: Sets) -> DataFrame:
    """a, b, common, either: sizes of intersection and union of the full sets of each pair.

    The smaller rows (pairs) are dealt by ``a``, which may be hot, and then by ``b`` with the text of ``a``.
    """
    first = pairs.select("a", "b").join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sizes_of(x, y, shingles) for _, (x, y) in texts_in(batch.column(2), batch.column(3))]
            common, either = (pa.array(np.concatenate(x)) for x in zip(*found)) if found else (pa.array([], pa.int64()),) * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), common, either], ["a", "b", "common", "either"])
        release()

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}, common long, either long")


def _rarest(nodes: DataFrame, texts: DataFrame, shingles: Sets, percent: int) -> DataFrame:
    """rep, x, rare, first (the first of the rare ones or of the others, as x is), n_rare, n_often, after (how many of the node's shingles follow x in the order): of each node's shingles the rarest among ``nodes``, so many that two linked nodes share one of them.

    Sets with a similarity of t have ceil(t n) of n shingles in common at least, so that the first n - ceil(t n) + 1 of
    each in one order for all share one. Rare ones first, a passage that many texts share brings none of them together.
    Shingles that a single node has come first of all; they are counted, and go no further.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, (own,) in texts_in(b.column(1)):
                every, rank, sizes = shingles(own)
                at = np.repeat(np.arange(first, first + len(own)), sizes)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(every[rank].view(np.int64))], ["rep", "x"])
        release()

    kind = nodes.schema["rep"].dataType.simpleString()
    rows = written(texts.join(nodes, "rep", "left_semi").select("rep", "text").mapInArrow(run, f"rep {kind}, x long"), "shingles")
    often = written(rows.groupBy("x").agg(F.count("*").alias("n")).where("n > 1"), "often")  # one that a single node has brings nothing together
    sizes = rows.groupBy("rep").agg(F.count("*").cast("int").alias("size"))
    ranked = rows.join(often, "x").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("own")).join(sizes, "rep")
    single = F.col("size") - F.size("own")
    first = F.col("size") - F.ceil(F.col("size") * F.lit(percent) / 100).cast("int") + 1 - single
    n_often = F.size(F.filter("own", lambda s: s["n"] > RARE))
    each = ranked.select("rep", (F.col("size") - n_often).alias("n_rare"), n_often.alias("n_often"), F.size("own").alias("n_own"), F.slice("own", F.lit(1), F.greatest(first, F.lit(0))).alias("first"))
    each = each.select("*", F.posexplode("first").alias("at", "s"))
    each = each.select("rep", F.col("s.x").alias("x"), (F.col("s.n") <= RARE).alias("rare"), F.slice(F.transform(F.filter("first", lambda s: (s["n"] <= RARE) == (F.col("s.n") <= RARE)), lambda s: s["x"]), 1, FIRST).alias("first"), "n_rare", "n_often", (F.col("n_own") - F.col("at") - 1).alias("after"))
    out = written(each, "rarest")
    drop_written(rows, often)
    return out


def link(met: DataFrame, traits: DataFrame, texts: Callable[[DataFrame], DataFrame], shingles: Sets, plausible: Callable[[str, str], Column], percent: int, direct: int = 0) -> DataFrame:
    """node, component of the nodes that have a link.

    met: of ``shared_keys``. traits: rep and the columns that ``plausible(alias, alias)`` needs; it is true of all links.
    texts: gives rep and text of nodes in met (a table of rep), of others too if it likes; ``shingles`` makes the sets of
    many of them. direct: nodes up to which all pairs of a key are tried by their traits; 0 if those say little.
    """
    linked = lambda t: t.where(f"100 * common >= {percent} * either").select("a", "b")
    ends = lambda t: t.select(F.col("a").alias("rep")).unionByName(t.select(F.col("b").alias("rep")))

    def near_ones(pairs: DataFrame) -> DataFrame:
        near = pairs.join(traits.alias("p"), F.col("a") == F.col("p.rep")).join(traits.alias("q"), F.col("b") == F.col("q.rep")).where(plausible("p", "q")).select("a", "b")
        return written(near, "near")

    close = near_ones(met.where("rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct())
    to_pivot = written(confirm(close, texts(ends(close).distinct()), shingles), "confirmed")
    links = linked(to_pivot)
    found = components(links)
    named = met.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "pivot", F.coalesce("component", "rep").alias("component"))
    named = written(named, "named")
    split = named.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n")).where("least != most and n > 2").select("key", "n")
    split = written(split, "split")
    apart = written(named.join(split.where(F.col("n") > direct), "key").select("rep", "component").distinct(), "apart")
    beside = close.limit(0)
    if direct:
        few = named.where("rep != pivot").join(split.where(F.col("n") <= direct), "key")  # all were held against the pivot
        beside = few.alias("p").join(few.alias("q"), "key").where("p.rep < q.rep and p.component != q.component").select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b"))
        beside = near_ones(beside.distinct())
    tried = [beside] if direct else []
    drop_written(named, split)
    if apart.isEmpty() and beside.isEmpty():
        drop_written(close, to_pivot, apart, *tried)
        return found
    own = texts(ends(beside).unionByName(apart.select("rep")).distinct())
    pairs = _pairs(apart, to_pivot, own, shingles, percent)
    rest = near_ones(pairs)
    last = written(confirm(beside.unionByName(rest).distinct() if direct else rest, own, shingles), "confirmed")
    more = linked(last)
    out = found if more.isEmpty() else components(links.unionByName(more))
    drop_written(close, apart, pairs, rest, to_pivot, last, *tried)
    return out


def _pairs(apart: DataFrame, to_pivot: DataFrame, texts: DataFrame, shingles: Sets, percent: int) -> DataFrame:
    """a, b: pairs of nodes apart, of which each has its component, that could be linked; to_pivot: sizes of intersection and union of b's and its pivot's sets."""
    # distance to one node that others were held against too
    to_first = to_pivot.select(F.col("b").alias("rep"), F.struct(F.col("a").alias("pivot"), (1 - F.col("common") / F.col("either")).alias("d")).alias("to"))
    itself = to_pivot.select(F.col("a").alias("rep"), F.struct(F.col("a").alias("pivot"), F.lit(0.0).alias("d")).alias("to"))
    near = to_first.unionByName(itself).groupBy("rep").agg(F.min("to").alias("to"))
    rarest = _rarest(apart.select("rep"), texts, shingles, percent)
    kept = written(rarest.join(apart, "rep").join(near, "rep", "left"), "rest")
    drop_written(rarest)
    # what isn't rare meets only where its nodes could have enough in common at all, and by how many such shingles they
    # have: of linked nodes neither number exceeds the other by more than the similarity allows, so the logarithms' whole
    # parts differ by one at most (the base is a little larger, so that rounding can't part them)
    able = F.col("rare") | (100 * F.col("n_often") >= percent * (F.col("n_often") + F.col("n_rare")))
    size = F.when(F.col("rare"), 0).otherwise(F.floor(F.log(F.col("n_often").cast("double")) / (math.log(100 / percent) + 1e-6)))
    own = kept.where(able).withColumn("size", size.cast("long"))
    around = F.when(F.col("rare"), F.array("size")).otherwise(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))
    p, q = own.alias("p"), own.withColumn("size", F.explode(around)).alias("q")
    ruled_out = F.coalesce((F.col("p.to.pivot") == F.col("q.to.pivot")) & (F.abs(F.col("p.to.d") - F.col("q.to.d")) > 1 - percent / 100 + 1e-9), F.lit(False))
    # the first shingle that two nodes share brings them together; if it isn't rare, they share no rare one, so that
    # their intersection is made of the others and their union holds all rare ones of both
    least, most = F.least("p.n_often", "q.n_often"), F.greatest("p.n_often", "q.n_often")
    enough = F.col("p.rare") | (100 * least >= percent * (most + F.col("p.n_rare") + F.col("q.n_rare")))
    # whatever else they share follows the first in the order of both
    sizes = F.col("p.n_rare") + F.col("p.n_often") + F.col("q.n_rare") + F.col("q.n_often")
    enough &= (100 + percent) * (1 + F.least("p.after", "q.after")) >= percent * sizes
    once = F.coalesce(F.get(F.array_intersect("p.first", "q.first"), F.lit(0)) == F.col("p.x"), F.lit(True))  # spares most repetitions of a pair
    rest = p.join(q, (F.col("p.x") == F.col("q.x")) & (F.col("p.size") == F.col("q.size")) & (F.col("p.rep") < F.col("q.rep")) & (F.col("p.component") != F.col("q.component")) & enough & ~ruled_out & once)
    out = written(rest.select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b")).distinct(), "pairs")
    drop_written(kept)
    return out
