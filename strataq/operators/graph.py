"""Closures and greedy selection over links, in rounds of joins: no group is held by one task.

A node is an id under some keys (a box on a page). Rounds are written to the
shared folder, so that a lost executor doesn't lose them, and deleted when the
next one is there. Only counts and sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import drop, stored

#: Links that a task has before it contracts them.
HELD = 1 << 18


def _contracted(columns: list[np.ndarray]) -> list[np.ndarray]:
    """keys, u, v (v < u) from keys, a, b: at most one link a node, with the least node that it reaches."""
    *keys, a, z = columns
    ids, node = np.unique(np.concatenate([a, z]), return_inverse=True)
    group = np.zeros(len(a), np.int64)
    for k in keys:
        different, own = np.unique(k, return_inverse=True)
        group = np.unique(group * len(different) + own, return_inverse=True)[1]
    # places of nodes in the order of their ids, so that the least place is the least id of a group
    own, first, at = np.unique(np.concatenate([group, group]) * len(ids) + node, return_index=True, return_inverse=True)
    x, y, least = at[: len(a)], at[len(a) :], np.arange(len(own))
    while True:
        low = np.minimum(least[x], least[y])
        new = least.copy()
        np.minimum.at(new, least[x], low)
        np.minimum.at(new, least[y], low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    on = np.flatnonzero(least != np.arange(len(own)))
    row, id_of = first[on] % max(1, len(a)), own % max(1, len(ids))
    return [*(k[row] for k in keys), ids[id_of[on]], ids[id_of[least[on]]]]


def _forest(links: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, u, v (v < u): fewer links that join the same nodes; where a task sees all links of its pages, each node with the least one reachable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        out = lambda own: pa.RecordBatch.from_arrays([pa.array(c) for c in own], [*keys, "u", "v"])
        for b in batches:
            held.append([np.asarray(c) for c in b.columns])
            size += b.num_rows
            if size >= HELD:
                own = _contracted([np.concatenate(c) for c in zip(*held)])
                held, size = [own], len(own[0])
                if size >= HELD // 2:
                    yield out(own)
                    held, size = [], 0
        if held:
            yield out(_contracted([np.concatenate(c) for c in zip(*held)]))

    schema = ", ".join(f"{k} {links.schema[k].dataType.simpleString()}" for k in keys) + ", u long, v long"
    return links.select(*keys, F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, schema.lstrip(", "))


def _are_stars(edges: DataFrame, keys: tuple[str, ...]) -> bool:
    """No node hangs on two others, and none that others hang on hangs itself."""
    twice = edges.groupBy(*keys, "u").agg(F.count("*").alias("n")).where("n > 1").select(*keys, "u")
    between = edges.select(*keys, F.col("v").alias("u")).join(edges, [*keys, "u"], "left_semi")
    return twice.unionByName(between).isEmpty()


def components(links: DataFrame, *keys: str) -> DataFrame:
    """keys, id, component (the least id reachable), of every node that has a link; links: keys (numbers, not null), a, b.

    Links of the same keys are brought near each other and contracted as they stream by; what isn't closed by that goes on
    in large and small stars in turn, by minima that are aggregated before they are shuffled. A task holds a bounded number
    of links, so that a page may have any number.
    """
    near = links.where("a != b").repartition(*keys) if keys else links.where("a != b")
    edges = stored(_forest(near, keys).distinct())
    while not _are_stars(edges, keys):
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).select(*keys, "u", F.least("u", "m").alias("m"))
        large = both.join(least, [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [*keys, "u"]).where("v != m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, stored(small.unionByName(least.select(*keys, "u", F.col("m").alias("v"))).distinct())
        drop(old)
    return edges.select(*keys, F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(*keys, F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def beaten(conflicts: DataFrame, *keys: str) -> DataFrame:
    """keys, id of the nodes that a greedy choice leaves out; conflicts: keys, low, high (the node that is looked at earlier; of any type that can be joined).

    A node is chosen when no earlier neighbour is chosen. In a round the nodes without an undecided earlier neighbour are
    chosen and their neighbours go; that is the sequential answer, in as many rounds as decisions hang on one another.
    """
    edges = stored(conflicts.select(*keys, "low", "high").distinct())
    gone = None
    while not edges.isEmpty():
        waiting = edges.select(*keys, F.col("low").alias("high")).distinct()
        out = stored(edges.join(waiting, [*keys, "high"], "left_anti").select(*keys, F.col("low").alias("id")).distinct())
        rest = edges.join(out.withColumnRenamed("id", "low"), [*keys, "low"], "left_anti").join(out.withColumnRenamed("id", "high"), [*keys, "high"], "left_anti")
        old, edges = edges, stored(rest.select(*keys, "low", "high"))
        drop(old)
        gone = out if gone is None else gone.unionByName(out)
    return edges.select(*keys, F.col("low").alias("id")) if gone is None else gone
