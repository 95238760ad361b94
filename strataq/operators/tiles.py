"""Components of boxes that are linked by where they lie: pairs are found and closed in one step.

Boxes are dealt to tiles of their page, a tile's boxes are paired and closed in
whole arrays, and a row a box is all that is written: no pair is. Pages that fit in
one tile are done with that; on wider ones a box names its part of each tile that it
lies in, and these links are closed in rounds (``graph``).

Cases: boxes of one id on a page are one node; boxes with a null side are linked
with nothing; those without a page or an id are left as they are; a tile of any
number of boxes is looked at from above to below, some of it at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import graph
from .cut import stored

SIDES = ("x0", "y0", "x1", "y1")
#: Pixels of a tile's side and of a strip's height; boxes that a task has before it solves the tiles among them, and pairs that it looks at together.
TILE, STRIP, HELD, PAIRS = 4096, 256, 1 << 17, 1 << 20
#: In place of a null side: it is neither least nor greatest.
NONE = 1 << 60

#: Which of two boxes (four arrays each: x0, y0, x1, y1) are linked.
Linked = Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray]


def touching(a: list[np.ndarray], b: list[np.ndarray], tolerance: int) -> np.ndarray:
    """``geometry.touches`` of arrays."""
    return (a[0] < b[2] + tolerance) & (b[0] < a[2] + tolerance) & (a[1] < b[3] + tolerance) & (b[1] < a[3] + tolerance)


def absorbing(a: list[np.ndarray], b: list[np.ndarray], margin: int, overlap: float) -> np.ndarray:
    """One contains the other, or they share enough of the smaller one: as ``boxes.absorb_pairs``."""
    within = lambda p, q: (q[0] >= p[0] - margin) & (q[1] >= p[1] - margin) & (q[2] <= p[2] + margin) & (q[3] <= p[3] + margin)
    side = lambda p, i: np.maximum(0, p[i + 2] - p[i])
    shared = np.maximum(0, np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])) * np.maximum(0, np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]))
    least = np.maximum(1, np.minimum(side(a, 0) * side(a, 1), side(b, 0) * side(b, 1)))
    return within(a, b) | within(b, a) | (shared / least >= overlap)


def _close(least: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the groups of x and y, pair by pair; least: of each node the least one of its group."""
    while True:
        a, b = least[x], least[y]
        on = np.flatnonzero(a != b)
        if not len(on):
            return
        x, y, a, b = x[on], y[on], a[on], b[on]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(new := least[least], least):
            least[:] = new


def _labels(tile: np.ndarray, node: np.ndarray, box: list[np.ndarray], tx: np.ndarray, ty: np.ndarray, linked: Linked, reach: int) -> np.ndarray:
    """Of each box the least node of its group; nodes are numbered by tile and id."""
    least = np.arange(int(node.max(initial=-1)) + 1)
    on = np.flatnonzero(np.all([np.abs(s) < NONE for s in box], axis=0))
    if not len(on):
        return least[node]
    left, top = tx[on] * TILE, ty[on] * TILE
    place = lambda v, edge: np.clip(v - edge, 0, TILE - 1)
    x0, y0, x1, y1 = (box[i][on] for i in range(4))
    low, high = place(x0, left), place(np.maximum(x0, x1) + reach, left)
    first, last = place(y0, top) // STRIP, place(np.maximum(y0, y1) + reach, top) // STRIP
    n = last - first + 1
    of = np.repeat(np.arange(len(on)), n)
    strip = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    line = (tile[on][of] * (TILE // STRIP) + strip) * (2 * TILE)  # strips lie apart on the line, so that none reaches the next one
    start = line + low[of]
    order = np.argsort(start, kind="stable")
    start, of, line = start[order], of[order], line[order]
    n = np.searchsorted(start, line + high[of], "right") - np.arange(len(of)) - 1
    ends = np.cumsum(n)
    at = 0
    while at < len(of):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        for a, b in _paired(at, to, n):
            p, q = on[of[a]], on[of[b]]
            met = np.flatnonzero((node[p] != node[q]) & linked([s[p] for s in box], [s[q] for s in box]))
            _close(least, node[p[met]], node[q[met]])
        at = to
    return least[node]


def _paired(at: int, to: int, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs: each from at to to with the n that follow it."""
    m = n[at:to]
    if to == at + 1:
        for k in range(0, int(m[0]), PAIRS):
            b = np.arange(at + 1 + k, at + 1 + min(k + PAIRS, int(m[0])))
            yield np.full(len(b), at), b
        return
    a = np.repeat(np.arange(at, to), m)
    yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)


def _solved(batches: Iterator[pa.RecordBatch], linked: Linked, reach: int, merged: bool, page_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """From boxes sorted by page, tile and y0: a row a box and tile (page, id, label: an id that it is linked with, the least of the tile); merged: and a row a label (id is null) with the box around its boxes.

    home: it is the box's first row; wide: the page isn't done with this tile.
    """

    def solved(c: list[np.ndarray], part: bool, again: int) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        page, ty, tx, several, id_, *box = c
        new = np.concatenate([[True], (page[1:] != page[:-1]) | (ty[1:] != ty[:-1]) | (tx[1:] != tx[:-1])])
        tile = np.cumsum(new) - 1
        order = np.lexsort((id_, tile))
        fresh = np.concatenate([[True], (tile[order][1:] != tile[order][:-1]) | (id_[order][1:] != id_[order][:-1])])
        node = np.empty(len(order), np.int64)
        node[order] = np.cumsum(fresh) - 1
        label = _labels(tile, node, box, tx, ty, linked, reach)
        least = id_[order][fresh][label]
        wide = part | (several != 0) | (tx != 0) | (ty != 0)
        home = (several != 2) & (np.arange(len(order)) >= again)
        rows = [pa.array(page, page_type), pa.array(id_), pa.array(least), pa.array(home), pa.array(wide)]
        if merged:
            by = np.argsort(label, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], label[by][1:] != label[by][:-1]]))
            around = [f.reduceat(s[by], first) for f, s in zip((np.minimum, np.minimum, np.maximum, np.maximum), box)]
            one = by[first]
            no = pa.nulls(len(by), pa.int64())
            own = [pa.array(page[one], page_type), pa.nulls(len(one), pa.int64()), pa.array(least[one]), pa.array(np.ones(len(one), bool)), pa.array(wide[one])]
            rows = [pa.concat_arrays([x, y]) for x, y in zip([*rows, no, no, no, no], [*own, *(pa.array(s, mask=np.abs(s) >= NONE) for s in around)])]
        return pa.RecordBatch.from_arrays(rows, ["page", "id", "label", "home", "wide", *(SIDES if merged else ())]), label, tile

    held: list[list[np.ndarray]] = []
    size, again, most = 0, 0, HELD
    for b in batches:
        if not b.num_rows:
            continue
        held.append([np.asarray(c) for c in b.columns])
        size += b.num_rows
        if size < most:
            continue
        c = [np.concatenate(x) for x in zip(*held)]
        end = int(np.flatnonzero((c[0] != c[0][-1]) | (c[1] != c[1][-1]) | (c[2] != c[2][-1])).max(initial=-1)) + 1  # the last tile may go on
        if end:
            yield solved([x[:end] for x in c], again > 0, again)[0]
            again = 0
        rest = [x[end:] for x in c]
        if len(rest[0]) >= HELD // 2:
            # a tile of many boxes: what ends above the boxes to come is done, of boxes at one place a row a group goes on
            out, label, _ = solved(rest, True, again)
            yield out
            box = rest[5:]
            known = np.all([np.abs(s) < NONE for s in box], axis=0)
            below = np.flatnonzero(known & (np.maximum(box[1], box[3]) + reach >= box[1][known].max(initial=-NONE)))
            below = below[np.unique(np.stack([label[below], *(s[below] for s in box)]), axis=1, return_index=True)[1]]
            rest = [x[below] for x in rest]
            again = len(below)
        held, size = [rest], len(rest[0])
        most = max(HELD, 2 * size)
    if size > again:
        yield solved([np.concatenate(x) for x in zip(*held)], again > 0, again)[0]


def _parts(boxes: DataFrame, linked: Linked, reach: int, merged: bool) -> DataFrame:
    """The rows of ``_solved``, stored."""
    long = lambda c: F.col(c).cast("long")
    tile = lambda low, high: F.sequence(F.coalesce(F.floor(low / TILE), F.lit(0).cast("long")), F.coalesce(F.floor((F.greatest(low, high) + reach) / TILE), F.floor(low / TILE), F.lit(0).cast("long")))
    own = boxes.where("page is not null and id is not null").select("page", long("id").alias("id"), *[long(c).alias(c) for c in SIDES])
    whole = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    at = lambda low, high: F.when(whole, tile(F.col(low), F.col(high))).otherwise(F.array(F.lit(0).cast("long")))
    own = own.withColumns({"txs": at("x0", "x1"), "tys": at("y0", "y1")})
    own = own.withColumn("tx", F.explode("txs")).withColumn("ty", F.explode("tys"))
    first = (F.col("tx") == F.get("txs", F.lit(0))) & (F.col("ty") == F.get("tys", F.lit(0)))
    several = F.when((F.size("txs") == 1) & (F.size("tys") == 1), 0).when(first, 1).otherwise(2)
    sides = [F.coalesce(c, F.lit(NONE if c in ("x0", "y0") else -NONE)).alias(c) for c in SIDES]
    dealt = own.select("page", "ty", "tx", several.alias("several"), "id", *sides).repartition("page", "ty", "tx").sortWithinPartitions("page", "ty", "tx", "y0")
    page = boxes.schema["page"].dataType
    schema = f"page {page.simpleString()}, id long, label long, home boolean, wide boolean" + ", x0 long, y0 long, x1 long, y1 long" * merged
    return stored(dealt.mapInArrow(partial(_solved, linked=linked, reach=reach, merged=merged, page_type=to_arrow_type(page)), schema))


def _closed(parts: DataFrame) -> DataFrame | None:
    """page, label, component on pages of more than a tile; None if there is none."""
    wide = parts.where("wide").select("page")
    if wide.isEmpty():
        return None
    links = parts.where("id is not null").join(wide.distinct().hint("merge"), "page", "left_semi")
    return graph.components(links.select("page", F.col("label").alias("a"), F.col("id").alias("b")), "page").withColumnRenamed("id", "label")


def _named(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return rows.withColumnRenamed("label", "component")
    return rows.join(found.hint("merge"), ["page", "label"], "left").withColumn("component", F.coalesce("component", "label")).drop("label")


def components(boxes: DataFrame, linked: Linked, reach: int) -> DataFrame:
    """page, id, component (the smallest id of the page that is reachable by links), a row a box.

    linked must imply gaps of at most reach on both axes.
    """
    parts = _parts(boxes, linked, reach, False)
    odd = boxes.where("page is null or id is null").select("page", F.col("id").cast("long").alias("id")).withColumn("component", F.col("id"))
    return _named(parts.where("home").select("page", "id", "label"), _closed(parts)).select("page", "id", "component").unionByName(odd)


def merged(boxes: DataFrame, linked: Linked, reach: int) -> DataFrame:
    """page, id (of the component), x0 ... y1: the box around each component."""
    around = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    parts = _parts(boxes, linked, reach, True)
    found = _closed(parts)
    out = _named(parts.where("id is null").select("page", "label", *SIDES), found).withColumnRenamed("component", "id")
    if found is not None:
        out = out.groupBy("page", "id").agg(*around)
    out = out.select("page", "id", *[F.col(c).cast(boxes.schema[c].dataType).alias(c) for c in SIDES])
    return out.unionByName(boxes.where("page is null or id is null").groupBy("page", F.col("id").cast("long").alias("id")).agg(*around))
