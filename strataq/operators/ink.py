"""Connected parts of a page's ink, from runs: rows of pixels without a gap.

A raster is a table of runs (page, y, x0, x1; pixels x0 to x1 - 1 of row y), as a
run-length coded image gives them. Runs of neighbouring rows that touch, corners
included, are linked; what is reachable is one component, with its box, its pixels
and those of them in text zones. No image is held anywhere: runs meet by tile of
a page, a tile's parts are found in whole arrays, and parts that meet at the edges
of tiles are closed in rounds (``graph``).

Cases: runs that overlap, touch or repeat in a row are one; empty ones (x1 <= x0)
and those with a null are left out; pixels in several zones count once; a table
without runs gives no component; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .cut import stored

#: Pixels of a row's stretch by which runs meet.
STRETCH = 256
#: Pixels of a tile; runs that a task has before it solves the tiles among them.
HIGH, WIDE, HELD = 256, 4096, 1 << 19
PART = ["page", "id", "x0", "y0", "x1", "y1", "pixel_area", "text_pixels"]


def joined_runs(runs: DataFrame) -> DataFrame:
    """page, y, x0, x1: the same pixels in runs with gaps between them."""
    own = runs.select(F.col("page").cast("long"), F.col("y").cast("long"), F.col("x0").cast("long"), F.col("x1").cast("long")).where("page is not null and y is not null and x0 < x1").distinct()
    row = Window.partitionBy("page", "y").orderBy("x0", "x1")  # a row of pixels, as wide as the page
    reach = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    begun = own.withColumn("new", (F.col("x0") > F.coalesce(reach, F.col("x0") - 1)).cast("int"))
    begun = begun.withColumn("run", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return begun.groupBy("page", "y", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("run")


def rows_of(boxes: DataFrame) -> DataFrame:
    """The runs of filled boxes."""
    return boxes.where("x0 < x1 and y0 < y1").select("page", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"), "x0", "x1")


def _stretches(runs: DataFrame, low, high) -> DataFrame:
    return runs.withColumn("s", F.explode(F.sequence(F.floor(low / STRETCH), F.floor(high / STRETCH))))


def _tiled(runs: DataFrame, kind: int) -> DataFrame:
    """The runs cut at the edges of tiles: page, ty, tx, kind, y, x0, x1."""
    own = runs.where("page is not null and y is not null and x0 < x1").select(*[F.col(c).cast("long") for c in ("page", "y", "x0", "x1")])
    own = own.withColumn("tx", F.explode(F.sequence(F.floor(F.col("x0") / WIDE), F.floor((F.col("x1") - 1) / WIDE))))
    return own.select("page", F.floor(F.col("y") / HIGH).alias("ty"), "tx", F.lit(kind).alias("kind"), "y", F.greatest("x0", F.col("tx") * WIDE).alias("x0"), F.least("x1", (F.col("tx") + 1) * WIDE).alias("x1"))


def _disjoint(row: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same pixels in runs with gaps between them, in order; x is counted from the tile's edge."""
    order = np.lexsort((x0, row))
    row, low, high = row[order], row[order] * (2 * WIDE) + x0[order], row[order] * (2 * WIDE) + x1[order]
    reach = np.maximum.accumulate(high)  # rows lie apart on the line, so that none reaches the next one
    first = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1]])) if len(row) else np.empty(0, np.int64)
    return row[first], low[first], np.maximum.reduceat(high, first) if len(first) else high


def _local(tile: np.ndarray, kind: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, tx: np.ndarray) -> list[np.ndarray]:
    """Whole tiles, numbered in order: of each run the first place of its part, tile, y, x0, x1, text pixels; and of each the number of its first run."""
    left, top = tx * WIDE, y - y % HIGH
    row = tile * (HIGH + 2) + y % HIGH  # a row of no tile between two tiles
    ink, zone = kind == 0, kind == 1
    at, low, high = _disjoint(row[ink], (x0 - left)[ink], (x1 - left)[ink])
    _, z0, z1 = _disjoint(row[zone], (x0 - left)[zone], (x1 - left)[zone])
    before = np.concatenate([[0], np.cumsum(z1 - z0)])

    def covered(x):
        k = np.searchsorted(z0, x, "right")
        return before[k] - np.where(k > 0, np.maximum(z1[np.maximum(k - 1, 0)] - x, 0), 0) if len(z0) else np.zeros(len(x), np.int64)

    text = covered(high) - covered(low)
    # runs of the row above that touch, corners included
    up0, up1 = low - 2 * WIDE, high - 2 * WIDE
    a, z = np.searchsorted(high, up0, "left"), np.searchsorted(low, up1, "right")
    n = np.maximum(0, z - a)
    below = np.repeat(np.arange(len(low)), n)
    above = np.repeat(a, n) + np.arange(len(below)) - np.repeat(np.cumsum(n) - n, n)
    least = np.arange(len(low))
    if len(below):
        v, u = graph._contracted([above, below])[::-1]
        least[u] = v
    first = np.unique(tile, return_index=True)[1]
    of = at // (HIGH + 2)
    own_y = top[first][of] + at % (HIGH + 2)
    edge = left[first][of]
    return [of, own_y, low - at * (2 * WIDE) + edge, high - at * (2 * WIDE) + edge, text, least]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of tiles from runs sorted by tile: a row a part, and a row a run at a tile's edge (pixel_area -1), so that parts can be linked."""

    def solved(c: list[np.ndarray]) -> pa.RecordBatch:
        page, ty, tx, kind, y, x0, x1 = c
        new = np.concatenate([[True], (page[1:] != page[:-1]) | (ty[1:] != ty[:-1]) | (tx[1:] != tx[:-1])])
        tile, first = np.cumsum(new) - 1, np.flatnonzero(new)
        of, y, x0, x1, text, least = _local(tile, kind, y, x0, x1, tx)
        own = np.flatnonzero(least == np.arange(len(least)))
        part = np.searchsorted(own, least)
        order = np.argsort(part, kind="stable")
        starts = np.searchsorted(part[order], np.arange(len(own)))
        each = lambda f, v: f.reduceat(v[order], starts) if len(own) else v[:0]
        place = (y << 32) + x0
        rows = [page[first][of[own]], place[own], each(np.minimum, x0), each(np.minimum, y), each(np.maximum, x1), each(np.maximum, y) + 1, each(np.add, x1 - x0), each(np.add, text)]
        edge = np.flatnonzero((y % HIGH == 0) | (y % HIGH == HIGH - 1) | (x0 % WIDE == 0) | (x1 % WIDE == 0))
        none = np.full(len(edge), -1)
        runs = [page[first][of[edge]], place[own][part[edge]], x0[edge], y[edge], x1[edge], none, none, none]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(rows, runs)], PART)

    held: list[list[np.ndarray]] = []
    size, most = 0, HELD
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
            yield solved([x[:end] for x in c])
        rest = [x[end:] for x in c]
        if len(rest[0]) >= HELD // 2:  # a tile of many runs: kept as its pixels, which are bounded
            rest = _fewer(rest)
        held, size = [rest], len(rest[0])
        most = max(HELD, 2 * size)
    if size:
        yield solved([np.concatenate(x) for x in zip(*held)])


def _fewer(c: list[np.ndarray]) -> list[np.ndarray]:
    """The runs of one tile as disjoint ones."""
    out = []
    for k in (0, 1):
        on = c[3] == k
        row, low, high = _disjoint(c[4][on] % HIGH, c[5][on] - c[2][on] * WIDE, c[6][on] - c[2][on] * WIDE)
        same = [np.full(len(row), x[0]) for x in c[:3]]
        shift = same[2] * WIDE - row * (2 * WIDE)
        out.append([*same, np.full(len(row), k), same[1] * HIGH + row, low + shift, high + shift])
    return [np.concatenate(x) for x in zip(*out)]


def ink_components(runs: DataFrame, zones: DataFrame) -> DataFrame:
    """page, id, x0 ... y1, pixel_area, text_pixels: components by the place of their first pixel, in the order of rows.

    zones: boxes of texts (page, x0 ... y1). What ``boxes.detect_details`` takes as measured components. Runs and zones meet
    once, by tile; each tile's parts are found in the task, and only parts at a tile's edge are linked by joins.
    """
    both = _tiled(runs, 0).unionByName(_tiled(rows_of(zones), 1)).repartition("page", "ty", "tx").sortWithinPartitions("page", "ty", "tx")
    parts = stored(both.mapInArrow(_parts, ", ".join(f"{c} long" for c in PART)))
    edges = parts.where("pixel_area = -1").select("page", "id", "x0", F.col("y0").alias("y"), "x1")
    # up and down: by stretches of the rows on both sides of an edge; sideways: by the edge, a row up or down too
    above = _stretches(edges.where(F.pmod("y", F.lit(HIGH)) == HIGH - 1).withColumn("y", F.col("y") + 1), F.col("x0"), F.col("x1")).alias("p")
    below = _stretches(edges.where(F.pmod("y", F.lit(HIGH)) == 0), F.col("x0"), F.col("x1")).alias("q")
    same = (F.col("p.page") == F.col("q.page")) & (F.col("p.y") == F.col("q.y")) & (F.col("p.s") == F.col("q.s"))
    vertical = above.join(below, same & (F.col("p.x0") <= F.col("q.x1")) & (F.col("q.x0") <= F.col("p.x1"))).select("p.page", F.col("p.id").alias("a"), F.col("q.id").alias("b"))
    near = edges.where(F.pmod("x1", F.lit(WIDE)) == 0).select("page", F.col("x1").alias("x"), F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)).alias("y"), F.col("id").alias("a"))
    sideways = near.join(edges.where(F.pmod("x0", F.lit(WIDE)) == 0).select("page", F.col("x0").alias("x"), "y", F.col("id").alias("b")), ["page", "x", "y"]).select("page", "a", "b")
    found = graph.components(vertical.unionByName(sideways), "page")
    named = parts.where("pixel_area != -1").join(found, ["page", "id"], "left").withColumn("component", F.coalesce("component", "id"))
    return named.groupBy("page", F.col("component").alias("id")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("pixel_area").alias("pixel_area"), F.sum("text_pixels").alias("text_pixels"))
