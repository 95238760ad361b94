"""Boxes and rectangles. A box is four columns p.x0 to p.y1 (integers, half open); a rectangle may hold NaN and infinities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def box(p: str = "") -> tuple[Column, Column, Column, Column]:
    """The four columns under an alias (``p``) or a struct column."""
    return tuple(F.col(f"{p}.{s}" if p else s) for s in SIDES)  # type: ignore[return-value]


def struct(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[c.alias(s) for c, s in zip((x0, y0, x1, y1), SIDES)])


def width(p: str = "") -> Column:
    x0, _, x1, _ = box(p)
    return F.greatest(F.lit(0), x1 - x0)


def height(p: str = "") -> Column:
    _, y0, _, y1 = box(p)
    return F.greatest(F.lit(0), y1 - y0)


def area(p: str = "") -> Column:
    return width(p).cast("long") * height(p).cast("long")


def intersects(p: str, q: str) -> Column:
    """Edges that touch don't count."""
    return touches(p, q, 0)


def touches(p: str, q: str, tolerance: int) -> Column:
    """Both gaps are smaller than the tolerance."""
    a, b = box(p), box(q)
    return (a[0] < b[2] + tolerance) & (b[0] < a[2] + tolerance) & (a[1] < b[3] + tolerance) & (b[1] < a[3] + tolerance)


def contains(p: str, q: str, margin: int = 0) -> Column:
    """q within p grown by the margin (a negative one is an inset)."""
    a, b = box(p), box(q)
    return (b[0] >= a[0] - margin) & (b[1] >= a[1] - margin) & (b[2] <= a[2] + margin) & (b[3] <= a[3] + margin)


def intersection_area(p: str, q: str) -> Column:
    a, b = box(p), box(q)
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return w.cast("long") * h.cast("long")


def expanded(margin: int, page_width: Column, page_height: Column, p: str = "") -> Column:
    x0, y0, x1, y1 = box(p)
    return struct(F.greatest(F.lit(0), x0 - margin), F.greatest(F.lit(0), y0 - margin), F.least(page_width, x1 + margin), F.least(page_height, y1 + margin))


def union() -> list[Column]:
    """Aggregates of a group's boxes: the box around all."""
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def to_points(dpi: int, p: str = "") -> Column:
    """Pixels to points (1/72 inch)."""
    return struct(*[c * F.lit(72.0) / dpi for c in box(p)])


def to_pixels(dpi: int, p: str = "") -> Column:
    """Points to pixels, towards zero."""
    return struct(*[(c * dpi / F.lit(72.0)).cast("int") for c in box(p)])


def sanitized(rect: str, page: str) -> Column:
    """The rectangle with ordered corners within the page; null if it isn't finite or has no area."""
    a, b = box(rect), box(page)
    finite = None
    for c in a:
        ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
        finite = ok if finite is None else finite & ok
    x0, x1 = F.least(a[0], a[2]), F.greatest(a[0], a[2])
    y0, y1 = F.least(a[1], a[3]), F.greatest(a[1], a[3])
    left, top, right, bottom = F.greatest(x0, b[0]), F.greatest(y0, b[1]), F.least(x1, b[2]), F.least(y1, b[3])
    return F.when(finite & (x1 > x0) & (y1 > y0) & (right > left) & (bottom > top), struct(left, top, right, bottom))


def crop_rect(bound: str, rect: str, page: str, padding: float = 10.0) -> Column:
    """``bound``, else ``rect``, sanitised, grown by the padding, sanitised again."""
    own = F.coalesce(sanitized(bound, page), sanitized(rect, page))
    b = box(page)
    grown = struct(F.greatest(own["x0"] - padding, b[0]), F.greatest(own["y0"] - padding, b[1]), F.least(own["x1"] + padding, b[2]), F.least(own["y1"] + padding, b[3]))
    return F.when(own.isNotNull(), grown)


def rgb255(color: Column) -> Column:
    """array of three shares (0 to 1) to struct(r, g, b): rounded half to even, clamped; null if it is short."""
    part = lambda i: F.greatest(F.lit(0), F.least(F.lit(255), F.bround(F.get(color, F.lit(i)) * 255).cast("int")))
    return F.when(F.size(color) >= 3, F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b")))
