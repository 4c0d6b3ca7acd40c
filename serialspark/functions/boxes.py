"""Box geometry as column expressions. A box is four columns x1, y1, x2, y2; right and lower edges are outside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]
CORNERS = ("x1", "y1", "x2", "y2")


def box(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in CORNERS]


def area(a: Box) -> Column:
    return F.greatest(a[2] - a[0], F.lit(0)) * F.greatest(a[3] - a[1], F.lit(0))


def intersection(a: Box, b: Box) -> Column:
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def containment(inner: Box, outer: Box) -> Column:
    """How much of the inner box the outer one covers."""
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(0.0)


def overlaps(a: Box, b: Box) -> Column:
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def clipped(a: Box, width: Column, height: Column) -> list[Column]:
    fit = lambda v, top: F.greatest(F.lit(0), F.least(top, v)).cast("int")
    return [fit(a[0], width), fit(a[1], height), fit(a[2], width), fit(a[3], height)]


def padded(a: Box, width: Column, height: Column, share_x: float = 0.15, share_y: float = 0.375) -> list[Column]:
    """Wider and taller by shares of its size on every side, truncated, within the image."""
    px, py = ((a[2] - a[0]) * share_x).cast("int"), ((a[3] - a[1]) * share_y).cast("int")
    return clipped([a[0] - px, a[1] - py, a[2] + px, a[3] + py], width, height)


def crop(a: Box, positive: Column, width: Column, height: Column, margin: int = 4) -> list[Column]:
    """The part of an image to cut out: positives with a margin, all within the image."""
    m = F.when(positive, margin).otherwise(0)
    return clipped([a[0] - m, a[1] - m, a[2] + m, a[3] + m], width, height)


def of_polygon(points: Column) -> list[Column]:
    """The axis-aligned box of an array of (x, y), rounded half to even before it is taken."""
    at = lambda f: F.transform(points, lambda p: F.bround(p[f]).cast("int"))
    return [F.array_min(at("x")), F.array_min(at("y")), F.array_max(at("x")), F.array_max(at("y"))]
