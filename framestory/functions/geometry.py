"""Box geometry on normalised coordinates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cx(p: str = "") -> Column:
    return (F.col(p + "x1") + F.col(p + "x2")) / 2


def cy(p: str = "") -> Column:
    return (F.col(p + "y1") + F.col(p + "y2")) / 2


def width(p: str = "") -> Column:
    return F.col(p + "x2") - F.col(p + "x1")


def height(p: str = "") -> Column:
    return F.col(p + "y2") - F.col(p + "y1")


def area(p: str = "") -> Column:
    return width(p) * height(p)


def overlap_area(a: str, b: str) -> Column:
    w = F.least(F.col(a + "x2"), F.col(b + "x2")) - F.greatest(F.col(a + "x1"), F.col(b + "x1"))
    h = F.least(F.col(a + "y2"), F.col(b + "y2")) - F.greatest(F.col(a + "y1"), F.col(b + "y1"))
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def iou(a: str, b: str) -> Column:
    inter = overlap_area(a, b)
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def inside_share(person: str, obj: str) -> Column:
    """Overlap divided by the person's area."""
    return overlap_area(person, obj) / F.greatest(area(person), F.lit(1e-6))


def centre_distance(a: str, b: str) -> Column:
    dx, dy = cx(a) - cx(b), cy(a) - cy(b)
    return F.sqrt(dx * dx + dy * dy)


def nearest_edge(x: Column, y: Column) -> Column:
    """left, right, top or bottom: the frame edge closest to the point, in that order on ties."""
    low = F.least(x, 1 - x, y, 1 - y)
    return (F.when(x == low, "left").when(1 - x == low, "right").when(y == low, "top").otherwise("bottom"))


def polygon_edges(polygon: Column) -> Column:
    """Edges of array<struct<x,y>> as array<struct<px,py,qx,qy>>, each corner with the one before it."""
    n = F.size(polygon)
    before = F.concat(F.slice(polygon, n, 1), F.slice(polygon, F.lit(1), n - 1))
    return F.zip_with(polygon, before, lambda p, q: F.struct(p["x"].alias("px"), p["y"].alias("py"), q["x"].alias("qx"), q["y"].alias("qy")))


def inside_edges(x: Column, y: Column, edges: Column) -> Column:
    """Ray casting with the half-open rule over ``polygon_edges``."""
    def crosses(e: Column) -> Column:
        at = (e["qx"] - e["px"]) * (y - e["py"]) / (e["qy"] - e["py"] + F.lit(1e-12)) + e["px"]
        return ((e["py"] > y) != (e["qy"] > y)) & (x < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def point_in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    return inside_edges(x, y, polygon_edges(polygon))


def prefixed(df, prefix: str, keep: list[str] | None = None):
    """Rename every column not in ``keep`` with a prefix."""
    keep = keep or []
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])
