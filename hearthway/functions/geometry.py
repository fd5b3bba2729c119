"""Planar geometry on plain columns.

A polygon is `rings: array<array<struct<x,y>>>` in metres: closed rings, outer rings
counter-clockwise and holes clockwise (the readers see to it). Most functions take the
`edges` of the polygon, computed once per polygon and carried along.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS_TYPE = "array<array<struct<x:double,y:double>>>"


def box_rings(minx, miny, maxx, maxy) -> Column:
    """One counter-clockwise ring around an axis-aligned box."""
    corners = [(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny)]
    points = [
        F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x, y in corners
    ]
    return F.array(F.array(*points))


def polygon_edges(rings: Column) -> Column:
    """All sides of all rings as `array<struct<ax,ay,bx,by>>`."""

    def sides(ring: Column) -> Column:
        count = F.size(ring) - 1
        return F.zip_with(
            F.slice(ring, 1, count),
            F.slice(ring, 2, count),
            lambda a, b: F.struct(
                a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")
            ),
        )

    return F.flatten(F.transform(rings, sides))


def bounds(edges: Column) -> dict[str, Column]:
    """Bounding box; rings are closed, so side starts cover every vertex."""
    return {
        "minx": F.array_min(F.transform(edges, lambda e: e["ax"])),
        "miny": F.array_min(F.transform(edges, lambda e: e["ay"])),
        "maxx": F.array_max(F.transform(edges, lambda e: e["ax"])),
        "maxy": F.array_max(F.transform(edges, lambda e: e["ay"])),
    }


def _moments(edges: Column) -> Column:
    """Shoelace sums (twice the area, first moments) relative to the first vertex."""
    ox, oy = edges[0]["ax"], edges[0]["ay"]

    def step(acc: Column, e: Column) -> Column:
        ax, ay, bx, by = e["ax"] - ox, e["ay"] - oy, e["bx"] - ox, e["by"] - oy
        cross = ax * by - bx * ay
        return F.struct(
            (acc["a"] + cross).alias("a"),
            (acc["mx"] + (ax + bx) * cross).alias("mx"),
            (acc["my"] + (ay + by) * cross).alias("my"),
        )

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(edges, zero, step)


def polygon_area(edges: Column) -> Column:
    return F.abs(_moments(edges)["a"]) / 2


def polygon_centroid(edges: Column) -> Column:
    """struct<x,y>; NULL for a polygon without area."""
    m = _moments(edges)
    return F.struct(
        (edges[0]["ax"] + F.try_divide(m["mx"], 3 * m["a"])).alias("x"),
        (edges[0]["ay"] + F.try_divide(m["my"], 3 * m["a"])).alias("y"),
    )


def distance_to_boundary(edges: Column, x: Column, y: Column) -> Column:
    """Distance from a point to the nearest side."""

    def squared(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        along = F.try_divide((x - e["ax"]) * dx + (y - e["ay"]) * dy, dx * dx + dy * dy)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
        px, py = e["ax"] + t * dx - x, e["ay"] + t * dy - y
        return px * px + py * py

    return F.sqrt(F.array_min(F.transform(edges, squared)))


def _turn(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))


def _between(e: Column, x: Column, y: Column) -> Column:
    return x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(
        F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])
    )


def _turns(e: Column, f: Column) -> tuple[Column, Column, Column, Column]:
    return (
        _turn(e["ax"], e["ay"], e["bx"], e["by"], f["ax"], f["ay"]),
        _turn(e["ax"], e["ay"], e["bx"], e["by"], f["bx"], f["by"]),
        _turn(f["ax"], f["ay"], f["bx"], f["by"], e["ax"], e["ay"]),
        _turn(f["ax"], f["ay"], f["bx"], f["by"], e["bx"], e["by"]),
    )


def sides_meet(e: Column, f: Column) -> Column:
    """Two sides share at least one point."""
    s1, s2, s3, s4 = _turns(e, f)
    return (
        ((s1 != s2) & (s3 != s4))
        | ((s1 == 0) & _between(e, f["ax"], f["ay"]))
        | ((s2 == 0) & _between(e, f["bx"], f["by"]))
        | ((s3 == 0) & _between(f, e["ax"], e["ay"]))
        | ((s4 == 0) & _between(f, e["bx"], e["by"]))
    )


def sides_cross(e: Column, f: Column) -> Column:
    """Two sides cross in a point interior to both."""
    s1, s2, s3, s4 = _turns(e, f)
    return (s1 * s2 < 0) & (s3 * s4 < 0)
