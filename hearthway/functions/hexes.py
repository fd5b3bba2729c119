"""A planar grid of pointy-top hexagons, addressed by axial coordinates.

`cell_size` is the side of a hexagon in metres. The cell of a point follows from
arithmetic alone, so binning points needs neither a join nor a spatial index. The ids
(`q_r`) belong to this planar grid only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT3 = math.sqrt(3.0)
STEPS = [(1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)]


def _nearest(value: Column) -> Column:
    return F.floor(value + 0.5)


def axial_of_point(x: Column, y: Column, cell_size: float) -> tuple[Column, Column]:
    """Cube rounding: round all three cube coordinates, then mend the worst one."""
    q = (x * (ROOT3 / 3) - y / 3) / cell_size
    r = (y * (2 / 3)) / cell_size
    s = -q - r
    rq, rr, rs = _nearest(q), _nearest(r), _nearest(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    mended_q = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    mended_r = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return mended_q.cast("bigint"), mended_r.cast("bigint")


def cell_id(q: Column, r: Column) -> Column:
    return F.concat_ws("_", q.cast("string"), r.cast("string"))


def hex_of_point(x: Column, y: Column, cell_size: float) -> Column:
    return cell_id(*axial_of_point(x, y, cell_size))


def hex_centre(q: Column, r: Column, cell_size: float) -> tuple[Column, Column]:
    return (q + r / 2) * (ROOT3 * cell_size), r * (1.5 * cell_size)


def hex_rings(q: Column, r: Column, cell_size: float) -> Column:
    """The closed counter-clockwise outline of a cell.

    Corners are built from whole multiples of half a width and half a side, so cells
    that share a corner compute exactly the same coordinates for it.
    """
    half_width, half_side = ROOT3 / 2 * cell_size, cell_size / 2
    column, row = 2 * q + r, 3 * r
    offsets = [(1, -1), (1, 1), (0, 2), (-1, 1), (-1, -1), (0, -2), (1, -1)]
    points = [
        F.struct(((column + i) * half_width).alias("x"), ((row + j) * half_side).alias("y"))
        for i, j in offsets
    ]
    return F.array(F.array(*points))
