"""Polygons on a grid: the sides that meet each cell, and which corners lie inside.

A side is listed in the cells it passes, not in those of its polygon's box. For every cell the polygon meets there is one row
with these sides and a flag: whether the cell's lower right corner lies inside. From the corner a point of the cell is reached along the right
border and then to the left; each side crossed on this way changes between inside and outside. So a point is tested against the sides of its
cell alone, however many the polygon has, and a cell without sides needs no test at all.

The flags come from the same crossings: a side that passes the lower line of a row of cells changes all corners to its left. No polygon is
held in one task but for the columns in which one grid line crosses it.

Points on a side count as inside. Where a corner lies on a side, it counts as moved up by an amount and right by a much smaller one, in
flags and tests alike. Polygons without rings are in no cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthway.functions import geometry as G

SIDE = ["ax", "ay", "bx", "by"]
CELL = ["_cx", "_cy"]
#: Part of a cell by which sides beyond its border are listed too, so that rounding loses none.
SLACK = 1e-6


def sides(zones: DataFrame, keep: list[str]) -> DataFrame:
    """One row per side: the columns `keep`, ax, ay, bx, by."""
    return zones.select(*keep, F.explode(G.polygon_edges(F.col("rings"))).alias("_side")).select(*keep, "_side.*")


def fitting_size(zones: DataFrame, margin: float = 0.0) -> float:
    """A cell size with a few sides per cell and about as many cells as sides, at least `margin`."""
    edges = G.polygon_edges(F.col("rings"))
    box = G.bounds(edges)
    length = F.aggregate(edges, F.lit(0.0), lambda s, e: s + F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]))
    area = (box["maxx"] - box["minx"]) * (box["maxy"] - box["miny"])
    known = zones.filter("rings is not null").select(F.size(edges).alias("n"), length.alias("length"), area.alias("area"))
    n, length, area = known.agg(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in ("n", "length", "area"))).first()
    return max(margin, math.sqrt(area / (4 * n + 1000)), length / (16 * n + 4000), 1e-3)


def _side_of(e: Column, x: Column, y: Column) -> Column:
    """Positive to the right of the side (looking along it), negative to the left, 0 on its line."""
    return (x - e["ax"]) * (e["by"] - e["ay"]) - (e["bx"] - e["ax"]) * (y - e["ay"])


def _moved_side_of(e: Column, x: Column, y: Column) -> Column:
    """Sign of `_side_of` with ties settled by moving the point up, and right by much less."""
    exact = _side_of(e, x, y)
    return F.when(exact != 0, F.signum(exact)).when(e["bx"] != e["ax"], F.signum(e["ax"] - e["bx"])).otherwise(F.signum(e["by"] - e["ay"]))


def _passes_right(e: Column, side: Column) -> Column:
    """A side that passes the height of a point does so to the right of it."""
    return (side < 0) == (e["by"] > e["ay"])


def _passes_above(e: Column, side: Column) -> Column:
    return (side > 0) == (e["bx"] > e["ax"])


def on_cells(lines: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """One row per side and cell that is passed, or lies within `margin` of it; `_cx` and `_cy` are added.

    Per row of cells only the columns that the side has there are listed, so a long slanted
    side is in as many cells as it is long.
    """
    slack = margin + size * SLACK
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = lines.withColumn("_cy", F.explode(F.sequence(F.floor((low - slack) / size), F.floor((high + slack) / size))))

    def x_at(y: Column) -> Column:
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(y - F.col("ay"), F.col("by") - F.col("ay")), F.lit(0.0))))
        return F.col("ax") + part * (F.col("bx") - F.col("ax"))

    one, two = x_at(F.col("_cy") * size - slack), x_at((F.col("_cy") + 1) * size + slack)
    flat = F.col("ay") == F.col("by")
    left = F.when(flat, F.least("ax", "bx")).otherwise(F.least(one, two))
    right = F.when(flat, F.greatest("ax", "bx")).otherwise(F.greatest(one, two))
    return rows.withColumn("_cx", F.explode(F.sequence(F.floor((left - slack) / size), F.floor((right + slack) / size))))


def _inner_cells(lines: DataFrame, key: list[str], size: float) -> DataFrame:
    """(key, cell) of the cells whose lower right corner lies inside."""
    e = {c: F.col(c) for c in SIDE}
    line = lines.withColumn("_cy", F.explode(F.sequence(F.floor(F.least("ay", "by") / size), F.floor(F.greatest("ay", "by") / size))))
    height = F.col("_cy") * size
    line = line.filter((F.col("ay") > height) != (F.col("by") > height))
    # The first column whose right border is not left of the side; rounding is settled by the side itself.
    guess = F.floor((e["ax"] + (height - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"])) / size)
    beyond = [_passes_right(e, _moved_side_of(e, (guess + d + 1) * size, height)) for d in (-1, 0)]
    column = F.when(~beyond[0], guess - 1).when(~beyond[1], guess).otherwise(guess + 1)
    crossings = line.groupBy(*key, "_cy").agg(F.sort_array(F.collect_list(column)).alias("_at"))
    # Corners between an odd crossing and the next even one are inside.
    pairs = F.transform(F.sequence(F.lit(0), F.size("_at") - 2, F.lit(2)), lambda i: F.struct(F.col("_at")[i].alias("a"), F.col("_at")[i + 1].alias("b")))
    runs = crossings.select(*key, "_cy", F.explode(pairs).alias("_run")).filter("_run.a < _run.b")
    return runs.select(*key, F.explode(F.sequence(F.col("_run.a"), F.col("_run.b") - 1)).alias("_cx"), "_cy")


def polygon_cells(zones: DataFrame, key: list[str], size: float, margin: float = 0.0) -> DataFrame:
    """(key, _cx, _cy, _odd, _sides) for every cell that may hold points of a polygon or points within `margin` of it."""
    lines = sides(zones, key)
    side = F.struct(*SIDE).alias("_side")
    border = on_cells(lines, size, margin).select(*key, *CELL, F.lit(False).alias("_odd"), side)
    inner = _inner_cells(lines, key, size).select(*key, *CELL, F.lit(True).alias("_odd"), F.lit(None).cast(border.schema["_side"].dataType).alias("_side"))
    return border.unionByName(inner).groupBy(*key, *CELL).agg(F.max("_odd").alias("_odd"), F.collect_list("_side").alias("_sides"))


def cell_of(points: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    return points.withColumns({"_cx": F.floor(F.col(x) / size), "_cy": F.floor(F.col(y) / size)})


def touches(lines: Column, x: Column, y: Column) -> Column:
    """A point lies on one of the sides."""

    def on(e: Column) -> Column:
        between = x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))
        return between & (_side_of(e, x, y) == 0)

    return F.exists(lines, on)


def strictly_inside(odd: Column, lines: Column, x: Column, y: Column, size: float) -> Column:
    """Inside by the sides of the cell; for points on a side the answer is either."""
    right, bottom = (F.col("_cx") + 1) * size, F.col("_cy") * size

    def crossed(e: Column) -> Column:
        bend = _moved_side_of(e, right, y)
        level = ((e["ay"] > y) != (e["by"] > y)) & (_passes_right(e, _side_of(e, x, y)) != _passes_right(e, bend))
        upright = ((e["ax"] > right) != (e["bx"] > right)) & (_passes_above(e, _moved_side_of(e, right, bottom)) != _passes_above(e, bend))
        return level != upright

    return odd != (F.size(F.filter(lines, crossed)) % 2 == 1)


def covers(odd: Column, lines: Column, x: Column, y: Column, size: float) -> Column:
    """A point of the cell lies inside the polygon or on its boundary."""
    return strictly_inside(odd, lines, x, y, size) | touches(lines, x, y)
