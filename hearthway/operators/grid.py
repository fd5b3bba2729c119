"""Hexagon grids over a study area."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthway import settings
from hearthway.functions import geometry as G
from hearthway.functions import hexes as H


def extent(zones: DataFrame, buffer: float = settings.GRID_BUFFER_METRES) -> DataFrame:
    """Bounding box of all polygons grown by `buffer`, as one row."""
    boxes = zones.select(G.polygon_edges(F.col("rings")).alias("e"))
    box = boxes.select(*[value.alias(name) for name, value in G.bounds(F.col("e")).items()])
    return box.agg(
        (F.min("minx") - buffer).alias("minx"),
        (F.min("miny") - buffer).alias("miny"),
        (F.max("maxx") + buffer).alias("maxx"),
        (F.max("maxy") + buffer).alias("maxy"),
    )


def hex_grid(spark: SparkSession, area: DataFrame, cell_size: float) -> DataFrame:
    """Every hexagon whose centre lies in the box `area` or that is next to such a one.

    (grid_id, q, r, rings). Only the four numbers of the box reach the driver; the rows of
    the grid are a distributed range and the cells of a row come from a sequence.
    """
    box = area.first()
    low = math.floor(box["miny"] / (1.5 * cell_size)) - 1
    high = math.ceil(box["maxy"] / (1.5 * cell_size)) + 1
    width = H.ROOT3 * cell_size
    r = F.col("r")
    first = F.floor(F.lit(box["minx"] / width) - r / 2) - 1
    last = F.ceil(F.lit(box["maxx"] / width) - r / 2) + 1
    cells = spark.range(low, high + 1).select(F.col("id").alias("r")).select("r", F.explode(F.sequence(first, last)).alias("q"))
    return cells.select(
        H.cell_id(F.col("q"), F.col("r")).alias("grid_id"),
        "q",
        "r",
        H.hex_rings(F.col("q"), F.col("r"), cell_size).alias("rings"),
    )


def bin_points(points: DataFrame, cell_size: float) -> DataFrame:
    """Points with the `grid_id` of their hexagon; no join."""
    return points.withColumn("grid_id", H.hex_of_point(F.col("x"), F.col("y"), cell_size))


def used_cells(points: DataFrame, cell_size: float) -> DataFrame:
    """Distinct hexagons that hold a point: (grid_id, q, r)."""
    q, r = H.axial_of_point(F.col("x"), F.col("y"), cell_size)
    return points.select(q.alias("q"), r.alias("r")).distinct().withColumn("grid_id", H.cell_id(F.col("q"), F.col("r")))


def hex_outlines(cells: DataFrame, cell_size: float) -> DataFrame:
    """Add the outline to cells that have `q` and `r`."""
    return cells.withColumn("rings", H.hex_rings(F.col("q"), F.col("r"), cell_size))


def hex_neighbors(cells: DataFrame) -> DataFrame:
    """Edges (i, j) between hexagons of the table that share a side.

    Six candidate addresses per cell and an equi join on the address.
    """
    steps = F.array(*[F.struct(F.lit(a).alias("dq"), F.lit(b).alias("dr")) for a, b in H.STEPS])
    candidates = cells.select(F.col("grid_id").alias("i"), "q", "r", F.explode(steps).alias("s")).select(
        "i", H.cell_id(F.col("q") + F.col("s.dq"), F.col("r") + F.col("s.dr")).alias("j")
    )
    return candidates.join(cells.select(F.col("grid_id").alias("j")), "j", "left_semi").select("i", "j")
