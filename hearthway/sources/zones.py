"""Polygon tables: zones, islands, grid cells, study areas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthway.functions import geometry as G


def read_zones(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Key and outline of every polygon: (key, rings, minx, miny, maxx, maxy).

    The file holds either `rings` or a WKB `geometry`.
    """
    table = spark.read.parquet(path)
    if "rings" not in table.columns:
        table = ingest_wkb(table.select(key, "geometry"), "geometry")
    return table.select(key, "rings").withColumns(G.bounds(G.polygon_edges(F.col("rings"))))


def ingest_wkb(df: DataFrame, column: str) -> DataFrame:
    """Replace a WKB column by `x`, `y` (points) and `rings` (polygons).

    Bytes that are missing or cannot be read give NULL in all three. Every partition is
    decoded by itself in Arrow batches.
    """
    kept = [f for f in df.schema.fields if f.name != column]
    rings = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
    schema = T.StructType(
        [*kept, T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("rings", rings)]
    )
    ring_type = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = [_read_wkb(value.as_py()) for value in batch.column(column)]
            columns = [batch.column(f.name) for f in kept]
            columns.append(pa.array([s[0] for s in shapes], pa.float64()))
            columns.append(pa.array([s[1] for s in shapes], pa.float64()))
            columns.append(pa.array([s[2] for s in shapes], ring_type))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(decode, schema)


def _read_wkb(data: bytes | None) -> tuple:
    """(x, y, rings) of one point, polygon or multipolygon."""
    if not data:
        return None, None, None
    try:
        kind, order, at = _header(data, 0)
        if kind == 1:
            x, y = np.frombuffer(data, f"{order}f8", 2, at)
            return (None, None, None) if np.isnan(x) else (float(x), float(y), None)
        if kind == 3:
            return None, None, _read_polygon(data, 0)[0]
        if kind == 6:
            count, at, rings = int(np.frombuffer(data, f"{order}u4", 1, at)[0]), at + 4, []
            for _ in range(count):
                part, at = _read_polygon(data, at)
                rings += part
            return None, None, rings
    except (ValueError, IndexError):
        pass
    return None, None, None


def _header(data: bytes, at: int) -> tuple[int, str, int]:
    """Geometry kind (2D only), byte order, position of the body."""
    order = "<" if data[at] == 1 else ">"
    return int(np.frombuffer(data, f"{order}u4", 1, at + 1)[0]), order, at + 5


def _read_polygon(data: bytes, at: int) -> tuple[list, int]:
    """Rings of one polygon, turned so that the first runs counter-clockwise, holes clockwise."""
    kind, order, at = _header(data, at)
    if kind != 3:
        raise ValueError("not a polygon")
    count, at, rings = int(np.frombuffer(data, f"{order}u4", 1, at)[0]), at + 4, []
    for index in range(count):
        size, at = int(np.frombuffer(data, f"{order}u4", 1, at)[0]), at + 4
        points = np.frombuffer(data, f"{order}f8", 2 * size, at).reshape(size, 2)
        at += 16 * size
        shifted = points - points[0]
        turn = np.sum(shifted[:-1, 0] * shifted[1:, 1] - shifted[1:, 0] * shifted[:-1, 1])
        if (turn > 0) != (index == 0):
            points = points[::-1]
        rings.append([{"x": float(x), "y": float(y)} for x, y in points])
    return rings, at
