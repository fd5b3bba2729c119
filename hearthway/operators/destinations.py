"""Destinations (places that offer a service), travel modes and trip legs."""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthway import settings
from hearthway.functions.scalar import lookup, parse_modes, transfers_of
from hearthway.operators.grid import bin_points
from hearthway.operators.aggregates import of_neighbor
from hearthway.operators.equi import equi_join
from hearthway.operators.graph import star_components
from hearthway.operators.joins import widen
from hearthway.operators.spatial import spatial_join
from hearthway.session import cut_lineage


def combine_results(trips: DataFrame, columns: list[str], services: list[str], neighbor: int = 1) -> DataFrame:
    """One row per home with the chosen columns of all services, `{service}_{n}_{column}`."""
    wide = widen(of_neighbor(trips, neighbor), ["source_id"], "service", services, columns)
    return wide.withColumnsRenamed({f"{s}_{c}": f"{s}_{neighbor}_{c}" for s in services for c in columns})


def transfers_from_modes(df: DataFrame, json_column: str, out: str = "transfers") -> DataFrame:
    return df.withColumn(out, transfers_of(F.col(json_column)))


def mode_names(df: DataFrame, json_column: str) -> list[str]:
    """Lower-case names of all modes; a distinct list, short by nature."""
    names = df.select(F.explode(F.map_keys(parse_modes(F.col(json_column)))).alias("mode"))
    return [r["mode"] for r in names.select(F.lower("mode").alias("mode")).distinct().orderBy("mode").collect()]


def modes_to_columns(df: DataFrame, json_column: str, modes: list[str] | None = None) -> DataFrame:
    """A column `{mode}_duration` per mode, 0 where the row does not use it.

    Rows are widened in place: no explode and no shuffle.
    """
    modes = mode_names(df, json_column) if modes is None else modes
    entries = F.map_entries(parse_modes(F.col(json_column)))

    def seconds(mode: str):
        mine = F.filter(F.col("_modes"), lambda e: F.lower(e["key"]) == mode)
        total = F.aggregate(mine, F.lit(0.0), lambda acc, e: acc + F.coalesce(e["value"], F.lit(0.0)))
        return F.coalesce(total, F.lit(0.0))

    wide = df.withColumn("_modes", entries)
    return wide.withColumns({f"{m}_duration": seconds(m) for m in modes}).drop("_modes")


def mode_durations(legs: DataFrame, key: str) -> DataFrame:
    """Seconds per mode over the legs (key, mode, duration) of each trip, as a map."""
    sums = legs.groupBy(key, "mode").agg(F.sum("duration").alias("duration"))
    listed = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("mode", "duration"))).alias("m"))
    return listed.select(key, F.map_from_entries("m").alias("mode_durations"))


def service_of_code(
    df: DataFrame, code: str, services: Mapping[str, list[int]] = settings.SERVICE_CODES, out: str = "service"
) -> DataFrame:
    """The service an industry code belongs to (the first that lists it), else NULL."""
    owner = {}
    for service, codes in services.items():
        for c in codes:
            owner.setdefault(c, service)
    return df.withColumn(out, lookup(owner, F.col(code)))


def first_code_of_service(
    df: DataFrame, service: str, services: Mapping[str, list[int]] = settings.SERVICE_CODES, out: str = "code"
) -> DataFrame:
    return df.withColumn(out, lookup({s: codes[0] for s, codes in services.items() if codes}, F.col(service)))


def destination_types(a: DataFrame, b: DataFrame, type_column: str) -> DataFrame:
    return a.select(type_column).unionByName(b.select(type_column)).distinct().orderBy(type_column)


def _counts(df: DataFrame, keys: list[str], type_column: str, types: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(F.col(type_column) == t).alias(str(t)) for t in types])


def destination_counts_by_hex(
    points: DataFrame, cells: DataFrame, type_column: str, types: list[str], cell_size: float
) -> DataFrame:
    """Destinations of each type in every cell of `cells` (grid_id), 0 where there are none."""
    counts = _counts(bin_points(points, cell_size), ["grid_id"], type_column, types)
    return cells.select("grid_id").join(counts, "grid_id", "left").na.fill(0, [str(t) for t in types])


def destination_counts_by_zone(
    points: DataFrame, zones: DataFrame, key: str, type_column: str, types: list[str]
) -> DataFrame:
    """Destinations of each type per zone that has any, and a row "Total"."""
    located = spatial_join(points, zones.select(key, "rings"), key, "inner")
    per_zone = located.groupBy(F.col(key).cast("string").alias(key), type_column).agg(F.count(F.lit(1)).alias("_n"))
    sums = [F.coalesce(F.sum(F.when(F.col(type_column) == t, F.col("_n"))), F.lit(0)).alias(str(t)) for t in types]
    rolled = per_zone.rollup(key).agg(F.grouping(key).alias("_total"), *sums)
    return rolled.withColumn(key, F.when(F.col("_total") == 1, "Total").otherwise(F.col(key))).drop("_total")


def source_difference(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Counts of two sources per cell and their difference.

    Cells that neither source covers in any column are dropped; a zero count is NULL.
    """
    left = a.select(key, *[F.col(c).alias(f"{c}_a") for c in columns])
    right = b.select(key, *[F.col(c).alias(f"{c}_b") for c in columns])
    both = left.join(right, key, "full").na.fill(0)
    some = reduce(lambda x, y: x | y, [(F.col(f"{c}_a") > 0) | (F.col(f"{c}_b") > 0) for c in columns])
    shown = []
    for c in columns:
        shown += [
            F.nullif(F.col(f"{c}_a"), F.lit(0)).alias(f"{c}_a"),
            F.nullif(F.col(f"{c}_b"), F.lit(0)).alias(f"{c}_b"),
            (F.col(f"{c}_a") - F.col(f"{c}_b")).alias(f"{c}_diff"),
        ]
    return both.filter(some).select(key, *shown)


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) of an undirected graph; the component is its smallest id."""
    stars = star_components(links).select(F.col("node").alias("id"), "root")
    return nodes.select("id").join(stars, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def merge_close_points(
    points: DataFrame, distance: float, key: str, inherit: list[str] = (), type_column: str | None = None
) -> DataFrame:
    """One point per group of points linked by steps of at most `distance`.

    A group is a connected component of the within-distance graph, so the result does not
    depend on row order. It gets the mean of its distinct places and the `inherit` values
    of its lowest key: (first_key, x, y, members, inherit...). With `type_column` only
    points of one type are linked.

    Points of a square with diagonal `distance` always belong together, so squares are the
    nodes of the graph and pairs inside one are never formed. Two squares are linked when
    some point of one has a point of the other in reach; that is a semi join, which stops
    at the first hit, on the points that can reach the other square's occupied box at all.
    """
    side = distance / math.sqrt(2.0)
    kind = F.lit("") if type_column is None else F.col(type_column).cast("string")
    kept = [*inherit] + ([type_column] if type_column and type_column not in inherit else [])

    def node(cx, cy):
        return F.concat_ws("|", F.col("_kind"), cx.cast("string"), cy.cast("string"))

    places = (
        points.withColumns({"_kind": kind, "_cx": F.floor(F.col("x") / side), "_cy": F.floor(F.col("y") / side)})
        .groupBy("_kind", "_cx", "_cy", "x", "y")
        .agg(F.min(F.struct(F.col(key).alias("first_key"), *kept)).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("id", node(F.col("_cx"), F.col("_cy")))
    )
    places = cut_lineage(places)
    boxes = places.groupBy("id").agg(
        F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1")
    )
    steps = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps])
    tries = places.select(F.col("id").alias("a"), "_kind", "_cx", "_cy", "x", "y", F.explode(around).alias("s")).select(
        "a", "x", "y", node(F.col("_cx") + F.col("s.dx"), F.col("_cy") + F.col("s.dy")).alias("b")
    )
    off_x = F.greatest(F.col("_x0") - F.col("x"), F.lit(0.0), F.col("x") - F.col("_x1"))
    off_y = F.greatest(F.col("_y0") - F.col("y"), F.lit(0.0), F.col("y") - F.col("_y1"))
    able = equi_join(tries, boxes.withColumnRenamed("id", "b"), ["b"]).filter(
        off_x * off_x + off_y * off_y <= distance * distance
    )
    there = places.select(F.col("id").alias("b"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    gap = dx * dx + dy * dy
    links = equi_join(able.select("a", "b", "x", "y"), there, ["b"], "left_semi", gap <= distance * distance)
    groups = connected_components(boxes.select("id"), links.select("a", "b").distinct())

    merged = equi_join(places.select("id", "x", "y", "_first", "_n"), groups, ["id"]).groupBy("component").agg(
        F.min("_first").alias("_first"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.sum("_n").alias("members")
    )
    return merged.select(
        F.col("_first.first_key").alias("first_key"), "x", "y", "members", *[F.col(f"_first.{c}").alias(c) for c in kept]
    )
