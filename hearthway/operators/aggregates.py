"""Summaries of trips, homes and zones.

Everything here combines partially before its shuffle; exact medians and percentiles go
through `ranking`, which spreads a group over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthway import settings
from hearthway.functions import geometry as G
from hearthway.functions.scalar import numeric_columns, sum_missing_as_zero
from hearthway.operators.columns import names_containing, weight_lookup, with_global
from hearthway.operators.joins import attach_zone, widen
from hearthway.operators.ranking import grouped_quantiles


def dataset_keys(trips: DataFrame) -> list[str]:
    """What tells the trip tables apart: the service, and the neighbour where the table has it."""
    return ["service"] + ["neighbor"] * ("neighbor" in trips.columns)


def service_summary(trips: DataFrame) -> DataFrame:
    """Per service and neighbour: smallest, mean, largest and median times, median and largest transfers."""
    keys = dataset_keys(trips)
    measures = {"duration_min": "duration", "wait_time_dest_min": "wait_time", "transfers": "transfers"}
    simple = trips.groupBy(*keys).agg(
        *[
            function(column).alias(f"{prefix}_{name}")
            for column, name in list(measures.items())[:2]
            for prefix, function in [("min", F.min), ("mean", F.avg), ("max", F.max)]
        ],
        F.max("transfers").cast("int").alias("max_transfers"),
    )
    long = trips.select(*keys, *[F.col(c).cast("double").alias(n) for c, n in measures.items()]).unpivot(
        keys, list(measures.values()), "measure", "value"
    )
    medians = widen(
        grouped_quantiles(long, [*keys, "measure"], "value", [0.5]).withColumnRenamed("quantile", "median"),
        keys,
        "measure",
        list(measures.values()),
        ["median"],
    )
    named = medians.select(
        *keys,
        F.col("duration_median").alias("median_duration"),
        F.col("wait_time_median").alias("median_wait_time"),
        F.col("transfers_median").cast("int").alias("median_transfers"),
    )
    return simple.join(named, keys, "left")


def connection_counts(trips: DataFrame) -> DataFrame:
    """Solved and unsolved rows and mean times per service and neighbour, before any threshold."""
    return trips.groupBy(*dataset_keys(trips)).agg(
        F.count_if(F.col("duration_min").isNotNull()).alias("solved"),
        F.count_if(F.col("duration_min").isNull()).alias("unsolved"),
        F.avg("duration_min").alias("mean_duration"),
        F.avg("wait_time_dest_min").alias("mean_wait_time"),
    )


def of_neighbor(trips: DataFrame, neighbor: int) -> DataFrame:
    """The trips to one of a home's nearest places; all of them where the table does not tell."""
    return trips.where(F.col("neighbor") == neighbor) if "neighbor" in trips.columns else trips


def weighted_time(
    trips: DataFrame,
    services: list[str] = settings.SERVICES,
    weights: Mapping[str, float] = settings.SERVICE_WEIGHTS,
    time_column: str = "total_time_min",
    neighbor: int = 1,
) -> DataFrame:
    """Travel time and weighted time per home and service, and their weighted total.

    A missing time counts as 0 in the total; a home without any time has total 0.
    """
    timed = weight_lookup(of_neighbor(trips, neighbor), weights).select(
        "source_id",
        "service",
        F.col(time_column).alias("travel_time"),
        (F.col(time_column) * F.col("weight")).alias("weighted_time"),
    )
    wide = widen(timed, ["source_id"], "service", services, ["travel_time", "weighted_time"])
    tagged = wide.withColumnsRenamed(
        {f"{s}_{c}": f"{s}_{neighbor}_{c}" for s in services for c in ["travel_time", "weighted_time"]}
    )
    total = sum_missing_as_zero([f"{s}_{neighbor}_weighted_time" for s in services])
    return tagged.withColumn("total_weighted_time", total)


def zone_weighted_avg(weighted: DataFrame, zone_map: DataFrame, zone_key: str = "grid_id") -> DataFrame:
    located = attach_zone(weighted.select("source_id", "total_weighted_time"), zone_map.select("source_id", zone_key))
    return located.groupBy(zone_key).agg(F.avg("total_weighted_time").alias("avg_total_weighted_time"))


def total_times(trips: DataFrame, neighbor: int = 1) -> DataFrame:
    """Sums over all services per home; NULL only where every service is missing."""
    sums = of_neighbor(trips, neighbor).groupBy("source_id").agg(
        F.sum("duration_min").alias("total_duration"), F.sum("wait_time_dest_min").alias("total_wait_time")
    )
    return sums.withColumn("total_time_min", F.col("total_duration") + F.col("total_wait_time"))


def zone_total_avg(totals: DataFrame, zone_map: DataFrame, zone_key: str = "grid_id") -> DataFrame:
    located = attach_zone(totals, zone_map.select("source_id", zone_key))
    return located.groupBy(zone_key).agg(
        F.avg("total_duration").alias("avg_total_duration"),
        F.avg("total_wait_time").alias("avg_total_wait_time"),
        F.avg("total_time_min").alias("avg_total_time"),
    )


def trip_measures(trips: DataFrame) -> list[str]:
    """The fixed measures that are present and every numeric `*_duration` column."""
    fixed = [c for c in settings.TRIP_MEASURES if c in trips.columns]
    return fixed + [c for c in names_containing(trips, ["_duration"]) if c not in fixed]


def zone_profile(
    trips: DataFrame,
    zone_map: DataFrame,
    zone_key: str,
    measures: list[str] | None = None,
    services: list[str] = settings.SERVICES,
    neighbor: int = 1,
    require_all: bool = True,
) -> DataFrame:
    """Wide zone table: means and missing connections per service, homes per zone.

    Rows are averaged per (zone, service) straight after the join; only that small result
    is spread into columns. With `require_all` a zone lacking any service is dropped.
    """
    measures = trip_measures(trips) if measures is None else measures
    located = attach_zone(
        of_neighbor(trips, neighbor).select("source_id", "service", *measures), zone_map.select("source_id", zone_key)
    )
    cells = located.groupBy(zone_key, "service").agg(
        *[F.avg(m).alias(m) for m in measures],
        F.count_if(F.col("duration_min").isNull()).alias("no_connection_count"),
        F.count(F.lit(1)).alias("rows"),
    )
    wide = widen(cells, [zone_key], "service", services, [*measures, "no_connection_count", "rows"])
    if require_all:
        wide = wide.na.drop(subset=[f"{s}_rows" for s in services])
    columns = []
    for s in services:
        columns += [F.col(f"{s}_{m}").alias(f"{m}_{s}_{neighbor}_ave") for m in measures]
        columns.append(F.col(f"{s}_no_connection_count").alias(f"no_connection_count_{s}_{neighbor}"))
    return wide.select(zone_key, *columns, F.col(f"{services[0]}_rows").alias("total_observations"))


def observation_count(trips: DataFrame, zone_map: DataFrame, zone_key: str, service: str) -> DataFrame:
    """Homes per zone, counted on one service."""
    one = trips.filter(F.col("service") == service).select("source_id")
    located = attach_zone(one, zone_map.select("source_id", zone_key))
    return located.groupBy(zone_key).agg(F.count(F.lit(1)).alias("total_observations"))


def describe_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(variable, count, mean, std, min, p25, p50, p75, max) with exact percentiles."""
    columns = columns or numeric_columns(df)
    long = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "variable", "value"
    )
    simple = long.groupBy("variable").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    points = {0.25: "p25", 0.5: "p50", 0.75: "p75"}
    shares = grouped_quantiles(long, ["variable"], "value", list(points)).groupBy("variable").agg(
        *[F.max(F.when(F.col("q") == q, F.col("quantile"))).alias(name) for q, name in points.items()]
    )
    return simple.join(shares, "variable", "left")


def group_sizes(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("size"))


def group_areas(zones: DataFrame, column: str) -> DataFrame:
    """Square kilometres per group."""
    area = G.polygon_area(G.polygon_edges(F.col("rings"))) / 10**6
    return zones.select(column, area.alias("area")).groupBy(column).agg(F.sum("area").alias("area_sqkm"))


def group_share_pct(zones: DataFrame, column: str) -> DataFrame:
    """Number of zones and their area per group, in percent of all."""
    area = G.polygon_area(G.polygon_edges(F.col("rings"))) / 10**6
    groups = zones.select(column, area.alias("area")).groupBy(column).agg(
        F.count(F.lit(1)).alias("size"), F.sum("area").alias("area_sqkm")
    )
    shares = with_global(groups, "_all", size=F.sum("size"), area=F.sum("area_sqkm"))
    return shares.select(
        column,
        F.try_divide(F.col("size") * 100.0, F.col("_all.size")).alias("size_pct"),
        F.try_divide(F.col("area_sqkm") * 100.0, F.col("_all.area")).alias("area_pct"),
    )


def group_means(df: DataFrame, column: str, variables: list[str], groups: list) -> DataFrame:
    """Mean of each variable per group: one row per variable, one column per group."""
    means = df.groupBy(column).agg(*[F.avg(F.col(f"`{v}`")).alias(v) for v in variables])
    long = means.unpivot([column], variables, "variable", "mean")
    return long.groupBy("variable").agg(
        *[F.max(F.when(F.col(column) == g, F.col("mean"))).alias(f"{column}_{g}") for g in groups]
    )


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Counts in equal-width bins (bin, lower, upper, count); the last bin is closed.

    Empty bins are kept, and a constant column gets a range of width 1. The bins are rows of a generated range, joined to the counts.
    """
    value = F.col(column).cast("double")
    values = df.filter(value.isNotNull()).select(value.alias("v"))
    pad = F.when(F.min("v") == F.max("v"), F.lit(0.5)).otherwise(F.lit(0.0))
    limits = values.agg(
        F.struct((F.min("v") - pad).alias("lo"), (F.max("v") + pad).alias("hi")).alias("s")
    ).scalar()
    width = (F.col("_limits.hi") - F.col("_limits.lo")) / bins
    place = F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("_limits.lo"), width)), F.lit(0))
    counts = (
        values.withColumn("_limits", limits)
        .groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("_limits", limits)
    return every.join(counts, "bin", "left").select(
        "bin",
        (F.col("_limits.lo") + F.col("bin") * width).alias("lower"),
        (F.col("_limits.lo") + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count_distinct(key).alias("distinct_keys"))
