"""From trips and homes to zone tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthway import settings
from hearthway.operators import aggregates as A
from hearthway.operators import columns as C
from hearthway.operators.grid import bin_points
from hearthway.operators.joins import merge_zone_maps
from hearthway.operators.spatial import assign_zone
from hearthway.session import cut_lineage


def home_zones(
    homes: DataFrame, municipalities: DataFrame, key: str, cell_size: float, fallback: float = settings.FALLBACK_METRES
) -> DataFrame:
    """(source_id, x, y, grid_id, municipality): one row per home."""
    cells = bin_points(homes.select("source_id", "x", "y"), cell_size)
    areas = assign_zone(homes.select("source_id", "x", "y"), municipalities, key, fallback).select("source_id", key)
    return merge_zone_maps(cells, areas)


def access_tables(
    trips: DataFrame,
    zones: DataFrame,
    zone_key: str,
    services: list[str] = settings.SERVICES,
    weights: Mapping[str, float] = settings.SERVICE_WEIGHTS,
    max_wait: float | None = None,
    max_duration: float | None = None,
) -> dict[str, DataFrame]:
    """All result tables of the access analysis, by name.

    `zones` maps homes to `grid_id` and `zone_key`. Connections are counted before the thresholds and
    everything else after them. The summaries list every neighbour; the other tables take the nearest.
    """
    if without := set(services) - set(weights):
        raise ValueError(f"no weight for {sorted(without)}")
    wanted = trips.filter(F.col("service").isin(services))
    kept = C.null_over_threshold(wanted, max_wait, max_duration)
    homes = cut_lineage(zones)
    tables = {
        "connection_counts": A.connection_counts(wanted),
        "service_summary": A.service_summary(kept),
        "hex_travel_times": A.zone_profile(kept, homes, "grid_id", services=services),
        "municipal_travel_times": A.zone_profile(kept, homes, zone_key, services=services),
        "total_travel_times": A.total_times(kept),
    }
    tables["hex_total_travel_times"] = A.zone_total_avg(tables["total_travel_times"], homes)
    for time in ["duration_min", "total_time_min"]:
        tables[f"weighted_{time}"] = A.weighted_time(kept, services, weights, time)
        tables[f"hex_weighted_{time}"] = A.zone_weighted_avg(tables[f"weighted_{time}"], homes)
    return tables
