"""Queries for whole analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthway.operators import clustering as L
from hearthway.plans import views as V
from hearthway.plans.access import access_tables, home_zones
from hearthway.plans.analysis import analysis_table, cluster_zones
from hearthway.plans.census import voting_areas
from hearthway.plans.queries_aggregates import _profile_sql, profile
from hearthway.plans.queries_columns import SHARES_SQL, raw_census
from hearthway.plans.queries_joins import hex_cells
from hearthway.plans.registry import query


@query("home_zones", "select source_id, x, y, grid_id, zone_id from v_hex join v_assigned using (source_id)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return home_zones(V.points(spark, sf_dir), V.zones(spark, sf_dir), "zone_id", V.CELL_SIZE)


@query(
    "access_with_limits",
    """select grid_id, avg(total_duration) as avg_total_duration, avg(total_wait_time) as avg_total_wait_time,
 avg(total_duration + total_wait_time) as avg_total_time from (
 select source_id, sum(case when ok then duration_min end) as total_duration,
  sum(case when ok then wait_time_dest_min end) as total_wait_time from (
  select *, not (coalesce(wait_time_dest_min >= 80, false) or coalesce(duration_min >= 120, false)) as ok from v_trips) t
 group by source_id) h join v_hex using (source_id) group by grid_id""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = home_zones(V.points(spark, sf_dir), V.zones(spark, sf_dir), "zone_id", V.CELL_SIZE)
    trips = V.trips(spark, sf_dir).withColumn("neighbor", F.lit(1))
    tables = access_tables(trips, zones, "zone_id", V.SERVICES, V.WEIGHTS, max_wait=80, max_duration=120)
    return tables["hex_total_travel_times"]


@query(
    "voting_areas",
    f"""select zone_id, zone_name, s.* exclude (zone_id), households / ((maxx - minx) * (maxy - miny) / 1000000) as population_density
 from ({SHARES_SQL}) s join v_census using (zone_id) join v_zones using (zone_id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = voting_areas(raw_census(spark, sf_dir), V.zones(spark, sf_dir).select("zone_id", "zone_name", "rings"), "zone_id")
    shares = [c for c in areas.columns if c.endswith("_pct") and c not in
              ("households_income_under_150k_pct", "low_income_pct", "medium_income_pct", "high_income_pct")]
    return areas.select("zone_id", "zone_name", *[F.col(f"`{c}`") for c in shares], "population_density")


@query(
    "analysis_table",
    "select grid_id, total_observations, "
    + ", ".join(
        f"{m}_{s}_1_ave"
        for s in V.SERVICES
        for m in ["duration_min", "wait_time_dest_min", "total_time_min", "abs_dist"]
    )
    + ", "
    + ", ".join(f"no_connection_count_{s}_1" for s in V.SERVICES)
    + f" from ({_profile_sql('grid_id', 'v_hex')}) p",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis_table(profile(spark, sf_dir), hex_cells(spark, sf_dir), None).drop("rings")


@query("cluster_zones")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = analysis_table(profile(spark, sf_dir), hex_cells(spark, sf_dir), V.islands(spark, sf_dir))
    labelled, variables = cluster_zones(table)
    return L.cluster_profile(labelled, "label", variables)
