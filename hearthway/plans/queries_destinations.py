"""Queries for destinations, travel modes and trip legs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthway import settings
from hearthway.functions.scalar import local_time_text
from hearthway.operators import destinations as D
from hearthway.operators import grid
from hearthway.operators import reshape as R
from hearthway.plans import views as V
from hearthway.plans.registry import query

TYPES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Homes read as destinations: a place and a type."""
    types = V.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("type")
    )
    return V.points(spark, sf_dir).join(types, "source_id")


_KINDS = ", ".join(
    f"max({c}) filter (where service = '{s}') as {s}_1_{c}"
    for s in V.SERVICES
    for c in ["duration_min", "transfers"]
)


@query("combine_results", f"select source_id, {_KINDS} from v_trips group by source_id")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.combine_results(V.trips(spark, sf_dir), ["duration_min", "transfers"], V.SERVICES)


@query("transfers_from_modes", "select l_orderkey, 1 as transfers from v_modes")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.transfers_from_modes(V.modes(spark, sf_dir), "mode_durations_json").select("l_orderkey", "transfers")


@query(
    "transfers_from_props",
    """select event_id, cast(greatest(0, len(json_keys(props)) - 1) as integer) as transfers from events""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.transfers_from_modes(V.table(spark, sf_dir, "events"), "props").select("event_id", "transfers")


@query(
    "modes_to_columns",
    """select l_orderkey, cast(walk as double) as walk_duration, cast(bus as double) as bus_duration,
 cast(rail as double) as rail_duration from v_modes""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.modes_to_columns(V.modes(spark, sf_dir), "mode_durations_json").drop("mode_durations_json")


_CODES = settings.SERVICE_CODES
CODE_SQL = "case (p_partkey % 20) " + " ".join(
    f"when {i} then {code}" for i, code in enumerate(c for codes in _CODES.values() for c in codes)
) + " else 0 end"


@query(
    "service_of_code",
    f"select p_partkey, case {CODE_SQL} "
    + " ".join(f"when {code} then '{s}'" for s, codes in _CODES.items() for code in codes)
    + " end as service from part",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = V.table(spark, sf_dir, "part").select("p_partkey", F.expr(CODE_SQL).alias("code"))
    return D.service_of_code(parts, "code").drop("code")


@query(
    "first_code_of_service",
    "select source_id, service, case service "
    + " ".join(f"when '{s}' then {codes[0]}" for s, codes in _CODES.items())
    + " end as code from v_trips",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.first_code_of_service(V.trips(spark, sf_dir).select("source_id", "service"), "service")


def _components(distance: int, same_type: bool) -> str:
    """Components by repeated spread of labels along near pairs, then their means."""
    typed = " and a.type = b.type" if same_type else ""
    return f"""with recursive d as (select p.*, c_mktsegment as type from v_points p join customer on c_custkey = source_id),
 e as (select a.source_id as i, b.source_id as j from d a, d b where
  (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {distance * distance}{typed}),
 reach as (select i, j from e union select r.i, e.j from reach r join e on e.i = r.j),
 g as (select i as source_id, min(j) as component from reach group by i)
 select component as first_key, round(avg(x), 6) as x, round(avg(y), 6) as y, count(*) as members,
  arg_min(type, source_id) as type from g join d using (source_id) group by component"""


@query("merge_close_points", _components(1800, False))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = D.merge_close_points(destinations(spark, sf_dir), 1800.0, "source_id", ["type"])
    return merged.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query("merge_close_by_type", _components(5000, True))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = D.merge_close_points(destinations(spark, sf_dir), 5000.0, "source_id", type_column="type")
    return merged.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


_TYPE_COUNTS = ", ".join(f"count(*) filter (where c_mktsegment = '{t}') as \"{t}\"" for t in TYPES)


@query(
    "destination_counts_by_hex",
    "select grid_id, "
    + ", ".join(f'coalesce("{t}", 0) as "{t}"' for t in TYPES)
    + f""" from v_cells left join (select grid_id, {_TYPE_COUNTS} from v_hex join customer on c_custkey = source_id
 where c_acctbal > 0 group by grid_id) c using (grid_id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid.used_cells(V.points(spark, sf_dir), V.CELL_SIZE)
    solvent = V.table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("source_id"))
    places = destinations(spark, sf_dir).join(solvent, "source_id")
    return D.destination_counts_by_hex(places, cells, "type", TYPES, V.CELL_SIZE)


@query(
    "destination_counts_by_zone",
    f"""select case when grouping(zone_name) = 1 then 'Total' else zone_name end as zone_name, {_TYPE_COUNTS}
 from v_points join v_zones on x between minx and maxx and y between miny and maxy join customer on c_custkey = source_id
 group by rollup(zone_name)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.destination_counts_by_zone(destinations(spark, sf_dir), V.zones(spark, sf_dir), "zone_name", "type", TYPES)


@query(
    "mode_durations",
    """select l_orderkey, key as mode, value as duration from (
 select l_orderkey, l_returnflag as key, sum(l_quantity) as value from lineitem group by l_orderkey, l_returnflag) t""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = V.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_returnflag").alias("mode"), F.col("l_quantity").alias("duration")
    )
    return D.mode_durations(legs, "l_orderkey").select("l_orderkey", F.explode("mode_durations").alias("mode", "duration"))


@query(
    "local_time_text",
    """select event_id, case when event_id % 5 = 0 then null else
 strftime((ts at time zone 'UTC') at time zone 'Europe/Copenhagen', '%Y-%m-%d %H:%M') end as local from events""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.table(spark, sf_dir, "events")
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    millis = F.when(F.col("event_id") % 5 == 0, F.lit(0)).otherwise(seconds * 1000)
    return events.select("event_id", local_time_text(millis, settings.LOCAL_TIME_ZONE).alias("local"))


@query("sample_rows", "select * from v_points order by md5(concat('13:', source_id)), source_id limit 300")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sample_rows(V.points(spark, sf_dir), 300, 13, "source_id")


@query(
    "source_difference",
    """with a as (select grid_id, count(*) filter (where c_acctbal > 5000) as n from v_hex join customer on c_custkey = source_id group by grid_id),
 b as (select grid_id, count(*) filter (where c_mktsegment = 'BUILDING') as n from v_hex join customer on c_custkey = source_id group by grid_id)
 select grid_id, nullif(coalesce(a.n, 0), 0) as n_a, nullif(coalesce(b.n, 0), 0) as n_b, coalesce(a.n, 0) - coalesce(b.n, 0) as n_diff
 from a full join b using (grid_id) where coalesce(a.n, 0) > 0 or coalesce(b.n, 0) > 0""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = grid.bin_points(destinations(spark, sf_dir), V.CELL_SIZE)
    rich = V.table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("source_id"))
    a = binned.join(rich, "source_id").groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"))
    b = binned.filter(F.col("type") == "BUILDING").groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"))
    return D.source_difference(a, b, "grid_id", ["n"])


_THREE = ["households_with_1_car", "households_with_2_cars", "households_without_car"]


@query(
    "flag_second_largest",
    """select zone_id, cast(v as double) as second, string_agg(c, ',' order by o) as columns from (
 select *, list_sort([households_with_1_car, households_with_2_cars, households_without_car], 'DESC')[2] as v from v_census) t,
 lateral (values (1, 'households_with_1_car', households_with_1_car), (2, 'households_with_2_cars', households_with_2_cars),
  (3, 'households_without_car', households_without_car)) l(o, c, n) where n = v group by zone_id, v""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.flag_second_largest(V.census(spark, sf_dir), "zone_id", _THREE)


@query(
    "destination_types",
    """select c_mktsegment as type from customer union select n_name from nation order by type""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = V.table(spark, sf_dir, "nation").select(F.col("n_name").alias("type"))
    return D.destination_types(destinations(spark, sf_dir), others, "type")
