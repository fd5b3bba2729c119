"""Queries for projections, filters and scalar work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthway import settings
from hearthway.operators import columns as C
from hearthway.plans import views as V
from hearthway.plans.registry import query


@query(
    "null_over_threshold",
    """select source_id, service, case when ok then duration_min end as duration_min,
 case when ok then wait_time_dest_min end as wait_time_dest_min,
 case when ok then total_time_min end as total_time_min from (
 select *, not (coalesce(wait_time_dest_min >= 60, false) or coalesce(duration_min >= 90, false)) as ok from v_trips) t""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = C.null_over_threshold(V.trips(spark, sf_dir), max_wait=60, max_duration=90)
    return trips.select("source_id", "service", *settings.TIME_COLUMNS)


@query("select_by_substring", "select source_id, service, duration_min, walk_duration from v_trips")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.select_by_substring(V.trips(spark, sf_dir), ["duration"], ["source_id", "service"])


@query(
    "drop_missing",
    "select source_id, service, duration_min from v_trips where duration_min is not null and wait_time_dest_min is not null",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = C.drop_missing(V.trips(spark, sf_dir), ["duration_min", "wait_time_dest_min"])
    return known.select("source_id", "service", "duration_min")


@query(
    "no_connection_rows",
    "select source_id, service, abs_dist from v_trips where duration_min is null and abs_dist > 0",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.no_connection_rows(V.trips(spark, sf_dir)).select("source_id", "service", "abs_dist")


@query("rename_columns", "select zone_id as municipal_id, households, income_low as low from v_census")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = C.rename_columns(V.census(spark, sf_dir), {"zone_id": "municipal_id", "income_low": "low"})
    return renamed.select("municipal_id", "households", "low")


@query(
    "minmax_normalize",
    """select zone_id, (households - min(households) over ()) / (max(households) over () - min(households) over ()) as households_norm,
 (income_low - min(income_low) over ()) / (max(income_low) over () - min(income_low) over ()) as income_low_norm from v_census""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = C.minmax_normalize(V.census(spark, sf_dir), ["households", "income_low"])
    return scaled.select("zone_id", "households_norm", "income_low_norm")


@query(
    "row_sum",
    """select source_id, service, coalesce(duration_min, 0) + coalesce(wait_time_dest_min, 0)
 + coalesce(walk_duration, 0) as minutes from v_trips""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = C.row_sum(V.trips(spark, sf_dir), ["duration_min", "wait_time_dest_min", "walk_duration"], "minutes")
    return trips.select("source_id", "service", "minutes")


def raw_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per nation under the column names of the census files.

    The band of a person follows from the key, the sex from the balance, so every band
    has two columns to be added up.
    """
    key, balance, segment = F.col("c_custkey"), F.col("c_acctbal"), F.col("c_mktsegment")
    ages = {}
    for i, band in enumerate(settings.AGE_BANDS):
        ages[f"men {band} years"] = F.count_if((key % 14 == i) & (balance < 4000))
        ages[f"women {band} years"] = F.count_if((key % 14 == i) & (balance >= 4000))
    steps = [0, 1000, 2000, 3000, 4000, 5000, 7500]
    lows, highs = [None, *steps], [*steps, None]
    incomes = []
    for low, high in zip(lows, highs):
        over = F.lit(True) if low is None else balance >= low
        incomes.append(F.count_if(over if high is None else over & (balance < high)))
    short = {
        "households_with_1_car": F.count_if(segment == "AUTOMOBILE"),
        "households_with_2_cars": F.count_if(segment == "MACHINERY"),
        "households_without_car": F.count_if(~segment.isin("AUTOMOBILE", "MACHINERY")),
        **dict(zip(settings.INCOME_SHARES.values(), incomes)),
        "households_income_50_percentile": F.min("c_custkey"),
        "households_income_80_percentile": F.max("c_custkey"),
        "households": F.count(F.lit(1)),
        "population": F.count(F.lit(1)),
        "students": F.nullif(F.count_if(segment == "BUILDING"), F.lit(0)),
    }
    named = [short[new].cast("double").alias(old) for old, new in settings.CENSUS_NAMES.items()]
    counted = [value.cast("double").alias(name) for name, value in ages.items()]
    return (
        V.table(spark, sf_dir, "customer")
        .groupBy(F.col("c_nationkey").alias("zone_id"))
        .agg(*counted, *named)
    )


_BANDS = ", ".join(
    f"cast(count(*) filter (where c_custkey % 14 = {i}) as double) as \"{band}\""
    for i, band in enumerate(settings.AGE_BANDS)
)
AGES_SQL = f"""select c_nationkey as zone_id, cast(count(*) as double) as population, {_BANDS},
 cast(count(*) filter (where c_custkey % 14 < 12) as double) as adults,
 cast(count(*) filter (where c_custkey % 14 >= 12) as double) as "-17",
 cast(count(*) filter (where c_custkey % 14 < 3) as double) as "18-29",
 cast(count(*) filter (where c_custkey % 14 in (3, 4)) as double) as "30-39",
 cast(count(*) filter (where c_custkey % 14 in (5, 6)) as double) as "40-49",
 cast(count(*) filter (where c_custkey % 14 in (7, 8)) as double) as "50-59",
 cast(count(*) filter (where c_custkey % 14 in (9, 10)) as double) as "60-69" from customer group by c_nationkey"""
_SHARE_INCOMES = [
    ("households_income_under_100k_pct", "c_acctbal < 0"),
    ("households_income_100_150k_pct", "c_acctbal >= 0 and c_acctbal < 1000"),
    ("households_income_150_200k_pct", "c_acctbal >= 1000 and c_acctbal < 2000"),
    ("households_income_200_300k_pct", "c_acctbal >= 2000 and c_acctbal < 3000"),
    ("households_income_300_400k_pct", "c_acctbal >= 3000 and c_acctbal < 4000"),
    ("households_income_400_500k_pct", "c_acctbal >= 4000 and c_acctbal < 5000"),
    ("households_income_500_750k_pct", "c_acctbal >= 5000 and c_acctbal < 7500"),
    ("households_income_750k_pct", "c_acctbal >= 7500"),
    ("households_with_car_pct", "c_mktsegment in ('AUTOMOBILE', 'MACHINERY')"),
    ("households_1car_pct", "c_mktsegment = 'AUTOMOBILE'"),
    ("households_2cars_pct", "c_mktsegment = 'MACHINERY'"),
    ("households_nocar_pct", "c_mktsegment not in ('AUTOMOBILE', 'MACHINERY')"),
    ("-17_pct", "c_custkey % 14 >= 12"),
    ("18-29_pct", "c_custkey % 14 < 3"),
    ("30-39_pct", "c_custkey % 14 in (3, 4)"),
    ("40-49_pct", "c_custkey % 14 in (5, 6)"),
    ("50-59_pct", "c_custkey % 14 in (7, 8)"),
    ("60-69_pct", "c_custkey % 14 in (9, 10)"),
    ("70-_pct", "c_custkey % 14 = 11"),
    ("student_pct", "c_mktsegment = 'BUILDING'"),
]
SHARES_SQL = (
    "select c_nationkey as zone_id, "
    + ", ".join(
        f'cast(count(*) filter (where {rule}) as double) / cast(count(*) as double) * 100 as "{name}"'
        for name, rule in _SHARE_INCOMES
    )
    + " from customer group by c_nationkey"
)
SHARE_NAMES = [name for name, _ in _SHARE_INCOMES]


@query("collapse_age_columns", AGES_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.collapse_age_columns(raw_census(spark, sf_dir), settings.CENSUS_POPULATION)
    groups = ["adults", *settings.AGE_BANDS, "-17", *settings.AGE_MERGES]
    return out.select(
        "zone_id", F.col(f"`{settings.CENSUS_POPULATION}`").alias("population"), *[F.col(f"`{g}`") for g in groups]
    )


@query(
    "share_of_total",
    """select zone_id, households_with_1_car / households * 100 as households_1car_pct,
 (households_with_1_car + households_with_2_cars) / households * 100 as households_with_car_pct from v_census""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {
        "households_1car_pct": "households_with_1_car",
        "households_with_car_pct": ["households_with_1_car", "households_with_2_cars"],
    }
    return C.share_of_total(V.census(spark, sf_dir), parts, "households").select("zone_id", *parts)


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    aged = C.collapse_age_columns(raw_census(spark, sf_dir), settings.CENSUS_POPULATION)
    return C.census_shares(C.rename_columns(aged, settings.CENSUS_NAMES))


@query("census_shares", SHARES_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(spark, sf_dir).select("zone_id", *[F.col(f"`{n}`") for n in SHARE_NAMES])


@query(
    "derived_groups",
    f"""select zone_id, u as households_income_under_150k_pct,
 u + households_income_150_200k_pct + households_income_200_300k_pct as low_income_pct,
 households_income_300_400k_pct + households_income_400_500k_pct as medium_income_pct,
 households_income_500_750k_pct + households_income_750k_pct as high_income_pct from (
 select *, households_income_under_100k_pct + households_income_100_150k_pct as u from ({SHARES_SQL}) s) t""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.derived_groups(shares(spark, sf_dir)).select("zone_id", *settings.INCOME_GROUPS)


@query(
    "area_key",
    """select s_suppkey, cast(concat(substr(cast(s_nationkey + 1000 as varchar), 2), '0', s_suppkey) as integer) as area_id
 from supplier""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = C.area_key(F.col("s_nationkey") + 1000, F.col("s_suppkey"))
    return V.table(spark, sf_dir, "supplier").select("s_suppkey", key.alias("area_id"))


@query("polygon_area_km2", "select zone_id, (maxx - minx) * (maxy - miny) / 1000000 as area_sqkm from v_zones")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.polygon_area_km2(V.zones(spark, sf_dir)).select("zone_id", "area_sqkm")


@query("polygon_centroid", "select zone_id, (minx + maxx) / 2 as x, (miny + maxy) / 2 as y from v_zones")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.centroids(V.zones(spark, sf_dir)).select("zone_id", "x", "y")


@query(
    "population_density",
    """select zone_id, cast(coalesce(households, 0) as integer) / ((maxx - minx) * (maxy - miny) / 1000000) as population_density
 from v_zones left join v_census using (zone_id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = V.census(spark, sf_dir).select("zone_id", F.col("households").alias("population"))
    areas = V.zones(spark, sf_dir).join(people, "zone_id", "left")
    return C.population_density(areas).select("zone_id", "population_density")


@query(
    "weight_lookup",
    """select source_id, service, cast(case service when 'doctor' then 0.0625 when 'school' then 5 when 'supermarket' then 5
 when 'library' then 1 else 1 end as double) as weight from v_trips""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = {k: v for k, v in V.WEIGHTS.items() if k != "train_station"}
    return C.weight_lookup(V.trips(spark, sf_dir), some).select("source_id", "service", "weight")


@query(
    "enumerate_datasets",
    """select service, cast(unnest(generate_series(1, max(transfers))) as integer) as neighbor,
 concat(service, '_', unnest(generate_series(1, max(transfers)))) as dataset from v_trips group by service""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    services = V.trips(spark, sf_dir).groupBy("service").agg(F.max("transfers").alias("n_neighbors"))
    return C.enumerate_datasets(services)


@query(
    "round_report",
    "select service, round_even(avg(duration_min), 2) as mean_duration, count(*) as n from v_trips group by service",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = V.trips(spark, sf_dir).groupBy("service").agg(
        F.avg("duration_min").alias("mean_duration"), F.count(F.lit(1)).alias("n")
    )
    return C.round_report(means)


@query("missing_weights", "select distinct service from v_trips where service in ('library', 'school')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = {k: v for k, v in V.WEIGHTS.items() if k not in ("library", "school")}
    return C.missing_weights(V.trips(spark, sf_dir), some)


@query(
    "check_invariants",
    """select count(*) = 1500000 as rows_kept, count(*) filter (where c_nationkey is null) = 0 as c_nationkey_present,
 max(c_acctbal) <= 100 as c_acctbal_at_most_100, count(distinct c_custkey) = count(*) as c_custkey_unique from customer""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.check_invariants(
        V.table(spark, sf_dir, "customer"),
        key="c_custkey",
        expected_rows=1_500_000,
        not_null=["c_nationkey"],
        at_most_100=["c_acctbal"],
    )


@query(
    "check_invariants_orders",
    """select count(*) = (select count(*) from orders) as rows_kept, count(*) filter (where o_custkey is null) = 0 as o_custkey_present,
 count(*) filter (where doubted is null) = 0 as doubted_present, round(max(coalesce(sure, 0) + coalesce(rest, 0)), 0) = 100 as shares_add_up,
 max(sure) <= 100 as sure_at_most_100, max(over) <= 100 as over_at_most_100, count(distinct o_orderkey) = count(*) as o_orderkey_unique from (
 select *, o_orderkey % 100 as sure, 100 - o_orderkey % 100 as rest, o_orderkey % 100 + 50 as over, case when o_orderkey % 17 > 0 then 1 end as doubted from orders) o""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that hold beside facts that do not."""
    orders = V.table(spark, sf_dir, "orders")
    rest = F.col("o_orderkey") % 100
    shares = orders.withColumns({"sure": rest, "rest": 100 - rest, "over": rest + 50, "doubted": F.when(F.col("o_orderkey") % 17 > 0, 1)})
    return C.check_invariants(
        shares,
        key="o_orderkey",
        expected_rows=orders.count(),
        not_null=["o_custkey", "doubted"],
        total_100=["sure", "rest"],
        at_most_100=["sure", "over"],
    )
