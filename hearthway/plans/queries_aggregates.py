"""Queries for summaries, reshaping and classes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthway import settings
from hearthway.operators import aggregates as A
from hearthway.operators import classify as K
from hearthway.operators import columns as C
from hearthway.operators import reshape as R
from hearthway.operators import spatial as S
from hearthway.operators.correlation import correlation_by_group, correlation_matrix
from hearthway.plans import views as V
from hearthway.plans.queries_joins import WEIGHTED_SQL, hex_map, per_service
from hearthway.plans.registry import query

SUMMARY_SQL = """select service, min(duration_min) as min_duration, avg(duration_min) as mean_duration,
 max(duration_min) as max_duration, min(wait_time_dest_min) as min_wait_time, avg(wait_time_dest_min) as mean_wait_time,
 max(wait_time_dest_min) as max_wait_time, cast(max(transfers) as integer) as max_transfers,
 median(duration_min) as median_duration, median(wait_time_dest_min) as median_wait_time,
 cast(trunc(median(transfers)) as integer) as median_transfers from v_trips group by service"""


@query("service_summary", SUMMARY_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.service_summary(V.trips(spark, sf_dir))


@query(
    "connection_counts",
    """select service, count(duration_min) as solved, count(*) - count(duration_min) as unsolved,
 avg(duration_min) as mean_duration, avg(wait_time_dest_min) as mean_wait_time from v_trips group by service""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.connection_counts(V.trips(spark, sf_dir))


def _weight(service: str) -> float:
    return float(V.WEIGHTS[service])


@query(
    "weighted_time",
    "select *, "
    + " + ".join(f"coalesce({s}_1_weighted_time, 0)" for s in V.SERVICES)
    + " as total_weighted_time from (select source_id, "
    + ", ".join(
        f"max(total_time_min) filter (where service = '{s}') as {s}_1_travel_time, "
        f"max(total_time_min * {_weight(s)}) filter (where service = '{s}') as {s}_1_weighted_time"
        for s in V.SERVICES
    )
    + " from v_trips group by source_id) t",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.weighted_time(V.trips(spark, sf_dir), V.SERVICES, V.WEIGHTS)


@query(
    "zone_weighted_avg",
    f"""select grid_id, avg(total_weighted_time) as avg_total_weighted_time from ({WEIGHTED_SQL}) w
 join v_hex using (source_id) group by grid_id""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = A.weighted_time(V.trips(spark, sf_dir), V.SERVICES, V.WEIGHTS)
    return A.zone_weighted_avg(weighted, hex_map(spark, sf_dir))


@query("total_times", "select * from v_totals")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.total_times(V.trips(spark, sf_dir))


@query("zone_total_avg", "select * from v_hex_totals")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.zone_total_avg(A.total_times(V.trips(spark, sf_dir)), hex_map(spark, sf_dir))


def _profile_sql(zone_key: str, zone_map: str) -> str:
    cells = []
    for s in V.SERVICES:
        cells += [f'avg("{m}") filter (where service = \'{s}\') as "{m}_{s}_1_ave"' for m in V.MEASURES]
        cells.append(
            f"count(*) filter (where service = '{s}' and duration_min is null) as no_connection_count_{s}_1"
        )
    present = " and ".join(f"count(*) filter (where service = '{s}') > 0" for s in V.SERVICES)
    return (
        f"select {zone_key}, {', '.join(cells)}, count(*) filter (where service = '{V.SERVICES[0]}') as total_observations "
        f"from v_trips join {zone_map} using (source_id) group by {zone_key} having {present}"
    )


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.zone_profile(V.trips(spark, sf_dir), hex_map(spark, sf_dir), "grid_id", services=V.SERVICES)


@query("zone_profile_hex", _profile_sql("grid_id", "v_hex"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(spark, sf_dir)


@query("zone_profile_municipality", _profile_sql("zone_id", "v_assigned"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = S.assign_zone(V.points(spark, sf_dir), V.zones(spark, sf_dir), "zone_id").filter("zone_id is not null")
    return A.zone_profile(V.trips(spark, sf_dir), areas, "zone_id", services=V.SERVICES)


@query(
    "observation_count",
    """select grid_id, count(*) as total_observations from v_trips join v_hex using (source_id)
 where service = 'doctor' group by grid_id""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.observation_count(V.trips(spark, sf_dir), hex_map(spark, sf_dir), "grid_id", "doctor")


NUMBERS = ["duration_min", "wait_time_dest_min", "total_time_min", "walkDistance", "abs_dist"]


@query(
    "describe_table",
    " union all ".join(
        f"""select '{c}' as variable, count("{c}") as count, avg("{c}") as mean, round(stddev_samp("{c}"), 6) as std,
 min("{c}") as min, quantile_cont("{c}", 0.25) as p25, quantile_cont("{c}", 0.5) as p50,
 quantile_cont("{c}", 0.75) as p75, max("{c}") as max from v_trips"""
        for c in NUMBERS
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = A.describe_table(V.trips(spark, sf_dir), NUMBERS)
    return table.withColumn("std", F.round("std", 6))


def _corr_sql(columns: list[str], source: str) -> str:
    return " union all ".join(
        f"""select '{a}' as a, '{b}' as b, round(corr("{a}", "{b}"), 6) as r from {source}"""
        for a in columns
        for b in columns
    )


@query("correlation_matrix", _corr_sql(NUMBERS, "v_trips"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation_matrix(V.trips(spark, sf_dir), NUMBERS).withColumn("r", F.round("r", 6))


@query(
    "correlation_dimensions",
    """with l as (select vec_id, unnest(range(1, 65)) as d, unnest(embedding) as v from embeddings)
 select concat('d', x.d - 1) as a, concat('d', y.d - 1) as b, round(corr(cast(x.v as double), cast(y.v as double)), 6) as r
 from l x join l y on x.vec_id = y.vec_id group by x.d, y.d""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64 dimensions of the embeddings against each other."""
    table = V.table(spark, sf_dir, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(64)])
    return correlation_matrix(table, table.columns).withColumn("r", F.round("r", 6))


_BY_SERVICE = ", ".join(
    f"avg(\"{c}\") filter (where service = '{s}') as \"{c}_{s}\"" for s in V.SERVICES for c in NUMBERS
)
_WIDE_HEX = f"(select grid_id, {_BY_SERVICE} from v_trips join v_hex using (source_id) group by grid_id) h"


@query("correlation_by_service", _corr_sql([f"{c}_doctor" for c in NUMBERS], _WIDE_HEX))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide_hex(spark, sf_dir, "_doctor")


@query("correlation_by_measure", _corr_sql([f"duration_min_{s}" for s in V.SERVICES], _WIDE_HEX))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide_hex(spark, sf_dir, "duration_min")


def _wide_hex(spark: SparkSession, sf_dir: str, token: str) -> DataFrame:
    trips = V.trips(spark, sf_dir)
    wide = A.zone_profile(trips, hex_map(spark, sf_dir), "grid_id", NUMBERS, V.SERVICES, require_all=False)
    short = {f"{c}_{s}_1_ave": f"{c}_{s}" for s in V.SERVICES for c in NUMBERS}
    named = C.rename_columns(wide, short).select(*short.values())
    return correlation_by_group(named, token).withColumn("r", F.round("r", 6))


def grouped_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones with a group number (their region) and census values."""
    regions = V.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("zone_id"), F.col("n_regionkey").alias("cluster")
    )
    return V.zones(spark, sf_dir).join(regions, "zone_id").join(V.census(spark, sf_dir), "zone_id")


GROUPED = """(select z.*, n.n_regionkey as cluster, c.* exclude (zone_id) from v_zones z
 join nation n on n.n_nationkey = z.zone_id join v_census c using (zone_id)) g"""
AREA = "(maxx - minx) * (maxy - miny) / 1000000"


@query("group_sizes", f"select cluster, count(*) as size from {GROUPED} group by cluster")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.group_sizes(grouped_zones(spark, sf_dir), "cluster")


@query("group_areas", f"select cluster, round(sum({AREA}), 6) as area_sqkm from {GROUPED} group by cluster")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.group_areas(grouped_zones(spark, sf_dir), "cluster").withColumn("area_sqkm", F.round("area_sqkm", 6))


@query(
    "group_share_pct",
    f"""select cluster, round(count(*) * 100.0::double / sum(count(*)) over (), 6) as size_pct,
 round(sum({AREA}) * 100.0::double / sum(sum({AREA})) over (), 6) as area_pct from {GROUPED} group by cluster""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = A.group_share_pct(grouped_zones(spark, sf_dir), "cluster")
    return shares.select("cluster", F.round("size_pct", 6).alias("size_pct"), F.round("area_pct", 6).alias("area_pct"))


@query(
    "group_means",
    " union all ".join(
        f"select '{v}' as variable, "
        + ", ".join(f"avg({v}) filter (where cluster = {g}) as cluster_{g}" for g in range(5))
        + f" from {GROUPED}"
        for v in ["households", "income_low", "income_high"]
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.group_means(grouped_zones(spark, sf_dir), "cluster", ["households", "income_low", "income_high"], list(range(5)))


@query(
    "histogram",
    """with m as (select min(total_time_min) as lo, max(total_time_min) as hi from v_totals),
 c as (select least(cast(floor((total_time_min - lo) / ((hi - lo) / 30)) as integer), 29) as bin, count(*) as n
  from v_totals, m where total_time_min is not null group by 1)
 select cast(b as integer) as bin, lo + b * ((hi - lo) / 30) as lower, lo + (b + 1) * ((hi - lo) / 30) as upper,
  coalesce(n, 0) as count from (select unnest(generate_series(0, 29)) as b) s cross join m left join c on c.bin = s.b""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(A.total_times(V.trips(spark, sf_dir)), "total_time_min")


@query("distinct_keys", "select count(distinct source_id) as distinct_keys from v_trips")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distinct_keys(V.trips(spark, sf_dir), "source_id")


_LONG_SUMMARY = " union all ".join(
    f"select '{m}' as measure, service, cast({m} as double) as value from s" for m in settings.SUMMARY_MEASURES
)


@query(
    "flag_row_extremes",
    f"""with s as ({SUMMARY_SQL}), l as ({_LONG_SUMMARY}) select measure, service, value,
 value = max(value) over (partition by measure) as is_max, value = min(value) over (partition by measure) as is_min from l""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.flag_row_extremes(A.service_summary(V.trips(spark, sf_dir)), "service", settings.SUMMARY_MEASURES)


@query(
    "best_k",
    """select label as k, avg(v) as mean_score from (select label, cast(floor(list_extract(embedding, 1) * 1024) as double) / 1024 as v
 from embeddings) t group by label order by mean_score desc, k limit 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_k(_scores(spark, sf_dir))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.floor(F.col("embedding")[0] * 1024) / 1024
    return V.table(spark, sf_dir, "embeddings").select(F.col("label").alias("k"), score.alias("score"))


@query("limit_rows", "select source_id, total_time_min from v_totals order by source_id limit 25")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = A.total_times(V.trips(spark, sf_dir)).select("source_id", "total_time_min")
    return R.limit_rows(totals, 25, ["source_id"])


@query(
    "score_spread",
    """select label as k, min(v) as min, quantile_cont(v, 0.25) as p25, median(v) as median, quantile_cont(v, 0.75) as p75,
 max(v) as max from (select label, cast(floor(list_extract(embedding, 1) * 1024) as double) / 1024 as v from embeddings) t group by label""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.score_spread(_scores(spark, sf_dir))


@query("union_services", "select source_id, duration_min, wait_time_dest_min, service from v_trips")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.union_services(per_service(spark, sf_dir), ["source_id", "duration_min", "wait_time_dest_min"])


@query(
    "concat_matches",
    """select source_id, zone_id from v_pairs where distance = 0 union all
 select source_id, arg_min(zone_id, (distance, zone_id)) as zone_id from v_pairs where distance <= 300
 and source_id not in (select source_id from v_pairs where distance = 0) group by source_id""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, zones = V.points(spark, sf_dir), V.zones(spark, sf_dir).select("zone_id", "rings")
    direct = S.spatial_join(points, zones, "zone_id").select("source_id", "x", "y", "zone_id")
    rest = direct.filter("zone_id is null").drop("zone_id")
    near = S.assign_zone(rest, zones, "zone_id", 300.0).filter("zone_id is not null")
    both = R.concat_matches(direct.filter("zone_id is not null"), near)
    return both.select("source_id", "zone_id")


@query(
    "unpivot_long",
    " union all ".join(
        f"select zone_id, '{v}' as variable, cast({v} as double) as value from v_census"
        for v in ["households", "income_low", "income_high"]
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unpivot_long(V.census(spark, sf_dir), ["zone_id"], ["households", "income_low", "income_high"])


@query(
    "transpose",
    f"with s as ({SUMMARY_SQL}) "
    + " union all ".join(
        f"select '{m}' as variable, "
        + ", ".join(f"max(cast({m} as double)) filter (where service = '{s}') as {s}" for s in V.SERVICES)
        + " from s"
        for m in settings.SUMMARY_MEASURES
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.transpose(A.service_summary(V.trips(spark, sf_dir)), "service", settings.SUMMARY_MEASURES, V.SERVICES)


def _class_sql(value: str, bounds: list) -> str:
    tests = " ".join(f"when {value} <= {b} then {i}" for i, b in enumerate(bounds))
    return f"case when {value} is null then null {tests} else {len(bounds)} end"


@query(
    "classify_fixed",
    f"select source_id, {_class_sql('total_time_min', settings.TOTAL_TIME_BOUNDS)} as total_time_min_class from v_totals",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    classed = K.classify_fixed(A.total_times(V.trips(spark, sf_dir)), "total_time_min", settings.TOTAL_TIME_BOUNDS)
    return classed.select("source_id", "total_time_min_class")


@query(
    "classify_quantiles",
    """with b as (select quantile_cont(c_acctbal, 0.2) as b1, quantile_cont(c_acctbal, 0.4) as b2, quantile_cont(c_acctbal, 0.6) as b3,
 quantile_cont(c_acctbal, 0.8) as b4 from customer)
 select c_custkey, case when c_acctbal <= b1 then 0 when c_acctbal <= b2 then 1 when c_acctbal <= b3 then 2
 when c_acctbal <= b4 then 3 else 4 end as c_acctbal_class from customer, b""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = V.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return K.classify_quantiles(customers, "c_acctbal", 5).select("c_custkey", "c_acctbal_class")


@query(
    "classify_quantiles_rounded",
    """with b as (select round_even(quantile_cont(c_acctbal, 0.2) / 10, 0) * 10 as b1,
 round_even(quantile_cont(c_acctbal, 0.4) / 10, 0) * 10 as b2, round_even(quantile_cont(c_acctbal, 0.6) / 10, 0) * 10 as b3,
 round_even(quantile_cont(c_acctbal, 0.8) / 10, 0) * 10 as b4, round_even(max(c_acctbal) / 10, 0) * 10 as b5 from customer)
 select c_custkey, case when c_acctbal <= b1 then 0 when c_acctbal <= b2 then 1 when c_acctbal <= b3 then 2
 when c_acctbal <= b4 then 3 when c_acctbal <= b5 then 4 else 5 end as c_acctbal_class from customer, b""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = V.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return K.classify_quantiles(customers, "c_acctbal", 5, 10.0).select("c_custkey", "c_acctbal_class")


@query("classify_natural")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.classify_natural(V.census(spark, sf_dir).select("zone_id", "households"), "households", 5)


_CAR_SHARES = ["households_with_1_car", "households_with_2_cars", "households_without_car"]


def _norm_sql(c: str) -> str:
    return f"({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()) as {c}_norm"


def _quarter(c: str) -> str:
    return f"case when {c}_norm <= 0.25 then 0 when {c}_norm <= 0.5 then 1 when {c}_norm <= 0.75 then 2 else 3 end"


@query(
    "classify_bivariate",
    "select zone_id, "
    + ", ".join(
        f"({_quarter(a)}) * 4 + ({_quarter(b)}) as {a}_norm__{b}_norm" for a, b in combinations(_CAR_SHARES, 2)
    )
    + f" from (select zone_id, {', '.join(_norm_sql(c) for c in _CAR_SHARES)} from v_census) t",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = C.minmax_normalize(V.census(spark, sf_dir), _CAR_SHARES)
    pairs = C.variable_pairs([f"{c}_norm" for c in _CAR_SHARES])
    return K.classify_bivariate(scaled, pairs).select("zone_id", *[f"{a}__{b}" for a, b in pairs])
