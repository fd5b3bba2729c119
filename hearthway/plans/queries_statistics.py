"""Queries for spatial autocorrelation and clustering."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthway import settings
from hearthway.operators import aggregates as A
from hearthway.operators import autocorrelation as M
from hearthway.operators import classify as K
from hearthway.operators import clustering as L
from hearthway.operators import grid
from hearthway.operators import reshape as R
from hearthway.plans import views as V
from hearthway.plans.analysis import autocorrelation_suite
from hearthway.plans.queries_aggregates import AREA, GROUPED, grouped_zones, profile
from hearthway.plans.queries_joins import UNION_SQL, combined_weights, hex_cells, hex_map, zone_graph_sql
from hearthway.plans.registry import query

TOTALS = ["avg_total_duration", "avg_total_wait_time", "avg_total_time"]
NEAREST_SQL = "(select grid_id, t.* exclude (grid_id) from v_hex_totals t where avg_total_time is not null) z"


def hex_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = A.total_times(V.trips(spark, sf_dir))
    return A.zone_total_avg(totals, hex_map(spark, sf_dir)).filter("avg_total_time is not null")


def hex_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = grid.hex_neighbors(grid.used_cells(V.points(spark, sf_dir), V.CELL_SIZE))
    return edges.withColumn("w", F.lit(1.0))


LAGS_SQL = f"""lags as (select i as grid_id, {', '.join(f'avg({c}) as {c}_lag' for c in TOTALS)} from v_edges
 join {NEAREST_SQL} on z.grid_id = v_edges.j group by i),
 known as (select z.*, {', '.join(f'{c}_lag' for c in TOTALS)} from {NEAREST_SQL} left join lags using (grid_id))"""


@query(
    "spatial_lag",
    f"with {LAGS_SQL} select grid_id, {', '.join(f'round(coalesce({c}_lag, 0), 8) as {c}_lag' for c in TOTALS)} from known",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    lagged = M.spatial_lag(hex_totals(spark, sf_dir), hex_edges(spark, sf_dir), TOTALS)
    return lagged.select("grid_id", *[F.round(f"{c}_lag", 8).alias(f"{c}_lag") for c in TOTALS])


def _moran_sql(c: str) -> str:
    return f"""select '{c}' as variable, count(*) as n,
 round(count(*) * sum(({c} - m) * ({c}_lag - m)) / (count({c}_lag) * sum(({c} - m) * ({c} - m))), 6) as moran_i,
 round(-1.0::double / (count(*) - 1), 9) as expected_i from known, (select avg({c}) as m from known) a"""


@query("morans_i", f"with {LAGS_SQL} " + " union all ".join(_moran_sql(c) for c in TOTALS))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.morans_i(hex_totals(spark, sf_dir), hex_edges(spark, sf_dir), TOTALS)
    return found.select(
        "variable", "n", F.round("moran_i", 6).alias("moran_i"), F.round("expected_i", 9).alias("expected_i")
    )


def rearranged_sql(asked: str, sizes: str, seed: int = 13, name: str = "walk") -> str:
    """Common tables ending in `name` (set, x, perm, v, n): the ranks v to which `M.rearranged` sends the ranks x of `asked` (set, x, perm), with `sizes` (set, n)."""

    def mixed(x: str, turn: int, size: str) -> str:
        key = f"({seed * M.KEYS[0] + turn * M.KEYS[2]} + perm * {M.KEYS[1]}) % {M.PRIME}"
        y = f"((({x} + {key}) % {M.PRIME} * {M.STEP[0]} + {M.STEP[1]}) % {M.PRIME})"
        return f"({y} * {y}) % {M.PRIME} % {size}"

    def once(source: str, value: str) -> str:
        rounds = f"select *, {value} // b as r0, {value} % b as c0 from {source}"
        rounds = f"select *, (r0 + {mixed('c0', 0, 'a')}) % a as r1 from ({rounds}) s"
        rounds = f"select *, (c0 + {mixed('r1', 1, 'b')}) % b as c1 from ({rounds}) s"
        rounds = f"select *, (r1 + {mixed('c1', 2, 'a')}) % a as r2 from ({rounds}) s"
        return f"select set, x, perm, n, a, b, r2 * b + (c1 + {mixed('r2', 3, 'b')}) % b as v from ({rounds}) s"

    start = f"""(select asked.set, x, perm, n, a, (n + a - 1) // a as b from ({asked}) asked
 join (select set, n, cast(ceil(sqrt(n)) as bigint) as a from ({sizes}) sizes) sized on sized.set = asked.set) begun"""
    return f"""{name}_all as ({once(start, 'x')} union all select set, x, perm, n, a, b, v from ({once(f'(select set, x, perm, n, a, b, v as reached from {name}_all where v >= n) w', 'reached')}) again),
 {name} as (select * from {name}_all where v < n)"""


def moran_p_sql(known: str, edges: str) -> str:
    """Common tables of both Moran tests for `known` (set, variable, grid_id, v) and `edges` (set, i, j) between known zones.

    p_global (set, variable, n, moran_i, p_sim), p_local (set, variable, grid_id, p_sim, quadrant).
    """
    equal = M.EQUAL
    return f"""known as ({known}), links as ({edges}),
 places as (select set, grid_id, row_number() over (partition by set order by grid_id) - 1 as rank from (select distinct set, grid_id from known) k),
 sizes as (select set, count(*) as n from places group by set),
 units as (select known.set, variable, known.grid_id, rank, coalesce((v - avg(v) over t) / nullif(stddev_pop(v) over t, 0), 0) as z
  from known join places on places.set = known.set and places.grid_id = known.grid_id window t as (partition by known.set, variable)),
 slots as (select set, i, j, row_number() over (partition by set, i order by j) - 1 as slot, count(*) over (partition by set, i) as size from links),
 lags as (select slots.set, variable, i, sum(z / size) as lag from slots join units on units.set = slots.set and grid_id = j group by slots.set, variable, i),
 perms as (select unnest(range(999)) as perm),
 {rearranged_sql('select set, rank as x, perm from places, perms', 'select * from sizes')},
 turned as (select walk.set, variable, perm, x, z from walk join units on units.set = walk.set and rank = v),
 sums as (select e.set, a.variable, a.perm, sum(a.z * b.z / size) / sum(1.0::double / size) as sim
  from (select slots.set, size, p.rank as ri, q.rank as rj from slots join places p on p.set = slots.set and p.grid_id = i join places q on q.set = slots.set and q.grid_id = j) e
  join turned a on a.set = e.set and a.x = ri join turned b on b.set = e.set and b.x = rj and b.variable = a.variable and b.perm = a.perm group by e.set, a.variable, a.perm),
 observed as (select units.set, units.variable, any_value(n) as n, sum(z * lag) / count(lag) as moran_i from units join sizes on sizes.set = units.set
  left join lags on lags.set = units.set and i = grid_id and lags.variable = units.variable group by units.set, units.variable),
 p_global as (select o.set, o.variable, any_value(n) as n, any_value(moran_i) as moran_i,
  (least(count(*) filter (where sim >= moran_i - {equal}), 999 - count(*) filter (where sim >= moran_i - {equal})) + 1) / 1000.0::double as p_sim
  from observed o join sums on sums.set = o.set and sums.variable = o.variable group by o.set, o.variable),
 drawn as (select slots.set, i, own.perm as perm, size, case when own.v = p.rank then spare.v else own.v end as rank, p.rank as rank_i
  from slots join places p on p.set = slots.set and p.grid_id = i join walk own on own.set = slots.set and own.x = slot
  join walk spare on spare.set = slots.set and spare.x = size and spare.perm = own.perm),
 local_sums as (select d.set, variable, i, perm, sum(z / size) as sim from drawn d join units on units.set = d.set and units.rank = d.rank group by d.set, variable, i, perm),
 p_counts as (select s.set, s.variable, s.i, count(*) filter (where z * (sim - lag) >= -{equal}) as larger from local_sums s
  join lags on lags.set = s.set and lags.variable = s.variable and lags.i = s.i
  join units on units.set = s.set and units.variable = s.variable and grid_id = s.i group by s.set, s.variable, s.i),
 p_local as (select units.set, units.variable, grid_id, (least(larger, 999 - larger) + 1) / 1000.0::double as p_sim,
  case when z > 0 and coalesce(lag, 0) > 0 then 'HH' when z <= 0 and coalesce(lag, 0) > 0 then 'LH' when z <= 0 then 'LL' else 'HL' end as quadrant
  from units left join lags on lags.set = units.set and lags.variable = units.variable and lags.i = grid_id
  left join p_counts c on c.set = units.set and c.variable = units.variable and c.i = grid_id)"""


TOTALS_TESTS = moran_p_sql(
    "select 'total' as set, variable, grid_id, v from (unpivot (select * from v_hex_totals where avg_total_time is not null) on "
    + ", ".join(TOTALS) + " into name variable value v) u",
    "select 'total' as set, i, j from v_edges where i in (select grid_id from known) and j in (select grid_id from known)",
)


@query(
    "morans_i_permuted",
    f"with recursive {TOTALS_TESTS} select variable, n, round(moran_i, 6) as moran_i, round(-1.0::double / (n - 1), 9) as expected_i, p_sim from p_global",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.morans_i(hex_totals(spark, sf_dir), hex_edges(spark, sf_dir), TOTALS, permutations=999)
    return found.select("variable", "n", F.round("moran_i", 6).alias("moran_i"), F.round("expected_i", 9).alias("expected_i"), "p_sim")


def _local_sql(c: str) -> str:
    z, lag = f"({c} - m)", f"coalesce({c}_lag - m, 0)"
    return f"""select grid_id, '{c}' as variable, round((n - 1) * {z} * {lag} / s, 6) as local_i,
 case when {z} > 0 and {lag} > 0 then 'HH' when {z} <= 0 and {lag} > 0 then 'LH' when {z} <= 0 then 'LL' else 'HL' end as quadrant
 from known, (select avg({c}) as m, count(*) as n, count(*) * var_pop({c}) as s from known) a"""


@query("local_moran", f"with {LAGS_SQL} " + " union all ".join(_local_sql(c) for c in TOTALS))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.local_moran(hex_totals(spark, sf_dir), hex_edges(spark, sf_dir), TOTALS)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("variable"),
                F.round(f"{c}_i", 6).alias("local_i"),
                F.col(f"{c}_quadrant").alias("quadrant"),
            )
            for c in TOTALS
        ]
    )
    return found.select("grid_id", F.inline(rows))


@query(
    "local_moran_permuted",
    f"""with recursive {TOTALS_TESTS} select grid_id, variable, quadrant, p_sim, case when p_sim < 0.05 then quadrant else 'Non-Significant' end as q,
 case when p_sim < 0.05 then 'Significant' else 'Non-Significant' end as significance from p_local""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.local_moran(hex_totals(spark, sf_dir), hex_edges(spark, sf_dir), TOTALS, permutations=999)
    for c in TOTALS:
        found = M.significance_label(found, c)
    names = {"quadrant": "quadrant", "p_sim": "p_sim", "q": "q", "significance": "significance"}
    return found.select("grid_id", F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), *[F.col(f"{c}_{n}").alias(n) for n in names]) for c in TOTALS])))


@query(
    "moran_line",
    f"with {LAGS_SQL} "
    + " union all ".join(
        f"""select '{c}' as variable, round(regr_slope(coalesce({c}_lag, 0), {c}), 6) as slope,
 round(regr_intercept(coalesce({c}_lag, 0), {c}), 6) as intercept from known"""
        for c in TOTALS
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = M.moran_line(M.spatial_lag(hex_totals(spark, sf_dir), hex_edges(spark, sf_dir), TOTALS), TOTALS)
    return line.select("variable", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query(
    "morans_i_combined_weights",
    f"""with e as ({UNION_SQL}), z as (select grid_id, avg_total_time as v from v_hex_totals where avg_total_time is not null),
 l as (select i as grid_id, avg(v) as lag from e join z on z.grid_id = e.j group by i),
 k as (select z.*, lag from z left join l using (grid_id)), a as (select avg(v) as m from k)
 select count(*) as n, round(count(*) * sum((v - m) * (lag - m)) / (count(lag) * sum((v - m) * (v - m))), 6) as moran_i from k, a""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.morans_i(hex_totals(spark, sf_dir), combined_weights(spark, sf_dir), ["avg_total_time"])
    return found.select("n", F.round("moran_i", 6).alias("moran_i"))


def _weighted_sql(time: str) -> str:
    weights = " ".join(f"when '{s}' then {w}" for s, w in V.WEIGHTS.items())
    return f"""select 'weighted' as set, 'weighted_{time}' as variable, grid_id, avg(weighted) as v from (
 select source_id, sum(coalesce({time}, 0) * case service {weights} end) as weighted from v_trips group by source_id) t join v_hex using (source_id) group by grid_id"""


SUITE_TESTS = moran_p_sql(
    f"""select 'duration' as set, 'duration_min_' || service || '_1_ave' as variable, grid_id, avg(duration_min) as v from v_trips join v_hex using (source_id)
  where grid_id in (select grid_id from (select grid_id, service, avg(duration_min) as v from v_trips join v_hex using (source_id) group by grid_id, service) s
   group by grid_id having count(*) = {len(V.SERVICES)} and count(v) = {len(V.SERVICES)}) group by grid_id, service
 union all select 'total' as set, variable, grid_id, v from (unpivot (select * from v_hex_totals where {' and '.join(f'{c} is not null' for c in TOTALS)}) on {', '.join(TOTALS)} into name variable value v) u
 union all {_weighted_sql('duration_min')} union all {_weighted_sql('total_time_min')}""",
    f"with members as (select distinct set, grid_id from known) {zone_graph_sql('members')}",
)


@query(
    "autocorrelation_suite",
    f"""with recursive {SUITE_TESTS}, labels as (select set, variable, {', '.join(f"count(*) filter (where p_sim < 0.05 and quadrant = '{q}') as {q}" for q in M.QUADRANTS.values())}
  from p_local group by set, variable)
 select g.set, g.variable, n, round(moran_i, 6) as moran_i, round(-1.0::double / (n - 1), 9) as expected_i, p_sim, {', '.join(M.QUADRANTS.values())},
  (select count(*) from places p where p.set = g.set and not exists (select 1 from links l where l.set = p.set and l.i = p.grid_id)) as islands
 from p_global g join labels l on l.set = g.set and l.variable = g.variable""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips, zones = V.trips(spark, sf_dir), hex_map(spark, sf_dir)
    weighted = {
        t: A.zone_weighted_avg(A.weighted_time(trips, V.SERVICES, V.WEIGHTS, t), zones)
        for t in ["duration_min", "total_time_min"]
    }
    found = autocorrelation_suite(profile(spark, sf_dir), hex_totals(spark, sf_dir), weighted, hex_cells(spark, sf_dir), permutations=999)
    return found.withColumns({"moran_i": F.round("moran_i", 6), "expected_i": F.round("expected_i", 9)})


FEATURES = ["f0", "f1", "f2", "f3"]


def vectors(spark: SparkSession, sf_dir: str, size: int | None = None) -> DataFrame:
    """Embeddings as a vector column `features`, with their given label."""
    array = F.col("embedding").cast("array<double>")
    return V.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("given"), array_to_vector(array).alias("features"))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four embedding dimensions as plain columns, on a grid of 1/1024 so that sums are exact."""
    return V.table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", *[(F.floor(F.col("embedding")[i] * 1024) / 1024).alias(c) for i, c in enumerate(FEATURES)]
    )


NUMBERS_SQL = "(select vec_id, label, " + ", ".join(
    f"cast(floor(list_extract(embedding, {i + 1}) * 1024) as double) / 1024 as {c}" for i, c in enumerate(FEATURES)
) + " from embeddings) e"


@query(
    "robust_scale",
    f"select vec_id, {', '.join(f'({c} - m_{c}) / (b_{c} - a_{c}) as {c}' for c in FEATURES)} from {NUMBERS_SQL}, (select "
    + ", ".join(
        f"quantile_cont({c}, 0.25) as a_{c}, quantile_cont({c}, 0.5) as m_{c}, quantile_cont({c}, 0.75) as b_{c}"
        for c in FEATURES
    )
    + f" from {NUMBERS_SQL}) q",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.robust_scale(numbers(spark, sf_dir), FEATURES).drop("label")


@query("elbow_curve")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.elbow_curve(vectors(spark, sf_dir), list(range(1, 30)))


@query("silhouette_scores")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.silhouette_scores(vectors(spark, sf_dir), list(range(6, 12)), iterations=10)


@query("silhouette_spread")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = L.silhouette_scores(vectors(spark, sf_dir), list(range(6, 12)), iterations=10)
    return R.score_spread(scores)


@query("kmeans_assign")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.kmeans_assign(vectors(spark, sf_dir)).select("vec_id", "label")


@query("kmeans_seed_test")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agreement of all pairs of seeds."""
    tested = L.kmeans_seed_test(vectors(spark, sf_dir), n_runs=10)
    return L.adjusted_rand_pairs(tested, [f"label_{seed}" for seed in settings.CLUSTER_SEEDS])


@query(
    "adjusted_rand",
    """with t as (select label as a, cast(vec_id % 7 as integer) as b from embeddings),
 c as (select a, b, count(*)::double as n from t group by a, b),
 p as (select (select sum(n * (n - 1) / 2) from c) as nij, (select sum(n * (n - 1) / 2) from (select sum(n) as n from c group by a) x) as na,
  (select sum(n * (n - 1) / 2) from (select sum(n) as n from c group by b) y) as nb, (select sum(n) from c) as n)
 select 'label' as a, 'other' as b, round((nij - na * nb / (n * (n - 1) / 2)) / ((na + nb) / 2 - na * nb / (n * (n - 1) / 2)), 9) as ari from p""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = V.table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 7).cast("int").alias("other"))
    return L.adjusted_rand(labels, "label", "other").withColumn("ari", F.round("ari", 9))


LABELS = {"given": "label", "seventh": "vec_id % 7", "fifth": "vec_id % 5", "half": "vec_id % 2"}


@query(
    "adjusted_rand_pairs",
    "with t as (select " + ", ".join(f"cast({v} as integer) as {n}" for n, v in LABELS.items()) + " from embeddings), c as ("
    + " union all ".join(f"select '{a}' as a, '{b}' as b, {a} as x, {b} as y, count(*)::double as n from t group by {a}, {b}" for a, b in combinations(LABELS, 2))
    + """), s as (select a, b, sum(n * (n - 1) / 2) as nij, sum(n) as n from c group by a, b),
 x as (select a, b, sum(n * (n - 1) / 2) as na from (select a, b, x, sum(n) as n from c group by a, b, x) q group by a, b),
 y as (select a, b, sum(n * (n - 1) / 2) as nb from (select a, b, y, sum(n) as n from c group by a, b, y) q group by a, b)
 select a, b, round((nij - na * nb / (n * (n - 1) / 2)) / ((na + nb) / 2 - na * nb / (n * (n - 1) / 2)), 9) as ari from s join x using (a, b) join y using (a, b)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = V.table(spark, sf_dir, "embeddings").select(*[F.expr(v).cast("int").alias(n) for n, v in LABELS.items()])
    return L.adjusted_rand_pairs(labels, list(LABELS)).withColumn("ari", F.round("ari", 9))


@query("pca_project")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.pca_project(vectors(spark, sf_dir)).select("vec_id", "pc1", "pc2")


@query(
    "cluster_profile",
    f"""select cluster, count(*) as size, round(sum({AREA}), 6) as area_sqkm, avg(households) as mean_households,
 avg(income_low) as mean_income_low, round(count(*) * 100.0::double / sum(count(*)) over (), 6) as size_pct,
 round(sum({AREA}) * 100.0::double / sum(sum({AREA})) over (), 6) as area_pct from {GROUPED} group by cluster""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.cluster_profile(grouped_zones(spark, sf_dir), "cluster", ["households", "income_low"])
    return found.withColumns({c: F.round(c, 6) for c in ["area_sqkm", "size_pct", "area_pct"]})


@query(
    "cluster_density",
    f"""with l as (select label, 'f0' as variable, f0 as v from {NUMBERS_SQL} union all
  select label, 'f1', f1 from {NUMBERS_SQL}),
 s as (select label, variable, count(*) as n, min(v) as lo, max(v) as hi, stddev_samp(v) * pow(count(*), -0.2) as bw
  from l group by label, variable having stddev_samp(v) > 0),
 g as (select *, lo - 3 * bw + step * ((hi - lo + 6 * bw) / 199) as x from s, (select unnest(generate_series(0, 199)) as step) t)
 select g.label, g.variable, cast(step as integer) as step, round(x, 6) as x,
  round(sum(exp(-((x - v) / bw) * ((x - v) / bw) / 2)) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 6) as density
 from g join l on g.label = l.label and g.variable = l.variable group by g.label, g.variable, step, x""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = L.cluster_density(numbers(spark, sf_dir), "label", ["f0", "f1"], points=200)
    return curve.withColumns({"x": F.round("x", 6), "density": F.round("density", 6)})


def separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points of six groups far apart, on whole numbers: id, x, y, features."""
    part, key = F.col("c_nationkey") % 6, F.col("c_custkey")
    x = (300 * part + key % 13).cast("double").alias("x")
    y = (300 * (part * part % 7) + key % 11).cast("double").alias("y")
    return L.features(V.table(spark, sf_dir, "customer").select(key.alias("id"), x, y), ["x", "y"])


SEPARATED_SQL = """g as (select c_custkey as id, c_nationkey % 6 as part, cast(300 * (c_nationkey % 6) + c_custkey % 13 as double) as x,
 cast(300 * ((c_nationkey % 6) * (c_nationkey % 6) % 7) + c_custkey % 11 as double) as y from customer)"""
LOWEST_SQL = "min(id) over (partition by part)"
SILHOUETTE_SQL = f"""{SEPARATED_SQL}, s as (select part, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x + y * y) as q from g group by part),
 d as (select id, g.part, s.part as other, n, n * (x * x + y * y) + q - 2 * (x * sx + y * sy) as total from g, s),
 v as (select id, max(case when other = part then total / (n - 1) end) as a, min(case when other <> part then total / n end) as b from d group by id),
 m as (select round(avg((b - a) / greatest(a, b)), 9) as score from v)"""


@query("kmeans_assign_separated", f"with {SEPARATED_SQL} select id, {LOWEST_SQL} as label from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.named_by_lowest(L.kmeans_assign(separated(spark, sf_dir)).select("id", "label"), ["label"], "id")


SEED_LABELS = [f"label_{seed}" for seed in settings.CLUSTER_SEEDS]


@query("kmeans_seed_test_separated", f"with {SEPARATED_SQL} select id, {', '.join(f'{LOWEST_SQL} as {c}' for c in SEED_LABELS)} from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    tested = L.kmeans_seed_test(separated(spark, sf_dir), n_runs=10)
    return L.named_by_lowest(tested.select("id", *SEED_LABELS), SEED_LABELS, "id")


@query(
    "elbow_curve_separated",
    f"""with {SEPARATED_SQL}, c as (select 1 as k, sqrt(pow(x - avg(x) over (), 2) + pow(y - avg(y) over (), 2)) as d from g
 union all select 6, sqrt(pow(x - avg(x) over p, 2) + pow(y - avg(y) over p, 2)) from g window p as (partition by part))
 select k, round(avg(d), 6) as distortion, round(sum(d * d), 1) as inertia from c group by k""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = L.elbow_curve(separated(spark, sf_dir), [1, 6])
    return curve.withColumns({"distortion": F.round("distortion", 6), "inertia": F.round("inertia", 1)})


@query("silhouette_scores_separated", f"with {SILHOUETTE_SQL} select 6 as k, run, score from m, (select unnest(range(10)) as run) r")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.silhouette_scores(separated(spark, sf_dir), [6], iterations=10).withColumn("score", F.round("score", 9))


@query("silhouette_spread_separated", f"with {SILHOUETTE_SQL} select 6 as k, score as min, score as p25, score as median, score as p75, score as max from m")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.score_spread(L.silhouette_scores(separated(spark, sf_dir), [6], iterations=10).withColumn("score", F.round("score", 9)))


@query(
    "silhouette_euclidean_separated",
    f"""with {SEPARATED_SQL}, d as (select p.id, p.part, q.part as other, sum(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))) as total, count(*) as n
 from g p, g q group by p.id, p.part, q.part),
 v as (select id, max(case when other = part then total / (n - 1) end) as a, min(case when other <> part then total / n end) as b from d group by id)
 select 6 as k, 0 as run, round(avg((b - a) / greatest(a, b)), 9) as score from v""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = L.silhouette_scores(separated(spark, sf_dir), [6], iterations=1, key="id", metric="euclidean")
    return scores.withColumn("score", F.round("score", 9))


@query(
    "pca_project_two",
    """with g as (select c_custkey as id, c_acctbal / 1000 as x, c_nationkey / 10 as y from customer),
 c as (select avg(x) as mx, avg(y) as my, var_samp(x) as a, covar_samp(x, y) as b, var_samp(y) as c from g),
 e as (select mx, my, b as ux, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) - a as uy from c)
 select id, round(abs((x - mx) * ux + (y - my) * uy) / sqrt(ux * ux + uy * uy), 6) as pc1,
  round(abs((y - my) * ux - (x - mx) * uy) / sqrt(ux * ux + uy * uy), 6) as pc2 from g, e""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the scores: the direction of a component has no sign of its own."""
    rows = V.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).cast("double").alias("x"), (F.col("c_nationkey") / 10).alias("y")
    )
    scores = L.pca_project(L.features(rows, ["x", "y"]))
    return scores.select("id", *[F.round(F.abs(c), 6).alias(c) for c in ("pc1", "pc2")])


@query("classify_natural_separated", f"with {SEPARATED_SQL} select id, x, part as x_class, max(x) over (partition by part) as x_upper from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.classify_natural(separated(spark, sf_dir).select("id", "x"), "x", 6)
