"""Analyses on zone tables: loading, autocorrelation, clustering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthway import settings
from hearthway.operators import autocorrelation as M
from hearthway.operators import clustering as L
from hearthway.operators.columns import drop_missing, names_containing, select_by_substring
from hearthway.operators.neighbours import isolated_zones, zone_graph
from hearthway.operators.spatial import spatial_anti_join
from hearthway.session import cut_lineage


def analysis_table(profile: DataFrame, outlines: DataFrame, islands: DataFrame | None, key: str = "grid_id") -> DataFrame:
    """The analysis columns of a zone profile with outlines, without zones that touch an island."""
    chosen = select_by_substring(profile, settings.ANALYSIS_TOKENS, [key, "total_observations"])
    located = drop_missing(chosen, ["total_observations"]).join(outlines.select(key, "rings"), key)
    return located if islands is None else spatial_anti_join(located, islands, key)


def variable_sets(profile: DataFrame, totals: DataFrame, weighted: dict[str, DataFrame], key: str = "grid_id") -> dict[str, tuple[DataFrame, list[str]]]:
    """The zone table and the variables of each analysed set: durations, totals, weighted times."""
    paired = reduce(
        lambda a, b: a.join(b, key),
        [t.select(key, F.col("avg_total_weighted_time").alias(f"weighted_{n}")) for n, t in weighted.items()],
    )
    return {
        "duration": (profile, names_containing(profile, ["duration_min"])),
        "total": (totals, names_containing(totals, ["total"])),
        "weighted": (paired, names_containing(paired, ["weighted"])),
    }


def autocorrelation_suite(
    profile: DataFrame,
    totals: DataFrame,
    weighted: dict[str, DataFrame],
    outlines: DataFrame,
    key: str = "grid_id",
    permutations: int = settings.PERMUTATIONS,
    seed: int = 13,
) -> DataFrame:
    """Global and local statistics of three variable sets: durations, totals, weighted times.

    (set, variable, n, moran_i, expected_i, p_sim, the number of significant zones per quadrant, and `islands`, the zones of the set
    without neighbours). Every set has a graph of its own, over the zones that have all its values: queen neighbours
    and the nearest centroids among them, so a zone whose neighbours are missing still has as many. One search
    finds the graphs of all sets. All variables of a set share their joins and permutations; the graphs and
    the zone tables are written once, as each is read for every statistic.
    """
    tables = variable_sets(profile, totals, weighted, key)
    known = {name: cut_lineage(drop_missing(table.select(key, *variables), variables)) for name, (table, variables) in tables.items()}
    members = reduce(DataFrame.unionByName, [t.select(F.lit(name).alias("set"), key) for name, t in known.items()])
    shaped = cut_lineage(members.join(outlines.select(key, "rings"), key))
    graphs = cut_lineage(zone_graph(shaped, settings.KNN_NEIGHBOURS, key, ["set"]))
    islands = isolated_zones(members, graphs, key, ["set"]).groupBy("set").agg(F.count(F.lit(1)).alias("islands"))
    results = []
    for name, (_, variables) in tables.items():
        edges = graphs.filter(F.col("set") == name).drop("set")
        overall = M.morans_i(known[name], edges, variables, key, permutations, seed)
        zones = M.local_moran(known[name], edges, variables, key, permutations=permutations, seed=seed)
        labels = zones.select(F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"`{v}_q`").alias("q")) for v in variables])))
        counts = labels.groupBy("variable").agg(*[F.count_if(F.col("q") == q).alias(q) for q in M.QUADRANTS.values()])
        results.append(overall.join(counts, "variable").select(F.lit(name).alias("set"), "*"))
    return reduce(DataFrame.unionByName, results).join(islands, "set", "left").na.fill(0, ["islands"])


def cluster_zones(
    table: DataFrame, key: str = "grid_id", k: int = settings.CLUSTERS, seed: int = 13
) -> tuple[DataFrame, list[str]]:
    """Zones with a k-means `label` on robustly scaled total times and missing connections.

    Returns the labelled table and its cluster variables. The zone table is written first:
    scaling, fitting and labelling each read it.
    """
    variables = names_containing(table, ["total_time_min", "no_connection_count"])
    known = cut_lineage(drop_missing(table, variables))
    scaled = L.robust_scale(known.select(key, *variables), variables)
    labels = L.kmeans_assign(L.features(scaled, variables), k, seed).select(key, "label")
    return known.join(labels, key), variables
