"""Scaling, k-means and the measures used to judge clusterings."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthway import settings
from hearthway.functions import geometry as G
from hearthway.operators.columns import with_global
from hearthway.operators.kmeans import Fit, Points
from hearthway.operators.ranking import quantiles
from hearthway.operators.reshape import sample_rows, unpivot_long
from hearthway.operators.equi import equi_join
from hearthway.session import cut_lineage


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / (q75 - q25) with exact quantiles; a zero range divides by 1."""
    points = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    table = quantiles(df, columns, list(points.values()))
    fields = [
        F.max(F.when((F.col("variable") == c) & (F.col("q") == q), F.col("quantile"))).alias(f"{name}_{i}")
        for i, c in enumerate(columns)
        for name, q in points.items()
    ]
    stats = table.agg(F.struct(*fields).alias("s")).scalar()
    out = df.withColumn("_stats", stats)
    scaled = {}
    for i, c in enumerate(columns):
        spread = F.col("_stats")[f"q75_{i}"] - F.col("_stats")[f"q25_{i}"]
        centred = F.col(f"`{c}`") - F.col("_stats")[f"q50_{i}"]
        scaled[c] = centred / F.when(spread == 0, F.lit(1.0)).otherwise(spread)
    return out.withColumns(scaled).drop("_stats")


def features(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out).transform(df)


def _fit(df: DataFrame, k: int, seed: int) -> KMeansModel:
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="label").fit(df)


def elbow_curve(df: DataFrame, ks: list[int], seed: int = 13) -> DataFrame:
    """(k, distortion, inertia): mean distance and summed squared distance to the centres.

    `df` has a vector column `features`. k = 1 has its centre at the mean. All fits share their passes over the distinct points; one row per k is returned.
    """
    points = Points(df)
    found = points.measure(points.fit([Fit(k, seed) for k in ks]))
    rows = [(k, float(found[n][:, 1].sum() / found[n][:, 0].sum()), float(found[n][:, 2].sum())) for n, k in enumerate(ks)]
    return df.sparkSession.createDataFrame(rows, "k int, distortion double, inertia double")


def silhouette_scores(
    df: DataFrame,
    ks: list[int],
    iterations: int = 10,
    seed: int = 13,
    sample: int = 0,
    key: str | None = None,
    metric: str = "squared",
) -> DataFrame:
    """(k, run, score) of repeated k-means fits.

    All fits and scores share their passes over the distinct points. The score is the silhouette on squared Euclidean distance, which needs one pass. With
    `sample` it is the Euclidean silhouette of that many rows instead, with the metric `euclidean` and no
    sample that of all rows; both need a `key`.
    """
    if metric not in ("squared", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    euclidean = bool(sample) or metric == "euclidean"
    if euclidean and key is None:
        raise ValueError("a Euclidean silhouette needs a key")
    if min(ks) < 2:
        raise ValueError("a silhouette needs at least two clusters")
    points = Points(df)
    runs = [(k, run) for k in ks for run in range(iterations)]
    centres = points.fit([Fit(k, seed + 1000 * k + run) for k, run in runs])
    if euclidean:
        data = df.select("features", key)
        scores = {n: silhouette_euclidean(data.withColumn("label", points.label("features", centres[n])), sample, seed + run, key) for n, (_, run) in enumerate(runs)}
    else:
        scores = points.silhouettes(centres)
    rows = [(k, run, float(scores[n])) for n, (k, run) in enumerate(runs)]
    return df.sparkSession.createDataFrame(rows, "k int, run int, score double")


#: Rows of a block of the Euclidean silhouette, about.
SILHOUETTE_BLOCK = 2_000


def silhouette_euclidean(labelled: DataFrame, sample: int, seed: int, key: str) -> float | None:
    """Mean Euclidean silhouette of `sample` random rows among themselves; 0 takes all rows.

    Equal rows of a cluster are one weighted row. Rows are dealt into blocks by a hash. Every unordered pair of blocks is a group of its own, so a
    task holds two blocks and measures each distance once: it gives the sums of distances from the rows of either block
    to the clusters of the other. The work grows with the square of the distinct rows, which is what the measure is
    made of. Fewer than two clusters have no silhouette.
    """
    chosen = sample_rows(labelled.select(key, "label", vector_to_array("features").alias("v")), sample, seed, key)
    merged = chosen.groupBy("label", "v").agg(F.count(F.lit(1)).cast("double").alias("w"))
    rows = cut_lineage(merged.withColumn("row", F.monotonically_increasing_id()))
    sizes = rows.groupBy("label").agg(F.sum("w").alias("n"))
    if sizes.count() < 2:
        return None
    blocks = -(-rows.count() // SILHOUETTE_BLOCK)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        packed = {"row": frame["row"].to_numpy(np.int64), "label": frame["label"].to_numpy(np.int32), "w": frame["w"].to_numpy(float), "v": np.array(frame["v"].tolist())}
        return pd.DataFrame({"block": frame["block"].iloc[:1], "size": [len(frame)], **{n: [x.tobytes()] for n, x in packed.items()}})

    packed = cut_lineage(dealt.groupBy("block").applyInPandas(pack, "block long, size int, row binary, label binary, w binary, v binary"))
    placed = packed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    pairs = placed.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
    measured = pairs.groupBy("low", "high").applyInPandas(_distances, "row long, label int, other int, d double")
    sums = measured.groupBy("row", "label", "other").agg(F.sum("d").alias("d"))
    inside = F.max(F.when(F.col("other") == F.col("label"), F.col("d") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("inside")
    outside = F.min(F.when(F.col("other") != F.col("label"), F.col("d") / F.col("n"))).alias("outside")
    alone = F.max((F.col("other") == F.col("label")) & (F.col("n") == 1)).alias("alone")
    scored = sums.join(sizes.withColumnRenamed("label", "other"), "other").groupBy("row").agg(inside, outside, alone).join(rows.select("row", "w"), "row")
    value = F.try_divide(F.col("outside") - F.col("inside"), F.greatest("inside", "outside"))
    score = F.when(F.col("alone"), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))
    return scored.agg(F.sum(score * F.col("w")) / F.sum("w")).first()[0]


def _distances(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums of distances between the rows of two blocks, or of one block among themselves, by cluster."""
    blocks = [
        (np.frombuffer(r.row, np.int64), np.frombuffer(r.label, np.int32), np.frombuffer(r.v).reshape(r.size, -1), np.frombuffer(r.w))
        for r in frame.itertuples()
    ]
    # A pair one of whose blocks holds no rows has nothing to measure.
    empty = pd.DataFrame({"row": np.zeros(0, np.int64), "label": np.zeros(0, np.int32), "other": np.zeros(0, np.int32), "d": np.zeros(0)})
    if len(blocks) == 1 and frame["low"].iloc[0] != frame["high"].iloc[0]:
        return empty
    (rows, labels, points, weights), (their_rows, their_labels, others, their_weights) = blocks[0], blocks[-1]
    clusters, place = np.unique(labels, return_inverse=True)
    their_clusters, their_place = np.unique(their_labels, return_inverse=True)
    forth = np.empty((len(rows), len(their_clusters)))
    back = np.zeros((len(their_rows), len(clusters)))
    member, their_member = np.eye(len(clusters))[place] * weights[:, None], np.eye(len(their_clusters))[their_place] * their_weights[:, None]
    for low in range(0, len(rows), 500):
        mine = points[low : low + 500]
        squares = (mine**2).sum(axis=1)[:, None] + (others**2).sum(axis=1) - 2 * mine @ others.T
        distance = np.sqrt(np.maximum(squares, 0))
        forth[low : low + 500] = distance @ their_member
        back += distance.T @ member[low : low + 500]
    sides = [(rows, labels, their_clusters, forth)]
    if len(blocks) == 2:
        sides.append((their_rows, their_labels, clusters, back))
    return pd.concat(
        [
            pd.DataFrame({"row": np.repeat(r, len(c)), "label": np.repeat(own, len(c)), "other": np.tile(c, len(r)), "d": d.ravel()})
            for r, own, c, d in sides
        ]
    )


def kmeans_assign(df: DataFrame, k: int = settings.CLUSTERS, seed: int = 13) -> DataFrame:
    """`df` with its k-means `label`."""
    return _fit(df, k, seed).transform(df)


def named_by_lowest(df: DataFrame, labels: list[str], key: str) -> DataFrame:
    """Each label column replaced by the lowest key of its cluster, so that numberings of clusters do not matter.

    The names of the clusters are few rows, joined per label column.
    """
    for label in labels:
        names = df.groupBy(F.col(label).alias("_label")).agg(F.min(key).alias("_name"))
        df = df.join(names, F.col(label).eqNullSafe(F.col("_label"))).withColumn(label, F.col("_name")).drop("_label", "_name")
    return df


def kmeans_seed_test(
    df: DataFrame, k: int = settings.CLUSTERS, seeds: list[int] = settings.CLUSTER_SEEDS, n_runs: int = 10
) -> DataFrame:
    """A column `label_{seed}` per seed, each from the best of `n_runs` starts."""
    points = Points(df)
    runs = [(seed, run) for seed in seeds for run in range(n_runs)]
    centres = points.fit([Fit(k, seed * 1000 + run) for seed, run in runs])
    costs = {n: table[:, 2].sum() for n, table in points.measure(centres).items()}
    for seed in seeds:
        best = min((n for n, (own, _) in enumerate(runs) if own == seed), key=costs.get)
        df = df.withColumn(f"label_{seed}", points.label("features", centres[best]))
    return df


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, as one row (a, b, ari).

    Only the contingency counts leave the tasks.
    """
    counts = labels.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))

    def pairs(table: DataFrame) -> DataFrame:
        return table.agg(F.struct(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("p"), F.sum("n").alias("n")).alias("s"))

    both = pairs(counts).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("s.p").alias("both"), F.col("s.n").alias("n"))
    for side in ("a", "b"):
        margin = counts.groupBy(side).agg(F.sum("n").alias("n"))
        both = both.withColumn(f"in_{side}", pairs(margin).scalar()["p"])
    expected = F.coalesce(F.try_divide(F.col("in_a") * F.col("in_b"), F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))
    largest = (F.col("in_a") + F.col("in_b")) / 2
    ari = F.coalesce(F.try_divide(F.col("both") - expected, largest - expected), F.lit(1.0))
    return both.select("a", "b", ari.alias("ari"))


def adjusted_rand_pairs(labels: DataFrame, columns: list[str]) -> DataFrame:
    """Adjusted Rand index of every pair of labelings: (a, b, ari), all from one grouping of the rows."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("of_a"), F.col(b).alias("of_b")) for a, b in combinations(columns, 2)]
    counts = labels.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.a", "p.b", "p.of_a", "p.of_b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # Sums per pair over the cells of its table, its rows and its columns: few rows, whatever the data.
    sides = {"both": ["of_a", "of_b"], "in_a": ["of_a"], "in_b": ["of_b"]}
    sums = None
    for name, by in sides.items():
        margin = counts.groupBy("a", "b", *by).agg(F.sum("n").alias("n")).groupBy("a", "b").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(name), F.sum("n").alias(f"n_{name}"))
        sums = margin if sums is None else sums.join(margin, ["a", "b"])
    expected = F.coalesce(F.try_divide(F.col("in_a") * F.col("in_b"), F.col("n_both") * (F.col("n_both") - 1) / 2), F.lit(0.0))
    largest = (F.col("in_a") + F.col("in_b")) / 2
    ari = F.coalesce(F.try_divide(F.col("both") - expected, largest - expected), F.lit(1.0))
    return sums.select("a", "b", ari.alias("ari"))


def pca_project(df: DataFrame, k: int = 2) -> DataFrame:
    """Scores on the first k principal components, `pc1`...; features are centred first."""
    scaler = StandardScaler(inputCol="features", outputCol="_centred", withMean=True, withStd=False)
    centred = scaler.fit(df).transform(df)
    model = PCA(k=k, inputCol="_centred", outputCol="_pc").fit(centred)
    scores = model.transform(centred).withColumn("_pc", vector_to_array("_pc"))
    return scores.withColumns({f"pc{i + 1}": F.col("_pc")[i] for i in range(k)}).drop("_centred", "_pc")


def cluster_profile(zones: DataFrame, cluster: str, variables: list[str]) -> DataFrame:
    """Per cluster: size, area, their shares in percent and the mean of each variable."""
    area = G.polygon_area(G.polygon_edges(F.col("rings"))) / 10**6
    groups = zones.select(cluster, *variables, area.alias("_area")).groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"),
        F.sum("_area").alias("area_sqkm"),
        *[F.avg(F.col(f"`{v}`")).alias(f"mean_{v}") for v in variables],
    )
    shares = with_global(groups, "_all", size=F.sum("size"), area=F.sum("area_sqkm"))
    return shares.withColumns(
        {
            "size_pct": F.try_divide(F.col("size") * 100.0, F.col("_all.size")),
            "area_pct": F.try_divide(F.col("area_sqkm") * 100.0, F.col("_all.area")),
        }
    ).drop("_all")


def cluster_density(df: DataFrame, cluster: str, variables: list[str], points: int = 200) -> DataFrame:
    """Gaussian kernel density of each variable in each cluster.

    (cluster, variable, step, x, density) on `points` even steps from three bandwidths
    below the smallest value to three above the largest, bandwidth sd * n^(-1/5). Groups
    without spread are left out. Equal values are counted first, and each task adds up its
    own kernels before the shuffle.
    """
    long = unpivot_long(df, [cluster], variables)
    counted = long.groupBy(cluster, "variable", "value").agg(F.count(F.lit(1)).alias("_copies"))
    stats = (
        long.groupBy(cluster, "variable")
        .agg(
            F.count("value").alias("_n"),
            F.stddev_samp("value").alias("_sd"),
            F.min("value").alias("_lo"),
            F.max("value").alias("_hi"),
        )
        .filter("_sd > 0")
        .withColumn("_bw", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    )
    start = F.col("_lo") - 3 * F.col("_bw")
    stride = (F.col("_hi") - F.col("_lo") + 6 * F.col("_bw")) / (points - 1)
    placed = (
        equi_join(counted, stats, [cluster, "variable"])
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", start + F.col("step") * stride)
    )
    u = (F.col("x") - F.col("value")) / F.col("_bw")
    scale = F.col("_n") * F.col("_bw") * math.sqrt(2 * math.pi)
    return placed.groupBy(cluster, "variable", "step", "x").agg(
        F.sum(F.col("_copies") * F.exp(-u * u / 2) / scale).alias("density")
    )
