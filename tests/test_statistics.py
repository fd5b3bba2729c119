"""Quantiles, Moran statistics and clustering measures."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearthway.operators import aggregates as A
from hearthway.operators import autocorrelation as M
from hearthway.operators import clustering as L
from hearthway.operators import neighbours as N
from hearthway.operators import reshape as R
from hearthway.operators.ranking import global_position, grouped_quantiles

SIDE = 8


@pytest.fixture(scope="module")
def board(spark):
    """An 8 x 8 chess board of zones with a trend and noise, and its rook edges."""
    draw = random.Random(3)
    cells = [(f"{i}_{j}", float(i + j + draw.random()), draw.random()) for i in range(SIDE) for j in range(SIDE)]
    edges = [
        (f"{i}_{j}", f"{i + a}_{j + b}", 1.0)
        for i in range(SIDE)
        for j in range(SIDE)
        for a, b in [(0, 1), (1, 0), (0, -1), (-1, 0)]
        if 0 <= i + a < SIDE and 0 <= j + b < SIDE
    ]
    zones = spark.createDataFrame(cells, "grid_id string, trend double, noise double")
    return zones, spark.createDataFrame(edges, "i string, j string, w double"), cells, edges


def matrix(cells, edges):
    place = {c[0]: n for n, c in enumerate(cells)}
    w = np.zeros((len(cells), len(cells)))
    for i, j, v in edges:
        w[place[i], place[j]] = v
    return w / w.sum(axis=1, keepdims=True)


def test_quantiles_of_a_crowded_group(spark):
    draw = random.Random(1)
    rows = [("a", draw.gauss(0, 1)) for _ in range(501)] + [("b", 7.0)] * 400 + [("b", 9.0), ("c", 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    points = [0.0, 0.2, 0.25, 0.5, 0.9, 1.0]
    found = {(r.g, r.q): r.quantile for r in grouped_quantiles(df, ["g"], "v", points).collect()}
    frame = pd.DataFrame(rows, columns=["g", "v"]).groupby("g").v
    for g, values in frame:
        for q in points:
            assert found[(g, q)] == pytest.approx(values.quantile(q))
    assert len(found) == 18


def test_positions_are_a_permutation(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("k"))
    found = global_position(df, ["k", "id"]).orderBy("position").collect()
    assert [r.position for r in found] == list(range(1000))
    assert [(r.k, r.id) for r in found] == sorted((i % 3, i) for i in range(1000))


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(500)
    a = {r.id for r in R.sample_rows(df, 40, 1, "id").collect()}
    b = {r.id for r in R.sample_rows(df.repartition(13), 40, 1, "id").collect()}
    assert a == b and len(a) == 40
    assert {r.id for r in R.sample_rows(df, 40, 2, "id").collect()} != a
    assert R.sample_rows(df, 0, 1, "id").count() == 500


def test_global_moran_equals_the_matrix_formula(board):
    zones, edges, cells, links = board
    w = matrix(cells, links)
    found = {r.variable: r for r in M.morans_i(zones, edges, ["trend", "noise"]).collect()}
    for at, name in enumerate(["trend", "noise"], 1):
        z = np.array([c[at] for c in cells])
        z = z - z.mean()
        assert found[name].moran_i == pytest.approx(z @ w @ z / (z @ z))
    slope = {r.variable: r.slope for r in M.moran_line(M.spatial_lag(zones, edges, ["trend"]), ["trend"]).collect()}
    assert slope["trend"] == pytest.approx(found["trend"].moran_i)


def test_permutations_tell_a_trend_from_noise(board):
    zones, edges, *_ = board
    found = {r.variable: r.p_sim for r in M.morans_i(zones, edges, ["trend", "noise"], permutations=99).collect()}
    again = {
        r.variable: r.p_sim
        for r in M.morans_i(zones.repartition(5), edges.repartition(3), ["trend", "noise"], permutations=99).collect()
    }
    assert found == again
    assert found["trend"] == 0.01 and found["noise"] > 0.05


def test_each_permutation_keeps_the_values(board):
    zones, edges, cells, links = board
    sims = M._permuted_moran(zones, edges, ["trend"], "grid_id", 200, 5).toPandas()["sim"]
    assert len(sims) == 200
    assert sims.mean() == pytest.approx(-1 / (len(cells) - 1), abs=0.03)


def test_local_moran(board):
    zones, edges, cells, links = board
    w = matrix(cells, links)
    z = np.array([c[1] for c in cells])
    z = z - z.mean()
    local = (len(cells) - 1) * z * (w @ z) / (z @ z)
    found = {r.grid_id: r for r in M.local_moran(zones, edges, ["trend"], permutations=199).collect()}
    for n, c in enumerate(cells):
        r = found[c[0]]
        assert r.trend_i == pytest.approx(local[n])
        want = ("H" if z[n] > 0 else "L") + ("H" if (w @ z)[n] > 0 else "L")
        assert r.trend_quadrant == want
        assert r.trend_q == (want if r.trend_p_sim < 0.05 else "Non-Significant")
    assert found["0_0"].trend_q == "LL" and found["7_7"].trend_q == "HH"
    again = {
        r.grid_id: r.trend_p_sim
        for r in M.local_moran(zones.repartition(9), edges.repartition(2), ["trend"], permutations=199).collect()
    }
    assert again == {k: r.trend_p_sim for k, r in found.items()}


def sent(rank, perm, n, seed):
    """The keyed map of ranks, step by step."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def mixed(x, turn, size):
        y = ((x + (seed * 7_368_787 + turn * 32_452_843 + perm * 15_485_863)) % 2_147_483_647 * 48_271 + 12_345) % 2_147_483_647
        return y * y % 2_147_483_647 % size

    while True:
        row, column = divmod(rank, b)
        for turn in (0, 2):
            row = (row + mixed(column, turn, a)) % a
            column = (column + mixed(row, turn + 1, b)) % b
        rank = row * b + column
        if rank < n:
            return rank


def test_rearrangements_are_one_to_one(spark):
    for n in (1, 2, 3, 5, 7, 10, 16, 37, 100, 167, 1009):
        df = spark.range(n).withColumn("other", F.col("id"))
        made = M.in_rearrangements(df, {"at": "id"}, n, 7, 13, ["id"]).collect()
        found = {(r.other, r.perm): r["at"] for r in made}
        assert len(made) == len(found) == 7 * n
        assert found == {(k, p): sent(k, p, n, 13) for k, p in found}
        for p in range(7):
            assert sorted(v for (_, q), v in found.items() if q == p) == list(range(n))
    assert M.in_rearrangements(spark.range(3), {"at": "id"}, 3, 150, 1, ["id"]).select("perm").distinct().count() == 150
    # Places are even, and neighbouring ranks do not stay neighbours.
    at = [[sent(k, p, 100, 1) for k in range(100)] for p in range(400)]
    hits = np.bincount([row[3] for row in at], minlength=100)
    assert hits.max() < 20
    assert np.mean([abs(row[k + 1] - row[k]) == 1 for row in at for k in range(99)]) < 0.04


def test_local_p_values_of_a_hub(spark, monkeypatch):
    """Draws by rearrangements, with the spare rank where a zone would draw itself, and no bound on neighbours."""
    monkeypatch.setattr(M, "BLOCK", 16)
    draw = random.Random(6)
    keys = [f"z{k:03d}" for k in range(80)]
    value = {k: float(draw.randint(0, 64)) for k in keys}
    links = {k: ([j for j in keys if j != k] if k == "z000" else ["z000", *draw.sample([j for j in keys[1:] if j != k], 2)]) for k in keys}
    zones = spark.createDataFrame(list(value.items()), "grid_id string, v double")
    edges = spark.createDataFrame([(i, j, 1.0) for i, near in links.items() for j in near], "i string, j string, w double")
    found = {r.grid_id: r.v_p_sim for r in M.local_moran(zones, edges, ["v"], permutations=60, seed=4).collect()}
    z = np.array(list(value.values()))
    z = (z - z.mean()) / z.std()
    for own, i in enumerate(keys):
        near = sorted(links[i])
        lag = np.mean([z[keys.index(j)] for j in near])
        larger = 0
        for perm in range(60):
            ranks = [sent(s, perm, 80, 4) for s in range(len(near))]
            ranks = [sent(len(near), perm, 80, 4) if r == own else r for r in ranks]
            larger += z[own] * (z[ranks].mean() - lag) >= -1e-9
        assert found[i] == pytest.approx((min(larger, 60 - larger) + 1) / 61)


def test_blocks_of_a_large_hub_are_separate_tasks(spark):
    spokes = spark.range(1, 20_001).select(F.lit("hub").alias("i"), F.format_string("z%05d", "id").alias("j"), F.lit(1.0).alias("w"))
    zones = spark.range(20_001).select(F.when(F.col("id") == 0, "hub").otherwise(F.format_string("z%05d", "id")).alias("grid_id"), (F.col("id") % 97).cast("double").alias("v"))
    found = M.local_moran(zones, spokes, ["v"], permutations=128, seed=2)
    assert 0 < found.filter("grid_id = 'hub'").first().v_p_sim <= 1
    assert "Window" not in M._permuted_moran(zones, spokes, ["v"], "grid_id", 9, 1)._jdf.queryExecution().optimizedPlan().toString()


def test_unknown_zones_leave_both_parts_of_the_statistic(spark):
    values = [("a", 1.0), ("b", 2.0), ("c", 4.0), ("d", 8.0), ("e", 16.0), ("x", None)]
    ring = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "a")]
    edges = ring + [(k, "x") for k in "abcde"]
    zones = spark.createDataFrame(values, "grid_id string, v double")
    graph = spark.createDataFrame([(i, j, 1.0) for i, j in edges + [(j, i) for i, j in edges]], "i string, j string, w double")
    observed = M.morans_i(zones, graph, ["v"]).first().moran_i
    known = zones.dropna()
    sims = [r.sim for r in M._permuted_moran(known, M.between_known(graph, known, "grid_id"), ["v"], "grid_id", 200, 3).collect()]
    # A ring of five zones has few arrangements; the observed one is among them.
    assert min(abs(s - observed) for s in sims) < 1e-9
    with_p = M.morans_i(zones, graph, ["v"], permutations=200, seed=3).first()
    # Arrangements equal to the observed one may fall on either side by rounding.
    counts = range(sum(s >= observed + 1e-9 for s in sims), sum(s >= observed - 1e-9 for s in sims) + 1)
    assert any(with_p.p_sim == pytest.approx((min(n, 200 - n) + 1) / 201) for n in counts)


def test_isolated_zone_has_no_lag(spark, board):
    zones, edges, *_ = board
    more = zones.union(spark.createDataFrame([("far", 1.0, 1.0)], zones.schema))
    assert [r.grid_id for r in N.isolated_zones(more, edges).collect()] == ["far"]
    lag = M.spatial_lag(more, edges, ["trend"]).filter("grid_id = 'far'").first()
    assert lag.trend_lag == 0.0


def test_adjusted_rand(spark):
    rows = [(i, i % 3, (i % 3 + 1) % 3, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a int, b int, c int")
    assert L.adjusted_rand(df, "a", "a").first()["ari"] == 1.0
    assert L.adjusted_rand(df, "a", "b").first()["ari"] == 1.0
    assert L.adjusted_rand(df, "a", "c").first()["ari"] < 0.01


@pytest.fixture(scope="module")
def blobs(spark):
    draw = random.Random(2)
    rows = [(i, float(10 * (i % 3) + draw.gauss(0, 0.5)), float(5 * (i % 3) + draw.gauss(0, 0.5))) for i in range(90)]
    return L.features(spark.createDataFrame(rows, "id int, a double, b double"), ["a", "b"])


def test_kmeans_finds_separate_groups(blobs):
    tested = L.kmeans_seed_test(blobs, 3, [1, 2], n_runs=3)
    assert L.adjusted_rand(tested, "label_1", "label_2").first()["ari"] == 1.0
    labelled = L.kmeans_assign(blobs, 3, 1).withColumn("true", F.col("id") % 3)
    assert L.adjusted_rand(labelled, "label", "true").first()["ari"] == 1.0


def test_elbow_falls_and_starts_at_the_variance(blobs):
    curve = {r.k: r for r in L.elbow_curve(blobs, [1, 2, 3]).collect()}
    frame = blobs.select("a", "b").toPandas()
    assert curve[1].inertia == pytest.approx(((frame - frame.mean()) ** 2).to_numpy().sum())
    assert curve[1].inertia > curve[2].inertia > curve[3].inertia


def test_silhouettes_prefer_the_true_number(blobs):
    for sample in (0, 90):
        scores = L.silhouette_scores(blobs, [2, 3, 4], iterations=1, sample=sample, key="id")
        assert R.best_k(scores).first()["k"] == 3


def test_euclidean_silhouette_by_hand(spark):
    rows = [(1, 0, 0.0), (2, 0, 2.0), (3, 1, 10.0), (4, 2, 30.0)]
    df = spark.createDataFrame(rows, "id int, label int, v double")
    found = L.silhouette_euclidean(L.features(df, ["v"]), 4, 1, "id")
    assert found == pytest.approx(((10 - 2) / 10 + (8 - 2) / 8 + 0 + 0) / 4)


def test_euclidean_silhouette_of_all_rows_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "SILHOUETTE_BLOCK", 30)
    draw = random.Random(8)
    rows = [(i, i % 3, draw.gauss(i % 3, 1), draw.gauss(0, 1)) for i in range(200)] + [(200, 7, 9.0, 9.0)] + [(k, 8, 5.0, 5.0) for k in (201, 202)]
    df = L.features(spark.createDataFrame(rows, "id int, label int, a double, b double"), ["a", "b"]).repartition(3)
    points, labels = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows])
    gaps = np.sqrt(((points[:, None] - points) ** 2).sum(axis=2))
    want = []
    for k, c in enumerate(labels):
        inside = gaps[k, labels == c].sum() / max((labels == c).sum() - 1, 1)
        outside = min(gaps[k, labels == o].mean() for o in set(labels) - {c})
        want.append(0 if (labels == c).sum() == 1 else (outside - inside) / max(inside, outside))
    assert L.silhouette_euclidean(df, 0, 1, "id") == pytest.approx(np.mean(want))
    # More rows than were taken before.
    assert L.silhouette_euclidean(df, 30_000, 1, "id") == pytest.approx(np.mean(want))


def test_silhouette_spread_scores_all_rows_in_full(spark, monkeypatch):
    from hearthway.plans import queries_statistics as Q
    from hearthway.plans.registry import QUERIES

    calls = []
    monkeypatch.setattr(Q.L, "silhouette_scores", lambda df, ks, iterations=10, seed=13, sample=0, key=None: calls.append((list(ks), iterations, sample)) or spark.createDataFrame([(k, 0, 0.5) for k in ks], "k int, run int, score double"))
    assert QUERIES["silhouette_spread"](spark, "/root/testdata/sf0.001").count() == 6
    assert calls == [([6, 7, 8, 9, 10, 11], 10, 0)]


def test_pca_scores_are_centred(blobs):
    scores = L.pca_project(blobs).toPandas()
    assert abs(scores.pc1.mean()) < 1e-9 and scores.pc1.std() > scores.pc2.std()


def test_density_integrates_to_one(spark):
    draw = random.Random(4)
    rows = [(0, draw.gauss(0, 1)) for _ in range(200)] + [(1, 3.0)] * 5
    df = spark.createDataFrame(rows, "cluster int, v double")
    curve = L.cluster_density(df, "cluster", ["v"]).orderBy("x").toPandas()
    assert set(curve.cluster) == {0} and len(curve) == 200
    assert np.trapezoid(curve.density, curve.x) == pytest.approx(1, abs=0.01)


def test_describe(spark):
    df = spark.createDataFrame([(1.0, 4), (2.0, None), (4.0, 8)], "a double, b int")
    found = {r.variable: r for r in A.describe_table(df).collect()}
    assert (found["a"]["count"], found["a"].p50, found["b"]["count"], found["b"].p25) == (3, 2.0, 2, 5.0)


def test_each_set_has_a_graph_of_its_own(spark):
    """Six nearest centroids among the known zones of a set, whatever other sets know; islands are told."""
    from hearthway.functions import hexes as H
    from hearthway.operators import grid

    draw = random.Random(5)
    places = sorted({(draw.randrange(12), draw.randrange(12)) for _ in range(40)})
    cells = spark.createDataFrame(places, "q long, r long").coalesce(1).withColumn("grid_id", H.cell_id(F.col("q"), F.col("r")))
    outlines = grid.hex_outlines(cells, 1400.0)
    names = {f"{q}_{r}": (q, r) for q, r in places}
    known = {"all": set(names), "half": {n for k, n in enumerate(sorted(names)) if k % 2}, "one": {min(names)}}
    members = spark.createDataFrame([(s, n) for s, own in known.items() for n in own], "set string, grid_id string")
    graph = N.zone_graph(members.join(outlines, "grid_id"), 6, by=["set"]).cache()
    linked = {}
    for row in graph.collect():
        linked.setdefault((row.set, row.i), set()).add(row.j)
    for name in ("all", "half"):
        for i in known[name]:
            (q, r), own = names[i], known[name]
            gaps = {j: (q - names[j][0]) ** 2 + (q - names[j][0]) * (r - names[j][1]) + (r - names[j][1]) ** 2 for j in own if j != i}
            sixth = sorted(gaps.values())[5]
            assert len(linked[name, i]) == 6
            assert {j for j, d in gaps.items() if d < sixth} <= linked[name, i] <= {j for j, d in gaps.items() if d <= sixth}
    assert [tuple(r) for r in N.isolated_zones(members, graph, by=["set"]).collect()] == [("one", min(names))]




def test_unknown_metric_and_missing_key_are_refused(spark):
    for arguments in ({"metric": "cosine"}, {"metric": "euclidean"}, {"sample": 5}):
        with pytest.raises(ValueError):
            L.silhouette_scores(spark.range(3), [2], **arguments)


def test_labels_named_by_the_lowest_key(spark):
    df = spark.createDataFrame([(1, 5, 0), (2, 3, 0), (3, 5, 1), (4, None, 1)], "id int, a int, b int")
    assert sorted(map(tuple, L.named_by_lowest(df, ["a", "b"], "id").select("id", "a", "b").collect())) == [(1, 1, 1), (2, 2, 1), (3, 1, 3), (4, 4, 3)]


def separated_groups(spark, copies):
    """Six groups far apart on whole numbers, each point `copies` times."""
    rows = [(g * 1000 + n * 10 + c, 300.0 * g + n % 13, 300.0 * (g * g % 7) + n % 11) for g in range(6) for n in range(40) for c in range(copies)]
    return rows, L.features(spark.createDataFrame(rows, "id long, x double, y double"), ["x", "y"])


def test_every_run_finds_separated_groups(spark):
    rows, df = separated_groups(spark, 3)
    at = np.array([r[1:] for r in rows])
    group = np.array([r[0] // 1000 for r in rows])
    squares = ((at[:, None] - at[None]) ** 2).sum(axis=2)
    means = np.array([[squares[n, group == g].sum() / ((group == g).sum() - (g == group[n])) for g in range(6)] for n in range(len(rows))])
    inside = means[np.arange(len(rows)), group]
    means[np.arange(len(rows)), group] = np.inf
    want = ((means.min(axis=1) - inside) / means.min(axis=1)).mean()
    scores = L.silhouette_scores(df, [6], iterations=60).collect()
    assert [r.score for r in scores] == pytest.approx([want] * 60, abs=1e-12)


def test_fits_share_passes_over_distinct_points(spark, monkeypatch):
    """The passes do not grow with the number of fits, nor their points with copies."""
    passes = []
    scan = L.Points.scan
    monkeypatch.setattr(L.Points, "scan", lambda self, *rest: passes.append(sum(r.n for r in self.blocks.collect())) or scan(self, *rest))
    _, df = separated_groups(spark, 5)
    L.silhouette_scores(df, [5, 6, 7], iterations=6)
    assert len(passes) <= 3 + 2 * 3 + 20 + 2 and set(passes) == {240}
    passes.clear()
    L.kmeans_seed_test(df, 6, [1, 2, 3], n_runs=4)
    L.elbow_curve(df, [1, 2, 3, 4, 5])
    assert len(passes) <= 2 * 32 and set(passes) == {240}


def test_euclidean_silhouette_measures_copies_once(spark, monkeypatch):
    rows, df = separated_groups(spark, 5)
    labelled = df.withColumn("label", F.expr("cast(id div 1000 as int)"))
    at, group = np.array([r[1:] for r in rows]), np.array([r[0] // 1000 for r in rows])
    gaps = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    means = np.array([[gaps[n, group == g].sum() / ((group == g).sum() - (g == group[n])) for g in range(6)] for n in range(len(rows))])
    inside = means[np.arange(len(rows)), group]
    means[np.arange(len(rows)), group] = np.inf
    want = ((means.min(axis=1) - inside) / np.maximum(means.min(axis=1), inside)).mean()
    # 240 distinct points are three blocks of 80, 1,200 rows would be fifteen.
    monkeypatch.setattr(L, "SILHOUETTE_BLOCK", 80)
    written = []
    cut = L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    assert L.silhouette_euclidean(labelled, 0, 1, "id") == pytest.approx(want)
    assert written[0].count() == 240


def test_fits_over_several_blocks(spark):
    """Blocks from which no start is drawn, among others: the centres are the means of the groups."""
    draw = random.Random(12)
    rows = [(k, 100.0 * (k % 4) + draw.random(), draw.random()) for k in range(6000)]
    df = L.features(spark.createDataFrame(rows, "id long, x double, y double"), ["x", "y"])
    points = L.Points(df)
    assert points.blocks.count() > 3
    found = points.fit([L.Fit(4, seed) for seed in range(8)])
    want = sorted([np.mean([r[1] for r in rows[g::4]]), np.mean([r[2] for r in rows[g::4]])] for g in range(4))
    for centres in found.values():
        assert np.allclose(sorted((centres + points.middle).tolist()), want)
