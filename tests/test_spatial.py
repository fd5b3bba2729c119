"""Spatial joins and graphs against brute force, crowds and copies among them."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthway.functions import geometry as G
from hearthway.operators import destinations as D
from hearthway.operators import grid
from hearthway.operators import joins as J
from hearthway.operators import neighbours as N
from hearthway.operators import polygon_cells as P
from hearthway.operators import spatial as S
from hearthway.operators.columns import centroids, polygon_area_km2
from hearthway.operators.equi import equi_join
from hearthway.operators.graph import star_components
from hearthway.sources.zones import _read_wkb

ZONE = "zone_id int, rings array<array<struct<x:double,y:double>>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def star(cx, cy, radius, corners, seed):
    draw = random.Random(seed)
    at = [(2 * math.pi * i / corners, radius * draw.uniform(0.3, 1)) for i in range(corners)]
    return ring(*[(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in at])


def inside(rings, x, y):
    odd = False
    for line in rings:
        for p, q in zip(line, line[1:]):
            side = (x - p["x"]) * (q["y"] - p["y"]) - (q["x"] - p["x"]) * (y - p["y"])
            if side == 0 and min(p["x"], q["x"]) <= x <= max(p["x"], q["x"]) and min(p["y"], q["y"]) <= y <= max(p["y"], q["y"]):
                return True
            if (p["y"] > y) != (q["y"] > y) and x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]:
                odd = not odd
    return odd


def gap(rings, x, y):
    if inside(rings, x, y):
        return 0.0
    best = math.inf
    for line in rings:
        for p, q in zip(line, line[1:]):
            dx, dy = q["x"] - p["x"], q["y"] - p["y"]
            t = max(0, min(1, ((x - p["x"]) * dx + (y - p["y"]) * dy) / (dx * dx + dy * dy)))
            best = min(best, math.hypot(p["x"] + t * dx - x, p["y"] + t * dy - y))
    return best


@pytest.fixture(scope="module")
def shapes():
    """Stars that overlap and span many cells, and a square with a hole."""
    zones = [(i, [star(150 * (i % 4), 150 * (i // 4), 120, 5 + i, i)]) for i in range(12)]
    hole = list(reversed(ring((620, 20), (680, 20), (680, 80), (620, 80))))
    return zones + [(12, [ring((600, 0), (700, 0), (700, 100), (600, 100)), hole])]


@pytest.fixture(scope="module")
def spots():
    draw = random.Random(5)
    points = [(i, draw.uniform(-200, 800), draw.uniform(-200, 600)) for i in range(150)]
    edge = [(600.0, 50.0), (650.0, 20.0), (650.0, 50.0), (700.0, 100.0), (600.0, 0.0)]
    crowd = [(650.0, 10.0)] * 60
    return points + [(150 + i, x, y) for i, (x, y) in enumerate(edge + crowd)]


POINT = "source_id int, x double, y double"


def test_spatial_join_equals_brute_force(spark, shapes, spots):
    found = S.spatial_join(spark.createDataFrame(spots, POINT), spark.createDataFrame(shapes, ZONE), "zone_id", "left", 40.0)
    got = sorted((r.source_id, -1 if r.zone_id is None else r.zone_id) for r in found.collect())
    want = []
    for i, x, y in spots:
        hits = [z for z, rings in shapes if inside(rings, x, y)]
        want += [(i, z) for z in hits or [-1]]
    assert got == sorted(want)


def test_assign_zone_equals_brute_force(spark, shapes, spots):
    points, zones = spark.createDataFrame(spots, POINT), spark.createDataFrame(shapes, ZONE)
    found = {r.source_id: r for r in S.nearest_join(points, zones, "zone_id", 30.0, cell_size=40.0).collect()}
    assert len(found) == len(spots)
    for i, x, y in spots:
        near = sorted((gap(rings, x, y), z) for z, rings in shapes)
        near = [n for n in near if n[0] <= 30]
        assert found[i].zone_id == (near[0][1] if near else None)
        if near:
            assert found[i].distance == pytest.approx(near[0][0])
    assert S.assign_zone(points, zones, "zone_id", 30.0, cell_size=40.0).columns == ["source_id", "x", "y", "zone_id"]


def test_polygon_intersection_cases(spark):
    zones = [
        (1, [ring((0, 0), (10, 0), (10, 10), (0, 10))]),
        (2, [ring((20, 0), (30, 0), (30, 10), (20, 10))]),
        (3, [ring((40, 0), (50, 0), (50, 10), (40, 10))]),
        (4, [ring((60, 0), (70, 0), (70, 10), (60, 10))]),
        (5, [ring((80, 0), (90, 0), (90, 10), (80, 10))]),
    ]
    islands = [
        (1, [ring((10, 10), (15, 10), (15, 15), (10, 15))]),  # touches a corner
        (2, [ring((18, 4), (32, 4), (32, 6), (18, 6))]),  # crosses without a corner inside
        (3, [ring((44, 4), (46, 4), (46, 6), (44, 6))]),  # lies inside
        (4, [ring((55, -5), (75, -5), (75, 15), (55, 15))]),  # lies around
    ]
    left = S.spatial_anti_join(spark.createDataFrame(zones, ZONE), spark.createDataFrame(islands, ZONE), "zone_id", 7.0)
    assert [r.zone_id for r in left.collect()] == [5]
    met = S.spatial_semi_join(spark.createDataFrame(zones, ZONE), spark.createDataFrame(islands, ZONE), "zone_id", 7.0)
    assert sorted(r.zone_id for r in met.collect()) == [1, 2, 3, 4]


def test_drop_contained(spark):
    hook = ring((0, 0), (30, 0), (30, 30), (20, 30), (20, 10), (10, 10), (10, 30), (0, 30))
    polygons = [
        (1, [hook]),
        (2, [ring((1, 1), (9, 1), (9, 9), (1, 9))]),  # inside
        (3, [ring((5, 20), (25, 20), (25, 25), (5, 25))]),  # corners inside, bridges the gap
        (4, [ring((12, 15), (18, 15), (18, 20), (12, 20))]),  # in the gap, outside
        (5, [ring((50, 50), (60, 50), (60, 60), (50, 60))]),  # two copies
        (6, [ring((50, 50), (60, 50), (60, 60), (50, 60))]),
        (7, [ring((0, 0), (10, 0), (10, 10), (0, 10))]),  # inside, shares sides
    ]
    left = S.drop_contained(spark.createDataFrame(polygons, ZONE), "zone_id", 8.0)
    assert sorted(r.zone_id for r in left.collect()) == [1, 3, 4]


def test_corners_and_sides_on_grid_lines(spark):
    """Whole and half coordinates: corners, sides and points on borders and corners of cells."""
    draw = random.Random(8)
    zones = []
    for i in range(14):
        around = sorted((math.atan2(y, x), x, y) for x, y in {(draw.randint(-6, 6), draw.randint(-6, 6)) for _ in range(9)} if x or y)
        by_angle = {round(a, 9): (x + 3 * (i % 4), y + 3 * (i // 4)) for a, x, y in around}
        zones.append((i, [ring(*by_angle.values())]))
    zones.append((14, [ring((0, 0), (8, 0), (8, 8), (0, 8)), list(reversed(ring((2, 2), (6, 2), (6, 6), (2, 6)))), ring((3, 3), (5, 3), (5, 5), (3, 5))]))
    spots = [(k, x / 2, y / 2) for k, (x, y) in enumerate(itertools.product(range(-18, 40), range(-18, 40)))]
    df, shapes = spark.createDataFrame(spots, POINT).cache(), spark.createDataFrame(zones, ZONE)
    hits = {(i, z) for i, x, y in spots for z, rings in zones if inside(rings, x, y)}
    for size in (1.0, 2.0, 3.5, None):
        found = S.spatial_join(df, shapes, "zone_id", "inner", size).select("source_id", "zone_id").collect()
        assert sorted(map(tuple, found)) == sorted(hits)
    near = {r.source_id: r for r in S.nearest_join(df, shapes, "zone_id", 1.5, cell_size=2.0).collect()}
    for i, x, y in spots:
        best = min((gap(rings, x, y), z) for z, rings in zones)
        assert near[i].zone_id == (best[1] if best[0] <= 1.5 else None)


def test_polygon_of_many_sides(spark):
    corners = 50_000
    turn = np.arange(corners) * 2 * math.pi / corners
    far = 9000 + 400 * np.sin(37 * turn) + 50 * np.random.default_rng(1).random(corners)
    xs, ys = far * np.cos(turn), far * np.sin(turn)
    zones = spark.createDataFrame([(1, [ring(*zip(xs, ys))])], ZONE)
    spots = np.random.default_rng(2).uniform(-10_000, 10_000, (400, 2))
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(spots)], POINT)
    x, y = spots[:, :1], spots[:, 1:]
    bx, by = np.roll(xs, -1), np.roll(ys, -1)
    odd = (((ys > y) != (by > y)) & (x < (bx - xs) * (y - ys) / (by - ys) + xs)).sum(axis=1) % 2 == 1
    cells = P.polygon_cells(zones, ["zone_id"], P.fitting_size(zones))
    most, held = cells.agg(F.max(F.size("_sides")), F.sum(F.size("_sides"))).first()
    assert most < 400 and held < 3 * corners
    assert {r.source_id for r in S.spatial_join(df, zones, "zone_id", "inner").collect()} == set(np.flatnonzero(odd).tolist())
    near = {r.source_id: r.distance for r in S.nearest_join(df, zones, "zone_id", 300.0).collect()}
    part = np.clip(((x - xs) * (bx - xs) + (y - ys) * (by - ys)) / ((bx - xs) ** 2 + (by - ys) ** 2), 0, 1)
    away = np.where(odd, 0, np.hypot(xs + part * (bx - xs) - x, ys + part * (by - ys) - y).min(axis=1))
    for k, d in enumerate(away):
        assert near[k] == (pytest.approx(d) if d <= 300 else None)
    assert S.spatial_anti_join(zones, zones, "zone_id").count() == 0


def test_points_are_read_once(spark, shapes, tmp_path):
    spark.createDataFrame([(1, 2.0, 3.0)], POINT).write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))
    zones = spark.createDataFrame(shapes, ZONE)
    for found in (S.assign_zone(points, zones, "zone_id", 30.0), S.spatial_join(points, zones, "zone_id")):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_rings_inside_others_meet(spark):
    """No side meets: a second part inside the other polygon, and polygons within a hole."""
    far, near = ring((100, 100), (101, 100), (101, 101), (100, 101)), ring((4, 4), (5, 4), (5, 5), (4, 5))
    block, hole = ring((0, 0), (10, 0), (10, 10), (0, 10)), list(reversed(ring((3, 3), (7, 3), (7, 7), (3, 7))))
    parts = spark.createDataFrame([(1, [far, near])], ZONE)
    assert [r.zone_id for r in S.spatial_semi_join(parts, spark.createDataFrame([(9, [block])], ZONE), "zone_id").collect()] == [1]
    assert [r.zone_id for r in S.spatial_semi_join(spark.createDataFrame([(9, [block])], ZONE), parts, "zone_id").collect()] == [9]
    assert S.spatial_semi_join(parts, spark.createDataFrame([(9, [block, hole])], ZONE), "zone_id").count() == 0
    empty = spark.createDataFrame([(9, None)], ZONE)
    assert S.spatial_anti_join(parts, empty, "zone_id").count() == 1
    assert S.spatial_join(spark.createDataFrame([(1, None, 2.0)], POINT), parts, "zone_id").collect()[0].zone_id is None


def test_area_and_centroid_respect_holes(spark):
    hole = list(reversed(ring((1000, 1000), (3000, 1000), (3000, 3000), (1000, 3000))))
    zones = spark.createDataFrame([(1, [ring((0, 0), (4000, 0), (4000, 4000), (0, 4000)), hole])], ZONE)
    assert polygon_area_km2(zones).first()["area_sqkm"] == 12.0
    at = centroids(zones).first()
    assert (at.x, at.y) == (2000.0, 2000.0)


def test_wkb_orders_and_failures():
    import struct

    box = [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)]
    flat = [float(v) for p in box for v in p]
    little = struct.pack("<BIII10d", 1, 3, 1, 5, *flat)
    big = struct.pack(">BIII10d", 0, 3, 1, 5, *flat)
    many = struct.pack("<BII", 1, 6, 2) + little + little
    assert _read_wkb(little)[2] == _read_wkb(big)[2] == [ring((0, 0), (2, 0), (2, 2), (0, 2))]
    assert len(_read_wkb(many)[2]) == 2
    assert _read_wkb(struct.pack(">BIdd", 0, 1, 3, 4)) == (3.0, 4.0, None)
    for bad in (None, b"", b"\x01", little[:-3]):
        assert _read_wkb(bad) == (None, None, None)


def test_hex_grid_covers_the_box_and_matches_binning(spark):
    box = spark.createDataFrame([(0.0, 0.0, 900.0, 700.0)], "minx double, miny double, maxx double, maxy double")
    cells = grid.hex_grid(spark, box, 100.0)
    draw = random.Random(9)
    points = spark.createDataFrame([(i, draw.uniform(0, 900), draw.uniform(0, 700)) for i in range(500)], POINT)
    joined = S.spatial_join(points, cells.select("grid_id", "rings"), "grid_id", "inner", 100.0)
    binned = grid.bin_points(points, 100.0)
    assert sorted((r.source_id, r.grid_id) for r in joined.collect()) == sorted(
        (r.source_id, r.grid_id) for r in binned.select("source_id", "grid_id").collect()
    )
    queen = {(r.i, r.j) for r in N.queen_weights(cells).collect()}
    assert queen == {(r.i, r.j) for r in grid.hex_neighbors(cells).collect()}


def clustered(seed):
    draw = random.Random(seed)
    wide = [(draw.uniform(0, 1e5), draw.uniform(0, 1e5)) for _ in range(60)]
    tight = [(5e4 + draw.uniform(0, 3), 5e4 + draw.uniform(0, 3)) for _ in range(60)]
    return [(i, float(x), float(y)) for i, (x, y) in enumerate(wide + tight + [(7.0, 7.0)] * 40)]


def test_knn_equals_brute_force_on_crowds_and_copies(spark):
    points = clustered(1)
    found = {}
    for r in N.knn_weights(spark.createDataFrame(points, POINT), 6, "source_id").collect():
        found.setdefault(r.i, []).append((r.distance, r.j))
    for i, x, y in points:
        near = sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), j) for j, a, b in points if j != i)[:6]
        assert [j for _, j in sorted(found[i])] == [j for _, j in near]


def test_knn_with_fewer_points_than_k(spark):
    found = N.knn_weights(spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 0.0)], POINT), 6, "source_id")
    assert sorted((r.i, r.j) for r in found.collect()) == [(1, 2), (2, 1)]


def test_distance_band_equals_brute_force(spark):
    points = clustered(2)
    found = {(r.i, r.j): r.w for r in N.distance_band_weights(spark.createDataFrame(points, POINT), 9000.0, "source_id").collect()}
    want = {}
    for (i, x, y), (j, a, b) in itertools.permutations(points, 2):
        d = math.sqrt((x - a) * (x - a) + (y - b) * (y - b))
        if d <= 9000:
            want[(i, j)] = 1 / d if d else None
    assert found == pytest.approx(want)


def test_merge_close_points_equals_union_find(spark):
    chain = [(200 + i, 2e5 + 150.0 * i, 0.0) for i in range(25)]
    points = clustered(3) + chain
    group = {i: i for i, _, _ in points}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for (i, x, y), (j, a, b) in itertools.combinations(points, 2):
        if (x - a) ** 2 + (y - b) ** 2 <= 200**2:
            low, high = sorted((root(i), root(j)))
            group[high] = low
    members = {}
    for i, x, y in points:
        members.setdefault(root(i), []).append((x, y))
    found = {r.first_key: r for r in D.merge_close_points(spark.createDataFrame(points, POINT), 200.0, "source_id").collect()}
    assert found.keys() == members.keys()
    for first, spots in members.items():
        distinct = set(spots)
        assert found[first].members == len(spots)
        assert found[first].x == pytest.approx(sum(x for x, _ in distinct) / len(distinct))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_equi_join_equals_a_plain_join(spark, how):
    tag = F.create_map(F.lit("a"), F.col("id") % 2)
    big = spark.range(300).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).alias("k"), tag.alias("tags"))
    small = spark.range(0, 40, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got, want = equi_join(big, small, ["k"], how), big.join(small, "k", how)
    columns = sorted(want.columns)
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    assert J.dedup_first(got.select("id", "k"), ["k"], ["id"]).count() == got.select("k").distinct().count()


@pytest.mark.parametrize("shuffled", [False, True])
def test_long_chains_take_few_rounds(spark, shuffled):
    names = list(range(2, 1602))
    if shuffled:
        random.Random(3).shuffle(names)
    else:
        names[0], names[-1] = 0, 1
    links = spark.createDataFrame([(str(a).zfill(5), str(b).zfill(5)) for a, b in zip(names[:-1], names[1:])], "a string, b string")
    rounds = []
    got = star_components(links, rounds.append).collect()
    assert len(got) == 1600 and len({r.root for r in got}) == 1
    assert len(rounds) <= 15


@pytest.mark.parametrize("extra", [0, 40])
def test_neighbours_among_copies(spark, extra):
    rng = random.Random(8)
    points = [(i, 720000.0, 6170000.0) for i in range(12)] + [(20 + i, 720000.0 + rng.random(), 6170000.0 + rng.random()) for i in range(4)]
    points += [(100 + i, 720000.0 + rng.randint(-900, 900), 6170000.0 + rng.randint(-900, 900)) for i in range(extra)]
    got = {}
    for r in N.knn_weights(spark.createDataFrame(points, POINT), 6, "source_id").collect():
        got.setdefault(r.i, []).append((r.distance, r.j))
    for i, x, y in points:
        near = sorted((math.sqrt((a - x) ** 2 + (b - y) ** 2), j) for j, a, b in points if j != i)[:6]
        assert [j for _, j in sorted(got[i])] == [j for _, j in near]


def test_distance_of_a_point_to_a_side(spark):
    zones = spark.createDataFrame([(1, [ring((0, 0), (10, 0), (10, 10), (0, 10))])], ZONE)
    edges = G.polygon_edges(F.col("rings"))
    row = zones.select(
        G.distance_to_boundary(edges, F.lit(13.0), F.lit(14.0)).alias("corner"),
        G.distance_to_boundary(edges, F.lit(5.0), F.lit(-2.0)).alias("side"),
    ).first()
    assert (row.corner, row.side) == (5.0, 2.0)


def test_rectangles_are_settled_by_boxes(spark, monkeypatch):
    """Boxes stacked on each other, and other shapes in them: against all pairs. No rectangle is looked up by points."""
    draw = random.Random(3)
    sizes = [(draw.randint(0, 12), draw.randint(0, 12), draw.randint(1, 6), draw.choice([1, 2, 3, 40])) for _ in range(160)]
    boxes = [(x, y, x + w, y + h) for x, y, w, h in sizes] + [(0, 0, 1, 1), (0, 0, 1, 1)]
    polygons = [(k, [ring((a, b), (c, b), (c, d), (a, d))]) for k, (a, b, c, d) in enumerate(boxes)]
    inner = {k for k, p in enumerate(boxes) if any(k != n and q[0] <= p[0] and q[1] <= p[1] and q[2] >= p[2] and q[3] >= p[3] for n, q in enumerate(boxes))}
    looked = []
    search = S.spatial_join
    monkeypatch.setattr(S, "spatial_join", lambda points, zones, *rest: looked.append(zones.count()) or search(points, zones, *rest))
    assert {r.zone_id for r in S.contained_polygons(spark.createDataFrame(polygons, ZONE), "zone_id").collect()} == inner
    assert looked == [0]
    # The same box named from another corner, a triangle in a box, a box in a triangle, a box with an unknown corner.
    shapes = [
        (1, [ring((0, 0), (9, 0), (9, 9), (0, 9))]), (2, [ring((9, 0), (9, 9), (0, 9), (0, 0))]), (3, [ring((1, 1), (8, 1), (1, 8))]), (4, [ring((2, 2), (3, 2), (3, 3), (2, 3))]),
        (5, [ring((20, 0), (60, 0), (20, 40))]), (6, [ring((22, 2), (25, 2), (25, 5), (22, 5))]), (7, [ring((50, 30), (52, 30), (52, 32), (50, 32))]),
        (8, [[{"x": 1.0, "y": 1.0}, {"x": None, "y": 1.0}, {"x": None, "y": None}, {"x": 1.0, "y": None}, {"x": 1.0, "y": 1.0}]]),
    ]
    assert {r.zone_id for r in S.contained_polygons(spark.createDataFrame(shapes, ZONE), "zone_id").collect()} == {1, 2, 3, 4, 6}


def test_zone_graph_reads_written_outlines(spark):
    """Outlines that are expressions do not reach the plan of the graph, which could not be optimised with them inside centroids."""
    cells = grid.used_cells(spark.createDataFrame([(k, 700.0 * k, 900.0 * (k % 7)) for k in range(60)], POINT), 1000.0)
    graph = N.zone_graph(grid.hex_outlines(cells, 1000.0), 2)
    assert "LogicalRDD" not in graph._jdf.queryExecution().analyzed().toString()
    assert graph.groupBy("i").count().filter("count < 2").count() == 0


def test_distance_band_tasks_follow_the_pairs(spark, monkeypatch):
    """A crowd is spread over tasks by the pairs it forms, with the same pairs."""
    draw = random.Random(4)
    points = [(k, draw.uniform(0, 50), draw.uniform(0, 50)) for k in range(300)] + [(k, 500.0, draw.uniform(0, 3)) for k in range(300, 330)] + [(400, None, 1.0)]
    monkeypatch.setattr(N, "BAND_POINTS", 16)
    monkeypatch.setattr(N, "BAND_PAIRS", 1000)
    edges = N.distance_band_weights(spark.createDataFrame(points, POINT), 10.0, "source_id")
    known = [p for p in points if p[1] is not None]
    near = {(i, j) for i, a, b in known for j, c, d in known if i != j and math.hypot(a - c, b - d) <= 10}
    assert sorted((r.i, r.j) for r in edges.collect()) == sorted(near)
    assert edges.rdd.getNumPartitions() > 8


def test_distance_band_blocks_meet_once_with_copies_and_odd_points(spark, monkeypatch):
    """Blocks that meet once give each pair of rows in both directions: repeated rows, keys and places, missing keys, points without a place."""
    draw = random.Random(6)
    points = [(k, draw.uniform(-25, 25), draw.uniform(-25, 25)) for k in range(150)] + [(k % 3, 4.0, 4.0) for k in range(40)]
    points += [(200, 0.0, 0.0), (201, 10.0, 0.0), (202, -1e-20, 0.0), (203, 10.0, 10.0), (None, 1.0, 1.0), (205, None, 1.0)]
    points += [(206, float("nan"), 1.0), (207, float("inf"), 1.0), (208, 1.0, -float("inf")), (209, float("inf"), 1.0)]
    monkeypatch.setattr(N, "BAND_POINTS", 8)
    monkeypatch.setattr(N, "BAND_SLICE", 3)
    edges = N.distance_band_weights(spark.createDataFrame(points, POINT), 10.0, "source_id")
    rows = [p for p in points if None not in p and all(map(math.isfinite, p))]
    far = [(i, j, math.sqrt((a - c) * (a - c) + (b - d) * (b - d))) for i, a, b in rows for j, c, d in rows if i != j]
    expected = sorted((i, j, d, 1 / d if d else 0.0) for i, j, d in far if d <= 10)
    assert sorted((r.i, r.j, r.distance, r.w or 0.0) for r in edges.collect()) == expected
    # Points meet as arrays: no join hands on single pairs.
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("Generate inline(") == 3
    assert N.distance_band_weights(spark.createDataFrame([], POINT), 10.0, "source_id").count() == 0


def test_isolated_points_form_no_pairs(spark, monkeypatch):
    draw = random.Random(5)
    points = [(k, draw.uniform(0, 200), draw.uniform(0, 200)) for k in range(150)]
    points += [(500, 1000.0, 1000.0), (500, 1001.0, 1000.0), (501, 1000.0, 1006.0), (502, 1000.0, -3000.0), (503, None, 5.0), (504, float("nan"), 5.0), (505, float("nan"), 5.0), (None, 10.0, 10.0)]
    points += [(600, -10.0, -400.0), (601, 0.0, -400.0), (602, 10.001, -400.0), (700, 0.0, -600.0), (700, 0.0, -600.0)]
    linked = {i for i, a, b in points for j, c, d in points if None not in (i, j, a, c) and i != j and math.hypot(a - c, b - d) <= 10}
    expected = sorted((k for k, _, _ in points if k not in linked), key=str)
    monkeypatch.setattr(N, "distance_band_weights", None)
    found = N.isolated_points(spark.createDataFrame(points, POINT), 10.0, "source_id")
    assert sorted((r.source_id for r in found.collect()), key=str) == expected
