"""Hand-made rows for missing values, ties and limits."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hearthway.functions.scalar import local_time_text, nan_to_null, rounded, transfers_of
from hearthway.operators.correlation import correlation_matrix
from hearthway.operators import aggregates as A
from hearthway.operators import classify as K
from hearthway.operators import clustering as L
from hearthway.operators import columns as C
from hearthway.operators import destinations as D
from hearthway.operators import reshape as R
from hearthway.sources.census import read_decimal_comma_csv
from hearthway.sources.tables import load_table, save_table, write_report_csv
from hearthway.sources.trips import read_trips

TRIPS = "source_id string, service string, duration_min double, wait_time_dest_min double, total_time_min double, transfers int"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_totals_treat_missing_differently(spark):
    trips = spark.createDataFrame(
        [
            ("a", "doctor", 10.0, 5.0, 15.0, 1),
            ("a", "school", None, None, None, None),
            ("b", "doctor", None, None, None, None),
            ("b", "school", None, None, None, None),
        ],
        TRIPS,
    )
    weighted = A.weighted_time(trips, ["doctor", "school"], {"doctor": 2, "school": 3})
    assert rows(weighted.select("source_id", "total_weighted_time"), "source_id") == [("a", 30.0), ("b", 0.0)]
    assert rows(A.total_times(trips), "source_id") == [("a", 10.0, 5.0, 15.0), ("b", None, None, None)]


def test_unknown_service_weighs_one_and_coverage_is_checked(spark):
    trips = spark.createDataFrame([("a", "zoo", 2.0, 0.0, 2.0, 0)], TRIPS)
    assert C.weight_lookup(trips, {"doctor": 5}).first()["weight"] == 1.0
    with pytest.raises(ValueError):
        C.assert_covered(trips, {"doctor": 5})


def test_wait_test_runs_before_duration_test(spark):
    trips = spark.createDataFrame(
        [("a", "s", 50.0, 70.0, 120.0, 0), ("b", "s", 90.0, 1.0, 91.0, 0), ("c", "s", 60.0, None, None, 0)], TRIPS
    )
    kept = C.null_over_threshold(trips, max_wait=70, max_duration=90)
    assert rows(kept.select("source_id", "duration_min"), "source_id") == [("a", None), ("b", None), ("c", 60.0)]
    assert C.null_over_threshold(trips).collect() == trips.collect()


def test_zone_lacking_a_service_is_dropped(spark):
    trips = spark.createDataFrame(
        [("a", "doctor", 10.0, 0.0, 10.0, 1), ("a", "school", None, None, None, 1), ("b", "doctor", 4.0, 0.0, 4.0, 0)],
        TRIPS,
    )
    zones = spark.createDataFrame([("a", "z1"), ("b", "z2")], "source_id string, grid_id string")
    services = ["doctor", "school"]
    found = A.zone_profile(trips, zones, "grid_id", ["duration_min"], services)
    assert rows(found, "grid_id") == [("z1", 10.0, 0, None, 1, 1)]
    every = A.zone_profile(trips, zones, "grid_id", ["duration_min"], services, require_all=False)
    assert every.count() == 2


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "v double")
    assert nan_to_null(df).agg(F.avg("v")).first()[0] == 1.0


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, 2.0, 5.0), (3.0, None, 5.0)], "a double, b double, c double")
    found = {(r.a, r.b): r.r for r in correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert found[("a", "b")] == pytest.approx(1.0)
    assert found[("a", "c")] is None and found[("c", "c")] is None
    assert found[("a", "a")] == 1.0 and len(found) == 9


def test_correlations_of_many_columns_in_one_scan(spark, tmp_path):
    """45 columns with gaps, on a large common part, over several tasks and against each other."""
    columns = [f"c{i}" for i in range(45)]
    values = [F.when((F.col("id") + i) % 11 != 3, 1e7 * (i % 3) + (F.col("id") * (i + 1) % (i + 7)).cast("double")).alias(c) for i, c in enumerate(columns)]
    spark.range(400).select(*values).repartition(6).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    made = correlation_matrix(df, columns)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    expected = df.toPandas().corr()
    found = made.toPandas()
    assert len(found) == 45 * 45
    for r in found.itertuples():
        assert r.r == pytest.approx(expected.loc[r.a, r.b], abs=1e-9)
    odd = spark.createDataFrame([(1.0, None, float("nan")), (2.0, None, 1.0), (None, 3.0, 2.0), (None, 4.0, 5.0)], "a double, b double, c double")
    got = {(r.a, r.b): r.r for r in correlation_matrix(odd, ["a", "b", "c"]).collect()}
    assert got["a", "b"] is None and got["b", "c"] == pytest.approx(1.0) and got["a", "c"] is None and len(got) == 9
    assert all(r.r is None for r in correlation_matrix(odd.limit(0), ["a", "b"]).collect())


def test_tied_extremes_are_all_flagged(spark):
    summary = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0)], "service string, m double")
    flags = R.flag_row_extremes(summary, "service", ["m"])
    assert rows(flags.select("service", "is_max", "is_min"), "service") == [
        ("a", False, True), ("b", True, False), ("c", True, False)]


def test_best_k_prefers_the_smaller_on_ties(spark):
    scores = spark.createDataFrame([(6, 0.5), (7, 0.5), (8, 0.25)], "k int, score double")
    assert R.best_k(scores).first()["k"] == 6


def test_decimal_comma(spark, tmp_path):
    path = tmp_path / "census.csv"
    path.write_text("id;name;a;b\n1;x;1,5;-\n2;y;-;7\n3;z;abc;1234,25\n", encoding="utf-8")
    table = read_decimal_comma_csv(spark, str(path), 2)
    assert rows(table, "id") == [("1", "x", 1.5, None), ("2", "y", None, 7.0), ("3", "z", None, 1234.25)]


def test_classes(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (9.0,), (None,)], "v double")
    assert [r[1] for r in K.classify_fixed(df, "v", [2, 5]).collect()] == [0, 0, 1, 2, None]
    pairs = spark.createDataFrame([(0.25, 1.0), (0.3, 0.0), (1.1, 0.5), (None, 0.5), (-0.1, 0.5)], "a double, b double")
    assert [r[2] for r in K.classify_bivariate(pairs, [("a", "b")]).collect()] == [3, 4, None, None, None]


def test_natural_breaks_are_ordered(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 50, 51, 52, 100, 101]], "v double")
    found = K.classify_natural(df, "v", 3).groupBy("v_class").agg(F.min("v"), F.max("v"), F.max("v_upper"))
    assert rows(found, "v_class") == [(0, 1.0, 3.0, 3.0), (1, 50.0, 52.0, 52.0), (2, 100.0, 101.0, 101.0)]


def test_robust_scale_without_spread(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0), (4, 9.0)], "id int, v double")
    assert [r["v"] for r in L.robust_scale(df, ["v"]).orderBy("id").collect()] == [0.0, 0.0, 0.0, 4.0]
    flat = spark.createDataFrame([(i, 5.0) for i in range(7)] + [(7, 6.0)], "id int, v double")
    assert [r["v"] for r in L.robust_scale(flat, ["v"]).orderBy("id").collect()] == [0.0] * 7 + [1.0]


def test_histogram_bins_sum_up(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 1, 2, 30]] + [(None,)], "v double")
    bins = A.histogram(df, "v", 10).orderBy("bin").collect()
    assert len(bins) == 10 and sum(b["count"] for b in bins) == 5 and bins[-1]["count"] == 1
    flat = A.histogram(df.filter("v = 1"), "v", 4).orderBy("bin").collect()
    assert [b["count"] for b in flat] == [0, 0, 2, 0] and flat[0]["lower"] == 0.5


def test_modes(spark):
    df = spark.createDataFrame(
        [(1, '{"WALK": 5, "BUS": 2}'), (2, '{"bus": 1, "RAIL": 3}'), (3, ""), (4, None), (5, "{}")], "id int, m string"
    )
    shown = df.select("id", transfers_of(F.col("m")))
    assert rows(shown, "id") == [(1, 0), (2, 1), (3, None), (4, None), (5, 0)]
    wide = D.modes_to_columns(df, "m").drop("m")
    assert wide.columns == ["id", "bus_duration", "rail_duration", "walk_duration"]
    assert rows(wide, "id")[:3] == [(1, 2.0, 0.0, 5.0), (2, 1.0, 3.0, 0.0), (3, 0.0, 0.0, 0.0)]


def test_local_time_knows_summer_time(spark):
    df = spark.createDataFrame([(1, 1704110400000), (2, 1719835200000), (3, 0), (4, -5)], "id int, ms bigint")
    shown = df.select("id", local_time_text(F.col("ms"), "Europe/Copenhagen"))
    assert rows(shown, "id") == [(1, "2024-01-01 13:00"), (2, "2024-07-01 14:00"), (3, None), (4, None)]


def test_second_largest(spark):
    df = spark.createDataFrame([("a", 1, 5, 3), ("b", 4, 4, 1), ("c", None, 2, None)], "id string, p int, q int, r int")
    assert rows(R.flag_second_largest(df, "id", ["p", "q", "r"]), "id") == [
        ("a", 3.0, "r"), ("b", 4.0, "p,q"), ("c", None, "")]


def test_tables(spark, tmp_path):
    df = spark.range(5)
    assert save_table(df, "test_saved", str(tmp_path / "saved")) == 5
    assert load_table(spark, "test_saved", 2).count() == 2
    with pytest.raises(ValueError):
        save_table(df.filter("id > 9"), "test_empty", str(tmp_path / "empty"))
    with pytest.raises(ValueError):
        load_table(spark, "test_absent")


def test_report_format(spark, tmp_path):
    df = spark.createDataFrame([("a", 1234.5, 1), ("b", None, 2)], "k string, v double, n int")
    write_report_csv(df, str(tmp_path / "report"))
    assert rows(spark.read.csv(str(tmp_path / "report"), header=True), "k") == [("a", "1234.50", "1"), ("b", None, "2")]


def test_trip_files_may_be_absent_or_differ(spark, tmp_path):
    spark.range(2).withColumn("bus_duration", F.lit(1.0)).write.parquet(str(tmp_path / "doctor_1_otp_geo.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "train_station_2_otp_geo.parquet"))
    found = read_trips(spark, str(tmp_path), ["doctor", "school", "train_station"], neighbors=2)
    counts = found.groupBy("service", "neighbor").agg(F.count("id"), F.count("bus_duration"))
    assert rows(counts, "service") == [("doctor", 1, 2, 2), ("train_station", 2, 3, 0)]


def test_pivoted_helpers_keep_every_key(spark):
    a = spark.createDataFrame([(1, 0), (2, 3)], "id int, n int")
    b = spark.createDataFrame([(2, 1), (3, 0), (4, 2)], "id int, n int")
    assert rows(D.source_difference(a, b, "id", ["n"]), "id") == [(2, 3, 1, 2), (4, None, 2, -2)]


def test_silhouette_needs_two_clusters(spark):
    with pytest.raises(ValueError):
        L.silhouette_scores(spark.range(3), [1, 2])


def test_neighbours_are_told_apart(spark, tmp_path):
    from hearthway.operators import aggregates as A
    from hearthway.sources.trips import read_trips, write_trips

    rows = [(k, s, n, float(10 * n + k), 1.0, 1) for k in range(3) for s in ("school2", "school") for n in (1, 2)]
    trips = spark.createDataFrame(rows, "source_id long, service string, neighbor int, duration_min double, wait_time_dest_min double, transfers int")
    write_trips(trips, str(tmp_path))
    read = read_trips(spark, str(tmp_path), ["school", "school2"], neighbors=2)
    columns = trips.columns
    assert sorted(map(tuple, read.select(columns).collect())) == sorted(rows)
    found = {(r.service, r.neighbor): (r.mean_duration, r.median_duration) for r in A.service_summary(read).collect()}
    assert found == {(s, n): (10 * n + 1.0, 10 * n + 1.0) for s in ("school", "school2") for n in (1, 2)}
    assert {(r.service, r.neighbor, r.solved) for r in A.connection_counts(read).collect()} == {(s, n, 3) for s in ("school", "school2") for n in (1, 2)}
    weighted = A.weighted_time(read.withColumn("total_time_min", read.duration_min), ["school"], {"school": 2.0, "school2": 1.0}, neighbor=2)
    assert {r.school_2_travel_time for r in weighted.collect()} == {20.0, 21.0, 22.0}
    assert {r.total_duration for r in A.total_times(read).collect()} == {20.0, 22.0, 24.0}


@pytest.mark.parametrize("digits", [0, 2, 6, 9])
def test_rounded_equals_round(spark, digits):
    draw = random.Random(digits)
    values = [draw.uniform(-1, 1) * 10 ** draw.uniform(-12, 18) for _ in range(3000)]
    ties = [(n + 0.5) / 10**digits for n in range(-400, 400)]
    near = [math.nextafter(t, way) for t in ties for way in (-math.inf, math.inf)]
    odd = [None, 0.0, -0.0, -1e-12, 1e308, -1e308, 5e-324, math.inf, -math.inf, math.nan, 2.0**40, 2.0**52 + 0.5]
    table = spark.createDataFrame([(v,) for v in values + ties + near + odd], "v double")
    found = table.select("v", F.round("v", digits).alias("a"), rounded(F.col("v"), digits).alias("b"))
    assert found.filter(~F.col("a").eqNullSafe(F.col("b"))).collect() == []
    assert found.filter("b = 0").filter(F.hex(F.col("b").cast("string")) != F.hex(F.lit("0.0"))).count() == 0
