"""Queries for the readers and writers: data is written to the shared folder and read back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthway.functions import geometry as G
from hearthway.operators.aggregates import service_summary, weighted_time
from hearthway.plans import views as V
from hearthway.plans.registry import query
from hearthway.session import scratch_path
from hearthway.sources.census import read_decimal_comma_csv
from hearthway.sources.tables import load_table, save_table, write_parquet, write_report_csv
from hearthway.sources.trips import read_trips, write_trips
from hearthway.sources.zones import ingest_wkb, read_zones

TRIP_COLUMNS = """source_id, service, duration_min, wait_time_dest_min, total_time_min, "walkDistance", abs_dist,
 transfers, walk_duration"""


@query("read_trips", f"select {TRIP_COLUMNS}, 1 as neighbor from v_trips")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "trips")
    write_trips(V.trips(spark, sf_dir).withColumn("neighbor", F.lit(1)), folder)
    # dentist has no file and is passed over
    return read_trips(spark, folder, [*V.SERVICES, "dentist"])


@query("read_zones", "select zone_id, minx, miny, maxx, maxy from v_zones")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "zones")
    V.zones(spark, sf_dir).drop("minx", "miny", "maxx", "maxy").write.parquet(path)
    return read_zones(spark, path, "zone_id").drop("rings")


@query(
    "read_decimal_comma_csv",
    """select cast(c_custkey as varchar) as id, c_name as name,
 case when c_acctbal < 0 then null else c_acctbal end as balance, cast(c_nationkey as double) as nation from customer""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "census")
    balance = F.col("c_acctbal")
    V.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.when(balance < 0, "-").otherwise(F.replace(balance.cast("string"), F.lit("."), F.lit(","))).alias("balance"),
        F.col("c_nationkey").alias("nation"),
    ).write.csv(path, sep=";", header=True, encoding="UTF-8")
    return read_decimal_comma_csv(spark, path, 2)


def _as_wkb(df: DataFrame) -> DataFrame:
    """(key, x, y) to (key, geometry) with two-dimensional WKB points."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())
            shapes = pa.array([struct.pack("<BIdd", 1, 1, x, y) for x, y in pairs], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("source_id"), shapes], ["source_id", "geometry"])

    return df.mapInArrow(encode, "source_id bigint, geometry binary")


@query("ingest_wkb", "select source_id, x, y from v_points")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest_wkb(_as_wkb(V.points(spark, sf_dir)), "geometry").drop("rings")


def _box_as_wkb(df: DataFrame) -> DataFrame:
    """Zones as clockwise WKB polygons, the other way round than the reader keeps them."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = []
            for b in batch.to_pylist():
                ring = [(b["minx"], b["miny"]), (b["minx"], b["maxy"]), (b["maxx"], b["maxy"]), (b["maxx"], b["miny"])]
                flat = [v for p in [*ring, ring[0]] for v in p]
                shapes.append(struct.pack("<BIII10d", 1, 3, 1, 5, *flat))
            yield pa.RecordBatch.from_arrays([batch.column("zone_id"), pa.array(shapes, pa.binary())], ["zone_id", "geometry"])

    return df.select("zone_id", "minx", "miny", "maxx", "maxy").mapInArrow(encode, "zone_id int, geometry binary")


@query("ingest_wkb_polygons", "select zone_id, (maxx - minx) * (maxy - miny) as area from v_zones")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = ingest_wkb(_box_as_wkb(V.zones(spark, sf_dir)), "geometry")
    return zones.select("zone_id", G.polygon_area(G.polygon_edges(F.col("rings"))).alias("area"))


@query("save_and_load_table", "select source_id, x, y from v_points")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    save_table(V.points(spark, sf_dir), "hearthway_points", scratch_path(spark, "points"))
    return load_table(spark, "hearthway_points")


@query(
    "write_parquet",
    """select source_id, sum(coalesce(total_time_min, 0) * case service when 'doctor' then 0.0625 when 'library' then 1
 else 5 end) as total_weighted_time from v_trips group by source_id""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "weighted")
    write_parquet(weighted_time(V.trips(spark, sf_dir), V.SERVICES, V.WEIGHTS), path)
    return spark.read.parquet(path).select("source_id", "total_weighted_time")


@query(
    "write_report_csv",
    """select service, printf('%.2f', min(duration_min)) as min_duration, printf('%.2f', max(duration_min)) as max_duration,
 cast(max(transfers) as varchar) as max_transfers from v_trips group by service""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "summary")
    summary = service_summary(V.trips(spark, sf_dir))
    write_report_csv(summary.select("service", "min_duration", "max_duration", "max_transfers"), path)
    return spark.read.csv(path, header=True)
