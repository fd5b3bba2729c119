"""The analysis inputs, derived from the star-schema tables.

Homes are customers, trips are orders, zones are nations, islands are regions. Times are
multiples of 1/8, so sums and means do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthway.functions import geometry as G

SERVICES = ["doctor", "school", "supermarket", "library", "train_station"]
WEIGHTS = {"doctor": 0.0625, "school": 5, "supermarket": 5, "library": 1, "train_station": 5}
CELL_SIZE = 5000.0
MEASURES = ["duration_min", "wait_time_dest_min", "total_time_min", "walkDistance", "abs_dist", "transfers", "walk_duration"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("source_id"),
        ((key * 7919) % 100003).cast("double").alias("x"),
        ((key * 104729) % 100019).cast("double").alias("y"),
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of each customer and priority, as a trip to one of five services."""
    names = {
        "1-URGENT": "doctor",
        "2-HIGH": "school",
        "3-MEDIUM": "supermarket",
        "4-NOT SPECIFIED": "library",
        "5-LOW": "train_station",
    }
    service = F.lit("train_station")
    for priority, name in names.items():
        service = F.when(F.col("o_orderpriority") == priority, name).otherwise(service)
    first = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("source_id"), service.alias("service"))
        .agg(F.min("o_orderkey").alias("o_orderkey"), F.min_by("o_totalprice", "o_orderkey").alias("o_totalprice"))
    )
    key, connected = F.col("o_orderkey"), F.col("o_orderkey") % 17 != 0
    timed = first.select(
        "source_id",
        "service",
        F.when(connected, F.floor(F.col("o_totalprice") / 250) / 8).alias("duration_min"),
        F.when(connected, ((key * 11) % 90).cast("double")).alias("wait_time_dest_min"),
        ((key * 13) % 3000).cast("double").alias("walkDistance"),
        ((key * 29) % 20000).cast("double").alias("abs_dist"),
        (key % 4).alias("transfers"),
        (((key * 13) % 3000) / 8).alias("walk_duration"),
    )
    return timed.withColumn("total_time_min", F.col("duration_min") + F.col("wait_time_dest_min"))


def _boxed(df: DataFrame) -> DataFrame:
    return df.withColumn("rings", G.box_rings("minx", "miny", "maxx", "maxy"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    column, row = key % 5, F.floor(key / 5)
    return _boxed(
        table(spark, sf_dir, "nation").select(
            key.alias("zone_id"),
            F.col("n_name").alias("zone_name"),
            (column * 20004 + 100).cast("double").alias("minx"),
            ((column + 1) * 20004 - 100).cast("double").alias("maxx"),
            (row * 20004 + 100).cast("double").alias("miny"),
            ((row + 1) * 20004 - 100).cast("double").alias("maxy"),
        )
    )


def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("r_regionkey")
    return _boxed(
        table(spark, sf_dir, "region").select(
            key.alias("island_id"),
            (key * 21000 + 2000).cast("double").alias("minx"),
            (key * 21000 + 6000).cast("double").alias("maxx"),
            (key * 17000 + 1000).cast("double").alias("miny"),
            (key * 17000 + 5000).cast("double").alias("maxy"),
        )
    )


def diamonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slanted square with a slanted hole per nation; neighbours of large ones overlap."""
    key, column, row = F.col("n_nationkey"), F.col("n_nationkey") % 5, F.floor(F.col("n_nationkey") / 5)

    def ring(radius, clockwise: bool):
        steps = [(1, 0), (0, -1), (-1, 0), (0, 1), (1, 0)] if clockwise else [(1, 0), (0, 1), (-1, 0), (0, -1), (1, 0)]
        x, y = column * 20004 + 10002, row * 20004 + 10002
        return F.array(*(F.struct((x + a * radius).cast("double").alias("x"), (y + b * radius).cast("double").alias("y")) for a, b in steps))

    return table(spark, sf_dir, "nation").select(key.alias("diamond_id"), F.array(ring(key * 150 + 9000, False), ring(key * 50 + 2000, True)).alias("rings"))


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    return (
        table(spark, sf_dir, "customer")
        .groupBy(F.col("c_nationkey").alias("zone_id"))
        .agg(
            F.count(F.lit(1)).alias("households"),
            F.count_if(segment == "AUTOMOBILE").alias("households_with_1_car"),
            F.count_if(segment == "MACHINERY").alias("households_with_2_cars"),
            F.count_if(~segment.isin("AUTOMOBILE", "MACHINERY")).alias("households_without_car"),
            F.count_if(balance < 0).alias("income_low"),
            F.count_if((balance >= 0) & (balance < 5000)).alias("income_mid"),
            F.count_if(balance >= 5000).alias("income_high"),
        )
    )


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, quantity = F.col("l_returnflag"), F.col("l_quantity")

    def seconds(value: str):
        return F.sum(F.when(flag == value, quantity).otherwise(0.0)).cast("bigint").cast("string")

    text = F.concat(
        F.lit('{"WALK":'), seconds("A"), F.lit(',"BUS":'), seconds("N"), F.lit(',"RAIL":'), seconds("R"), F.lit("}")
    )
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(text.alias("mode_durations_json"))
