"""Exact positions and quantiles without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthway.session import cut_lineage


def _sliced(df: DataFrame, order: list[str]) -> DataFrame:
    """Range-partition by `order` and number the slices in `_slice`.

    The written copy fixes the slices: range bounds are sampled, so they must not be
    drawn again when a later step reads the slices a second time.
    """
    slices = df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id())
    return cut_lineage(slices)


def global_position(df: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    """Zero-based position of every row in the total order `order`.

    Each slice is numbered by itself and shifted by the rows of the slices before it.
    There are as many offsets as slices, so their broadcast is bounded by the number of
    shuffle partitions.
    """
    rows = _sliced(df, order)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_slice").orderBy(*order)
    return (
        rows.join(F.broadcast(offsets), "_slice")
        .withColumn(out, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_slice", "_offset")
    )


def grouped_quantiles(df: DataFrame, by: list[str], value: str, points: list[float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per group: (by..., q, quantile).

    Equal values collapse to one counted row on the map side, the counted values are
    range-partitioned, and only the slices that hold a wanted rank are looked at again.
    A group of any size is therefore spread over many tasks.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    slices = _sliced(counted, [*by, "_value"])

    group = Window.partitionBy(*by)
    totals = (
        slices.groupBy(*by, "_slice")
        .agg(F.sum("_count").alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(group.orderBy("_slice")) - F.col("_rows"))
        .withColumn("_total", F.sum("_rows").over(group))
    )
    wanted = (
        totals.withColumn("q", F.explode(F.array(*[F.lit(float(p)) for p in points])))
        .withColumn("_rank", F.col("q") * (F.col("_total") - 1))
        .withColumn("_side", F.explode(F.array(F.lit("low"), F.lit("high"))))
        .withColumn("_place", F.when(F.col("_side") == "low", F.floor("_rank")).otherwise(F.ceil("_rank")))
        .withColumn("_place", F.col("_place") - F.col("_before"))
        .filter("_place >= 0 and _place < _rows")
        .select(*by, "_slice", "q", "_side", "_place", "_rank")
    )

    keys = [*by, "_slice"]
    inside = Window.partitionBy(*keys).orderBy("_value")
    candidates = (
        slices.join(wanted.select(*keys).distinct(), keys, "left_semi")
        .withColumn("_upto", F.sum("_count").over(inside))
        .withColumn("_from", F.col("_upto") - F.col("_count"))
    )
    found = candidates.join(wanted, keys).filter("_place >= _from and _place < _upto")
    low = F.max(F.when(F.col("_side") == "low", F.col("_value")).cast("double"))
    high = F.max(F.when(F.col("_side") == "high", F.col("_value")).cast("double"))
    fraction = F.max(F.col("_rank") - F.floor("_rank"))
    return found.groupBy(*by, "q").agg((low + (high - low) * fraction).alias("quantile"))


def quantiles(df: DataFrame, columns: list[str], points: list[float]) -> DataFrame:
    """Exact quantiles of several columns at once: (variable, q, quantile)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "variable", "value"
    )
    return grouped_quantiles(long, ["variable"], "value", points)
