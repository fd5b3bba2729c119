"""Equi joins between homes, trips, zones and census tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthway.operators.equi import equi_join


def attach_zone(trips: DataFrame, zone_map: DataFrame, key: str = "source_id") -> DataFrame:
    """Trips with the zones of their home; homes without a zone are dropped."""
    return equi_join(trips, zone_map, [key])


def join_all_using(tables: list[DataFrame], key: str) -> DataFrame:
    """Inner join of tables with one row per key: a key missing anywhere is dropped.

    All tables are partitioned by the same key, so every one is shuffled once and the
    intermediate results not again.
    """
    return reduce(lambda a, b: a.join(b, key), tables)


def combine_columns(tables: dict[str, DataFrame], columns: list[str], key: str, keep: list[str] = ()) -> DataFrame:
    """Left-join the same columns of several tables to the first, named `{column}_{table}`.

    `keep` are further columns of the first table, such as its geometry.
    """
    parts = [
        table.select(key, *(keep if i == 0 else []), *[F.col(c).alias(f"{c}_{name}") for c in columns])
        for i, (name, table) in enumerate(tables.items())
    ]
    return reduce(lambda a, b: a.join(b, key, "left"), parts)


def merge_outer(tables: dict[str, DataFrame], columns: list[str], key: str) -> DataFrame:
    """Full outer merge of tables with one row per key, as `{table}_{column}`.

    The tables are stacked and folded by one aggregate, so any number of them costs one
    shuffle, and rows of a key combine before it.
    """
    stacked = reduce(
        DataFrame.unionByName,
        [t.select(key, *columns).withColumn("_table", F.lit(name)) for name, t in tables.items()],
    )
    return widen(stacked, [key], "_table", list(tables), columns)


def widen(df: DataFrame, keys: list[str], by: str, values: list[str], columns: list[str]) -> DataFrame:
    """Long to wide: one row per key and a column `{value}_{column}` per value of `by`."""
    cells = [
        F.max(F.when(F.col(by) == value, F.col(column))).alias(f"{value}_{column}")
        for value in values
        for column in columns
    ]
    return df.groupBy(*keys).agg(*cells)


def merge_zone_maps(hex_map: DataFrame, area_map: DataFrame, key: str = "source_id") -> DataFrame:
    return hex_map.join(area_map, key, "left")


def outer_join_areas(areas: DataFrame, census: DataFrame, key: str, population: str = "population") -> DataFrame:
    """Areas and census side by side; areas without population are dropped."""
    return areas.join(census, key, "full").na.drop(subset=[population])


def pair_measures(a: DataFrame, b: DataFrame, key: str, a_names: dict[str, str], b_names: dict[str, str]) -> DataFrame:
    """Chosen columns of two zone tables side by side under new names."""
    left = a.select(key, *[F.col(old).alias(new) for old, new in a_names.items()])
    right = b.select(key, *[F.col(old).alias(new) for old, new in b_names.items()])
    return left.join(right, key)


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the stated order (all other columns break ties).

    A minimum over structs keeps one row per key before the shuffle, so a key with any
    number of rows costs no sort of its own.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(*keys, "_first.*").select(*df.columns)


def keep_members(df: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    return equi_join(df, members.select(*keys).distinct(), keys, "left_semi")


def drop_members(df: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    return equi_join(df, members.select(*keys).distinct(), keys, "left_anti")
