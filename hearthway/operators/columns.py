"""Projections, filters and other work on the columns of one table."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthway import settings
from hearthway.functions import geometry as G
from hearthway.functions.scalar import lookup, numeric_columns, percent_of, sum_missing_as_zero, sum_or_null


def null_over_threshold(
    trips: DataFrame,
    max_wait: float | None = None,
    max_duration: float | None = None,
    columns: list[str] = settings.TIME_COLUMNS,
) -> DataFrame:
    """Blank the times of trips that wait or last too long; None switches a test off.

    The wait test comes first, so the duration test sees its result.
    """
    for measure, limit in [("wait_time_dest_min", max_wait), ("duration_min", max_duration)]:
        if limit is not None:
            over = F.coalesce(F.col(measure) >= limit, F.lit(False))
            trips = trips.withColumns({c: F.when(~over, F.col(c)) for c in columns})
    return trips


def names_containing(df: DataFrame, tokens: list[str], numeric: bool = True) -> list[str]:
    pool = numeric_columns(df) if numeric else df.columns
    return [c for c in pool if any(t in c for t in tokens)]


def select_by_substring(df: DataFrame, tokens: list[str], keep: list[str] = ()) -> DataFrame:
    """The fixed columns `keep` and every numeric column whose name holds a token."""
    picked = [c for c in names_containing(df, tokens) if c not in keep]
    return df.select(*[F.col(f"`{c}`") for c in [*keep, *picked]])


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def no_connection_rows(trips: DataFrame) -> DataFrame:
    """Trips without a connection from homes that are not at the service itself."""
    return trips.filter(F.col("duration_min").isNull() & (F.col("abs_dist") > 0))


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def with_global(df: DataFrame, out: str, **aggregates: Column) -> DataFrame:
    """Attach global aggregates as one struct column, through a scalar subquery."""
    one_row = df.agg(F.struct(*[value.alias(name) for name, value in aggregates.items()]).alias("s"))
    return df.withColumn(out, one_row.scalar())


def minmax_normalize(df: DataFrame, columns: list[str]) -> DataFrame:
    """`{c}_norm` in [0, 1] for every column; NULL for a constant column."""
    limits = {f"lo{i}": F.min(F.col(f"`{c}`")) for i, c in enumerate(columns)}
    limits |= {f"hi{i}": F.max(F.col(f"`{c}`")) for i, c in enumerate(columns)}
    df = with_global(df, "_limits", **limits)
    span = {c: F.col("_limits")[f"hi{i}"] - F.col("_limits")[f"lo{i}"] for i, c in enumerate(columns)}
    shift = {c: F.col(f"`{c}`") - F.col("_limits")[f"lo{i}"] for i, c in enumerate(columns)}
    return df.withColumns({f"{c}_norm": F.try_divide(shift[c], span[c]) for c in columns}).drop("_limits")


def row_sum(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    return df.withColumn(out, sum_missing_as_zero([F.col(f"`{c}`") for c in columns]))


def collapse_age_columns(
    census: DataFrame,
    population: str,
    bands: list[str] = settings.AGE_BANDS,
    merges: Mapping[str, list[str]] = settings.AGE_MERGES,
) -> DataFrame:
    """Sum the many columns of each age band into one, then form wider groups.

    Adds `adults` and `-17` (population less adults). Bands are matched in their order,
    each on the columns the earlier ones have left.
    """
    left = list(census.columns)
    sums = {}
    for band in bands:
        members = [c for c in left if band in c]
        left = [c for c in left if c not in members]
        sums[band] = sum_missing_as_zero([F.col(f"`{c}`") for c in members]) if members else F.lit(0.0)
    out = census.select(*[F.col(f"`{c}`") for c in left], *[v.alias(k) for k, v in sums.items()])
    out = row_sum(out, bands, "adults").withColumn("-17", F.col(f"`{population}`") - F.col("adults"))
    for group, members in merges.items():
        out = row_sum(out, members, group)
    return out


def share_of_total(df: DataFrame, parts: Mapping[str, str | list[str]], total: str) -> DataFrame:
    """`out = part / total * 100`; a list of parts is added up first."""
    shares = {}
    for out, part in parts.items():
        value = F.col(f"`{part}`") if isinstance(part, str) else sum_or_null([f"`{p}`" for p in part])
        shares[out] = percent_of(value, F.col(total))
    return df.withColumns(shares)


def census_shares(census: DataFrame) -> DataFrame:
    """All census shares: ages and students of the population, income and cars of households."""
    ages = {f"{group}_pct": group for group in settings.AGE_GROUPS}
    out = share_of_total(census, {**ages, "student_pct": "students"}, "population")
    out = out.withColumn("student_pct", F.coalesce("student_pct", F.lit(0.0)))
    cars = {"households_with_car_pct": ["households_with_1_car", "households_with_2_cars"], **settings.CAR_SHARES}
    return share_of_total(out, {**settings.INCOME_SHARES, **cars}, "households")


def derived_groups(df: DataFrame, groups: Mapping[str, list[str]] = settings.INCOME_GROUPS) -> DataFrame:
    """Sums of shares in which one missing share makes the group missing."""
    for out, parts in groups.items():
        df = df.withColumn(out, sum_or_null([f"`{p}`" for p in parts]))
    return df


def area_key(municipality: Column, number: Column) -> Column:
    """Integer key of a voting area: the code without its first character, 0, the number."""
    code = municipality.cast("string")
    return F.concat(F.substr(code, F.lit(2)), F.lit("0"), number.cast("string")).cast("int")


def polygon_area_km2(zones: DataFrame, out: str = "area_sqkm") -> DataFrame:
    return zones.withColumn(out, G.polygon_area(G.polygon_edges(F.col("rings"))) / 10**6)


def centroids(zones: DataFrame) -> DataFrame:
    """Centroid coordinates `x`, `y` in place of the outline."""
    centre = G.polygon_centroid(G.polygon_edges(F.col("rings")))
    return (
        zones.withColumn("_centre", centre)
        .withColumns({"x": F.col("_centre.x"), "y": F.col("_centre.y")})
        .drop("_centre", "rings", "minx", "miny", "maxx", "maxy")
    )


def population_density(areas: DataFrame) -> DataFrame:
    """Whole persons per square kilometre; missing population counts as 0."""
    persons = F.coalesce(F.col("population"), F.lit(0)).cast("int")
    area = G.polygon_area(G.polygon_edges(F.col("rings"))) / 10**6
    return areas.withColumn("population_density", F.try_divide(persons, area))


def weight_lookup(
    trips: DataFrame, weights: Mapping[str, float] = settings.SERVICE_WEIGHTS, out: str = "weight"
) -> DataFrame:
    """Weight of each row's service, 1 when none is set."""
    literal = {k: float(v) for k, v in weights.items()}
    return trips.withColumn(out, lookup(literal, F.col("service"), 1.0))


def enumerate_datasets(services: DataFrame) -> DataFrame:
    """(service, n_neighbors) to one row per neighbour with its name `{service}_{i}`."""
    return services.select(
        "service", F.explode(F.sequence(F.lit(1), F.col("n_neighbors").cast("int"))).alias("neighbor")
    ).withColumn("dataset", F.concat_ws("_", "service", "neighbor"))


def round_report(df: DataFrame, scale: int = 2, half_even: bool = True) -> DataFrame:
    """Round fractional columns; for reports only, never between steps."""
    rounded = F.bround if half_even else F.round
    types = dict(df.dtypes)
    return df.select(
        *[rounded(F.col(f"`{c}`"), scale).alias(c) if types[c] == "double" else F.col(f"`{c}`") for c in df.columns]
    )


def missing_weights(services: DataFrame, weights: Mapping[str, float] = settings.SERVICE_WEIGHTS) -> DataFrame:
    """Services that have no weight."""
    literal = {k: float(v) for k, v in weights.items()}
    return services.select("service").distinct().filter(lookup(literal, F.col("service")).isNull())


def assert_covered(services: DataFrame, weights: Mapping[str, float] = settings.SERVICE_WEIGHTS) -> None:
    uncovered = missing_weights(services, weights).first()
    if uncovered:
        raise ValueError(f"service {uncovered['service']!r} has no weight")


def check_invariants(
    df: DataFrame,
    key: str | None = None,
    expected_rows: int | None = None,
    not_null: list[str] = (),
    total_100: list[str] = (),
    at_most_100: list[str] = (),
) -> DataFrame:
    """One row of pass/fail flags.

    A unique key is tested on counts per key, so repeated keys shrink before the shuffle.
    """
    rules = {}
    if expected_rows is not None:
        rules["rows_kept"] = F.count(F.lit(1)) == expected_rows
    for c in not_null:
        rules[f"{c}_present"] = F.count_if(F.col(f"`{c}`").isNull()) == 0
    if total_100:
        total = sum_missing_as_zero([F.col(f"`{c}`") for c in total_100])
        rules["shares_add_up"] = F.round(F.max(total), 0) == 100
    for c in at_most_100:
        rules[f"{c}_at_most_100"] = F.coalesce(F.max(F.col(f"`{c}`")) <= 100, F.lit(True))
    flags = df.agg(*[rule.alias(name) for name, rule in (rules or {"any": F.lit(True)}).items()])
    if key is None:
        return flags
    repeated = df.groupBy(key).count().agg((F.coalesce(F.max("count"), F.lit(1)) == 1).alias("unique"))
    return flags.withColumn(f"{key}_unique", repeated.scalar())


def variable_pairs(variables: list[str]) -> list[tuple[str, str]]:
    return list(combinations(variables, 2))
