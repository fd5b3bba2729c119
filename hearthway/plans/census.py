"""Socio-economic profile of voting areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthway import settings
from hearthway.operators import columns as C
from hearthway.operators.joins import outer_join_areas


def voting_areas(census: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """Areas with outlines joined to census shares, income groups and population density.

    `census` has the column names of the census files; `areas` has `key` and `rings`.
    """
    aged = C.collapse_age_columns(census, settings.CENSUS_POPULATION)
    shares = C.census_shares(C.rename_columns(aged, settings.CENSUS_NAMES))
    ages = [f"{g}_pct" for g in settings.AGE_GROUPS]
    cars = ["households_with_car_pct", *settings.CAR_SHARES]
    kept = [key, *ages, "student_pct", *settings.INCOME_SHARES, *cars, *settings.CENSUS_NAMES.values()]
    profile = shares.select(*[F.col(f"`{c}`") for c in kept])
    joined = outer_join_areas(areas, profile, key)
    return C.population_density(C.derived_groups(joined))
