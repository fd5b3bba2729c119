"""Small column expressions with the null rules of the analysis."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Aggregates skip NULL but not NaN, so missing numbers become NULL on reading."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in floats})


def sum_missing_as_zero(columns: Iterable[Column | str]) -> Column:
    """Row sum in which a missing value counts as 0."""
    terms = [F.col(c) if isinstance(c, str) else c for c in columns]
    return reduce(add, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in terms])


def sum_or_null(columns: Iterable[str]) -> Column:
    """Row sum that is NULL when any value is."""
    return reduce(add, [F.col(c) for c in columns])


def percent_of(part: Column, total: Column) -> Column:
    return F.try_divide(part, total) * 100


def rounded(value: Column, digits: int) -> Column:
    """`F.round` of a double, which goes through decimals and takes most of the time where rows are many.

    A whole number divided by a power of ten gives the same double as its decimal; only values near a tie or too large for that go the long way.
    """
    scaled = value * 10.0**digits
    whole = F.rint(scaled)
    clear = (F.abs(scaled) < 2.0**40) & (F.abs(scaled - whole) < 0.499)
    return F.when(clear, whole / 10.0**digits + 0.0).otherwise(F.round(value, digits))


def lookup(values: Mapping, key: Column, default=None) -> Column:
    """Value of `key` in a small configuration mapping, as a literal map."""
    entries = [F.lit(x) for pair in values.items() for x in pair]
    found = F.try_element_at(F.create_map(*entries), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def local_time_text(millis: Column, zone: str) -> Column:
    """Epoch milliseconds as local 'yyyy-MM-dd HH:mm'; zero and negative become NULL."""
    moment = F.timestamp_millis(millis.cast("bigint")).cast("timestamp_ntz")
    local = F.convert_timezone(None, F.lit(zone), moment)
    return F.when(millis > 0, F.date_format(local, "yyyy-MM-dd HH:mm"))


def parse_modes(json: Column) -> Column:
    """'{"BUS": 60}' to a map; broken or missing text gives NULL."""
    return F.from_json(json, "map<string,double>")


def transfers_of(json: Column) -> Column:
    """Changes between vehicles: modes other than walking, less one, not below 0."""
    vehicles = F.size(F.map_filter(parse_modes(json), lambda mode, _: F.upper(mode) != "WALK"))
    return F.when(json != "", F.greatest(F.lit(0), vehicles - 1))
