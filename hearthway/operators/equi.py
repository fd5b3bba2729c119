"""Equi joins whose two sides share column names."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equi_join(
    big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", condition: Column | None = None
) -> DataFrame:
    """Join on equal keys; `how` is inner, left, left_semi or left_anti.

    `condition` may name further columns of both sides. One plan for every size: a key that
    holds many rows of `big` is left to adaptive execution, which splits its partition once
    the shuffle has shown its size.
    """
    right = small.withColumnsRenamed({c: f"_right_{c}" for c in keys})
    on = reduce(and_, [F.col(c) == F.col(f"_right_{c}") for c in keys])
    if condition is not None:
        on = on & condition
    return big.join(right, on, how).drop(*[f"_right_{c}" for c in keys])
