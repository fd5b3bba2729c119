"""Correlations of many columns in one pass.

Every task turns its rows into blocks of a matrix and adds up four products of values and of marks for known values. That gives, for each pair of columns, the
number of rows in which both are known and their sums and products over just these rows. One row per task and pair is left to be added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthway.operators.columns import names_containing

#: A spread below this share of the mean is rounding: the column counts as constant.
ROUNDING = 1e-12
STATES = ["n", "x", "y", "xx", "yy", "xy"]


def _values(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The rows as a matrix with 0 for missing values, and which are known."""
    columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
    table = np.column_stack(columns)
    known = ~np.isnan(table)
    return np.where(known, table, 0.0), known


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per task and pair of columns (a <= b, by place): rows with both, their means, squares and products about these means."""
    width = len(columns)
    upper = np.triu_indices(width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin, found = np.zeros(width), np.zeros(width, bool)
        n, one, two, both = (np.zeros((width, width)) for _ in range(4))
        for batch in batches:
            if not batch.num_rows:
                continue
            table, known = _values(batch)
            # Differences to the first known value of a column lose no digits to a large common part.
            fresh = known.any(axis=0) & ~found
            origin[fresh] = table[known.argmax(axis=0), np.arange(width)][fresh]
            found |= fresh
            table = np.where(known, table - origin, 0.0)
            marks = known.astype(float)
            n += marks.T @ marks
            one += table.T @ marks
            two += (table * table).T @ marks
            both += table.T @ table
        a, b = (x[n[upper] > 0] for x in upper)
        rows, x, y = n[a, b], one[a, b], one[b, a]
        values = [rows, origin[a] + x / rows, origin[b] + y / rows, two[a, b] - x * x / rows, two[b, a] - y * y / rows, both[a, b] - x * y / rows]
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *map(pa.array, values)], names=["a", "b", *STATES])

    narrow = df.select(*[F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    return narrow.mapInArrow(add, "a int, b int, " + ", ".join(f"{s} double" for s in STATES))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every ordered pair: (a, b, r), over rows where both exist; NaN is missing.

    r is NULL where one side is constant.
    """
    parts = pair_moments(df, columns).groupBy("a", "b").agg(F.collect_list(F.struct(*STATES)).alias("parts"))

    def total(value) -> Column:
        return F.aggregate("parts", F.lit(0.0), lambda s, p: s + value(p))

    means = parts.withColumn("n", total(lambda p: p["n"]))
    means = means.withColumns({c: total(lambda p, c=c: p["n"] * p[c]) / F.col("n") for c in "xy"})

    def about(c: str, d: str) -> Column:
        return total(lambda p: p[c + d] + p["n"] * (p[c] - F.col(c)) * (p[d] - F.col(d)))

    moments = means.withColumns({c + d: about(c, d) for c, d in ("xx", "yy", "xy")})

    def spread(c: str) -> Column:
        least = F.col("n") * F.pow(F.col(c) * ROUNDING, F.lit(2.0))
        return F.when(F.col(c + c) > least, F.col(c + c))

    r = F.col("xy") / F.sqrt(spread("x") * spread("y"))
    bounded = F.when(F.col("a") == F.col("b"), F.when(spread("x").isNotNull(), F.lit(1.0))).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    names = F.array(*[F.lit(c) for c in columns])
    sides = [("a", "b"), ("b", "a")]
    turned = F.explode(F.array(*[F.struct(names[F.col(p)].alias("a"), names[F.col(q)].alias("b"), F.when(r.isNotNull(), bounded).alias("r"), F.lit(k).alias("turn")) for k, (p, q) in enumerate(sides)]))
    known = moments.select(F.col("a").alias("_i"), F.col("b").alias("_j"), turned.alias("p")).filter("_i != _j or p.turn = 0").select("p.a", "p.b", "p.r")
    # Pairs that never occur together are in no part.
    every = df.sparkSession.createDataFrame([(a, b) for a in columns for b in columns], "a string, b string")
    return every.join(known, ["a", "b"], "left")


def correlation_by_group(df: DataFrame, token: str) -> DataFrame:
    """The matrix of the numeric columns whose name holds `token`: a service or a measure."""
    return correlation_matrix(df, names_containing(df, [token]))
