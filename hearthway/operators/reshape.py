"""Stacking, turning and flagging small result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthway.operators.ranking import global_position


def union_services(tables: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """UNION ALL of the same columns of per-service tables, tagged with the service."""
    parts = [t.select(*columns).withColumn("service", F.lit(name)) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def concat_matches(direct: DataFrame, fallback: DataFrame) -> DataFrame:
    return direct.unionByName(fallback)


def unpivot_long(df: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """(keys..., variable, value); missing values are dropped."""
    typed = df.select(*keys, *[F.col(f"`{v}`").cast("double").alias(v) for v in variables])
    return typed.unpivot(keys, variables, "variable", "value").filter(F.col("value").isNotNull())


def transpose(df: DataFrame, key: str, variables: list[str], values: list[str], out: str = "variable") -> DataFrame:
    """Rows named by `key` become columns; the variables become rows."""
    long = df.select(key, *[F.col(v).cast("double").alias(v) for v in variables]).unpivot(
        [key], variables, out, "_value"
    )
    return long.groupBy(out).agg(*[F.max(F.when(F.col(key) == v, F.col("_value"))).alias(str(v)) for v in values])


def flag_row_extremes(summary: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """(measure, key, value, is_max, is_min): which row holds the extremes; ties all count."""
    long = unpivot_long(summary, [key], measures).withColumnRenamed("variable", "measure")
    limits = long.groupBy("measure").agg(F.max("value").alias("_max"), F.min("value").alias("_min"))
    return long.join(limits, "measure").select(
        "measure",
        key,
        "value",
        (F.col("value") == F.col("_max")).alias("is_max"),
        (F.col("value") == F.col("_min")).alias("is_min"),
    )


def best_k(scores: DataFrame) -> DataFrame:
    """The k with the highest mean score; the smallest k on ties."""
    means = scores.groupBy("k").agg(F.avg("score").alias("mean_score"))
    return means.orderBy(F.desc("mean_score"), "k").limit(1)


def limit_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def score_spread(scores: DataFrame) -> DataFrame:
    """Five-number summary of the scores per k; a k has as many scores as runs."""
    points = {"min": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "max": 1.0}
    spread = F.percentile("score", list(points.values()))
    return scores.groupBy("k").agg(spread.alias("s")).select(
        "k", *[F.col("s")[i].alias(name) for i, name in enumerate(points)]
    )


def flag_second_largest(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Second-highest value of each row and the columns that hold it.

    Works inside the row. A repeated maximum is its own runner-up; a row with a single
    value has none.
    """
    values = F.array_compact(F.array(*[F.col(c).cast("double") for c in columns]))
    second = F.get(F.sort_array(values, asc=False), F.lit(1))
    held = F.array_compact(F.array(*[F.when(F.col(c) == F.col("second"), F.lit(c)) for c in columns]))
    return df.select(key, *columns, second.alias("second")).select(
        key, "second", F.array_join(held, ",").alias("columns")
    )


#: Hexadecimal digits of a draw by which draws are counted: 65,536 counts at most.
DIGITS = 4


def sample_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """`n` rows in random but repeatable order of a seeded hash (md5) of the key; 0 keeps all.

    Draws are counted by their first digits, from the key alone. The counts tell below which digits the
    first n draws lie; only rows below are read and ordered, whatever the size of the table.
    """
    if n == 0:
        return df
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    counts = df.select(F.substring(draw, 1, DIGITS).alias("first")).groupBy("first").count().collect()
    bound, held = "", 0
    for first, count in sorted(map(tuple, counts)):
        bound, held = first, held + count
        if held >= n:
            break
    near = df.withColumn("_draw", draw).filter(F.substring("_draw", 1, DIGITS) <= bound)
    return global_position(near, ["_draw", key], "_at").filter(F.col("_at") < n).drop("_draw", "_at")
