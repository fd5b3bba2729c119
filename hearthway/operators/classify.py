"""Class numbers for maps. Classes count from 0; missing values have no class."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthway import settings
from hearthway.operators.ranking import quantiles


def class_of(value: Column, bounds: list, above: bool = True) -> Column:
    """Index of the first upper bound that is not below `value`.

    Values over the last bound form one more class, or none when `above` is False.
    """
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for index, bound in enumerate(bounds):
        out = out.when(value <= bound, F.lit(index))
    return out.otherwise(F.lit(len(bounds)) if above else F.lit(None).cast("int"))


def classify_fixed(df: DataFrame, column: str, bounds: list[float], out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{column}_class", class_of(F.col(f"`{column}`"), bounds))


def quantile_bounds(df: DataFrame, column: str, k: int, round_to: float | None = None) -> list[float]:
    """The k upper bounds of quantile classes, at most k numbers; equal bounds collapse."""
    wanted = quantiles(df, [column], [i / k for i in range(1, k + 1)])
    value = F.col("quantile") if round_to is None else F.bround(F.col("quantile") / round_to) * round_to
    return [r["bound"] for r in wanted.select(value.alias("bound")).distinct().orderBy("bound").collect()]


def classify_quantiles(df: DataFrame, column: str, k: int, round_to: float | None = None) -> DataFrame:
    """Quantile classes of `column`, with bounds rounded to a multiple when asked."""
    return classify_fixed(df, column, quantile_bounds(df, column, k, round_to))


def classify_natural(df: DataFrame, column: str, k: int = 5, seed: int = 13) -> DataFrame:
    """Natural breaks: k-means on the single column, classes numbered by their centres.

    Adds `{column}_class` and `{column}_upper`, the largest value of the class.
    """
    known = df.filter(F.col(column).isNotNull()).withColumn("_value", F.col(column).cast("double"))
    features = VectorAssembler(inputCols=["_value"], outputCol="_features")
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="_label").fit(features.transform(known))
    centres = sorted((float(c[0]), i) for i, c in enumerate(model.clusterCenters()))
    # Nearest centre in one dimension: the first class whose upper midpoint is not below.
    middles = [(a[0] + b[0]) / 2 for a, b in zip(centres, centres[1:])]
    classed = known.withColumn(f"{column}_class", class_of(F.col("_value"), middles))
    uppers = classed.groupBy(f"{column}_class").agg(F.max("_value").alias(f"{column}_upper"))
    return classed.drop("_value").join(F.broadcast(uppers), f"{column}_class", "left").select(
        *df.columns, f"{column}_class", f"{column}_upper"
    )


def classify_bivariate(
    df: DataFrame, pairs: list[tuple[str, str]], bounds: list[float] = settings.BIVARIATE_BOUNDS
) -> DataFrame:
    """Class i * n + j of every pair of columns in [0, 1], as `{a}__{b}`.

    NULL where a value is missing, negative or above the last bound.
    """
    n = len(bounds)

    def part(name: str) -> Column:
        value = F.col(f"`{name}`")
        return F.when(value >= 0, class_of(value, bounds, above=False))

    return df.withColumns({f"{a}__{b}": part(a) * n + part(b) for a, b in pairs})
