"""Named tables and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def save_table(df: DataFrame, name: str, path: str | None = None) -> int:
    """Create or replace a table and return its row count; empty input is refused."""
    if df.isEmpty():
        raise ValueError(f"nothing to save in {name}")
    writer = df.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name).count()


def load_table(spark: SparkSession, name: str, limit: int | None = None) -> DataFrame:
    """Read a table; a missing one is an error at once."""
    if not spark.catalog.tableExists(name):
        raise ValueError(f"no table {name}")
    table = spark.table(name)
    return table.limit(limit) if limit else table


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_report_csv(df: DataFrame, path: str, scale: int = 2) -> None:
    """CSV with a header and a fixed number of decimals in fractional columns."""
    fractional = T.DoubleType | T.FloatType | T.DecimalType

    def shown(field: T.StructField):
        value = F.col(f"`{field.name}`")
        if not isinstance(field.dataType, fractional):
            return value
        text = F.format_string(f"%.{scale}f", F.bround(value, scale))
        return F.when(value.isNotNull(), text).alias(field.name)

    report = df.select(*[shown(f) for f in df.schema.fields])
    report.write.mode("overwrite").option("header", True).csv(path)
