"""Census text files with decimal commas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_decimal_comma_csv(spark: SparkSession, path: str, text_columns: int = 5) -> DataFrame:
    """Semicolon-separated UTF-8 text; '-' is missing.

    The first `text_columns` columns stay text, the others become DOUBLE.
    """
    raw = spark.read.csv(path, sep=";", header=True, encoding="UTF-8", nullValue="-")
    numbers = raw.columns[text_columns:]
    return raw.select(
        *[F.col(f"`{c}`") for c in raw.columns[:text_columns]],
        *[F.expr(f"try_cast(replace(`{c}`, ',', '.') as double) as `{c}`") for c in numbers],
    )
