"""Trip tables: one Parquet file or folder per service and neighbour."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthway import settings
from hearthway.functions.scalar import nan_to_null


def read_trips(
    spark: SparkSession,
    folder: str,
    services: list[str] = settings.SERVICES,
    neighbors: int = 1,
    suffix: str = settings.TRIP_FILE_SUFFIX,
) -> DataFrame:
    """All trips as one long table with `service` and `neighbor`.

    A single glob names every wanted file, so absent ones are skipped and the whole set
    is one scan with one merged schema; the tags come from the file names.
    """
    names = [f"{service}_{i}" for service in services for i in range(1, neighbors + 1)]
    pattern = f"{folder}/{{{','.join(names)}}}{suffix}"
    # Names are matched as given, the longest first, whatever characters they hold.
    known = "|".join(re.escape(s) for s in sorted(services, key=len, reverse=True))
    shape = rf"(?:^|/)({known})_([0-9]+){re.escape(suffix)}(?:/|$)"
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    tag, number = F.regexp_extract(path, shape, 1), F.regexp_extract(path, shape, 2)
    trips = spark.read.option("mergeSchema", "true").parquet(pattern)
    return nan_to_null(trips.select("*", tag.alias("service"), number.cast("int").alias("neighbor")))


def write_trips(trips: DataFrame, folder: str, suffix: str = settings.TRIP_FILE_SUFFIX) -> None:
    """Write a long trip table in the one-folder-per-service layout.

    The list of datasets is a grouped result no longer than services times neighbours.
    """
    pairs = [(r["service"], r["neighbor"]) for r in trips.groupBy("service", "neighbor").count().collect()]
    for service, neighbor in pairs:
        part = trips.filter((F.col("service") == service) & (F.col("neighbor") == neighbor))
        part.drop("service", "neighbor").write.parquet(f"{folder}/{service}_{neighbor}{suffix}")
