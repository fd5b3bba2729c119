"""Exact deduplication of a new batch against an immutable snapshot.

A snapshot holds one exact row per distinct text and a static binary fuse filter per bucket
of digests. A batch is first grouped by itself; the filters then screen its distinct
digests, and only those that may be known meet the exact buckets, where the bytes of the
normalised texts are compared.

Two texts are equal when they are identical after deleting ASCII white space
(`[\\x20\\x09-\\x0D]`). Of equal texts the row with the most code points stays, then the
smallest id (null ids last), then one row of any that are alike. Null text counts as empty, so null
and blank texts are one group. Repeated rows are copies of each other. Empty tables give
empty results. Other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthway.llm import fuse
from hearthway.llm.shared import as_bytes, fetch_rows, free_name, trimmed, worker_release
from hearthway.session import cut_lineage

WHITE = b" \t\n\x0b\x0c\r"
#: Distinct digests per bucket, and so per filter, on average at most.
BUCKET_ROWS = 50_000


def with_digest(docs: DataFrame, text: str, name: str = "text_sha256", body: str | None = None) -> DataFrame:
    """Add the SHA-256 (hex) of the normalised text, and that text's bytes as `body` if named."""
    schema = T.StructType([*docs.schema.fields]).add(name, "string")
    if body:
        schema = schema.add(body, "binary")
    place = docs.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_release()
        for batch in batches:
            plain = [x.translate(None, WHITE) for x in as_bytes(batch.column(place))]
            arrays = [*batch.columns, pa.array([hashlib.sha256(x).hexdigest() for x in plain], pa.string())]
            if body:
                arrays.append(pa.array(plain, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(trimmed(add), schema)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, stored: Column) -> DataFrame:
    """A narrow row per document: id, whether it is stored, digest, size in bytes and code points."""
    narrow = docs.select(F.col(id_col).alias("id"), stored.alias("stored"), F.col(text_col).alias("text"))
    schema = narrow.schema.fields[0:2]
    schema = f"id {schema[0].dataType.simpleString()}, stored boolean, digest string, n_bytes long, n_chars long, route long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_release()
        for batch in batches:
            plain = [x.translate(None, WHITE) for x in as_bytes(batch.column(2))]
            digests = [hashlib.sha256(x) for x in plain]
            arrays = [
                batch.column(0),
                batch.column(1),
                pa.array([x.hexdigest() for x in digests], pa.string()),
                pa.array([len(x) for x in plain], pa.int64()),
                pc.fill_null(pc.utf8_length(batch.column(2)), 0).cast(pa.int64()),
                pa.array([int.from_bytes(x.digest()[8:15], "big") for x in digests], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "stored", "digest", "n_bytes", "n_chars", "route"])

    rows = cut_lineage(narrow.mapInArrow(trimmed(scan), schema))
    # The number of a row is fixed once the rows are written.
    return cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))


def grouped(rows: DataFrame) -> DataFrame:
    """One row per distinct text: its size, the row that stays and the number of rows."""
    best = F.min(F.struct((-F.col("n_chars")).alias("longest"), F.col("id").isNull().alias("no_id"), "id", "row"))
    return rows.groupBy("digest", "n_bytes", "route").agg(best.alias("best"), F.count("*").alias("n"))


def filters_of(groups: DataFrame, buckets: int) -> DataFrame:
    """One binary fuse filter per bucket of a snapshot."""

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": frame["bucket"].iloc[:1], "filter": [fuse.build(_keys(frame["digest"]))]})

    keyed = groups.select((F.col("route") % buckets).alias("bucket"), "digest")
    return keyed.groupBy("bucket").applyInPandas(make, "bucket long, filter binary")


def screened(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The digests of a batch that may be in the snapshot; none that is there gets lost."""

    def ask(frame: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(held):
            return frame[["digest"]].iloc[:0]
        return frame[["digest"]][fuse.contains(held["filter"].iloc[0], _keys(frame["digest"]))]

    keyed = groups.select((F.col("route") % buckets).alias("bucket"), "digest")
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(ask, "digest string")


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(x[:16] for x in digests)), ">u8").astype(np.uint64)


def exact_dedup(docs: DataFrame, stored: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group equal texts of stored and incoming rows.

    `stored` tells which rows form the snapshot; the others are the new batch. Returns a row
    per input row: id_col, keep_id, group_size, kept, text_sha256.
    """
    rows = fingerprints(docs, id_col, text_col, stored)
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    old = cut_lineage(grouped(rows.where("stored")))
    new = cut_lineage(grouped(rows.where("not stored")))

    maybe = screened(new, filters_of(old, buckets), buckets)
    pairs = cut_lineage(
        new.join(maybe, "digest").select("digest", "n_bytes", F.col("best.id").alias("new_id"))
        .join(old.select("digest", "n_bytes", F.col("best.id").alias("old_id")), ["digest", "n_bytes"])
    )
    same = pairs.join(_equal_bytes(docs, pairs, id_col, text_col), "digest", "left_semi").select("digest", F.lit(True).alias("same"))

    met = old.withColumn("side", F.lit(True)).unionByName(new.withColumn("side", F.lit(False)))
    met = met.withColumn("same", F.lit(None).cast("boolean")).unionByName(same, allowMissingColumns=True)
    side = {flag: F.when(F.col("side") == flag, F.col("best")) for flag in (True, False)}
    count = {flag: F.sum(F.when(F.col("side") == flag, F.col("n"))) for flag in (True, False)}
    both = met.groupBy("digest").agg(
        F.min(side[True]).alias("old"), F.min(side[False]).alias("new"),
        count[True].alias("n_old"), count[False].alias("n_new"), F.max("same").alias("same"),
    )
    joint = F.coalesce("same", F.lit(False))
    sides = F.array(*[
        F.struct(
            F.lit(flag).alias("stored"),
            F.when(joint, F.least("old", "new")).otherwise(F.col(own)).alias("best"),
            F.when(joint, F.col("n_old") + F.col("n_new")).otherwise(F.col(n)).alias("n"),
        )
        for flag, own, n in ((True, "old", "n_old"), (False, "new", "n_new"))
    ])
    final = both.select("digest", F.inline(sides)).where("n is not null")
    return rows.join(final, ["digest", "stored"]).select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def _equal_bytes(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The digests whose stored and incoming texts are the same bytes.

    Texts are fetched for one row of either side of a pair only, however many copies there are.
    """
    narrow = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.col(text_col).alias("_text"))
    ids = pairs.select(F.explode(F.array("new_id", "old_id")).alias("_id")).select(F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_id")).distinct()
    texts = with_digest(fetch_rows(narrow, ids, "_id").select("_text"), "_text", "digest", "body")
    wanted = texts.join(pairs.select("digest").distinct(), "digest", "left_semi")
    return wanted.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low = high").select("digest")


def drop_copies(docs: DataFrame, stored: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Where the id of a row that stays carries several of its group's texts, that is the longest."""
    own, digest = free_name(docs, "_own"), free_name(docs, "_digest")
    as_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    kept = exact_dedup(docs, stored, id_col, text_col).where("kept").select(as_text.alias(own), F.col("text_sha256").alias(digest))
    keyed = with_digest(docs, text_col, digest).withColumn(own, as_text)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    longest = F.max_by(whole, F.struct(F.length(F.col(text_col)), F.col(text_col))).alias("_row")
    return keyed.join(kept, [own, digest], "left_semi").groupBy(own, digest).agg(longest).select("_row.*")
