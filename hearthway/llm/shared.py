"""Helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthway.session import cut_lineage

#: Slots of the broadcast pre-filter of `fetch_rows`; its size bound, whatever the data.
SLOTS = 1 << 19


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """One object per Python worker process, kept from task to task."""
    home = sys.modules.setdefault("_hearthway_worker", types.ModuleType("_hearthway_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def worker_latest(slot: str, key: str, make: Callable[[], object]) -> object:
    """The object of this slot and key; a worker holds one at a time, whatever operator made it."""
    held = worker_cache("latest", dict)
    if (slot, key) not in held:
        worker_release()
        held[slot, key] = make()
    return held[slot, key]


def worker_release() -> None:
    """Drop what earlier operators left in this worker."""
    worker_cache("latest", dict).clear()
    trim()


def trim() -> None:
    """Give freed memory back, so that idle workers do not hold what busy ones need."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """The function of a task, with its memory given back at the end."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def byte_chunks(items: list[bytes] | list[str], limit: int) -> Iterator[slice]:
    """Slices of consecutive items of about `limit` bytes or characters, one item at least."""
    yield from _size_chunks([len(x) for x in items], limit)


def column_chunks(column: pa.Array, limit: int) -> Iterator[slice]:
    """Slices of consecutive rows of a text column of about `limit` bytes, one row at least; the texts themselves stay in the column."""
    yield from _size_chunks(pc.fill_null(pc.binary_length(column), 0).to_pylist(), limit)


def _size_chunks(sizes: list[int], limit: int) -> Iterator[slice]:
    begin, size = 0, 0
    for k, item in enumerate(sizes):
        if size and size + item > limit:
            yield slice(begin, k)
            begin, size = k, 0
        size += item
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slot_of(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SLOTS))


def fetch_rows(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose `key` occurs in the distinct keys of `wanted`, with the other columns of `wanted`.

    A broadcast list of hash slots, at most `SLOTS` integers, first screens out most
    rows before the join shuffles them. Keys in many rows are left to the splitting of
    skewed joins.
    """
    slots = wanted.select(slot_of(F.col(key)).alias("_slot")).distinct()
    screened = rows.withColumn("_slot", slot_of(F.col(key))).join(F.broadcast(slots), "_slot", "left_semi").drop("_slot")
    return screened.join(wanted, key)


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of `value` over all rows before each row in the given order.

    Rows are range-partitioned and summed per partition; only one total per partition
    reaches the driver.
    """
    schema = T.StructType([*df.schema.fields]).add("_slice", "integer").add(name, "long")

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        before = 0
        for frame in frames:
            sums = frame[value].cumsum()
            yield frame.assign(_slice=TaskContext.get().partitionId(), **{name: before + sums - frame[value]})
            before += int(sums.iloc[-1]) if len(sums) else 0

    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    written = cut_lineage(ordered.mapInPandas(add, schema))
    totals = sorted(written.groupBy("_slice").agg(F.sum(value)).collect())
    base, before = [], 0
    for piece, total in totals:
        base.append((piece, before))
        before += total
    bases = df.sparkSession.createDataFrame(base, "_slice int, _base long")
    return written.join(F.broadcast(bases), "_slice").withColumn(name, F.col(name) + F.col("_base")).drop("_slice", "_base")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list of longs: (node, root), root the smallest node.

    Every round lets each task reduce its own edges to a forest (so repeated edges vanish
    before a shuffle), then links every node to the smallest neighbour of its smallest
    neighbour. Rounds grow with the logarithm of the length of a chain. Edges are narrow,
    written to the shared folder each round. `edges` should be read from a written table: a stage that also makes
    them in Python keeps twice the Python workers, and these stay.
    """
    schema = "a long, b long"
    partial = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    current = cut_lineage(partial.mapInPandas(_forest_task, schema))
    while True:
        # Larger neighbours, then smaller ones, meet the smallest of the neighbourhood.
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b")
        large = large.where("a <> b").distinct()
        high = large.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"))
        lowest = high.groupBy("b").agg(F.min("a").alias("m"))
        small = high.join(lowest, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        after = cut_lineage(small.where("a <> b").distinct())
        # A forest of stars: no node is both a root and a leaf, no leaf has two roots.
        leaves = after.groupBy("b").agg(F.count("*").alias("n"))
        bad = leaves.where("n > 1").select("b").union(leaves.join(after.select(F.col("a").alias("b")).distinct(), "b").select("b"))
        current = after
        if bad.isEmpty():
            break
    return current.select(F.col("b").alias("node"), F.col("a").alias("root")).union(current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reduce edges to (root, node) with the smallest node of each component as root."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        label = label[label]
        if np.array_equal(before, label):
            break
    keep = label != np.arange(len(nodes))
    return nodes[label[keep]], nodes[keep]


def _forest_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in merged(frames, 200_000):
        root, node = forest(frame["a"].to_numpy(), frame["b"].to_numpy())
        yield pd.DataFrame({"a": root, "b": node})


def merged(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Join consecutive frames up to about `rows` rows."""
    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= rows:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if size:
        yield pd.concat(held, ignore_index=True)
