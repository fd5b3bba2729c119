"""Spatial autocorrelation of zone values: lag, global and local Moran statistics.

Weights are row-standardised throughout. Several variables travel as columns of one
table, so they share every join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthway import settings
from hearthway.operators.columns import drop_missing, with_global
from hearthway.operators.neighbours import row_standardize
from hearthway.operators.ranking import global_position
from hearthway.operators.equi import equi_join
from hearthway.session import cut_lineage

QUADRANTS = {1: "HH", 2: "LH", 3: "LL", 4: "HL"}
#: Numbers of the keyed rearrangement: a prime, multipliers for seed, number and round, and a step. Any other SQL engine gives the same ranks.
PRIME, KEYS, STEP = 2_147_483_647, (7_368_787, 15_485_863, 32_452_843), (48_271, 12_345)
#: Rearrangements whose neighbourhood sums one task takes at a time.
BLOCK = 64
#: Values in standard units closer than this count as equal.
EQUAL = 1e-9


def rearranged(ranks: np.ndarray, perms: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where the keyed one-to-one maps of 0 .. n - 1 with the numbers `perms` put `ranks`.

    The ranks are read as places of a near-square table of at least n places. Four rounds shift the row by a keyed function of the column and the
    column by one of the row, which can be undone, so no two ranks meet. A rank sent to an unused place goes through the map again until it is
    below n. Only whole numbers below 2 ** 63 occur.
    """
    a = math.isqrt(max(n, 1) - 1) + 1
    b = max(1, -(-n // a))
    out, left = ranks.astype(np.int64), np.arange(len(ranks))
    while len(left):
        row, column = np.divmod(out[left], b)
        for turn in range(4):
            key = (seed * KEYS[0] + turn * KEYS[2] + perms[left] * KEYS[1]) % PRIME
            mixed = (((row if turn % 2 else column) + key) % PRIME * STEP[0] + STEP[1]) % PRIME
            shift = mixed * mixed % PRIME
            if turn % 2:
                column = (column + shift) % b
            else:
                row = (row + shift) % a
        out[left] = row * b + column
        left = left[out[left] >= n]
    return out


def in_rearrangements(df: DataFrame, ranks: dict[str, str], n: int, permutations: int, seed: int, key: list[str]) -> DataFrame:
    """Each row once per rearrangement `perm`, with the new places (the keys of `ranks`) of rank columns (its values).

    Rows are spread by `key` and blocks of rearrangements first, so that few rows make many tasks; `_block` stays.
    """
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((permutations - 1) // BLOCK)))).repartition(spread, *key, "_block")
    kept = [c for c in blocks.columns if c not in ranks.values()]
    schema = T.StructType([*blocks.select(*kept).schema.fields, T.StructField("perm", T.LongType()), *(T.StructField(c, T.LongType()) for c in ranks)])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                rows = batch.slice(begin, 1024)
                first = rows.column("_block").to_numpy().astype(np.int64) * BLOCK
                times = np.minimum(BLOCK, permutations - first)
                row = np.repeat(np.arange(len(first)), times)
                perm = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + first[row]
                places = [rearranged(rows.column(c).to_numpy()[row], perm, n, seed) for c in ranks.values()]
                own = rows.select(kept).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(perm), *map(pa.array, places)], names=schema.names)

    return blocks.mapInArrow(turn, schema)


def _placed(known: DataFrame, columns: list[str], key: str) -> tuple[DataFrame, int]:
    """(key, _rank, _z0, _z1, ...): values in standard units by rank of the key, written; and how many."""
    moments = {f"m{i}": F.avg(F.col(f"`{c}`")) for i, c in enumerate(columns)} | {f"s{i}": F.stddev_pop(F.col(f"`{c}`")) for i, c in enumerate(columns)}
    centred = with_global(known.select(key, *columns), "_all", **moments)
    z = [F.coalesce(F.try_divide(F.col(f"`{c}`") - F.col("_all")[f"m{i}"], F.col("_all")[f"s{i}"]), F.lit(0.0)).alias(f"_z{i}") for i, c in enumerate(columns)]
    placed = cut_lineage(global_position(centred.select(key, *z), [key], "_rank"))
    return placed, placed.count()


def spatial_lag(df: DataFrame, edges: DataFrame, columns: list[str], key: str = "grid_id") -> DataFrame:
    """Add `{c}_lag`, the weighted mean over the neighbours; 0 for a zone without any."""
    return _with_lag(df, edges, columns, key).na.fill(0.0, [f"{c}_lag" for c in columns])


def _with_lag(df: DataFrame, edges: DataFrame, columns: list[str], key: str) -> DataFrame:
    values = df.select(F.col(key).alias("j"), *[F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    carried = equi_join(edges.select("i", "j", "w"), values, ["j"])
    lags = carried.groupBy(F.col("i").alias(key)).agg(
        *[
            F.try_divide(F.sum(F.col("w") * F.col(f"_{i}")), F.sum("w")).alias(f"{c}_lag")
            for i, c in enumerate(columns)
        ]
    )
    return df.join(lags, key, "left")


def between_known(edges: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The edges between zones that both have values."""
    for end in ("i", "j"):
        edges = equi_join(edges, known.select(F.col(key).alias(end)), [end], "left_semi")
    return edges


def morans_i(
    df: DataFrame,
    edges: DataFrame,
    columns: list[str],
    key: str = "grid_id",
    permutations: int = 0,
    seed: int = 13,
) -> DataFrame:
    """Global Moran's I per variable: (variable, n, moran_i, expected_i[, p_sim]).

    With `permutations` the pseudo p-value compares I with as many random rearrangements
    of the values over the zones.
    """
    known = drop_missing(df.select(key, *columns), columns)
    if permutations:
        # Read by several steps.
        known, edges = cut_lineage(known), cut_lineage(edges.select("i", "j", "w"))
    # Observed and rearranged values meet the same graph: that of the known zones.
    edges = between_known(edges, known, key)
    lagged = _with_lag(known, edges, columns, key)
    lagged = with_global(lagged, "_mean", **{f"m{i}": F.avg(F.col(f"`{c}`")) for i, c in enumerate(columns)})
    rows = []
    for i, c in enumerate(columns):
        mean = F.col("_mean")[f"m{i}"]
        z = F.col(f"`{c}`") - mean
        lag = F.col(f"`{c}_lag`") - mean
        n = F.count(F.lit(1))
        rows.append(
            F.struct(
                F.lit(c).alias("variable"),
                n.alias("n"),
                F.try_divide(n * F.sum(z * lag), F.count(lag) * F.sum(z * z)).alias("moran_i"),
                F.try_divide(F.lit(-1.0), n - 1).alias("expected_i"),
            )
        )
    observed = lagged.agg(F.array(*rows).alias("all")).select(F.inline("all"))
    if not permutations:
        return observed
    simulated = _permuted_moran(known, edges, columns, key, permutations, seed)
    larger = F.count_if(F.col("sim") >= F.col("moran_i") - EQUAL)
    return (
        observed.join(simulated, "variable")
        .groupBy("variable", "n", "moran_i", "expected_i")
        .agg(((F.least(larger, permutations - larger) + 1) / (permutations + 1)).alias("p_sim"))
    )


def _permuted_moran(
    known: DataFrame, edges: DataFrame, columns: list[str], key: str, permutations: int, seed: int
) -> DataFrame:
    """(variable, perm, sim): Moran's I of each rearrangement.

    A rearrangement gives the zone of rank r the value of another rank, by arithmetic on columns. An edge asks for the values of its two ends
    and adds their product to the sum of its rearrangement: nothing is sorted, and where the values are small
    enough for Spark to broadcast them, one row per task and rearrangement is shuffled.
    """
    placed, zones = _placed(known, columns, key)
    z = [f"_z{i}" for i in range(len(columns))]
    ends = row_standardize(edges).select("i", "j", "w")
    for end in ("i", "j"):
        ends = equi_join(ends, placed.select(F.col(key).alias(end), F.col("_rank").alias(f"_rank_{end}")), [end])
    ends = cut_lineage(ends.select("w", "_rank_i", "_rank_j"))
    turned = in_rearrangements(ends, {"_at_i": "_rank_i", "_at_j": "_rank_j"}, zones, permutations, seed, ["_rank_i"])
    for end in ("i", "j"):
        values = placed.select(F.col("_rank").alias(f"_at_{end}"), *[F.col(c).alias(f"{c}_{end}") for c in z])
        turned = equi_join(turned, values, [f"_at_{end}"])
    sums = turned.groupBy("perm").agg(F.sum("w").alias("_s0"), *[F.sum(F.col("w") * F.col(f"{c}_i") * F.col(f"{c}_j")).alias(c) for c in z])
    # In standard units the squares add up to the number of zones, or to 0 where all values are equal.
    rows = [F.struct(F.lit(c).alias("variable"), F.try_divide(F.col(z[i]), F.col("_s0")).alias("sim")) for i, c in enumerate(columns)]
    return sums.select("perm", F.inline(F.array(*rows)))


def local_moran(
    df: DataFrame,
    edges: DataFrame,
    columns: list[str],
    key: str = "grid_id",
    p: float = settings.SIGNIFICANCE,
    permutations: int = 0,
    seed: int = 13,
) -> DataFrame:
    """Local Moran statistics of every zone and variable.

    Adds `{c}_lag`, `{c}_i` and `{c}_quadrant`; with `permutations` also `{c}_p_sim` and
    `{c}_q`, the quadrant where it is significant and "Non-Significant" elsewhere.
    """
    known = drop_missing(df, columns)
    if permutations:
        # Read by several steps.
        known, edges = cut_lineage(known), cut_lineage(edges.select("i", "j", "w"))
    lagged = _with_lag(known, edges, columns, key)
    moments = {f"m{i}": F.avg(F.col(f"`{c}`")) for i, c in enumerate(columns)}
    moments |= {f"s{i}": F.var_pop(F.col(f"`{c}`")) for i, c in enumerate(columns)}
    lagged = with_global(lagged, "_all", n=F.count(F.lit(1)), **moments)
    for i, c in enumerate(columns):
        z = F.col(f"`{c}`") - F.col("_all")[f"m{i}"]
        lag = F.coalesce(F.col(f"`{c}_lag`") - F.col("_all")[f"m{i}"], F.lit(0.0))
        scale = F.col("_all.n") * F.col("_all")[f"s{i}"]
        lagged = lagged.withColumns(
            {
                f"{c}_i": F.try_divide((F.col("_all.n") - 1) * z * lag, scale),
                f"{c}_quadrant": quadrant(z, lag),
            }
        )
    result = lagged.drop("_all")
    if not permutations:
        return result
    tested = _conditional_p(known, edges, columns, key, permutations, seed)
    result = result.join(tested, key, "left")
    labels = {
        f"{c}_q": F.when(F.col(f"`{c}_p_sim`") < p, F.col(f"`{c}_quadrant`")).otherwise("Non-Significant")
        for c in columns
    }
    return result.withColumns(labels)


def quadrant(z: Column, lag: Column) -> Column:
    """High or low zone (second letter of the pair: its neighbours), relative to the mean."""
    return (
        F.when((z > 0) & (lag > 0), QUADRANTS[1])
        .when((z <= 0) & (lag > 0), QUADRANTS[2])
        .when((z <= 0) & (lag <= 0), QUADRANTS[3])
        .otherwise(QUADRANTS[4])
    )


def significance_label(df: DataFrame, column: str, p: float = settings.SIGNIFICANCE) -> DataFrame:
    significant = F.col(f"`{column}_p_sim`") < p
    return df.withColumn(f"{column}_significance", F.when(significant, "Significant").otherwise("Non-Significant"))


def _conditional_p(
    known: DataFrame, edges: DataFrame, columns: list[str], key: str, permutations: int, seed: int
) -> DataFrame:
    """(key, `{c}_p_sim`...): share of random neighbourhoods at least as extreme.

    In rearrangement p the n-th neighbour of a zone (in order of keys) is the zone of the rank to which p sends n; a zone that
    would be its own neighbour takes the rank behind its last neighbour's instead. The edges of a zone
    meet the rearrangements in blocks: a zone with very many neighbours is as many
    tasks as there are blocks, and a count per zone and block is what is left of it.
    """
    placed, zones = _placed(known, columns, key)
    z = [f"_z{i}" for i in range(len(columns))]
    weights = row_standardize(between_known(edges, known, key)).select("i", "j", "w")
    in_turn, whole = Window.partitionBy("i").orderBy("j"), Window.partitionBy("i")
    slotted = weights.withColumns({"slot": F.row_number().over(in_turn) - 1, "_size": F.count(F.lit(1)).over(whole)})
    there = equi_join(slotted, placed.drop("_rank").withColumnRenamed(key, "j"), ["j"])
    there = there.select("i", "w", "slot", "_size", *[(F.col("w") * F.col(c)).alias(f"_part{c}") for c in z])
    lags = there.withColumns({f"_lag{c}": F.sum(f"_part{c}").over(whole) for c in z}).drop(*[f"_part{c}" for c in z])
    observed = cut_lineage(equi_join(lags, placed.withColumnsRenamed({key: "i", **{c: f"_own{c}" for c in z}}), ["i"]))

    slots = observed.withColumn("_next", F.least(F.col("_size"), F.lit(zones - 1))).drop("_size")
    drawn = in_rearrangements(slots, {"_at": "slot", "_spare": "_next"}, zones, permutations, seed, ["i"])
    drawn = drawn.withColumn("_at", F.when(F.col("_at") == F.col("_rank"), F.col("_spare")).otherwise(F.col("_at"))).drop("_rank", "_spare")
    drawn = equi_join(drawn, placed.drop(key).withColumnRenamed("_rank", "_at"), ["_at"])
    kept = {f"_{name}{c}": F.max(f"_{name}{c}") for c in z for name in ("own", "lag")}
    sums = drawn.groupBy("i", "_block", "perm").agg(*[F.sum(F.col("w") * F.col(c)).alias(f"_sim{c}") for c in z], *[v.alias(n) for n, v in kept.items()])
    larger = [F.count_if(F.col(f"_own{c}") * (F.col(f"_sim{c}") - F.col(f"_lag{c}")) >= -EQUAL).alias(c) for c in z]
    counts = sums.groupBy("i", "_block").agg(*larger).groupBy("i").agg(*[F.sum(c).alias(c) for c in z])
    return counts.select(
        F.col("i").alias(key),
        *[
            ((F.least(F.col(c), permutations - F.col(c)) + 1) / (permutations + 1)).alias(f"{columns[i]}_p_sim")
            for i, c in enumerate(z)
        ],
    )


def moran_line(df: DataFrame, columns: list[str]) -> DataFrame:
    """Line fitted to lag over value per variable: (variable, slope, intercept)."""
    rows = [
        F.struct(
            F.lit(c).alias("variable"),
            F.regr_slope(F.col(f"`{c}_lag`"), F.col(f"`{c}`")).alias("slope"),
            F.regr_intercept(F.col(f"`{c}_lag`"), F.col(f"`{c}`")).alias("intercept"),
        )
        for c in columns
    ]
    return df.agg(F.array(*rows).alias("all")).select(F.inline("all"))
