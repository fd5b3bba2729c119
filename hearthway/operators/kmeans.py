"""Many k-means fits over one table at once.

Equal points are one weighted point, so the work follows the distinct points. They are packed into blocks of numbers and written; every pass over the
blocks serves all fits that are still moving: a task assigns its points to the centres of each fit and adds up what the next centres need. What
reaches the driver is a row per centre. Starts are chosen by k-means|| over all points, the last step of it by k-means++ among the chosen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthway.session import cut_lineage

#: Points of a block, about, and points that a task measures at a time.
BLOCK, STEP = 20_000, 4_000
#: Rounds of k-means||, starts of k-means++ among the points it has chosen, rounds of Lloyd and the move that ends them.
START_ROUNDS, START_TRIES, ROUNDS, STILL = 3, 10, 20, 1e-4


class Fit(NamedTuple):
    k: int
    seed: int


class Points:
    """The distinct points of a vector column `features`: blocks (block, n, v, w), less `middle`, their weighted mean."""

    def __init__(self, df: DataFrame):
        distinct = cut_lineage(df.select(vector_to_array("features").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("w")))
        self.spark, rows = df.sparkSession, distinct.count()
        self.size = len((distinct.select("v").first() or [[]])[0] or [])
        total = [F.sum(F.col("v")[c] * F.col("w")) / F.sum("w") for c in range(self.size)]
        self.middle = np.array(distinct.agg(F.array(*total)).first()[0] if rows else [], float)
        tasks = max(1, min(max(-(-rows // BLOCK), df.sparkSession.sparkContext.defaultParallelism), -(-rows // 1_000)))
        middle = self.middle

        def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                points, weights = np.array(frame["v"].tolist(), float) - middle, frame["w"].to_numpy(float)
                # A block is known by its first point, however often its task runs.
                yield pd.DataFrame({"block": [int(pd.util.hash_array(points[0]).sum() % 2**31)], "n": [len(frame)], "v": [points.tobytes()], "w": [weights.tobytes()]})

        ordered = distinct.repartition(tasks, "v").sortWithinPartitions("v")
        self.blocks = cut_lineage(ordered.mapInPandas(pack, "block long, n int, v binary, w binary"))

    def scan(self, run: Callable[[int, np.ndarray, np.ndarray], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
        """The rows of `run` over the points and weights of each block."""

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples():
                    yield from run(row.block, np.frombuffer(row.v).reshape(row.n, -1), np.frombuffer(row.w))

        return self.blocks.mapInPandas(each, schema)

    def measure(self, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """For each fit a row per centre: points, their distances, squared distances, squared lengths and sums."""
        names, models = [f"s{c}" for c in range(4 + self.size)], self.spark.sparkContext.broadcast(centres)

        def run(block: int, points: np.ndarray, weights: np.ndarray) -> Iterator[pd.DataFrame]:
            for fit, model in models.value.items():
                table = np.zeros((len(model), len(names)))
                for low in range(0, len(points), STEP):
                    some, weight = points[low : low + STEP], weights[low : low + STEP]
                    label, squares = nearest(some, model)
                    member = np.zeros((len(some), len(model)))
                    member[np.arange(len(some)), label] = weight
                    table += member.T @ np.column_stack([np.ones(len(some)), np.sqrt(squares), squares, (some**2).sum(axis=1), some])
                yield pd.DataFrame({"fit": fit, "centre": np.arange(len(model)), **dict(zip(names, table.T))})

        found = self.scan(run, "fit int, centre int, " + ", ".join(f"{n} double" for n in names))
        out = {fit: np.zeros((len(model), len(names))) for fit, model in centres.items()}
        for row in found.groupBy("fit", "centre").agg(*[F.sum(n) for n in names]).collect():
            out[row[0]][row[1]] = row[2:]
        models.destroy()
        return out

    def draw(self, chance: dict[int, tuple[np.ndarray | None, float]], seeds: dict[int, int]) -> dict[int, np.ndarray]:
        """Points drawn for each fit: with centres and a factor, each point with factor * squared distance as its chance; without, a single one."""
        models = self.spark.sparkContext.broadcast(chance)

        def run(block: int, points: np.ndarray, weights: np.ndarray) -> Iterator[pd.DataFrame]:
            for fit, (model, factor) in models.value.items():
                dice = np.random.default_rng([seeds[fit], 0 if model is None else len(model), block])
                if model is None:
                    race = dice.exponential(size=len(points)) / weights
                    chosen = np.array([np.argmin(race)])
                else:
                    race = np.concatenate([nearest(points[low : low + STEP], model)[1] for low in range(0, len(points), STEP)])
                    chosen = np.flatnonzero(dice.random(len(points)) < factor * race * weights)
                if len(chosen):
                    yield pd.DataFrame({"fit": fit, "race": race[chosen], "v": list(points[chosen])})

        found = self.scan(run, "fit int, race double, v array<double>")
        single = [fit for fit, (model, _) in chance.items() if model is None]
        if single:
            found = found.groupBy("fit").agg(F.min_by("v", "race").alias("v"))
        out: dict[int, list] = {fit: [] for fit in chance}
        for row in found.select("fit", "v").collect():
            out[row[0]].append(row[1])
        models.destroy()
        # Spark gives no order to the rows; the draws of a seed are the same in any.
        return {fit: np.array(sorted(rows)).reshape(len(rows), self.size) for fit, rows in out.items()}

    def fit(self, fits: list[Fit]) -> dict[int, np.ndarray]:
        """The centres of each fit by its place in the list, less the middle."""
        todo = {n: fit for n, fit in enumerate(fits) if fit.k > 1}
        seeds = {n: fit.seed for n, fit in todo.items()}
        centres = {n: np.zeros((1, self.size)) for n, fit in enumerate(fits) if fit.k == 1}
        if not todo:
            return centres
        chosen = self.draw({n: (None, 0.0) for n in todo}, seeds)
        for _ in range(START_ROUNDS):
            cost = {n: table[:, 2].sum() for n, table in self.measure(chosen).items()}
            drawn = self.draw({n: (chosen[n], 2 * todo[n].k / max(cost[n], 1e-300)) for n in todo}, seeds)
            chosen = {n: np.unique(np.concatenate([chosen[n], drawn[n]]), axis=0) for n in todo}
        held = self.measure(chosen)
        moving = {n: start(chosen[n], held[n][:, 0], fit) for n, fit in todo.items()}
        for _ in range(ROUNDS):
            if not moving:
                break
            for n, table in self.measure(moving).items():
                kept = table[:, 0] > 0
                new = np.where(kept[:, None], table[:, 4:] / np.maximum(table[:, :1], 1), moving[n])
                still = ((new - moving[n]) ** 2).sum(axis=1).max() <= STILL**2
                centres[n] = moving[n] = new
                if still:
                    del moving[n]
        return centres

    def silhouettes(self, centres: dict[int, np.ndarray]) -> dict[int, float]:
        """The mean silhouette of each fit on squared distances, copies counted one by one."""
        held = self.measure(centres)
        # A fit that found one cluster only has no silhouette.
        centres = {fit: model for fit, model in centres.items() if (held[fit][:, 0] > 0).sum() > 1}
        models = self.spark.sparkContext.broadcast((centres, held))

        def run(block: int, points: np.ndarray, weights: np.ndarray) -> Iterator[pd.DataFrame]:
            for fit, model in models.value[0].items():
                table, total = models.value[1][fit], 0.0
                n = table[:, 0]
                for low in range(0, len(points), STEP):
                    some, at = points[low : low + STEP], np.arange(min(STEP, len(points) - low))
                    label, _ = nearest(some, model)
                    sums = np.maximum(n * (some**2).sum(axis=1)[:, None] + table[:, 3] - 2 * some @ table[:, 4:].T, 0)
                    inside = sums[at, label] / np.maximum(n[label] - 1, 1)
                    means = np.where(n > 0, sums / np.maximum(n, 1), np.inf)
                    means[at, label] = np.inf
                    outside, most = means.min(axis=1), np.maximum(means.min(axis=1), inside)
                    value = np.where((most > 0) & (n[label] > 1), (outside - inside) / np.where(most > 0, most, 1), 0.0)
                    total += float(value @ weights[low : low + STEP])
                yield pd.DataFrame({"fit": [fit], "score": [total]})

        found = {row[0]: row[1] for row in self.scan(run, "fit int, score double").groupBy("fit").agg(F.sum("score")).collect()}
        return {fit: found[fit] / held[fit][:, 0].sum() for fit in centres}

    def label(self, features: str, model: np.ndarray) -> Column:
        """The place of the centre nearest to a vector column."""
        shared, middle = self.spark.sparkContext.broadcast(model), self.middle

        @F.pandas_udf("int")
        def place(v: pd.Series) -> pd.Series:
            return pd.Series(nearest(np.array(v.tolist(), float).reshape(len(v), -1) - middle, shared.value)[0])

        return place(vector_to_array(features))


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the nearest centre and the squared distance to it."""
    squares = (points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * points @ centres.T
    label = squares.argmin(axis=1)
    return label, ((points - centres[label]) ** 2).sum(axis=1)


def start(chosen: np.ndarray, weights: np.ndarray, fit: Fit) -> np.ndarray:
    """Centres among the few chosen points, weighted by the points near them: the best of some starts of k-means++ with Lloyd rounds."""
    if len(chosen) <= fit.k:
        return chosen
    dice, best, least = np.random.default_rng(fit.seed), chosen[: fit.k], np.inf
    weights = np.maximum(weights, 1e-12)
    for _ in range(START_TRIES):
        centres = chosen[[dice.choice(len(chosen), p=weights / weights.sum())]]
        while len(centres) < fit.k:
            mass = weights * nearest(chosen, centres)[1]
            if not mass.sum():
                break
            centres = np.concatenate([centres, chosen[[dice.choice(len(chosen), p=mass / mass.sum())]]])
        for _ in range(ROUNDS):
            label, _ = nearest(chosen, centres)
            member = np.eye(len(centres))[label] * weights[:, None]
            held = member.sum(axis=0)
            centres = np.where(held[:, None] > 0, member.T @ chosen / np.maximum(held, 1e-300)[:, None], centres)
        cost = float(weights @ nearest(chosen, centres)[1])
        if cost < least:
            best, least = centres, cost
    return best
