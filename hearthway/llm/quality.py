"""Document quality with hierarchical empirical Bayes over sites.

A document classifier, a numpy logistic model over simple counts of the text, gives each document a probability of
being good. Grouped sums of these over hosts and over paths within hosts give posteriors: a host's rate is
shrunk toward the global rate, a path's toward its host's, and the strength of either shrinkage is estimated
from how much the rates of all groups differ beyond chance (method of moments). A document's score combines its own evidence
with the posterior of its path, from which its own part is taken out first.

Training takes a bounded sample of labelled rows; features, sums and scores cover all rows and whole
texts. Null and empty texts are scored by the features of an empty text. A null host or path is a group of its own.
Rows with null ids and repeated rows are scored like others. Without labels of both kinds every
document's own probability is one half. Empty tables give empty results. Other columns are neither read nor inputs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthway.llm.language_id import held_out
from hearthway.llm.shared import as_bytes, fetch_rows
from hearthway.session import cut_lineage

#: Labelled rows that are learned from, about; chosen by a hash of the id.
TRAIN_ROWS = 20_000
#: Steps into which each feature is cut, by quantiles of the sample.
STEPS = 8
FEATURES = ("letters", "capitals", "digits", "spaces", "marks", "bars", "odd", "ends", "distinct", "commonest", "longest_run", "word_size", "words", "repeated_lines")
SIGNS = re.compile(rb"[%$&*#@^~]")


def features(text: bytes) -> list[float]:
    """Shares and averages that tell prose from other text."""
    size = max(1, len(text))
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    run = best = 0
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b else 0
        best = max(best, run)
    upper = sum(map(bytes.isupper, words))
    letters = sum(map(bytes.isalpha, words))
    return [
        letters / n, upper / n, sum(map(bytes.isdigit, words)) / n, (size - sum(map(len, words))) / size, text.count(b"!") / n, text.count(b"|") / n,
        len(SIGNS.findall(text)) / n, text.count(b".") / n, len(counts) / n, max(counts.values(), default=0) / n, best / n,
        sum(map(len, words)) / n, np.log1p(len(words)), 1 - len(set(lines)) / max(1, len(lines)),
    ]


def described(docs: DataFrame) -> DataFrame:
    """Replace the column `text` by its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.names.index("text")
            found = pa.array([features(x) for x in as_bytes(batch.column(place))], pa.list_(pa.float64()))
            arrays = [x for k, x in enumerate(batch.columns) if k != place]
            yield pa.RecordBatch.from_arrays([*arrays, found], names=[*(x for x in batch.schema.names if x != "text"), "features"])

    kept = ", ".join(f"{n} {t}" for n, t in docs.dtypes if n != "text")
    return docs.mapInArrow(run, f"{kept}, features array<double>")


class Logistic:
    """A logistic model over features cut into steps."""

    def __init__(self, rows: np.ndarray, good: np.ndarray, rounds: int = 25, ridge: float = 1.0):
        self.cuts = np.quantile(rows, np.arange(1, STEPS) / STEPS, axis=0)
        x = self.steps(rows)
        self.weight = np.zeros(x.shape[1])
        # Newton steps on the penalised likelihood.
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weight, -30, 30)))
            slope = x.T @ (p - good) + ridge * self.weight
            curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(self.weight))
            move = np.linalg.solve(curve, slope)
            self.weight -= move
            if np.abs(move).max() < 1e-6:
                break

    def steps(self, rows: np.ndarray) -> np.ndarray:
        """One column for each feature and cut that it exceeds, and a constant."""
        return np.concatenate([(rows[:, :, None] > self.cuts.T[None]).reshape(len(rows), -1), np.ones((len(rows), 1))], axis=1).astype(float)

    def chance(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.steps(rows) @ self.weight, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = TRAIN_ROWS) -> Logistic | None:
    """Learn from about `rows` labelled rows of documents (id, text) where `learn` holds for the id."""
    marks = labels.where(F.col("id").isNotNull() & F.col("good").isNotNull() & learn).groupBy("id").agg(F.max("good").alias("good"))
    share = min(1.0, rows / max(1, marks.count()))
    chosen = marks.where(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = described(fetch_rows(docs.select("id", "text"), chosen, "id").select("good", "text")).collect()
    good = np.array([x["good"] for x in sample], float)
    if not len(set(good.tolist())) == 2:
        return None
    order = np.lexsort((*np.array([x["features"] for x in sample]).T, good))
    return Logistic(np.array([x["features"] for x in sample])[order], good[order])


def strength(groups: DataFrame, rate: Column, n: str = "n", good: str = "good") -> float:
    """The weight of a prior in documents: chance variance of the group rates over what they vary beyond it."""
    found = groups.select(
        F.sum(n).alias("n"), F.sum(F.col(n) * rate * (1 - rate)).alias("within"), F.count("*").alias("groups"),
        F.sum(F.col(n) * (F.col(good) / F.col(n) - rate) * (F.col(good) / F.col(n) - rate)).alias("spread"), F.sum(F.col(n) * F.col(n)).alias("square"),
    ).first()
    if not found["n"] or found["groups"] < 2:
        return 100.0
    level = found["within"] / found["n"]
    beyond = (found["spread"] - found["groups"] * level) / max(found["n"] - found["square"] / found["n"], 1e-9)
    return float(min(max(level / max(beyond, 1e-12) - 1, 1.0), 1e6))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """A row per document: id, held_out, own_score, host_rate, path_rate, score, predicted."""
    all_rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("good"))
    model = fit(all_rows, marks, ~held_out("id"))
    parts = None if model is None else (model.cuts, model.weight)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chance = np.full(batch.num_rows, 0.5)
            if parts is not None and batch.num_rows:
                scorer = Logistic.__new__(Logistic)
                scorer.cuts, scorer.weight = parts
                chance = scorer.chance(np.array([features(x) for x in as_bytes(batch.column(4))]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(chance)], names=["id", "held_out", "host", "path", "own"])

    kind = all_rows.schema["id"].dataType.simpleString()
    rows = cut_lineage(all_rows.mapInArrow(own, f"id {kind}, held_out boolean, host string, path string, own double"))
    total = rows.agg(F.count("*").alias("n"), F.avg("own").alias("rate")).first()
    rate = min(max(total["rate"] if total["n"] else 0.5, 1e-6), 1 - 1e-6)

    paths = cut_lineage(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("own").alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    k_host = strength(hosts, F.lit(rate), "host_n", "host_good")
    hosts = hosts.withColumn("host_rate", (F.col("host_good") + k_host * rate) / (F.col("host_n") + k_host))
    known = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    k_path = strength(known, F.col("host_rate"))

    # Sums without the document itself, so that its evidence counts once.
    joined = rows.join(known, rows["host"].eqNullSafe(known["host"]) & rows["path"].eqNullSafe(known["path"])).select(rows["*"], "n", "good", "host_n", "host_good")
    host_rate = (F.col("host_good") - F.col("own") + k_host * rate) / (F.col("host_n") - 1 + k_host)
    path_rate = (F.col("good") - F.col("own") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path)
    logit = lambda x: F.log(x / (1 - x))
    bounded = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
    scored = joined.withColumn("host_rate", bounded(host_rate)).withColumn("path_rate", bounded(path_rate))
    scored = scored.withColumn("score", 1 / (1 + F.exp(-(logit(bounded(F.col("own"))) + logit(F.col("path_rate")) - logit(F.lit(rate))))))
    return scored.select(F.col("id").alias(id_col), "held_out", F.col("own").alias("own_score"), "host_rate", "path_rate", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
