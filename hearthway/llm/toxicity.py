"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the words and word parts that occur in a text is trained from confirmed toxic texts
and unlabelled ones. The risk of the unlabelled texts as negatives is corrected by the class prior,
`R = prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`; where the corrected part would turn negative its
gradient is reversed, so that the model does not fit the toxic texts among the unlabelled ones. The prior is the
share of toxic rows among the labels, or given.

Training takes a bounded sample of the labelled rows; scoring reads whole texts of all rows. Null and
empty texts have no features and get the score of the bias alone. Rows with null ids and repeated
rows are scored like others; repeated labels of an id count as toxic if one of them is. Without toxic labels every score is 0.
Empty tables give empty results. Other columns are neither read nor inputs.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthway.llm.language_id import held_out
from hearthway.llm.shared import as_texts, fetch_rows, trimmed, worker_latest
from hearthway.session import cut_lineage

WORD = re.compile(r"[^\W_]+")
#: Word parts are n-grams of these lengths.
PART_SIZES = (4, 5, 6)
#: Rows that are learned from, about: toxic ones and unlabelled ones, chosen by a hash of the id.
POSITIVE_ROWS, UNLABELLED_ROWS = 2_000, 12_000
#: Features that a model keeps: those whose frequency differs most between toxic and unlabelled texts.
KEPT_FEATURES = 1_500
#: A feature is in so many texts of the sample at least.
LEAST_TEXTS = 8
#: Features of words that a worker remembers.
KEPT_KNOWN = 300_000


def parts(word: str) -> set[str]:
    """The features of a word: itself between marks, and its n-grams."""
    found = {f"<{word}>"}
    for n in PART_SIZES:
        for k in range(len(word) - n + 1):
            found.add(word[k : k + n])
    return found


def features(text: str) -> set[str]:
    return set().union(*map(parts, set(WORD.findall(text.lower())))) if text else set()


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, start: np.ndarray | None = None, steps: int = 300, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative positive-unlabelled risk with the sigmoid loss, by Adam on batches."""
    rng = np.random.default_rng(seed)
    weight, bias = np.zeros(positive.shape[1]) if start is None else start.astype(float), -1.0
    m, v = np.zeros(len(weight) + 1), np.zeros(len(weight) + 1)
    for step in range(1, steps + 1):
        p = positive[rng.integers(0, len(positive), min(400, len(positive)))].astype(float)
        u = unlabelled[rng.integers(0, len(unlabelled), min(1200, len(unlabelled)))].astype(float)
        # Loss of a score z as positive is sigmoid(-z), as negative sigmoid(z).
        at_p, at_u = 1 / (1 + np.exp(-np.clip(p @ weight + bias, -30, 30))), 1 / (1 + np.exp(-np.clip(u @ weight + bias, -30, 30)))
        slope_p, slope_u = at_p * (1 - at_p), at_u * (1 - at_u)
        corrected = at_u.mean() - prior * at_p.mean()
        plus = -prior * _mean(p, slope_p)
        minus = _mean(u, slope_u) - prior * _mean(p, slope_p)
        gradient = plus + minus if corrected >= 0 else -minus
        gradient[:-1] += decay * weight
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return weight, float(bias)


def _mean(rows: np.ndarray, slope: np.ndarray) -> np.ndarray:
    return np.append(rows.T @ slope, slope.sum()) / len(slope)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None) -> tuple[dict[str, float], float] | None:
    """Feature weights and bias, or None where nothing is confirmed to be toxic."""
    narrow = docs.where(learn & F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learn)
    marks = marks.groupBy(F.col(id_col).cast("string").alias("id")).agg(F.max(label_col).alias("toxic"))
    n, toxic = marks.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not toxic:
        return None
    prior = toxic / n if prior is None else prior
    place = F.pmod(F.xxhash64("id", F.lit(10)), F.lit(1 << 30))
    share = lambda rows, of: int(min(1.0, rows / max(1, of)) * (1 << 30))
    chosen = marks.where((F.col("toxic") == 1) & (place < share(POSITIVE_ROWS, toxic))).select("id")
    total = narrow.select("id").count()
    # Unlabelled rows are any rows; whether they are labelled is not looked at.
    other = narrow.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < share(UNLABELLED_ROWS, total))
    sample = fetch_rows(narrow, chosen, "id").select("text", F.lit(True).alias("toxic")).union(other.select("text", F.lit(False).alias("toxic")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Only the feature sets of a bounded sample are made here.
        for batch in batches:
            found = [sorted(features(x)) for x in as_texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["toxic", "features"])

    sets = cut_lineage(sample.mapInArrow(trimmed(count), "toxic boolean, features array<string>"))
    sizes = {x["toxic"]: x["n"] for x in sets.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    texts = {flag: max(1, sizes.get(flag, 0)) for flag in (True, False)}
    each = sets.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count(F.when(F.col("toxic"), 1)).alias("p"), F.count(F.when(~F.col("toxic"), 1)).alias("u")
    )
    # The rate in texts that are not toxic follows from the prior; selection and first weights use it.
    rate_p, rate_u = F.col("p") / texts[True], F.col("u") / texts[False]
    rate_n = F.greatest(F.lit(0.0), (rate_u - prior * rate_p) / max(1 - prior, 1e-6))
    spread = F.abs(rate_p - rate_n) / F.sqrt((rate_p + 1 / texts[True]) / texts[True] + (rate_n + 1 / texts[False]) / texts[False])
    odds = F.log((rate_p + 1 / texts[True]) / (rate_n + 1 / texts[False]))
    ranked = each.where(F.col("p") + F.col("u") >= LEAST_TEXTS).select("feature", spread.alias("spread"), odds.alias("odds"))
    first = {x["feature"]: x["odds"] for x in ranked.orderBy(F.desc("spread"), "feature").limit(KEPT_FEATURES).collect()}
    names = sorted(first)
    if not names:
        return {}, -1.0
    index = {f: k for k, f in enumerate(names)}
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = [[own[f] for f in x if f in own] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["toxic", "at"])

    matrix: dict[bool, list[list[int]]] = {True: [], False: []}
    for row in sets.mapInArrow(lines, "toxic boolean, at array<int>").toLocalIterator():
        matrix[row["toxic"]].append(row["at"])
    dense = {}
    for flag, rows in matrix.items():
        # A fixed order makes training repeatable.
        rows.sort()
        dense[flag] = np.zeros((max(1, len(rows)), len(names)), np.uint8)
        for k, at in enumerate(rows):
            dense[flag][k, at] = 1
    weight, bias = train(dense[True], dense[False], prior, np.array([first[f] for f in names]))
    return {f: float(w) for f, w in zip(names, weight) if w}, bias


class Scorer:
    def __init__(self, weights: dict[str, float], bias: float):
        self.bias = bias
        self.names = {f: k for k, f in enumerate(weights)}
        self.weights = np.asarray(list(weights.values()), float)
        self.known: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > KEPT_KNOWN:
                self.known.clear()
            names = self.names
            found = self.known[word] = tuple(names[p] for p in parts(word) if p in names)
        return found

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            present = set()
            for word in set(WORD.findall(text.lower())):
                present.update(self.of_word(word))
            out[k] = self.bias + self.weights[sorted(present)].sum()
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def score(docs: DataFrame, model: tuple[dict[str, float], float] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, held_out, score, predicted."""
    narrow = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    schema = T.StructType([*narrow.schema.fields[:2]]).add("score", "double").add("predicted", "integer")
    # At most KEPT_FEATURES weights travel.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_latest("toxicity_model", name, lambda: shared.value and Scorer(*shared.value))
        for batch in batches:
            texts = as_texts(batch.column(2))
            scores = own.score(texts) if own else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=schema.names)

    return narrow.mapInArrow(trimmed(run), schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Learn from the rows that are not held out and score all documents."""
    return score(docs, fit(docs, labels, ~held_out(id_col), id_col, text_col, label_col), id_col, text_col)
