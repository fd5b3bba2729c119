"""Language identification by known words, backing off to character n-grams.

Fitting counts words and character n-grams per language over a bounded sample of labelled texts, of which every
language has an equal share, as it has of the words and n-grams kept, so a frequent language does not push out a rare one. A
known word scores by its log frequency in each language. A word that was not seen scores by the longest
known character n-grams in it: at each place the length falls back from `LONGEST` until an n-gram is known. A text
is the sum over its words. Its score is the posterior of the best language times the evidence of the text: the mean over its words of 1 for a
known word, else of the share of places where an n-gram of `TELLING` or more is known. A text of a language that was not learned
has little evidence, however sure the posterior.

Words are runs of letters in any script. A text that is null or has no letter is `und` with score 0, and so is every
text when nothing was learned. Whole texts are read, whatever their length. Ties go to the first language in
alphabetical order. Rows with null ids and repeated rows are predicted like others. Empty tables give empty
results. Other columns are neither read nor inputs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthway.llm.shared import as_texts, column_chunks, free_name, trimmed, worker_release
from hearthway.session import cut_lineage

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 4
#: Length of n-grams that are evidence of a learned language; single letters and pairs are common to most of a script.
TELLING = 3
#: Labelled texts that are learned from, about; chosen by a hash of the id, as many of each language.
TRAIN_ROWS = 20_000
#: Words and n-grams that a model keeps; the most frequent ones of each language, as many of each.
KEPT_WORDS, KEPT_GRAMS = 100_000, 40_000
#: Scores of words that a worker remembers, about.
KEPT_UNSEEN = 100_000
#: Text that is worked on at a time, about, one text at least.
STEP_BYTES = 1 << 20
UNKNOWN = "und"


def grams(word: str) -> Iterator[str]:
    """All character n-grams of a word with its ends marked."""
    marked = f"_{word}_"
    for n in range(1, LONGEST + 1):
        for k in range(len(marked) - n + 1):
            yield marked[k : k + n]


class Logs:
    """Log frequencies of items per language: a row of one table each."""

    def __init__(self, rows: dict[str, int], table: np.ndarray):
        self.rows, self.table = rows, table

    def __getitem__(self, item: str) -> np.ndarray:
        return self.table[self.rows[item]]


class Model:
    """Log frequencies per language of words and n-grams; `texts` counts all labelled texts of each language."""

    def __init__(self, languages: list[str], words: dict[str, list[int]], counts: dict[str, list[int]], texts: list[int]):
        self.languages = languages
        self.prior = np.log(np.asarray(texts, float) / max(1, sum(texts))) if languages else np.zeros(0)
        self.words = self._logs([words])
        # Each length is a distribution of its own.
        self.grams = self._logs([{g: c for g, c in counts.items() if len(g) == n} for n in range(1, LONGEST + 1)])
        self.forget()

    def forget(self) -> None:
        """Judged words have a row of `store` each; the first row is that of words without a letter."""
        self.places: dict[str, int] = {}
        self.store = np.zeros((1, len(self.languages) + 1))

    def _logs(self, kinds: list[dict[str, list[int]]]) -> Logs:
        tables = [np.asarray(list(x.values()), float) + 0.5 for x in kinds if x]
        items = [item for x in kinds for item in x]
        return Logs(dict(zip(items, range(len(items)))), np.concatenate([np.zeros((0, len(self.languages))), *(np.log(x / x.sum(axis=0)) for x in tables)]))

    def word(self, word: str) -> np.ndarray:
        """The score of a word in each language."""
        return self.judged([word])[0, :-1]

    def judged(self, words: list[str]) -> np.ndarray:
        """A row per word: its score in each language, and last its evidence."""
        out = np.zeros((len(words), len(self.languages) + 1))
        rows: list[int] = []
        unseen, begins = [], []
        row_of = self.grams.rows
        known = [self.words.rows.get(w, -1) for w in words]
        for place, word in enumerate(words):
            if known[place] >= 0:
                continue
            marked = f"_{word}_"
            length, begin, telling = len(marked), len(rows), 0
            for k in range(length - 1):
                for size in range(min(LONGEST, length - k), 0, -1):
                    row = row_of.get(marked[k : k + size])
                    if row is not None:
                        rows.append(row)
                        telling += size >= TELLING
                        break
            # The last TELLING - 1 places are too near to the end to hold such an n-gram.
            out[place, -1] = min(1.0, telling / max(1, length - TELLING + 1))
            if len(rows) > begin:
                unseen.append(place)
                begins.append(begin)
        if unseen:
            counts = np.diff(np.append(begins, len(rows)))
            out[unseen, :-1] = np.add.reduceat(self.grams.table[rows], begins, axis=0) / counts[:, None]
        at = np.asarray(known, np.int64)
        out[at >= 0, :-1], out[at >= 0, -1] = self.words.table[at[at >= 0]], 1.0
        return out

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The best language of each text, and its score."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        split = [WORD.findall(x.lower()) for x in texts]
        flat = pa.array([w for x in split for w in x], pa.string()).dictionary_encode()
        unique = flat.dictionary.to_pylist()
        if len(self.places) > KEPT_UNSEEN:
            self.forget()
        fresh = [w for w in unique if w not in self.places and (w.isalpha() or any(map(str.isalpha, w)))]
        if fresh:
            self.places.update(zip(fresh, range(len(self.store), len(self.store) + len(fresh))))
            self.store = np.concatenate([self.store, self.judged(fresh)])
        rows = np.fromiter((self.places.get(w, 0) for w in unique), np.int64, len(unique))
        lettered, table = rows > 0, self.store[rows]
        ends = np.cumsum([len(x) for x in split], dtype=np.int64)
        where = flat.indices.to_numpy(zero_copy_only=False)
        running = np.zeros((len(where) + 1, len(self.languages) + 1))
        np.take(table, where, axis=0, out=running[1:], mode="clip")
        np.cumsum(running[1:], axis=0, out=running[1:])
        letters = np.concatenate([[0], np.cumsum(lettered[where])])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        sums = running[ends] - running[starts]
        total = sums[:, :-1] + self.prior
        best = total.argmax(axis=1)
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        words = letters[ends] - letters[starts]
        evidence = np.clip(sums[:, -1] / np.maximum(words, 1), 0.0, 1.0)
        scores = np.where(words > 0, evidence * odds.max(axis=1) / odds.sum(axis=1), 0.0)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best, words)], scores


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> tuple:
    """Learn from about `rows` of the rows where `learn` holds and the language is given, as many of each language: the arguments of `Model`.

    Languages are a short list by nature; their counts, and the words and n-grams kept, reach the driver.
    """
    spark = docs.sparkSession
    labelled = docs.where(learn & F.col(lang_col).isNotNull()).withColumn("_lang", F.col(lang_col).cast("string"))
    texts = {x["_lang"]: x["n"] for x in labelled.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(texts)
    if not languages:
        return [], {}, {}, []
    bounds = spark.createDataFrame([(k, int(min(1.0, max(1, rows // len(texts)) / n) * (1 << 30))) for k, n in texts.items()], "_lang string, _bound long")
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(6)), F.lit(1 << 30))
    chosen = labelled.select("_lang", F.col(text_col).alias("_text"), draw.alias("_draw")).join(F.broadcast(bounds), "_lang").where("_draw < _bound")
    narrow = chosen.select(F.col("_lang").alias("lang"), F.col("_text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_release()
        words: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for some in column_chunks(batch.column(1), STEP_BYTES):
                for lang, text in zip(batch.column(0)[some.start : some.stop].to_pylist(), as_texts(batch.column(1)[some.start : some.stop])):
                    words.update((lang, w) for w in WORD.findall(text.lower()))
        chars: Counter[tuple[str, str]] = Counter()
        for (lang, word), n in words.items():
            for g in grams(word):
                chars[lang, g] += n
        for kind, counts in (("word", words), ("gram", chars)):
            items = list(counts.items())
            for k in range(0, len(items), 50_000):
                some = items[k : k + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(some)), pa.array([x[0][0] for x in some], pa.string()), pa.array([x[0][1] for x in some], pa.string()), pa.array([x[1] for x in some], pa.int64())],
                    names=["kind", "lang", "item", "n"],
                )

    counted = narrow.mapInArrow(trimmed(count), "kind string, lang string, item string, n long").groupBy("kind", "lang", "item").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted)

    def top(kind: str, most: int) -> dict[str, list[int]]:
        mine = counted.where((F.col("kind") == kind) & (F.col("n") >= 2))
        placed = mine.withColumn("_place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "item")))
        kept = placed.where(F.col("_place") <= max(1, most // len(languages))).select("item").distinct()
        table: dict[str, list[int]] = {}
        place = {lang: k for k, lang in enumerate(languages)}
        for x in counted.where(F.col("kind") == kind).join(kept, "item", "left_semi").select("lang", "item", "n").collect():
            table.setdefault(x["item"], [0] * len(languages))[place[x["lang"]]] = x["n"]
        return dict(sorted(table.items()))

    return languages, top("word", KEPT_WORDS), top("gram", KEPT_GRAMS), [texts[x] for x in languages]


def predict(docs: DataFrame, model: tuple, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All rows and columns with the predicted language and its score."""
    schema = T.StructType([*docs.schema.fields]).add(names[0], "string").add(names[1], "double")
    place = docs.columns.index(text_col)
    # A model travels, of at most KEPT_WORDS + KEPT_GRAMS entries, and is the only copy that a worker holds.
    shared = docs.sparkSession.sparkContext.broadcast(Model(*model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_release()
        own = shared.value
        for batch in batches:
            # A batch of long texts is not held a second time as strings.
            for some in column_chunks(batch.column(place), STEP_BYTES):
                part = batch.slice(some.start, some.stop - some.start)
                langs, scores = own.score(as_texts(part.column(place)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(trimmed(run), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves no rest modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row per document: id, held_out, lang_pred, score."""
    model = fit(docs, ~held_out(id_col), id_col, text_col, lang_col)
    narrow = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    return predict(narrow, model, "_text").drop("_text")


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is told with a score of `least` or more, with all their columns."""
    model = fit(docs, ~held_out(id_col), id_col, text_col, lang_col)
    names = (free_name(docs, "lang_pred"), free_name(docs, "score"))
    told = predict(docs, model, text_col, names)
    return told.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least)).select(*docs.columns)
