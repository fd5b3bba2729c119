"""Scoring texts with a hidden Markov language model.

A text is the sequence of its words, A-Z in lower case, and one end. Latent states follow each other as a Markov chain and each emits one token. A state
emits the class of a token, and the class the token by its count: a word that makes up a share of `1 / OWN` or more of all words is a class
of its own (there are at most `OWN` such words), the others share `SHARED` classes by a hash, each with a share for words that
were not learned. So what is broadcast has a fixed size, while the counts behind it are those of all words of all learned texts, as a table.

Texts are first brought into blocks of about `BLOCK_BYTES`. A block lists its distinct words once: counts are summed over these lists, and joined
back to them, so a frequent word is one row per block and not one per place. Each round of Baum-Welch then is one scan of the coded
texts: every task adds up the expected counts of its texts, they are summed by class and the new model has one row per class. The states get their start
from one reading of all learned texts in `PARTS` parts, each of which moves the model (stepwise EM); `ROUNDS` rounds of all learned texts follow.

The likelihood of a text is exact: the scaled forward recursion runs over its whole sequence. Texts are cut into segments for that, whose products of transitions give
the vector with which each segment is entered, so long texts are worked on in parallel and in bounded memory.

Null and empty texts consist of the end alone. Rows with null ids are learned from. Repeated rows count and are scored each. Without learned texts
every count is 0 and all states are alike. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthway.llm.shared import as_bytes, byte_chunks, trimmed
from hearthway.session import cut_lineage

#: Text in a block, about, and in a step of its making.
BLOCK_BYTES, STEP_BYTES = 8 << 20, 1 << 20
#: Words with a share of 1 / OWN of all words or more are classes; the other words share SHARED classes.
OWN, SHARED = 4096, 4096
#: Class 0 is the end, then come the words with classes of their own, then the shared ones.
CLASSES = 1 + OWN + SHARED
STATES = 8
#: Parts of the learned texts that the start is made from, how fast later parts weigh less, and rounds over all learned texts behind it.
PARTS, FADE, ROUNDS = 8, 0.6, 3
#: Weight of the class frequencies in the emissions of a state, and of an even spread in its transitions, in tokens.
PRIOR_TOKENS, PRIOR_MOVES = 5.0, 0.5
#: Tokens in a tail of a text, and segments worked on side by side; fewer texts than LONE of a batch have tails.
SEGMENT, GROUP, LONE = 256, 1_200, 96
#: Places from one scaling to the next.
SCALED = 4
#: Tokens of texts that are worked on at a time, one text at least.
BATCH_TOKENS = 400_000


class Block:
    """Texts under way: their tokens as places in a list of distinct words."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.ids, self.learned, self.sizes, self.tokens = [], [], [], []
        self.counts = np.zeros(0, np.int64)
        self.bytes = 0

    def add(self, ids: pa.Array, learned: np.ndarray, texts: list[bytes]) -> None:
        split = [x.lower().split() for x in texts]
        sizes = np.array([len(x) for x in split], np.int64)
        coded = pa.array([w for x in split for w in x], pa.large_binary()).dictionary_encode()
        words = self.words
        places = np.array([words.setdefault(w, len(words)) for w in coded.dictionary.to_pylist()], np.int32)
        tokens = places[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int32)
        counts = np.bincount(tokens[np.repeat(learned, sizes)], minlength=len(words))
        counts[: len(self.counts)] += self.counts
        self.counts = counts
        self.ids.append(ids)
        self.learned.append(learned)
        self.sizes.append(sizes)
        self.tokens.append(tokens)
        self.bytes += sum(map(len, texts))

    def row(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        lists = [pa.concat_arrays(self.ids), pa.array(np.concatenate(self.learned)), pa.array(np.concatenate(self.sizes))]
        # Frequent words get small numbers, so that most bytes of the numbers are zeros, which compress away.
        tokens = np.concatenate(self.tokens)
        order = np.argsort(-np.bincount(tokens, minlength=len(self.words)), kind="stable")
        number_of = np.empty(len(order), np.int32)
        number_of[order] = np.arange(len(order))
        words = pa.array(list(self.words), pa.large_binary()).take(pa.array(order)).cast(pa.large_string()).cast(pa.string())
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        planes = pa.array([as_planes(number_of[tokens])], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([number]), *map(one, lists), planes, one(words), one(pa.array(self.counts[order]))], schema=schema)


def as_planes(numbers: np.ndarray) -> bytes:
    """The lowest bytes of all 32-bit numbers, then the next ones, and so on."""
    return numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def blocks(docs: DataFrame, learn: Column, id_col: str, text_col: str) -> DataFrame:
    """A row per block: block, ids, learned, sizes, tokens, words, counts; written."""
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(True)).alias("learned"), F.col(text_col).alias("text"))
    schema = T.StructType().add("block", "long").add("ids", T.ArrayType(narrow.schema["id"].dataType)).add("learned", T.ArrayType(T.BooleanType()))
    longs, strings = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
    schema = schema.add("sizes", longs).add("tokens", "binary").add("words", strings).add("counts", longs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, block, shape = TaskContext.get().partitionId() << 32, Block(), None
        for batch in batches:
            texts, learned = as_bytes(batch.column(2)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            shape = pa.schema([
                ("block", pa.int64()), ("ids", pa.list_(batch.schema.field(0).type)), ("learned", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())),
                ("tokens", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
            ])
            for part in byte_chunks(texts, STEP_BYTES):
                block.add(batch.column(0).slice(part.start, part.stop - part.start), learned[part], texts[part])
                if block.bytes >= BLOCK_BYTES:
                    yield block.row(number, shape)
                    number, block = number + 1, Block()
        if block.ids:
            yield block.row(number, shape)

    return cut_lineage(narrow.mapInArrow(trimmed(run), schema))


@dataclass
class Totals:
    """What the learned texts hold: tokens, distinct tokens, texts, and per class its tokens and distinct words."""

    tokens: int
    distinct: int
    texts: int
    of_class: np.ndarray
    words_of_class: np.ndarray

    @property
    def all(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    def class_mass(self) -> np.ndarray:
        """Tokens of each class, with half a token for each word and for the unseen words of a shared class."""
        mass = self.of_class + 0.5 * self.words_of_class
        mass[0] = self.texts + 0.5
        mass[1 + OWN :] += 0.5
        return mass

    def within(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of the share of words with these counts in their classes."""
        return np.where(classes > OWN, np.log10((counts + 0.5) / self.class_mass()[classes]), 0.0)


def shared_class(word: Column) -> Column:
    return (F.pmod(F.xxhash64(word), F.lit(SHARED)) + (1 + OWN)).cast("int")


def count_words(made: DataFrame) -> tuple[DataFrame, Totals]:
    """(word, count, class) of all learned words, and their totals."""
    entries = made.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select("x.words", "x.counts").where("counts > 0")
    counted = cut_lineage(entries.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("count")))
    words, distinct = counted.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    texts = made.agg(F.coalesce(F.sum(F.size(F.filter("learned", lambda x: x))), F.lit(0))).first()[0]
    # At most OWN words are so frequent, and together at most OWN times as long as the mean token.
    frequent = counted.where(F.col("count") * OWN >= words).select("word", F.row_number().over(Window.orderBy("word")).alias("own"))
    classed = counted.join(F.broadcast(frequent), "word", "left").select("word", "count", F.coalesce("own", shared_class(F.col("word"))).alias("class"))
    of_class, words_of = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in classed.groupBy("class").agg(F.sum("count").alias("n"), F.count("*").alias("v")).collect():
        of_class[row["class"]], words_of[row["class"]] = row["n"], row["v"]
    of_class[0] = texts
    return classed, Totals(words + texts, distinct + (texts > 0), texts, of_class, words_of)


def code_texts(made: DataFrame, classed: DataFrame, totals: Totals) -> DataFrame:
    """A row per document: id, learned, n_tokens, n_known, base_score, within, classes (16-bit numbers); written."""
    places = made.select(F.col("block").alias("of_block"), F.posexplode("words").alias("place", "word"))
    told = places.join(classed, "word", "left").select("of_block", "place", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("class", shared_class(F.col("word"))).alias("class"))
    id_type = made.schema["ids"].dataType.elementType
    schema = T.StructType().add("id", id_type).add("learned", "boolean").add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("within", "double").add("classes", "binary")
    end = np.log10((totals.texts + 0.5) / totals.all)

    def code(block: pa.Table, words: pa.Table) -> pa.Table:
        ids, learned, sizes, tokens = (block.column(c).combine_chunks() for c in ("ids", "learned", "sizes", "tokens"))
        place = words.column("place").to_numpy()
        counts, classes = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        counts[place], classes[place] = words.column("count").to_numpy(), words.column("class").to_numpy()
        flat, size = from_planes(tokens[0].as_buffer()), sizes.flatten().to_numpy()
        row, n = np.repeat(np.arange(len(size)), size), len(size)
        per_text = lambda x: np.bincount(row, weights=x[flat], minlength=n).astype(float)
        known = per_text((counts > 0).astype(float)).astype(np.int64) + int(totals.texts > 0)
        base = per_text(np.log10((counts + 0.5) / totals.all)) + end
        inner = per_text(totals.within(counts, classes))
        # Class 0, the end, stands behind the tokens of each text.
        sequence = np.zeros(len(flat) + n, np.uint16)
        sequence[np.arange(len(flat)) + row] = classes[flat]
        edges = np.concatenate([[0], np.cumsum(2 * (size + 1))]).astype(np.int32)
        binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges), pa.py_buffer(sequence)])
        return pa.Table.from_arrays([ids.flatten(), learned.flatten(), pa.array(size + 1), pa.array(known), pa.array(base), pa.array(inner), binary], names=schema.names)

    left = made.select("block", "ids", "learned", "sizes", "tokens").groupBy("block")
    return cut_lineage(left.cogroup(told.groupBy("of_block")).applyInArrow(code, schema))


@dataclass
class Model:
    """Chances of the first state, of moves between states, and of each class in each state (a row per class)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def estimate(start: np.ndarray, move: np.ndarray, emit: np.ndarray, totals: Totals) -> Model:
    """The model of expected counts, with a prior of class frequencies."""
    mass = totals.class_mass()
    emit = emit + PRIOR_TOKENS * (mass / mass.sum())[:, None]
    return Model(unit(start + PRIOR_MOVES), unit(move + PRIOR_MOVES), emit / emit.sum(axis=0))


def first_model(totals: Totals, seed: int) -> Model:
    """States that differ by chance and tend to stay."""
    rng = np.random.default_rng(seed)
    mass = totals.class_mass()[:, None]
    return estimate(np.zeros(STATES), 10 * np.eye(STATES), mass * rng.random((CLASSES, STATES)) ** 2, totals)


class Segments:
    """Sequences of classes cut into segments: a head as long as many sequences are, side by side, and tails of `SEGMENT`.

    A vector has a row per state and a column per segment. The sum of a vector is taken out every `SCALED` places.
    """

    def __init__(self, model: Model, classes: np.ndarray, sizes: np.ndarray):
        self.model, self.classes = model, classes
        self.states = len(model.start)
        self.emit, self.onward = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
        # Fewer than LONE sequences reach behind the head, so their heads are in the first group.
        head = max(SEGMENT, int(np.partition(sizes, -LONE)[-LONE])) if len(sizes) >= LONE else SEGMENT
        per = 1 + -(-np.maximum(sizes - head, 0) // SEGMENT)
        self.first, self.per = np.cumsum(per) - per, per
        self.text = np.repeat(np.arange(len(sizes)), per)
        number = np.arange(len(self.text)) - self.first[self.text]
        self.head = number == 0
        offset = np.where(self.head, 0, head + (number - 1) * SEGMENT)
        self.begin = (np.cumsum(sizes) - sizes)[self.text] + offset
        self.length = np.minimum(np.where(self.head, head, SEGMENT), sizes[self.text] - offset)
        self.enter, self.leave = np.tile(model.start[:, None], len(self.text)), np.ones((self.states, len(self.text)))

    def groups(self, some: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """Segments in groups, longest first."""
        some = some[np.argsort(-self.length[some], kind="stable")]
        for k in range(0, len(some), most):
            yield some[k : k + most]

    def heads(self) -> Iterator[np.ndarray]:
        return self.groups(np.flatnonzero(self.head), max(GROUP, LONE))

    def tails(self) -> Iterator[np.ndarray]:
        return self.groups(np.flatnonzero(~self.head), GROUP)

    def steps(self, group: np.ndarray) -> tuple[list[slice], np.ndarray]:
        """For each place the tokens of the segments that reach it, which are the first ones of the group, and the classes of all tokens."""
        lengths = self.length[group]
        reach = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        ends = np.cumsum(reach)
        place = np.repeat(np.arange(len(reach)), reach)
        column = np.arange(ends[-1]) - (ends - reach)[place]
        return [slice(e - n, e) for e, n in zip(ends.tolist(), reach.tolist())], self.classes[self.begin[group][column] + place].astype(np.int64)

    def cross(self, group: np.ndarray, last: np.ndarray, back: bool) -> None:
        """Vectors at the borders of all tails and, if asked, behind the heads, from the products of moves and emissions over each tail.

        `last` has the vectors at the ends of the heads in `group`.
        """
        if self.head.all():
            return
        products = np.zeros((self.states, self.states, len(self.text)))
        for some in self.tails():
            products[:, :, some] = self.product(some)
        long = self.per[self.text[group]] > 1
        self.enter[:, group[long] + 1] = last[:, long] / last[:, long].sum(axis=0)
        for k in range(2, int(self.per.max())):
            at = self.first[self.per > k] + k
            vector = np.einsum("in,ijn->jn", self.enter[:, at - 1], products[:, :, at - 1])
            self.enter[:, at] = vector / vector.sum(axis=0)
        for k in range(int(self.per.max()) - 1, 0, -1) if back else ():
            at = self.first[self.per > k] + k
            vector = np.einsum("ijn,jn->in", products[:, :, at], self.leave[:, at])
            self.leave[:, at - 1] = vector / vector.sum(axis=0)

    def product(self, group: np.ndarray) -> np.ndarray:
        """The product of moves and emissions over each tail, up to a factor."""
        steps, classes = self.steps(group)
        out = np.tile(self.onward.T[:, :, None], len(group))
        for t, at in enumerate(steps):
            n = at.stop - at.start
            now = self.onward @ out[:, :, :n] if t else out
            now *= self.emit[:, classes[at]]
            if t % SCALED == SCALED - 1:
                now /= now.sum(axis=(0, 1))
            out[:, :, :n] = now
        return out / out.sum(axis=(0, 1))

    def forward(self, group: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, tuple | None]:
        """The log of the likelihood that each segment adds, the vectors at its end and, if kept, steps, classes, emissions, vectors and scales at each place."""
        steps, classes = self.steps(group)
        logs, last = np.zeros(len(group)), np.empty((self.states, len(group)))
        emissions = self.emit[:, classes] if keep else None
        vectors = np.empty_like(emissions) if keep else None
        scales: list[np.ndarray | None] = []
        now = np.where(self.head[group], self.enter[:, group], self.onward @ self.enter[:, group])
        for t, at in enumerate(steps):
            n = at.stop - at.start
            if t:
                last[:, n : now.shape[1]] = now[:, n:]
                now = self.onward @ now[:, :n]
            now *= emissions[:, at] if keep else self.emit[:, classes[at]]
            scale = None
            if t % SCALED == SCALED - 1:
                scale = now.sum(axis=0)
                now /= scale
                logs[:n] += np.log(scale)
            if keep:
                vectors[:, at] = now
                scales.append(scale)
        last[:, : now.shape[1]] = now
        return logs + np.log(last.sum(axis=0)), last, (steps, classes, emissions, vectors, scales) if keep else None

    def log_likelihood(self, texts: int) -> np.ndarray:
        out = np.zeros(texts)
        for number, group in enumerate(self.heads()):
            logs, last, _ = self.forward(group, False)
            out += np.bincount(self.text[group], weights=logs, minlength=texts)
            if not number:
                self.cross(group, last, False)
        for group in self.tails():
            out += np.bincount(self.text[group], weights=self.forward(group, False)[0], minlength=texts)
        return out

    def expected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of first states, moves and emissions."""
        sums = np.zeros(self.states), np.zeros((self.states, self.states)), np.zeros_like(self.emit)
        for number, group in enumerate(self.heads()):
            _, last, kept = self.forward(group, True)
            if not number:
                self.cross(group, last, True)
            self.backward(group, last, kept, *sums)
        for group in self.tails():
            _, last, kept = self.forward(group, True)
            self.backward(group, last, kept, *sums)
        start, move, emit = sums
        return start, move * self.model.move, emit.T

    def backward(self, group: np.ndarray, last: np.ndarray, kept: tuple, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """Add the expected counts of a group whose forward vectors are given; moves up to their chances.

        Both directions share the scales, so that the product of their vectors adds up to 1 at every place.
        """
        steps, classes, emissions, vectors, scales = kept
        later = self.leave[:, group]
        later = later / (last * later).sum(axis=0)
        inner = ~self.head[group]
        for t in range(len(steps) - 1, -1, -1):
            at = steps[t]
            n = at.stop - at.start
            weight, chance = emissions[:, at], vectors[:, at]
            weight *= later[:, :n]
            if scales[t] is not None:
                weight /= scales[t]
            chance *= later[:, :n]
            if t:
                before = steps[t - 1].start
                move += vectors[:, before : before + n] @ weight.T
                later[:, :n] = self.model.move @ weight
            else:
                move += self.enter[:, group[inner]] @ weight[:, inner].T
                start += chance[:, ~inner].sum(axis=1)
        for s in range(self.states):
            emit[s] += np.bincount(classes, weights=vectors[s], minlength=emit.shape[1])


def sequences(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of rows of about `BATCH_TOKENS` tokens, with their classes side by side and their sizes."""
    rows = column.to_pylist()
    for part in byte_chunks(rows, 2 * BATCH_TOKENS):
        yield part, np.frombuffer(b"".join(rows[part]), np.uint16), np.array([len(x) // 2 for x in rows[part]])


def expected_counts(coded: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected first states, moves and emissions over the coded texts: a row per class and state reaches the driver, whatever the data."""
    states = len(model.start)
    # Rows of emissions, moves and first states in one table of fixed size.
    schema = "row int, " + ", ".join(f"s{k} double" for k in range(states))
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES + states + 1, states))
        for batch in batches:
            for _, classes, sizes in sequences(batch.column(0)):
                start, move, emit = Segments(shared.value, classes, sizes).expected()
                total += np.concatenate([emit, move, start[None]])
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *map(pa.array, total[used].T)], names=["row", *(f"s{k}" for k in range(states))])

    summed = coded.select("classes").mapInArrow(trimmed(count), schema).groupBy("row").agg(*(F.sum(f"s{k}") for k in range(states)))
    table = np.zeros((CLASSES + states + 1, states))
    for row in summed.collect():
        table[row[0]] = row[1:]
    shared.destroy()
    return table[-1], table[CLASSES:-1], table[:CLASSES]


def learn_round(coded: DataFrame, model: Model, totals: Totals) -> Model:
    """One round of Baum-Welch over the coded texts."""
    return estimate(*expected_counts(coded, model), totals)


def fit(coded: DataFrame, totals: Totals, seed: int = 1) -> Model:
    """States learned from the coded texts marked as learned."""
    model = first_model(totals, seed)
    if not totals.texts:
        return model
    learned = coded.where("learned")
    part = F.pmod(F.xxhash64("id", "n_tokens"), F.lit(PARTS))
    running, steps = None, 0
    for number in range(PARTS):
        found = expected_counts(learned.where(part == number).select("classes"), model)
        if not (held := found[2].sum()):
            continue
        # As many counts as all learned texts would give.
        found = [x * (totals.tokens / held) for x in found]
        steps += 1
        weight = steps**-FADE
        running = found if running is None else [(1 - weight) * x + weight * y for x, y in zip(running, found)]
        model = estimate(*running, totals)
    for _ in range(ROUNDS):
        model = learn_round(learned.select("classes"), model, totals)
    return model


def score(coded: DataFrame, model: Model, totals: Totals, id_name: str) -> DataFrame:
    """A row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    narrow = coded.select(F.col("id").alias(id_name), (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "within", "classes")
    schema = T.StructType([*narrow.schema.fields[:6]]).add("score", "double")
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = batch.column(6).to_numpy().copy()
            for part, classes, sizes in sequences(batch.column(7)):
                scores[part] += Segments(shared.value, classes, sizes).log_likelihood(len(sizes)) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(scores)], names=schema.names)

    return narrow.mapInArrow(trimmed(run), schema)


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """Learn from the rows where `learn` holds and score all; log10 probabilities, `base_score` by single tokens, `score` by the model."""
    made = blocks(docs, learn, id_col, text_col)
    classed, totals = count_words(made)
    coded = code_texts(made, classed, totals)
    return score(coded, fit(coded, totals, seed), totals, id_col)
