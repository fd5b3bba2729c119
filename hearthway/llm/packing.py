"""Mixture-controlled packing of documents into sequences of fixed size.

Every source is a queue of tokens, cut into chunks of a quarter window. Deficit round-robin
serves the queues: each round adds a quantum to every queue's credit, whole chunks are sent while credit
lasts, and what is left is carried on. With integer arithmetic the credit before any round has a closed
form, so each task continues with the deficits of all windows before its own. By default the quanta
are the sources' shares of all tokens, and all queues run dry together; given weights set other
target proportions while queues last.

Null text is an empty document; null and empty sources are one queue. A document is its ids and a
closing id, and each id lies in exactly one piece. Repeated rows are packed as often as they
occur. Rows with null ids are packed. An empty table gives no pieces. Very long texts are
cut into many pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthway.llm.shared import as_bytes, byte_chunks, running_total, trimmed
from hearthway.llm.tokens import encoder
from hearthway.session import cut_lineage

#: Chunks per window: the smallest unit of the mixture.
CHUNKS = 4
#: So many queues are known to every task; the places of more are found as a table, in the same order.
MOST_QUEUES = 256
#: Chunks of a queue that one row stands for until they are dealt out.
RUN = 1 << 16


def tokenized(docs: DataFrame, id_col: str, text_col: str, source_col: str | None, tokenizer: str, ranks: str | None, closing_id: int) -> DataFrame:
    """Documents as ids (2 or 4 bytes each), with their place in their source within the writing task."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("")) if source_col else F.lit("")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), F.col(text_col).alias("text"))
    names = ["doc_id", "source", "part", "start", "n", "ids"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        own = encoder(tokenizer, ranks)
        closing = np.asarray([closing_id], own.kind).tobytes()
        before: dict[str, int] = {}
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for some in byte_chunks(texts, 2 << 20):
                ids = [x.tobytes() + closing for x in own.encode(texts[some])]
                sources = batch.column(1)[some.start : some.stop].to_pylist()
                sizes = [len(x) // own.kind.itemsize for x in ids]
                starts = []
                for source, size in zip(sources, sizes):
                    starts.append(before.get(source, 0))
                    before[source] = starts[-1] + size
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[some.start : some.stop], pa.array(sources, pa.string()), pa.array([part] * len(ids), pa.int32()),
                     pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    names=names,
                )

    return cut_lineage(narrow.mapInArrow(trimmed(encode), "doc_id long, source string, part int, start long, n long, ids binary"))


def muldiv(x: np.ndarray, y: int, z: int) -> np.ndarray:
    """floor(x * y / z) for x below 2**40 and y, z below 2**38, without overflow."""
    whole, rest = divmod(y, z)
    high, low = x >> 20, x & ((1 << 20) - 1)
    first = high * rest
    second = ((first % z) << 20) + low * rest
    return x * whole + ((first // z) << 20) + second // z


class Schedule:
    """Where each chunk of each queue goes."""

    def __init__(self, tokens: list[int], window: int, weights: list[float] | None = None):
        self.chunk = window // CHUNKS
        self.window = window
        self.chunks = [t // self.chunk for t in tokens]
        self.rounds = max(1, -(-sum(self.chunks) // CHUNKS))
        if weights is None:
            self.quanta = [max(1, c) for c in self.chunks]
        else:
            # A queue without weight is served last, at the smallest pace.
            unit = CHUNKS * self.rounds / max(sum(weights), 1e-300)
            self.quanta = [max(1, round(w * unit)) for w in weights]
        rest = [t - c * self.chunk for t, c in zip(tokens, self.chunks)]
        self.tail = sum(self.chunks) * self.chunk + np.concatenate([[0], np.cumsum(rest)[:-1]]).astype(np.int64)

    def sent(self, queue: int, rounds: np.ndarray) -> np.ndarray:
        """Chunks of a queue sent in so many rounds; the fraction left over is its deficit."""
        return np.minimum(muldiv(rounds, self.quanta[queue], self.rounds), self.chunks[queue])

    def ranks(self, queue: int, chunk: np.ndarray) -> np.ndarray:
        """Places of chunks of one queue in the order of all chunks."""
        quantum = self.quanta[queue]
        # The round in which the credit first covers the chunk.
        turn = -muldiv_negative(chunk + 1, self.rounds, quantum) - 1
        place = chunk - self.sent(queue, turn)
        for other in range(len(self.chunks)):
            # Queues before this one have had their turn in the same round.
            place += self.sent(other, turn + 1 if other < queue else turn)
        return place


def muldiv_negative(x: np.ndarray, y: int, z: int) -> np.ndarray:
    """-ceil(x * y / z)."""
    down = muldiv(x, y, z)
    # Rest of the division, from products taken modulo 2**64: it is below z.
    rest = x.astype(np.uint64) * np.uint64(y) - down.astype(np.uint64) * np.uint64(z)
    return -(down + (rest != 0))


def pieces_of(schedule: Schedule, queue: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cut documents (queue, begin in its queue, size): row, start in the document, length, global place."""

    def places(row: np.ndarray, chunk: np.ndarray, low: np.ndarray) -> np.ndarray:
        place = np.empty(len(row), np.int64)
        of, step = queue[row], schedule.chunk
        for q in np.unique(of):
            mine = np.flatnonzero(of == q)
            c = chunk[mine]
            full = schedule.chunks[q]
            inner = c < full
            place[mine[inner]] = schedule.ranks(q, c[inner]) * step + low[mine[inner]] - c[inner] * step
            place[mine[~inner]] = schedule.tail[q] + low[mine[~inner]] - full * step
        return place

    return cut_pieces(schedule.window, begin, size, places)


def cut_pieces(window: int, begin: np.ndarray, size: np.ndarray, places: Callable) -> tuple[np.ndarray, ...]:
    """Cut documents by the places of their chunks (row, chunk, begin in its queue)."""
    step = window // CHUNKS
    first, last = begin // step, (begin + size - 1) // step
    count = last - first + 1
    row = np.repeat(np.arange(len(begin)), count)
    chunk = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    low = np.maximum(chunk * step, begin[row])
    high = np.minimum((chunk + 1) * step, (begin + size)[row])
    place = places(row, chunk, low)
    start, length = low - begin[row], high - low
    # Only the tail can cross a window's end.
    end = (place // window + 1) * window
    over = np.flatnonzero(place + length > end)
    cut = end[over] - place[over]
    at = over + 1
    row, start, length, place = (np.insert(x, at, y) for x, y in ((row, row[over]), (start, start[over] + cut), (length, length[over] - cut), (place, end[over])))
    length[over + np.arange(len(over))] = cut
    # Neighbours that lie side by side in one window are one piece.
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + length[:-1]) | (place[1:] % window == 0)
    heads = np.flatnonzero(new)
    return row[heads], start[heads], np.add.reduceat(length, heads) if len(heads) else length, place[heads]


def chunk_places(totals: DataFrame, window: int, weights: dict[str, float] | None) -> tuple[DataFrame, DataFrame]:
    """The schedule of any number of queues as tables: (source, full, tail) and (source, chunk, rank).

    The order of all chunks is that of the round, the queue and the chunk, so ranks are running totals. Weights of
    sources without rows do not count.
    """
    spark = totals.sparkSession
    step = window // CHUNKS
    sized = totals.select("source", "n", F.floor(F.col("n") / step).alias("full"), (F.col("n") % step).alias("rest"), (-F.col("n")).alias("_less"), F.lit(1).cast("long").alias("_one"))
    numbered = running_total(sized, ["_less", "source"], "_one", "queue")
    tails = running_total(numbered, ["queue"], "rest", "before")
    all_chunks = tails.agg(F.sum("full")).first()[0] or 0
    rounds = max(1, -(-all_chunks // CHUNKS))
    if weights is None:
        tails = tails.withColumn("quantum", F.greatest("full", F.lit(1)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()] or [("", 0.0)], "source string, weight double")
        tails = cut_lineage(tails.join(given, "source", "left").fillna(0.0, ["weight"]))
        unit = CHUNKS * rounds / max(tails.agg(F.sum("weight")).first()[0] or 0.0, 1e-300)
        tails = tails.withColumn("quantum", F.greatest(F.bround(F.col("weight") * unit).cast("long"), F.lit(1)))
    runs = tails.where("full > 0").select("source", "queue", "quantum", "full", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1, F.lit(RUN).cast("long"))).alias("low"))
    chunks = runs.repartition("source", "low").select("source", "queue", "quantum", F.explode(F.sequence("low", F.least(F.col("low") + RUN, F.col("full")) - 1)).alias("chunk"))

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The round in which the credit first covers the chunk.
            turn = -muldiv_negative(batch.column("chunk").to_numpy() + 1, rounds, batch.column("quantum").to_numpy()) - 1
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("queue"), batch.column("chunk"), pa.array(turn, pa.int64()), pa.array(np.ones(len(turn), np.int64))], names=["source", "queue", "chunk", "turn", "_one"])

    timed = chunks.mapInArrow(turns, "source string, queue long, chunk long, turn long, _one long")
    ranks = running_total(timed, ["turn", "queue", "chunk"], "_one", "rank").select("source", "chunk", "rank")
    return tails.select("source", "full", (F.col("before") + all_chunks * step).alias("tail")), ranks


def with_places(rows: DataFrame, parts: DataFrame, totals: DataFrame, window: int, weights: dict[str, float] | None) -> DataFrame:
    """Documents with their begin in their queue and the places of all chunks that they touch, in order."""
    step, key = window // CHUNKS, ["source", "part", "start"]
    tails, ranks = chunk_places(totals, window, weights)
    # Running totals over all sources, less that of the source's first part.
    sums = running_total(parts, ["source", "part"], "n", "sum")
    begins = sums.join(sums.groupBy("source").agg(F.min("sum").alias("first")), "source").select("source", "part", (F.col("sum") - F.col("first")).alias("base"))
    slim = rows.select(*key, "n").join(begins, ["source", "part"]).join(tails, "source").withColumn("begin", F.col("base") + F.col("start"))
    touched = slim.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("begin") / step), F.floor((F.col("begin") + F.col("n") - 1) / step))))
    at = F.coalesce(F.col("rank") * step, F.col("tail") + (F.col("chunk") - F.col("full")) * step)
    placed = touched.join(ranks, ["source", "chunk"], "left").select(*key, "begin", F.struct("chunk", at.alias("at")).alias("c"))
    listed = placed.groupBy(*key).agg(F.first("begin").alias("begin"), F.transform(F.array_sort(F.collect_list("c")), lambda c: c["at"]).alias("places"))
    return rows.join(listed, key).select("doc_id", "source", "n", "ids", "begin", "places")


def pack(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source",
    window: int = 1024, closing_id: int = 0, weights: dict[str, float] | None = None, with_ids: bool = False,
) -> DataFrame:
    """Pack documents into sequences of `window` ids.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source
    (and the ids, as little-endian unsigned 32-bit integers, on request). Only the last sequence may be shorter.
    """
    spark = docs.sparkSession
    rows = tokenized(docs, id_col, text_col, source_col, tokenizer, ranks, closing_id)
    parts = cut_lineage(rows.groupBy("source", "part").agg(F.sum("n").alias("n")))
    totals = parts.groupBy("source").agg(F.sum("n").alias("n"))
    largest = [(x["source"], x["n"]) for x in totals.orderBy(F.desc("n"), "source").limit(MOST_QUEUES + 1).collect()]
    many = len(largest) > MOST_QUEUES
    if many:
        placed = with_places(rows, parts, totals, window, weights)
    else:
        tokens = [n for _, n in largest]
        share = None if weights is None else [weights.get(s, 0.0) for s, _ in largest]
        schedule = Schedule(tokens, window, share)
        before = np.concatenate([[0], np.cumsum(tokens)[:-1]]).astype(np.int64)
        listed = spark.createDataFrame([(s, k) for k, (s, _) in enumerate(largest)], "source string, queue int")
        numbered = parts.join(F.broadcast(listed), "source")
        base = running_total(numbered, ["queue", "source", "part"], "n", "base").select("source", "part", "queue", "base")
        placed = rows.join(base, ["source", "part"]).select("doc_id", "source", "n", "start", "ids", "queue", "base")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    wide = _width(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("n").to_numpy()
            if many:
                begin, own = batch.column("begin").to_numpy(), np.asarray(batch.column("places").flatten())
                row, start, length, place = cut_pieces(window, begin, size, lambda row, chunk, low: own + low - chunk * (window // CHUNKS))
            else:
                queue = batch.column("queue").to_numpy()
                begin = batch.column("base").to_numpy() + batch.column("start").to_numpy() - before[queue]
                row, start, length, place = pieces_of(schedule, queue, begin, size)
            ids = [np.frombuffer(x, wide).astype("<u4") for x in batch.column("ids").to_pylist()]
            bodies = [ids[r][s : s + n].tobytes() for r, s, n in zip(row, start, length)]
            crc = [zlib.crc32(x) for x in bodies]
            chosen = pa.array(row)
            arrays = [batch.column("doc_id").take(chosen), start, length, crc, size[row], place // window, place % window, batch.column("source").take(chosen)]
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in arrays]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(bodies, pa.binary())] * with_ids, names=names)

    return placed.mapInArrow(trimmed(cut), schema)


def _width(rows: DataFrame) -> str:
    one = rows.select((F.length("ids") / F.col("n")).cast("int").alias("w")).first()
    return "<u2" if one is None or one["w"] == 2 else "<u4"
