"""Links between documents whose word n-gram sets have a high Jaccard similarity.

Sets that can link are brought together without loss: a set is cut into so many parts by hash that two
linked sets, which differ in few elements, agree in at least one part that is not empty. Documents that
share a part, directly or over others, form a cluster. Within a cluster, signature trees hold in
each node the OR of the token bitmaps below it and the range of set sizes; a dual traversal drops pairs of
nodes whose largest possible overlap is too small, or whose documents are linked already, and what is
left is compared exactly. Large clusters are cut into blocks.

Null and blank texts have an empty set and link with nothing; fewer words than a shingle has are one
shingle. Texts of equal sets (repeated rows among them) are one node of the graph, so copies are not
paired. Rows with a null id are returned with the size of their set and no component, and
link nobody. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthway.llm.shared import as_bytes, byte_chunks, components, fetch_rows, forest, free_name, mix64, trimmed, worker_release
from hearthway.session import cut_lineage, free_shuffles

#: Sizes of a class of sets differ by this factor at most.
CLASS_RATIO = 1.25
#: Shingles of the sets that one task holds at a time, about.
BLOCK_SHINGLES = 500_000
#: Shingles whose part keys make up a bucket, about.
BUCKET_SHINGLES = 2_000_000
#: Bits of a token bitmap, and children of a node.
BITS, FAN = 2048, 8
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct hashes (64 bits) of the word n-grams of each text, ASCII letters lower-cased."""
    split = [x.lower().split() for x in texts]
    flat = pa.array([w for x in split for w in x], pa.binary()).dictionary_encode()
    known = np.empty(len(flat.dictionary), object)
    known[:] = flat.dictionary.to_pylist()
    word = pd.util.hash_array(known, categorize=False)[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
    width = max(1, len(word) - words + 1)
    gram = np.full(width, words, np.uint64)
    for k in range(words):
        gram = gram * _ODD + word[k : k + width] if len(word) >= words else gram
    gram = mix64(gram)
    out, at = [], 0
    for x in split:
        n = len(x)
        if n >= words:
            out.append(np.unique(gram[at : at + n - words + 1]))
        elif n:
            whole = np.full(1, n, np.uint64)
            for k in range(at, at + n):
                whole = whole * _ODD + word[k : k + 1]
            out.append(mix64(whole))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


class Parts:
    """How many parts sets of a class are cut into, for links at `percent` or more."""

    def __init__(self, percent: int):
        self.percent = percent
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * CLASS_RATIO)))
        self.of_class = lru_cache(None)(self._of_class)

    def classes(self, size: int) -> range:
        """The classes of all sets, up to its own size, that a set of this size can link with."""
        least = -(-self.percent * size // 100)
        low, high = np.searchsorted(self.lows, [max(least, 1), size], side="right") - 1
        return range(int(low), int(high) + 1)

    def _of_class(self, number: int) -> tuple[int, int]:
        """(parts, most parts in which linked sets differ)."""
        low, high = self.lows[number], self.lows[number + 1] - 1
        together = high + high * 100 // self.percent
        differ = (100 - self.percent) * together // (100 + self.percent)
        spare = 1
        while True:
            parts = differ + 1 + spare
            if spare >= 1 + 2 * parts * math.exp(-low / parts) or spare > 4 * differ + 8:
                return parts, differ
            spare += 1

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """One key per part of a set; linked sets share at least one."""
        found = []
        mixed = None
        for number in self.classes(len(grams)):
            parts, differ = self.of_class(number)
            if not differ:
                continue  # only equal sets link here, and they are one node
            if mixed is None:
                mixed = mix64(grams ^ _ODD)
            part = ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            sums = np.add.reduceat(mixed, heads)
            place = part[heads]
            if parts - len(heads) >= parts - differ:
                # So many empty parts that linked sets may agree in these alone.
                empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), place)
                place, sums = np.append(place, empty), np.append(sums, np.zeros(len(empty), np.uint64))
            found.append(mix64(sums * _ODD + place + np.uint64(number << 40)))
        return np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)


def described(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """A row per document: id, size and digest (s1, s2) of its set, and `mark`, a hash of its text."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("mark"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_release()
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for some in byte_chunks(texts, 1 << 20):
                sets = shingle_sets(texts[some], words)
                ids = batch.column(0)[some.start : some.stop]
                first, second = digests(sets)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(x) for x in sets], pa.int64()), pa.array(first), pa.array(second), batch.column(2)[some.start : some.stop]],
                    names=["doc_id", "n_shingles", "s1", "s2", "mark"],
                )

    return cut_lineage(narrow.mapInArrow(trimmed(scan), f"doc_id {kind}, n_shingles long, s1 long, s2 long, mark long"))


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    first = np.array([int(mix64(x).sum()) if len(x) else 0 for x in sets], np.uint64)
    second = np.array([int((mix64(x ^ np.uint64(0x5BD1E995)) | np.uint64(1)).sum()) if len(x) else 0 for x in sets], np.uint64)
    size = np.array([len(x) for x in sets], np.uint64)
    return mix64(first + size * _ODD).view(np.int64), mix64(second).view(np.int64)


def clustered(texts: DataFrame, words: int, percent: int, shingles: int = 0) -> DataFrame:
    """(node, root) of the sets that share parts with others, directly or over others.

    `texts` has doc_id and text. Keys are not stored: each task makes those of a batch, ties the sets of
    a key together within it, so that a key of very many sets sends one entry per batch through the shuffle, and
    packs the rest by the bucket of the key, each set's number once per bucket. A bucket is a hash share of all
    keys. Their number grows with `shingles`, those of all sets, and a task sorts the rows of its buckets and works on one bucket at a time.
    """
    buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shingles // BUCKET_SHINGLES))
    narrow = texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("text")
    names = ["bucket", "nodes", "counts", "keys", "a", "b"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_release()
        parts = Parts(percent)
        for batch in batches:
            bodies = as_bytes(batch.column(0))
            for some in byte_chunks(bodies, 2 << 20):
                held: dict[int, np.ndarray] = {}
                for few in byte_chunks(bodies[some], 1 << 20):
                    sets = shingle_sets(bodies[some][few], words)
                    held |= {int(n): parts.keys(x) for n, x in zip(digests(sets)[0], sets) if len(x)}
                yield packed(held)

    def packed(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        key = np.concatenate([np.zeros(0, np.int64), *held.values()])
        node = np.repeat(np.fromiter(held, np.int64, len(held)), [len(x) for x in held.values()])
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        head = np.append(True, key[1:] != key[:-1])[: len(key)]
        hub = node[np.flatnonzero(head)][np.cumsum(head) - 1] if len(key) else node
        root, leaf = forest(hub[~head], node[~head])
        key, node = key[head], node[head]
        bucket = (key.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((key, node, bucket))
        key, node, bucket = key[order], node[order], bucket[order]
        rows: list[list] = [[] for _ in names]
        for at in np.split(np.arange(len(key)), np.flatnonzero(np.diff(bucket)) + 1):
            if len(at):
                nodes, counts = np.unique(node[at], return_counts=True)
                for column, value in zip(rows, (int(bucket[at[0]]), nodes, counts, key[at], [], [])):
                    column.append(value)
        if len(root):
            for column, value in zip(rows, (int(root[0]) % buckets, [], [], [], root, leaf)):
                column.append(value)
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], names=names)

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, current = [], [], None
        for batch in batches:
            of = batch.column("bucket").to_numpy()
            for low, high in zip(starts := np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)]), [*starts[1:], len(of)]):
                if of[low] != current:
                    yield chained(keys, nodes)
                    keys, nodes, current = [], [], of[low]
                flat = {n: batch.column(n).slice(low, high - low).flatten().to_numpy() for n in names[1:]}
                keys.append(flat["keys"].copy())
                nodes.append(np.repeat(flat["nodes"], flat["counts"]))
                if len(flat["a"]):
                    yield edges(*forest(flat["a"], flat["b"]))
        yield chained(keys, nodes)

    def chained(keys: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        """Neighbours of one key, chained, are as connected as all of its pairs."""
        key, node = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *nodes])
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        return edges(*forest(node[same], node[same + 1]))

    def edges(root: np.ndarray, leaf: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(root, pa.int64()), pa.array(leaf, pa.int64())], names=["a", "b"])

    schema = "bucket long, nodes array<long>, counts array<int>, keys array<long>, a array<long>, b array<long>"
    dealt = narrow.mapInArrow(trimmed(emit), schema).repartition("bucket").sortWithinPartitions("bucket")
    # Written first: a stage of two Python steps starts twice the workers, which stay in the executors' memory.
    return components(cut_lineage(dealt.mapInArrow(trimmed(tie), "a long, b long")))


def rare_clusters(texts: DataFrame, members: DataFrame, words: int, percent: int, shingles: int) -> DataFrame:
    """(node, root) of the `members` that share one of their rarest shingles with another of their cluster, directly or over others.

    Two linked sets share a shingle among the first n - ceil(percent * n / 100) + 1 of each, n being its own size and the
    order that of the number of sets that hold a shingle. Sets that have so many shingles to themselves link with
    nobody; common passages come last and tie nothing together. `members` has s1, n and cluster. Shingles go to buckets, as keys do in `clustered`.
    """
    buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shingles // BUCKET_SHINGLES))
    narrow = texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("text")
    names = ["bucket", "nodes", "counts", "keys"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_release()
        for batch in batches:
            bodies = as_bytes(batch.column(0))
            for some in byte_chunks(bodies, 1 << 20):
                sets = shingle_sets(bodies[some], words)
                held = {int(n): x for n, x in zip(digests(sets)[0], sets) if len(x)}
                yield packed(held)

    def packed(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        key = np.concatenate([np.zeros(0, np.uint64), *held.values()])
        node = np.repeat(np.fromiter(held, np.int64, len(held)), [len(x) for x in held.values()])
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((node, bucket))
        key, node, bucket = key[order].view(np.int64), node[order], bucket[order]
        rows: list[list] = [[] for _ in names]
        for at in np.split(np.arange(len(key)), np.flatnonzero(np.diff(bucket)) + 1):
            if len(at):
                nodes, counts = np.unique(node[at], return_counts=True)
                for column, value in zip(rows, (int(bucket[at[0]]), nodes, counts, key[at])):
                    column.append(value)
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, current = [], [], None
        for batch in batches:
            of = batch.column("bucket").to_numpy()
            for low, high in zip(starts := np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)]), [*starts[1:], len(of)]):
                if of[low] != current:
                    yield from held_by(keys, nodes)
                    keys, nodes, current = [], [], of[low]
                flat = {n: batch.column(n).slice(low, high - low).flatten().to_numpy() for n in names[1:]}
                keys.append(flat["keys"].copy())
                nodes.append(np.repeat(flat["nodes"], flat["counts"]))
        yield from held_by(keys, nodes)

    def held_by(keys: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The shingles of a bucket that several sets hold, a row per set."""
        key, node = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *nodes])
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        # Copies of a text are one set.
        other = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))[: len(key)]
        key, node = key[other], node[other]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        sizes = np.diff(np.append(heads, len(key)))
        holders = np.repeat(sizes, sizes)
        several = holders > 1
        key, node, holders = key[several], node[several], holders[several]
        for low in range(0, len(key), 100_000):
            part = slice(low, low + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(node[part]), pa.array(key[part]), pa.array(holders[part], pa.int64())], names=["s1", "key", "holders"])

    schema = "bucket long, nodes array<long>, counts array<int>, keys array<long>"
    dealt = narrow.mapInArrow(trimmed(emit), schema).repartition("bucket").sortWithinPartitions("bucket")
    shared = dealt.mapInArrow(trimmed(count), "s1 long, key long, holders long").join(members.select("s1", "n", "cluster"), "s1")
    own = Window.partitionBy("s1")
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    # Shingles that no other set holds come before all others.
    placed = shared.withColumn("place", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("holders", "key")))
    rare = cut_lineage(placed.where(F.col("place") <= first).select("cluster", "key", "s1"))
    least = rare.groupBy("cluster", "key").agg(F.min("s1").alias("a"))
    return components(cut_lineage(rare.join(least, ["cluster", "key"]).select("a", F.col("s1").alias("b")).where("a <> b")))


class SignatureTree:
    """Levels of nodes over sets: OR of bitmaps, range of sizes, most colliding tokens."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = np.lexsort(([len(x) for x in sets], [x[0] for x in sets]))
        maps = np.zeros((len(sets), BITS // 64), np.uint64)
        for k, at in enumerate(self.order):
            bit = sets[at] >> np.uint64(64 - 11)
            np.bitwise_or.at(maps[k], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        size = np.array([len(sets[k]) for k in self.order], np.int64)
        excess = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, size, size, excess)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, excess = self.levels[-1]
            heads = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, heads), np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads), np.maximum.reduceat(excess, heads)))


class Links:
    """Verified links between sets, kept as a forest."""

    def __init__(self, sets: list[np.ndarray], percent: int, label: np.ndarray | None = None):
        self.sets, self.percent = sets, percent
        self.parent = np.arange(len(sets))
        self.found: list[tuple[int, int]] = []
        if label is not None:
            _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
            self.parent = first[inverse]

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def test(self, a: int, b: int) -> None:
        """Link two sets unless they are connected already."""
        p, q = self.root(a), self.root(b)
        if p == q:
            return
        x, y = self.sets[a], self.sets[b]
        if len(x) > len(y):
            x, y = y, x
        if 100 * len(x) < self.percent * len(y):
            return
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        both = int((y[at] == x).sum())
        if 100 * both >= self.percent * (len(x) + len(y) - both):
            self.parent[max(p, q)] = min(p, q)
            self.found.append((a, b))

    def join(self, left: SignatureTree, right: SignatureTree, left_rows: np.ndarray, right_rows: np.ndarray) -> None:
        """Dual traversal of two trees (or of one with itself) over rows of `sets`."""
        same = left is right
        top = max(len(left.levels), len(right.levels)) - 1
        stack = [(top, np.zeros((1, 2), np.int64))]
        while stack:
            level, pairs = stack.pop()
            if len(pairs) > 2000:
                stack += [(level, pairs[k : k + 2000]) for k in range(0, len(pairs), 2000)]
                continue
            pairs = pairs[self._may(left, right, level, pairs, left_rows, right_rows)]
            if not level:
                for a, b in pairs:
                    self.test(left_rows[left.order[a]], right_rows[right.order[b]])
                continue
            if len(pairs):
                a = _children(pairs[:, 0], left, level)
                b = _children(pairs[:, 1], right, level)
                down = np.stack([np.repeat(a, b.shape[1], axis=1), np.tile(b, (1, a.shape[1]))], axis=-1).reshape(-1, 2)
                down = down[(down >= 0).all(axis=1)]
                if same:
                    down = down[down[:, 0] <= down[:, 1] - (level == 1)]
                stack.append((level - 1, down))

    def _may(self, left: SignatureTree, right: SignatureTree, level: int, pairs: np.ndarray, left_rows: np.ndarray, right_rows: np.ndarray) -> np.ndarray:
        """Which pairs of nodes may hold a link that is not implied yet."""
        one = left.levels[min(level, len(left.levels) - 1)]
        two = right.levels[min(level, len(right.levels) - 1)]
        i, j = pairs[:, 0], pairs[:, 1]
        shared = np.bitwise_count(one[0][i] & two[0][j]).sum(axis=1, dtype=np.int64) + np.minimum(one[3][i], two[3][j])
        most = np.minimum(shared, np.minimum(one[2][i], two[2][j]))
        may = (100 + self.percent) * most >= self.percent * (one[1][i] + two[1][j])
        may &= (100 * one[2][i] >= self.percent * two[1][j]) & (100 * two[2][j] >= self.percent * one[1][i])
        roots = self.roots()
        (low1, high1), (low2, high2) = (_range(roots[rows[tree.order]], min(level, len(tree.levels) - 1)) for tree, rows in ((left, left_rows), (right, right_rows)))
        return may & ~((low1[i] == high1[i]) & (low2[j] == high2[j]) & (low1[i] == low2[j]))


def _range(roots: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    heads = np.arange(0, len(roots), FAN**level)
    return np.minimum.reduceat(roots, heads), np.maximum.reduceat(roots, heads)


def _children(nodes: np.ndarray, tree: SignatureTree, level: int) -> np.ndarray:
    """Children of nodes, -1 for none; a tree that has no such level stays at its root."""
    if level >= len(tree.levels):
        return nodes[:, None]
    below = nodes[:, None] * FAN + np.arange(FAN)
    return np.where(below < len(tree.levels[level - 1][1]), below, -1)


def link_sets(sets: list[np.ndarray], percent: int, label: np.ndarray | None = None, asked: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (a, b) that connect all linked sets; with `asked`, only links of these rows are sought."""
    links = Links(sets, percent, label)
    rows = np.arange(len(sets))
    if asked is not None:
        mine = np.flatnonzero(asked)
        if len(mine):
            links.join(SignatureTree([sets[k] for k in mine]), SignatureTree(sets), mine, rows)
        return links.found
    if len(sets) > 2:
        # Copies of one text come together at once, so whole subtrees need no test below.
        largest = int(np.argmax([len(x) for x in sets]))
        order = np.lexsort(([len(x) for x in sets], [x[0] for x in sets]))
        for a, b in zip(order[:-1], order[1:]):
            links.test(a, b)
        for a in rows:
            links.test(largest, a)
    if len(sets) > 1:
        tree = SignatureTree(sets)
        links.join(tree, tree, rows, rows)
    return links.found


def _linked(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Verified links (a, b) within each (cluster, task) of rows with texts."""

    def flush(held: list[pd.DataFrame]) -> pd.DataFrame:
        frame = pd.concat(held, ignore_index=True).drop_duplicates(["s1", "s2", "asked", "body"], ignore_index=True)
        sets = shingle_sets([x or b"" for x in frame["body"]], words)
        first, second = digests(sets)
        # A row whose id carries several texts comes with each of them; only the described one counts.
        fit = (first == frame["s1"].to_numpy()) & (second == frame["s2"].to_numpy())
        chosen = frame[fit].drop_duplicates(["s1", "s2", "asked"])
        frame, sets = chosen.reset_index(drop=True), [sets[k] for k in chosen.index]
        asked = frame["asked"].to_numpy(bool)
        node = frame["s1"].to_numpy()
        found = link_sets(sets, percent, frame["label"].to_numpy(), None if not asked.any() else asked)
        return pd.DataFrame({"a": [node[a] for a, _ in found], "b": [node[b] for _, b in found]}, dtype=np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, of = [], None
        for frame in frames:
            for key, part in frame.groupby(["cluster", "task"], sort=False):
                if of is not None and key != of:
                    yield flush(held)
                    held = []
                of = key
                held.append(part)
        if held:
            yield flush(held)

    narrow = rows.select("cluster", "task", "s1", "s2", "asked", "label", F.col("text").cast("binary").alias("body"))
    return narrow.repartition("cluster", "task").sortWithinPartitions("cluster", "task").mapInPandas(trimmed(run), "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """The rows of `described` with component_id, and `first`, the smallest (doc_id, mark) of the component; both null for rows without id or set."""
    rows = described(docs, id_col, text_col, words)
    known = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # Copies are one row from here on.
    sets = cut_lineage(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.min(F.struct("doc_id", "mark")).alias("first")))
    links = _verified(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), sets, words, percent)
    roots = cut_lineage(components(links))

    labelled = cut_lineage(sets.join(roots.withColumnRenamed("node", "s1"), "s1", "left").withColumn("root", F.coalesce("root", "s1")))
    # A set without links is its own component; equal sets have one label by both digests.
    least = labelled.groupBy("root").agg(F.min("first").alias("first"))
    named = labelled.drop("first").join(least, "root").select("s1", "s2", F.col("first.doc_id").alias("component_id"), "first")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    out = rows.join(named, ["s1", "s2"], "left")
    return out.withColumns({c: F.when(~alone, F.col(c)) for c in ("component_id", "first")})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """Connected components of documents whose n-gram sets are at least `percent` similar.

    Returns a row per document: doc_id, n_shingles, component_id (the smallest id in the component).
    """
    out = _grouped(docs, id_col, text_col, words, percent)
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _verified(texts: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    shingles = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    clusters = cut_lineage(clustered(texts, words, percent, shingles))
    # Keys and texts are the large shuffles; each goes before the next is made.
    free_shuffles(texts.sparkSession)
    members = sets.drop("first").join(clusters.select(F.col("node").alias("s1"), F.col("root").alias("cluster")), "s1")
    members = cut_lineage(members)
    crowded = members.groupBy("cluster").agg(F.sum("n").alias("total")).where(F.col("total") > BLOCK_SHINGLES).select("cluster")
    if not crowded.isEmpty():
        # Chance ties of common passages make few large clusters; comparing all their blocks would send each text to every block.
        crowd = cut_lineage(members.join(crowded, "cluster", "left_semi"))
        closer = rare_clusters(texts, crowd, words, percent, shingles).select(F.col("node").alias("s1"), F.col("root").alias("cluster"))
        members = cut_lineage(members.join(crowded, "cluster", "left_anti").unionByName(crowd.drop("cluster").join(closer, "s1")))
        free_shuffles(texts.sparkSession)
    size = members.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("total")).where("sets > 1")
    blocks = F.ceil(F.col("total") / BLOCK_SHINGLES).cast("long")
    placed = members.join(size, "cluster").withColumn("blocks", blocks).withColumn("block", F.pmod("s1", "blocks"))
    # The first block meets every other one.
    tasks = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).when(F.col("block") > 0, F.array("block")).otherwise(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1))
    first = placed.select("cluster", "s1", "s2", "doc_id", F.explode(tasks).alias("task"), F.lit(False).alias("asked"), F.col("s1").alias("label"))
    links = cut_lineage(_linked(fetch_rows(texts, first, "doc_id"), words, percent))

    large = placed.where("blocks > 1").select("cluster", "block", "blocks", "s1", "s2", "doc_id", "n")
    alone = large.isEmpty()
    free_shuffles(texts.sparkSession)
    if alone:
        return links
    # Sets outside the largest component of a large cluster still have to meet all of its blocks.
    roots = components(links).withColumnRenamed("node", "s1")
    large = cut_lineage(large.join(roots, "s1", "left").withColumn("label", F.coalesce("root", "s1")).drop("root"))
    main = large.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    minor = large.join(main, "cluster").where("label <> main").drop("main")
    groups = minor.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("long").alias("groups"))
    minor = minor.join(groups, "cluster").withColumn("group", F.pmod(F.xxhash64("s1"), F.col("groups")))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    asked = minor.select("cluster", "s1", "s2", "doc_id", "label", "group", F.explode(every("blocks")).alias("block"), F.lit(True).alias("asked"))
    held = large.join(groups, "cluster").select("cluster", "s1", "s2", "doc_id", "label", F.explode(every("groups")).alias("group"), "block", F.lit(False).alias("asked"))
    second = asked.unionByName(held).withColumn("task", F.xxhash64("group", "block"))
    return links.union(cut_lineage(_linked(fetch_rows(texts, second, "doc_id"), words, percent)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component with all its columns: that of the smallest id, and of its texts the one of the smallest hash.

    An id may carry several texts: each is judged by itself. Rows without id or words stay, and so do rows that repeat id and text of a row that stays.
    """
    out = _grouped(docs, id_col, text_col, words, percent)
    own, mark = free_name(docs, "_own"), free_name(docs, "_mark")
    away = out.where(F.struct("doc_id", "mark") != F.col("first")).select(F.col("doc_id").alias(own), F.col("mark").alias(mark)).distinct()
    marked = docs.withColumns({own: F.col(id_col), mark: F.xxhash64(F.col(text_col))})
    return marked.join(away, [own, mark], "left_anti").select(*docs.columns)
