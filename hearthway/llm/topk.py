"""Exact top-k search by inner product with dual trees.

Candidates and queries are both put into cells around a bounded sample of pivots, and each block of a cell
into a cover tree: a node is a centre with the radius that covers its vectors, children cover it with
smaller radii. For a query node (centre q, radius s) and a candidate node (centre x, radius r) no inner product
exceeds `<q,x> + s|x| + r|q| + sr`; a pair of nodes is dropped when that is below the worst kth
score of the query node's queries. Queries first meet the blocks of their own cell, and then only the
cells that their worst kth score cannot rule out.

Components x become floor(256 * x), of any size, and scores are exact; a score beyond 64 bits counts as the nearest
64-bit integer, and components beyond the largest double as that. Vectors that are null, empty, or hold null
or non-finite components take no part, as queries or candidates; neither do rows with a null id. Only
vectors of equal length are compared. Repeated rows are candidates each; a query leaves out only its own row.
Ties go to the smaller id. Fewer candidates than k give fewer rows, an empty table none. Other
columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthway.session import cut_lineage

SCALE = 256
#: Vectors of the sample that cells are formed around; the index is fitted on these alone.
PIVOTS = 64
#: Vectors per candidate block and queries per group, about.
BLOCK, GROUP = 4096, 1024
#: Nodes of no more vectors are leaves; so are nodes that fall apart into nearly as many children.
LEAF = 16
#: Bound of what rounding adds to a distance, as a part of the vectors' lengths.
ROUNDING = 1e-6
#: Stands for no score, and the range of scores.
NONE, LOWEST, HIGHEST = -(1 << 63), 1 - (1 << 63), (1 << 63) - 1


def components(blob: bytes, dim: int) -> np.ndarray:
    """The components of a vector, stored in 32 bits where these hold all of them and as doubles where not."""
    return np.frombuffer(blob, np.int32 if len(blob) == 4 * dim else np.float64)


class CoverTree:
    """Nodes as arrays: centre, covering radius, range of rows, children; rows are put in the order of the leaves."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.arange(len(vectors))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.below: list[list[int]] = []
        self._build(vectors)

    def _build(self, vectors: np.ndarray) -> None:
        square = (vectors**2).sum(axis=1)

        def away(rows: np.ndarray, centre: int) -> np.ndarray:
            return np.sqrt(np.maximum(square[rows] + square[centre] - 2 * (vectors[rows] @ vectors[centre]), 0))

        def node(begin: int, end: int, centre: int, far: np.ndarray) -> int:
            self.centre.append(centre)
            self.radius.append(float(far.max()) * (1 + 1e-9) + 1e-3 if len(far) else 0.0)
            self.span.append((begin, end))
            self.below.append([])
            return len(self.centre) - 1

        first = int(self.order[0])
        stack = [node(0, len(vectors), first, away(self.order, first))]
        while stack:
            at = stack.pop()
            begin, end = self.span[at]
            rows = self.order[begin:end]
            # A radius beyond doubles says nothing.
            if end - begin <= LEAF or not 1e-2 < self.radius[at] < np.inf:
                continue
            reach = self.radius[at] / 2
            nearest = away(rows, self.centre[at])
            owner, centres = np.zeros(len(rows), np.int64), [self.centre[at]]
            while len(centres) <= len(rows) // 4:
                loose = int(nearest.argmax())
                if nearest[loose] <= reach:
                    break
                distance = away(rows, int(rows[loose]))
                closer = distance < nearest
                owner[closer], nearest = len(centres), np.minimum(nearest, distance)
                centres.append(int(rows[loose]))
            else:
                continue
            turn = np.argsort(owner, kind="stable")
            self.order[begin:end] = rows[turn]
            sizes = np.bincount(owner, minlength=len(centres))
            low = begin
            for centre, size, far in zip(centres, sizes, np.split(nearest[turn], np.cumsum(sizes)[:-1])):
                if size:
                    child = node(low, low + size, centre, far)
                    self.below[at].append(child)
                    stack.append(child)
                    low += size


def packed(frame: pd.DataFrame) -> bytes:
    """A block as bytes: its tree, and rows in the tree's order."""
    vectors = np.stack([components(x, dim) for x, dim in zip(frame["vec"], frame["dim"])])
    tree = CoverTree(vectors.astype(float))
    centres = vectors[tree.centre]
    # Rounding of the distances grows with the vectors.
    slack = ROUNDING * float(np.sqrt((vectors.astype(float) ** 2).sum(axis=1).max()))
    return pickle.dumps({
        "row": frame["row"].to_numpy()[tree.order], "id": frame["vec_id"].to_numpy()[tree.order], "vec": vectors[tree.order],
        "centre": centres, "radius": np.asarray(tree.radius) + slack, "span": np.asarray(tree.span), "below": tree.below,
    })


class Best:
    """The k best (score, smaller id first) of each query, kept in order."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.score = np.full((queries, k), NONE, np.int64)
        self.id = np.full((queries, k), 2**62, np.int64)
        self.floor = floor

    def kth(self, low: int, high: int) -> int:
        return int(np.maximum(self.score[low:high, -1], self.floor[low:high]).min())

    def offer(self, low: int, high: int, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        scores = np.concatenate([self.score[low:high], scores], axis=1)
        ids = np.concatenate([self.id[low:high], np.broadcast_to(ids, (high - low, len(ids)))], axis=1)
        if scores.shape[1] > 4 * k:
            # The kth largest score bounds what can stay; equal scores stay for the order of ids.
            bound = np.partition(scores, -k, axis=1)[:, -k]
            width = int((scores >= bound[:, None]).sum(axis=1).max())
            some = np.argsort(~scores, axis=1, kind="stable")[:, :width]
            scores, ids = np.take_along_axis(scores, some, 1), np.take_along_axis(ids, some, 1)
        order = np.lexsort((ids, ~scores), axis=1)[:, :k]
        self.score[low:high] = np.take_along_axis(scores, order, 1)
        self.id[low:high] = np.take_along_axis(ids, order, 1)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows of both, exactly: in doubles or 64-bit integers if these hold every sum."""
    most = left.shape[1] * int(max(np.abs(left.astype(float)).max(), 1)) * int(max(np.abs(right.astype(float)).max(), 1))
    if most < 1 << 52:
        return (left.astype(float) @ right.astype(float).T).astype(np.int64)
    if most < 1 << 62:
        return left.astype(np.int64) @ right.astype(np.int64).T
    wide = [np.array([[int(x) for x in row] for row in some.tolist()], object) for some in (left, right)]
    return np.clip(wide[0] @ wide[1].T, LOWEST, HIGHEST).astype(np.int64)


def dual_search(queries: dict, block: dict, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, candidate id, score) of the k best in one block per query, none below its floor."""
    best = Best(len(queries["id"]), k, floor)
    q_centre, x_centre = queries["centre"].astype(float), block["centre"].astype(float)
    q_norm, x_norm = np.linalg.norm(q_centre, axis=1), np.linalg.norm(x_centre, axis=1)
    q_vec, x_vec = queries["vec"], block["vec"]
    if q_vec.dtype == x_vec.dtype == np.int32 and len(q_vec[0]) * int(np.abs(q_vec.astype(float)).max()) * int(np.abs(x_vec.astype(float)).max()) < 1 << 52:
        # Doubles hold all products of these blocks.
        q_vec, x_vec = q_vec.astype(float), x_vec.astype(float)
        multiplied = lambda a, b: (a @ b.T).astype(np.int64)
    else:
        multiplied = products

    def bound(a: int, others: list[int]) -> np.ndarray:
        r, s = block["radius"][others], queries["radius"][a]
        far = s * x_norm[others] + r * q_norm[a] + r * s
        return x_centre[others] @ q_centre[a] + far + 1e-9 * (far + x_norm[others] * q_norm[a]) + 1e-3

    stack = [(0, 0, np.inf)]
    while stack:
        a, b, top = stack.pop()
        low, high = queries["span"][a]
        if top < best.kth(low, high):
            continue
        q_below, x_below = queries["below"][a], block["below"][b]
        if not q_below and not x_below:
            begin, end = block["span"][b]
            scores = multiplied(q_vec[low:high], x_vec[begin:end])
            own = queries["row"][low:high, None] == block["row"][None, begin:end]
            scores[own] = NONE
            best.offer(low, high, scores, block["id"][begin:end])
            continue
        pairs = []
        for one in q_below or [a]:
            others = x_below or [b]
            pairs += [(one, other, float(t)) for other, t in zip(others, bound(one, others))]
        # The most promising pair comes off the stack first.
        stack += sorted(pairs, key=lambda x: x[2])
    at, place = np.nonzero((best.score > NONE) & (best.score >= best.floor[:, None]))
    return at, best.id[at, place], best.score[at, place]


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows that take part: row, vec_id, dim, vec (see `components`)."""
    # The vector's elements stay nullable for Arrow.
    narrow = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))

    most = np.finfo(np.float64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, vecs = [], [], []
            for one, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = x.values
                if len(values) and not values.null_count:
                    value = values.to_numpy(zero_copy_only=False)
                    if np.isfinite(value).all():
                        ids.append(one)
                        with np.errstate(over="ignore"):
                            floors = np.clip(np.floor(SCALE * value), -most, most)
                        narrow = -(2**31) <= floors.min() and floors.max() < 2**31
                        dims.append(len(floors))
                        vecs.append(floors.astype(np.int32 if narrow else np.float64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int64()), pa.array(vecs, pa.binary())], names=["vec_id", "dim", "vec"])

    return cut_lineage(narrow.mapInArrow(run, "vec_id long, dim long, vec binary").withColumn("row", F.monotonically_increasing_id()))


def in_cells(rows: DataFrame, pivots: list[np.ndarray]) -> DataFrame:
    """Add the cell (its nearest pivot of equal length, or a cell per length without pivots) and the distance to the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell, far = -dims, np.zeros(len(dims))
            blobs = batch.column("vec").to_pylist()
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                x = np.stack([components(blobs[k], dim) for k in mine]).astype(float)
                near = [k for k, p in enumerate(pivots) if len(p) == dim]
                if near:
                    p = np.stack([pivots[k] for k in near])
                    square = np.maximum((x**2).sum(1)[:, None] + (p**2).sum(1) - 2 * x @ p.T, 0)
                    best = square.argmin(1)
                    cell[mine] = np.asarray(near)[best]
                    far[mine] = np.sqrt(square.min(1)) + ROUNDING * (np.linalg.norm(x, axis=1) + np.linalg.norm(p[best], axis=1))
                else:
                    far[mine] = np.linalg.norm(x, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return cut_lineage(rows.mapInArrow(run, "vec_id long, dim long, vec binary, row long, cell long, far double"))


def blocks_of(rows: DataFrame, size: int) -> DataFrame:
    """One packed row per block; the rows of a cell are dealt over blocks of about `size` rows by hash."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": frame["cell"].iloc[:1], "block": frame["block"].iloc[:1], "body": [packed(frame)]})

    counts = rows.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("long").alias("blocks"))
    dealt = rows.join(F.broadcast(counts), "cell").withColumn("block", F.pmod(F.xxhash64("row"), "blocks"))
    return cut_lineage(dealt.select("cell", "block", "row", "vec_id", "dim", "vec").groupBy("cell", "block").applyInPandas(pack, "cell long, block long, body binary"))


def _found(pairs: DataFrame, k: int) -> DataFrame:
    """Search each pair of a query group (q_body, floors by row) and a candidate block (body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, x, rows, floors in zip(*(batch.column(n).to_pylist() for n in ("q_body", "body", "rows", "floors"))):
                queries, block = pickle.loads(q), pickle.loads(x)
                known = dict(zip(rows or [], floors or []))
                floor = np.asarray([known.get(r, NONE) for r in queries["row"].tolist()], np.int64)
                at, ids, scores = dual_search(queries, block, k, floor)
                yield pa.RecordBatch.from_arrays([pa.array(queries["row"][at]), pa.array(queries["id"][at]), pa.array(ids), pa.array(scores)], names=["row", "query_id", "vec_id", "score"])

    return pairs.select("q_body", "body", "rows", "floors").mapInArrow(run, "row long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best candidates of every row of `vectors` where `queries` holds for its vec_id.

    Returns query_id, rank (from 1), vec_id, score.
    """
    rows = quantised(vectors, id_col, vector_col)
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(PIVOTS).select("vec", "dim").collect()
    pivots = [components(x["vec"], x["dim"]).astype(float) for x in sample]
    placed = in_cells(rows, pivots)
    blocks = blocks_of(placed, BLOCK)
    groups = blocks_of(placed.where(queries), GROUP).select("cell", F.col("block").alias("group"), F.col("body").alias("q_body"))
    none = (F.lit(None).cast("array<long>").alias("rows"), F.lit(None).cast("array<long>").alias("floors"))
    best = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")

    def top(found: DataFrame) -> DataFrame:
        # Ranks above k are dropped before and after the shuffle.
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    home = cut_lineage(top(_found(groups.join(blocks, "cell").select("q_body", "body", *none), k)))

    kth = home.groupBy("row").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    sizes = placed.where(queries).groupBy("cell").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("blocks"))
    asked = placed.where(queries).join(F.broadcast(sizes), "cell").withColumn("group", F.pmod(F.xxhash64("row"), "blocks"))
    floors = asked.join(kth, "row", "left").select("cell", "group", "row", F.coalesce("floor", F.lit(NONE)).alias("floor"))
    floors = floors.groupBy("cell", "group").agg(F.collect_list("row").alias("rows"), F.collect_list("floor").alias("floors"), F.min("floor").alias("worst"))
    # At most PIVOTS cells, and one for each further length.
    cells = [(x["cell"], x["far"]) for x in placed.groupBy("cell").agg(F.max("far").alias("far")).collect()]

    def open_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell, group, worst, body in zip(*(batch.column(n).to_pylist() for n in ("cell", "group", "worst", "q_body"))):
                queries = pickle.loads(body)
                q, s = queries["centre"][0].astype(float), float(queries["radius"][0])
                for other, far in cells:
                    x = pivots[other] if other >= 0 else np.zeros(-other)
                    if other != cell and len(x) == len(q):
                        far = far * (1 + 1e-9) + 1e-3
                        size, own = np.linalg.norm(x), np.linalg.norm(q)
                        slack = s * size + far * own + s * far
                        # Bounds that are beyond doubles drop nothing.
                        if not q @ x + slack + 1e-9 * (slack + size * own) + 1e-3 < worst:
                            out.append((cell, group, other))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["q_cell", "q_group", "cell"])

    full = groups.join(floors, ["cell", "group"])
    opened = full.select("cell", "group", "worst", "q_body").mapInArrow(open_cells, "q_cell long, q_group long, cell long")
    opened = cut_lineage(opened.join(blocks.select("cell", "block"), "cell"))
    pairs = opened.join(full.select(F.col("cell").alias("q_cell"), F.col("group").alias("q_group"), "q_body", "rows", "floors"), ["q_cell", "q_group"]).join(blocks, ["cell", "block"])
    away = _found(pairs, k)
    return top(home.select("row", "query_id", "vec_id", "score").union(away)).select("query_id", "rank", "vec_id", "score")
