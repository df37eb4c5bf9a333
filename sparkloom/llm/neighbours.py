"""Approximate nearest neighbours: stable random projections, kd-trees, chi-square stopping.

Vectors are projected to a few dimensions by a Gaussian matrix. The squared projected
distance over the squared true distance follows a chi-square law with that many degrees of
freedom, whatever the data. Candidates are verified in the order of their projected distance
until the law says that a vector nearer than the k-th best would, with the wanted
probability, have come up already.

Layout: the top of the kd-tree is fitted on a bounded sample and cuts the projected space
into cells; every vector is indexed in its cell, where a kd-tree of its own is built. A query
first searches its home cell; the k-th distance found there and the stopping test say which
other cells can still matter, and only those get the query. Vectors that are equal in every
component are indexed by their k + 1 smallest ids, since ties go to smaller ids and no query
returns more of them. Equal queries are searched once, for k + 1 neighbours, of which each
then leaves itself out; so copies, however many, are neither a full cell nor a queue before
one. A cell that still holds or is asked more than a block goes through in blocks.

Defined results: vectors that are null, of another length than the most frequent one, zero,
or that hold null or non-finite components take no part, neither as query nor as candidate;
null ids neither. Rows that share an id count as one, with the smallest of their vectors.
Fewer candidates than k are all returned. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import ease, eased, written

PROJECTED = 8
RECALL = 0.98
CELL_ROWS = 8192
#: Vectors of a cell, and queries put to it, that meet in one task.
BLOCK_ROWS, BLOCK_ASKED = 32_768, 32_768
SAMPLE = 4096
LEAF = 32


def chi_square_cdf(x: float, m: int) -> float:
    """For an even number m of degrees of freedom."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, m) < p else (low, mid)
    return high


@dataclass
class Cells:
    """The top of the tree: inner nodes cut one projected dimension; leaves are the cells' boxes."""

    matrix: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, m: int, seed: int = 7) -> Cells:
        dim = sample.shape[1]
        matrix = np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, m))
        p = sample @ matrix
        boxes = [(p, np.full(m, -np.inf), np.full(m, np.inf), cells)]
        done = []
        while boxes:
            points, low, high, want = boxes.pop()
            spread = np.ptp(points, axis=0) if len(points) > 1 else np.zeros(m)
            d = int(spread.argmax())
            if want < 2 or spread[d] <= 0:
                done.append((low, high))
                continue
            at = np.quantile(points[:, d], (want // 2) / want)
            left = points[:, d] < at
            if not left.any():
                at = points[points[:, d] > at, d].min()
                left = points[:, d] < at
            l2, h2 = low.copy(), high.copy()
            h2[d], l2[d] = at, at
            boxes += [(points[left], low, h2, want // 2), (points[~left], l2, high, want - want // 2)]
        return cls(matrix, np.array([x[0] for x in done]), np.array([x[1] for x in done]))

    def home(self, projected: np.ndarray) -> np.ndarray:
        out = np.zeros(len(projected), np.int32)
        for c in range(len(self.low)):
            out[((projected >= self.low[c]) & (projected < self.high[c])).all(1)] = c
        return out

    def distance(self, projected: np.ndarray) -> np.ndarray:
        """Squared projected distance of one point to every cell's box."""
        gap = np.maximum(np.maximum(self.low - projected, projected - self.high), 0)
        return (gap**2).sum(1)


class Tree:
    """A kd-tree over projected points; leaves of up to LEAF rows, boxes are those of the points in them."""

    def __init__(self, projected: np.ndarray):
        self.p = projected
        self.order = np.arange(len(projected))
        self.nodes: list[tuple] = []  # (low, high, begin, end, left, right)
        if len(projected):
            self._build(0, len(projected))

    def _build(self, begin: int, end: int) -> int:
        own = self.p[self.order[begin:end]]
        low, high = own.min(0), own.max(0)
        k = len(self.nodes)
        self.nodes.append(())
        left = right = -1
        if end - begin > LEAF and (high > low).any():
            d = int((high - low).argmax())
            mid = (end - begin) // 2
            part = np.argpartition(own[:, d], mid)
            self.order[begin:end] = self.order[begin:end][part]
            left = self._build(begin, begin + mid)
            right = self._build(begin + mid, end)
        self.nodes[k] = (low, high, begin, end, left, right)
        return k

    def leaves(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """Squared lower bounds and row numbers of leaves, nearest first."""
        if not self.nodes:
            return
        heap = [(0.0, 0)]
        while heap:
            bound, k = heapq.heappop(heap)
            _, _, begin, end, left, right = self.nodes[k]
            if left < 0:
                yield bound, self.order[begin:end]
                continue
            for child in (left, right):
                low, high = self.nodes[child][:2]
                gap = np.maximum(np.maximum(low - q, q - high), 0)
                heapq.heappush(heap, (float(gap @ gap), child))


def search(tree: Tree, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, projected: np.ndarray, k: int, stop: float, bound: float) -> list[tuple[float, int]]:
    """The k best found: (distance, id). `bound`: a k-th distance known from elsewhere; `stop`: the chi-square quantile."""
    best: list[tuple[float, int]] = []
    worst = bound
    for near, rows in tree.leaves(projected):
        if near > worst * worst * stop:
            break
        d = np.sqrt(np.cumsum((vectors[rows] - query) ** 2, axis=1)[:, -1])  # summed from left to right, as SQL does
        close = d <= worst
        if close.any():
            best = sorted([*best, *zip(d[close].tolist(), ids[rows][close].tolist(), strict=True)])[:k]
            if len(best) == k:
                worst = min(worst, best[-1][0])
    return best


def _matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


_FOUND_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, recall: float = RECALL, m: int = PROJECTED) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row where `is_query` holds, itself excepted."""
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    fine = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q"))
    fine = fine.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    sizes = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], empty)
    dim, rows = sizes["d"], sizes["count"]
    fine = fine.where(F.size("v") == dim).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    fine = written(fine.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("q").alias("q")))
    # lossless: of equal vectors no query returns more than k, and those with the smallest ids
    w = Window.partitionBy("v").orderBy("vec_id")
    indexed = fine.select("vec_id", "v").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r")
    # a bounded sample, of different vectors, in hash order
    sample = fine.select("v").distinct().orderBy(F.xxhash64("v")).limit(SAMPLE).collect()
    cells = Cells.fit(np.array([r["v"] for r in sample]), max(1, -(-rows // CELL_ROWS)), m)
    stop = chi_square_quantile(recall, m)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home = cells.home(_matrix(b.column("v"), dim) @ cells.matrix)
            yield pa.RecordBatch.from_arrays([pa.array(home), *(b.column(c) for c in ("vec_id", "v"))], names=["cell", "vec_id", "v"])

    index = written(indexed.select("vec_id", "v").mapInArrow(eased(place), "cell int, vec_id long, v array<double>"))
    held = index.groupBy("cell").agg(F.count(F.lit(1)).alias("held"))
    # one of the equal queries asks for all of them
    asking = fine.where("q").groupBy("v").agg(F.min("vec_id").alias("vec_id"))
    first = written(asking.select("vec_id", "v").mapInArrow(eased(place), "cell int, vec_id long, v array<double>"))

    def look(key: tuple, own: pa.Table, asked: pa.Table) -> pa.Table:
        ease()
        if not own.num_rows or not asked.num_rows:
            return _FOUND_SCHEMA.empty_table()
        v, ids = _matrix(own.column("v"), dim), own.column("vec_id").to_numpy()
        tree = Tree(v @ cells.matrix)
        qv, qid, bound = _matrix(asked.column("v"), dim), asked.column("vec_id").to_numpy(), asked.column("bound").to_numpy()
        qp = qv @ cells.matrix
        rows = [(int(qid[i]), j, d) for i in range(len(qid)) for d, j in search(tree, v, ids, qv[i], qp[i], k + 1, stop, float(bound[i]))]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 3, _FOUND_SCHEMA, strict=True)], schema=_FOUND_SCHEMA)

    def ask(requests: DataFrame) -> DataFrame:
        asked = requests.groupBy("cell").agg(F.count(F.lit(1)).alias("asked"))
        blocks = held.join(asked, "cell").select("cell", F.ceil(F.col("held") / BLOCK_ROWS).alias("parts"), F.ceil(F.col("asked") / BLOCK_ASKED).alias("turns"))
        blocks = F.broadcast(blocks)  # a row a cell, SAMPLE at most
        part, turn = (F.pmod(F.xxhash64("vec_id"), F.col(n)) for n in ("parts", "turns"))
        every = {n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)) for n in ("parts", "turns")}
        key = ["cell", "part", "turn"]
        own = index.join(blocks, "cell").withColumn("part", part).withColumn("turn", every["turns"]).select(*key, "vec_id", "v")
        put = requests.join(blocks, "cell").withColumn("turn", turn).withColumn("part", every["parts"]).select(*key, "vec_id", "v", "bound")
        return own.groupBy(*key).cogroup(put.groupBy(*key)).applyInArrow(look, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r")

    found = written(best(ask(first.withColumn("bound", F.lit(float("inf"))))))
    bounds = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) > k, F.max("score")).otherwise(F.lit(float("inf"))).alias("bound"))
    again = first.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _matrix(b.column("v"), dim) @ cells.matrix
            home, bound = b.column("cell").to_numpy(), b.column("bound").to_numpy()
            at, cell = [], []
            for i in range(len(p)):
                near = np.flatnonzero(cells.distance(p[i]) <= bound[i] * bound[i] * stop)
                near = near[near != home[i]]
                at += [i] * len(near)
                cell += near.tolist()
            t = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), t.column("vec_id"), t.column("v"), t.column("bound")], names=["cell", "vec_id", "v", "bound"])

    more = written(again.select("cell", "vec_id", "v", "bound").mapInArrow(eased(spread), "cell int, vec_id long, v array<double>, bound double"))
    near = best(found.unionAll(ask(more))).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("score", F.col("vec_id").alias("id")))).alias("near"))  # k + 1 at most
    lists = first.select("vec_id", "v").join(near, F.col("vec_id") == F.col("query_id")).select("v", "near")
    every = fine.where("q").select(F.col("vec_id").alias("query_id"), "v").join(lists, "v")
    others = every.select("query_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k).alias("near"))
    ranked = others.select("query_id", F.posexplode("near").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
