"""Exact centroid clustering of integer vectors; an annulus of norms picks the centroids that are compared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import eased, pack, table, unpack

SIZE, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Vectors whose integers stay below this have squared distances that a double holds exactly; beyond it they are summed as integers of any length.
EXACT = 1 << 22
#: Pairs of a vector and a centroid that are compared in one step.
STEP = 1 << 17
LARGEST = (1 << 63) - 1
#: Integers are held within these, so that sums over 10^11 vectors have at most 38 digits; squared distances of such vectors fit 64 bits no more.
LARGEST_PART = 1 << 40


class Annulus:
    """Centroids sorted by norm. The nearest one of a vector lies within the ring of norms that is as wide as any centroid's distance."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = np.array(centroids, object).reshape(len(centroids), len(centroids[0]) if centroids else 0)
        self.narrow = all(abs(x) < EXACT for c in centroids for x in c)
        self.rows = self.exact.astype(np.float64)
        norm = np.sqrt((self.rows**2).sum(axis=1))
        self.order = np.argsort(norm, kind="stable")
        self.norm = norm[self.order]

    def _squared(self, v: np.ndarray, at: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Exact squared distances of v[at] from centroids c; doubles, or integers of any length."""
        if v.dtype == np.float64:
            d = v[at] - self.rows[c]
            return np.einsum("ij,ij->i", d, d)
        return ((v[at] - self.exact[c]) ** 2).sum(axis=1)

    def assign(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of every row of q and its squared distance, ties to the smaller number.

        A few centroids, each row's nearest by norm among them, bound its distance; those whose
        norms differ by no more, found by binary search, are compared exactly. The ring is a
        little wider than the bound, so that a tie on its edge is inside."""
        n, k = len(q), len(self.order)
        v = q.astype(np.float64) if self.narrow and (not n or np.abs(q).max() < EXACT) else q.astype(object)
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        every, place = np.arange(n), np.clip(np.searchsorted(self.norm, norm), 0, k - 1)
        bound = self._squared(v, every, self.order[place]).astype(np.float64)
        for c in self.order[:: max(1, int(np.sqrt(k)))].tolist():
            bound = np.minimum(bound, self._squared(v, every, np.full(n, c)).astype(np.float64))
        width = np.sqrt(bound) * (1 + 1e-9) + (norm + self.norm[-1]) * 1e-9 + 1e-9
        low, high = np.searchsorted(self.norm, norm - width, "left"), np.searchsorted(self.norm, norm + width, "right")
        cluster, distance = np.zeros(n, np.int64), np.zeros(n, object if v.dtype == object else np.float64)
        upto, at = np.cumsum(high - low), 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, "right")))
            count = (high - low)[at:end]
            first = np.cumsum(count) - count
            row = np.repeat(np.arange(at, end), count)
            c = self.order[np.arange(len(row)) - np.repeat(first, count) + low[row]]
            d = self._squared(v, row, c)
            least = np.minimum.reduceat(d, first)
            ties = np.where(d == np.repeat(least, count), c, k)
            cluster[at:end], distance[at:end] = np.minimum.reduceat(ties, first), least
            at = end
        return cluster, distance


def _integers(batch: pa.RecordBatch, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold `size` finite numbers, and floor(scale * x) of those."""
    column = batch.column("embedding")
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    offsets = column.offsets.to_numpy(zero_copy_only=False)
    have = np.flatnonzero((np.diff(offsets) == size) & column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    x = flat[(offsets[have][:, None] + np.arange(size)).ravel()].reshape(-1, size)
    whole = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        return have[whole], np.clip(np.floor(x[whole] * scale), -LARGEST_PART, LARGEST_PART).astype(np.int64)


def _packed(batch: pa.RecordBatch, size: int, scale: int) -> bytes:
    rows, q = _integers(batch, size, scale)
    ids = batch.column("vec_id").take(pa.array(rows))
    most = np.abs(q).max() if len(q) else 0
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    return pack(ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), q.astype(kind).ravel())


def _unpacked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whether ids are known, the ids, the vectors."""
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            known, ids, body = unpack(blob)
            if len(ids):
                yield known.astype(bool), ids, body.reshape(-1, size).astype(np.int64)


def _held(value: int) -> int:
    return int(min(value, LARGEST))


def cluster_vectors(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = "3") -> DataFrame:
    """`vectors` (vec_id, embedding, ...) to a row for each kept one: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of `size` components, none null or not finite; each component becomes
    floor(scale * x). The first centroids are the kept vectors with the smallest hashes of
    `seed:vec_id` (ties: the smaller vector). A round assigns every vector to its nearest
    centroid (ties: the smaller number) and moves each centroid that has any to the floors of
    their means; empty ones stay. All of it is exact: a round stops early only where no
    centroid moved, as no later one would move any. Components of 2^30 and more are held to what
    LARGEST_PART allows, numbers beyond 64 bits stand as 2^63 - 1.

    Rows of one id are vectors of their own; a row without id sorts behind all others where
    first centroids are chosen; fewer vectors than centroids make fewer centroids; an empty table, or one
    without kept vectors, gives no row. Other columns are left behind, whatever their names.

    The vectors are packed once into the shared folder; what leaves a task in a round are
    sums, one row for each centroid, which are added by centroid and component. Only the
    centroids go through the driver."""
    spark = vectors.sparkSession
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_packed(batch, size, scale)], pa.binary())], names=["blob"])

    packed = table(source.mapInArrow(eased(packs), "blob binary")).df

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best first centroids of a task."""
        best: list[tuple[str, list[int]]] = []
        for known, ids, q in _unpacked(batches, size):
            last = best[-1][0] if len(best) == centroids else "g"
            # "g" sorts behind all hexadecimal digits
            hashes = [(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if k else "g", at) for at, (i, k) in enumerate(zip(ids.tolist(), known.tolist(), strict=True))]
            best = sorted(best + [(h, q[at].tolist()) for h, at in hashes if h <= last])[:centroids]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best], pa.string()), pa.array([c for _, c in best], pa.list_(pa.int64()))], names=["hash", "centroid"])

    now = [list(r["centroid"]) for r in packed.mapInArrow(firsts, "hash string, centroid array<long>").orderBy("hash", "centroid").limit(centroids).collect()]

    def sums(centres: list[list[int]]) -> dict[int, list[int]]:
        """By centroid that has any vectors: the components' sums, how many, their distances' sum."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ring = Annulus(centres)
            total = [[0] * (size + 2) for _ in centres]
            for _, _, q in _unpacked(batches, size):
                cluster, distance = ring.assign(q)
                for c in np.unique(cluster).tolist():
                    own = cluster == c
                    more = [*q[own].sum(axis=0).tolist(), int(own.sum()), sum(map(int, distance[own].tolist()))]
                    total[c] = [a + b for a, b in zip(total[c], more, strict=True)]
            rows = [(c, at, str(x)) for c, t in enumerate(total) if t[size] for at, x in enumerate(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string()))], names=["cluster", "at", "x"])

        out: dict[int, list[int]] = {}
        added = packed.mapInArrow(eased(run), "cluster int, at int, x string").groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        for r in added.collect():  # a number for each centroid and component
            out.setdefault(r["cluster"], [0] * (size + 2))[r["at"]] = int(r["x"])
        return out

    for _ in range(rounds if now else 0):
        got = sums(now)
        then = [[x // got[c][size] for x in got[c][:size]] if c in got else old for c, old in enumerate(now)]
        if then == now:
            break
        now = then
    got = sums(now) if now else {}
    inertia = _held(sum(x[size + 1] for x in got.values()))
    own = [_held(got[c][size + 1]) if c in got else 0 for c in range(len(now))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = Annulus(now)
        for known, ids, q in _unpacked(batches, size):
            cluster, distance = ring.assign(q)
            d = [_held(x) for x in distance.tolist()] if distance.dtype == object else distance.astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64(), mask=~known), pa.array(cluster, pa.int32()), pa.array(d, pa.int64()), pa.array(np.array(own, np.int64)[cluster]),
                pa.array(np.full(len(ids), inertia, np.int64)), pa.array(digest, pa.string()).take(pa.array(cluster)),
            ], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return packed.mapInArrow(eased(last), "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
