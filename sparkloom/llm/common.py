"""What the operators share: scratch tables, Arrow text buffers, packed columns, components."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- scratch tables


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one of our own only where it is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get()
    return root.rstrip("/")


_SETTING = threading.Lock()
#: Parquet looks at its buffers after a hundred rows unless told otherwise; rows of packed
#: columns may hold a megabyte each.
_PAGES = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}
#: The scratch scopes of this thread of work, the innermost last; another thread has its own.
_SCOPES: ContextVar[tuple[list[Written], ...]] = ContextVar("scopes", default=())


class Written:
    """A table in the shared folder. It cuts lineage and survives lost executors; drop() frees
    it, or what of it has a value of the column `by`; JVM exit does otherwise."""

    def __init__(self, df: DataFrame, by: str | None = None):
        self.spark = df.sparkSession
        self.path = f"{scratch_root(self.spark)}/sparkloom-{uuid.uuid4().hex}"
        # shuffle files are of no use once the table stands
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        with _SETTING:
            kept = self.spark.conf.get(key, "false")
            self.spark.conf.set(key, "true")
            try:
                df.write.options(**_PAGES).partitionBy(*([by] if by else [])).parquet(self.path)
            finally:
                self.spark.conf.set(key, kept)
        jvm = self.spark._jvm
        self._where = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._where)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self, part: str | None = None) -> None:
        where = self._where if part is None else self.spark._jvm.org.apache.hadoop.fs.Path(self._where, part)
        self._fs.delete(where, True)


def table(df: DataFrame, by: str | None = None) -> Written:
    """A table that the current scratch scope drops, JVM exit where there is none."""
    t = Written(df, by)
    if scopes := _SCOPES.get():
        scopes[-1].append(t)
    return t


def written(df: DataFrame) -> DataFrame:
    return table(df).df


@contextmanager
def scratch() -> Iterator[None]:
    """Drops the tables that are `written` inside; what is to stay is to be a Written of its own."""
    made: list[Written] = []
    before = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield
    finally:
        _SCOPES.reset(before)
        for t in made:
            t.drop()


def text_volume(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column: two numbers, from which shard counts follow."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def shard_count(total: float, each: float, least: int = 12) -> int:
    """Shards so that each holds about `each` of `total`; grows with the input without a cap."""
    return max(least, int(-(-total // each)))


def dealt(df: DataFrame, key: str, size: float, each: float) -> DataFrame:
    """Shuffled by `key` into as many tasks as hold `each` of `size`, where those are more than the session's own number."""
    tasks = int(-(-size // each))
    return df.repartition(tasks, key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


# ---------------------------------------------------------------- Arrow text


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in one array and the offsets between them; null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


_LIBRARY = ctypes.CDLL(None)
_EASED = [0.0]


def ease(every: float = 1.0) -> None:
    """Gives memory that a Python worker has freed back to the system, once in `every` seconds at
    most. Workers wait for their next task with what their allocator holds, several of them
    beside one JVM."""
    if time.monotonic() - _EASED[0] >= every:
        pa.default_memory_pool().release_unused()
        if hasattr(_LIBRARY, "malloc_trim"):
            _LIBRARY.malloc_trim(0)
        _EASED[0] = time.monotonic()


def eased(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that leaves no freed memory behind it."""

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        ease(0)

    return then


_KEPT: dict = {}


def kept(key: object, make: Callable[[], object]):
    """What `make` gives, held by the Python worker for its next tasks. A worker holds one such
    thing: another key frees the last, so stages in a row do not add up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def slices(batch: pa.RecordBatch, most: int = 16 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` text bytes each; one long text is a run of its own."""
    _, off = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(off, off[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


#: ASCII white space; and all ASCII but letters and digits.
WHITE = np.array([b in (32, *range(9, 14)) for b in range(256)])
NO_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_rng = np.random.Generator(np.random.PCG64(20240607))
_VALUE = _rng.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept by the worker, at most for a slice's length."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(1024, n), np.uint64)
        have[1] = base
        done = 2
        while done < len(have):
            more = min(done, len(have) - done)
            have[done : done + more] = have[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
        if n <= 32 << 20:
            _POWERS[base] = have
    return have[:n]


def rolling_hash(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit key of every string of `width` bytes. Equal strings have equal keys; the
    polynomial modulo 2^64 is no identity, so nothing may follow from equal keys alone."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _powers(_BASE, len(data)), out=prefix[1:])
    return mix64((prefix[width:] - prefix[: len(prefix) - width]) * _powers(_BASE_INVERSE, len(prefix))[: max(0, len(prefix) - width)])


#: Spans beyond this many bytes go through BLAKE2, one by one.
LONG_SPAN = 64


def eights(data: np.ndarray) -> np.ndarray:
    """At every position the eight bytes from there on; zeros follow the end."""
    padded = np.concatenate([data.astype(np.uint8, copy=False), np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))


def take_eight(view: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(view[at]).view(np.uint64).ravel()


def _up_to(size: np.ndarray) -> np.ndarray:
    """Masks of the first `size` of eight bytes."""
    return np.where(size >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * size.clip(0, 7)).astype(np.uint64)) - np.uint64(1))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the spans' bytes; two seeds make a hash of 128 bits.

    Eight bytes at a time go through a bijective mixing, so spans of up to eight bytes never
    collide with others of their length, and no pattern of bytes makes longer ones collide."""
    size = end - start
    out = mix64(size.astype(np.uint64) + np.uint64(_BASE) * np.uint64(seed))
    if not len(size):
        return out
    view, live, o = eights(data), np.flatnonzero(size <= LONG_SPAN), 0
    while len(live):
        rest = size[live] - o
        out[live] = mix64(out[live] ^ (take_eight(view, start[live] + o) & _up_to(rest)))
        o += 8
        live = live[rest > 8]
    for k in np.flatnonzero(size > LONG_SPAN).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] == data[b : b + size], for each."""
    view = eights(data)
    same = np.ones(len(a), bool)
    live, o = np.flatnonzero((size > 0) & (a != b)), 0
    while len(live):
        if o >= LONG_SPAN and len(live) < 64:  # few long ones
            for k in live.tolist():
                same[k] = np.array_equal(data[a[k] + o : a[k] + size[k]], data[b[k] + o : b[k] + size[k]])
            break
        rest = size[live] - o
        bad = ((take_eight(view, a[live] + o) ^ take_eight(view, b[live] + o)) & _up_to(rest)) != 0
        same[live[bad]] = False
        o += 8
        live = live[~bad & (rest > 8)]
    return same


def digests(raw: bytes | memoryview, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2 a span, as two columns: equal digests mean equal bytes."""
    view, make = memoryview(raw), hashlib.blake2b
    got = b"".join([make(view[s:e], digest_size=16).digest() for s, e in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(got, np.uint64).reshape(-1, 2)


def word_spans(data: np.ndarray, between: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts laid end to end, and how many words each text has.

    `between` marks the bytes that stand between words; a word never crosses two texts."""
    inside = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.diff(np.searchsorted(s, off))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


# ---------------------------------------------------------------- packed columns


def pack(*arrays: np.ndarray) -> bytes:
    """Numeric arrays as one compressed value; bytes are stored plane by plane, so that high zero bytes cost nothing."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
        parts.append(f"{a.dtype.str},{len(a)};".encode() + planes.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    ease()
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    while at < len(raw):
        end = raw.index(b";", at)
        kind, n = raw[at:end].decode().split(",")
        size, n, at = np.dtype(kind).itemsize, int(n), end + 1
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * size
    return out


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours, then the length."""
    n = len(sorted_keys)
    if n == 0:
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [n]]).astype(np.int64)


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of `edges` (a, b): label is the smallest node of its component.

    Rounds of hooking to the smallest neighbour, pointer jumping and contraction. Each
    round's tables are written to the shared folder; nothing is gathered on the driver but
    whether edges are left. Groups are combined before they are shuffled, joins may be
    split by AQE, so a node with very many neighbours is no single task.
    """
    spark = edges.sparkSession
    left = table(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct())
    labels: Written | None = None
    while not left.df.isEmpty():
        both = left.df.unionAll(left.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        hook = table(hook)
        p = hook.df
        for _ in range(2):
            q = p.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            p = p.join(q, "up").select("node", F.col("upper").alias("up"))
        jump = table(p)
        p = jump.df
        pa_, pb = p.select(F.col("node").alias("a"), F.col("up").alias("x")), p.select(F.col("node").alias("b"), F.col("up").alias("y"))
        more = left.df.join(pa_, "a").join(pb, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        # A pointer may end above its root: the node itself stays tied to what it points to.
        tied = p.join(p.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").where("up <> top").select(F.col("top").alias("a"), F.col("up").alias("b"))
        next_left = table(more.unionAll(tied).distinct())
        if labels is None:
            next_labels = table(p.select("node", F.col("up").alias("label")))
        else:
            step = p.select(F.col("node").alias("label"), F.col("up").alias("next"))
            next_labels = table(labels.df.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
            labels.drop()
        for t in (left, hook, jump):
            t.drop()
        left, labels = next_left, next_labels
    left.drop()
    if labels is None:
        return spark.createDataFrame([], "node long, label long")
    return labels.df


def bounded_rows(df: DataFrame, most: int) -> list | None:
    """The rows if there are at most `most` of them, else None; the driver never holds more than most + 1."""
    got = df.limit(most + 1).collect()
    return got if len(got) <= most else None
