"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

A text's shingles are its runs of five words (a shorter text is one shingle). TREES prefix
tries hold the documents, each sorted by its own sequence of DEPTH MinHash values, so that
documents with a common prefix stand together. In every trie the prefix that documents have
to share is shortened step by step, from the whole sequence on, and a document goes on to the
next shorter prefix only while its estimated recall falls short of the target: with the n
neighbours found so far, the least alike of them at similarity s, and one more assumed at the
threshold t, it is (n + P(t)) / (n / P(s) + 1), where P(x) = 1 - (1 - x^depth)^TREES is the
chance that the forest finds a pair of similarity x at that depth. Documents that have found
many close neighbours stop early; they are still found by those that go on. Without any
neighbour, the prefix shrinks until P(t) itself reaches the target.

Steps, none of which lists all pairs of a group:
1. Documents with equal shingle sets are one class; only its smallest id goes on.
2. The tries are dealt by the shortest prefix that may be needed, and each part is walked as
   above; a link needs an estimated similarity that a pair at the threshold misses with a
   chance of a tenth of what the target leaves. A walk leaves a tree of links, not their
   pairs. Large parts are cut into blocks that meet in pairs, so nothing is lost.
3. Connected candidates form groups. All pairs in a group are verified with their exact
   shingle sets in blocks (a matrix product of a block's incidence matrices), and each class
   gets its number of links; again only a tree of the links leaves the block. Exact numbers of
   links cost this: a group of n different, similar texts is read n / GROUP_BLOCK times.
4. Components of verified links are the result's classes.

Defined results: null and empty texts have no shingles and no links; rows with a null id take
no part; rows that share a doc_id count as one document (its smallest fingerprint stands).
Ties go to the smallest id. Long texts are read whole. Extra columns are not read. An empty
table gives no rows. Words go by 64-bit hashes (see span_hash), sets by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import LOWER, NO_WORD, components, ease, eased, mix64, slices, span_hash, utf8, word_spans, written
from sparkloom.llm.substrings import squeezed

SHINGLE = 5
THRESHOLD = 0.8
TREES = 28
DEPTH = 7
RECALL = 0.99999
#: Rows of a block of a trie's part; documents and shingles of a group's block.
BUCKET_BLOCK = 4096
GROUP_BLOCK, GROUP_SHINGLES = 128, 400_000

_rng = np.random.Generator(np.random.PCG64(11))
_A = (_rng.integers(0, 1 << 32, TREES * DEPTH, np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, TREES * DEPTH, np.uint32)[:, None]


@dataclass(frozen=True)
class Forest:
    """What a threshold and a recall ask of TREES tries of DEPTH values."""

    threshold: float = THRESHOLD
    recall: float = RECALL

    def found(self, similarity: float | np.ndarray, depth: int) -> float | np.ndarray:
        """The chance that a pair shares a prefix of that depth in some trie."""
        return 1 - (1 - similarity**depth) ** TREES

    @property
    def shortest(self) -> int:
        """The longest prefix at which a pair at the threshold is found with the wanted chance."""
        for depth in range(DEPTH, 0, -1):
            if self.found(self.threshold, depth) >= self.recall:
                return depth
        raise ValueError(f"{TREES} tries do not reach a recall of {self.recall} at similarity {self.threshold}")

    @property
    def least(self) -> int:
        """Equal values that a link needs; a pair at the threshold has fewer with a chance of (1 - recall) / 10 at most."""
        n, t, tail = TREES * DEPTH, self.threshold, 0.0
        if t >= 1:
            return n
        for k in range(n + 1):
            tail += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(t) + (n - k) * math.log(1 - t))
            if tail > (1 - self.recall) / 10:
                return k
        return n

    def estimate(self, neighbours: np.ndarray, least: np.ndarray, depth: int) -> np.ndarray:
        """Each document's estimated recall at a depth."""
        close = np.maximum(self.found(np.clip(least, 1e-3, 1.0), depth), 1e-12)
        return (neighbours + self.found(self.threshold, depth)) / (neighbours / close + 1)


def shingle_sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    low = LOWER[data]
    s, e, per = word_spans(low, NO_WORD, off)
    h = span_hash(low, s, e)
    if len(h) >= SHINGLE:
        g = h[: len(h) - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(g)]
        g = mix64(g)
    first = np.cumsum(per) - per
    out = []
    for a, n in zip(first.tolist(), per.tolist(), strict=True):
        if n >= SHINGLE:
            out.append(np.unique(g[a : a + n - SHINGLE + 1]))
        elif n:
            x = h[a : a + 1]
            for k in range(1, n):
                x = x * np.uint64(0x9E3779B97F4A7C15) + h[a + k]
            out.append(mix64(x))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_hashes(x: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima over permutations of the shingles' 32-bit hashes."""
    low = (x >> np.uint64(32)).astype(np.uint32)
    out = np.full(TREES * DEPTH, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(out, (_A * low[at : at + 512] + _B).min(axis=1), out=out)
    return out


_SIGNED = pa.schema([("doc_id", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("n", pa.int64()), ("sig", pa.binary())])
_SIGNED_DDL = "doc_id long, set_a long, set_b long, n long, sig binary"
#: Bytes of a value in a signature: the low half of the MinHash.
VALUE_BYTES = 2


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):  # hashes wrap around
        for whole in batches:
            for b in slices(whole, 1 << 20):
                rows = [[] for _ in _SIGNED]
                for doc, x in zip(b.column("doc_id").to_pylist(), shingle_sets(*utf8(b.column("text"))), strict=True):
                    sums = (int(x.sum().view(np.int64)), int(mix64(x).sum().view(np.int64))) if len(x) else (0, 0)
                    for row, v in zip(rows, (doc, *sums, len(x), min_hashes(x).astype(np.uint16).tobytes() if len(x) else b""), strict=True):
                        row.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, _SIGNED, strict=True)], schema=_SIGNED)


def blocked(rows: DataFrame, key: str, parts: F.Column, salt: F.Column) -> DataFrame:
    """`rows` (with their group in `key`) with i, j, own: each row goes to the blocks (i, j), i <= j, that hold its part `own`."""
    own = rows.withColumn("parts", parts.cast("int")).withColumn("own", F.pmod(salt, F.col("parts")).cast("int"))
    return own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*rows.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def walk_trie(forest: Forest, ids: np.ndarray, signatures: np.ndarray, tree: int) -> list[tuple[int, int]]:
    """Links (a tree of them for each group) between the documents of a part of a trie.

    Nodes are runs of the sorted labels; from one depth to the next shorter one, only
    documents whose estimated recall falls short look for neighbours, among all of the node."""
    label = signatures[:, tree * DEPTH : (tree + 1) * DEPTH]
    order = np.lexsort((ids, *label.T[::-1]))
    ids, sig, label = ids[order], signatures[order], label[order]
    n, values, least = len(ids), signatures.shape[1], forest.least
    common = np.cumprod(label[1:] == label[:-1], axis=1).sum(1)  # with the document before
    group, size, alike = np.arange(n), np.ones(n, np.int64), np.ones(n)
    active = np.ones(n, bool)
    links: list[tuple[int, int]] = []
    for depth in range(DEPTH, forest.shortest - 1, -1):
        cuts = np.concatenate([[0], np.flatnonzero(common < depth) + 1, [n]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a < 2 or not active[a:b].any():
                continue
            for k in range(a, b):
                if not active[k]:
                    continue
                others = a + np.flatnonzero(group[a:b] != group[k])
                if not len(others):
                    if (group[a:b] == group[a]).all():
                        break
                    continue
                agree = (sig[others] == sig[k]).sum(1)
                close = agree >= least
                if not close.any():
                    continue
                new, near = others[close], agree[close] / values
                alike[new] = np.minimum(alike[new], near)
                alike[k] = min(alike[k], float(near.min()))
                roots, first = np.unique(group[new], return_index=True)
                links += [(int(ids[k]), int(ids[j])) for j in new[first]]
                whole = np.isin(group, np.append(roots, group[k]))
                group[whole], size[whole] = group[k], whole.sum()
        active = forest.estimate(size - 1, alike, depth) < forest.recall
        if not active.any():
            break
    return links


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _walk(forest: Forest):
    def run(group: pa.Table) -> pa.Table:
        ease()
        ids = group.column("id").to_numpy()
        signatures = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(len(ids), -1)
        links: list[tuple[int, int]] = []
        trees = group.column("tree").to_numpy()
        for tree in np.unique(trees):  # one, unless keys collide
            own = trees == tree
            links += walk_trie(forest, ids[own], signatures[own], int(tree))
        return pa.Table.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=_EDGE)

    return run


_MEMBER = pa.schema([("group", pa.int64()), ("id", pa.int64()), ("copies", pa.int64()), ("parts", pa.int32()), ("x", pa.binary())])


def _reread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    for b in batches:
        for at in range(0, b.num_rows, 256):
            c = b.slice(at, 256)
            sets = shingle_sets(*utf8(pa.array([z.decompress(x) for x in c.column("z").to_pylist()], pa.binary())))
            yield pa.RecordBatch.from_arrays([c.column("group"), c.column("id"), c.column("copies"), c.column("parts"), pa.array([x.tobytes() for x in sets], pa.binary())], schema=_MEMBER)


_VERIFIED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _verify(threshold: float):
    """Exact similarities of a block: rows (id, null, links) and a tree of links (a, b, 0)."""

    def run(group: pa.Table) -> pa.Table:
        ease()
        order = np.argsort(group.column("id").to_numpy())
        ids, copies, own = (group.column(c).to_numpy()[order] for c in ("id", "copies", "own"))
        blobs = group.column("x").to_pylist()
        sets = [np.frombuffer(blobs[k], np.uint64) for k in order]
        size = np.array([len(x) for x in sets], np.int64)
        doc = np.repeat(np.arange(len(ids)), size)
        u, word, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        doc, word = doc[shared[word]], (np.cumsum(shared) - 1)[word][shared[word]]
        by = np.argsort(word, kind="stable")
        doc, word = doc[by], word[by]
        both = np.zeros((len(ids), len(ids)), np.float32)
        width = max(256, (8 << 20) // max(1, len(ids)))
        cuts = np.searchsorted(word, np.arange(0, int(shared.sum()) + width, width))
        for k, (p, q) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            m = np.zeros((len(ids), width), np.float32)
            m[doc[p:q], word[p:q] - k * width] = 1
            both += m @ m.T
        similar = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
        np.fill_diagonal(similar, False)
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        if i != j:  # pairs within a part are another block's
            similar &= own[:, None] != own[None, :]
        links = similar @ copies
        a, b = ids.tolist(), [None] * len(ids)
        n = links.tolist()
        left = np.ones(len(ids), bool)
        for root in range(len(ids)):
            if not left[root]:
                continue
            left[root] = False
            stack = [root]
            while stack:
                new = np.flatnonzero(similar[stack.pop()] & left)
                left[new] = False
                stack += new.tolist()
                a += [ids[root]] * len(new)
                b += ids[new].tolist()
                n += [0] * len(new)
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], schema=_VERIFIED)

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, copy_of, n_shingles, n_rows: a row for each document.

    class_id: the smallest doc_id that chains of links lead to. n_links: documents at or above
    the threshold, copies included. copy_of: the smallest doc_id with the same shingle set.
    n_rows: rows that have the doc_id."""
    forest = Forest(threshold, recall)
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(own.mapInArrow(eased(_sign), _SIGNED_DDL))
    per_doc = signed.groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b", "n")).alias("s"), F.count(F.lit(1)).alias("n_rows")).select("doc_id", "s.*", "n_rows")
    classes = written(per_doc.where("n > 0").groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    reps = signed.join(classes.select("id", "copies", F.col("set_a").alias("ra"), F.col("set_b").alias("rb")), (F.col("doc_id") == F.col("id")) & (F.col("set_a") == F.col("ra")) & (F.col("set_b") == F.col("rb")))
    reps = written(reps.select("id", "copies", "n", "sig").dropDuplicates(["id"]))

    # the tries, dealt by the shortest prefix; parts that hold more than one class
    prefix = F.substring("sig", F.col("tree") * (DEPTH * VALUE_BYTES) + 1, F.lit(forest.shortest * VALUE_BYTES))
    rows = reps.select("id", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("id", "tree", F.xxhash64("tree", prefix).alias("node"))
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    met = rows.join(nodes, "node").join(reps.select("id", "sig"), "id")
    met = blocked(met, "node", F.ceil(F.col("held") / BUCKET_BLOCK), F.xxhash64("id"))
    maybe = met.select("node", "i", "j", "id", "tree", "sig").groupBy("node", "i", "j").applyInArrow(_walk(forest), "a long, b long").distinct()
    groups = components(maybe)

    size = groups.join(reps.select(F.col("id").alias("node"), "n", "copies"), "node").select(F.col("label").alias("group"), F.col("node").alias("id"), "n", "copies")
    parts = size.groupBy("group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_BLOCK), F.ceil(F.sum("n") / GROUP_SHINGLES)).cast("int").alias("parts"))
    members = size.join(parts, "group").select("group", "id", "copies", "parts")
    texts = squeezed(own).join(members, F.col("doc_id") == F.col("id")).select("group", "id", "copies", "parts", "z")
    sets = texts.mapInArrow(eased(_reread), "group long, id long, copies long, parts int, x binary").dropDuplicates(["id"])
    blocks = blocked(sets.select("group", "id", "copies", F.col("parts").alias("of"), "x"), "group", F.col("of"), F.xxhash64("id"))
    checked = written(blocks.groupBy("group", "i", "j").applyInArrow(_verify(threshold), "a long, b long, links long"))

    labels = components(checked.where("b is not null").select("a", "b"))
    links = checked.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    known = classes.join(links, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("set_a", "set_b", "n", F.col("id").alias("copy_of"), F.coalesce("label", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = per_doc.join(known, ["set_a", "set_b", "n"], "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copy_of", "doc_id").alias("copy_of"), F.col("n").alias("n_shingles"), "n_rows")


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of `docs`, all columns: of each class the document with the smallest id, and one
    row of those that share a doc_id (the smallest by text). Rows with a null id stay."""
    found = written(near_duplicates(docs, threshold, recall).select("doc_id", "class_id", "n_rows"))
    kept = docs.join(found.where("class_id <> doc_id").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    again = found.where("class_id = doc_id and n_rows > 1").select("doc_id")
    if again.isEmpty():
        return kept
    w = Window.partitionBy("doc_id").orderBy("text", *[c for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith("map")])
    row = next(x for x in ("row" + "_" * n for n in range(len(docs.columns) + 1)) if x not in docs.columns)
    one = kept.join(again, "doc_id", "left_semi").withColumn(row, F.row_number().over(w)).where(F.col(row) == 1).select(docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(one)
