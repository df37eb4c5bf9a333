"""Suffix-array dedup: bytes covered by long strings that also start earlier in the corpus.

A window is a string of `length` bytes. Every window is keyed by the smallest hash of the
GRAM-byte strings in it, so equal windows have equal keys wherever they stand, and windows
that follow each other mostly share a key: a document falls into runs of windows, which cover
`length` - 1 bytes more than they have windows. Runs with the same bytes (the same 128-bit
BLAKE2 digest) are combined where they are made and again in their key's shard; of each, the
first is kept, and the windows of the others start earlier there. Runs that share a key but
not their bytes may still share windows. Their bytes, once for every different run, are
gathered in shards; a suffix array is built for each shard by induced sorting, permuted common
prefixes say which neighbours share a window, and of each group of equal windows all but the
first are marked. So no window is compared on its own with all others, and no key's copies
meet in one task.

A key whose different runs hold more than `hot` bytes (a passage in very many surroundings, a
long text of one letter) is cut into single windows for the last step. They go by their own
digests: of equal ones a task keeps the first and marks the others before anything is sent,
and the firsts meet again in their digest's shard. So neither a hot key nor a hot window is a
group that grows with the documents that hold it, but by one row a task's block of windows.

Keys may collide without harm, as bytes or digests decide. Defined results: null and empty
texts have 0 bytes and nothing removed. Rows with a null id are returned with nothing removed
and take no part. Rows that share a doc_id count as one document, whose repeats do not remove
themselves. Long texts are read in stretches that overlap by a window. Extra columns are not
read. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import dealt, digests, ease, eased, pack, rolling_hash, runs, shard_count, slices, text_volume, unpack, utf8, written
from sparkloom.llm.suffix_array import permuted_common_prefixes, suffix_array

LENGTH = 100
GRAM = 48
#: Text bytes whose runs make one shard, and bytes of runs that make one suffix array.
SHARD_BYTES = 24 << 20
ARRAY_BYTES = 1 << 20
#: Text bytes whose runs, and bytes of runs that, go to one task's shards.
TASK_BYTES, TASK_PIECES = 96 << 20, 16 << 20
#: Text bytes whose windows are hashed at once, and those whose runs are combined before they are sent.
STRETCH = 1 << 20
COMBINED = 8 << 20
#: Bytes of a key's different runs that may meet in one suffix array.
HOT = 1 << 18
#: Windows of hot keys that are combined before they are sent, and those that make one shard.
WINDOWS, SHARD_WINDOWS = 1 << 19, 1 << 21
#: Runs of texts that leave a task as one batch.
PIECE_ROWS = 16_384


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by prefix and suffix minima of blocks."""
    n = len(x)
    if n < width:
        return x[:0]
    full = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def stretches(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets, where in their documents the texts begin), of about STRETCH bytes each."""
    for b in slices(batch, STRETCH):
        ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        data, off = utf8(b.column("text"))
        if b.num_rows > 1 or len(data) <= 2 * STRETCH:
            yield ids, data, off, np.zeros(len(ids), np.int64)
            continue
        for at in range(0, len(data), STRETCH):
            part = data[at : at + STRETCH + length - 1]
            if len(part) >= length:
                yield ids, part, np.array([0, len(part)]), np.array([at])


def window_runs(ids: np.ndarray, data: np.ndarray, off: np.ndarray, base: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Key, content digest, document, start, number of windows of each run, and whether its key's string stands in it twice.

    Only then may a run hold a window twice."""
    n = len(data)
    if n < length:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z.view(np.uint64).reshape(0, 2), z, z, z, z > 0
    width = length - GRAM + 1
    grams = rolling_hash(data, GRAM)
    key = sliding_minimum(grams, width)
    size = np.diff(off)
    last = np.repeat(off[1:], size)[: len(key)] - length
    fine = np.arange(len(key)) <= last
    start = fine.copy()
    start[1:] &= ~fine[:-1] | (key[1:] != key[:-1])
    start[off[:-1][(off[:-1] < len(key)) & (size >= length)]] = True
    s = np.flatnonzero(start)
    stop = np.concatenate([s[1:], [len(key)]]) if len(s) else s
    e = np.minimum(stop, last[s] + 1)
    doc = np.searchsorted(off, s, "right") - 1
    # a string is some window's smallest if no window that holds it has a larger minimum
    most = np.iinfo(np.uint64).max
    around = np.concatenate([np.full(width - 1, most), most - key, np.full(width - 1, most)])
    smallest = np.flatnonzero(most - sliding_minimum(around, width) == grams)
    low, high = np.searchsorted(smallest, s), np.searchsorted(smallest, e + width - 1)
    run = np.repeat(np.arange(len(s)), high - low)
    at = smallest[np.repeat(low - np.cumsum(high - low) + high - low, high - low) + np.arange(len(run))]
    twice = np.bincount(run[grams[at] == key[s][run]], minlength=len(s)) > 1
    return key[s], digests(data, s, e + length - 1), ids[doc], s - off[doc] + base[doc], e - s, twice


def _firsts(same: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with equal `same` (two columns): the indices of the earliest ones and of those that start later than it."""
    high, low = same[:, 0], same[:, 1]
    order = np.lexsort((pos, doc, high))
    if len(order) and ((high[order][1:] == high[order][:-1]) & (low[order][1:] != low[order][:-1])).any():
        order = np.lexsort((pos, doc, low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    first = order[new]
    of = first[np.cumsum(new) - 1]
    later = order[(doc[order] != doc[of]) | (pos[order] != pos[of])]
    return first, later


_MESSAGE = pa.schema([("shard", pa.int64()), ("blob", pa.binary())])
_RUNS = pa.schema([("doc_id", pa.int64()), ("p", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("kind", pa.int32())])
_RUNS_DDL = "doc_id long, p long, n long, key long, kind int"
DONE, ASK, HOT_ASK = 0, 1, 2


def _messages(found: list[tuple[np.ndarray, ...]], shards: int) -> pa.RecordBatch:
    """Runs of some stretches, combined, as one message to each shard."""
    key, content, doc, pos, n, twice = (np.concatenate(x) for x in zip(*found, strict=True))
    first, later = _firsts(content, doc, pos)
    names, blobs = [], []
    if len(later):  # repeats within these stretches are marked; they go with the messages of some shard
        names.append(-1 - int(doc[later[0]] % shards))
        blobs.append(pack(doc[later], pos[later].astype(np.uint32), n[later].astype(np.uint32)))
    key, content, doc, pos, n, twice = (x[first] for x in (key, content, doc, pos, n, twice))
    shard = ((key >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((pos, doc, shard))
    cut = runs(shard[order])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        k = order[a:b]
        names.append(int(shard[k[0]]))
        step = np.diff(doc[k], prepend=0)
        blobs.append(pack(key[k].astype(np.uint32), content[k, 0], content[k, 1], step, pos[k].astype(np.uint32), n[k].astype(np.uint32), twice[k]))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], schema=_MESSAGE)


def _scatter(shards: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for part in stretches(batch, length):
                found.append(window_runs(*part, length))
                size += len(part[1])
                if size >= COMBINED:
                    yield _messages(found, shards)
                    found, size = [], 0
        if found:
            yield _messages(found, shards)

    return run


def _resolve(hot: int, length: int):
    def run(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        parts = [unpack(b) for b in group.column("blob").to_pylist()]
        if shard < 0:
            doc, pos, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            return _run_table(doc, pos, n, np.zeros(len(doc), np.int64), np.full(len(doc), DONE))
        key = np.concatenate([x[0] for x in parts]).astype(np.int64)
        content = np.concatenate([np.stack(x[1:3], axis=1) for x in parts])
        doc = np.concatenate([np.cumsum(x[3]) for x in parts])
        pos, n = (np.concatenate([x[i] for x in parts]).astype(np.int64) for i in (4, 5))
        twice = np.concatenate([x[6] for x in parts])
        first, later = _firsts(content, doc, pos)
        _, inverse, kinds = np.unique(key[first], return_inverse=True, return_counts=True)
        size = np.bincount(inverse, n[first] + length)
        open_ = (kinds[inverse] > 1) | twice[first]
        ask = first[open_]
        kind = np.where(size[inverse][open_] > hot, HOT_ASK, ASK)
        at = np.concatenate([later, ask])
        return _run_table(doc[at], pos[at], n[at], key[at] + (shard << 32), np.concatenate([np.full(len(later), DONE), kind]))

    return run


def _run_table(doc: np.ndarray, pos: np.ndarray, n: np.ndarray, key: np.ndarray, kind: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x.astype(np.int64)) for x in (doc, pos, n, key)] + [pa.array(kind.astype(np.int32))], schema=_RUNS)


def squeezed(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, z (the compressed text) and the columns `carry` as c0, c1, ..., for a shuffle of whole texts."""
    carry = carry or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            data, off = utf8(b.column("text"))
            blobs = [z.compress(data[off[i] : off[i + 1]].tobytes()) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(blobs, pa.binary()), *b.columns[2:]], names=["doc_id", "z", *b.schema.names[2:]])

    kinds = dict(docs.dtypes)
    ddl = "".join(f", c{i} {kinds[c]}" for i, c in enumerate(carry))
    return docs.select("doc_id", "text", *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).mapInArrow(eased(run), "doc_id long, z binary" + ddl)


_PIECES = pa.schema([("array", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("p", pa.int64()), ("n", pa.int64()), ("s", pa.binary())])
_PIECES_DDL = "array long, key long, doc_id long, p long, n long, s binary"
#: In place of a key: what a message of windows holds.
FIRSTS, LATER = 0, 1


def _window_messages(found: list[tuple[np.ndarray, ...]], shards: int) -> pa.RecordBatch:
    """Windows of hot keys, combined: the firsts as a message to each shard (named -1 - shard), the others, marked, to some shard."""
    digest, doc, pos = (np.concatenate(x) for x in zip(*found, strict=True))
    first, later = _firsts(digest, doc, pos)
    rows = []
    if len(later):
        rows.append((-1 - int(doc[later[0]] % shards), LATER, 0, 0, 0, pack(doc[later], pos[later])))
    shard = (digest[first, 0] % np.uint64(shards)).astype(np.int64)
    first, shard = first[order := np.argsort(shard, kind="stable")], shard[order]
    cut = runs(shard)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        k = first[a:b]
        rows.append((-1 - int(shard[a]), FIRSTS, 0, 0, 0, pack(digest[k, 0], digest[k, 1], doc[k], pos[k])))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)


def _cut(arrays: int, shards: int, length: int):
    """Texts and their asked runs to the runs' bytes, dealt to suffix arrays by key; runs of hot keys to messages of single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        found, held = [], 0
        for b in batches:
            for doc, blob, asked in zip(b.column("doc_id").to_pylist(), b.column("z"), b.column("asked"), strict=True):
                raw = z.decompress(blob.as_py())
                a = asked.values
                p, n, key, kind = (a.field(f).to_numpy(zero_copy_only=False) for f in ("p", "n", "key", "kind"))
                rows = [(int(k) % arrays, int(k), doc, int(i), int(m), raw[i : i + m + length - 1]) for i, m, k, h in zip(p, n, key, kind, strict=True) if h == ASK]
                for at in range(0, len(rows), PIECE_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + PIECE_ROWS], strict=True), _PIECES, strict=True)], schema=_PIECES)
                for i, m, h in zip(p.tolist(), n.tolist(), kind.tolist(), strict=True):
                    for begin in range(i, i + m if h == HOT_ASK else i, WINDOWS):
                        at = np.arange(begin, min(i + m, begin + WINDOWS))
                        found.append((digests(raw, at, at + length), np.full(len(at), doc), at))
                        held += len(at)
                        if held >= WINDOWS:
                            yield _window_messages(found, shards)
                            found, held = [], 0
        if found:
            yield _window_messages(found, shards)

    return run


def repeated_windows(strings: list[bytes], doc: np.ndarray, pos: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of the windows that also start earlier, among those of the given runs."""
    size = np.array([len(s) for s in strings])
    text = np.frombuffer(b"\xff".join(strings), np.uint8)  # no UTF-8 text has this byte
    begin = np.cumsum(size + 1) - size - 1
    sa = suffix_array(text)
    common = permuted_common_prefixes(text, sa, length)[sa]
    of = np.searchsorted(begin, sa, "right") - 1
    window = sa - begin[of] < n[of]
    group = np.cumsum(common < length)
    group, of, at = group[window], of[window], (sa - begin[of])[window]
    d, p = doc[of], pos[of] + at
    _, later = _firsts(np.stack([group, np.zeros(len(group), group.dtype)], axis=1), d, p)
    return d[later], p[later]


def _arrays(length: int):
    def run(group: pa.Table) -> pa.Table:
        ease()
        if group.column("array")[0].as_py() < 0:
            parts = [[], []]
            for kind, blob in zip(group.column("key").to_pylist(), group.column("s").to_pylist(), strict=True):
                parts[kind].append(unpack(blob))
            d, p = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*parts[LATER], strict=True) if parts[LATER] else ([], [])))
            if parts[FIRSTS]:
                high, low, doc, pos = (np.concatenate(x) for x in zip(*parts[FIRSTS], strict=True))
                _, later = _firsts(np.stack([high, low], axis=1), doc, pos)
                d, p = np.concatenate([d, doc[later]]), np.concatenate([p, pos[later]])
        else:
            doc, pos, n = (group.column(c).to_numpy() for c in ("doc_id", "p", "n"))
            d, p = repeated_windows(group.column("s").to_pylist(), doc, pos, n, length)
        order = np.lexsort((p, d))
        d, p = d[order], p[order]
        keep = np.ones(len(d), bool)
        keep[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1])
        d, p = d[keep], p[keep]
        cut = np.concatenate([[0], np.flatnonzero((d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)) + 1, [len(d)]])[0 if len(d) else 1 :]
        begin = cut[:-1]
        return _run_table(d[begin], p[begin], np.diff(cut), np.zeros(len(begin)), np.full(len(begin), DONE))

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id and spans array<struct<p, n>>: windows [p, p + n) of the document also start earlier. Documents without any have no row."""
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    _, size = text_volume(own)
    shards = shard_count(size, SHARD_BYTES)
    messages = own.mapInArrow(eased(_scatter(shards, length)), "shard long, blob binary")
    found = written(dealt(messages, "shard", size, TASK_BYTES).groupBy("shard").applyInArrow(_resolve(hot, length), _RUNS_DDL))
    asked = found.where(F.col("kind") != DONE)
    some = lambda kind, what: F.coalesce(F.sum(F.when(F.col("kind") == kind, what)), F.lit(0))
    piece_bytes, windows = asked.agg(some(ASK, F.col("n") + length), some(HOT_ASK, F.col("n"))).first()
    arrays, window_shards = shard_count(piece_bytes, ARRAY_BYTES), shard_count(windows, SHARD_WINDOWS, 1)
    by_doc = asked.groupBy("doc_id").agg(F.collect_list(F.struct("p", "n", "key", "kind")).alias("asked"))  # a document's length bounds it
    pieces = squeezed(own).join(by_doc, "doc_id").select("doc_id", "z", "asked").mapInArrow(eased(_cut(arrays, window_shards, length)), _PIECES_DDL)
    later = dealt(pieces, "array", piece_bytes + 32 * windows, TASK_PIECES).groupBy("array").applyInArrow(_arrays(length), _RUNS_DDL)
    marks = found.where(F.col("kind") == DONE).unionAll(later)
    return marks.groupBy("doc_id").agg(F.collect_list(F.struct("p", "n")).alias("spans"))


def removed_bytes(size: int, p: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Which of a text's bytes lie in the windows."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, np.minimum(p, size), 1)
    np.add.at(step, np.minimum(p + n + length - 1, size), -1)
    return np.cumsum(step)[:-1] > 0


def _cleaned(b: pa.RecordBatch, length: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Each row's text and which of its bytes go."""
    z = zstandard.ZstdDecompressor()
    for blob, spans in zip(b.column("z"), b.column("spans"), strict=True):
        raw = z.decompress(blob.as_py())
        if spans.is_valid:
            v = spans.values
            yield raw, removed_bytes(len(raw), v.field("p").to_numpy(zero_copy_only=False), v.field("n").to_numpy(zero_copy_only=False), length)
        else:
            yield raw, np.zeros(len(raw), bool)


def _kept(raw: bytes, mask: np.ndarray) -> bytes:
    return np.frombuffer(raw, np.uint8)[~mask].tobytes() if mask.any() else raw


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(len(raw), int(m.sum()), int((m[1:] & ~m[:-1]).sum() + m[:1].sum()), hashlib.sha256(_kept(raw, m)).hexdigest()) for raw, m in _cleaned(b, length)]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(_DIGEST)[1:], strict=True))], schema=_DIGEST)

    joined = squeezed(docs).join(repeated_spans(docs, length, hot), "doc_id", "left").select("doc_id", "z", "spans")
    return joined.mapInArrow(eased(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """The rows of `docs`, all columns, with the text that is left; n_chars, where there is one, is its new length.

    Cuts may part a character; its rest is no UTF-8 and is left out. A text without repeats,
    null included, stays as it is."""
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_kept(raw, m).decode("utf-8", "ignore") for raw, m in _cleaned(b, length)]
            texts = [None if null else t for t, null in zip(texts, b.column("gone").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), *b.columns[4:]], names=["doc_id", "text", *b.schema.names[4:]])

    kinds = dict(docs.dtypes)
    marked = docs.withColumn("__null", F.col("text").isNull())
    joined = squeezed(marked, ["__null", *carry]).join(repeated_spans(docs, length, hot), "doc_id", "left")
    joined = joined.select("doc_id", "z", "spans", F.col("c0").alias("gone"), *[F.col(f"c{i + 1}") for i in range(len(carry))])
    out = joined.mapInArrow(eased(run), "doc_id long, text string" + "".join(f", c{i + 1} {kinds[c]}" for i, c in enumerate(carry)))
    back = {c: F.col(f"c{i + 1}").alias(c) for i, c in enumerate(carry)} | {"doc_id": F.col("doc_id").cast(kinds["doc_id"]), "text": F.col("text")}
    if "n_chars" in carry:
        back["n_chars"] = F.coalesce(F.length("text").cast(kinds["n_chars"]), F.col(f"c{carry.index('n_chars') + 1}")).alias("n_chars")
    return out.select(*[back[c].alias(c) for c in docs.columns])
