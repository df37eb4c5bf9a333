"""Packing: vector bins under limits on tokens, segments and loss-bearing tokens.

Each input partition is packed on its own, so nothing is shuffled and no bin waits for
another executor; a rerun of a task gives the same bins. Documents longer than a bin give
whole bins first. What remains is placed by the dot-product heuristic: of the items that
fit, the one whose demand vector points most along the bin's free capacity. A bin that no
item fits any more is filled by cutting one, as cuts are free; a partition's last bin is
laid out in powers of two, which need no padding.

Defined results: a null or empty text has the end id alone. Repeated rows are packed as
often as they stand there. Long texts are packed whole. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sparkloom.llm.common import LOWER, WHITE, eased, kept, same_spans, slices, span_hash, utf8


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


@dataclass
class Item:
    """A run of ids of one document that is still to be placed."""

    doc: int | None
    start: int
    ids: np.ndarray
    loss: np.ndarray | None
    doc_tokens: int

    def n_loss(self) -> int:
        return len(self.ids) if self.loss is None else int(self.loss.sum())

    def cut(self, n: int) -> tuple[Item, Item]:
        parts = ((slice(None, n), 0), (slice(n, None), n))
        return tuple(Item(self.doc, self.start + at, self.ids[s], None if self.loss is None else self.loss[s], self.doc_tokens) for s, at in parts)  # type: ignore[return-value]


@dataclass
class Packer:
    """Places items; emits finished bins as (sequence number, pieces)."""

    limits: Limits
    window: int = 1024
    waiting: list[Item] = field(default_factory=list)
    bins: int = 0

    def _fits(self, item: Item, most: int, loss: int) -> int:
        """Ids of a prefix of the item within both limits."""
        n = min(len(item.ids), most)
        if item.loss is None:
            return min(n, loss)
        if (used := np.cumsum(item.loss[:n])).size and used[-1] > loss:
            n = int(np.searchsorted(used, loss, "right"))
        return n

    def _emit(self, pieces: list[Item]) -> tuple[int, list[Item]]:
        self.bins += 1
        return self.bins - 1, pieces

    def add(self, item: Item) -> Iterator[tuple[int, list[Item]]]:
        while len(item.ids) >= self.limits.tokens and (n := self._fits(item, self.limits.tokens, self.limits.loss)) == self.limits.tokens:
            head, item = item.cut(n)
            yield self._emit([head])
        while len(item.ids) > self.limits.tokens or item.n_loss() > self.limits.loss:  # bound by loss
            head, item = item.cut(max(1, self._fits(item, self.limits.tokens - 1, self.limits.loss)))
            self.waiting.append(head)
        if len(item.ids):
            self.waiting.append(item)
        if len(self.waiting) >= self.window:
            yield from self._place(self.window // 4)

    def _place(self, keep: int) -> Iterator[tuple[int, list[Item]]]:
        """Fills bins until no more than `keep` items wait."""
        cap = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        items: list[Item | None] = list(self.waiting)
        need = np.array([[len(i.ids), 1, i.n_loss()] for i in self.waiting], float).reshape(-1, 3)
        left = len(items)
        while left > keep:
            free, pieces = cap.copy(), []
            while left and free[0] > 0 and free[1] > 0:
                fits = (need <= free).all(axis=1)
                if fits.any():
                    score = np.where(fits, (need / cap) @ (free / cap), -1.0)
                    k = int(score.argmax())
                    pieces.append(items[k])
                    free -= need[k]
                    items[k] = None
                    need[k] = np.inf
                    left -= 1
                    continue
                k = int(np.where(np.isfinite(need[:, 0]), need[:, 0], -1).argmax())
                n = self._fits(items[k], int(free[0]), int(free[2]))
                if not 0 < n < len(items[k].ids):
                    break
                head, tail = items[k].cut(n)
                pieces.append(head)
                free -= [n, 1, head.n_loss()]
                items[k], need[k] = tail, [len(tail.ids), 1, tail.n_loss()]
            if left == 0 and free[0] > 0:
                yield from self._finish(pieces)
            else:
                yield self._emit(pieces)
        self.waiting = [i for i in items if i is not None]

    def _finish(self, pieces: list[Item]) -> Iterator[tuple[int, list[Item]]]:
        """The last, part-filled bin as sequences whose lengths are powers of two, the largest first."""
        total = sum(len(p.ids) for p in pieces)
        queue = list(pieces)
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            part: list[Item] = []
            while size:
                p = queue.pop(0)
                if len(p.ids) > size:
                    p, rest = p.cut(size)
                    queue.insert(0, rest)
                part.append(p)
                size -= len(p.ids)
            yield self._emit(part)

    def close(self) -> Iterator[tuple[int, list[Item]]]:
        yield from self._place(0)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a printable byte as itself and the others as letters from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(0x100 + i) for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


class WordPieces:
    """Ids of whole texts, remembering those of the chunks between spaces and line feeds.

    The vocabulary's splitter never joins across white space, and its normaliser lowers
    case, so a text's ids are those of its lower-cased chunks in order; a chunk of ASCII
    letters and a mark is at once in pieces and goes to the merge table directly. Equality
    with the tokenizer run over whole texts is tested. This holds for vocabularies that lower
    case and split at white space first; where a probe of a few texts says otherwise, whole
    texts go through the tokenizer, one by one."""

    MOST_CHUNKS, MOST_BYTES = 1_000_000, 64 << 20
    #: Texts that tell whether a vocabulary lowers case and never joins across white space.
    _PROBE = ("The Quick brown FOX, it jumped. twice! (So it did)", "É Über ça\tÑandú\n\nİstanbul  two  spaces ", "12 34,5 a.b x=1; https://e.org/?q=1", "", "日本 語 and e\u0301 ok")
    #: Letters up to U+024F (all of them stable under NFC), but for one whose lower case is no letter, then marks.
    _PLAIN = re.compile(r"((?:(?![\u0130\u00d7\u00f7\u00aa\u00ba])[a-z\u00c0-\u024f])+)([.,;:!?)]*)")
    _A_TO_Z = np.array([97 <= b <= 122 for b in range(256)])
    #: Last bytes of the letters whose first byte is 0xC3.
    _AFTER_C3 = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])

    def __init__(self, path: str):
        import tokenizers

        self.tok = tokenizers.Tokenizer.from_file(path)
        self.model = self.tok.model
        self.clear()
        self.whole = False
        data, off = utf8(pa.array(self._PROBE))
        got, edge = self.ids(data, off, 0)
        self.whole = any(self._encode(t.encode()) != got[a : b - 1].tolist() for t, a, b in zip(self._PROBE, edge[:-1], edge[1:], strict=True))
        self.clear()

    def _encode(self, text: bytes) -> list[int]:
        return self.tok.encode(text.decode(), add_special_tokens=False).ids

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.flat = array("I")
        self.bounds = array("q", [0])
        self.held = 0

    def _learn(self, chunk: bytes) -> None:
        if chunk.isalpha():  # ASCII letters
            ids = [t.id for t in self.model.tokenize(chunk.decode())]
        else:
            text = chunk.decode()
            plain = self._PLAIN.fullmatch(text)
            if plain and not plain[2]:
                ids = [t.id for t in self.model.tokenize(text.lower().encode().decode("latin-1").translate(BYTE_LETTERS))]
            elif plain:
                ids = []
                for piece in map(str.encode, plain.groups()):
                    if piece not in self.at:
                        self._learn(piece)
                    k = self.at[piece]
                    ids += self.flat[self.bounds[k] : self.bounds[k + 1]]
            else:
                ids = self.tok.encode(text, add_special_tokens=False).ids
        self.at[chunk] = len(self.bounds) - 1
        self.flat.extend(ids)
        self.bounds.append(len(self.flat))
        self.held += len(chunk)

    def _chunks(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As word_spans, but a full stop or comma between a letter and white space is a chunk of its own."""
        white = WHITE[data]
        after = np.zeros(len(data), bool)  # a letter ends before this byte
        after[1:] = self._A_TO_Z[data[:-1]]
        after[2:] |= (data[:-2] == 0xC3) & self._AFTER_C3[data[1:-1]]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        mark = ((data == 44) | (data == 46)) & after
        mark[:-1] &= white[1:] | edge[1:-1]
        start = ~white
        end = ~white
        start[1:] &= white[:-1] | edge[1:-1] | mark[1:]
        end[:-1] &= white[1:] | edge[1:-1] | mark[1:]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        return s, e, np.searchsorted(s, off)

    def ids(self, data: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8, laid end to end), each text's with the end id behind them, and the bounds between texts."""
        if len(self.at) > self.MOST_CHUNKS or self.held > self.MOST_BYTES:
            self.clear()
        if self.whole:
            each = [[*self._encode(data[a:b].tobytes()), end_id] for a, b in zip(off[:-1], off[1:], strict=True)]
            return np.array([i for x in each for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        low = LOWER[data]
        s, e, first = self._chunks(low, off)
        _, one, inverse = np.unique(span_hash(low, s, e), return_index=True, return_inverse=True)
        raw, size = low.tobytes(), e - s
        # a hash only proposes: chunks go by their bytes
        same = (size == size[one][inverse]) & same_spans(low, s, s[one][inverse], np.minimum(size, size[one][inverse]))
        if not same.all():
            one = np.append(one, np.flatnonzero(~same))
            inverse[~same] = np.arange(len(one) - (~same).sum(), len(one))
        chunks = [raw[a:b] for a, b in zip(s[one].tolist(), e[one].tolist(), strict=True)]
        for chunk in chunks:
            if chunk not in self.at:
                self._learn(chunk)
        at = np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))[inverse]
        bounds, flat = np.frombuffer(self.bounds, np.int64), np.frombuffer(self.flat, np.uint32) if self.flat else np.zeros(0, np.uint32)
        size = (bounds[at + 1] - bounds[at]) if len(at) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        got = flat[np.repeat(bounds[at] - ends[:-1], size) + np.arange(ends[-1])] if ends[-1] else np.zeros(0, np.uint32)
        edges = ends[first] + np.arange(len(off))
        out = np.full(edges[-1], end_id, np.uint32)
        real = np.ones(edges[-1], bool)
        real[edges[1:] - 1] = False
        out[real] = got
        named = np.flatnonzero([b"<|" in raw[off[i] : off[i + 1]] for i in range(len(off) - 1)]) if b"<|" in raw else []
        if len(named):  # maybe the name of a special id, which has a case
            each = [out[edges[i] : edges[i + 1]] for i in range(len(off) - 1)]
            for i in named:
                each[i] = np.array([*self._encode(data[off[i] : off[i + 1]].tobytes()), end_id], np.uint32)
            out, edges = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return out, edges


def word_pieces(path: str) -> WordPieces:
    """The worker's own; it is kept between tasks."""
    return kept((WordPieces, path), lambda: WordPieces(path))


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 1, loss_of: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row a piece.

    `tokenizer` is the path of a vocabulary file. `loss_of` marks a document's loss-bearing
    ids (all of them, if not given). The bins of partition p are numbered from p * 2^32."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, packer = word_pieces(tokenizer), Packer(limits)
        base = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def note(bins: Iterator[tuple[int, list[Item]]]) -> None:
            for k, pieces in bins:
                at = 0
                for p in pieces:
                    rows.append((p.doc, p.start, len(p.ids), zlib.crc32(np.ascontiguousarray(p.ids, "<u4")), p.doc_tokens, base + k, at))
                    at += len(p.ids)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], schema=SCHEMA)
            rows.clear()
            return out

        for whole in batches:
            for batch in slices(whole, 2 << 20):
                data, off = utf8(batch.column("text"))
                flat, edge = words.ids(data, off, end_id)
                for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                    ids = flat[edge[i] : edge[i + 1]]
                    note(packer.add(Item(doc, 0, ids, None if loss_of is None else loss_of(ids), len(ids))))
                yield flush()
        note(packer.close())
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(eased(pack), DDL)


def padding(pieces: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row: sequences, ids and padding of a packing."""
    from pyspark.sql import functions as F

    size = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    whole = (F.col("n").bitwiseAND(F.col("n") - 1) == 0) | (F.col("n") == limits.tokens)
    return size.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("ids"), F.sum(F.when(whole, 0).otherwise(limits.tokens - F.col("n"))).alias("padding"))
