"""Runs of repeated words in texts, found on a harmonic grid.

A run of period p and at least `exponent` periods covers `exponent` neighbours of the grid
0, p, 2p, ...; so for every p the grid's neighbours are asked how far the text goes on the
same, forwards and backwards. All grids of a text have n log n places. The answers are range
minima over the common prefixes of a suffix array, and of the array of the reversed words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import WHITE, eased, runs, slices, utf8, word_spans

EXPONENT, LEAST_WORDS = 4, 6
#: Bytes of text that go through together, and places of the grid that are looked at in one step.
SLICE, STEP = 4 << 20, 1 << 20
BLOCK = 16

RESULT_DDL = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


# ---------------------------------------------------------------- longest common extensions


def suffix_order(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of integers and its inverse, by doubling; only suffixes that are not told apart yet are sorted on."""
    n = len(t)
    order = np.argsort(t, kind="stable")
    rank = np.empty(n, np.int64)
    slots, keys, k = np.arange(n), t[order].astype(np.int64), 0
    while True:
        edge = runs(keys)
        first = np.repeat(slots[edge[:-1]], np.diff(edge))
        rank[order[slots]] = first
        slots = slots[np.repeat(np.diff(edge) > 1, np.diff(edge))]
        if not len(slots):
            return order, rank
        k = max(1, 2 * k)
        at = order[slots]
        far = np.where(at + k < n, rank[np.minimum(at + k, n - 1)], -1)
        keys = rank[at] * (n + 1) + far + 1
        by = np.argsort(keys, kind="stable")
        order[slots], keys = at[by], keys[by]


def common_prefixes(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many symbols each suffix of `order` shares with the one before it; t ends with a symbol that stands nowhere else.

    Where the symbols in front of both suffixes are equal, one less is shared than by the
    suffixes one place earlier; only the others are compared, 2 n log n symbols in all."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    own = (at == 0) | (before <= 0) | (t[at - 1] != t[before - 1])
    own[1:] |= before[:-1] < 0
    shared = np.zeros(n, np.int64)
    live, width = np.flatnonzero(own & (before >= 0)), 8
    while len(live):
        after = shared[live][:, None] + np.arange(width)
        same = t[np.minimum(live[:, None] + after, n - 1)] == t[np.minimum(before[live][:, None] + after, n - 1)]
        whole = same.all(axis=1)
        shared[live] += np.where(whole, width, same.argmin(axis=1))
        live = live[whole]
        width = int(np.clip(STEP // max(1, len(live)), 8, 2 * width))
    last = np.maximum.accumulate(np.where(own, at, 0))
    return np.maximum(shared[last] - (at - last), 0)[order]


class Extensions:
    """Longest common extensions of pairs of places in t: minima of ranges of its common prefixes, by blocks and a sparse table of their minima."""

    def __init__(self, t: np.ndarray):
        order, self.rank = suffix_order(t)
        lcp = common_prefixes(t, order)
        fill = -len(lcp) % BLOCK
        self.lcp = np.concatenate([lcp, np.full(fill, np.iinfo(np.int32).max)]).astype(np.int32)
        rows = self.lcp.reshape(-1, BLOCK)
        self.head = np.minimum.accumulate(rows, axis=1).ravel()
        self.tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [rows.min(axis=1)]
        while 2 << (len(self.levels) - 1) <= len(rows):
            up, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(up[:-half], up[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that t has in common from i and from j on, i unlike j."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b)
        x, y = a // BLOCK, b // BLOCK
        out = np.where(x == y, np.iinfo(np.int32).max, np.minimum(self.tail[a], self.head[b]))
        near = np.flatnonzero(x == y)
        for k in range(BLOCK if len(near) else 0):
            out[near] = np.minimum(out[near], self.lcp[np.minimum(a[near] + k, b[near])])
        wide = np.flatnonzero(y - x > 1)
        level = np.frexp((y - x - 1)[wide].astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            q = wide[level == k]
            table = self.levels[k]
            out[q] = np.minimum(out[q], np.minimum(table[x[q] + 1], table[y[q] - (1 << k)]))
        return out.astype(np.int64)


# ---------------------------------------------------------------- the grid


def _grid(words: np.ndarray, start: np.ndarray, size: np.ndarray, exponent: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period): grid places with the same word at `exponent` neighbours, as every run has. At others the extension ends at once."""
    periods = np.where(size >= least, size // exponent, 0)
    text = np.repeat(np.arange(len(size)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    count = (size[text] - 1) // period - exponent + 2
    upto = np.cumsum(count)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, "right")))
        n = count[at:end]
        row = np.repeat(np.arange(at, end), n)
        p = period[row]
        place = start[text[row]] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * p
        for k in range(1, exponent):
            same = np.flatnonzero(words[place] == words[place + k * p])
            row, p, place = row[same], p[same], place[same]
        if len(row):
            yield text[row], place, p
        at = end


def find_runs(words: np.ndarray, size: np.ndarray, exponent: int = EXPONENT, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of texts laid end to end, by text, start and period.

    A run is a stretch whose smallest period is `period`, of max(least, exponent * period)
    words at least, that no word at either side goes on. Words are integers; suffix arrays
    are built of the texts that have any place of the grid to be asked."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    size = np.asarray(size, np.int64)
    start = np.cumsum(size) - size
    some = np.zeros(len(size), bool)
    for text, _, _ in _grid(words, start, size, exponent, least):
        some[text] = True
    asked = np.flatnonzero(some)
    best = np.zeros((0, 4), np.int64)
    if not len(asked):
        return tuple(best.T)
    # texts between marks that stand nowhere else, so that nothing extends beyond a text
    moved = np.zeros(len(size), np.int64)
    moved[asked] = 1 + np.cumsum(size[asked] + 1) - (size[asked] + 1) - start[asked]
    t = np.empty(1 + int((size[asked] + 1).sum()), np.int64)
    mark = int(words.max()) + 1
    t[0] = mark
    for k, d in enumerate(asked.tolist()):
        at = start[d] + moved[d]
        t[at : at + size[d]] = words[start[d] : start[d] + size[d]]
        t[at + size[d]] = mark + 1 + k
    forwards, backwards, last = Extensions(t), Extensions(np.ascontiguousarray(t[::-1])), len(t) - 1
    for text, place, p in _grid(words, start, np.where(some, size, 0), exponent, least):
        i = place + moved[text]
        right = i + p + forwards(i, i + p)
        left = i - backwards(last - i + 1, last - i - p + 1)
        keep = right - left >= np.maximum(least, exponent * p)
        rows = np.stack([text[keep], (left - moved[text])[keep], (right - left)[keep], p[keep]], axis=1)
        best = np.concatenate([best, rows])
        # a stretch that has a period has its multiples as well: the smallest one counts
        best = best[np.lexsort(best.T[::-1])]
        best = best[np.concatenate([[True], (np.diff(best[:, :3], axis=0) != 0).any(axis=1)])] if len(best) else best
    best[:, 1] -= start[best[:, 0]]
    return tuple(best[np.lexsort((best[:, 3], best[:, 1], best[:, 0]))].T)


# ---------------------------------------------------------------- documents


def word_ids(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts as one array, their numbers (equal words, equal numbers) and how many each text has."""
    s, e, size = word_spans(data, WHITE, off)
    ends = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(s), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[~WHITE[data]].tobytes())])
    return words, words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), size


def _collapse(batch: pa.RecordBatch, exponent: int, least: int) -> pa.RecordBatch:
    words, ids, size = word_ids(*utf8(batch.column("text")))
    text, start, length, period = find_runs(ids, size, exponent, least)
    first = np.cumsum(size) - size
    # words behind a run's first period go; how many runs take a word, by differences
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, first[text] + start + period, 1)
    np.add.at(cover, first[text] + start + length, -1)
    stays = np.cumsum(cover[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(stays)])
    ends = left[np.concatenate([[0], np.cumsum(size)])]
    kept = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(np.flatnonzero(stays))))
    spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
    found = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(size) + 1)), pa.int32()), spans)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), found, pc.binary_join(kept, " ")], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST_WORDS) -> DataFrame:
    """`docs` (doc_id, text, ...) to a row each: doc_id, n_words, runs (start, length and period in words, by start and period), collapsed.

    `collapsed` is the text without the words that any run repeats, joined by one space.
    Words stand between ASCII white space. Each row goes through on its own, so nothing is
    shuffled and repeated rows (also of one id, or of none) give a row each. Null, empty and
    blank texts have no words, no runs and an empty `collapsed`; an empty table gives no row.
    Other columns are left behind, whatever their names. A text is the unit of work: its
    arrays take about 150 bytes a word while it goes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE):
                yield _collapse(part, exponent, least)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(eased(run), RESULT_DDL)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of one document in ten (by the checksum of its id) the words from a place on repeat, as the contract of the query has it. No id, no change."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.size(words).cast("long")
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    whole = lambda x: x.cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, whole(a + 1), whole(p)), whole(F.floor((n - a + p - 1) / p))))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), whole(a)), F.slice(again, F.lit(1), whole(n - a))), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), planted).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The rows of periodic_runs as counts, the longest run (ties: the first, then the shortest period) and digests."""
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    best = F.when(F.size("runs") > 0, best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    n, p = -F.col("best.n"), F.col("best.period")
    return out.select("doc_id", "n_runs", F.col("best.start").alias("start"), n.alias("length"), p.alias("period"), F.floor(1000 * n / p).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
