"""Benchmark decontamination by template windows.

Words are turned into templates: numbers, names (runs of capitalised words, one placeholder
a run) and units behind a number become typed placeholders, other words are lower-cased. A
capitalised word that begins a sentence is read both ways: as a plain word, and as a name or
the first word of one. Windows of
`n` template words of the benchmark are hash-joined with those of the documents. Hits of one
document with one item on one alignment are then read together: the values in the item's
slots must map to the document's one to one, as they do in a copy and in a question that was
given new parameters, but not in text that merely has the same frame. The plain words of
windows, without case, are hash-joined as well. The mapping is tested over all hits, and over
those alone that read no sentence's first word as a name: either will do. A run of several
words that begins a sentence has no value in the mapping, as its first word may be no name.

A document is contaminated by an item if a window's words stand there one for one, or if the
mapping is consistent and the hits cover `least` of the item's template windows. Items
shorter than a window are one window. Template windows with less than half of literal words
say too little and are left out, as are the templates of items under SHORTEST words; their
words count all the same. A row's coverage is the larger of the words' and the templates'.

Defined results: null and empty texts have no windows. Repeated rows (one doc_id) are one
document. Rows with a null id take no part, as the result could not name them. Only doc_id,
item_id and the texts are read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import LOWER, NO_WORD, bounded_rows, eased, mix64, slices, span_hash, utf8, word_spans, written

WINDOW = 8
#: Items have to have this many words for a template; shorter ones are found by their words.
SHORTEST = 4
#: Benchmark windows, repeats included, that may travel to every executor: a row of some 150
#: bytes for the join, 8 bytes and a table of 64 bits for the filter.
MOST_BROADCAST = 500_000

#: Words that are units behind a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles g kg mg t ton tons oz lb lbs pound pounds ml l liter liters litre litres "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents usd eur percent degree degrees c f k w kw v a hz khz mhz ghz b kb mb gb tb j kj cal kcal pa kpa mph kmh"
).split()
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))
#: Readings of windows that a task holds at once.
BLOCK = 1 << 19
_JOINS = np.array([chr(b) in " \t-'" for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_STOP = np.array([b in b".!?\n\r:;" for b in range(256)])


def _hashes(words: list[str]) -> np.ndarray:
    data, off = utf8(pa.array(words))
    return span_hash(data, off[:-1], off[1:])


_UNIT_HASH = np.sort(_hashes(UNITS))


def _lower_table() -> np.ndarray:
    """Lower case of the code points under 0x10000 whose lower case has as many UTF-8 bytes."""
    out = np.arange(0x10000)
    for i in range(0x80, 0x10000):
        x = chr(i).lower()
        if len(x) == 1 and ord(x) != i and ord(x) >= 0x80 and (ord(x) < 0x800) == (i < 0x800) and ord(x) < 0x10000:
            out[i] = ord(x)
    return out


_LOWER_POINT = _lower_table()


def fold(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes in lower case, letters in place."""
    low = LOWER[data]
    more = (data & 0xC0) == 0x80
    two = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] < 0xE0) & more[1:])
    point = _LOWER_POINT[((data[two] & 31).astype(np.int64) << 6) | (data[two + 1] & 63)]
    low[two], low[two + 1] = 0xC0 | (point >> 6), 0x80 | (point & 63)
    three = np.flatnonzero((data[:-2] >= 0xE0) & (data[:-2] < 0xF0) & more[1:-1] & more[2:])
    point = _LOWER_POINT[((data[three] & 15).astype(np.int64) << 12) | ((data[three + 1] & 63).astype(np.int64) << 6) | (data[three + 2] & 63)]
    low[three], low[three + 1], low[three + 2] = 0xE0 | (point >> 12), 0x80 | ((point >> 6) & 63), 0x80 | (point & 63)
    return low


@dataclass
class Words:
    """The words of texts laid end to end; ends are places of words, exclusive."""

    per: np.ndarray  # words per text
    own: np.ndarray  # hashes of the words, in lower case
    code: np.ndarray  # template codes; a sentence's first word as a plain word
    slot: np.ndarray  # is the code a placeholder
    after: np.ndarray  # where a window goes on behind the code
    opener: np.ndarray  # a capitalised word that begins a sentence
    run: np.ndarray  # end of the run of capitalised words from here
    value: np.ndarray  # a placeholder's value
    inner: np.ndarray  # inside of a name, so no window begins here
    group: np.ndarray  # place in the text, a run with its opener counted once
    low: np.ndarray  # the bytes in lower case
    begin: np.ndarray  # where the words begin and end there
    end: np.ndarray


def template(data: np.ndarray, off: np.ndarray) -> Words:
    low = fold(data)
    between = NO_WORD[data]
    # a full stop or comma between two digits is part of a number
    point = np.zeros(len(data), bool)
    if len(data) > 2:
        point[1:-1] = ((data[1:-1] == 44) | (data[1:-1] == 46)) & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
    classes = np.where(between & ~point, np.uint8(32), np.uint8(97))
    s, e, per = word_spans(classes, NO_WORD, off)
    h = span_hash(low, s, e)
    first = np.zeros(len(s) + 1, bool)
    first[np.concatenate([[0], np.cumsum(per)])] = True
    stops = np.concatenate([[0], np.cumsum(_STOP[data] & ~point)])
    opens = first[:-1].copy()
    opens[1:] |= stops[s[1:]] > stops[e[:-1]]
    number = _DIGIT[data[s]]
    upper = ((data[s] >= 65) & (data[s] <= 90)) | ((data[s] == 0xC3) & (data[np.minimum(s + 1, len(data) - 1)] <= 0x9E))
    unit = np.zeros(len(s), bool)
    at = np.minimum(np.searchsorted(_UNIT_HASH, h), len(_UNIT_HASH) - 1)
    unit[1:] = (_UNIT_HASH[at] == h)[1:] & number[:-1] & ~first[1:-1]
    capital = upper & ~number & ~unit
    name, opener = capital & ~opens, capital & opens
    # a name goes on over blanks, hyphens and apostrophes
    parts = np.concatenate([[0], np.cumsum(between & ~_JOINS[data])])
    linked = np.zeros(len(s), bool)
    linked[1:] = name[1:] & capital[:-1] & (parts[s[1:]] == parts[e[:-1]])
    heads = np.append(np.flatnonzero(~linked), len(s))
    place = np.arange(len(s))
    run = np.where(capital, heads[np.searchsorted(heads, place, "right")] if len(s) else place, place + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
    group = np.cumsum(~linked) - 1
    start = np.cumsum(per) - per
    inner = linked.copy()
    inner[1:] &= ~opener[:-1]
    return Words(
        per, h, np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, h))), number | name | unit, np.where(name, run, place + 1), opener, run,
        (sums[run] - sums[:-1]).view(np.int64), inner, group - np.repeat(group[np.minimum(start, len(s) - 1)] if len(s) else start, per), low, s, e,
    )


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def windows(words: np.ndarray, per: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the windows of n words that no text's end cuts."""
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * _FACTOR + words[k : k + len(h)]
    text = np.repeat(np.arange(len(per)), per)
    at = np.flatnonzero(text[: len(h)] == text[n - 1 :])
    return at, mix64(h[at])


def template_windows(w: Words, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Size, first words, ends, hashes and readings of the template windows that no text's end
    cuts and that have enough literal words, in every reading. Bit k of a reading says that
    template word k is a sentence's first word taken for a name. Placeholders may be half of a
    window, its first word not counted."""
    if not sizes or not len(w.own):
        return
    most = max(sizes)
    stop = np.repeat(np.cumsum(w.per), w.per)
    begin = np.flatnonzero(~w.inner)
    # windows read both ways at every opener, so starts go in blocks by what they may become
    openers = np.concatenate([[0], np.cumsum(w.opener)])
    heads = np.append(np.flatnonzero(~w.inner), len(w.own))
    end = heads[np.minimum(np.arange(len(begin)) + 2 * most, len(heads) - 1)]
    cost = np.cumsum(2.0 ** np.minimum(openers[end] - openers[begin], most))
    cuts = np.unique(np.append(np.searchsorted(cost, np.arange(0, cost[-1], BLOCK)), len(begin)))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        a = begin[lo:hi]
        p, h, slots, read = a, np.zeros(len(a), np.uint64), np.zeros(len(a), np.int8), np.zeros(len(a), np.int32)
        for k in range(most):
            live = p < stop[a]
            if not live.all():
                a, p, h, slots, read = (x[live] for x in (a, p, h, slots, read))
            h = h * _FACTOR
            o = np.flatnonzero(w.opener[p])
            more = a[o], w.run[p[o]], h[o] + _NAME, slots[o] + np.int8(k > 0), read[o] | np.int32(1 << k)
            less = a, w.after[p], h + w.code[p], slots + w.slot[p] if k else slots, read
            a, p, h, slots, read = (np.concatenate(x) for x in zip(less, more, strict=True)) if len(o) else less
            few = 2 * slots <= most
            if not few.all():
                a, p, h, slots, read = (x[few] for x in (a, p, h, slots, read))
            if k + 1 in sizes:
                good = 2 * slots <= k + 1
                yield k + 1, a[good], p[good], mix64(h[good] + np.uint64(k + 1)), read[good]


def _values(w: Words, at: np.ndarray, size: np.ndarray, read: np.ndarray) -> pa.ListArray:
    """The values of the windows' placeholders in their order; null for a run of several words
    that an opener begins, and for the rest of it where a window begins behind the opener."""
    most = int(size.max(initial=0))
    slot, known, value = np.zeros((len(at), most), bool), np.ones((len(at), most), bool), np.zeros((len(at), most), np.int64)
    p = at.copy()
    for k in range(most):
        on = np.flatnonzero(k < size)
        q = p[on]
        named = (read[on] >> k & 1).astype(bool)
        slot[on, k] = named | w.slot[q]
        known[on, k] = ~named | (w.run[q] == q + 1)
        if k == 0:
            known[on, k] &= ~((q > 0) & w.opener[q - 1] & (w.run[q - 1] > q))
        value[on, k] = w.value[q]
        p[on] = np.where(named, w.run[q], w.after[q])
    ends = np.concatenate([[0], np.cumsum(slot.sum(axis=1))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(value[slot], mask=~known[slot]))


_HIT = "h long, h2 long, lit boolean, id long, at int, n int, strict boolean, v array<long>"
#: Keys that are wanted, if they are few, and a bit for each that might be.
_Wanted = tuple[np.ndarray | None, np.ndarray] | None
#: Bits of that filter where the keys themselves are too many to be sent: of fixed size, 16 MB.
FILTER_BITS = 1 << 27


def _might_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & np.uint64(8 * len(bits) - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _filter_of(items: DataFrame) -> np.ndarray:
    """A bit for the key of every window of the items; combined by Spark, so the driver gets no more than the filter's own words."""
    place = F.col("h").bitwiseAND(FILTER_BITS - 1)
    words = items.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, int((h & {FILTER_BITS - 1}) & 63))")).alias("x"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column("w").to_numpy(zero_copy_only=False)] = batch.column("x").to_numpy(zero_copy_only=False)
    return out.view(np.uint8)


def _second(w: Words, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A second hash of windows of words, by other hashes of the words, so that equal windows are told by 128 bits."""
    if not len(at):
        return np.zeros(0, np.int64)
    own = span_hash(w.low, w.begin, w.end, 1)
    h = size.astype(np.uint64)
    for k in range(int(size.max())):
        on = np.flatnonzero(k < size)
        h[on] = mix64(h[on] * _FACTOR + own[at[on] + k])
    return h.view(np.int64)


def _window_rows(ids: np.ndarray, data: np.ndarray, off: np.ndarray, sizes: list[tuple[bool, int]] | None, n: int, wanted: _Wanted) -> pa.RecordBatch:
    """Rows of windows of words (lit) and of templates: for documents every kind and length in `sizes`; for items (sizes None) those that their lengths call for."""
    w = template(data, off)
    first = np.cumsum(w.per) - w.per
    text = np.repeat(np.arange(len(w.per)), w.per)
    if sizes is None:
        sizes, whole = [*((True, k) for k in range(1, n + 1)), *((False, k) for k in range(2, n + 1))], True
    else:
        whole = False
    parts = []

    def add(lit: bool, size: int, at: np.ndarray, end: np.ndarray, h: np.ndarray, read: np.ndarray) -> None:
        if whole:
            # windows of n, or the text as one window; of few template words some have to be literal
            fit = (size == n) | ((at == first[text[at]]) & (end == (first + w.per)[text[at]]))
            if not lit and size < n:
                fit = np.broadcast_to(fit, at.shape) & (w.per[text[at]] >= SHORTEST)
                if size < SHORTEST:
                    fit[fit] = np.diff(_values(w, at[fit], np.full(int(fit.sum()), size), read[fit]).offsets.to_numpy()) <= size - 2
            at, h, read = (x[np.broadcast_to(fit, at.shape)] for x in (at, h, read))
        if wanted is not None:
            keys, bits = wanted
            maybe = _might_hold(bits, h)
            at, h, read = at[maybe], h[maybe], read[maybe]
            if keys is not None:
                k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                at, h, read = (x[keys[k] == h] for x in (at, h, read))
        if lit and size < SHORTEST:
            # one or two words may stand in a text very often; once says all
            order = np.lexsort((at, h, text[at]))
            once = np.ones(len(order), bool)
            once[1:] = (h[order][1:] != h[order][:-1]) | (text[at[order]][1:] != text[at[order]][:-1])
            at, h, read = (x[order][once] for x in (at, h, read))
        parts.append((h, at, read, np.full(len(at), size), np.full(len(at), lit)))

    for lit, size in sizes:
        if lit:
            at, h = windows(w.own, w.per, size)
            add(True, size, at, at + size, h, np.zeros(len(at), np.int32))
    for found in template_windows(w, [k for lit, k in sizes if not lit]):
        add(False, *found)
    h, at, read, size, lit = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, bool))
    # template windows are placed by runs, as a name of one word may stand for one of two
    place = np.where(lit, at - first[text[at]], w.group[at]) if len(at) else at
    second = np.zeros(len(at), np.int64)
    second[lit] = _second(w, at[lit], size[lit])
    columns = [
        pa.array(h.view(np.int64)), pa.array(second), pa.array(lit), pa.array(ids[text[at]]), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32)),
        pa.array(read == 0), _values(w, at, np.where(lit, 0, size), read),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["h", "h2", "lit", "id", "at", "n", "strict", "v"])


def _rows(df: DataFrame, key: str, sizes: list[tuple[bool, int]] | None, n: int, wanted: _Wanted) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1 << 20):
                yield _window_rows(b.column("id").to_numpy(zero_copy_only=False).astype(np.int64), *utf8(b.column("text")), sizes, n, wanted)

    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), "text").mapInArrow(eased(run), _HIT)


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, least: float = 0.5, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, coverage, n_exact, n_slots, consistent: a row for each contaminated pair.

    The benchmark's window hashes filter the documents' windows where they are made, exactly if
    there are at most `most_broadcast` of them; beyond that a filter of fixed size lets pass
    what may be one of them, and both sides are shuffled. Windows of words are equal where
    two hashes of 64 bits are."""
    items = written(_rows(benchmark, "item_id", None, n, None))
    few = items.count() <= most_broadcast
    sizes = sorted((r["lit"], r["n"]) for r in items.select("lit", "n").distinct().collect())
    known = bounded_rows(items.select("h").distinct(), most_broadcast) if few else None
    if known is not None:
        keys = np.unique(np.array([r["h"] for r in known], np.int64).view(np.uint64)) if known else np.zeros(1, np.uint64)
        bits = np.zeros(1 << max(10, (64 * len(keys)).bit_length()), bool)
        bits[(keys & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        wanted = keys, np.packbits(bits, bitorder="little")
    else:
        wanted = None, _filter_of(items)
    hits = _rows(docs, "doc_id", sizes, n, wanted)
    per_item = items.groupBy("id", "lit").agg(F.countDistinct("at").alias("item_windows"))
    left = items.join(per_item, ["id", "lit"]).select("h", "h2", "lit", "n", F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("strict").alias("item_strict"), F.col("v").alias("item_v"), "item_windows")
    pairs = hits.join(F.broadcast(left) if known is not None else left, ["h", "h2", "lit", "n"])
    pairs = pairs.select("item_id", F.col("id").alias("doc_id"), "lit", "item_at", "item_windows", (F.col("at") - F.col("item_at")).alias("shift"), (F.col("strict") & F.col("item_strict")).alias("strict"), F.arrays_zip(F.col("item_v").alias("a"), F.col("v").alias("b")).alias("slots"))
    # an item's length bounds what is gathered for one alignment
    grouped = pairs.groupBy("doc_id", "item_id", "lit", "shift", "item_windows")
    # over all hits, and over the strict ones
    both = {k: (F.collect_set(F.when(on, F.col("item_at"))), F.collect_set(F.when(on, F.col("slots")))) for k, on in (("all", F.lit(True)), ("strict", F.col("strict")))}
    found = grouped.agg(*(F.struct(F.size(at).alias("n_windows"), F.array_distinct(F.flatten(v)).alias("map")).alias(k) for k, (at, v) in both.items()))
    found = found.select("doc_id", "item_id", "lit", "item_windows", F.explode(F.array("all", "strict")).alias("s")).where("s.n_windows > 0")
    found = found.select("doc_id", "item_id", "lit", "item_windows", "s.n_windows", F.filter("s.map", lambda x: x["a"].isNotNull() & x["b"].isNotNull()).alias("map"))
    one_to_one = (F.size("map") == F.size(F.array_distinct(F.col("map.a")))) & (F.size("map") == F.size(F.array_distinct(F.col("map.b"))))
    found = found.select("doc_id", "item_id", "lit", "n_windows", "item_windows", (F.col("n_windows") / F.col("item_windows")).alias("coverage"), F.size("map").alias("n_slots"), one_to_one.alias("consistent"))
    found = found.withColumn("ok", F.col("lit") | (F.col("consistent") & (F.col("coverage") >= least)))
    # the best alignment of words and the best of templates
    row = F.struct("ok", "n_windows", "consistent", "n_slots", "item_windows", "coverage")
    found = found.groupBy("doc_id", "item_id").agg(F.max(F.when(F.col("lit"), row)).alias("w"), F.max(F.when(~F.col("lit"), row)).alias("t")).where("w.ok or t.ok")
    more = F.when(F.col("t").isNull() | (F.col("w.coverage") > F.col("t.coverage")), F.col("w")).otherwise(F.col("t"))
    found = found.withColumn("c", more).select(
        "doc_id", "item_id", "c.n_windows", "c.item_windows", "c.coverage", F.coalesce("w.n_windows", F.lit(0)).alias("n_exact"), F.coalesce("t.n_slots", F.lit(0)).alias("n_slots"), F.coalesce("t.consistent", F.lit(True)).alias("consistent")
    )
    return found
