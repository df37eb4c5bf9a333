"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than the next one. Leftmost S suffixes
are sorted through the substrings between them, recursively where substrings repeat, and
induce the order of all others. Over bytes, a whole bucket is induced by a few array
operations: what a bucket's entries place in later buckets does not depend on each other,
and what they place in their own bucket is taken in waves. Reduced strings, with alphabets
as large as they are, are induced entry by entry.
"""

from __future__ import annotations

import numpy as np

from sparkloom.llm.common import eights, same_spans, take_eight


def _classify(t: np.ndarray) -> np.ndarray:
    """Which suffixes of t (its last symbol the unique smallest) are of type S."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    s = np.ones(n, bool)
    s[:-1] = step[at] > 0
    return s


def _deal(places: list[list[np.ndarray]], p: np.ndarray, symbols: np.ndarray) -> None:
    """Appends the positions to their symbols' buckets, in order."""
    if not len(p):
        return
    order = np.argsort(symbols, kind="stable")
    cut = np.flatnonzero(np.diff(symbols[order])) + 1
    for part in np.split(order, cut):
        places[symbols[part[0]]].append(p[part])


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The order of all suffixes that the order of `lms` (sorted within buckets) induces."""
    n = len(t)
    none = np.zeros(0, np.int64)
    small = t.astype(np.int16)
    of = small[lms]
    groups: list[list[np.ndarray]] = [[] for _ in range(size)]
    _deal(groups, lms, of)
    l_places: list[list[np.ndarray]] = [[] for _ in range(size)]
    l_done: list[np.ndarray] = [none] * size
    for c in range(size):
        waves, away = [], []
        wave = np.concatenate(l_places[c]) if l_places[c] else none
        while len(wave):
            waves.append(wave)
            p = wave[wave > 0] - 1
            p = p[~is_s[p]]
            same = small[p] == c
            away.append(p[~same])
            wave = p[same]
        l_done[c] = np.concatenate(waves) if waves else none
        for g in groups[c]:
            away.append(g[g > 0] - 1)
        if away:
            p = np.concatenate(away)
            _deal(l_places, p, small[p])
    s_places: list[list[np.ndarray]] = [[] for _ in range(size)]
    s_places[int(t[n - 1])].append(np.array([n - 1]))
    out: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):
        waves, away = [], []
        wave = np.concatenate(s_places[c]) if s_places[c] else none
        while len(wave):
            waves.append(wave)
            p = wave[wave > 0] - 1
            p = p[is_s[p] & (small[p] <= small[p + 1])]
            same = small[p] == c
            away.append(p[~same])
            wave = p[same]
        s = np.concatenate(waves) if waves else none
        p = l_done[c][::-1]
        p = p[p > 0] - 1
        away.append(p[is_s[p]])
        p = np.concatenate(away)
        _deal(s_places, p, small[p])
        out += [s, l_done[c][::-1]]
    return np.concatenate(out)[::-1]


def _reduce(r: list[int], top: int) -> list[int]:
    """Induced sorting, entry by entry, of a string over 0..top whose last symbol is the unique smallest."""
    n = len(r)
    if n == 1:
        return [0]
    is_s = [True] * n
    for i in range(n - 2, -1, -1):
        is_s[i] = r[i] < r[i + 1] or (r[i] == r[i + 1] and is_s[i + 1])
    lms = [i for i in range(1, n) if is_s[i] and not is_s[i - 1]]
    count = [0] * (top + 2)
    for c in r:
        count[c + 1] += 1
    for c in range(top + 1):
        count[c + 1] += count[c]

    def induce(order: list[int]) -> list[int]:
        sa = [-1] * n
        tail = count[1:]
        for i in reversed(order):
            tail[r[i]] -= 1
            sa[tail[r[i]]] = i
        head = count[:-1]
        for i in range(n):
            j = sa[i] - 1
            if j >= 0 and not is_s[j]:
                c = r[j]
                sa[head[c]] = j
                head[c] += 1
        tail = count[1:]
        for i in range(n - 1, -1, -1):
            j = sa[i] - 1
            if j >= 0 and is_s[j]:
                c = r[j]
                tail[c] -= 1
                sa[tail[c]] = j
        return sa

    # Leftmost-smaller substrings by their symbols; where one begins another, its end is of
    # type S there and so sorts behind what goes on as type L.
    ends = [*lms[1:], n - 1]
    spans = [(*r[i : e + 1], top + 1) for i, e in zip(lms, ends, strict=True)]
    rank = {x: k for k, x in enumerate(sorted(set(spans)))}
    names = [rank[x] for x in spans]
    name = len(rank) - 1
    if name + 1 == len(lms):
        order = [0] * len(lms)
        for k, x in enumerate(names):
            order[x] = lms[k]
    else:
        order = [lms[k] for k in _reduce(names, name)]
    return induce(order)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a byte string in sorted order."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    t = np.zeros(n + 1, np.int16)
    t[:-1] = text
    t[:-1] += 1
    is_s = _classify(t)
    is_lms = np.zeros(n + 1, bool)
    is_lms[1:] = is_s[1:] & ~is_s[:-1]
    lms = np.flatnonzero(is_lms)
    sa = _induce(t, is_s, lms, 257)
    if len(lms) > 1:
        found = sa[is_lms[sa]]
        end = np.full(n + 1, n, np.int64)
        end[lms[:-1]] = lms[1:]
        length = np.minimum(end[found] + 1, n) - found  # the end marker is at n alone
        same = np.zeros(len(found), bool)
        alike = np.flatnonzero((length[1:] == length[:-1]) & (end[found[1:]] < n) & (end[found[:-1]] < n)) + 1
        same[alike] = same_spans(text, found[alike], found[alike - 1], length[alike])
        name = np.cumsum(~same) - 1
        if name[-1] + 1 < len(lms):
            named = np.zeros(n + 1, np.int64)
            named[found] = name
            lms = lms[np.array(_reduce(named[lms].tolist(), int(name[-1])), np.int64)]
        else:
            lms = found
        sa = _induce(t, is_s, lms, 257)
    return sa[1:]


SPARSE = 16


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """By text position: bytes, up to `most`, shared with the suffix that sorts before this one.

    Every SPARSE-th position is compared from its start; the next ones share at most one
    byte less each, and are compared from there on."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    view = eights(text)

    def extend(live: np.ndarray) -> None:
        live = live[(before[live] >= 0) & (out[live] < most)]
        while len(live):
            o = out[live]
            a, b = live + o, before[live] + o
            x = take_eight(view, np.minimum(a, n)) ^ take_eight(view, np.minimum(b, n))
            low = x & (~x + np.uint64(1))
            got = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
            got = np.minimum(got, np.minimum(n - a, n - b).clip(0))
            out[live] = o + got
            live = live[(got == 8) & (o + 8 < most)]

    at = np.arange(n)
    first = at[::SPARSE]
    extend(first)
    rest = at % SPARSE
    out = np.maximum(np.minimum(out[at - rest], most) - rest, 0) if n else out
    out = np.where(before < 0, 0, out)
    extend(at)
    return np.minimum(out, most).astype(np.int32)
