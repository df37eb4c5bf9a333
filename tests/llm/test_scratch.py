"""Scratch tables: none is left by a scope, and threads do not take each other's."""

import os
import threading

import numpy as np

from sparkloom.llm import decontamination, jaccard
from sparkloom.llm.common import components, scratch, scratch_root, written


def _tables(spark):
    return {f for f in os.listdir(scratch_root(spark).removeprefix("file:")) if f.startswith("sparkloom-")}


def test_a_scope_leaves_no_table(spark, docs):
    before = _tables(spark)
    with scratch():
        assert jaccard.near_duplicates(docs).count() and _tables(spark) - before
        edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
        assert {r.label for r in components(edges).collect()} == {0}
    assert _tables(spark) == before


def test_threads_keep_their_own_tables(spark):
    inside, wrote, counts = threading.Event(), threading.Event(), []

    def other():
        inside.wait(60)
        df = written(spark.range(50).toDF("n"))
        wrote.set()
        closed.wait(60)
        counts.append(df.count())

    closed = threading.Event()
    t = threading.Thread(target=other)
    t.start()
    with scratch():
        inside.set()
        assert wrote.wait(60)
    closed.set()
    t.join(60)
    assert counts == [50]


def test_filter_holds_all_keys(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "FILTER_BITS", 1 << 14)
    h = np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, 500)
    bits = decontamination._filter_of(spark.createDataFrame([(int(x),) for x in h], "h long"))
    assert decontamination._might_hold(bits, h.view(np.uint64)).all() and int(np.unpackbits(bits).sum()) == len(np.unique(h.view(np.uint64) % np.uint64(1 << 14)))


def test_equal_keys_are_not_taken_for_equal_words(spark, monkeypatch):
    """With a first hash that is always the same, windows still go by the second one."""
    monkeypatch.setattr(decontamination, "windows", lambda words, per, n: (lambda at: (at, np.full(len(at), n, np.uint64)))(np.flatnonzero(np.repeat(np.arange(len(per)), per)[: max(0, len(words) - n + 1)] == np.repeat(np.arange(len(per)), per)[n - 1 :])))
    data = [np.frombuffer(x.encode(), np.uint8) for x in ("one two three four", "one two three five", "One two three four")]
    seen = []
    for x in data:
        b = decontamination._window_rows(np.array([1]), x, np.array([0, len(x)]), [(True, 4)], 8, None)
        seen.append((b.column("h").to_pylist(), b.column("h2").to_pylist()))
    assert seen[0][0] == seen[1][0] == [4] and seen[0][1] != seen[1][1] and seen[0] == seen[2]
