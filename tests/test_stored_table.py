"""The stored table: batches that touch some buckets, reruns, broken writes, conflicts, earlier states."""

import os

import pytest

from sparkloom.operators.stored_table import CommitConflict, StoredTable


def _files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    schema = spark.createDataFrame([], "key string, value int, tags map<string,int>").schema
    return StoredTable(spark, str(tmp_path / "store"), schema, buckets=8)


def _writes(spark, rows):
    return spark.createDataFrame([(k, v, {"n": v}, s) for k, v, s in rows], "key string, value int, tags map<string,int>, seq long")


def _keys(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def _now(table, commit=None):
    return {r.key: r.value for r in table.read(commit).collect()}


def test_touched_buckets_alone_are_written(spark, table):
    assert _now(table) == {}
    assert table.apply("one", _writes(spark, [(f"k{i}", i, 1) for i in range(60)]), _keys(spark, ["none"]))
    before = _files(table.path)
    assert table.apply("two", _writes(spark, [("k3", 300, 1), ("k3", 301, 2), ("new", 5, 1)]), _keys(spark, ["k4", "k3", None]))
    got = _now(table)
    assert got["k3"] == 301 and got["new"] == 5 and "k4" not in got and got["k5"] == 5 and len(got) == 60
    after = _files(table.path)
    touched = {b for r in table.commits().where("batch = 'two'").collect() for b in r.buckets}
    assert 0 < len(touched) < 8
    assert before <= after and {f.split("/")[1] for f in after - before} == {f"bucket={b}" for b in touched}
    assert _now(table, 1)["k4"] == 4 and _now(table, 1)["k3"] == 3  # the earlier state is still there
    assert table.expire() > 0 and _now(table) == got


def test_a_batch_is_applied_once(spark, table):
    writes = _writes(spark, [("a", 1, 1)])
    assert table.apply("b", writes, _keys(spark, [])) and not table.apply("b", _writes(spark, [("a", 2, 9)]), _keys(spark, []))
    assert _now(table) == {"a": 1} and table.last_commit() == 1


def test_a_broken_write_changes_nothing(spark, table, monkeypatch):
    table.apply("one", _writes(spark, [(f"k{i}", i, 1) for i in range(20)]), _keys(spark, []))
    old = _now(table)

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(StoredTable, "_commit", stop)
        with pytest.raises(KeyboardInterrupt):
            table.apply("two", _writes(spark, [(f"k{i}", -1, 1) for i in range(20)]), _keys(spark, []))
    assert _now(table) == old
    assert table.apply("two", _writes(spark, [("k1", 7, 1)]), _keys(spark, ["k2"]))
    assert _now(table) == {k: v for k, v in old.items() if k != "k2"} | {"k1": 7}


def test_two_writers(spark, table, monkeypatch):
    """The second one to commit is told so and its rows are not seen."""
    take = StoredTable.last_commit
    with monkeypatch.context() as m:
        m.setattr(StoredTable, "last_commit", lambda self: 0)
        assert table.apply("one", _writes(spark, [("a", 1, 1)]), _keys(spark, []))
        with pytest.raises(CommitConflict):
            table.apply("two", _writes(spark, [("a", 2, 1)]), _keys(spark, []))
    assert take(table) == 1 and _now(table) == {"a": 1}
    assert table.apply("two", _writes(spark, [("a", 2, 1)]), _keys(spark, [])) and _now(table) == {"a": 2}


def test_empty_buckets_and_batches(spark, table):
    table.apply("one", _writes(spark, [("a", 1, 1)]), _keys(spark, []))
    assert table.apply("gone", _writes(spark, []), _keys(spark, ["a"])) and _now(table) == {}
    assert table.apply("nothing", _writes(spark, []), _keys(spark, [])) and _now(table) == {} and table.last_commit() == 3
    with pytest.raises(Exception, match="no key"):
        table.apply("bad", _writes(spark, [(None, 1, 1)]), _keys(spark, []))
