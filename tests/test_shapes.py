"""Versions as of a commit, one ordered document, table functions, responses and events of odd shapes."""

import bisect
import json
import random

import pytest

from sparkloom.functions import source_code, tables
from sparkloom.operators import asof, store
from sparkloom.sources import records


def test_versions_as_of_a_commit(spark):
    rng = random.Random(4)
    versions = sorted({(f"f{rng.randrange(6)}", rng.randrange(400)) for _ in range(300)})
    versions = [(f, c, None if rng.random() < 0.2 else f"{f}@{c}") for f, c in versions] + [("hot", c, f"hot@{c}") for c in range(0, 5000, 3)]
    asks = [(i, f"f{rng.randrange(8)}", rng.randrange(-5, 420)) for i in range(500)] + [(1000 + i, "hot", rng.randrange(6000)) for i in range(300)] + [(7, "f1", 50), (None, None, 3)]
    at = {}
    for f, c, x in sorted(versions, key=lambda v: v[:2]):
        at.setdefault(f, ([], []))[0].append(c)
        at[f][1].append(x)

    def plain(f, c):
        have = at.get(f, ([], []))
        k = bisect.bisect_right(have[0], c)
        return have[1][k - 1] if k else None

    got = asof.versions_as_of(spark.createDataFrame(asks, "i int, file_path string, commit int"), spark.createDataFrame(versions, "file_path string, commit int, content string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(i, f, c, plain(f, c)) for i, f, c in asks], key=str)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_one_document_over_part_files(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"src/{rng.randrange(99)}.py::f{i}", "s,\"é\n", "python", f"f{i}", None, "t", [f"test_{k}" for k in range(i % 4)]) for i in range(300)]
    ddl = "key string, source_file string, language string, function_name string, test_id string, target_file string, test_names array<string>"
    df = spark.createDataFrame(rows, ddl).repartition(5)
    path = tmp_path / "doc"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.save_document(df, str(path), str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted(path.glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    fields = [x.split(" ")[0] for x in ddl.split(", ")][1:]
    assert len(parts) > 1 and text == json.dumps({r[0]: dict(zip(fields, r[1:], strict=True)) for r in rows}, indent=2, sort_keys=True) + "\n"
    assert sorted(map(tuple, records.read_document(spark, str(path)).collect()), key=str) == sorted(rows, key=str)
    (tmp_path / "one.json").write_text(text)
    assert sorted(map(tuple, records.read_mapping(spark, str(tmp_path / "one.json")).collect()), key=str) == sorted(rows, key=str)
    assert records.read_document(spark, str(tmp_path / "one.json")).count() == 300
    store.save_document(df.where("false"), str(path), str(tmp_path), overwrite=True)
    assert "".join(p.read_text() for p in sorted(path.glob("part-*"))) == "{}\n" and records.read_document(spark, str(path)).count() == 0


def test_table_functions(spark):
    tables.register(spark)
    code = {"python": "class A:\n    def m(self):\n        return go(1)\n\ndef f(x):\n    pass\n", "typescript": "class B {\n  run(a) { return /}/ }\n}\n", "javascript": "function g(a) {\n}\n"}
    spark.createDataFrame([*code.items(), ("python", None), ("python", "def (")], "language string, content string").createOrReplaceTempView("sources")
    rows = spark.sql("SELECT s.language, f.function_name, f.called_functions FROM sources s, LATERAL python_functions(s.content) f WHERE s.language = 'python'").collect()
    assert sorted((r.function_name, r.called_functions) for r in rows) == [("A.m", ["go"]), ("f", [])]
    rows = spark.sql("SELECT f.* FROM sources s, LATERAL script_functions(s.content, s.language) f WHERE s.language <> 'python'").collect()
    assert sorted(r.signature for r in rows) == ["function g(a)", "function run(a)"]
    assert len(source_code.script_functions(code["typescript"], "typescript")) == 1
    rows = spark.sql("SELECT f.function_name FROM sources s, LATERAL functions_without_diff(s.content, s.language) f").collect()
    assert sorted(r.function_name for r in rows) == ["A_m", "B_run", "g"]
    rows = spark.sql("SELECT s.language, c.class_source FROM sources s, LATERAL class_source(s.content, s.language, CASE s.language WHEN 'python' THEN 'A' ELSE 'B' END) c").collect()
    assert {r.language: r.class_source for r in rows} == {"python": code["python"].split("\n\n")[0], "typescript": code["typescript"].strip()}


def test_responses_of_any_shape(spark, tmp_path):
    bodies = ['{"choices": [{"message": {"content": [{"text": "a"}, {"type": "image"}, {"text": "b"}]}}]}', '{"choices": [{"message": {"content": "[c]"}}]}', '{"choices": [], "output_text": "d"}', '{"choices": [{"text": "e", "message": {"content": null}}]}', "not json", '{"x": 1}', None, '{"choices": [{"message": {"content": 7}}]}']
    df = records.with_response_content(spark.createDataFrame(list(enumerate(bodies)), "i int, body string"))
    assert [(r.content, r.bad_json) for r in df.orderBy("i").collect()] == [("ab", False), ("[c]", False), ("d", False), ("e", False), (None, True), (None, False), (None, False), ("7", False)]
    (tmp_path / "r.json").write_text("\n".join(json.dumps({"target_id": i, "attempt": 1, "http_status": 200, "body": b}) for i, b in enumerate(bodies)))
    got = {r.target_id: (r.status, r.message) for r in records.read_responses(spark, str(tmp_path / "r.json")).collect()}
    assert got[4] == ("error", "no JSON") and got[5] == ("error", "empty response") and got[0] == ("answer", None)


def test_events_that_lack_something(spark):
    event = lambda x: spark.createDataFrame([(x,)], "payload string")
    good = '{"repository": {"full_name": "o/r"}, "number": "12", "pull_request": {"number": 0, "base": {"ref": "main"}, "head": {"ref": "b"}, "title": "T"}}'
    assert tuple(records.event_context(event(good)).first()) == ("o/r", 12, "main", "b", "T", None)
    for bad in ("{}", good.replace('"main"', '""'), good.replace('"12"', '"x"'), "no json"):
        with pytest.raises(Exception, match="missing|MALFORMED"):
            records.event_context(event(bad)).collect()


def test_native_checks_of_valid_contents_run_once_and_in_many_tasks(spark, tmp_path, monkeypatch):
    from sparkloom import code_queries, session

    monkeypatch.setattr(session.spread, "__defaults__", (100,))
    spark.range(2000).selectExpr("id AS c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    got = code_queries.q_valid_tests(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("todo|tbd") == 1
    at = plan.index("RepartitionByExpression")
    assert plan.index("todo|tbd") < at and plan[at:].split("]", 1)[1].startswith(", 20")
    valid = {k for k, x in enumerate(code_queries._TESTS) if x[4] == ""}
    assert {r.c_custkey for r in got.collect()} == {i for i in range(2000) if i % len(code_queries._TESTS) in valid}
