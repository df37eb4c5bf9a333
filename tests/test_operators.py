"""Operators on small tables against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.source_code import extract_functions
from sparkloom.operators import attempts, budgets, changes, dedup, dependencies, discovery, logs, store, validation
from sparkloom.plans import generation
from sparkloom.sources import records
from sparkloom.streaming import responses

DIFF = """diff --git a/src/a.py b/src/a.py
--- a/src/a.py
+++ b/src/a.py
@@ -1,2 +1,3 @@
@@ -10 +12,0 @@
diff --git a/gone.py b/gone.py
+++ /dev/null
@@ -1,5 +0,0 @@
diff --git a/src/b.py b/src/b.py
+++ b/src/b.py
@@ -0,0 +7 @@
"""


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_changed_lines_and_impacted(spark):
    lines = changes.changed_lines(spark.createDataFrame([("d", DIFF)], "diff_id string, text string"))
    assert rows(lines, "file_path", "side", "line") == [("src/a.py", "added", 1), ("src/a.py", "added", 2), ("src/a.py", "added", 3), ("src/a.py", "removed", 1), ("src/a.py", "removed", 2), ("src/a.py", "removed", 10), ("src/b.py", "added", 7)]
    f = spark.createDataFrame([("src/a.py", "f", 2, 5), ("src/a.py", "g", 6, 9), ("src/c.py", "h", 1, 1)], "file_path string, function_name string, start_line int, end_line int")
    assert rows(changes.impacted(f, lines), "function_name") == [("f",), ("h",)]
    assert rows(changes.impacted(f, lines, empty_side="none"), "function_name") == [("f",)]


OLD = "def keep(a):\n    return a\n\ndef old_name(items, rate):\n    total = 0\n    for i in items:\n        total += i * rate\n    return total\n\ndef gone(x):\n    raise ValueError(x)\n"
NEW = "def keep(a, b):\n    return a + b\n\ndef new_name(items, rate):\n    total = 0\n    for i in items:\n        total += i * rate\n    return total\n\ndef fresh(q):\n    if q:\n        return {}\n"


def test_analysis(spark):
    files = spark.createDataFrame([("src/m.py", NEW, OLD), ("tests/t.py", NEW, OLD), ("readme.md", "x", "y")], "file_path string, content string, previous_source string")
    diff = spark.createDataFrame([("d", "+++ b/src/m.py\n@@ -1,12 +1,12 @@\n+++ b/tests/t.py\n@@ -1 +1 @@\n")], "diff_id string, text string")
    got = {r["function_name"]: r for r in generation.analyse(diff, files).collect()}
    assert {k: r["change_type"] for k, r in got.items()} == {"keep": "signature_change", "new_name": "rename", "fresh": "logic_change", "gone": "deletion"}
    assert got["new_name"]["previous_name"] == "old_name" and not got["new_name"]["should_generate"] and got["fresh"]["should_generate"]
    assert got["keep"]["skip_reason"] == "short_function_without_branches_or_validation"
    targets, kept = changes.targets_and_maintenance(generation.analyse(diff, files))
    assert rows(targets, "function_name") == [("fresh",)] and kept.count() == 2


def test_extraction_without_diff(spark):
    files = spark.createDataFrame([("a.py", "python", "class C:\n    def __repr__(self):\n        return 'x'\n    def run(self):\n        return 1\ndef e():\n    pass\n"), ("b.ts", "typescript", None)], "file_path string, language string, content string")
    assert rows(extract_functions(files, diff_free=True), "function_name", "change_type") == [("C_run", "added")]


def test_budgets(spark):
    rng = random.Random(1)
    data = [(t, i, rng.choice([0, 3, 5, 9])) for t in range(6) for i in range(8)] + [(9, 0, 50), (9, 1, 1)]
    df = spark.createDataFrame(data, "t int, i int, c int")

    def loop(budget, keep_first):
        out = []
        for t in {x[0] for x in data}:
            used = 0
            for _, i, c in sorted(x for x in data if x[0] == t):
                if used + c > budget and not (keep_first and i == 0):
                    break
                used += c
                out.append((t, i))
        return sorted(out)

    assert rows(budgets.prefix_within_budget(df, ["t"], ["i"], F.col("c"), 14), "t", "i") == loop(14, False)
    assert rows(budgets.prefix_within_budget(df, ["t"], ["i"], F.col("c"), 14, keep_first=True), "t", "i") == loop(14, True)
    data = [(0, i, rng.choice([0, 1, 2, 30])) for i in range(2000)]  # one hot group
    df = spark.createDataFrame(data, "t int, i int, c int")
    for budget in (0, 14, 500, 10_000):
        assert rows(budgets.prefix_within_budget(df, ["t"], ["i"], F.col("c"), budget), "t", "i") == loop(budget, False)
    blocks = spark.createDataFrame([(1, 0, 0, "a" * 9), (1, 0, 1, "b" * 5), (1, 0, 2, "c"), (1, 1, 0, "d"), (1, 1, 1, "e")], "target_id int, file_ordinal int, ordinal int, text string")
    assert budgets.capped_blocks(blocks, 3, 11).first()["kept"] == ["a" * 9, "d", "e"]
    items = spark.createDataFrame([(1, "fixed", 0, 10), (1, "request_rule", 0, 4), (1, "request_rule", 1, 4), (1, "dependency", 0, 3), (1, "dependency", 1, 7), (2, "fixed", 0, 99)], "target_id int, kind string, ordinal int, tokens int")
    out = budgets.evict_to_budget(items, 16)
    assert rows(out.where("evicted"), "kind", "ordinal") == [("dependency", 1), ("request_rule", 0), ("request_rule", 1)] and rows(out.where("skipped"), "target_id") == [(2,)]


def test_first_failure(spark):
    ok = "import unittest\ndef test_a():\n    assert 1\ndef test_b():\n    assert 2\n"
    cases = [
        ("", "python", "empty"), ("def test_a():", "python", "truncated"), ("x = f(((((1\n", "python", "truncated"), ("def test_a():\n    raise NotImplementedError", "python", "stub_body"),
        ("import your_module\n" + ok, "python", "fake_import_your_module"), ("from fake_pkg import x\n" + ok, "python", "placeholder_import"), ("import {a} from 'placeholder'\nf(() => {\n})", "javascript", "fake_import_js"),
        ("import a.b\nimport c.d\nimport e.f\n" + ok, "python", "too_many_suspicious_imports(3)"), ("# ***\n" + ok, "python", "banned_pattern"), ("expect(f).toThrowError()\n})", "javascript", "banned_js_pattern"),
        ("def test_a()\n    x\n", "python", "syntax_error"), ("x = 1\n", "python", "no_tests"), ("def test_a():\n    pass\n", "python", "test_count_out_of_range(1)"), (ok, "python", ""), (None, "python", "empty"),
        ("todo ***\nraise NotImplementedError", "python", "stub_body"),
    ]
    df = spark.createDataFrame([(i, c, lang, "src/app.py") for i, (c, lang, _) in enumerate(cases)], "i int, content string, language string, source_file string")
    assert [r[1] for r in rows(validation.validate(df), "i", "reason")] == [x[2] for x in cases]


def test_attempts(spark):
    seqs = {"a": "v", "b": "iv", "c": "iiv", "d": "iiiv", "e": "eeev", "f": "e" * 12, "g": "iee", "h": "e" * 12 + "v", "i": "eeiv"}
    name = {"v": "valid", "i": "invalid", "e": "error"}
    df = spark.createDataFrame([(k, n + 1, name[s], f"r{n}", k + str(n)) for k, q in seqs.items() for n, s in enumerate(q)], "target_id string, attempt int, status string, reason string, content string")

    def loop(q):
        last = "unknown"
        for n, s in enumerate(q[:12], 1):
            if s == "v":
                return True, n, ""
            if s == "i":
                last = f"r{n - 1}"
                if n >= 3:
                    return False, 12, "skipped_after_3_attempts"
        return False, 12, last

    assert rows(attempts.resolve_attempts(df), "target_id", "succeeded", "attempts", "reason") == sorted((k, *loop(q)) for k, q in seqs.items())


def test_dedup_and_store(spark):
    g = spark.createDataFrame([(0, "s", "f", "a b", "replace"), (1, "s", "g", "ab", "replace"), (2, "s", "h", "in side", "replace"), (3, "s", "h", "in side", "repair"), (4, "q", "z", "c", "replace"), (5, "s", "f", "", "replace")], "ordinal int, source_file string, function_name string, content string, generation_mode string")
    t = spark.createDataFrame([("s", "f", 0, None), ("s", "g", 0, "x"), ("s", "h", 0, "old"), ("s", "h", 1, "w inside w")], "source_file string, function_name string, ordinal int, existing_tests_text string")
    assert rows(dedup.filter_duplicates(g, t), "ordinal") == [(0,), (3,), (5,)]
    base = spark.createDataFrame([("s::a", 1), ("s::b", 2)], "key string, v int")
    w = spark.createDataFrame([("s::a", 5, 0), ("s::a", 6, 1), ("s::c", 7, 0)], "key string, v int, seq long")
    gone = store.maintenance_deletes(spark.createDataFrame([("rename", "s", "n", "b"), ("deletion", "s", "x", None)], "action_type string, source_file string, function_name string, previous_name string"))
    assert rows(store.upsert(base, w, gone), "key", "v") == [("s::a", 6), ("s::c", 7)] and store.deleted_count(base, gone).first()[0] == 1
    m = store.merge_artifacts(spark.createDataFrame([("s", 0, "import os\nimport pytest\n\ndef test_a():\n    import re"), ("s", 1, "import os\nx = 1")], "source_file string, ordinal int, content string")).first()["content"]
    assert m == "import unittest\nimport os\n\ndef test_a():\n    import re\n\n\nx = 1\n"
    tests = spark.createDataFrame([("s", 0, "from src.m import a, zz as q\nfrom os import (\n  path,\n)\nfrom src.n import zz\n\nfrom json import loads\nx = a\n  # c\n"), ("s", 1, None), ("q", 0, "from src.m import zz\ny")], "source_file string, ordinal int, content string")
    got = dict(rows(store.merge_artifacts(tests, spark.createDataFrame([("s", "a")], "source_file string, name string")), "source_file", "content"))
    assert got == {"s": "import unittest\nfrom json import loads\nfrom src.m import a\n\nx = a\n  # c\n", "q": "import unittest\nfrom src.m import zz\n\ny\n"}


def test_store_files(spark, tmp_path):
    kept = spark.createDataFrame([("s/a.py::f", "s/a.py", "python", "f", "f", "t/s/a/test_f.py", ["test_f_1"]), ("s/b.py::g", "s/b.py", "python", "g", "g", "t/s/b/test_g.py", [])], "key string, source_file string, language string, function_name string, test_id string, target_file string, test_names array<string>")
    store.save_mapping(kept, str(tmp_path / "m"), str(tmp_path))
    assert sorted(map(tuple, records.read_mapping(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, kept.collect())) and records.read_mapping(spark, str(tmp_path / "none")).count() == 0
    for path, fails in ((str(tmp_path / "m"), Exception), (str(tmp_path / "x/../../y"), ValueError)):
        with pytest.raises(fails):
            store.save_mapping(kept, path, str(tmp_path))
    assert rows(store.package_files(kept, "t"), "file_path") == [("t/__init__.py",), ("t/s/__init__.py",), ("t/s/a/__init__.py",), ("t/s/b/__init__.py",)]
    assert rows(store.emptied_folders(kept, kept.where("function_name = 'g'"), "t"), "folder") == [("t/s/b",)]
    assert store.as_json(kept).count() == 2


def test_readers(spark, tmp_path):
    (tmp_path / "d.diff").write_text(DIFF)
    (tmp_path / "paths.txt").write_text(" src\\a.py \n\nb.py\n")
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.py").write_text("x = 1\n")
    (tmp_path / "e.json").write_text('{"number": 4}')
    (tmp_path / "r.json").write_text('{"target_id": 1, "attempt": 1, "http_status": 200, "body": "{\\"output_text\\": \\"x\\"}"}\n{"target_id": 1, "attempt": 2, "http_status": 429, "body": "{}"}\n{"target_id": 1, "attempt": 3, "http_status": 200, "body": "{}"}\n')
    (tmp_path / "runs.json").write_text('{"run_id": 1, "ordinal": 0, "language": "python", "stdout": "a", "returncode": 0}\n{"run_id": 1, "ordinal": 1, "language": "ruby", "returncode": 1}\n')
    assert records.read_diffs(spark, str(tmp_path / "d.diff")).first()["text"] == DIFF
    assert rows(records.read_changed_paths(spark, str(tmp_path / "paths.txt")), "file_path") == [("b.py",), ("src/a.py",)]
    files = records.read_files(spark, str(tmp_path / "f"))
    assert files.first()["content"] == "x = 1\n"
    named = files.select(F.lit("a.py").alias("file_path"), "content")
    assert rows(records.with_contents(spark.createDataFrame([("a.py",), ("no.py",)], "file_path string"), named), "file_path", "content") == [("a.py", "x = 1\n"), ("no.py", "")]
    assert records.with_previous(named, named.withColumn("ref", F.lit("v1")), "v0").first()["previous_source"] is None
    assert [records.read_events(spark, str(tmp_path / p)).first()["payload"] for p in ("e.json", "none.json")] == ['{"number": 4}', "{}"]
    assert rows(records.read_responses(spark, str(tmp_path / "r.json")), "attempt", "status", "content", "message") == [(1, "answer", "x", None), (2, "error", None, "429 {}"), (3, "error", None, "empty response")]
    assert records.read_runs(spark, str(tmp_path / "runs.json"), ["python"]).count() == 1


def test_requests_do_not_mix(spark):
    files = spark.createDataFrame([("d1", "src/m.py", NEW, OLD), ("d2", "src/m.py", OLD, OLD)], "diff_id string, file_path string, content string, previous_source string")
    diffs = spark.createDataFrame([("d1", "+++ b/src/m.py\n@@ -1,12 +1,12 @@"), ("d2", "+++ b/src/m.py\n@@ -1,2 +1,2 @@")], "diff_id string, text string")
    got = generation.analyse(diffs, files)
    assert rows(got, "diff_id", "function_name", "change_type") == [("d1", "fresh", "logic_change"), ("d1", "gone", "deletion"), ("d1", "keep", "signature_change"), ("d1", "new_name", "rename"), ("d2", "keep", "logic_change")]


def test_last_entry_of_a_key_stands(spark):
    targets = spark.createDataFrame([(1, "s.py", "python", "f"), (2, "s.py", "python", "f")], "target_id long, file_path string, language string, function_name string")
    good = "def test_f_%s():\n    assert 1\n\ndef test_f_%s():\n    assert 2\n"
    answers = spark.createDataFrame([(i, 1, "answer", good % (f"a{i}", f"b{i}")) for i in (1, 2)], "target_id long, attempt int, status string, content string")
    existing = spark.createDataFrame([("s.py", "f", 0, "")], "source_file string, function_name string, ordinal int, existing_tests_text string")
    base = spark.createDataFrame([], "key string, source_file string, language string, function_name string, test_id string, target_file string, test_names array<string>")
    actions = spark.createDataFrame([], "action_type string, source_file string, function_name string, previous_name string")
    kept, _ = generation.generate(targets, answers, existing, base, actions, "t")
    assert [r["test_names"] for r in kept.collect()] == [["test_f_a2", "test_f_b2"]]


def test_small_helpers(spark):
    lit = F.lit
    one = lambda **c: spark.range(1).select(*[x.alias(k) for k, x in c.items()]).first()
    assert one(a=validation.is_component(lit("return (<Box/>)"), lit("javascript")), b=validation.is_component(lit("return 1"), lit("typescript")), c=validation.is_component(lit("<Box"), lit("python"))).asDict() == {"a": True, "b": False, "c": False}
    assert one(x=validation.to_mock(lit("q(b[1]) + len(c) + d.e (2) + os.f(1)")))["x"] == ["d.e()", "b[...]"]
    names = spark.createDataFrame([(1, "test_f_1"), (1, "test_g_1"), (2, "test_f_2")], "target_id int, name string")
    prefixes = spark.createDataFrame([(1, "test_f_"), (1, "test_old_"), (2, "test_g_")], "target_id int, prefix string")
    assert rows(discovery.matching_test_names(names, prefixes), "target_id", "name") == [(1, "test_f_1")]
    targets = spark.createDataFrame([(i, "s", f"f{i}") for i in range(4)], "target_id int, source_file string, function_name string")
    outcomes = spark.createDataFrame([(0, True), (1, False), (2, False)], "target_id int, succeeded boolean")
    assert rows(attempts.unresolved_by_file(targets, outcomes), "failed", "not_attempted") == [(["f1", "f2"], ["f3"])]
    rules = spark.createDataFrame([(1, "project", 0, "x" * 8000), (1, "project", 1, "y" * 2000), (1, "request", 0, "z")], "target_id int, kind string, ordinal int, rule string")
    assert rows(budgets.split_rule_budget(rules), "kind", "ordinal") == [("project", 0), ("request", 0)]
    r = spark.createDataFrame([("see a/test_ai_generated_x.py and ERROR collecting b/test_ai_generated_y.py", "c\\ai_generated_z.test.ts")], "stdout string, stderr string")
    assert rows(logs.failed_files(r), "file") == [("ai_generated_z.test.ts",), ("test_ai_generated_x.py",), ("test_ai_generated_y.py",)] and rows(logs.collection_errors(r), "file") == [("test_ai_generated_y.py",)]
    rng = random.Random(4)
    stem = lambda: "".join(rng.choice("abx_") for _ in range(rng.randint(1, 7)))
    src, tst = [f"src/{stem()}.py" for _ in range(40)], [f"tests/test_{stem()}{rng.choice(['', '_test'])}.py" for _ in range(40)]
    want = set()
    for a in src:
        s = a[4:-3].lower()
        for b in tst:
            t = re.sub("^_+|_+$", "", re.sub(r"^test_|_test$|^test|test$|\.test$|\.spec$", "", b[6:-3]))
            if len(s) >= 4 and (s in b[6:] or (len(t) >= 4 and (t in s or s in t))):
                want.add((a, b))
    path = lambda xs: spark.createDataFrame([(x,) for x in xs], "file_path string")
    assert set(map(tuple, discovery.related_tests(path(src), path(tst)).collect())) == want and want


def test_outcomes_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"ts": "2024-01-01T00:01:00Z", "status": "valid"}\n{"ts": "2024-01-01T00:02:00Z", "status": "valid"}\n{"ts": "2024-01-01T00:07:00Z", "status": "error"}\n')
    counts = responses.outcome_counts(responses.read_stream(spark, str(tmp_path / "in"), "ts timestamp, status string"))
    query = counts.writeStream.outputMode("complete").format("memory").queryName("outcome_counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows(spark.table("outcome_counts"), "status", "n") == [("error", 1), ("valid", 2)]


def test_dependencies(spark):
    files = spark.createDataFrame([("p/a.py", "from .b import util as u, other\nimport p.c as c\n"), ("p/b.py", ""), ("p/c/__init__.py", "")], "file_path string, content string")
    refs = dependencies.resolve_modules(dependencies.python_imports(files), files, "python")
    assert rows(refs, "local_name", "module_path") == [("c", "p/c/__init__.py"), ("other", "p/b.py"), ("u", "p/b.py")]
    funcs = spark.createDataFrame([("p/a.py", "f", "def f(): ...", 0), ("p/a.py", "K.g", "def g():\n1\n2\n3\n4\n5", 1), ("p/b.py", "util", "def util():\n a\n b\n c\n d", 0)], "file_path string, function_name string, source_code string, ordinal int")
    change = spark.createDataFrame([(1, "p/a.py", "f", None, "if self.g(1):\n  return u(2)\nlogin(3)", ["self.g", "u", "login", "f"])], "change_id int, file_path string, function_name string, enclosing_class_name string, source_code string, called_functions array<string>")
    resolved = dependencies.resolve_calls(change, funcs, refs)
    got = dependencies.select_dependencies(resolved, files, "python")
    assert rows(got, "function_name", "score", "mode") == [("K.g", 3, "code"), ("util", 3, "code")]
    bare = change.withColumn("called_functions", F.array().cast("array<string>"))
    assert rows(dependencies.resolve_calls(bare, funcs, refs), "call") == rows(resolved, "call")
    js = spark.createDataFrame([("w/a.js", "import { x as y, z } from './b';\nimport * as n from './c';\nconst q = require('./d')"), ("w/b.js", ""), ("w/c/index.ts", ""), ("w/d.ts", "")], "file_path string, content string")
    assert rows(dependencies.resolve_modules(dependencies.script_imports(js), js, "javascript"), "local_name", "module_path") == [("n", "w/c/index.ts"), ("q", "w/d.ts"), ("y", "w/b.js"), ("z", "w/b.js")]


def test_logs_and_discovery(spark):
    out = "x FAILED t.py::test_one - E\nline 2\n\nline 4\nt.py::test_two FAILED"
    r = spark.createDataFrame([("python", 0, 1, out, None, 1), ("javascript", 1, 1, "  ✕ test_js now", "", 0)], "language string, ordinal int, run_id int, stdout string, stderr string, returncode int")
    assert rows(logs.failed_tests(r), "name") == [("test_js",), ("test_one",), ("test_two",)]
    notes = logs.failure_notes(r, spark.createDataFrame([(1, "test_one")], "run_id int, word string"))
    assert rows(notes, "note") == [("x FAILED t.py::test_one - E | line 2 | line 4",)]
    assert rows(logs.run_counts(r, "run_id"), "passed", "failed", "has_failures") == [(1, 1, True)]
    f = spark.createDataFrame([("tests/test_orders.py",), ("a/b/spec/x.spec.ts",), ("a/b/c/tests/test_deep.py",), ("tests/readme.md",), ("src/orders.py",)], "file_path string")
    tests = discovery.discover_tests(f)
    assert rows(tests, "file_path") == [("a/b/spec/x.spec.ts",), ("tests/test_orders.py",)]
    assert rows(discovery.related_tests(f.where("file_path like 'src%'"), tests), "test_path") == [("tests/test_orders.py",)]


def test_records(spark):
    bodies = ['{"choices":[{"message":{"content":"a"}}]}', '{"choices":[{"message":{"content":[{"text":"b"},{"text":"c"}]}}]}', '{"choices":[{"text":"d"}]}', '{"output_text":"e"}', '{"choices":[],"output_text":"f"}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    assert [r[1] for r in rows(records.with_response_content(df, "b"), "i", "content")] == ["a", "bc", "d", "e", "f"]
    event = '{"number": 4, "repository": {"full_name": "o/r"}, "pull_request": {"number": 0, "base": {"ref": "main"}, "head": {"ref": "x"}, "title": "T"}}'
    got = records.event_context(spark.createDataFrame([(event,)], "payload string")).first()
    assert (got["pull_request_number"], got["base_branch"], got["body"]) == (4, "main", None)


def test_queries_match_their_sql(spark):
    import duckdb

    from sparkloom import queries as q

    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, f in q.queries().items():
        got, want = f(spark, sf).toPandas(), con.sql(q.oracle_sql()[name]).df()
        columns = sorted(want.columns)
        as_rows = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
        assert as_rows(got) == as_rows(want), name


def test_banned_content_in_both_readings_of_words(spark):
    texts = [("a é*** b", False, True), ("ñ??? b", False, True), ("étodo ", False, True), ("x***", False, False), (" *** ", True, True), ("TODO", True, True), ("todos", False, False), ("é requests.get(", True, True), ("éopen('x', 'w'", False, True), (None, None, None)]
    df = spark.createDataFrame(texts, "text string, unicode boolean, ascii boolean")
    got = df.select("*", validation.has_banned_content(F.col("text")).alias("u"), validation.has_banned_content(F.col("text"), unicode=False).alias("a")).collect()
    assert [(r.text, r.u, r.a) for r in got] == texts


def test_query_of_banned_content_takes_words_as_its_sql(spark, tmp_path):
    import duckdb

    from sparkloom import queries

    rows = [(0, "schü*** der"), (1, "miñí??? x"), (2, "étodo"), (3, "a***"), (4, "*** b"), (5, "none")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = dict(duckdb.sql(queries.oracle_sql()["q_banned_content"]).fetchall())
    assert {r.doc_id: r.banned for r in queries.queries()["q_banned_content"](spark, str(tmp_path)).collect()} == want == {0: True, 1: True, 2: True, 3: False, 4: True, 5: False}


def test_query_of_first_failures_takes_words_as_its_sql(spark, tmp_path):
    import duckdb

    from sparkloom import queries

    rows = [(0, "schü*** der"), (1, "miñí??? x"), (2, "étbd x"), (3, "a*** x"), (4, "é *** b,"), (5, "none")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = dict(duckdb.sql(queries.oracle_sql()["q_first_failure_reason"]).fetchall())
    assert {r.doc_id: r.reason for r in queries.queries()["q_first_failure_reason"](spark, str(tmp_path)).collect()} == want
    assert want == {0: "banned_pattern", 1: "banned_pattern", 2: "banned_pattern", 3: "", 4: "truncated", 5: ""}
