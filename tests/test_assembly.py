"""Requests put together from diffs and files: two requests with files of one name, scripts, tests, budgets."""

from pyspark.sql import functions as F

from sparkloom import flow_queries, session
from sparkloom.operators import budgets, changes
from sparkloom.plans import assembly, generation

PYTHON = "from src.util import aid\n\nclass Box:\n    def run(self, a):\n        if a:\n            return helper(a)\n        return api.get(a)\n\ndef helper(a):\n    if a is None:\n        raise ValueError(a)\n    return aid(a)\n"
SCRIPT = "import { far } from './far';\nclass Shop {\n  open(key) {\n    if (key) { return far(key); }\n    return /[}]/.test(key);\n  }\n}\n"
TESTS = "def test_helper_a():\n    assert helper(1)\n\ndef test_helper_b():\n    assert helper(2)\n\ndef test_other():\n    pass\n"
SECTION = "diff --git a/x b/x\n+++ b/{0}\n@@ -1,9 +1,14 @@"


def test_assembled_requests(spark):
    files = [(d, "src/boxes.py", PYTHON, "def gone(q):\n    while q:\n        q -= 1\n") for d in ("d1", "d2")]
    files += [("d1", "src/util.py", "def aid(x):\n    return 'first'\n", None), ("d2", "src/util.py", "def aid(x):\n    return 'second'\n", None), ("d1", "web/shop.ts", SCRIPT, None), ("d1", "web/far.ts", "export function far(a) { return a }\n", None)]
    files = spark.createDataFrame(files, "diff_id string, file_path string, content string, previous_source string")
    diffs = spark.createDataFrame([("d1", SECTION.format("src/boxes.py")), ("d1", SECTION.format("web/shop.ts")), ("d2", SECTION.format("src/boxes.py"))], "diff_id string, text string")
    tests = spark.createDataFrame([("tests/test_boxes.py", TESTS), ("tests/z/test_boxes.py", TESTS.replace("_a", "_c").replace("_b", "_gone")), ("tests/test_gone.py", "def test_gone_x(): pass")], "file_path string, content string")
    rules = spark.createDataFrame([("d1", "project_rule", 0, "be brief"), ("d2", "request_rule", 1, "later"), ("d2", "request_rule", 0, "sooner"), ("d2", "project_rule", 5, "x" * 9200)], "diff_id string, kind string, ordinal int, rule string")
    targets, upkeep = assembly.assemble(generation.analyse(diffs, files), files, tests, rules, "tests/generated")
    got = {(r.diff_id, r.function_name): r for r in targets.collect()}
    assert set(got) == {("d1", "Box.run"), ("d1", "helper"), ("d2", "Box.run"), ("d2", "helper"), ("d1", "Shop.open")}
    # each request meets its own files
    assert [("first" in got["d1", "helper"].request, "second" in got["d2", "helper"].request), ("second" in got["d1", "helper"].request)] == [(True, True), False]
    assert got["d1", "Box.run"].source_code == PYTHON.split("\n\n")[1] and got["d1", "Shop.open"].source_code == SCRIPT.split("\n", 1)[1].strip()
    assert got["d1", "Shop.open"].dependencies == ["- far (web/far.ts)\nfunction far(a) { return a }"]
    assert got["d1", "helper"].existing_test_names == ["test_helper_a", "test_helper_b", "test_helper_c", "test_helper_gone"]
    assert got["d1", "helper"].existing_tests_text.split("\n\n")[1] == "def test_helper_b():\n    assert helper(2)" and "test_helper_gone" in got["d1", "helper"].request
    assert len(got["d1", "helper"].project_rules) == 2 and got["d1", "helper"].project_rules[1] == "be brief"
    assert len(got["d2", "helper"].project_rules) == 1  # a rule beyond its half of the budget ends them
    assert got["d2", "helper"].request_rules[1:] == ["sooner", "later"]
    assert "## To be mocked\n- api.get()" in got["d1", "Box.run"].request and not got["d1", "Box.run"].skipped
    kept = {(r.diff_id, r.function_name, r.action_type): r.existing_test_names for r in upkeep.collect()}
    assert kept == {("d1", "gone", "deletion"): [], ("d2", "gone", "deletion"): []}


def test_requests_that_do_not_fit(spark):
    long = "def big(a):\n    if a:\n        return near(a)\n    return far_(a)\n" + "".join(f"    x{i} = '{'y' * 90}'\n" for i in range(700)) + "\n\ndef near(a):\n    if a:\n        return 1\n    check(a)\n    b = a\n" + "    return b + 1\n" * 700
    files = spark.createDataFrame([("d", "src/long.py", long, None), ("d", "src/huge.py", "def huge(a):\n    if a:\n        return 1\n" + "    y = 'zzzzzzzzz'\n" * 6000, None)], "diff_id string, file_path string, content string, previous_source string")
    diffs = spark.createDataFrame([("d", SECTION.format("src/long.py")), ("d", SECTION.format("src/huge.py"))], "diff_id string, text string")
    none = spark.createDataFrame([], "file_path string, content string")
    rules = spark.createDataFrame([("d", "request_rule", i, f"rule {i}") for i in range(3)], "diff_id string, kind string, ordinal int, rule string")
    targets, _ = assembly.assemble(generation.analyse(diffs, files), files, none, rules, "t")
    got = {r.function_name: r for r in targets.collect()}
    assert set(got) == {"big", "huge"} and got["huge"].skipped and got["huge"].request is None
    assert got["big"].dependencies == [] and got["big"].request_rules == [] and not got["big"].skipped  # rules go first, then the dependency
    assert len(got["big"].request) <= assembly.MOST_CHARS + 20


def test_lines_of_one_text(spark):
    lines = ["a" * 2000, "b", "c" * 40, "d"]
    df = spark.createDataFrame([("\n".join(lines),), ("",), (None,), ("x\ny",), ("k" * 400 + "\n" + "m" * 600 + "\n" + "z",)], "t string")
    assert [r[0] for r in df.select(budgets.lines_within_budget(F.col("t"))).collect()] == ["a" * 2000, "", "", "x\ny", "k" * 400 + "\n" + "m" * 600]


def test_steps_are_dealt_by_numbers_of_rows_and_nothing_that_grows_is_sent_to_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda spark, name: str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}"))
    monkeypatch.setattr(session.spread, "__defaults__", (50,))
    for plan in (generation, assembly):
        monkeypatch.setattr(plan, "PARSED_ROWS", 50, raising=False)
    spark.range(400).selectExpr("id AS s_suppkey", "int(id % 25) AS s_nationkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    got = flow_queries.q_target_requests(spark, str(tmp_path))
    rows = got.collect()
    assert len(rows) == 400 * 2 + 134 and sum(r.request is None for r in rows) == 134
    assert {r.function_name: r.tests for r in rows if r.tests} == {f"helper{k}": f"test_helper{k}_a" for k in range(0, 400, 2)} | {f"gone{k}": f"test_gone{k}_b" for k in range(0, 400, 6)}
    tasks = {}
    for f in tmp_path.iterdir():
        tasks[f.name.split("-")[0]] = max(tasks.get(f.name.split("-")[0], 0), len(list(f.glob("part-*"))))
    assert tasks["functions"] >= 8 and tasks["current"] >= 8, tasks
    lines = spark.createDataFrame([("d", "f", 1)], "diff_id string, file_path string, line int")
    functions = spark.createDataFrame([("d", "f", 1, 2), ("d", "g", 1, 2), ("d", "f", 3, 4)], "diff_id string, file_path string, start_line int, end_line int")
    hit = changes.impacted(functions, lines, ["diff_id", "file_path"])
    assert "Broadcast" not in hit._jdf.queryExecution().sparkPlan().toString()
    assert {tuple(r) for r in hit.collect()} == {("d", "f", 1, 2), ("d", "g", 1, 2)}
