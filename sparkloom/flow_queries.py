"""Queries of what goes through storage and of whole plans: stored tables, diffs in sections. As in
code_queries, columns shaped like code are derived from rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import source_code, tables, text
from sparkloom.operators import asof, budgets, changes, store, validation
from sparkloom.operators.stored_table import StoredTable
from sparkloom.plans import assembly, generation
from sparkloom.session import parts_of, shared_folder, spread, stored
from sparkloom.sources import records

_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        _ALL[f.__name__] = (f, sql)
        return f

    return keep


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(
    """WITH one AS (SELECT min(o_custkey) AS c FROM orders) SELECT o_orderkey AS key, CASE WHEN o_custkey = c THEN 'moved' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'F' AND o_custkey <> c THEN o_custkey + 1 ELSE o_custkey END AS customer
    FROM orders, one WHERE o_orderpriority <> '1-URGENT' OR o_orderstatus = 'F' OR o_custkey = c"""
)
def q_stored_updates(spark, sf_dir):
    """All orders, then a batch of deletes and writes over them, the same batch again, then one that touches one customer's orders."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"), "o_orderpriority")
    stored = StoredTable(spark, shared_folder(spark, "stored"), o.select("key", "status", "customer").schema)
    none = o.where("false").select("key")
    stored.apply("all", o.withColumn("seq", F.lit(0)), none)
    done = o.where("status = 'F'").select("key", "status", "customer")
    twice = done.withColumn("seq", F.lit(1)).unionByName(done.withColumn("customer", F.col("customer") + 1).withColumn("seq", F.lit(2)))
    for _ in range(2):
        stored.apply("finished", twice, o.where("o_orderpriority = '1-URGENT'").select("key"))
    first = o.agg(F.min("customer").alias("customer"))
    stored.apply("moved", o.join(first, "customer").select("key", F.lit("moved").alias("status"), "customer", F.lit(1).alias("seq")), none)
    return stored.read()


@_query(
    """WITH h AS (SELECT l_suppkey % 16 AS request, 'src/m' || l_partkey % 40 || '.py' AS file_path, l_linenumber * 10 AS a, l_partkey % 3 AS n, l_suppkey % 50 + 1 AS b, l_quantity::INT % 4 AS m FROM lineitem),
    l AS (SELECT request, file_path, 'removed' AS side, unnest(range(a, a + n)) AS line FROM h UNION ALL SELECT request, file_path, 'added', unnest(range(b, b + m)) FROM h UNION ALL SELECT request, file_path, 'added', b + 500 FROM h)
    SELECT DISTINCT request, file_path, side, line::INT AS line FROM l"""
)
def q_diff_sections(spark, sf_dir):
    """Diffs of 16 requests, written as text files and read section by section; two hunks a section.

    Requests are cut by ranges of orders, so that each task sorts and writes about as many sections, however many there are in all."""
    i = _t(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 16).alias("request"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    i = i.repartitionByRange(parts_of(i), "request", "l_orderkey")
    file = F.concat(F.lit("src/m"), (F.col("l_partkey") % 40).cast("string"), F.lit(".py"))
    first = F.format_string("@@ -%d,%d +%d,%d @@ def f():", F.col("l_linenumber") * 10, F.col("l_partkey") % 3, F.col("l_suppkey") % 50 + 1, F.col("l_quantity").cast("int") % 4)
    second = F.format_string("@@ -0,0 +%d @@", F.col("l_suppkey") % 50 + 501)
    section = F.concat_ws("\n", F.concat(F.lit("diff --git a/"), file, F.lit(" b/"), file), F.lit("index 1..2"), F.concat(F.lit("--- a/"), file), F.concat(F.lit("+++ b/"), file), first, F.lit("-old"), F.lit("+new @@ -1 +1 @@"), second, F.lit("+more"))
    path = shared_folder(spark, "diffs")
    i.select("request", section.alias("value")).write.partitionBy("request").text(path)
    lines = changes.changed_lines(records.read_diff_sections(spark, f"{path}/*"))
    return lines.select(F.regexp_extract("diff_id", r"request=(\d+)/", 1).cast("long").alias("request"), "file_path", "side", "line").distinct()


@_query(
    """WITH v AS (SELECT user_id AS k, event_id AS at, CASE WHEN event_type = 'view' AND event_id % 3 = 0 THEN NULL ELSE event_type || event_id END AS content FROM events),
    a AS (SELECT o_orderkey, o_custkey AS k, o_orderkey AS at FROM orders)
    SELECT o_orderkey, content FROM a ASOF LEFT JOIN v ON a.k = v.k AND a.at >= v.at"""
)
def q_versions_as_of(spark, sf_dir):
    """A user's events are the versions of a file, some of them deletions; every order asks for one as of its number."""
    gone = (F.col("event_type") == "view") & (F.col("event_id") % 3 == 0)
    name = lambda c: F.concat(F.lit("src/"), F.col(c).cast("string"), F.lit(".py")).alias("file_path")
    versions = _t(spark, sf_dir, "events").select(name("user_id"), F.col("event_id").alias("commit"), F.when(~gone, F.concat("event_type", F.col("event_id").cast("string"))).alias("content"))
    asks = _t(spark, sf_dir, "orders").select("o_orderkey", name("o_custkey"), F.col("o_orderkey").alias("commit"))
    return asof.versions_as_of(asks, versions).select("o_orderkey", F.col("previous_source").alias("content"))


@_query(
    """SELECT c_nationkey || '/' || c_name AS key, 'f' || c_nationkey AS source_file, c_name AS function_name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'test_a,test_"' || c_custkey || 'é' END AS names FROM customer"""
)
def q_mapping_document(spark, sf_dir):
    """One indented document over all part files, written and read back entry by entry."""
    c = _t(spark, sf_dir, "customer")
    names = F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("test_a"), F.concat(F.lit('test_"'), F.col("c_custkey").cast("string"), F.lit("é"))))
    rows = c.select(F.concat(F.col("c_nationkey").cast("string"), F.lit("/"), "c_name").alias("key"), F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("source_file"), F.lit("python").alias("language"), F.col("c_name").alias("function_name"), F.lit("t").alias("test_id"), F.lit("x/y").alias("target_file"), names.alias("test_names"))
    path = shared_folder(spark, "mapping")
    store.save_document(rows, path, path)
    return records.read_document(spark, path).select("key", "source_file", "function_name", F.array_join("test_names", ",").alias("names"))


@_query(
    """SELECT n_nationkey, n_name || '.m' AS function_name, 2 AS start_line, 4 AS end_line, 1 AS branch_count, false AS has_validation, 'helper,a.go' AS calls FROM nation
    UNION ALL SELECT n_nationkey, 'f' || n_nationkey, 7, 9, 0, true, 'check' FROM nation"""
)
def q_functions_by_sql(spark, sf_dir):
    """The rows of q_python_functions, asked for in SQL through LATERAL."""
    tables.register(spark)
    code = F.concat(F.lit("class "), F.col("n_name"), F.lit(":\n    def m(self, a: int):\n        for i in helper(a):\n            a.go(i)\n\n@deco\nasync def f"), F.col("n_nationkey").cast("string"), F.lit("(x, /, *rest, y, **z):\n    def inner(): raise\n    check(x)\n"))
    files = _t(spark, sf_dir, "nation").select("n_nationkey", code.alias("content"))
    return spark.sql("SELECT n_nationkey, function_name, start_line, end_line, branch_count, has_validation, array_join(called_functions, ',') AS calls FROM {files} f, LATERAL python_functions(f.content)", files=files)


#: For each pattern that generated tests must not hold, a text that does and one that nearly does.
_BANNED = (
    ("a *** b", "a ** b, x***y"), ("why ???", "why ??, x???"), ("# ToDo", "todos"), ("x = your_module", "your_modules"), ("create_engine (url)", "recreate_engine(url)"),
    ("httpx.patch (u)", "httpx.options(u)"), ("psycopg2.connect(d)", "mysql.connect(d)"), ("open(p, 'w')", "open(p, 'r')"), ("pathlib.Path(a).write_text(b)", "Path(a).read_text()"),
    ("aiohttp . request( 'https://a.co.uk/x'", "aiohttp.request('https://example.com/x'"), ("  const a = require('b')", "let a = require('b')"),
)


@_query("SELECT c_custkey, c_custkey % 2 = 0 AS banned FROM customer")
def q_banned_patterns(spark, sf_dir):
    """All eleven patterns, each by a text that holds it and one that nearly does."""
    texts = F.array(*[F.array(*map(F.lit, pair)) for pair in _BANNED])
    pair = F.get(texts, (F.floor(F.col("c_custkey") / 2) % len(_BANNED)).cast("int"))
    content = F.concat(F.lit("def test_a():\n    pass\n"), F.get(pair, (F.col("c_custkey") % 2).cast("int")), F.lit("\n"))
    return _t(spark, sf_dir, "customer").select("c_custkey", validation.has_banned_content(content).alias("banned"))


_EVICTED = ("fixed", "request_rule", "project_rule", "dependency", "test_line")


@_query(
    """WITH t AS (SELECT conv_id, turn, turn % 5 AS kind, (CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END) AS n FROM conversations),
    s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id) - 90 AS over_, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY CASE kind WHEN 0 THEN 9 ELSE kind END, CASE WHEN kind = 3 THEN -n ELSE 0 END, CASE WHEN kind = 3 THEN turn ELSE -turn END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, sum(CASE WHEN kind = 0 THEN n ELSE 0 END) OVER (PARTITION BY conv_id) AS fixed FROM t)
    SELECT conv_id, turn, kind > 0 AND over_ > 0 AND freed < over_ AS evicted, fixed > 90 AS skipped FROM s"""
)
def q_eviction_of_all_kinds(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    kind = F.get(F.array(*map(F.lit, _EVICTED)), (F.col("turn") % 5).cast("int"))
    items = c.select(F.col("conv_id").alias("target_id"), kind.alias("kind"), F.col("turn").alias("ordinal"), text.estimate_tokens(F.col("text")).alias("tokens"))
    return budgets.evict_to_budget(items, 90).select(F.col("target_id").alias("conv_id"), F.col("ordinal").alias("turn"), "evicted", "skipped")


@_query(
    """SELECT s_suppkey, 'import unittest' || chr(10) || 'from app.m import Box' || s_suppkey || ', go' || chr(10) || chr(10) || 'def test_a(): pass' || chr(10) AS content FROM supplier WHERE s_suppkey % 2 = 0
    UNION ALL SELECT s_suppkey, 'import unittest' || chr(10) || 'from app.m import Box' || s_suppkey || ', go, gone, LIMIT' || chr(10) || chr(10) || 'def test_a(): pass' || chr(10) FROM supplier WHERE s_suppkey % 2 = 1"""
)
def q_merged_by_source(spark, sf_dir):
    """Names that a source defines at its top level decide which imports stay; every second source does not parse, so all stay."""
    s = _t(spark, sf_dir, "supplier")
    number = F.col("s_suppkey").cast("string")
    code = F.concat(F.lit("class Box"), number, F.lit(":\n    def gone(self): pass\n    LIMIT = 1\n\nasync def go():\n    pass\na, b = 1, 2\n"), F.when(F.col("s_suppkey") % 2 == 1, "def (").otherwise(""))
    symbols = store.own_symbols(s.select(F.col("s_suppkey").alias("source_file"), F.lit("python").alias("language"), code.alias("content")))
    tests = s.select(F.col("s_suppkey").alias("source_file"), F.lit(0).alias("ordinal"), F.concat(F.lit("from app.m import Box"), number, F.lit(", go, gone, LIMIT\n\ndef test_a(): pass\n")).alias("content"))
    return store.merge_artifacts(tests, symbols).select(F.col("source_file").alias("s_suppkey"), "content")


@_query("SELECT DISTINCT 'src/' || c_nationkey || '/m' || c_custkey % 50 || '.py' AS file_path FROM customer")
def q_changed_paths(spark, sf_dir):
    """Lists of changed paths as a shell writes them, blanks and backslashes among them."""
    c = _t(spark, sf_dir, "customer")
    line = F.concat(F.lit(" src\\"), F.col("c_nationkey").cast("string"), F.lit("/m"), (F.col("c_custkey") % 50).cast("string"), F.lit(".py \n\n  "))
    path = shared_folder(spark, "paths")
    c.select(line.alias("value")).write.text(path)
    return records.read_changed_paths(spark, path).distinct()


@_query(
    """SELECT conv_id AS target_id, turn + 1 AS attempt, CASE WHEN turn % 5 IN (0, 1, 4) OR (turn % 5 = 2 AND trim(text) = '') THEN 'error' ELSE 'answer' END AS status, CASE WHEN turn % 5 IN (2, 3) AND trim(text) <> '' THEN text END AS content,
    CASE turn % 5 WHEN 0 THEN '429 busy' WHEN 1 THEN 'no JSON' WHEN 4 THEN 'empty response' END AS message FROM conversations"""
)
def q_captured_responses(spark, sf_dir):
    """Answers of a model as JSON lines: refused, broken, blank and good ones of two shapes."""
    c = _t(spark, sf_dir, "conversations")
    case = F.col("turn") % 5
    said = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    body = F.when(case == 0, "busy").when(case == 1, F.concat(F.lit("<"), "text")).when(case == 2, said).when(case == 3, F.to_json(F.struct(F.col("text").alias("output_text")))).otherwise('{"choices": []}')
    path = shared_folder(spark, "responses")
    c.select(F.col("conv_id").alias("target_id"), (F.col("turn") + 1).alias("attempt"), F.when(case == 0, 429).otherwise(200).alias("http_status"), body.alias("body")).write.json(path)
    return records.read_responses(spark, path)


@_query("SELECT o_orderkey, 'o/r' AS repository, (o_custkey + 1)::INT AS number, 'main' AS base, 'b' || o_orderkey AS head FROM orders")
def q_captured_events(spark, sf_dir):
    """Event files, one a bucket of orders, each an array of events; fields of other shapes do not matter."""
    o = _t(spark, sf_dir, "orders")
    odd = F.when(F.col("o_orderkey") % 2 == 0, F.lit('{"a": [1, {"b": null}]}')).otherwise(F.lit('"text"'))
    event = F.format_string('{"repository": {"full_name": "o/r"}, "other": %s, "number": "%d", "pull_request": {"number": 0, "base": {"ref": "main"}, "head": {"ref": "b%d"}}}', odd, F.col("o_custkey") + 1, F.col("o_orderkey"))
    path = shared_folder(spark, "events")
    o.groupBy((F.col("o_orderkey") % 64).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(event), ", "), F.lit("]")).alias("value")).repartition(64, "file").write.partitionBy("file").text(path)
    files = records.read_events(spark, path)
    each = files.select(F.explode(F.try_variant_get(F.parse_json("payload"), "$", "array<variant>")).alias("v")).select(F.to_json("v").alias("payload"))
    got = records.event_context(each)
    return got.select(F.substring("head_branch", 2, 20).cast("long").alias("o_orderkey"), "repository", F.col("pull_request_number").alias("number"), F.col("base_branch").alias("base"), F.col("head_branch").alias("head"))


@_query(
    """SELECT DISTINCT c_nationkey AS request_id, CASE c_custkey % 4 WHEN 0 THEN 'python' ELSE 'javascript' END AS language FROM customer WHERE c_custkey % 4 = 0 OR (c_custkey % 4 IN (1, 2) AND c_nationkey % 3 = 0)"""
)
def q_expected_runs(spark, sf_dir):
    """Which runs a request calls for: scripts only where the root has a package.json, one run for both script languages."""
    c = _t(spark, sf_dir, "customer")
    language = F.get(F.array(F.lit("python"), F.lit("javascript"), F.lit("typescript"), F.lit(None)), (F.col("c_custkey") % 4).cast("int"))
    touched = c.select(F.col("c_nationkey").alias("request_id"), language.alias("language"))
    files = c.select(F.col("c_nationkey").alias("request_id"), F.when(F.col("c_nationkey") % 3 == 0, "package.json").otherwise("web/package.json").alias("file_path"))
    return records.expected_runs(touched, files, ["python", "npm"])


@_query("SELECT 'f' || c_nationkey || '::' || c_name AS key, 'x/' || c_custkey AS target_file, 't' || c_custkey % 3 AS names FROM customer")
def q_saved_mapping(spark, sf_dir):
    """The mapping saved a source file a line, read back."""
    c = _t(spark, sf_dir, "customer")
    file = F.concat(F.lit("f"), F.col("c_nationkey").cast("string"))
    rows = c.select(store.mapping_key(file, F.col("c_name")).alias("key"), file.alias("source_file"), F.lit("python").alias("language"), F.col("c_name").alias("function_name"), F.lit("t").alias("test_id"), F.concat(F.lit("x/"), F.col("c_custkey").cast("string")).alias("target_file"), F.array(F.concat(F.lit("t"), (F.col("c_custkey") % 3).cast("string"))).alias("test_names"))
    path = shared_folder(spark, "saved")
    store.save_mapping(rows, path, path)
    return records.read_mapping(spark, path).select("key", "target_file", F.array_join("test_names", ",").alias("names"))


@_query(
    """SELECT n_nationkey, 'f("// no", ' || n_nationkey || ') ' || chr(10) || 'x = /[/*]/ + `/* ${n} */` ' || chr(10) || n_name || '()' AS code FROM nation"""
)
def q_script_comments(spark, sf_dir):
    """Comments go; what looks like one in a string, a pattern or a template stays."""
    code = F.concat(F.lit('f("// no", '), F.col("n_nationkey").cast("string"), F.lit(") // it's `gone`\nx = /[/*]/ + `/* ${n} */` /* a\nb */\n"), "n_name", F.lit("()"))
    return _t(spark, sf_dir, "nation").select("n_nationkey", source_code.without_comments(code).alias("code"))


#: A file with a class and a function, the module that it imports from, its tests; ¤ is the file's number.
_CODE = "from src.util¤ import aid\n\nclass Box¤:\n    def run(self, a):\n        if a:\n            return helper¤(a)\n        return api.get(a)\n\ndef helper¤(a):\n    if a is None:\n        raise ValueError(a)\n    return aid(a)\n"
_UTIL = "def aid(x):\n    check(x)\n    return x\n"
_TESTS = "def test_helper¤_a():\n    assert helper¤(1)\n\ndef test_other():\n    pass\n"
_POLICY = "Tests are deterministic and need neither network nor files."
_HELPER = "def helper¤(a):\n    if a is None:\n        raise ValueError(a)\n    return aid(a)"
_REQUEST = (
    "## Task\nWrite 3 to 9 unit tests for {name}.\n\n## Language\npython, pytest\n\n## Imports\n- file: src/unit¤.py\n- module: src.unit¤\n- import: from src.unit¤ import {symbol}\n- no other module than src.unit¤\n- types may stand in package src\n\n"
    f"## Project rules\n{_POLICY}\nrules of @\n\n## Request rules\n{_POLICY}~\n\n{{mocks}}## Code\n{{code}}\n\n## Dependencies\n{{calls}}\n\n## Existing tests\n"
)
_RUN = _REQUEST.format(name="Box¤.run", symbol="Box¤", mocks="## To be mocked\n- api.get()\n\n", code=_CODE[27:].split("\n\ndef")[0].strip(), calls=f"- helper¤ (src/unit¤.py)\n{_HELPER}") + "none"
_HELP = _REQUEST.format(name="helper¤", symbol="helper¤", mocks="", code=_HELPER, calls=f"- aid (src/util¤.py)\n{_UTIL.strip()}")


def _filled(shown: str, tests: str) -> str:
    return f"replace(replace(replace({_q(shown)}{tests}, '¤', k::VARCHAR), '@', n::VARCHAR), '~', CASE WHEN n % 2 = 0 THEN '' ELSE chr(10) || 'asked by ' || n END)"


@_query(
    f"""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier)
    SELECT n AS request_id, 'Box' || k || '.run' AS function_name, {_filled(_RUN, '')} AS request, '' AS tests, 'target' AS kind FROM s
    UNION ALL SELECT n, 'helper' || k, {_filled(_HELP, f" || CASE WHEN k % 2 = 0 THEN {_q(_TESTS.split(chr(10) * 2)[0])} ELSE 'none' END")}, CASE WHEN k % 2 = 0 THEN 'test_helper' || k || '_a' ELSE '' END, 'target' FROM s
    UNION ALL SELECT n, 'gone' || k, NULL, CASE WHEN k % 2 = 0 THEN 'test_gone' || k || '_b' ELSE '' END, 'deletion' FROM s WHERE k % 3 = 0"""
)
def q_target_requests(spark, sf_dir):
    """From diffs and files to requests: a request a nation, a changed file a supplier. Every third file had a function that is gone."""
    # stored, as conditions on what is derived would else go before the dealing, into the one task that reads the small file
    s = stored(spread(_t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("diff_id")), "k"), "rows")
    number = F.col("k").cast("string")
    of = lambda x: F.replace(F.lit(x), F.lit("¤"), number)
    gone = F.when(F.col("k") % 3 == 0, of("def gone¤(q):\n    while q:\n        q -= 1\n    raise q\n"))
    code = s.select("diff_id", of("src/unit¤.py").alias("file_path"), of(_CODE).alias("content"), gone.alias("previous_source"))
    files = code.unionByName(s.select("diff_id", of("src/util¤.py").alias("file_path"), F.lit(_UTIL).alias("content"), F.lit(_UTIL).alias("previous_source")))
    section = F.concat(F.lit("diff --git a/x b/x\n+++ b/"), of("src/unit¤.py"), F.lit("\n@@ -1,4 +1,12 @@"))
    diffs = s.select("diff_id", section.alias("text"))  # a row for each section
    tests = s.where("k % 2 = 0").select(of("tests/test_unit¤.py").alias("file_path"), of(_TESTS + "\ndef test_gone¤_b():\n    pass\n").alias("content"))
    named = s.select("diff_id").distinct()
    rules = named.select("diff_id", F.lit("project_rule").alias("kind"), F.lit(0).alias("ordinal"), F.concat(F.lit("rules of "), F.col("diff_id").cast("string")).alias("rule"))
    rules = rules.unionByName(named.where("diff_id % 2 = 1").select("diff_id", F.lit("request_rule").alias("kind"), F.lit(0).alias("ordinal"), F.concat(F.lit("asked by "), F.col("diff_id").cast("string")).alias("rule")))
    targets, upkeep = assembly.assemble(generation.analyse(diffs, files), files, tests, rules, "tests/generated")
    names = F.array_join("existing_test_names", ",").alias("tests")
    return targets.select(F.col("diff_id").alias("request_id"), "function_name", "request", names, F.lit("target").alias("kind")).unionByName(upkeep.select(F.col("diff_id").alias("request_id"), "function_name", F.lit(None).cast("string").alias("request"), names, F.col("action_type").alias("kind")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}
