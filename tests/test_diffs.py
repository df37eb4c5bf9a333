"""Diffs cut into pieces against a plain reading line by line; large diffs are read by many tasks."""

import random
import re

from pyspark.sql import functions as F

from sparkloom.operators import changes
from sparkloom.sources import records

HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _plain(diffs):
    out = set()
    for name, text in diffs:
        path = ""
        for line in text.splitlines():
            if line.startswith("diff --git "):
                path = ""
            elif line.startswith("+++ b/"):
                path = line[6:].strip().replace("\\", "/")
            elif path and (m := HUNK.match(line)):
                for side, at, n in (("removed", m[1], m[2]), ("added", m[3], m[4])):
                    out |= {(name, path, side, int(at) + k) for k in range(int(n or 1))}
    return out


def _diff(rng, sections, breaks=("\n",)):
    lines = ["commit 1", "@@ -1 +1 @@"] * rng.randint(0, 1)
    for _ in range(sections):
        name = f"src/m{rng.randrange(9)}.py"
        lines += [f"diff --git a/{name} b/{name}", f"--- a/{name}", rng.choice([f"+++ b/{name}", f"+++ b/{name}", f"+++ b/ w\\{name} ", "+++ /dev/null", "+++ b/"])]
        for _ in range(rng.randint(0, 4)):
            a, b = rng.randint(0, 50), rng.randint(1, 50)
            lines += [rng.choice([f"@@ -{a} +{b} @@", f"@@ -{a},{rng.randint(0, 3)} +{b},{rng.randint(0, 3)} @@ def f():", "@@ no @@", f" @@ -{a} +{b} @@", f"++@@ -{a} +{b} @@"]), "-old", rng.choice(["+new", "+++ b/other.py", "+diff --git a/x b/x"])]
    return "".join(x + rng.choice(breaks) for x in lines)


def test_pieces_equal_lines(spark):
    rng = random.Random(6)
    diffs = [(f"d{i}", _diff(rng, rng.randint(0, 6), ("\n", "\n", "\r\n", "\r", "\x0c", " "))) for i in range(150)] + [("none", ""), ("head", "+++ b/x.py\n@@ -1 +2 @@"), ("null", None)]
    got = changes.changed_lines(spark.createDataFrame(diffs, "diff_id string, text string"))
    assert {tuple(r) for r in got.collect()} == _plain([(a, b) for a, b in diffs if b])
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_large_diffs_are_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(7)
    (tmp_path / "one.diff").write_text(_diff(rng, 20_000))
    (tmp_path / "two.diff").write_text(_diff(rng, 3))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(200_000))
    try:
        sections = records.read_diff_sections(spark, str(tmp_path))
        assert sections.rdd.getNumPartitions() >= 10 and sections.count() >= 20_003
        got = {(r.diff_id.split("/")[-1], r.file_path, r.side, r.line) for r in changes.changed_lines(sections).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got == _plain([(f.name, f.read_text()) for f in tmp_path.glob("*.diff")])
    whole = {(r.diff_id.split("/")[-1], r.file_path, r.side, r.line) for r in changes.changed_lines(records.read_diffs(spark, str(tmp_path))).collect()}
    assert got == whole


def test_tasks_of_the_query_hold_about_as_many_rows_of_a_larger_table(spark, tmp_path, monkeypatch):
    from sparkloom import queries, session

    monkeypatch.setattr(session.parts_of, "__defaults__", (500,))
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        for n in (1000, 8000):
            rows = spark.range(n).selectExpr("id div 4 AS l_orderkey", "id % 97 AS l_partkey", "id % 53 AS l_suppkey", "int(id % 4 + 1) AS l_linenumber")
            rows.write.mode("overwrite").parquet(str(tmp_path / "lineitem.parquet"))
            got = queries.queries()["q_hunk_lines"](spark, str(tmp_path))
            sizes = got.groupBy(F.spark_partition_id()).agg(F.countDistinct("l_orderkey").alias("orders")).collect()
            assert len(sizes) >= n // 1000 and max(r.orders for r in sizes) <= 250, sizes
            want = {(i // 4, "removed", i % 4 + 1 + k) for i in range(n) for k in range(i % 97 % 3)} | {(i // 4, "added", i % 53 % 50) for i in range(n)}
            assert {tuple(r) for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", kept)


def test_sections_are_written_by_as_many_tasks_as_the_rows_call_for(spark, tmp_path, monkeypatch):
    from sparkloom import flow_queries, session

    monkeypatch.setattr(session.parts_of, "__defaults__", (500,))
    monkeypatch.setattr(flow_queries, "shared_folder", lambda spark, name: str(tmp_path / name))
    rows = spark.range(16_000).selectExpr("id div 4 AS l_orderkey", "id % 97 AS l_partkey", "id % 2 AS l_suppkey", "int(id % 4 + 1) AS l_linenumber", "double(id % 7) AS l_quantity")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = [tuple(r) for r in flow_queries.q_diff_sections(spark, str(tmp_path)).collect()]
    files = [f.read_text().count("diff --git ") for f in (tmp_path / "diffs").glob("request=*/*.txt")]
    assert sum(files) == 16_000 and max(files) <= 1500, files
    want = set()
    for i in range(16_000):
        at, b = (i % 2, f"src/m{i % 97 % 40}.py"), i % 2 + 1
        want |= {(*at, "removed", (i % 4 + 1) * 10 + k) for k in range(i % 97 % 3)} | {(*at, "added", b + k) for k in range(i % 7 % 4)} | {(*at, "added", b + 500)}
    assert len(got) == len(set(got)) and set(got) == want
