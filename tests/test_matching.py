"""Renames against a plain greedy matching, stems against all pairs, several outputs of one pass."""

import difflib
import random

from pyspark.sql import functions as F

from sparkloom.operators import changes, discovery, validation

DDL = "diff_id int, file_path string, language string, ordinal int, function_name string, start_line int, end_line int, source_code string, context_code string, signature string, enclosing_class_name string, called_functions array<string>, branch_count int, has_validation boolean"


def _bare(row):
    return "".join((row["source_code"] or "").split()).replace(row["function_name"].split(".")[-1], "")


def _alike(a, b):
    ratio = lambda x, y: difflib.SequenceMatcher(a=x, b=y).ratio()
    return 0.75 * ratio(_bare(a), _bare(b)) + 0.25 * ratio(a["signature"], b["signature"])


def _greedy(now, before):
    """(function, change, previous name) in order; and how many pairs a plain search compares."""
    by_name, taken, out, pairs = {o["function_name"]: o for o in before}, set(), [], 0
    for row in now:
        old, kind = by_name.get(row["function_name"]), "logic_change"
        if old is not None:
            kind = "signature_change" if old["signature"] != row["signature"] else kind
        else:
            best = 0.0
            for o in before:
                if o["function_name"] not in taken and (o["enclosing_class_name"] or None) == (row["enclosing_class_name"] or None):
                    pairs += 1
                    score = _alike(row, o)
                    if score >= changes.RENAME_AT and score > best:
                        old, best, kind = o, score, "rename"
        if old is not None:
            taken.add(old["function_name"])
        out.append((row["function_name"], kind, old and old["function_name"], old and old["source_code"]))
    out += [(o["function_name"], "deletion", o["function_name"], o["source_code"]) for o in before if o["function_name"] not in taken]
    return out, pairs


def _files(rng):
    many = ["alpha", "beta", "gamma", "delta", "x = 1", "y += 2", "return", "if a:", "é", "go(b)", "while z < 9", "import json", "[q for q in w]", "{'k': 7}", "assert v", "0x5F3759DF", "print(u, end='')", "MAX_SIZE"]

    def function(i):
        name = f"f{i}" if rng.random() < 0.7 else f"K.f{i}"
        words = rng.sample(many, 3)
        return {"function_name": name, "source_code": f"def {name}(a):\n  " + "\n  ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 10, 40]))), "signature": f"def {name}({', '.join(rng.choice('abc') for _ in range(rng.randint(0, 3)))})", "enclosing_class_name": rng.choice([None, None, "", "K"])}

    before = [function(i) for i in range(rng.randint(0, 9))]
    now = []
    for i, old in enumerate(before):
        row = dict(old)
        if rng.random() < 0.5:
            row["function_name"] = f"g{i}"
            row["source_code"] = old["source_code"].replace(old["function_name"].split(".")[-1], f"g{i}")
        if rng.random() < 0.5:
            row["source_code"] += "\n  " + rng.choice(many)
        if rng.random() < 0.2:
            row["signature"] = "def other(z)"
        if rng.random() < 0.85:
            now.append(row)
    now += [function(100 + i) for i in range(rng.randint(0, 3))]
    if before and rng.random() < 0.4:  # two with one name, or with one body
        before.append({**before[0], "source_code": "def twice(): 1"} if rng.random() < 0.5 else {**before[0], "function_name": "copy"})
    rng.shuffle(now)
    return now, before


def test_renames_equal_a_greedy_search(spark):
    rng = random.Random(11)
    files = {(d, f"src/{i}.py"): _files(rng) for d in (1, 2) for i in range(40)}

    def table(side):
        return spark.createDataFrame([(d, path, "python", i, r["function_name"], 1, 2, r["source_code"], r["source_code"], r["signature"], r["enclosing_class_name"], [], 0, False) for (d, path), both in files.items() for i, r in enumerate(both[side])], DDL).repartition(5)

    now, before = table(0), table(1)
    got = {}
    for r in changes.classify(now, before, "diff_id").orderBy("ordinal").collect():
        got.setdefault((r.diff_id, r.file_path), []).append((r.function_name, r.change_type, r.previous_name, r.previous_source_code))
    plain = {k: _greedy(*both) for k, both in files.items()}
    assert got == {k: out for k, (out, _) in plain.items() if out}
    assert {c for out in got.values() for _, c, _, _ in out} == {"logic_change", "signature_change", "rename", "deletion"}
    compared = changes.rename_candidates(now, before, ["diff_id", "file_path"]).count()
    assert compared < 0.5 * sum(n for _, n in plain.values()), "most pairs are dropped by their letters"


def test_letters_bound_what_is_alike(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("abc é~!\U0001f600") for _ in range(rng.randint(0, 30))).replace(" ", "") for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("c", changes.letter_counts(F.col("t")))
    counts = {r.i: (r.t, r.c) for r in df.collect()}
    for a, (x, cx) in counts.items():
        assert sum(cx) == len(x)
        for b, (y, cy) in counts.items():
            if a < b and x + y:
                assert difflib.SequenceMatcher(a=x, b=y).ratio() <= 2 * sum(map(min, cx, cy)) / (len(x) + len(y)) + 1e-12


def test_stems_equal_all_pairs(spark):
    rng = random.Random(13)
    part = lambda: rng.choice(["user", "test", "serv", "ice", "data", "x", "base_", "ab", "user_service", "тест"])
    sources = sorted({f"src/{part()}{part()}{rng.choice(['', part()])}.py" for _ in range(150)})
    tests = sorted({f"tests/{rng.choice(['test_', '', 'tests/a/test'])}{part()}{rng.choice(['', part()])}{rng.choice(['.py', '_test.py', '.spec.ts', '.test.js'])}" for _ in range(150)})
    import re

    expected = set()
    for s in sources:
        stem = s.rsplit("/", 1)[1].rsplit(".", 1)[0].lower()
        for t in tests:
            name = t.rsplit("/", 1)[1].lower()
            clean = re.sub(r"^_+|_+$", "", re.sub(r"^test_|_test$|^test|test$|\.test$|\.spec$", "", name.rsplit(".", 1)[0]))
            if len(stem) >= 4 and (stem in name or (len(clean) >= 4 and (clean in stem or stem in clean))):
                expected.add((s, t))
    frames = [spark.createDataFrame([(x,) for x in xs], "file_path string") for xs in (sources + sources[:3], tests + tests[:3])]
    got = [tuple(r) for r in discovery.related_tests(*frames).collect()]
    assert set(got) == expected and len(got) == len(expected) > 100


def test_frequent_grams_are_not_looked_up(spark):
    """Every text holds `test`; a part that has a rarer gram meets the texts of that one alone."""
    wholes = spark.range(3000).selectExpr("concat('test_', lpad(conv(id, 10, 26), 4, 'z'), '_', id) AS whole")
    parts = spark.range(0, 3000, 10).selectExpr("concat('test_', lpad(conv(id, 10, 26), 4, 'z'), '_', id) AS part")
    found = discovery.contained(parts, wholes)
    assert found.where("part = whole").count() == 300
    joined = [n for n in _rows(found) if n]
    assert max(joined) < 3000 * 300 / 20


def test_numbered_texts_are_looked_up_by_long_grams(spark):
    """Of many numbers each few digits stand in a part of all; most of the digits stand in few."""
    wholes = spark.range(2048).selectExpr("concat('test_unit', lpad(bin(id), 11, '0'), '.py') AS whole").union(spark.createDataFrame([("unit01",), ("a",)], "whole string"))
    parts = spark.range(2048).selectExpr("concat('unit', lpad(bin(id), 11, '0')) AS part").union(spark.createDataFrame([("unit000000",), ("01.p",)], "part string"))
    found = discovery.contained(parts, wholes)
    a, b = [r[0] for r in wholes.collect()], [r[0] for r in parts.collect()]
    got = [tuple(r) for r in found.collect()]
    assert set(got) == {(p, w) for w in a for p in b if p in w} and len(got) == len(set(got))
    assert discovery.candidates(parts, wholes).count() < 100_000  # 4-letter grams: a few hundred thousand


def _rows(df):
    """Rows that inner joins gave, as their metrics say."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(plan.finalPhysicalPlan())
            continue
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(plan.plan())
            continue
        if "Join" in plan.getClass().getSimpleName():
            out.append(plan.metrics().apply("numOutputRows").value())
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_two_outputs_of_one_pass(spark, tmp_path):
    ok = "def test_a():\n    assert f(1)\ndef test_b():\n    assert f(2)\n"
    bodies = [ok, "def test_a(:\n  pass", "", ok + "# ***", "x = 1", ok, None]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    df = spark.createDataFrame([(i, "python", b, "src/a.py") for i, b in enumerate(bodies)], "i int, language string, content string, source_file string")
    df = df.withColumn("source_file", counted.asNondeterministic()("source_file"))
    valid, invalid = validation.validated_once(df, str(tmp_path / "out"))
    assert sorted(r.i for r in valid.collect()) == [0, 5]
    assert {r.i: r.reason for r in invalid.collect()} == {1: "syntax_error", 2: "empty", 3: "banned_pattern", 4: "no_tests", 6: "empty"}
    assert seen.value == len(bodies) and "Python" not in valid._jdf.queryExecution().executedPlan().toString()
    assert valid.columns == validation.validate(df).columns
    plan = validation.validate(df.drop("source_file").withColumn("source_file", F.lit("a.py")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2 and "Union" not in plan
    gated = spark.createDataFrame([(1, "rename", False), (2, "logic_change", True), (3, "deletion", False), (4, "logic_change", False)], "i int, change_type string, should_generate boolean")
    targets, upkeep = changes.targets_and_maintenance_once(gated, str(tmp_path / "parts"))
    assert [r.i for r in targets.collect()] == [2] and sorted(r.i for r in upkeep.collect()) == [1, 3]
    again = changes.targets_and_maintenance_once(gated.where("i = 1"), str(tmp_path / "parts"))
    assert [x.count() for x in again] == [0, 1]


def test_equal_texts_need_no_matcher(monkeypatch):
    from sparkloom.functions import source_code

    same = source_code.alike("():" + "a" * 60, "():" + "a" * 60, "f(a)", "f(a)")
    assert same == 1.0 and source_code.alike("", "", "f(a)", "g(a)") == 0.75 + 0.25 * 0.75

    class Never:
        def __init__(self, *args, **kwargs):
            raise AssertionError("compared")

    monkeypatch.setattr(source_code.difflib, "SequenceMatcher", Never)
    assert source_code.alike("():" + "a" * 60, "():" + "a" * 60, "f(a)", "f(a)") == 1.0


def test_groups_of_letters_drop_pairs_before_single_letters(spark):
    from sparkloom.operators import changes

    rows = [("f.py", None, i, f"{side}{i}", f"def {side}{i}(): " + c * 40, "s") for side, i, c in (("a", 0, "k"), ("b", 1, "l"), ("c", 2, "é"))]
    schema = "file_path string, enclosing_class_name string, ordinal int, function_name string, source_code string, signature string"
    new, old = spark.createDataFrame(rows, schema), spark.createDataFrame([(*r[:3], "x" + r[3], *r[4:]) for r in rows], schema)
    pairs = changes.rename_candidates(new, old, ["file_path"])
    assert sorted((r.n_at, r.o_at) for r in pairs.collect()) == [(0, 0), (1, 1), (2, 2)]
    assert "n_group15" in pairs._jdf.queryExecution().optimizedPlan().toString()
