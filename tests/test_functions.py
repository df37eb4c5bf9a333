"""Functions against plain Python."""

import math
import posixpath
import re

import pytest
from pyspark.sql import functions as F

from sparkloom import config
from sparkloom.functions import paths, prompts, script_tokens, source_code, text

TEXTS = ["", "abc", "abcd efgh", "a\u00a0b\u3000c\x1cd\u0085e", "```py\nx = 1\n```\n", "x" * 41, "\n\n a \n"]


def one(spark, values, column, name="x"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[0] for r in df.select("i", column.alias("y")).orderBy("i").select("y").collect()]


def test_text_functions(spark):
    assert one(spark, TEXTS, text.estimate_tokens(F.col("x"))) == [0 if not t else max(1, len(t) // 4) for t in TEXTS]
    assert one(spark, TEXTS, text.strip_space(F.col("x"))) == ["".join(t.split()) for t in TEXTS]
    fenced = ["\n".join(line for line in t.split("\n") if not line.strip().startswith("```")).strip() for t in TEXTS]
    assert one(spark, TEXTS, text.strip_code_fences(F.col("x"))) == fenced
    names = ["a.b c", "__x__", "", "é", "Order.total!"]
    assert one(spark, names, text.sanitize_identifier(F.col("x"))) == [re.sub(r"[^A-Za-z0-9_]+", "_", n).strip("_") or "target" for n in names]
    assert one(spark, ["1", "2", "5", "40"], text.retry_temperature(F.col("x").cast("int"))) == pytest.approx([0, 0.3, 0.45, 0.8])
    assert one(spark, ["f(1) + g.h(2); if (x) f(3)"], text.called_functions(F.col("x"))) == [["f", "g.h"]]
    assert one(spark, ["a\nb\nc\nd"], text.line_slice(F.col("x"), F.lit(2), F.lit(3))) == ["b\nc"]
    assert one(spark, ["def test_a(x):\n  1\ndef test_b():\n  2\n"], text.named_block(F.col("x"), "test_a")) == ["def test_a(x):\n  1\n"]


def test_paths(spark):
    p = ["src/app.py", "tests/a.py", "web/dist/x.js", "UNIT_TESTS_REPO/backend/main.py", "backend/main.TSX", "x.md", "pkg/__init__.py", "src\\my_settings.ts"]
    assert one(spark, p, paths.language_of(F.col("x"))) == ["python", "python", "javascript", "python", "typescript", None, "python", "typescript"]
    assert one(spark, p, paths.is_test_or_generated(F.col("x"))) == [False, True, True, False, False, False, False, False]
    assert one(spark, p, paths.sanitized_source(F.col("x")))[3] == "backend/main.py"
    assert one(spark, p, paths.is_config_file(F.col("x"))) == [False] * 5 + [True, False, False]
    assert one(spark, p, paths.has_config_name(F.col("x"))) == [False] * 7 + [True]
    assert one(spark, p, paths.python_module(F.col("x")))[6] == "pkg"
    assert one(spark, p, paths.output_path("gen", F.col("x"), F.lit("f"), paths.language_of(F.col("x"))))[3] == "gen/backend/main/test_f.py"
    assert one(spark, ["a/b.py"], paths.import_line(F.lit("f"), F.col("x"), F.lit("python"))) == ["from a.b import f"]


PYTHON = '''
import os

class Cart:
    def total(self, rate: float = 1.0, *, tax=None):
        """Sum."""
        if tax is None:
            raise ValueError
        return helper(self.items) * rate

def helper(items):
    for i in items:
        print(i)
    return len(items)
'''
SCRIPT = """
export function add(a, b) { // { not counted
  if (a > b) { return "}"; }
  return a + b;
}
const twice = (x) => x * 2;
class Box {
  open(key) {
    return this.check(key);
  }
}
"""


def test_parsers():
    found = source_code.python_functions(PYTHON)
    assert [(f["function_name"], f["branch_count"], f["has_validation"], f["called_functions"]) for f in found] == [("Cart.total", 1, True, ["helper"]), ("helper", 1, False, ["print", "len"])]
    assert found[0]["signature"] == "def total(self, rate: float, *, tax)" and (found[1]["start_line"], found[1]["end_line"]) == (11, 14)
    assert source_code.python_functions("def (") == [] == source_code.python_functions(None)
    a, b = "def f(x):\n    '''d'''\n    y = x\n    return y", "def g(z):\n    w = z  # note\n    return w"
    assert source_code.canonical_python(a) == source_code.canonical_python(b) != source_code.canonical_python(b + " + 1")
    js = source_code.script_functions(SCRIPT)
    assert [(f["function_name"], f["start_line"], f["end_line"]) for f in js] == [("add", 2, 5), ("twice", 6, 6), ("Box.open", 8, 10)]
    assert js[2]["has_validation"] and js[2]["called_functions"] == ["open", "this.check"]
    assert source_code.parses("python", "x = 1") and not source_code.parses("python", "x =") and not source_code.parses("typescript", "f(}")
    assert math.isclose(source_code.alike("abc", "abc", "x", "x"), 1.0)


def row(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_names_of_tests(spark):
    cases = [("javascript", "it('adds two', () => {})\ntest_x = (1)", ["test_x", "it_adds_two"]), ("typescript", "describe('All of it', () => {})", ["describe_All_of_it"]), ("python", "def test_b(): pass\ndef test_a(): pass\ndef help(): pass", ["test_a", "test_b"]), ("python", "def (", []), (None, "it('test_q')  test( 'x' )", ["test_q"]), ("javascript", None, [])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, language string, content string")
    got = {r["i"]: r["n"] for r in df.select("i", source_code.test_names(F.col("language"), F.col("content")).alias("n")).collect()}
    assert got == {i: c for i, (_, _, c) in enumerate(cases)}


def test_script_tokens():
    t = script_tokens
    assert t.canonical('return "a b"') != t.canonical('return "ab"')
    assert t.canonical("a = 1 // x\n  + 2") == t.canonical("a=1+2 /* y */") != t.canonical("a = 12")
    assert t.canonical("`a ${b + `c ${d}`} e` ") == "`a ${b + `c ${d}`} e`" and t.canonical("x / 2 / y").count("/") == 2
    assert t.scan("const r = /[(]/g; a / b").kind == ["name", "name", "mark", "regex", "mark", "name", "mark", "name"]
    fine = ["const r = /[(]/;", "f(a => a / 2, `}${x}`)", "for (const x of /a/g) {}", "if (a) { return /x\\/y/.test(b) }", "", None, "const x = <p>it's</p>;", "type T = Map<string, Array<number>>;", "a ??= b", "for (;;) {}", "x = -1", "f(!a, ...b)"]
    bad = ["let = = 3 ;", "f(}", "const s = 'abc", "a = `x", "x = ;", "a && ", "/* open", "f(a == )", "((1)"]
    assert [x for x in fine if t.may_parse(x) is False] == [] and [x for x in bad if t.may_parse(x)] == []


def test_prompts(spark):
    lit = F.lit
    cases = {("src/web/a/box.ts", "tests/generated"): "../../src/web/a/box", ("tests/generated/x/y.js", "tests/generated"): "./x/y", ("a.js", ""): "./a", ("tests/z.js", "tests/generated"): "../z"}
    for (path, folder), want in cases.items():
        hints = row(spark, h=prompts.import_hints(lit("typescript"), lit(path), lit("Box.open"), lit(None).cast("string"), lit("export class Box {}"), folder))["h"]
        assert hints == [f"file: {path}", f"path: {want}", f"import: import {{ Box }} from '{want}'", "export: named"]
        assert posixpath.relpath(path.rsplit(".", 1)[0], folder or ".") == want.removeprefix("./")
    hints = row(spark, h=prompts.import_hints(lit("python"), lit("a/b/__init__.py"), lit("K.run"), lit("K"), lit(""), "t"))["h"]
    assert hints == ["file: a/b/__init__.py", "module: a.b", "import: from a.b import K", "no other module than a.b", "types may stand in package a"]
    assert row(spark, h=prompts.type_hint(lit("a/m.py"), lit("class A:\n  class B:\nclass C(A):\n" + "class D:\n" * 9), lit("a/n.py")))["h"] == "types of a/m.py: from a.m import A, C, D, D, D"
    assert row(spark, h=prompts.type_hint(lit("a/m.py"), lit("class A:"), lit("a/m.py")))["h"] is None
    assert [row(spark, h=prompts.export_style(lit(x)))["h"] for x in ("export default function f(){}", "export async function f(){}", "function f(){}", None)] == ["default", "named", "unclear", "unclear"]
    want = {("truncated", 1, True): ["truncated"], ("bad generator use", 5, True): ["generator", "component"], ("too_many_suspicious_imports(3)", 7, False): ["suspicious_imports", "short"], ("fake_import_js", 7, True): ["imports", "component", "short"], (None, 2, True): [], ("syntax_error", 4, True): []}
    for (reason, attempt, ui), ids in want.items():
        assert row(spark, c=prompts.corrections(lit(reason).cast("string"), lit(attempt), lit(ui)))["c"] == ids
    assert set(prompts.ADVICE) == {k for k, _ in prompts.CORRECTED} | {"component", "short"}
    assert row(spark, e=prompts.dependency_entry(lit("code"), lit("f"), lit("a.py"), lit(" x \n")), t=prompts.dependency_entry(lit("import_only"), lit("g"), lit(None).cast("string"), lit("# g"))).asDict() == {"e": "- f (a.py)\nx", "t": "- g (third-party)\n  # g"}
    none = F.array().cast("array<string>")
    assert row(spark, a=prompts.existing_tests(lit("repair"), F.array(lit("t1")), none, lit(" b ")), b=prompts.existing_tests(lit("replace"), none, none, lit(" b "))).asDict() == {"a": "Failing tests to repair:\n- t1\nTests so far:\nb", "b": " b "}
    text = row(spark, r=prompts.request_text(lit("python"), lit("pytest"), lit("f"), lit("def f(): ..."), F.array(lit("h")), none, lit(""), F.array(lit("p1"), lit("p2")), none, none, lit(False)))["r"]
    assert text == "## Task\nWrite 3 to 9 unit tests for f.\n\n## Language\npython, pytest\n\n## Imports\n- h\n\n## Project rules\np1\np2\n\n## Request rules\nnone\n\n## Code\ndef f(): ...\n\n## Dependencies\nnone\n\n## Existing tests\nnone"
    assert row(spark, r=prompts.retry_text(lit("R"), lit("stub_body"), lit(2), lit(False)))["r"] == "R\n\n## Rejected: stub_body\n\n- " + prompts.ADVICE["stub_body"]


def test_lines_rules_and_config(spark):
    assert row(spark, a=text.split_lines(F.lit("a\r\nb\x0bc\u2028\n")), b=text.split_lines(F.lit("x\n\n")), c=text.split_lines(F.lit(""))).asDict() == {"a": ["a", "b", "c", ""], "b": ["x", ""], "c": []}
    assert row(spark, a=text.request_context(F.lit(" T "), F.lit("\n")), b=text.request_context(F.lit(" "), F.lit(None).cast("string")), c=text.combined_rules("p", F.array(F.lit("a")), F.lit(None).cast("array<string>"))).asDict() == {"a": "T", "b": None, "c": ["p", "a"]}
    c = config.load_config({"SPARKLOOM_ROOT": "/r", "SPARKLOOM_MODEL": " m ", "SPARKLOOM_COMMENT": "TRUE", "SPARKLOOM_TIMEOUT_SECONDS": "9"})
    assert (c.tests_dir, c.model, c.comment, c.fail_on_failure, c.timeout_seconds, config.load_config({}).timeout_seconds) == ("/r/tests/generated", "m", True, False, 9, 150)
    f = spark.createDataFrame([("a.PY",), ("b.tsx",), ("c.md",)], "file_path string")
    langs = paths.languages_of(f)
    assert langs.first()["languages"] == ["python", "typescript"] and langs.select(paths.script_languages(F.col("languages")).alias("s")).first()["s"] == ["typescript"]
