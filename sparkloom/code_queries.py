"""Queries of operators on code and requests. No driver table holds code, so columns shaped like it are
derived from rows of the tables: texts are picked from short lists by a key. The SQL works the answers out
again, or states, text by text, the answer worked out by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import paths, prompts, source_code, text
from sparkloom.operators import attempts, budgets, changes, dependencies, discovery, logs, store, validation
from sparkloom.session import spread
from sparkloom.sources import records

_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        _ALL[f.__name__] = (f, sql)
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: str, values: tuple) -> Column:
    """The value whose turn it is."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _q(value: object) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (bool, int)) else "'" + str(value).replace("'", "''") + "'"


def _sql(key: str, values: tuple) -> str:
    return f"([{', '.join(map(_q, values))}])[{key} % {len(values)} + 1]"


# ---------------------------------------------------------------- paths

_NAMES = ("Dockerfile", ".env", ".env.local", "requirements.txt", "package-lock.json", "yarn.lock", "readme.MD", "jest.config.ts", "app.py", "x.config.JS", "my_settings.py", "a.tsx", "b.Jsx", "c.ts", "d.js", "noext", "build_all.py")
_FOLDERS = ("src/", "", "UNIT_TEST_REPO/app/", "a/b/", "Tests/", "node_modules/q/")
_PATH = f"({_sql('p_partkey', _FOLDERS)} || {_sql('p_partkey // 7', _NAMES)})"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").withColumn("k7", F.floor(F.col("p_partkey") / 7))
    return p.select("p_partkey", F.concat(_pick("p_partkey", _FOLDERS), _pick("k7", _NAMES)).alias("file_path"))


@_query(
    rf"""WITH f AS (SELECT p_partkey, {_PATH} AS p FROM part), s AS (SELECT *, lower(regexp_extract(p, '(\.[^./]+)$', 1)) AS x FROM f)
    SELECT p_partkey, CASE x WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' END AS language,
    regexp_matches(lower(p), '(^|/)(dockerfile|\.env(\.[^/]+)?|requirements\.txt|constraints\.txt|package\.json|package-lock\.json|pnpm-lock\.yaml|yarn\.lock|[^/]*\.mdx?|[^/]*\.config\.(py|js|jsx|ts|tsx))$') AS is_config,
    regexp_matches(lower(regexp_replace(list_last(string_split(p, '/')), '(.)\.[^.]*$', '\1')), 'config|settings|constants|env|setup|build') AS named_config FROM s"""
)
def q_path_predicates(spark, sf_dir):
    p = F.col("file_path")
    return _paths(spark, sf_dir).select("p_partkey", paths.language_of(p).alias("language"), paths.is_config_file(p).alias("is_config"), paths.has_config_name(p).alias("named_config"))


@_query(
    rf"""WITH f AS (SELECT p_partkey, {_PATH} AS p FROM part), s AS (SELECT *, lower(regexp_extract(p, '(\.[^./]+)$', 1)) AS x, CASE WHEN p LIKE 'UNIT_TEST_REPO/%' THEN substr(p, 16) ELSE p END AS c, regexp_replace(p, '\.[^./]*$', '') AS b FROM f)
    SELECT p_partkey, replace(regexp_replace(p, '\.py$', ''), '/', '.') AS module, replace(replace(b, '/', '_'), '-', '_') AS flat, c AS clean,
    'tests/generated/' || regexp_replace(c, '([^/])\.[^./]*$', '\1') || '/test_t' || p_partkey || CASE WHEN x IN ('.ts', '.tsx') THEN '.test.ts' WHEN x IN ('.js', '.jsx') THEN '.test.js' ELSE '.py' END AS target,
    CASE WHEN x = '.py' THEN 'from ' || replace(regexp_replace(p, '\.py$', ''), '/', '.') || ' import f' ELSE 'import {{ f }} from ' || chr(39) || regexp_replace(p, '\.(tsx|ts|jsx|js)$', '') || chr(39) END AS import_line FROM s"""
)
def q_module_paths(spark, sf_dir):
    p, lang = F.col("file_path"), F.col("language")
    some = _paths(spark, sf_dir).withColumn("language", paths.language_of(p))
    return some.select(
        "p_partkey", paths.python_module(p).alias("module"), paths.module_name(p).alias("flat"), paths.sanitized_source(p).alias("clean"),
        paths.output_path("tests/generated", p, F.concat(F.lit("t"), F.col("p_partkey").cast("string")), lang).alias("target"), paths.import_line(F.lit("f"), p, lang).alias("import_line"),
    )


@_query(f"""WITH f AS (SELECT DISTINCT {_PATH} AS p FROM part) SELECT 'javascript,python,typescript' AS languages, 'javascript,typescript' AS scripts FROM f LIMIT 1""")
def q_languages_of_paths(spark, sf_dir):
    found = paths.languages_of(_paths(spark, sf_dir))
    return found.select(F.array_join("languages", ",").alias("languages"), F.array_join(paths.script_languages(F.col("languages")), ",").alias("scripts"))


@_query(
    """WITH f AS (SELECT DISTINCT 'tests/g/' || c_nationkey || '/' || c_mktsegment || '/test_' || c_custkey || '.py' AS p, c_nationkey AS n, c_mktsegment AS m FROM customer)
    SELECT 'tests/__init__.py' AS file_path UNION SELECT 'tests/g/__init__.py' UNION SELECT 'tests/g/' || n || '/__init__.py' FROM f UNION SELECT 'tests/g/' || n || '/' || m || '/__init__.py' FROM f"""
)
def q_package_files(spark, sf_dir):
    return store.package_files(_t(spark, sf_dir, "customer").select(F.format_string("tests/g/%d/%s/test_%d.py", "c_nationkey", "c_mktsegment", "c_custkey").alias("target_file")), "tests")


@_query(
    """WITH f AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS m, (c_custkey % 5 < 4 OR c_nationkey % 7 = 0) AS gone FROM customer)
    SELECT 'g/' || n || '/' || m AS folder FROM f GROUP BY n, m HAVING bool_and(gone) UNION SELECT 'g/' || n FROM f GROUP BY n HAVING bool_and(gone)"""
)
def q_emptied_folders(spark, sf_dir):
    f = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.format_string("g/%d/%s/test_%d.py", "c_nationkey", "c_mktsegment", "c_custkey").alias("target_file"))
    return store.emptied_folders(f, f.where("c_custkey % 5 < 4 OR c_nationkey % 7 = 0"), "g")


# ---------------------------------------------------------------- functions, their gates and changes

_BODIES = (
    "def f(a):\n    return len(a)", "def f(a):\n    b = a + 1\n    return b", "def f(a):\n    if a:\n        return 1\n    return 2", "def f(a):\n    cache[a] = 1\n    return a",
    "def f(a):\n    validate(a)\n    return a", "def f(a):\n    return <Box/>", "function f(a) {\n  return a;\n}", "def f(a):\n    return go(a)", "def f(a):\n    pass", "@deco\ndef f(a):\n    x = 1\n    y = 2\n    z = 3\n    return x and await_(y)\n",
    "async def f(a):\n    await a\n    return 3", "def f(a):\n    a = 1\n    b = 2\n    c = 3\n    d = 4\n    e = 5\n    g = 6\n    return 7",
)
_BRANCHES = (0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0)
_CALLS = ("len", "", "", "", "validate", "", "", "go", "", "await_", "", "")


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", F.format_string("src/m%d.py", F.col("o_custkey") % 97).alias("file_path"), _pick("o_orderkey", _BODIES).alias("source_code"), _pick("o_orderkey", _BRANCHES).alias("branch_count"), (F.col("o_orderkey") % 5 == 4).alias("has_validation"),
        F.filter(F.array(_pick("o_orderkey", _CALLS)), lambda x: x != "").alias("called_functions"),
    )


_FUNCTIONS = f"""f AS (SELECT o_orderkey, 'src/m' || o_custkey % 97 || '.py' AS file_path, {_sql('o_orderkey', _BODIES)} AS s, {_sql('o_orderkey', _BRANCHES)} AS branches, o_orderkey % 5 = 4 AS v, {_sql('o_orderkey', _CALLS)} AS call FROM orders),
    b AS (SELECT *, list_filter(list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND x NOT LIKE '@%')[2:], lambda x: x NOT IN ('{{', '}}')) AS body FROM f),
    t AS (SELECT *, branches = 0 AND NOT v AND call IN ('', 'len') AND len(body) BETWEEN 1 AND 6 AND len(list_filter(body, lambda x: NOT regexp_matches(regexp_replace(x, ';+$', ''), '^(return\\b.*|pass|(const|let|var)\\s+[A-Za-z_$][\\w$]*\\s*=.*|[A-Za-z_$][\\w$.\\[\\]]*\\s*=.*)$') OR regexp_matches(x, '\\b(await|yield|raise|throw|try|except|catch|switch|case)\\b|&&|\\|\\||\\?'))) = 0 AS trivial FROM b)"""


@_query(f"WITH {_FUNCTIONS} SELECT o_orderkey, trivial FROM t")
def q_trivial_functions(spark, sf_dir):
    trivial = changes.is_trivial(F.col("source_code"), F.col("branch_count"), F.col("has_validation"), F.col("called_functions"))
    return _functions(spark, sf_dir).select("o_orderkey", trivial.alias("trivial"))


@_query(f"WITH {_FUNCTIONS} SELECT file_path, bool_and(trivial) AS is_config_like FROM t GROUP BY file_path")
def q_config_like_files(spark, sf_dir):
    return changes.config_like_files(_functions(spark, sf_dir))


@_query(
    rf"""WITH {_FUNCTIONS} SELECT o_orderkey, CASE WHEN regexp_matches(s, '\w+\s*\[.+\]\s*=|\.(append|close)\s*\(') OR regexp_matches(s, 'return\s*[(<]|</[a-zA-Z]|<[A-Z]') THEN false
    ELSE len(list_filter(string_split(s, chr(10)), lambda x: trim(x) <> '' AND trim(x) NOT LIKE '@%' AND NOT regexp_matches(x, '^\s*((async\s+)?(def|function)|class)\s+\w+'))) < 4 AND branches = 0 AND NOT v AND NOT regexp_matches(s, '(?i)\b(validate|check|parse|required|invalid|empty|none|null|raise|throw)\b') END AS skip FROM f"""
)
def q_skipped_functions(spark, sf_dir):
    skip = changes.should_skip(F.col("source_code"), F.col("branch_count"), F.col("has_validation"))
    return _functions(spark, sf_dir).select("o_orderkey", skip.alias("skip"))


_OLD = ("def f(a):\n    '''doc'''\n    y = go(a)\n    return y", "def f(a):\n    return go(a) + 1", "const f = (a) => { return 'a b' }", None)
_NEW = ("def f(b):\n    z = go(b)  # note\n    return z", "def f(a):\n    return go(a) + 2", "const f = (a) =>   {\n return 'a b' } // note", "const f = (a) => { return 'ab' }")
_KINDS = ("logic_change", "signature_change", "rename", "deletion", "logic_change")


@_query(
    f"""WITH c AS (SELECT o_orderkey AS k, o_orderkey % 4 AS o, o_orderkey // 4 % 4 AS n, {_sql('o_orderkey // 16', _KINDS)} AS kind, o_orderkey % 3 = 0 AS v FROM orders),
    b AS (SELECT *, (o IN (1, 3) OR kind = 'deletion' OR o <> n) AS behaves FROM c), s AS (SELECT *, CASE WHEN NOT behaves AND kind <> 'rename' THEN 'cosmetic_change' WHEN kind IN ('logic_change', 'signature_change') AND NOT v THEN 'short_function_without_branches_or_validation' END AS skip_reason FROM b)
    SELECT k AS o_orderkey, behaves AS has_behavioral_change, skip_reason, (kind NOT IN ('rename', 'deletion') AND behaves AND skip_reason IS NULL) AS should_generate FROM s"""
)
def q_generation_gates(spark, sf_dir):
    o = spread(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").withColumn("n", F.floor(F.col("o_orderkey") / 4)).withColumn("q", F.floor(F.col("o_orderkey") / 16))
    language = F.when(F.col("o_orderkey") % 4 < 2, "python").otherwise("javascript")
    c = o.select("o_orderkey", F.lit("f").alias("function_name"), language.alias("language"), _pick("o_orderkey", _OLD).alias("previous_source_code"), _pick("n", _NEW).alias("source_code"), _pick("q", _KINDS).alias("change_type"), F.lit(0).alias("branch_count"), (F.col("o_orderkey") % 3 == 0).alias("has_validation"))
    return changes.with_gates(c).select("o_orderkey", "has_behavioral_change", "skip_reason", "should_generate")


@_query(
    """WITH f AS (SELECT o_orderkey // 32 AS file, row_number() OVER (PARTITION BY o_orderkey // 32 ORDER BY o_orderkey) - 1 AS n FROM orders),
    c AS (SELECT file, 'fn' || n AS function_name, CASE n % 5 WHEN 1 THEN 'signature_change' WHEN 3 THEN 'deletion' ELSE 'logic_change' END AS change_type, CASE WHEN n % 5 <> 4 THEN 'fn' || n END AS previous_name FROM f WHERE n % 5 <> 2
    UNION ALL SELECT file, 'to' || n, 'rename', 'fn' || n FROM f WHERE n % 10 = 2 UNION ALL SELECT file, 'dup' || n, 'deletion', 'dup' || n FROM f WHERE n % 10 = 2
    UNION ALL SELECT file, 'to' || n, 'logic_change', NULL FROM f WHERE n % 10 = 7 UNION ALL SELECT file, 'fn' || n, 'deletion', 'fn' || n FROM f WHERE n % 10 = 7)
    SELECT 'src/' || file || '.py' AS file_path, function_name, change_type, previous_name FROM c"""
)
def q_classify_changes(spark, sf_dir):
    """Of a file's n-th function: 0 stays, 1 gets another signature, 2 another name (an equal one comes later and goes), 7 another name and class, 3 and 8 go, 4 and 9 are new."""
    w = Window.partitionBy("file").orderBy("o_orderkey")
    f = _t(spark, sf_dir, "orders").withColumn("file", F.floor(F.col("o_orderkey") / 32)).withColumn("n", F.row_number().over(w) - 1)
    case = F.col("n") % 5
    none = F.lit(None).cast("string")

    def version(rows: DataFrame, name: Column, signature: Column, owner: Column, at: int = 0) -> DataFrame:
        body = F.concat(name, F.lit("(): "), F.repeat(F.char(F.col("n") + 97), 60))
        return rows.select(
            F.format_string("src/%d.py", "file").alias("file_path"), F.lit("python").alias("language"), (F.col("n") + at).cast("int").alias("ordinal"), name.alias("function_name"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), body.alias("source_code"), body.alias("context_code"),
            signature.alias("signature"), owner.alias("enclosing_class_name"), F.array().cast("array<string>").alias("called_functions"), F.lit(0).alias("branch_count"), F.lit(False).alias("has_validation"),
        )

    of = lambda x: F.concat(F.lit(x), F.col("n").cast("string"))
    head = F.char(F.col("n") + 65)
    owner = F.when(case == 2, "C").otherwise(none)
    now = version(f.where("n % 5 <> 3"), F.when(case == 2, of("to")).otherwise(of("fn")), F.concat(head, F.when(case == 1, "(b)").otherwise("(a)")), F.when(F.col("n") % 10 == 7, "D").otherwise(owner))
    before = version(f.where("n % 5 <> 4"), of("fn"), F.concat(head, F.lit("(a)")), owner).unionByName(version(f.where("n % 10 = 2"), of("dup"), F.concat(head, F.lit("(a)")), owner, 1000))
    return changes.classify(now, before).select("file_path", "function_name", "change_type", "previous_name")


# ---------------------------------------------------------------- extraction


@_query(
    """SELECT n_nationkey, n_name || '.m' AS function_name, 2 AS start_line, 4 AS end_line, 1 AS branch_count, false AS has_validation, 'def m(self, a: int)' AS signature, 'helper,a.go' AS calls, n_name AS enclosing FROM nation
    UNION ALL SELECT n_nationkey, 'f' || n_nationkey, 7, 9, 0, true, 'async def f' || n_nationkey || '(x, /, *rest, y, **z)', 'check', NULL FROM nation"""
)
def q_python_functions(spark, sf_dir):
    code = F.concat(F.lit("class "), F.col("n_name"), F.lit(":\n    def m(self, a: int):\n        for i in helper(a):\n            a.go(i)\n\n@deco\nasync def f"), F.col("n_nationkey").cast("string"), F.lit("(x, /, *rest, y, **z):\n    def inner(): raise\n    check(x)\n"))
    files = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("file_path"), F.lit("python").alias("language"), code.alias("content"))
    found = source_code.extract_functions(files)
    return found.select(F.col("file_path").cast("long").alias("n_nationkey"), "function_name", "start_line", "end_line", "branch_count", "has_validation", "signature", F.array_join("called_functions", ",").alias("calls"), F.col("enclosing_class_name").alias("enclosing"))


@_query(
    """SELECT n_nationkey, 'add' || n_nationkey AS function_name, 1 AS start_line, 3 AS end_line, 1 AS branch_count, 'add' || n_nationkey || ',go' AS calls, 'function add' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '(a, b=...)' ELSE '(a, b = 1)' END AS signature FROM nation
    UNION ALL SELECT n_nationkey, 'twice', 4, 4, 0, 'async', CASE WHEN n_nationkey % 2 = 0 THEN 'async function twice(x)' ELSE 'function twice(x)' END FROM nation
    UNION ALL SELECT n_nationkey, n_name || '.open', 6, 8, 2, 'open,this.check', CASE WHEN n_nationkey % 2 = 0 THEN 'async function ' || n_name || '.open(key)' ELSE 'function open(key)' END FROM nation UNION ALL SELECT n_nationkey, 'k', 10, 10, 0, 'k', 'function k(a)' FROM nation"""
)
def q_script_functions(spark, sf_dir):
    code = F.concat(F.lit("export function add"), F.col("n_nationkey").cast("string"), F.lit("(a, b = 1) {\n  if (a) { return go(\"}\"); } // { open\n}\nconst twice = async (x) => x * 2;\nclass "), F.col("n_name"), F.lit(" {\n  async open(key) {\n    for (const k of key) { this.check(k) ? 1 : 2 }\n  }\n}\nfunction k(a) { return /[{]/ }\nconst g = useCallback((a) => a)\nexport class Out {\n  run() { }\n}\n"))
    files = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("file_path"), _pick("n_nationkey", ("javascript", "typescript")).alias("language"), code.alias("content"))
    return source_code.extract_functions(files).select(F.col("file_path").cast("long").alias("n_nationkey"), "function_name", "start_line", "end_line", "branch_count", F.array_join("called_functions", ",").alias("calls"), "signature")


@_query(
    """SELECT n_nationkey, 'run' AS function_name, 1 AS start_line FROM nation UNION ALL SELECT n_nationkey, n_name || '_open', 8 FROM nation UNION ALL SELECT n_nationkey, 'Full_constructor', 13 FROM nation"""
)
def q_script_functions_without_diff(spark, sf_dir):
    """Methods of exported classes count here; a constructor that only sets `this.x` does not."""
    code = F.concat(F.lit("async function run(a) {\n}\nexport default class "), F.col("n_name"), F.lit(" {\n  constructor(a) {\n    this.a = a;\n\n  }\n  open() { return /}/ }\n}\nif (a) { b(() => 1) }\nclass Full {\n\n  constructor() {\n    this.a = 1;\n    go()\n  }\n}\n"))
    files = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("file_path"), _pick("n_nationkey", ("javascript", "typescript")).alias("language"), code.alias("content"))
    return source_code.extract_functions(files, diff_free=True).select(F.col("file_path").cast("long").alias("n_nationkey"), "function_name", "start_line")


@_query(
    """SELECT n_nationkey, n_name || '_run' AS function_name, 4 AS start_line FROM nation UNION ALL SELECT n_nationkey, 'top', 8 FROM nation"""
)
def q_functions_without_diff(spark, sf_dir):
    code = F.concat(F.lit("class "), F.col("n_name"), F.lit(":\n    def __repr__(self):\n        return 'x'\n    def run(self):\n        return 1\n    def __init__(self, a):\n        self.a = a\ndef top():\n    return go()\ndef e():\n    '''d'''\n    pass\ndef to_dict():\n    return {}\n"))
    files = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("file_path"), F.lit("python").alias("language"), code.alias("content"))
    return source_code.extract_functions(files, diff_free=True).select(F.col("file_path").cast("long").alias("n_nationkey"), "function_name", "start_line")


_TESTS = (
    ("python", "def test_b():\n    assert f() == 1\n\nasync def test_a():\n    assert f(2) == 2\n", "test_a,test_b", True, ""),
    ("javascript", "it('adds two', () => { expect(f(1)).toBe(2) })\ntest('All, of it', () => {\n  expect(f(2)).toBe(3)\n})", "it_adds_two,it_All_of_it", True, ""),
    ("typescript", "describe('group', () => {\n})", "describe_group", True, "test_count_out_of_range(1)"),
    ("python", "def test_a(:\n    pass", "", False, "syntax_error"),
    ("python", "x = 1", "", True, "no_tests"),
    ("javascript", "it('a', () => {\n  expect(f(1)).toThrowError(/x[(]/)\n})", "it_a", True, "banned_js_pattern"),
    ("javascript", "it('a', () => { let = = 3 })\nit('b', () => {\n})", "it_a,it_b", False, "syntax_error"),
    ("python", "from your_mod import f\ndef test_a(): pass\ndef test_b(): pass", "test_a,test_b", True, "placeholder_import"),
    ("python", "import a.b\nimport c.d\nfrom e.f import g\ndef test_a(): pass\ndef test_b(): pass", "test_a,test_b", True, "too_many_suspicious_imports(3)"),
    ("python", "import src.b\nimport c.d\nfrom e.f import g\ndef test_a(): pass\ndef test_b(): pass", "test_a,test_b", True, ""),
    ("python", "def test_a():\n    open('x', 'w')\ndef test_b(): pass", "test_a,test_b", True, "banned_pattern"),
    ("python", "def test_a():\n    x = (1 +", "", False, "syntax_error"),
    ("python", "def test_a():\n    f(", "", False, "truncated"),
    ("javascript", "import f from 'placeholder'\nit('a', () => {\n})", "it_a", True, "fake_import_js"),
    ("python", "def test_a():\n    raise NotImplementedError", "test_a", True, "stub_body"),
    ("python", " ", "", True, "empty"),
    ("javascript", "it('a', () => {\n  if (x) /[(]/.test(y)\n})\nit('b', () => {\n})", "it_a,it_b", True, ""),
    ("typescript", "it('a', () => {\n  const f = () => <p>{a && (<b>x</b>)} <i/></p>\n})\nit('b', () => {\n})", "it_a,it_b", None, ""),
    ("javascript", "it('b', () => {})\nit('a', () => {\x0c})", "it_b,it_a", True, ""),
    ("javascript", "it('b', () => { f(1 2) })\nit('a', () => {\n})", "it_b,it_a", False, "syntax_error"),
)


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is parsed, so the keys are dealt to tasks before."""
    c = spread(_t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return c.select("c_custkey", _pick("c_custkey", tuple(x[0] for x in _TESTS)).alias("language"), _pick("c_custkey", tuple(x[1] for x in _TESTS)).alias("content"), F.lit("src/app.py").alias("source_file"))


@_query(f"SELECT c_custkey, {_sql('c_custkey', tuple(x[2] for x in _TESTS))} AS names, {_sql('c_custkey', tuple(x[3] for x in _TESTS))} AS valid FROM customer")
def q_test_names_and_syntax(spark, sf_dir):
    t = _tests(spark, sf_dir)
    return t.select("c_custkey", F.array_join(source_code.test_names(F.col("language"), F.col("content")), ",").alias("names"), source_code.is_syntax_valid("language", "content").alias("valid"))


@_query(f"SELECT c_custkey, {_sql('c_custkey', tuple(x[4] for x in _TESTS))} AS reason FROM customer")
def q_validation_reasons(spark, sf_dir):
    return validation.validate(_tests(spark, sf_dir)).select("c_custkey", "reason")


@_query(f"SELECT c_custkey FROM customer WHERE {_sql('c_custkey', tuple(x[4] for x in _TESTS))} = ''")
def q_valid_tests(spark, sf_dir):
    return validation.split_valid(_tests(spark, sf_dir))[0].select("c_custkey")


_IMPORTS = ("import a.b.c\nimport src.x\nfrom q.r import s\nfrom your_x import y\n", "import z\nfrom u.v import w\nimport k.l\nimport m.n\n", "x = 1\n", "from src.a import b\nfrom app.py import c\nfrom q.r import d\nimport e.f\nimport g.h", "import placeholder_q", "use your_module here")


@_query(
    rf"""WITH c AS (SELECT p_partkey, {_sql('p_partkey', _IMPORTS)} AS s FROM part), l AS (SELECT *, list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(x)), lambda x: x LIKE 'import %' OR x LIKE 'from %') AS l FROM c),
    m AS (SELECT *, list_filter(list_transform(l, lambda x: string_split(regexp_extract(x, '^(?:from|import)\s+([\w.]+)', 1), '.')), lambda p: len(p) >= 2 AND NOT list_has_any(p, ['src', 'app.py'])) AS odd FROM l)
    SELECT p_partkey, CASE WHEN contains(s, 'your_module') THEN 'fake_import_your_module' WHEN len(list_filter(l, lambda x: regexp_matches(x, '\b(your_|example_|placeholder_|fake_|dummy_module)\w*'))) > 0 THEN 'placeholder_import' WHEN len(odd) > 2 THEN 'too_many_suspicious_imports(' || len(odd) || ')' END AS reason FROM m"""
)
def q_import_checks(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", validation.import_failure(_pick("p_partkey", _IMPORTS), F.lit("python"), F.lit("src/app.py")).alias("reason"))


_SCRIPTS = ("return 'a b'", 'return "ab"', "return  'a b' // x", "return 'ab'", "a = /[(]/g /* c */ + 1", "a = /[(]/g+1", "f(`x ${y} z`)", "f( `x ${y} z` )", "f(`x ${y}  z`)", "return\n x", "return x", "a\n++b", "a++\nb", "if (x) /[(]/.test(y)", "if(x)/[(]/.test( y ) // z", "a\n++ b")
_SAME = (0, 1, 0, 2, 3, 3, 4, 4, 5, 6, 7, 8, 9, 10, 10, 8)


@_query(f"WITH c AS (SELECT c_custkey, {_sql('c_custkey', _SAME)} AS a, {_sql(f'c_custkey // {len(_SAME)}', _SAME)} AS b FROM customer) SELECT c_custkey, a = b AS same FROM c")
def q_canonical_scripts(spark, sf_dir):
    c = spread(_t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").withColumn("n", F.floor(F.col("c_custkey") / len(_SCRIPTS))).select("c_custkey", F.lit("typescript").alias("language"), _pick("c_custkey", _SCRIPTS).alias("a"), _pick("n", _SCRIPTS).alias("b"))
    return c.select("c_custkey", (source_code.canonical_form("language", "a") == source_code.canonical_form("language", "b")).alias("same"))


# ---------------------------------------------------------------- dependencies

_CALLERS = ("def f():\n    if check_it(1):\n        return a.b(2)\n", "def f():\n    while go(1): pass\n    return go(2)\n", "login()\nparse(x)", "return not_go(1)\nif go (2):\n  pass", "x = a.b(1)")
_NAMED = ("check_it", "a.b", "go", "login", "parse", "debugParser")
_WRAPPERS = ("def g(x):\n    return x", "def g(x):\n    a\n    b\n    c\n    return x", "// n\nfunction g() {\n  return 1\n}", "class G:\n  pass", "async g")


@_query(
    rf"""WITH c AS (SELECT p_partkey, {_sql('p_partkey', _CALLERS)} AS s, {_sql('p_partkey // 5', _NAMED)} AS n, {_sql('p_partkey // 30', _WRAPPERS)} AS w FROM part),
    l AS (SELECT *, list_filter(list_transform(string_split(w, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '//') AND NOT starts_with(x, '@')) AS l FROM c),
    p AS (SELECT *, len(l) <= 4 AND regexp_matches(lower(array_to_string(l, ' ')), '^(def |function |async)') AS wrapper FROM l)
    SELECT p_partkey, wrapper, (CASE WHEN regexp_matches(s, '\b(if|while)\b[^\n]*' || regexp_escape(n) || '\s*\(') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(s, '\breturn\b[^\n]*' || regexp_escape(n) || '\s*\(') THEN 3 ELSE 0 END
    + CASE WHEN regexp_matches(lower(n), 'validate|check|parse') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(n), 'log|print|debug|trace') THEN -5 ELSE 0 END + CASE WHEN wrapper THEN -3 ELSE 0 END)::INT AS score FROM p"""
)
def q_dependency_scores(spark, sf_dir):
    p = _t(spark, sf_dir, "part").withColumn("n", F.floor(F.col("p_partkey") / 5)).withColumn("w", F.floor(F.col("p_partkey") / 30))
    wrapper = _pick("w", _WRAPPERS)
    return p.select("p_partkey", dependencies.is_simple_wrapper(wrapper).alias("wrapper"), dependencies.dependency_score(_pick("n", _NAMED), _pick("p_partkey", _CALLERS), wrapper).cast("int").alias("score"))


_CALL_TABLES = """fn AS (SELECT 'm' || n_regionkey || '.py' AS file, 'g' || n_nationkey AS fn, n_nationkey AS ord FROM nation), ref AS (SELECT DISTINCT 'm' || a.r_regionkey || '.py' AS file, b.r_regionkey AS ord, 'x' || b.r_regionkey AS local, 'g' || b.r_regionkey AS imported, 'm' || b.r_regionkey || '.py' AS module FROM region a, region b WHERE b.r_regionkey <> a.r_regionkey)"""


@_query(
    f"""WITH {_CALL_TABLES}, c AS (SELECT c_custkey AS k, 'm' || c_custkey % 5 || '.py' AS file, unnest(['g' || c_nationkey, 'x' || c_custkey // 5 % 5, 'x' || c_custkey // 25 % 5 || '.g' || c_nationkey, 'none']) AS call FROM customer),
    d AS (SELECT DISTINCT k, file, call, list_last(string_split(call, '.')) AS bare, string_split(call, '.')[1] AS head FROM c),
    same AS (SELECT k, call, min_by(struct_pack(f := fn.file, n := fn.fn), ord) AS s FROM d JOIN fn ON fn.file = d.file AND fn.fn = d.bare GROUP BY k, call),
    via AS (SELECT k, call, min_by(struct_pack(m := module, w := CASE WHEN contains(call, '.') THEN bare ELSE imported END), ord) AS r FROM d JOIN ref ON ref.file = d.file AND local IN (head, bare) GROUP BY k, call),
    far AS (SELECT k, call, struct_pack(f := fn.file, n := fn.fn) AS s FROM via JOIN fn ON fn.file = r.m AND fn.fn = r.w)
    SELECT d.k AS c_custkey, d.call, coalesce(same.s, far.s).f AS source_file, coalesce(same.s, far.s).n AS function_name FROM d LEFT JOIN same ON same.k = d.k AND same.call = d.call LEFT JOIN far ON far.k = d.k AND far.call = d.call WHERE coalesce(same.s, far.s) IS NOT NULL"""
)
def q_resolved_calls(spark, sf_dir):
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    functions = n.select(F.format_string("m%d.py", "n_regionkey").alias("file_path"), F.format_string("g%d", "n_nationkey").alias("function_name"), F.lit("code").alias("source_code"), F.col("n_nationkey").alias("ordinal"))
    a = r.select(F.col("r_regionkey").alias("a")).join(r, F.col("a") != F.col("r_regionkey"))
    refs = a.select(F.format_string("m%d.py", "a").alias("file_path"), F.col("r_regionkey").alias("ordinal"), F.format_string("x%d", "r_regionkey").alias("local_name"), F.format_string("g%d", "r_regionkey").alias("imported_name"), F.format_string("m%d.py", "r_regionkey").alias("module_path"))
    k = F.col("c_custkey")
    calls = F.array(F.format_string("g%d", "c_nationkey"), F.format_string("x%d", F.floor(k / 5) % 5), F.format_string("x%d.g%d", F.floor(k / 25) % 5, F.col("c_nationkey")), F.lit("none"))
    c = _t(spark, sf_dir, "customer").select(k.alias("change_id"), F.format_string("m%d.py", k % 5).alias("file_path"), F.lit("self").alias("function_name"), F.lit(None).cast("string").alias("enclosing_class_name"), F.lit("c").alias("source_code"), calls.alias("called_functions"))
    return dependencies.resolve_calls(c, functions, refs).select(F.col("change_id").alias("c_custkey"), "call", "source_file", "function_name")


@_query(
    """WITH f AS (SELECT s_suppkey AS k, 'p/q' || s_suppkey % 10 || '/a' || s_suppkey || '.py' AS file FROM supplier)
    SELECT k AS s_suppkey, 'b' AS local_name, 'p/q' || k % 10 || '/a' || (k + 10) || '.py' AS module_path FROM f WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = k + 10)
    UNION ALL SELECT k, 'other', 'p/q' || (k + 1) % 10 || '/a' || (k + 1) || '.py' FROM f WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = k + 1) UNION ALL SELECT k, 'z', 'p/q' || k % 10 || '/a' || k || '.py' FROM f"""
)
def q_resolved_imports(spark, sf_dir):
    k = F.col("s_suppkey")
    path = lambda i: F.concat(F.lit("p/q"), (i % 10).cast("string"), F.lit("/a"), i.cast("string"))
    code = F.concat(F.lit("from .a"), (k + 10).cast("string"), F.lit(" import x as b, # c\nfrom ..q"), ((k + 1) % 10).cast("string"), F.lit(".a"), (k + 1).cast("string"), F.lit(" import (other)\nimport os\nimport "), F.replace(path(k), F.lit("/"), F.lit(".")), F.lit(" as z\n"))
    files = _t(spark, sf_dir, "supplier").select("s_suppkey", F.concat(path(k), F.lit(".py")).alias("file_path"), code.alias("content"))
    found = dependencies.resolve_modules(dependencies.python_imports(files), files, "python")
    return found.join(files.select("file_path", "s_suppkey"), "file_path").select("s_suppkey", "local_name", "module_path")


@_query(
    """WITH f AS (SELECT s_suppkey AS k FROM supplier) SELECT k AS s_suppkey, 'y' AS local_name, 'x' AS imported_name, 'w/b' || (k + 1) || '.ts' AS module_path FROM f WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = k + 1)
    UNION ALL SELECT k, 'z', 'z', 'w/b' || (k + 1) || '.ts' FROM f WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = k + 1) UNION ALL SELECT k, 'n', NULL, 'w/b' || k || '.ts' FROM f UNION ALL SELECT k, 'q', 'q', 'w/b0.ts' FROM f"""
)
def q_resolved_script_imports(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    code = F.concat(F.lit("import { x as y, z } from './b"), (F.col("s_suppkey") + 1).cast("string"), F.lit("';\nimport * as n from '../w/b"), k, F.lit("';\nimport r from 'react';\nconst q = require('./b0');\n"))
    files = _t(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("w/b"), k, F.lit(".ts")).alias("file_path"), code.alias("content"))
    found = dependencies.resolve_modules(dependencies.script_imports(files), files, "typescript")
    return found.join(files.select("file_path", "s_suppkey"), "file_path").select("s_suppkey", "local_name", "imported_name", "module_path")


@_query(
    """WITH r AS (SELECT l_orderkey AS change_id, 'f' || l_partkey % 7 AS fn, CASE WHEN l_suppkey % 3 = 0 THEN NULL WHEN l_suppkey % 3 = 1 THEN 'src/a.py' ELSE 'lib/site-packages/b.py' END AS file, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS call_at,
    CASE WHEN l_partkey % 2 = 0 THEN 'check' ELSE 'trace' END AS call FROM lineitem), b AS (SELECT *, CASE call WHEN 'check' THEN 2 ELSE -5 END - 3 AS score FROM r),
    m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY change_id, fn ORDER BY score DESC, call_at) AS r FROM b) WHERE r = 1), t AS (SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY score DESC, fn) AS rank FROM m)
    SELECT change_id, rank::INT AS rank, fn AS function_name, score::INT AS score, CASE WHEN file = 'src/a.py' THEN 'code' ELSE 'import_only' END AS mode, CASE WHEN file = 'src/a.py' THEN 'def g(): 1' WHEN file IS NULL THEN '# ' || fn || ' (third-party)' ELSE 'from lib.site-packages.b import ' || fn END AS content FROM t WHERE rank <= 20 AND score > -4"""
)
def q_selected_dependencies(spark, sf_dir):
    i = _t(spark, sf_dir, "lineitem")
    file = F.when(F.col("l_suppkey") % 3 == 1, "src/a.py").when(F.col("l_suppkey") % 3 == 2, "lib/site-packages/b.py")
    resolved = i.select(F.col("l_orderkey").alias("change_id"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("call_at"), F.when(F.col("l_partkey") % 2 == 0, "check").otherwise("trace").alias("call"), F.lit("").alias("caller"), file.alias("source_file"), F.concat(F.lit("f"), (F.col("l_partkey") % 7).cast("string")).alias("function_name"), F.lit("def g(): 1").alias("source_code"))
    files = spark.createDataFrame([("src/a.py",), ("lib/site-packages/b.py",)], "file_path string")
    return dependencies.select_dependencies(resolved, files, "python").select("change_id", "rank", "function_name", F.col("score").cast("int").alias("score"), "mode", "content")


# ---------------------------------------------------------------- tests and their names


@_query(
    """WITH s AS (SELECT p_partkey, lower(regexp_replace(p_name, '[^a-z]+', '_', 'g') || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '_' || p_size END) AS s FROM part), t AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'test_' || regexp_replace(p_name, '[^a-z]+', '_', 'g') || '.py' WHEN 1 THEN string_split(p_name, ' ')[1] || '.test.ts' ELSE 'test_' || p_size || '.py' END AS name FROM part),
    c AS (SELECT name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '\\.test$', ''), '^test_', ''), '^_+|_+$', '', 'g') AS t FROM t)
    SELECT p_partkey, 'tests/' || name AS test_path FROM s JOIN c ON length(s) >= 4 AND (contains(name, s) OR (length(t) >= 4 AND (contains(t, s) OR contains(s, t))))"""
)
def q_related_tests(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    flat = F.regexp_replace("p_name", "[^a-z]+", "_")
    sources = p.select("p_partkey", F.concat(F.lit("src/k"), F.col("p_partkey").cast("string"), F.lit("/"), flat, F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("_"), F.col("p_size").cast("string"))), F.lit(".py")).alias("file_path"))
    case = F.col("p_partkey") % 3
    name = F.when(case == 0, F.concat(F.lit("test_"), flat, F.lit(".py"))).when(case == 1, F.concat(F.split("p_name", " ")[0], F.lit(".test.ts"))).otherwise(F.concat(F.lit("test_"), F.col("p_size").cast("string"), F.lit(".py")))
    tests = p.select(F.concat(F.lit("tests/"), name).alias("file_path")).distinct()
    return discovery.related_tests(sources.select("file_path"), tests).join(sources, "file_path").select("p_partkey", "test_path")


@_query("SELECT p FROM (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'tests/test_' WHEN 1 THEN 'a/spec/x' WHEN 2 THEN 'a/b/c/tests/test_' ELSE 'src/test_' END || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.spec.ts' ELSE '_test.py' END AS p, c_custkey AS k FROM customer) WHERE (k % 4 = 0 OR (k % 4 = 1 AND k % 3 <> 0)) ORDER BY p LIMIT 500")
def q_discovered_tests(spark, sf_dir):
    k = F.col("c_custkey")
    folder = F.element_at(F.array(*map(F.lit, ("tests/test_", "a/spec/x", "a/b/c/tests/test_", "src/test_"))), (k % 4 + 1).cast("int"))
    files = _t(spark, sf_dir, "customer").select(F.concat(folder, k.cast("string"), _pick("c_custkey", (".py", ".spec.ts", "_test.py"))).alias("file_path"))
    return discovery.discover_tests(files).select(F.col("file_path").alias("p"))


@_query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE starts_with('test_' || (o_orderkey % 12) || '_' || o_orderkey, 'test_' || (c_custkey % 10) || '_') OR starts_with('test_' || (o_orderkey % 12) || '_' || o_orderkey, 'test_' || (c_nationkey % 10) || '_')")
def q_matching_test_names(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    names = o.select(F.col("o_custkey").alias("target_id"), F.concat(F.lit("test_"), (F.col("o_orderkey") % 12).cast("string"), F.lit("_"), F.col("o_orderkey").cast("string")).alias("name"))
    prefix = lambda x: text.test_prefix((F.col(x) % 10).cast("string"))
    prefixes = c.select(F.col("c_custkey").alias("target_id"), prefix("c_custkey").alias("prefix")).unionAll(c.select("c_custkey", prefix("c_nationkey")))
    return discovery.matching_test_names(names, prefixes).select(F.col("target_id").alias("c_custkey"), F.element_at(F.split("name", "_"), -1).cast("long").alias("o_orderkey"))


@_query(
    """SELECT c_nationkey, coalesce(array_to_string(list_sort(list_distinct(list(c_name) FILTER (c_custkey % 3 = 0))), ','), '') AS failed, coalesce(array_to_string(list_sort(list_distinct(list(c_name) FILTER (c_custkey % 3 = 2))), ','), '') AS not_attempted FROM customer GROUP BY c_nationkey"""
)
def q_unresolved_by_file(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    targets = c.select(F.col("c_custkey").alias("target_id"), F.col("c_nationkey").alias("source_file"), F.col("c_name").alias("function_name"))
    outcomes = c.where("c_custkey % 3 < 2").select(F.col("c_custkey").alias("target_id"), (F.col("c_custkey") % 3 == 1).alias("succeeded"))
    return attempts.unresolved_by_file(targets, outcomes).select(F.col("source_file").alias("c_nationkey"), F.array_join("failed", ",").alias("failed"), F.array_join("not_attempted", ",").alias("not_attempted"))


_TO_MOCK = (
    ("def f(a, db: Session = Depends(get)):\n    q# = store#.save(1)\n    q#.go(2)\n    self.run(x)\n    json.loads(s)\n    return cache#[k]", "store#.save(),cache#[...],db = Depends(...)"),
    ("def f(a):\n    api#.get(1)\n    api#.get(2)\n    api#.put(rows[0])\n    rows = [1]\n    return cls[0]", "api#.get(),api#.put()"),
    ("\n\n  function f(a = New#(1), b = 2) {\n    console.log(a);\n    if (n# == 3) { return state#[1] + state#[2] }\n  }", "state#[...],a = New#(...)"),
    ("def f():\n    n# == 3\n    n#.go()\n    return g(1)", ""),
    (" ", ""),
)


@_query(f"SELECT c_custkey, replace({_sql('c_custkey', tuple(x[1] for x in _TO_MOCK))}, '#', c_nationkey::VARCHAR) AS mocks FROM customer")
def q_to_mock(spark, sf_dir):
    """Pairs of thing and method, subscripts and made defaults; what a body assigns (`n# ==` counts as that) and a fixed list are left out."""
    source = F.replace(_pick("c_custkey", tuple(x[0] for x in _TO_MOCK)), F.lit("#"), F.col("c_nationkey").cast("string"))
    return _t(spark, sf_dir, "customer").select("c_custkey", F.array_join(validation.to_mock(source), ",").alias("mocks"))


@_query(
    """SELECT conv_id, 'def test_' || conv_id || '_a(x):' || chr(10) || '    assert ' || turn || chr(10) AS block FROM conversations"""
)
def q_named_blocks(spark, sf_dir):
    k = F.col("conv_id").cast("string")
    code = F.concat(F.lit("import x\ndef test_0():\n    pass\n"), F.lit("def test_"), k, F.lit("_a(x):\n    assert "), F.col("turn").cast("string"), F.lit("\ndef test_z():\n    y\n"))
    named = _t(spark, sf_dir, "conversations").select("conv_id", code.alias("c"))
    generic = F.regexp_replace("c", r"test_\d+_a", "test_named")
    return named.select("conv_id", F.regexp_replace(text.named_block(generic, "test_named"), "test_named", F.concat(F.lit("test_"), k, F.lit("_a"))).alias("block"))


# ---------------------------------------------------------------- budgets and rules

_TOK = "(CASE WHEN coalesce(length({0}), 0) = 0 THEN 0 ELSE greatest(1, length({0}) // 4) END)"


@_query(f"SELECT conv_id, kind, turn FROM (SELECT *, sum({_TOK.format('rule')}) OVER (PARTITION BY conv_id, kind ORDER BY turn ROWS UNBOUNDED PRECEDING) AS running FROM (SELECT conv_id, turn, role AS kind, repeat(text, 12) AS rule FROM conversations)) WHERE running <= 2250")
def q_split_rule_budget(spark, sf_dir):
    rules = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("target_id"), F.col("role").alias("kind"), F.col("turn").alias("ordinal"), F.repeat("text", 12).alias("rule"))
    return budgets.split_rule_budget(rules).select(F.col("target_id").alias("conv_id"), "kind", F.col("ordinal").alias("turn"))


@_query(
    """WITH RECURSIVE b AS (SELECT conv_id, turn // 2 AS file, turn, length(text) * 6 AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2, turn) AS r FROM conversations),
    s AS (SELECT conv_id, r, [turn] AS kept, n AS size, -1::BIGINT AS shut FROM b WHERE r = 1 UNION ALL
    SELECT b.conv_id, b.r, CASE WHEN b.file = s.shut OR len(kept) >= 4 OR size + n > 4000 THEN kept ELSE list_append(kept, turn) END, CASE WHEN b.file = s.shut OR len(kept) >= 4 OR size + n > 4000 THEN size ELSE size + n END, CASE WHEN b.file = s.shut OR len(kept) >= 4 THEN s.shut WHEN size + n > 4000 THEN b.file ELSE s.shut END FROM s JOIN b ON b.conv_id = s.conv_id AND b.r = s.r + 1)
    SELECT conv_id, array_to_string(max_by(kept, r), ',') AS kept FROM s GROUP BY conv_id"""
)
def q_capped_blocks(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    # a block's text begins with its turn and has six times the turn's length
    body = F.rpad(F.concat(F.col("turn").cast("string"), F.lit("|")), F.length("text") * 6, "x")
    blocks = c.select(F.col("conv_id").alias("target_id"), F.floor(F.col("turn") / 2).cast("int").alias("file_ordinal"), F.col("turn").cast("int").alias("ordinal"), body.alias("text"))
    return budgets.capped_blocks(blocks).select(F.col("target_id").alias("conv_id"), F.array_join(F.transform("kept", lambda x: F.split(x, r"\|")[0]), ",").alias("kept"))


@_query(f"SELECT conv_id, CASE WHEN turn % 3 = 0 THEN 'T' || turn WHEN turn % 3 = 1 THEN 'T' || turn || chr(10) || role END AS context, {_q(text.POLICY)} || '|' || role || CASE WHEN turn % 2 = 0 THEN '|r' ELSE '' END AS rules, turn FROM conversations")
def q_request_rules(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    title = F.when(F.col("turn") % 3 < 2, F.concat(F.lit(" T"), F.col("turn").cast("string"), F.lit(" \n"))).otherwise("\n ")
    rules = text.combined_rules(text.POLICY, F.array("role"), F.when(F.col("turn") % 2 == 0, F.array(F.lit("r"))))
    return c.select("conv_id", text.request_context(title, F.when(F.col("turn") % 3 == 1, F.col("role")).otherwise("  ")).alias("context"), F.array_join(rules, "|").alias("rules"), "turn")


@_query("SELECT conv_id, turn, 'x' || turn || chr(10) || '  y' AS content, role AS line FROM conversations")
def q_code_fences_and_lines(spark, sf_dir):
    fenced = F.concat(F.lit("```py\n\n"), F.lit("x"), F.col("turn").cast("string"), F.lit("\n ```\n  y\n```\n\n"))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", text.strip_code_fences(fenced).alias("content"), text.line_slice(F.concat(F.lit("a\nb\n"), "role", F.lit("\nc")), F.lit(3), F.lit(3)).alias("line"))


# ---------------------------------------------------------------- requests to a model

_REASONS = ("truncated", "fake_import_js", "generator_not_unwrapped", "banned_pattern", "stub_body", "too_many_suspicious_imports(4)", "missing_screen_import", "banned_js_pattern", "no_tests", "syntax_error", "placeholder_import")
_FIXES = ("truncated", "imports", "generator", "banned_pattern", "stub_body", "suspicious_imports", "missing_screen_import", "banned_js_pattern", "no_tests", "", "imports")


@_query(f"SELECT c_custkey, array_to_string(list_filter([{_sql('c_custkey', _FIXES)}, CASE WHEN c_nationkey % 9 + 1 >= 5 AND c_custkey % 2 = 0 THEN 'component' END, CASE WHEN c_nationkey % 9 + 1 >= 7 THEN 'short' END], lambda x: x <> ''), ',') AS fixes FROM customer")
def q_corrections(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return c.select("c_custkey", F.array_join(prompts.corrections(_pick("c_custkey", _REASONS), F.col("c_nationkey") % 9 + 1, F.col("c_custkey") % 2 == 0), ",").alias("fixes"))


_EXPORTS = ("export default function f() {}", "export const f = 1", "function f() {}")
_HINT_FILES = ("src/web/box.ts", "tests/generated/x/y.js", "C:\\w\\z.tsx", "tests/q.js")
_HINT_PATHS = ("../../src/web/box", "./x/y", "../../w/z", "../q")


@_query(
    f"""WITH c AS (SELECT c_custkey, c_name, {_sql('c_custkey', _HINT_FILES)} AS f, {_sql('c_custkey', _HINT_PATHS)} AS p, c_custkey // 4 % 3 AS e FROM customer)
    SELECT c_custkey, 'file: ' || f || '|path: ' || p || '|import: ' || CASE e WHEN 0 THEN 'import ' || c_name || ' from ''' || p || '''' WHEN 1 THEN 'import {{ ' || c_name || ' }} from ''' || p || '''' ELSE 'import {{ ' || c_name || ' }} from ''' || p || ''' or import ' || c_name || ' from ''' || p || '''' END || '|export: ' || (['default', 'named', 'unclear'])[e + 1] AS hints FROM c"""
)
def q_script_import_hints(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").withColumn("e", F.floor(F.col("c_custkey") / 4))
    hints = prompts.import_hints(F.lit("typescript"), _pick("c_custkey", _HINT_FILES), F.concat("c_name", F.lit(".open")), F.lit(None).cast("string"), _pick("e", _EXPORTS), "tests/generated")
    return c.select("c_custkey", F.array_join(hints, "|").alias("hints"))


@_query(
    """SELECT c_custkey, 'file: a/n' || c_nationkey || '.py|module: a.n' || c_nationkey || '|import: from a.n' || c_nationkey || ' import ' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'run' END || '|no other module than a.n' || c_nationkey || '|types may stand in package a' AS hints,
    CASE WHEN c_nationkey <> 3 AND c_custkey % 4 > 0 THEN 'types of a/n' || c_nationkey || '.py: from a.n' || c_nationkey || ' import ' || (['A', 'A, B', 'A, B, C, D, E'])[c_custkey % 4] END AS types FROM customer"""
)
def q_python_import_hints(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    file = F.format_string("a/n%d.py", "c_nationkey")
    hints = prompts.import_hints(F.lit("python"), file, F.concat("c_mktsegment", F.lit(".run")), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), F.lit(""), "t")
    types = prompts.type_hint(file, _pick("c_custkey", ("x = 1\n  class Q:", "class A:\n", "class A:\nclass B(A):\n", "class A:\nclass B:\nclass C:\nclass D:\nclass E:\nclass F:\n")), F.lit("a/n3.py"))
    return c.select("c_custkey", F.array_join(hints, "|").alias("hints"), types.alias("types"))


@_query(
    """SELECT c_custkey, '## Task' || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN 'Repair the failing tests named below and keep their names.' ELSE 'Write 3 to 9 unit tests for ' || c_name || '.' END || chr(10) || chr(10) || '## Language' || chr(10) || 'python, pytest' || chr(10) || chr(10) || '## Imports' || chr(10) || '- h' || chr(10) || chr(10)
    || '## Project rules' || chr(10) || 'none' || chr(10) || chr(10) || '## Request rules' || chr(10) || c_mktsegment || chr(10) || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN '## To be mocked' || chr(10) || '- db' || chr(10) || chr(10) ELSE '' END || '## Code' || chr(10) || 'c' || chr(10) || chr(10)
    || '## Dependencies' || chr(10) || '- g (third-party)' || chr(10) || '  # g' || chr(10) || chr(10) || '- k (k.py)' || chr(10) || 'body' || chr(10) || chr(10) || '## Existing tests' || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN 'Failing tests to repair:' || chr(10) || '- t1' || chr(10) || 'Tests so far:' || chr(10) || 'old' ELSE 'none' END AS request FROM customer"""
)
def q_request_texts(spark, sf_dir):
    none = F.array().cast("array<string>")
    repair = F.col("c_custkey") % 3 == 0
    tests = prompts.existing_tests(F.when(repair, "repair").otherwise("replace"), F.array(F.lit("t1")), none, F.when(repair, " old ").otherwise(""))
    deps = F.array(prompts.dependency_entry(F.lit("import_only"), F.lit("g"), F.lit(None).cast("string"), F.lit("# g")), prompts.dependency_entry(F.lit("code"), F.lit("k"), F.lit("k.py"), F.lit(" body\n")))
    whole = prompts.request_text(F.lit("python"), F.lit("pytest"), F.col("c_name"), F.lit("c"), F.array(F.lit("h")), deps, tests, none, F.array("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("db"))).otherwise(none), repair)
    return _t(spark, sf_dir, "customer").select("c_custkey", whole.alias("request"))


# ---------------------------------------------------------------- store, logs, events


@_query(
    """WITH a AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'rename' ELSE 'deletion' END AS kind, 's' || o_custkey % 50 AS f, 'g' || o_orderkey % 40 AS n, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'p' || o_orderkey % 40 END AS p FROM orders WHERE o_orderkey % 11 = 0),
    k AS (SELECT DISTINCT f || '::' || CASE WHEN kind = 'rename' AND p <> '' THEN p ELSE n END AS key FROM a), b AS (SELECT DISTINCT 's' || o_custkey % 50 || '::g' || o_orderkey % 40 AS key FROM orders WHERE o_orderkey % 2 = 0)
    SELECT count(*) AS deleted FROM b WHERE key IN (SELECT key FROM k)"""
)
def q_maintenance_deletes(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    name = lambda c: F.concat(F.lit(c), (F.col("o_orderkey") % 40).cast("string"))
    file = F.concat(F.lit("s"), (F.col("o_custkey") % 50).cast("string"))
    actions = o.where("o_orderkey % 11 = 0").select(F.when(F.col("o_orderkey") % 3 == 0, "rename").otherwise("deletion").alias("action_type"), file.alias("source_file"), name("g").alias("function_name"), F.when(F.col("o_orderkey") % 6 == 0, "").otherwise(name("p")).alias("previous_name"))
    base = o.where("o_orderkey % 2 = 0").select(store.mapping_key(file, name("g")).alias("key")).distinct()
    return store.deleted_count(base, store.maintenance_deletes(actions))


@_query(
    """SELECT 'f' || c_nationkey || '.py::' || c_name AS key, 't/f' || c_nationkey || '/test_' || regexp_replace(c_name, '[^A-Za-z0-9_]+', '_', 'g') || '.py' AS target_file, 'test_' || c_custkey % 3 || ',test_x' AS names FROM customer"""
)
def q_store_entries(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    test = F.concat(F.lit("test_"), (F.col("c_custkey") % 3).cast("string"))
    g = c.select(F.format_string("f%d.py", "c_nationkey").alias("source_file"), F.lit("python").alias("language"), F.col("c_name").alias("function_name"), text.sanitize_identifier(F.col("c_name")).alias("test_id"), F.array(F.lit("test_x"), test, test).alias("test_names"))
    return store.entries(g, "t").select("key", "target_file", F.array_join("test_names", ",").alias("names"))


@_query(
    """SELECT n_regionkey, '{' || string_agg('"' || n_regionkey || '::' || n_name || '":{"source_file":"' || n_regionkey || '","function_name":"' || n_name || '"}', ',' ORDER BY n_regionkey || '::' || n_name) || '}' AS mapping FROM nation GROUP BY n_regionkey"""
)
def q_mapping_json(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("source_file"), F.col("n_name").alias("function_name"))
    rows = n.select(store.mapping_key(F.col("source_file"), F.col("function_name")).alias("key"), "source_file", "function_name")
    return store.as_json(rows).select(F.col("source_file").cast("long").alias("n_regionkey"), "mapping")


@_query(
    """SELECT n_regionkey, 'import unittest' || chr(10) || 'from json import loads' || chr(10) || string_agg(DISTINCT 'from src.m import ' || n_name, chr(10) ORDER BY 'from src.m import ' || n_name) || chr(10) || chr(10) || string_agg('def test_' || n_nationkey || '(): pass' || chr(10) || '  # c', chr(10) || chr(10) || chr(10) ORDER BY n_nationkey) || chr(10) AS content FROM nation GROUP BY n_regionkey"""
)
def q_merged_artifacts(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    code = F.concat(F.lit("from src.m import "), F.col("n_name"), F.lit(", gone as q\nimport pytest\nfrom os import (\n  path,\n)\n\nfrom json import loads\nfrom app.z import gone\n"), F.lit("def test_"), F.col("n_nationkey").cast("string"), F.lit("(): pass\n  # c\n\n"))
    tests = n.select(F.col("n_regionkey").alias("source_file"), F.col("n_nationkey").alias("ordinal"), code.alias("content"))
    return store.merge_artifacts(tests, n.select(F.col("n_regionkey").alias("source_file"), F.col("n_name").alias("name"))).select(F.col("source_file").alias("n_regionkey"), "content")


@_query(
    """SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN 'test_a' || o_custkey % 20 WHEN 1 THEN 'test_b' || o_custkey % 20 ELSE 'test_c' || o_custkey % 20 END AS name FROM orders"""
)
def q_failed_tests(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    n = (F.col("o_custkey") % 20).cast("string")
    case = F.col("o_orderkey") % 3
    out = F.when(case == 0, F.concat(F.lit("FAILED t.py::test_a"), n, F.lit(" - E"))).when(case == 1, F.concat(F.lit("t.py::test_b"), n, F.lit(" FAILED"))).otherwise(F.lit(""))
    err = F.when(case == 2, F.concat(F.lit(" x \n  ✕ test_c"), n, F.lit(" (3 ms)"))).otherwise(F.lit(None).cast("string"))
    return logs.failed_tests(o.select(F.when(case == 2, "javascript").otherwise("python").alias("language"), out.alias("stdout"), err.alias("stderr")))


@_query("SELECT DISTINCT 'failed' AS kind, 'test_ai_generated_m' || o_custkey % 30 || '.py' AS file FROM orders UNION SELECT DISTINCT 'collected', 'test_ai_generated_m' || o_custkey % 30 || '.py' FROM orders WHERE o_orderkey % 50 = 0")
def q_failed_files(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    n = F.concat(F.lit("test_ai_generated_m"), (F.col("o_custkey") % 30).cast("string"), F.lit(".py"))
    r = o.select(F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit("ERROR  collecting a/b/"), n)).otherwise("").alias("stdout"), F.concat(F.lit("at x/"), n, F.lit(": 1")).alias("stderr"))
    return logs.failed_files(r).select(F.lit("failed").alias("kind"), "file").unionAll(logs.collection_errors(r).select(F.lit("collected"), "file"))


@_query("SELECT o_orderkey, 'o/r' || o_custkey % 5 AS repository, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 1 ELSE o_orderkey + 2 END::INT AS number, 'main' AS base, 'b' || o_orderkey AS head, CASE WHEN o_orderkey % 3 = 0 THEN 'T' END AS title FROM orders")
def q_event_context(spark, sf_dir):
    k = F.col("o_orderkey")
    null = F.lit(None)
    pull = F.struct(F.when(k % 2 == 0, k + 1).otherwise(0).alias("number"), F.struct(F.lit("main").alias("ref")).alias("base"), F.struct(F.concat(F.lit("b"), k.cast("string")).alias("ref")).alias("head"), F.when(k % 3 == 0, "T").otherwise(null).alias("title"))
    payload = F.to_json(F.struct(F.struct(F.concat(F.lit("o/r"), (F.col("o_custkey") % 5).cast("string")).alias("full_name")).alias("repository"), (k + 2).alias("number"), pull.alias("pull_request")))
    got = records.event_context(_t(spark, sf_dir, "orders").select(payload.alias("payload")))
    return got.select(F.substring("head_branch", 2, 20).cast("long").alias("o_orderkey"), "repository", F.col("pull_request_number").alias("number"), F.col("base_branch").alias("base"), F.col("head_branch").alias("head"), "title")


@_query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'text ' || p_name ELSE '' END AS content, CASE WHEN p_partkey % 4 = 2 THEN p_brand END AS previous FROM part")
def q_contents_and_versions(spark, sf_dir):
    p = _t(spark, sf_dir, "part").withColumn("file_path", F.concat(F.lit("f"), F.col("p_partkey").cast("string")))
    files = p.where("p_partkey % 2 = 0").select("file_path", F.concat(F.lit("text "), F.col("p_name")).alias("content"))
    versions = p.select("file_path", F.when(F.col("p_partkey") % 4 == 2, "base").otherwise("other").alias("ref"), F.col("p_brand").alias("content"))
    return records.with_previous(records.with_contents(p.select("p_partkey", "file_path"), files), versions, "base").select("p_partkey", "content", F.col("previous_source").alias("previous"))


@_query(
    """WITH s AS (SELECT c_custkey AS k, c_mktsegment AS m FROM customer) SELECT k AS c_custkey, m IN ('HOUSEHOLD', 'MACHINERY') AND k % 3 < 2 AS is_component, k % 4 + 1 AS attempt, CASE WHEN k % 4 = 0 THEN 0 ELSE least(0.2 + (k % 4 + 1) * 0.05, 0.8) END::DOUBLE AS temperature, k % 5 = 0 AS rate_limited FROM s"""
)
def q_attempt_plan(spark, sf_dir):
    k = F.col("c_custkey")
    source = F.when(F.col("c_mktsegment").isin("HOUSEHOLD", "MACHINERY"), "return (<Box/>)").otherwise("return 1")
    c = _t(spark, sf_dir, "customer").select("c_custkey", validation.is_component(source, _pick("c_custkey", ("javascript", "typescript", "python"))).alias("is_component"), (k % 4 + 1).alias("attempt"), F.when(k % 5 == 0, "Too Many Requests").when(k % 5 == 1, "oops").alias("message"))
    return attempts.attempt_plan(c).select("c_custkey", "is_component", "attempt", F.round("temperature", 10).alias("temperature"), "rate_limited")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}
