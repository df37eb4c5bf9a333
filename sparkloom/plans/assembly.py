"""Targets and what their requests show: class source, dependencies, rules, existing tests, stand-ins, hints, within one budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import paths, prompts
from sparkloom.functions.source_code import class_source, extract_functions, test_names
from sparkloom.functions.text import POLICY, estimate_tokens, sanitize_identifier, split_lines, test_prefix, trim_space
from sparkloom.operators import budgets, dependencies, discovery, validation
from sparkloom.session import PARSED_ROWS, merged, parts_of, stored

#: The framework of each language.
FRAMEWORKS = {"python": "pytest", "javascript": "jest", "typescript": "jest"}
#: A request is too long from this many characters on: a quarter of it is above the budget of tokens.
MOST_CHARS = 4 * budgets.INPUT_BUDGET + 3
SCRIPTS = ("javascript", "typescript")
_KEY = ["diff_id", "file_path"]


def with_ids(changes: DataFrame) -> DataFrame:
    """Adds target_id, a number that a rerun gives again, and test_id."""
    return changes.withColumn("target_id", F.xxhash64("diff_id", "file_path", "function_name", "ordinal")).withColumn("test_id", sanitize_identifier(F.col("function_name")))


def with_class_source(targets: DataFrame, files: DataFrame) -> DataFrame:
    """A method's source_code becomes that of its whole class, as the file has it; it stays where the file has no such class."""
    methods = targets.where("enclosing_class_name <> ''").select("target_id", *_KEY, "language", "enclosing_class_name").join(merged(files.select(*_KEY, "content")), _KEY)
    found = methods.select("target_id", F.nullif(class_source("language", "content", "enclosing_class_name"), F.lit("")).alias("__class"))
    return targets.join(merged(found), "target_id", "left").withColumn("source_code", F.coalesce("__class", "source_code")).drop("__class")


def target_dependencies(targets: DataFrame, files: DataFrame) -> DataFrame:
    """target_id, rank, function_name, source_file, mode, content: what each target calls, best first.

    Functions are extracted from the targets' own files and the modules that these import, no
    others. References and functions are stored once each, as several joins read them."""
    files = files.withColumn("language", paths.language_of(F.col("file_path")))
    own = files.join(merged(targets.select(*_KEY).distinct()), _KEY, "left_semi")
    out = None
    for group, parse, lang in ((("python",), dependencies.python_imports, "python"), (SCRIPTS, dependencies.script_imports, "typescript")):
        of = F.col("language").isin(*group)
        refs = stored(dependencies.resolve_modules(parse(own.where(of), "diff_id"), files, lang, "diff_id"), "references")
        needed = targets.where(of).select(*_KEY).union(refs.select("diff_id", "module_path")).distinct()
        read = files.where(of).join(merged(needed), _KEY, "left_semi").repartition(parts_of(needed, PARSED_ROWS), "file_path")
        functions = stored(extract_functions(read, request="diff_id"), "functions")
        calls = targets.where(of).withColumn("change_id", F.col("target_id"))
        resolved = dependencies.resolve_calls(calls, functions, refs, "diff_id")
        rows = dependencies.select_dependencies(resolved, files, lang).withColumnRenamed("change_id", "target_id")
        out = rows if out is None else out.unionByName(rows)
    return out


def _block(language: Column, content: Column, name: Column) -> Column:
    """The named test up to the next one, trimmed."""
    quoted = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    python = F.concat(F.lit(r"(?msd)^def\s+"), quoted, F.lit(r"\(.*?(?=^def\s+test_|\z)"))
    script = F.concat(F.lit(r"(?msd)^\s*(?:it|test)\(\s*['\"`]"), quoted, F.lit(r"['\"`].*?(?=^\s*(?:it|test)\(\s*['\"`]test_|\z)"))
    return trim_space(F.call_function("regexp_extract", content, F.when(language == "python", python).otherwise(script), F.lit(0)))


def existing_tests(changes: DataFrame, tests: DataFrame) -> DataFrame:
    """target_id, existing_tests_text, existing_test_names, for changes that have any.

    Tests are those of related files whose names begin as the function's own would, under its
    name or its last one. Files are taken by path until there are enough blocks or characters;
    names of the files behind that are left out. Pairs of targets and files, and the tests
    found, are stored once each, as several joins read them."""
    related = discovery.related_tests(changes.select("file_path").distinct(), tests)
    asked = changes.select("target_id", "file_path", "language", test_prefix(F.col("function_name")).alias("a"), test_prefix(F.coalesce("previous_name", "function_name")).alias("b")).join(merged(related), "file_path")
    asked = stored(asked, "asked")
    read = asked.select("language", "test_path").distinct()
    bodies = read.join(merged(tests.select(F.col("file_path").alias("test_path"), "content")), "test_path")
    named = bodies.repartition(parts_of(read, PARSED_ROWS), "test_path").select("language", "test_path", "content", F.posexplode(test_names(F.col("language"), F.col("content"))).alias("at", "name"))
    hits = asked.join(merged(named), ["language", "test_path"]).where(F.col("name").startswith(F.col("a")) | F.col("name").startswith(F.col("b")))
    hits = hits.withColumn("file_ordinal", F.dense_rank().over(Window.partitionBy("target_id").orderBy("test_path")))
    hits = stored(hits.select("target_id", "file_ordinal", "at", "name", _block(F.col("language"), F.col("content"), F.col("name")).alias("text")), "hits")
    blocks = hits.where("text <> ''").groupBy("target_id", "file_ordinal", "text").agg(F.min("at").alias("ordinal"))
    kept = budgets.capped_blocks(blocks, places=True)
    names = hits.select("target_id", "file_ordinal", "name").join(merged(kept), "target_id", "left")
    before = F.coalesce(F.filter(F.arrays_zip("files", "kept"), lambda x: x["files"] < F.col("file_ordinal")), F.array().cast("array<struct<files:long,kept:string>>"))
    size = F.aggregate(before, F.lit(0), lambda n, x: n + F.length(x["kept"]))
    names = names.where((F.size(before) < budgets.MOST_BLOCKS) & (size < budgets.MOST_CHARS)).groupBy("target_id").agg(F.array_sort(F.collect_set("name")).alias("existing_test_names"))
    return names.join(merged(kept.select("target_id", F.array_join("kept", "\n\n").alias("existing_tests_text"))), "target_id", "left").withColumn("existing_tests_text", F.coalesce("existing_tests_text", F.lit("")))


def _in_order(rows: DataFrame, kind: str, name: str) -> DataFrame:
    got = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"])
    return rows.where(F.col("kind") == kind).groupBy("target_id").agg(got.alias(name))


def assemble(changes: DataFrame, files: DataFrame, tests: DataFrame, rules: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(targets, maintenance) of the changes that `generation.analyse` gives.

    `files` (diff_id, file_path, content): each request's files; `tests` (file_path, content):
    the discovered tests; `rules` (diff_id, kind, ordinal, rule), kind project_rule or
    request_rule. Targets have `request`, the text that a model gets, and `skipped` where even
    without rules, dependencies and tests it would be too long. Children (rules, dependencies,
    lines of tests) are rows until each target's fit its budget; then they are gathered in
    order. Changes, targets and children are stored once each, in the shared folder."""
    changes = stored(with_ids(changes), "changes")
    have = stored(existing_tests(changes.where("should_generate OR change_type IN ('rename', 'deletion')"), tests), "tests")
    none = F.array().cast("array<string>")
    with_tests = lambda df: df.join(merged(have), "target_id", "left").withColumn("existing_tests_text", F.coalesce("existing_tests_text", F.lit(""))).withColumn("existing_test_names", F.coalesce("existing_test_names", none))
    upkeep = with_tests(changes.where("change_type IN ('rename', 'deletion')"))
    upkeep = upkeep.select("target_id", "diff_id", F.col("file_path").alias("source_file"), "language", "function_name", "test_id", F.col("change_type").alias("action_type"), "previous_name", sanitize_identifier(F.coalesce("previous_name", "function_name")).alias("previous_test_id"), "existing_test_names")
    targets = with_tests(with_class_source(changes.where("should_generate"), files))
    language = F.col("language")
    seen = files.select(*_KEY, F.col("content").alias("__content"))
    hints = prompts.import_hints(language, F.col("file_path"), F.col("function_name"), F.nullif("enclosing_class_name", F.lit("")), F.col("__content"), root)
    targets = stored(targets.join(merged(seen), _KEY, "left").withColumn("hints", hints).withColumn("mocks", validation.to_mock(F.col("source_code"))).drop("__content"), "targets")

    ids = targets.select("target_id", "diff_id")
    kinds = F.explode(F.array(F.lit("project_rule"), F.lit("request_rule"))).alias("kind")
    policy = ids.select("diff_id").distinct().select("diff_id", kinds, F.lit(-1).alias("ordinal"), F.lit(POLICY).alias("rule"))
    every = policy.unionByName(rules.select("diff_id", "kind", F.col("ordinal").cast("int").alias("ordinal"), "rule"))
    fitting = budgets.split_rule_budget(every.withColumnRenamed("diff_id", "target_id")).withColumnRenamed("target_id", "diff_id")
    own_rules = ids.join(fitting, "diff_id").select("target_id", "kind", "ordinal", F.col("rule").alias("text"), F.lit(0).alias("weight"))
    entry = prompts.dependency_entry(F.col("mode"), F.col("function_name"), F.col("source_file"), F.col("content"))
    deps = target_dependencies(targets, files).select("target_id", F.lit("dependency").alias("kind"), F.col("rank").cast("int").alias("ordinal"), entry.alias("text"))
    deps = deps.withColumn("weight", estimate_tokens(F.col("text")))
    lines = targets.select("target_id", F.lit("test_line").alias("kind"), F.posexplode(split_lines(budgets.lines_within_budget(F.col("existing_tests_text")))).alias("ordinal", "text"), F.lit(0).alias("weight"))
    # children are made once and read once for each kind
    children = own_rules.unionByName(deps).unionByName(lines)

    framework = F.create_map(*[F.lit(x) for kv in FRAMEWORKS.items() for x in kv])[language]

    def text(of: DataFrame, deps: Column, tests: Column, project: Column, request: Column) -> Column:
        return prompts.request_text(of["language"], framework, of["function_name"], of["source_code"], of["hints"], deps, tests, project, request, of["mocks"], F.lit(False))

    bare = targets.select("target_id", F.lit("fixed").alias("kind"), F.lit(0).alias("ordinal"), F.length(text(targets, none, F.lit(""), none, none)).alias("tokens"), F.lit(0).alias("weight"), F.lit(None).cast("string").alias("text"))
    costs = children.withColumn("tokens", F.length("text") + F.when(F.col("kind") == "dependency", 2).otherwise(1))
    fitted = stored(budgets.evict_to_budget(bare.unionByName(costs), MOST_CHARS), "children")
    left = fitted.where("NOT evicted")
    skipped = fitted.where("kind = 'fixed'").select("target_id", "skipped")
    for kind, name in (("project_rule", "project_rules"), ("request_rule", "request_rules"), ("dependency", "dependencies"), ("test_line", "test_lines")):
        targets = targets.join(merged(_in_order(left, kind, name)), "target_id", "left").withColumn(name, F.coalesce(name, none))
    targets = targets.join(merged(skipped), "target_id")
    shown = text(targets, F.col("dependencies"), F.array_join("test_lines", "\n"), F.col("project_rules"), F.col("request_rules"))
    done = targets.withColumn("request", F.when(~F.col("skipped"), shown)).withColumn("generation_mode", F.lit("replace"))
    return done.select("target_id", "diff_id", F.col("file_path").alias("source_file"), "language", "function_name", "test_id", "generation_mode", "source_code", "project_rules", "request_rules", "dependencies", "existing_tests_text", "existing_test_names", "request", "skipped"), upkeep
