"""What a request to a model is put together from, as native columns: hints, sections, corrections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import paths
from sparkloom.functions.text import trim_space

MOST_CLASSES = 5
#: From which attempt on a component's request and any request is made simpler.
COMPONENT_FROM, SHORT_FROM = 5, 7

def _list(*items: Column) -> Column:
    """The items that are not null, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


# ---------------------------------------------------------------- hints


def class_names(content: Column) -> Column:
    """The first classes that the text defines at the start of a line."""
    return F.slice(F.regexp_extract_all(content, F.lit(r"(?m)^class\s+(\w+)"), F.lit(1)), 1, MOST_CLASSES)


def relative_path(path: Column, folder: Column) -> Column:
    """`path` as seen from `folder`; both are relative to one root."""
    parts = lambda c: F.filter(F.split(c, "/"), lambda x: ~x.isin("", "."))
    p, d = parts(path), parts(folder)
    depth = F.least(F.size(p), F.size(d))
    common = F.size(F.filter(F.sequence(F.lit(0), depth), lambda i: (i > 0) & (F.slice(p, 1, i) == F.slice(d, 1, i))))
    up = F.array_repeat(F.lit(".."), F.size(d) - common)
    whole = F.array_join(F.concat(up, F.slice(p, common + 1, F.greatest(F.size(p), F.lit(1)))), "/")
    return F.when(whole == "", ".").otherwise(whole)


def import_hints(language: Column, source_file: Column, function_name: Column, class_name: Column, source: Column, folder: str) -> Column:
    """Lines that say how a target is imported: by module for Python, else by its path from `folder` and its style of export."""
    file = F.concat(F.lit("file: "), source_file)
    module = F.when(source_file.endswith(".py"), paths.python_module(source_file)).otherwise("")
    module = F.nullif(module, F.lit(""))
    name = F.coalesce(class_name, F.element_at(F.split(function_name, r"\."), -1))
    package = F.nullif(F.regexp_replace(module, r"\.?[^.]*$", ""), F.lit(""))
    python = _list(file, F.concat(F.lit("module: "), module), F.concat(F.lit("import: from "), module, F.lit(" import "), name), F.concat(F.lit("no other module than "), module), F.concat(F.lit("types may stand in package "), package))
    clean = F.regexp_replace(F.regexp_replace(paths.slashed(source_file), r"^[A-Za-z]:/", ""), r"^/+", "")
    target = relative_path(F.regexp_replace(clean, r"(?<=[^/])\.[^./]*$", ""), F.lit(folder))
    target = F.when(target.startswith("."), target).otherwise(F.concat(F.lit("./"), target))
    symbol = F.coalesce(class_name, F.element_at(F.split(function_name, r"\."), 1))
    style = export_style(source)
    default = F.concat(F.lit("import "), symbol, F.lit(" from '"), target, F.lit("'"))
    named = F.concat(F.lit("import { "), symbol, F.lit(" } from '"), target, F.lit("'"))
    line = F.when(style == "default", default).when(style == "named", named).otherwise(F.concat(named, F.lit(" or "), default))
    script = _list(file, F.concat(F.lit("path: "), target), F.concat(F.lit("import: "), line), F.concat(F.lit("export: "), style))
    return F.when(language == "python", python).otherwise(script)


def export_style(source: Column) -> Column:
    """default, named or unclear, by the words in the source; a default export wins."""
    text = F.coalesce(source, F.lit(""))
    return F.when(text.rlike(r"\bexport\s+default\b"), "default").when(text.rlike(r"\bexport\s+(?:function|const|class|let|var|async\s+function)\b"), "named").otherwise("unclear")


def type_hint(source_file: Column, content: Column, own_file: Column) -> Column:
    """How to import the classes of a dependency; null for the own module, other languages and files without classes."""
    module = paths.python_module(source_file)
    names = class_names(content)
    fits = source_file.endswith(".py") & (module != "") & ~module.eqNullSafe(F.when(own_file.endswith(".py"), paths.python_module(own_file))) & (F.size(names) > 0)
    return F.when(fits, F.concat(F.lit("types of "), source_file, F.lit(": from "), module, F.lit(" import "), F.array_join(names, ", ")))


# ---------------------------------------------------------------- sections


def dependency_entry(mode: Column, name: Column, source_file: Column, content: Column) -> Column:
    place = F.when(F.coalesce(source_file, F.lit("")) != "", F.concat(F.lit(" ("), source_file, F.lit(")"))).otherwise("")
    return F.when(mode == "import_only", F.concat(F.lit("- "), name, F.lit(" (third-party)\n  "), content)).otherwise(F.concat(F.lit("- "), name, place, F.lit("\n"), trim_space(content)))


def existing_tests(mode: Column, names: Column, notes: Column, text: Column) -> Column:
    """The tests that are there; for repairs, what to repair and why before them."""
    rows = lambda title, items: F.when(F.size(items) > 0, F.concat_ws("\n", F.lit(title), F.transform(items, lambda x: F.concat(F.lit("- "), x))))
    body = trim_space(F.coalesce(text, F.lit("")))
    repair = F.concat_ws("\n", rows("Failing tests to repair:", names), rows("Notes of failures:", notes), F.when(body != "", F.concat(F.lit("Tests so far:\n"), body)))
    return F.when(mode == "repair", trim_space(repair)).otherwise(F.coalesce(text, F.lit("")))


def section(title: str, body: Column, none: str | None = "none") -> Column:
    """A headed section; a blank body reads `none`, or gives null where that is None."""
    blank = F.coalesce(trim_space(body), F.lit("")) == ""
    text = F.concat(F.lit(f"## {title}\n"), F.when(blank, F.lit(none).cast("string")).otherwise(body))
    return text if none is not None else F.when(~blank, text)


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def request_text(language: Column, framework: Column, function_name: Column, code: Column, hints: Column, dependencies: Column, tests: Column, project_rules: Column, request_rules: Column, mocks: Column, is_repair: Column) -> Column:
    """All sections of one request, in their order; sections of rules, tests, hints and dependencies are never left out."""
    task = F.when(is_repair, F.lit("Repair the failing tests named below and keep their names.")).otherwise(F.concat(F.lit("Write 3 to 9 unit tests for "), function_name, F.lit(".")))
    return F.concat_ws(
        "\n\n", section("Task", task), section("Language", F.concat_ws(", ", language, framework)), section("Imports", bullets(hints)), section("Project rules", F.array_join(project_rules, "\n")), section("Request rules", F.array_join(request_rules, "\n")),
        section("To be mocked", bullets(mocks), None), section("Code", code), section("Dependencies", F.array_join(dependencies, "\n\n")), section("Existing tests", tests),
    )


# ---------------------------------------------------------------- corrections

#: Reasons for which a correction stands; a trailing % takes reasons that hold the word.
CORRECTED = (
    ("truncated", ("truncated",)),
    ("imports", ("fake_import_your_module", "placeholder_import", "fake_import_js")),
    ("generator", ("generator%",)),
    ("banned_pattern", ("banned_pattern",)),
    ("stub_body", ("stub_body",)),
    ("suspicious_imports", ("suspicious_imports%",)),
    ("missing_screen_import", ("missing_screen_import",)),
    ("banned_js_pattern", ("banned_js_pattern",)),
    ("no_tests", ("no_tests",)),
)
#: What each correction asks for.
ADVICE = {
    "truncated": "The answer broke off. End with a complete statement.",
    "imports": "Import from the paths under Imports alone; no made-up modules.",
    "generator": "Take values of a generator with next() or list().",
    "banned_pattern": "No engines, network, file writes or placeholders; mock them.",
    "stub_body": "Every test needs a body with assertions.",
    "suspicious_imports": "Do not import from modules that are not named under Imports.",
    "missing_screen_import": "Import screen together with render.",
    "banned_js_pattern": "Use toThrow, and module mocks in place of accessor spies.",
    "no_tests": "Name Python tests test_*, script tests by it() or test().",
    "component": "Render the component and use queries and events alone.",
    "short": "Write 3 to 6 tests and close every block.",
}


def corrections(reason: Column, attempt: Column, is_component: Column) -> Column:
    """The ids of the corrections that a rejected attempt calls for, in their order."""
    why = F.coalesce(reason, F.lit(""))
    tests = []
    for name, reasons in CORRECTED:
        hit = F.lit(False)
        for r in reasons:
            hit |= why.contains(r[:-1]) if r.endswith("%") else why == r
        tests.append((name, hit))
    tests += [("component", (attempt >= COMPONENT_FROM) & is_component), ("short", attempt >= SHORT_FROM)]
    return _list(*[F.when(hit, F.lit(name)) for name, hit in tests])


def retry_text(request: Column, reason: Column, attempt: Column, is_component: Column) -> Column:
    """A request with the reason of the rejection and its corrections behind it."""
    advice = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])
    lines = F.transform(corrections(reason, attempt, is_component), lambda x: F.element_at(advice, x))
    return F.concat_ws("\n\n", request, F.concat(F.lit("## Rejected: "), reason), F.nullif(bullets(lines), F.lit("")))
