"""Content checks: predicates and the first failure's reason."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.source_code import is_syntax_valid, test_names
from sparkloom.functions.text import LINE_BREAKS, SPACE, split_lines, trim_space
from sparkloom.operators.outcomes import split_once

#: What generated tests must not hold (Unicode word characters are meant).
BANNED = (
    r"(?U)(?<![\w*])\*{3,}(?![\w*])", r"(?U)(?<![\w?])\?{3,}(?![\w?])", r"(?iU)\b(?:todo|tbd)\b", r"(?U)\byour_module\b", r"(?U)\bcreate_engine\s*\(",
    r"(?U)\b(?:requests|httpx)\.(?:get|post|put|delete|patch)\s*\(", r"(?U)\b(?:sqlite3|psycopg|psycopg2)\.connect\s*\(", r"(?U)\bopen\s*\([^\n,]+,\s*['\"](?:w|a|x)",
    r"(?U)\b(?:Path|pathlib\.Path)\([^\n]*\)\.(?:write_text|write_bytes|open)\s*\(",
    r"(?U)(?:requests|httpx|aiohttp|urllib)\s*\.\s*(?:get|post|put|delete|patch|request)\s*\(\s*['\"]https?://(?!(?:example\.com|test\.com|localhost|127\.0\.0\.1))[a-zA-Z0-9][a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    r"(?mU)^\s*const\s+\w+\s*=\s*require\s*\(",
)
#: What scripts must not hold; marks of stubs; marks of components.
BANNED_SCRIPT = (r"\.toThrowError\s*\(", r"jest\.spyOn\s*\([^)]+,\s*['\"][^'\"]+['\"],\s*['\"](?:get|set)['\"]")
STUBS = r"(?i)pass\s*#\s*TODO|raise\s+NotImplementedError|#\s*implement|#\s*fill\s+in"
COMPONENT = (r"return\s*\(\s*<", r"return\s*<", r"=>\s*\(\s*<", r"=>\s*<", r"<[A-Z]\w*", r"</[a-zA-Z]", r"React\.createElement")
FEWEST_TESTS, MOST_TESTS, MOST_SUSPICIOUS = 2, 30, 2


#: What a text (in lower case, if the pattern takes any case) has to hold for the pattern of the same place in BANNED to match: a search for
#: a plain string costs far less than the pattern, and most texts hold none of them.
BANNED_HOLDS = (("***",), ("???",), ("todo", "tbd"), ("your_module",), ("create_engine",), ("requests", "httpx"), (".connect",), ("open",), ("Path(",), ("http",), ("require",))


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out |= text.contains(w)
    return out


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out |= text.rlike(p)
    return out


def ascii_words(pattern: str) -> str:
    """A pattern of BANNED with the word characters of ASCII alone. Java's own `\\b` takes letters of any script, so edges of words are written out."""
    return re.sub(r"^\(\?(\w*)U\)", lambda m: f"(?{m[1]})" if m[1] else "", pattern).replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def has_banned_content(text: Column, unicode: bool = True) -> Column:
    """Word characters are those of Unicode, or else of ASCII, as engines without Unicode classes take them: there `é***` is banned."""
    out = F.lit(False)
    for words, pattern in zip(BANNED_HOLDS, BANNED, strict=True):
        out |= _holds(F.lower(text) if pattern.startswith("(?i") else text, words) & text.rlike(pattern if unicode else ascii_words(pattern))
    return out


def is_component(text: Column, language: Column) -> Column:
    return language.isin("javascript", "typescript") & _any(text, COMPONENT)


#: How the last line of a script ends, and of Python where something is to follow.
SCRIPT_END = r"^\s*\}[\s\)]*;?\s*$"
PYTHON_OPEN = (r"[\\:]$", r"(==|!=|<=|>=|(?<!\w)=(?!\w)|,|\()\s*$", r"\b(and|or|not)\s*$")
MOST_OPEN = 3


def is_truncated(text: Column, language: Column) -> Column:
    """By the last line that is not blank, and by brackets that are left open. No text is split for that; the rarer line breaks are looked for in what the usual ones leave."""
    rest = F.regexp_replace(text, rf"{SPACE}+\z", "")
    tail = F.substring_index(F.replace(rest, F.lit("\r"), F.lit("\n")), "\n", -1)
    last = F.substring_index(F.translate(tail, LINE_BREAKS, "\n" * len(LINE_BREAKS)), "\n", -1)
    script = language.isin("javascript", "typescript") & ~last.rlike(SCRIPT_END)
    python = (language == "python") & _any(last, PYTHON_OPEN)
    size = lambda a, b, c: F.octet_length(F.replace(F.replace(F.replace(text, F.lit(a)), F.lit(b)), F.lit(c)))
    return (rest == "") | F.coalesce(script | python, F.lit(False)) | (size(")", "]", "}") - size("(", "[", "{") > MOST_OPEN)


#: Imports that were made up, of Python and of scripts; the modules that are looked at.
PLACEHOLDERS = r"\b(your_|example_|placeholder_|fake_|dummy_module)\w*"
FAKE_MODULES = "your_module|example_module|placeholder"
PYTHON_MODULE = r"^(?:from|import)\s+([\w.]+)"
SCRIPT_MODULE = r"(?:from|require\()\s*['\"]([^'\"]+)['\"]"


def import_failure(text: Column, language: Column, source_file: Column) -> Column:
    """A reason or null."""
    some = text.contains("import") | text.contains("from") | text.contains("require(")
    lines = F.when(some, F.transform(F.split(text, r"\r\n|\n|\r"), trim_space)).otherwise(F.array().cast("array<string>"))
    own = F.filter(lines, lambda x: x.startswith("import ") | x.startswith("from "))
    placeholder = F.exists(own, lambda x: x.rlike(PLACEHOLDERS))
    parts = F.filter(F.split(F.translate(source_file, "\\", "/"), "/"), lambda x: x != "")
    modules = F.transform(own, lambda x: F.split(F.regexp_extract(x, PYTHON_MODULE, 1), r"\."))
    odd = F.size(F.filter(modules, lambda m: (F.size(m) >= 2) & ~F.arrays_overlap(m, parts)))
    fake = F.exists(lines, lambda x: F.regexp_extract(x, SCRIPT_MODULE, 1).rlike(FAKE_MODULES))
    return (
        F.when(text.contains("your_module"), "fake_import_your_module")
        .when((language == "python") & placeholder, "placeholder_import")
        .when(language.isin("javascript", "typescript") & fake, "fake_import_js")
        .when((language == "python") & (odd > MOST_SUSPICIOUS), F.format_string("too_many_suspicious_imports(%d)", odd))
    )


def native_failure(text: Column, language: Column, source_file: Column, unicode: bool = True) -> Column:
    """The first reason of the checks that need no parser, or null; for `unicode` see `has_banned_content`."""
    return F.coalesce(
        F.when(F.coalesce(trim_space(text), F.lit("")) == "", "empty"),
        F.when(is_truncated(text, language), "truncated"),
        F.when(_holds(F.lower(text), ("#", "notimplementederror")) & text.rlike(STUBS), "stub_body"),
        import_failure(text, language, source_file),
        F.when(has_banned_content(text, unicode), "banned_pattern"),
        F.when(language.isin("javascript", "typescript") & _any(text, BANNED_SCRIPT), "banned_js_pattern"),
    )


#: Not deterministic as far as plans go: a condition on the reason stays behind the parsers. Put before them, it would hold all native checks
#: many times over, as each use of a column is written out.
_parses = F.pandas_udf(is_syntax_valid.func, T.BooleanType()).asNondeterministic()


def validate(contents: DataFrame) -> DataFrame:
    """`contents` (..., language, content, source_file) with `reason`, '' where all checks pass.

    The native checks run once. The parsers, the only Python step, get null in place of the
    texts that failed them. A script whose syntax is not decided counts as one that parses."""
    first = contents.withColumn("__native", native_failure(F.col("content"), F.col("language"), F.col("source_file")))
    left = lambda c: F.when(F.col("__native").isNull(), F.col(c))
    seen = first.withColumn("__language", left("language")).withColumn("__content", left("content"))
    seen = seen.withColumn("__ok", F.coalesce(_parses("__language", "__content"), F.lit(True))).withColumn("__n", F.size(test_names(F.col("__language"), F.col("__content"))))
    parsed = F.when(~F.col("__ok"), "syntax_error").when(F.col("__n") == 0, "no_tests").when(~F.col("__n").between(FEWEST_TESTS, MOST_TESTS), F.format_string("test_count_out_of_range(%d)", F.col("__n"))).otherwise("")
    return seen.withColumn("reason", F.coalesce("__native", parsed)).drop("__native", "__language", "__content", "__ok", "__n")


def split_valid(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and invalid contents as two plans; `validated_once` gives both from one pass."""
    checked = validate(contents)
    return checked.where("reason = ''"), checked.where("reason <> ''")


def validated_once(contents: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid and invalid contents, from one pass that writes them to `path`, a part for each outcome."""
    parts = split_once(validate(contents), F.when(F.col("reason") == "", "valid").otherwise("invalid"), ["valid", "invalid"], path)
    return parts["valid"], parts["invalid"]


#: Names that need no stand-in, and those that are never state of somebody else.
NEVER_MOCKED = (
    "self", "cls", "str", "int", "float", "bool", "list", "dict", "set", "tuple", "type", "re", "os", "sys", "math", "json", "time", "datetime", "timedelta", "pathlib", "Path",
    "console", "Math", "JSON", "Object", "Array", "Promise", "Error", "String", "Number",
)
NEVER_STATE = ("self", "cls")
#: Names that a body assigns; calls of a thing's method; subscripts; parameters whose default a framework makes.
ASSIGNED, METHOD_CALL, SUBSCRIPT, MADE_DEFAULT = r"(?mdU)^\s{4,}(\w+)\s*=", r"(?U)\b(\w+)\.(\w+)\s*\(", r"(?U)\b(\w+)\s*\[", r"(?U)(\w+)\s*(?::\s*[\w\[\]| ,]+)?\s*=\s*([A-Z]\w*)\s*\("


def to_mock(source: Column) -> Column:
    """What a test of the function has to put stand-ins for, in order: `thing.method()` of things that it does not assign itself, `name[...]`, `parameter = Default(...)`."""
    text = F.coalesce(source, F.lit(""))
    found = lambda x, p, i: F.regexp_extract_all(x, F.lit(p), F.lit(i))
    own = found(text, ASSIGNED, 1)
    calls = F.arrays_zip(found(text, METHOD_CALL, 1).alias("a"), found(text, METHOD_CALL, 2).alias("b"))
    calls = F.transform(F.filter(calls, lambda x: ~x["a"].isin(*NEVER_MOCKED) & ~F.array_contains(own, x["a"])), lambda x: F.concat(x["a"], F.lit("."), x["b"], F.lit("()")))
    state = F.transform(F.filter(F.array_except(found(text, SUBSCRIPT, 1), own), lambda x: ~x.isin(*NEVER_STATE)), lambda x: F.concat(x, F.lit("[...]")))
    head = F.element_at(split_lines(trim_space(text)), 1)
    made = F.transform(F.arrays_zip(found(head, MADE_DEFAULT, 1).alias("a"), found(head, MADE_DEFAULT, 2).alias("b")), lambda x: F.concat(x["a"], F.lit(" = "), x["b"], F.lit("(...)")))
    return F.when(trim_space(text) == "", F.array().cast("array<string>")).otherwise(F.concat(F.array_distinct(calls), state, made))
