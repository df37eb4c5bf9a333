"""Path predicates and projections as native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffix -> language, language -> generated file's suffix.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript"}
OUTPUT_SUFFIX = {"typescript": ".test.ts", "javascript": ".test.js"}
#: Folders that hold no sources.
IGNORED_FOLDERS = ("node_modules", ".next", "dist", "build", "public", ".nuxt", "out", "coverage", "__pycache__")
#: Patterns of files that are configuration.
CONFIG_FILES = (
    r"(^|/)dockerfile$", r"(^|/)\.env(?:\.[^/]+)?$", r"(^|/)(?:requirements|constraints)\.txt$", r"(^|/)package(?:-lock)?\.json$",
    r"(^|/)pnpm-lock\.yaml$", r"(^|/)yarn\.lock$", r"(^|/).*\.mdx?$", r"(^|/).*\.config\.(?:py|js|jsx|ts|tsx)$",
    r"(^|/)(?:jest|webpack|vite|rollup|babel|eslint|prettier|tsup|vitest|tailwind|postcss|next|nuxt)\.config\.(?:js|ts|mjs|cjs)$",
)
#: Words in names of configuration-like files.
CONFIG_WORDS = ("config", "settings", "constants", "env", "setup", "build")
#: Test files' patterns.
TEST_FILE = r"(^|/)(test_[^/]*\.py|[^/]*_test\.py|[^/]*\.(test|spec)\.(js|jsx|ts|tsx))$"
TEST_FOLDERS = ("tests", "test", "spec", "specs", "__tests__")


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(slashed(path), "/"), -1)


def stem(path: Column) -> Column:
    """The name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=[^/])\.[^./]*$", "")


def language_of(path: Column) -> Column:
    """By the last suffix in lower case; null for other files."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[suffix]


def languages_of(files: DataFrame, column: str = "file_path") -> DataFrame:
    """One row: the languages of all paths, sorted; other files do not count."""
    return files.agg(F.array_sort(F.collect_set(language_of(F.col(column)))).alias("languages"))


def script_languages(languages: Column) -> Column:
    """Those of an array of languages that are scripts'."""
    return F.array_sort(F.array_intersect(languages, F.array(F.lit("javascript"), F.lit("typescript"))))


def is_test_or_generated(path: Column) -> Column:
    low = F.lower(slashed(path))
    folders = F.array(*map(F.lit, IGNORED_FOLDERS))
    return low.contains("/tests/") | low.startswith("tests/") | low.contains("/ai_generated/") | F.arrays_overlap(F.split(low, "/"), folders)


def is_config_file(path: Column) -> Column:
    return F.lower(slashed(path)).rlike("|".join(CONFIG_FILES))


def has_config_name(path: Column) -> Column:
    return F.lower(stem(path)).rlike("|".join(CONFIG_WORDS))


def python_module(path: Column) -> Column:
    return F.replace(F.regexp_replace(F.regexp_replace(slashed(path), r"\.py$", ""), r"/?__init__$", ""), F.lit("/"), F.lit("."))


def module_name(path: Column) -> Column:
    return F.translate(F.regexp_replace(slashed(path), r"\.[^./]*$", ""), "/-", "__")


def sanitized_source(path: Column) -> Column:
    """Without a first folder in capitals that has an underscore, 8 characters or more, and letters only besides."""
    return F.regexp_replace(slashed(path), r"^(?=[^/]{8,}/.)(?=[^/]*_)[\p{Lu}_]*\p{Lu}[\p{Lu}_]*/", "")


def output_path(root: str, source: Column, test_id: Column, language: Column) -> Column:
    suffix = F.coalesce(F.create_map(*[F.lit(x) for kv in OUTPUT_SUFFIX.items() for x in kv])[language], F.lit(".py"))
    return F.concat_ws("/", F.lit(root), F.regexp_replace(sanitized_source(source), r"(?<=[^/])\.[^./]*$", ""), F.concat(F.lit("test_"), test_id, suffix))


def import_line(name: Column, path: Column, language: Column) -> Column:
    python = F.concat(F.lit("from "), F.replace(F.regexp_replace(slashed(path), r"\.py$", ""), F.lit("/"), F.lit(".")), F.lit(" import "), name)
    script = F.concat(F.lit("import { "), name, F.lit(" } from '"), F.regexp_replace(slashed(path), r"\.(tsx|ts|jsx|js)$", ""), F.lit("'"))
    return F.when(F.coalesce(path, F.lit("")) == "", F.concat(F.lit("# "), name, F.lit(" (third-party)"))).when(language == "python", python).otherwise(script)


def ancestors(path: Column) -> Column:
    """All folders above a path, the outermost first."""
    parts = F.split(slashed(path), "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
