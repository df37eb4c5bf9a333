"""Scalar text functions as native columns; all of them stay in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.split() takes as white space, for Java's regular expressions.
SPACE = r"(?U)[\s\x1c-\x1f]"


def estimate_tokens(text: Column) -> Column:
    """A quarter of the code points, at least 1; 0 for an empty or null text."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


#: Where Python's str.splitlines() breaks.
LINE_BREAKS = "\n\x0b\f\r\x1c\x1d\x1e\x85\u2028\u2029"
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c\x1d\x1e\x85\u2028\u2029]"


def split_lines(text: Column) -> Column:
    """The lines; an empty one behind the last break does not count."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", "")


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def strip_code_fences(text: Column) -> Column:
    """Without the lines that open or close a code fence, trimmed."""
    return trim_space(F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~trim_space(x).startswith("```")), "\n"))


def sanitize_identifier(name: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("target"))


def test_prefix(name: Column) -> Column:
    return F.concat(F.lit("test_"), sanitize_identifier(name), F.lit("_"))


def retry_temperature(attempt: Column, first: float = 0.0) -> Column:
    return F.when(attempt <= 1, F.lit(first)).otherwise(F.least(F.lit(0.2) + attempt * 0.05, F.lit(0.8)))


def is_rate_limited(message: Column) -> Column:
    return F.lower(message).rlike("429|rate limit|too many requests")


#: Words that take an opening bracket and are no calls.
CALL_KEYWORDS = ("if", "for", "while", "switch", "catch", "function")


def called_functions(source: Column) -> Column:
    """Names before an opening bracket, the first of each, in order."""
    names = F.array_distinct(F.regexp_extract_all(source, F.lit(r"\b([A-Za-z_][\w.]*)\s*\("), F.lit(1)))
    return F.filter(names, lambda x: ~x.isin(*CALL_KEYWORDS))


def joined_output(stdout: Column, stderr: Column) -> Column:
    return F.concat_ws("\n", F.nullif(stdout, F.lit("")), F.nullif(stderr, F.lit("")))


def request_context(title: Column, body: Column) -> Column:
    """Title and body as one rule; blank parts fall away, null if both are blank."""
    blank = F.lit("")
    return F.nullif(F.concat_ws("\n", F.nullif(trim_space(title), blank), F.nullif(trim_space(body), blank)), blank)


#: The rule that stands before all others.
POLICY = "Tests are deterministic and need neither network nor files."


def combined_rules(policy: str, constraints: Column, rules: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.array(F.lit(policy)), F.coalesce(constraints, none), F.coalesce(rules, none))


def line_slice(source: Column, start: Column, end: Column) -> Column:
    """Lines start..end, from 1, both included."""
    return F.array_join(F.slice(F.split(source, "\n", -1), F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n")


def named_block(content: Column, name: str) -> Column:
    """From `def name(` to the next top-level test or the end."""
    return F.regexp_extract(content, rf"(?ms)^([ \t]*def \Q{name}\E\(.*?)(?=^[ \t]*def test_|\z)", 1)
