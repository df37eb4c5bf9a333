"""Diffs to changed lines, functions they touch, and classified changes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import paths
from sparkloom.functions.source_code import canonical_form, similarity
from sparkloom.functions.text import LINE_BREAK, strip_space, trim_space
from sparkloom.operators.outcomes import split_once
from sparkloom.session import merged

RENAME_AT = 0.58
#: Calls that do not count, and the lines of a trivial body.
TRIVIAL_CALLS = ("bool", "dict", "float", "frozenset", "int", "len", "list", "set", "sorted", "str", "tuple", "Object", "Array", "String", "Number", "Boolean")
COMPLEX_LINE = r"\b(await|yield|raise|throw|try|except|catch|switch|case)\b|&&|\|\||\?"
SIMPLE_LINE = r"^(?:return\b.*|pass$|(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*=.*|[A-Za-z_$][\w$\.\[\]]*\s*=.*|[{}]$)$"
#: A hint at validation; marks of side effects; marks of markup.
VALIDATION_HINT = r"(?i)\b(validate|check|parse|required|invalid|empty|none|null|raise|throw)\b"
SIDE_EFFECTS = (
    r"\b\w+\s*\[.+\]\s*=(?!=)",
    r"\bdel\s+\w+\s*\[",
    r"\b\w+\.(append|extend|update|pop|remove|delete|commit|rollback|add|flush|execute|send|publish|write|save|close)\s*\(",
    r"\b_\w+\s*\[.+\]\s*=",
)
#: Fixed value: a line that only opens a function or class.
HEADER_LINE = r"^\s*((async\s+)?(def|function)|class)\s+\w+"
MARKUP = r"return\s*[\(<]|=>\s*[\(<]|<[A-Z][a-zA-Z]+|</[a-zA-Z]"


#: A hunk's header; where a file's section begins.
HUNK = r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
SECTION, TARGET = "diff --git ", "+++ b/"


def hunks(diffs: DataFrame) -> DataFrame:
    """`diffs` (diff_id, text) to diff_id, file_path, old_start, old_size, new_start, new_size, a row for each hunk.

    A text is cut before every line that begins a section or names a target, so each piece
    holds its own path and its hunks; lines need no order among each other, and nothing is
    shuffled. A text may be a whole diff or some of its sections."""
    cut = rf"(?:\A|{LINE_BREAK})(?=\Q{SECTION}\E|\Q{TARGET}\E)"
    # outer, as Spark else makes each array twice more to look whether it has elements; the conditions drop the nulls
    pieces = diffs.select("diff_id", F.explode_outer(F.split("text", cut, -1)).alias("piece")).where(F.col("piece").startswith(TARGET))
    head = F.split("piece", LINE_BREAK, 2)[0]
    path = F.translate(trim_space(F.substring(head, len(TARGET) + 1, 1 << 30)), "\\", "/")
    found = pieces.select("diff_id", path.alias("file_path"), F.explode_outer(F.regexp_extract_all("piece", F.lit(rf"(?:{LINE_BREAK})({HUNK})"), F.lit(1))).alias("hunk")).where("file_path <> '' AND hunk IS NOT NULL")
    span = lambda i: F.substring(F.split_part(F.col("hunk"), F.lit(" "), F.lit(i)), 2, 1 << 30)
    start = lambda i: F.substring_index(span(i), ",", 1).cast("int")
    size = lambda i: F.when(span(i).contains(","), F.substring_index(span(i), ",", -1).cast("int")).otherwise(1)
    return found.select("diff_id", "file_path", start(2).alias("old_start"), size(2).alias("old_size"), start(3).alias("new_start"), size(3).alias("new_size"))


def changed_lines(diffs: DataFrame) -> DataFrame:
    """`diffs` (diff_id, text) to distinct (diff_id, file_path, side, line); side is 'added' or 'removed'.

    A file's section reaches from its `+++ b/` line to the next section; a size that is left
    out is 1, one of 0 gives no line. See `hunks`: rows of one diff need not be together."""
    sides = F.array(
        F.struct(F.lit("removed").alias("side"), F.col("old_start").alias("start"), F.col("old_size").alias("n")), F.struct(F.lit("added").alias("side"), F.col("new_start").alias("start"), F.col("new_size").alias("n"))
    )
    spans = hunks(diffs).select("diff_id", "file_path", F.inline(sides)).where("n > 0")
    return spans.select("diff_id", "file_path", "side", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("line")).distinct()


def impacted(functions: DataFrame, lines: DataFrame, key: str | Sequence[str] = "file_path", empty_side: str = "all") -> DataFrame:
    """Interval semi-join: functions whose [start_line, end_line] holds a line of their file.

    A file without any line keeps all its functions (`empty_side='all'`) or none ('none').
    The file (and the request, where `key` names both) is an equality key, so no plan compares
    all functions with all lines."""
    keys = [key] if isinstance(key, str) else list(key)
    own = lines.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("line").alias("__line"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k) == F.col(f"__{k}")
    hit = functions.join(merged(own), same & F.col("__line").between(F.col("start_line"), F.col("end_line")), "left_semi")
    if empty_side == "none":
        return hit
    return hit.unionByName(functions.join(merged(own.drop("__line").distinct()), same, "left_anti"))


_FIELDS = "function_name start_line end_line source_code context_code signature enclosing_class_name called_functions branch_count has_validation".split()
_PREVIOUS = ("name", "function_name"), ("signature", "signature"), ("source_code", "source_code"), ("context_code", "context_code")
#: Letters that are counted one by one; all others count together.
_LETTERS = [chr(c) for c in range(33, 127)]
#: Groups of letters, whose counts are compared before those of single letters.
_GROUPS = 16


def bare_body(source: Column, name: Column) -> Column:
    """Without white space and without the last part of the function's name."""
    last = F.element_at(F.split(name, r"\."), -1)
    return F.replace(strip_space(F.coalesce(source, F.lit(""))), last, F.lit(""))


def letter_counts(text: Column) -> Column:
    own = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in _LETTERS]
    return F.array(*own, F.length(F.regexp_replace(text, r"[!-~]", "")))


def _at_most(a: Column, b: Column, common: Column) -> Column:
    """The most that two texts with so many letters in common can be alike, as twice that over both lengths."""
    return F.when((a == 0) & (b == 0), 1.0).otherwise(2.0 * common / (a + b))


def rename_candidates(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of a current function that no previous one has the name of, and a previous one of its file and class, that may be alike by RENAME_AT.

    What two texts share in order is no more than the letters that both have, each as often as
    the one with fewer has it. Pairs that stay below the limit by their lengths, or by those
    counts (of groups of letters first, which are few), are dropped in the join itself; the
    rest go on to be compared."""
    new = current.join(previous.select(*keys, "function_name").distinct(), [*keys, "function_name"], "left_anti")

    def side(df: DataFrame, x: str) -> DataFrame:
        body = bare_body(F.col("source_code"), F.col("function_name"))
        row = df.select(*keys, F.coalesce("enclosing_class_name", F.lit("")).alias("__class"), F.col("ordinal").alias(f"{x}_at"), F.col("function_name").alias(f"{x}_name"), body.alias(f"{x}_body"), F.coalesce("signature", F.lit("")).alias(f"{x}_signature"))
        row = row.withColumns({f"{x}_size": F.length(f"{x}_body"), f"{x}_letters": letter_counts(F.col(f"{x}_body"))})
        group = lambda g: reduce(add, [F.get(f"{x}_letters", F.lit(i)) for i in range(g, len(_LETTERS) + 1, _GROUPS)])
        return row.withColumns({f"{x}_group{g}": group(g) for g in range(_GROUPS)})

    n, o = (lambda c: F.col(f"n_{c}")), (lambda c: F.col(f"o_{c}"))
    heads = _at_most(F.length(n("signature")), F.length(o("signature")), F.least(F.length(n("signature")), F.length(o("signature"))))
    by_size = 0.75 * _at_most(n("size"), o("size"), F.least(n("size"), o("size"))) + 0.25 * heads
    both = F.aggregate(F.zip_with(n("letters"), o("letters"), lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    by_letters = 0.75 * _at_most(n("size"), o("size"), both) + 0.25 * heads
    by_groups = 0.75 * _at_most(n("size"), o("size"), reduce(add, [F.least(n(f"group{g}"), o(f"group{g}")) for g in range(_GROUPS)])) + 0.25 * heads
    pairs = side(new, "n").join(side(previous, "o"), [*keys, "__class"])
    # a hair below the limit, as the bound is rounded
    return pairs.where(by_size >= RENAME_AT - 1e-9).where(by_groups >= RENAME_AT - 1e-9).where(by_letters >= RENAME_AT - 1e-9).select(*keys, "n_at", "o_at", "o_name", "n_body", "o_body", "n_signature", "o_signature")


def classify(current: DataFrame, previous: DataFrame, request: str | None = None) -> DataFrame:
    """Impacted functions of both versions to changes, file by file (of a request, if that column is named).

    Same name: signature_change or logic_change. Else the most similar previous function of
    the same class that is not matched yet, from RENAME_AT on: rename (the first wins ties).
    Else logic_change without a previous function. What no current function took: deletion.

    Only pairs that may be alike are compared, each where it is, in whatever file. Which of
    them a function takes depends on what those before it took, so names and scores of a file,
    and no sources, are folded in the functions' order."""
    keys = [request, "file_path"] if request else ["file_path"]
    current, previous = (x.withColumn("ordinal", F.col("ordinal").cast("int")) for x in (current, previous))
    named = previous.groupBy(*keys, "function_name").agg(F.max_by("ordinal", "ordinal").alias("__by"))
    scores = rename_candidates(current, previous, keys).withColumn("score", similarity("n_body", "o_body", "n_signature", "o_signature")).where(F.col("score") >= RENAME_AT)
    offers = scores.groupBy(*keys, F.col("n_at").alias("ordinal")).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col("o_at").alias("at"), F.col("o_name").alias("name")))).alias("__offers"))
    kind = "array<struct<less:double,at:int,name:string>>"
    slim = current.select(*keys, "function_name", "ordinal").join(named, [*keys, "function_name"], "left").join(offers, [*keys, "ordinal"], "left")
    none = F.array().cast(kind)
    turns = F.array_sort(F.collect_list(F.struct("ordinal", F.col("function_name").alias("name"), F.col("__by").alias("by"), F.coalesce("__offers", none).alias("offers"))))
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.array().cast("array<struct<ordinal:int,at:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        best = F.get(F.filter(x["offers"], lambda o: ~F.array_contains(acc["taken"], o["name"])), F.lit(0))
        name, at = F.when(x["by"].isNotNull(), x["name"]).otherwise(best["name"]), F.coalesce(x["by"], best["at"])
        taken = F.when(name.isNull(), acc["taken"]).otherwise(F.concat(acc["taken"], F.array(name)))
        return F.struct(taken.alias("taken"), F.concat(acc["out"], F.array(F.struct(x["ordinal"].alias("ordinal"), at.alias("at")))).alias("out"))

    matched = slim.groupBy(*keys).agg(turns.alias("t")).select(*keys, F.inline(F.aggregate("t", start, step, lambda acc: acc["out"])))
    old = previous.select(*keys, F.col("ordinal").alias("at"), *[F.col(b).alias(f"previous_{a}") for a, b in _PREVIOUS])
    pairs = matched.where("at is not null").join(old, [*keys, "at"]).drop("at")
    now = current.join(pairs, [*keys, "ordinal"], "left")
    change = F.when(F.col("previous_name") != F.col("function_name"), "rename").when(F.col("previous_name").isNotNull() & ~F.col("previous_signature").eqNullSafe(F.col("signature")), "signature_change").otherwise("logic_change")
    now = now.withColumn("change_type", change).withColumn("__late", F.lit(False))
    gone = previous.join(pairs.select(*keys, F.col("previous_name").alias("function_name")).distinct(), [*keys, "function_name"], "left_anti")
    gone = gone.withColumns({f"previous_{a}": F.col(b) for a, b in _PREVIOUS}).withColumn("change_type", F.lit("deletion")).withColumn("__late", F.lit(True))
    columns = [*keys, "language", *_FIELDS[:6], "change_type", *[f"previous_{a}" for a, _ in _PREVIOUS], *_FIELDS[6:], "ordinal", "__late"]
    whole = now.select(*columns).unionByName(gone.select(*columns))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__late", "ordinal")) - 1
    return whole.withColumn("ordinal", place.cast("int")).drop("__late")


def should_skip(source: Column, branches: Column, has_validation: Column) -> Column:
    """A small pure function: no side effects, no markup, under four lines that mean something, no branch, no validation."""
    lines = F.filter(F.split(source, "\n"), lambda x: (trim_space(x) != "") & ~trim_space(x).startswith("@") & ~x.rlike(HEADER_LINE))
    small = (F.size(lines) < 4) & (branches == 0) & ~(has_validation | source.rlike(VALIDATION_HINT))
    return F.when(source.rlike("|".join(SIDE_EFFECTS)) | source.rlike(MARKUP), False).otherwise(small)


def is_trivial(source: Column, branches: Column, has_validation: Column, calls: Column) -> Column:
    named = F.forall(calls, lambda c: F.element_at(F.split(c, r"\."), -1).isin(*TRIVIAL_CALLS))
    lines = F.transform(F.filter(F.split(source, "\n"), lambda x: (trim_space(x) != "") & ~trim_space(x).startswith("@")), lambda x: F.regexp_replace(trim_space(x), ";+$", ""))
    body = F.filter(F.slice(lines, 2, 1 << 30), lambda x: ~x.isin("{", "}"))
    simple = F.forall(body, lambda x: ~x.rlike(COMPLEX_LINE) & x.rlike(SIMPLE_LINE))
    return (branches == 0) & ~has_validation & named & F.size(body).between(1, 6) & simple


def with_gates(changes: DataFrame) -> DataFrame:
    """Adds has_behavioral_change, should_skip_generation, skip_reason and should_generate."""
    old = F.col("previous_source_code")
    fresh = old.isNull() | (F.col("change_type") == "deletion")
    # Spark runs Python for all rows, whatever the condition says; a null costs it next to nothing
    form = lambda c: canonical_form("language", F.when(~fresh, F.col(c)))
    behaves = F.when(fresh, True).otherwise(form("source_code") != form("previous_source_code"))
    out = changes.withColumn("has_behavioral_change", behaves)
    kind = F.col("change_type")
    reason = F.when(~F.col("has_behavioral_change") & (kind != "rename"), "cosmetic_change").when(
        kind.isin("logic_change", "signature_change") & should_skip(F.col("source_code"), F.col("branch_count"), F.col("has_validation")), "short_function_without_branches_or_validation"
    )
    out = out.withColumn("skip_reason", reason).withColumn("should_skip_generation", reason.isNotNull())
    return out.withColumn("should_generate", (F.col("function_name") != "") & ~kind.isin("rename", "deletion") & F.col("has_behavioral_change") & ~F.col("should_skip_generation"))


def config_like_files(functions: DataFrame, request: str | None = None) -> DataFrame:
    """file_path (and request), is_config_like: by its name, or because all its functions are trivial."""
    trivial = is_trivial(F.col("source_code"), F.col("branch_count"), F.col("has_validation"), F.col("called_functions"))
    keys = [request, "file_path"] if request else ["file_path"]
    return functions.groupBy(*keys).agg(F.bool_and(trivial).alias("t")).select(*keys, (paths.has_config_name(F.col("file_path")) | F.col("t")).alias("is_config_like"))


def targets_and_maintenance(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What gets tests; and renames and deletions, whose stored tests are kept up or dropped. Two plans; see `targets_and_maintenance_once`."""
    return changes.where("should_generate"), changes.where("change_type in ('rename', 'deletion')")


def targets_and_maintenance_once(changes: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Both from one pass, written to `path`: no change is both, as renames and deletions get no tests."""
    kind = F.when(F.col("should_generate"), "target").when(F.col("change_type").isin("rename", "deletion"), "maintenance").otherwise("none")
    parts = split_once(changes, kind, ["target", "maintenance"], path)
    return parts["target"], parts["maintenance"]
