"""Ordered selections under a budget of estimated tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import estimate_tokens, split_lines, trim_space

RULE_BUDGET = 4500
TEST_BUDGET = 250
INPUT_BUDGET = 20_000
MOST_BLOCKS, MOST_CHARS = 4, 4000
#: Parts that a group is cut into before its own running sum.
SALTS = 64


def _running(group: list[str], order: list[str]):
    return Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def prefix_within_budget(df: DataFrame, group: list[str], order: list[str], cost: Column, budget: int, keep_first: bool = False) -> DataFrame:
    """Rows of each group until the first one that overflows; `keep_first` keeps the first whatever it costs.

    Costs are not negative, so the running sum passes the budget once and for all. A row that
    stands behind an overflow among any part of its group's rows is out; so a group is first cut
    by hash into `SALTS` parts that each keep their rows up to the first overflow, and only
    those meet in the group's own window. A hot group is no single task, and results are exact."""
    salted = df.withColumn("__cost", cost).withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    before = F.sum("__cost").over(_running([*group, "__part"], order)) - F.coalesce("__cost", F.lit(0))
    some = salted.withColumn("__before", before).where(F.coalesce("__before", F.lit(0)) <= budget).drop("__before", "__part")
    out = some.withColumn("running", F.sum("__cost").over(_running(group, order))).drop("__cost")
    fits = F.col("running") <= budget
    if keep_first:
        fits |= F.row_number().over(Window.partitionBy(*group).orderBy(*order)) == 1
    return out.where(fits) if not keep_first else out.withColumn("__fits", fits).where("__fits").drop("__fits")


def split_rule_budget(rules: DataFrame) -> DataFrame:
    """`rules` (target_id, kind, ordinal, rule): half of the budget for either kind."""
    return prefix_within_budget(rules, ["target_id", "kind"], ["ordinal"], estimate_tokens(F.col("rule")), RULE_BUDGET // 2)


def capped_blocks(blocks: DataFrame, most: int = MOST_BLOCKS, chars: int = MOST_CHARS, places: bool = False) -> DataFrame:
    """`blocks` (target_id, file_ordinal, ordinal, text) to target_id and `kept`, the array of kept texts, with `places` also `files`, the file_ordinal of each.

    At most `most` blocks and `chars` characters; the first is kept whatever its length. A
    block that would overflow ends its own file's turn, later files may still add."""
    rows = F.array_sort(F.collect_list(F.struct("file_ordinal", "ordinal", "text")))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("size"), F.lit(-1).cast("long").alias("shut"), F.array().cast("array<long>").alias("files"))

    def step(acc: Column, x: Column) -> Column:
        n = F.length(x["text"])
        closed = (x["file_ordinal"].cast("long") == acc["shut"]) | (F.size(acc["kept"]) >= most)
        over = (F.size(acc["kept"]) > 0) & (acc["size"] + n > chars)
        return F.when(closed, acc).when(over, F.struct(acc["kept"].alias("kept"), acc["size"].alias("size"), x["file_ordinal"].cast("long").alias("shut"), acc["files"].alias("files"))).otherwise(
            F.struct(F.concat(acc["kept"], F.array(x["text"])).alias("kept"), (acc["size"] + n).alias("size"), acc["shut"].alias("shut"), F.concat(acc["files"], F.array(x["file_ordinal"].cast("long"))).alias("files"))
        )

    folded = blocks.groupBy("target_id").agg(rows.alias("__rows"))
    out = folded.select("target_id", F.aggregate("__rows", start, step).alias("a"))
    return out.select("target_id", F.col("a.kept").alias("kept"), *([F.col("a.files").alias("files")] if places else []))


def lines_within_budget(text: Column, budget: int = TEST_BUDGET) -> Column:
    """The lines of one text until the first that overflows, the first whatever it costs, trimmed; as prefix_within_budget does for rows."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(True).alias("open"))

    def step(acc: Column, line: Column) -> Column:
        used = acc["used"] + estimate_tokens(line)
        fits = acc["open"] & ((F.size(acc["kept"]) == 0) | (used <= budget))
        return F.struct(F.when(fits, F.concat(acc["kept"], F.array(line))).otherwise(acc["kept"]).alias("kept"), used.alias("used"), fits.alias("open"))

    kept = F.aggregate(split_lines(text), start, step, lambda acc: acc["kept"])
    return F.when(F.coalesce(trim_space(text), F.lit("")) == "", "").otherwise(trim_space(F.array_join(kept, "\n")))


def evict_to_budget(items: DataFrame, budget: int = INPUT_BUDGET) -> DataFrame:
    """`items` (target_id, kind, ordinal, tokens) with `evicted` and, where even that does not do, `skipped`.

    Kinds are given up in a fixed order, so how much must be freed decides the victims by one
    running sum: rules of the request from the tail, rules of the project from the tail,
    dependencies from the largest (the first of equals), lines of tests from the tail. Kind
    'fixed' is never given up. Costs (`tokens`) may be in any unit, `budget` in the same; a
    column `weight` says which dependency is the largest, if costs are not to."""
    rank = F.create_map(*[F.lit(x) for kv in {"request_rule": 0, "project_rule": 1, "dependency": 2, "test_line": 3, "fixed": 9}.items() for x in kv])[F.col("kind")]
    whole = Window.partitionBy("target_id")
    out = items.withColumn("__over", F.sum("tokens").over(whole) - budget).withColumn("__rank", rank)
    within = F.when(F.col("kind") == "dependency", -F.col("weight" if "weight" in items.columns else "tokens")).otherwise(F.lit(0))
    tail = F.when(F.col("kind") == "dependency", F.col("ordinal")).otherwise(-F.col("ordinal"))
    out = out.withColumn("__within", within).withColumn("__tail", tail)
    freed = F.coalesce(F.sum("tokens").over(Window.partitionBy("target_id").orderBy("__rank", "__within", "__tail").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumn("evicted", (F.col("kind") != "fixed") & (F.col("__over") > 0) & (freed < F.col("__over")))
    fixed = F.sum(F.when(F.col("kind") == "fixed", F.col("tokens")).otherwise(0)).over(whole)
    return out.withColumn("skipped", fixed > budget).drop("__over", "__rank", "__within", "__tail")
