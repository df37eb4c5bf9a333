"""Test logs: captured names, notes with context, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import joined_output, trim_space

#: Where failed names and generated files stand in logs.
PYTEST = (r"FAILED\s+[^\s]+::(test_[A-Za-z0-9_]+)", r"::(test_[A-Za-z0-9_]+)\s+FAILED")
JEST = ("(?m)^[\\s✕×]*[✕×]\\s+(test_[A-Za-z0-9_]+)", "›\\s+(test_[A-Za-z0-9_]+)")
GENERATED = r"(test_ai_generated_[A-Za-z0-9_./\\-]+\.py|ai_generated_[A-Za-z0-9_./\\-]+\.test\.(?:js|ts))"
COLLECTING = r"ERROR\s+collecting\s+.*?(test_ai_generated_\w+\.py)"
MOST_NOTES, NOTE_CHARS, NOTE_LINES = 6, 400, 4


def captures(text: Column, patterns: tuple[str, ...]) -> Column:
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]
    return F.array_distinct(F.concat(*found))


def _explode(results: DataFrame, found: Column, name: str) -> DataFrame:
    return results.select(F.explode(found).alias(name)).distinct()


def failed_tests(results: DataFrame) -> DataFrame:
    text = joined_output(F.col("stdout"), F.col("stderr"))
    return _explode(results, F.when(F.col("language") == "python", captures(text, PYTEST)).otherwise(captures(text, JEST)), "name")


def failed_files(results: DataFrame) -> DataFrame:
    found = captures(joined_output(F.col("stdout"), F.col("stderr")), (GENERATED,))
    return _explode(results, F.transform(found, lambda x: F.element_at(F.split(F.translate(x, "\\", "/"), "/"), -1)), "file")


def collection_errors(results: DataFrame) -> DataFrame:
    return _explode(results, captures(F.concat(F.coalesce("stdout", F.lit("")), F.coalesce("stderr", F.lit(""))), (COLLECTING,)), "file")


def failure_notes(results: DataFrame, watched: DataFrame) -> DataFrame:
    """`results` (run_id, ordinal, stdout, stderr), `watched` (run_id, word): the first notes of each run.

    A note is a line that holds a watched word, with the next three, joined and cut; repeats
    count once, where they first stand."""
    lines = results.select("run_id", "ordinal", F.posexplode(F.split(joined_output(F.col("stdout"), F.col("stderr")), "\n")).alias("pos", "line"))
    w = Window.partitionBy("run_id", "ordinal").orderBy("pos")
    parts = [trim_space(F.col("line"))] + [trim_space(F.lead("line", i).over(w)) for i in range(1, NOTE_LINES)]
    notes = lines.withColumn("full", F.concat_ws(" | ", *[F.nullif(p, F.lit("")) for p in parts]))
    hit = notes.join(watched.select(F.col("run_id").alias("__r"), "word"), (F.col("run_id") == F.col("__r")) & F.col("line").contains(F.col("word")), "left_semi").where("full <> ''")
    first = hit.groupBy("run_id", F.substring("full", 1, NOTE_CHARS).alias("note")).agg(F.min(F.struct("ordinal", "pos")).alias("at"))
    top = first.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy("at"))).where(F.col("rank") <= MOST_NOTES)
    return top.select("run_id", "rank", "note")


def run_counts(results: DataFrame, by: str) -> DataFrame:
    return results.groupBy(by).agg(F.count_if(F.col("returncode") == 0).alias("passed"), F.count_if(F.col("returncode") != 0).alias("failed"), F.bool_or(F.col("returncode") != 0).alias("has_failures"))
