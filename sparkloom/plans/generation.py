"""The whole flow as one declarative plan: changes to targets, responses to outcomes, outcomes to the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import paths
from sparkloom.functions.source_code import extract_functions, test_names
from sparkloom.functions.text import sanitize_identifier, strip_code_fences
from sparkloom.operators import attempts, changes, dedup, store, validation
from sparkloom.session import PARSED_ROWS, merged, parts_of, stored


def analyse(diffs: DataFrame, files: DataFrame) -> DataFrame:
    """Changes of all requests. `diffs`: diff_id, text; `files`: diff_id, file_path, content,
    previous_source (without diff_id they are those of every request). Paths are filtered
    before anything is parsed; a request's lines meet its own files alone. Changed lines and
    the functions of both versions are stored once, as several joins read them. Files are
    dealt to tasks by their number before they are parsed, and so are the functions that are
    compared: texts of code pack well, so their bytes leave them to a few tasks."""
    key = ["diff_id", "file_path"]
    lines = stored(changes.changed_lines(diffs), "lines")
    touched = lines.select(*key).distinct()
    use = files.join(merged(touched), "file_path") if "diff_id" not in files.columns else files.join(merged(touched), key, "left_semi")
    lang = paths.language_of(F.col("file_path"))
    use = use.withColumn("language", lang).where(F.col("language").isNotNull() & ~paths.is_test_or_generated(F.col("file_path")) & ~paths.is_config_file(F.col("file_path")))
    use = use.repartition(parts_of(touched, PARSED_ROWS), "file_path")
    now = stored(extract_functions(use, request="diff_id"), "functions")
    parts = parts_of(now, PARSED_ROWS)
    quiet = merged(changes.config_like_files(now, "diff_id").where("is_config_like").select(*key))
    before = extract_functions(use.join(quiet, key, "left_anti").where("previous_source is not null").select(*key, "language", F.col("previous_source").alias("content")), request="diff_id")
    current = stored(changes.impacted(now.join(quiet, key, "left_anti"), lines.where("side = 'added'"), key).repartition(parts, *key), "current")
    previous = stored(changes.impacted(before, lines.where("side = 'removed'"), key).repartition(parts, *key), "previous")
    return changes.with_gates(changes.classify(current, previous, "diff_id"))


def generate(targets: DataFrame, responses: DataFrame, existing: DataFrame, base: DataFrame, actions: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(new store, outcomes). `responses`: target_id, attempt, status, content; statuses other than 'error' are decided here."""
    keyed = targets.select("target_id", F.col("file_path").alias("source_file"), "language", "function_name")
    got = responses.join(keyed, "target_id").withColumn("content", strip_code_fences(F.col("content")))
    failed = got.where("status = 'error'").withColumn("reason", F.lit("error"))
    checked = validation.validate(got.where("status <> 'error'")).withColumn("status", F.when(F.col("reason") == "", "valid").otherwise("invalid"))
    outcomes = attempts.resolve_attempts(failed.unionByName(checked).select("target_id", "attempt", "status", "reason", "content"))
    done = outcomes.where("succeeded").join(keyed, "target_id").withColumn("ordinal", F.col("target_id")).withColumn("generation_mode", F.lit("replace"))
    kept = dedup.filter_duplicates(done, existing).withColumn("test_id", sanitize_identifier(F.col("function_name"))).withColumn("test_names", test_names(F.col("language"), F.col("content")))
    # of targets with one key the later one's entry stands
    rows = store.entries(kept, root, "target_id").withColumnRenamed("target_id", "seq")
    return store.upsert(base, rows, store.maintenance_deletes(actions)), outcomes
