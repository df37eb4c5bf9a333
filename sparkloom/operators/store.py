"""A keyed store: deletes, then upserts, the last write wins."""

from __future__ import annotations

import json
import posixpath

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import paths
from sparkloom.functions.source_code import mapping_json, top_level_names
from sparkloom.functions.text import split_lines, trim_space


def mapping_key(source_file: Column, function_name: Column) -> Column:
    return F.concat_ws("::", source_file, function_name)


def upsert(base: DataFrame, writes: DataFrame, deletes: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """`base` without the deleted keys, with the last write of each key; `order` orders the
    writes. Of writes that share it the one with the largest values stands, so results are stable."""
    left = base.join(deletes.select(key), key, "left_anti").withColumn("__at", F.lit(-1).cast("long"))
    rows = left.unionByName(writes.withColumn("__at", F.col(order).cast("long")).drop(*([order] if order not in base.columns else [])))
    w = Window.partitionBy(key).orderBy(F.desc("__at"), *[F.desc(c) for c, kind in rows.dtypes if c not in (key, "__at") and not kind.startswith("map")])
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__at")


def maintenance_deletes(actions: DataFrame) -> DataFrame:
    """The keys that deletions and renames give up: a rename's old name, else the own."""
    name = F.when(F.col("action_type") == "rename", F.coalesce(F.nullif("previous_name", F.lit("")), "function_name")).otherwise(F.col("function_name"))
    return actions.select(mapping_key(F.col("source_file"), name).alias("key")).distinct()


def deleted_count(base: DataFrame, deletes: DataFrame, key: str = "key") -> DataFrame:
    """How many keys were really there."""
    return base.join(deletes, key, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))


def entries(generated: DataFrame, root: str, *more: str) -> DataFrame:
    """Store rows of generated tests: key, target file, sorted distinct test names, and columns to carry along."""
    target = paths.output_path(root, F.col("source_file"), F.col("test_id"), F.col("language"))
    return generated.select(mapping_key(F.col("source_file"), F.col("function_name")).alias("key"), "source_file", "language", "function_name", "test_id", target.alias("target_file"), F.array_sort(F.array_distinct("test_names")).alias("test_names"), *more)


def as_json(store: DataFrame) -> DataFrame:
    """One row for each source file, its part of the mapping as JSON with sorted keys."""
    fields = [c for c in store.columns if c != "key"]
    return store.groupBy("source_file").agg(mapping_json(F.map_from_entries(F.collect_list(F.struct("key", F.struct(*fields))))).alias("mapping"))


def save_mapping(store: DataFrame, path: str, root: str, overwrite: bool = False) -> None:
    """Writes the mapping, a JSON text for each source file; see guarded_path."""
    as_json(store).select("mapping").write.mode("overwrite" if overwrite else "errorifexists").text(guarded_path(path, root))


@F.pandas_udf(T.StringType())
def _entry(key: pd.Series, entry: pd.Series) -> pd.Series:
    """One entry of the document: indented by two, its fields sorted, without the brackets around all entries."""
    whole = [json.dumps({k: json.loads(e)}, indent=2, sort_keys=True) for k, e in zip(key, entry, strict=True)]
    return pd.Series([x[2:-2] for x in whole], dtype=object)


def save_document(store: DataFrame, path: str, root: str, overwrite: bool = False) -> None:
    """Writes the mapping as one indented document with sorted keys: the part files in their order are its text.

    Keys are range-partitioned and sorted, and each part is rendered on its own; only the
    first and the last key are asked for beforehand, as they carry the outer brackets."""
    ends = store.agg(F.min("key").alias("a"), F.max("key").alias("b")).first()
    out = guarded_path(path, root)
    mode = "overwrite" if overwrite else "errorifexists"
    if ends["a"] is None:
        store.sparkSession.createDataFrame([("{}",)], "value string").coalesce(1).write.mode(mode).text(out)
        return
    fields = F.to_json(F.struct(*[c for c in store.columns if c != "key"]), {"ignoreNullFields": "false"})
    head, tail = F.when(F.col("key") == ends["a"], "{\n").otherwise(""), F.when(F.col("key") == ends["b"], "\n}").otherwise(",")
    store.orderBy("key").select(F.concat(head, _entry(F.col("key"), fields), tail).alias("value")).write.mode(mode).text(out)


def guarded_path(path: str, root: str) -> str:
    """The path without `..`, if it lies in `root`; else an error, so that nothing is written elsewhere."""
    here, top = posixpath.normpath(path), posixpath.normpath(root)
    if here != top and not here.startswith(top.rstrip("/") + "/"):
        raise ValueError(f"{path} is not inside {root}")
    return here


def package_files(files: DataFrame, root: str, column: str = "target_file") -> DataFrame:
    """file_path: the `__init__.py` of every folder from `root` down to those of the files."""
    folders = files.select(F.explode(paths.ancestors(F.col(column))).alias("folder")).where((F.col("folder") == root) | F.col("folder").startswith(root.rstrip("/") + "/"))
    return folders.distinct().select(F.concat("folder", F.lit("/__init__.py")).alias("file_path"))


def emptied_folders(before: DataFrame, deleted: DataFrame, root: str, column: str = "target_file") -> DataFrame:
    """folder: those below `root` that held deleted files and hold no file any more."""
    folders = lambda df: df.select(F.explode(paths.ancestors(F.col(column))).alias("folder")).distinct()
    left = before.join(deleted.select(column).distinct(), column, "left_anti")
    return folders(deleted).where(F.col("folder").startswith(root.rstrip("/") + "/")).join(folders(left), "folder", "left_anti")


#: Parts of module names whose symbols have to be the source's own.
OWN_MODULES = ("django", "flask", "fastapi", "src", "app", "lib")


def own_symbols(sources: DataFrame) -> DataFrame:
    """`sources` (source_file, language, content) to (source_file, name): what Python sources define at their top level, for merge_artifacts."""
    return sources.select("source_file", F.explode(top_level_names("language", "content")).alias("name"))


def merge_artifacts(tests: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """`tests` (source_file, ordinal, content) to one text each: the union of leading imports, sorted, then the bodies in order.

    The header ends with the first line that is neither blank nor an import; imports that go
    over several lines in brackets, and those of pytest, fall away. `symbols` (source_file,
    name): where a source has any, imports from modules that look like its own keep those
    names alone."""
    lines = tests.select("source_file", "ordinal", F.posexplode(split_lines(trim_space(F.col("content")))).alias("pos", "line")).withColumn("line", F.coalesce("line", F.lit("")))
    text = trim_space(F.col("line"))
    head = text.startswith("import ") | text.startswith("from ")
    opens = head & text.endswith("(") & ~text.contains(")")
    lines = lines.withColumn("text", text).withColumn("head", head).withColumn("opens", opens)
    rows = F.array_sort(F.collect_list(F.struct("pos", "line", "text", "head", "opens")))
    kinds = F.aggregate(rows, F.struct(F.lit(False).alias("inside"), F.lit(False).alias("body"), F.array().cast("array<struct<kind:string,line:string>>").alias("out")), _step, lambda acc: acc["out"])
    artifacts = lines.groupBy("source_file", "ordinal").agg(kinds.alias("k"))
    heads = F.transform(F.filter("k", lambda x: x["kind"] == "head"), lambda x: x["line"])
    bodies = trim_space(F.array_join(F.transform(F.filter("k", lambda x: x["kind"] == "body"), lambda x: x["line"]), "\n"))
    artifacts = artifacts.select("source_file", "ordinal", heads.alias("heads"), bodies.alias("body"))
    if symbols is not None:
        own = symbols.groupBy("source_file").agg(F.collect_set("name").alias("names"))
        artifacts = artifacts.join(own, "source_file", "left").withColumn("heads", F.when(F.col("names").isNull(), F.col("heads")).otherwise(F.filter(F.transform("heads", lambda x: _known(x, F.col("names"))), lambda x: x.isNotNull())))
    merged = artifacts.groupBy("source_file").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("heads")))).alias("heads"), F.array_sort(F.collect_list(F.when(F.col("body") != "", F.struct("ordinal", "body")))).alias("bodies"))
    imports = F.array_union(F.array(F.lit("import unittest")), F.filter("heads", lambda x: ~x.startswith("import pytest") & ~x.startswith("from pytest")))
    return merged.select("source_file", F.concat(F.array_join(imports, "\n"), F.lit("\n\n"), F.array_join(F.transform("bodies", lambda x: x["body"]), "\n\n\n"), F.lit("\n")).alias("content"))


def _step(acc: Column, x: Column) -> Column:
    """One line more: skipped inside of brackets, head, or body."""
    keep = lambda inside, body, kind: F.struct(inside.alias("inside"), body.alias("body"), (F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), F.when(F.lit(kind == "head"), x["text"]).otherwise(x["line"]).alias("line")))) if kind else acc["out"]).alias("out"))
    yes, no = F.lit(True), F.lit(False)
    return (
        F.when(acc["inside"], keep(~x["line"].contains(")"), acc["body"], None))
        .when(~acc["body"] & x["opens"], keep(yes, no, None))
        .when(~acc["body"] & x["head"], keep(no, no, "head"))
        .when(~acc["body"] & (x["text"] == ""), keep(no, no, None))
        .otherwise(keep(no, yes, "body"))
    )


def _known(line: Column, names: Column) -> Column:
    """An import line with the names that are known; null where none is left; other lines as they are."""
    module = trim_space(F.regexp_extract(line, r"^from\s+(.*?)\s+import\s", 1))
    wanted = F.transform(F.split(F.regexp_extract(line, r"\simport\s+(.*)$", 1), ","), lambda s: trim_space(F.element_at(F.split(trim_space(s), " as "), 1)))
    kept = F.filter(wanted, lambda s: F.array_contains(names, s))
    own = line.startswith("from ") & line.contains(" import ") & F.exists(F.array(*map(F.lit, OWN_MODULES)), lambda p: module.contains(p))
    return F.when(~own, line).when(F.size(kept) > 0, F.concat(F.lit("from "), module, F.lit(" import "), F.array_join(kept, ", ")))
