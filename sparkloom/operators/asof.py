"""Versions as of a commit: the last one at or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Commits that share a range of a file's history.
SPAN = 1024


def last_at_or_before(asks: DataFrame, versions: DataFrame, keys: Sequence[str], at: str, span: int = SPAN) -> DataFrame:
    """`asks` (keys, at, ...) with `found`, the largest `at` of the versions of their keys that is not above their own; null where there is none.

    A key's history is cut into ranges of `span` commits. The last version within a range comes
    from a running maximum of that range alone, and what earlier ranges leave from one over
    ranges; so a key with a very long history is many tasks, and no ask meets more than one row."""
    keys = list(keys)
    part = F.floor(F.col(at) / span).alias("__part")
    known = versions.select(*keys, F.col(at).alias("__at"), part, F.lit(True).alias("__version")).distinct()
    own = asks.select(*keys, F.col(at).alias("__at"), part).distinct().withColumn("__version", F.lit(False))
    rows = known.unionByName(own)
    version = F.when(F.col("__version"), F.col("__at"))
    within = Window.partitionBy(*keys, "__part").orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("__near", F.max(version).over(within)).where("NOT __version").drop("__version")
    tops = rows.groupBy(*keys, "__part").agg(F.max(version).alias("__top"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "__part", F.max("__top").over(before).alias("__far"))
    same = [near[k].eqNullSafe(tops[k]) for k in [*keys, "__part"]]
    all_same = same[0]
    for s in same[1:]:
        all_same &= s
    found = near.join(tops, all_same).select(*[near[k] for k in keys], F.col("__at").alias(at), F.coalesce("__near", "__far").alias("found"))
    return asks.join(found, [*keys, at], "left")


def versions_as_of(asks: DataFrame, versions: DataFrame, at: str = "commit") -> DataFrame:
    """`asks` (file_path, commit, ...) with previous_source, the file's content as of that commit.

    `versions` (file_path, commit, content): one row for each commit that changed the file, with
    a null content where it deleted it; of several for one commit the one with the largest
    content counts. Null where the file was not there yet or not any more."""
    one = versions.groupBy("file_path", at).agg(F.max("content").alias("previous_source")).withColumnRenamed(at, "found")
    return last_at_or_before(asks, versions, ["file_path"], at).join(one, ["file_path", "found"], "left").drop("found").select(*asks.columns, "previous_source")
