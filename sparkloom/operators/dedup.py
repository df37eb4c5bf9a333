"""Whitespace-normalised dedup and containment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import strip_space


def first_of_equal(df: DataFrame, text: str, order: str) -> DataFrame:
    """Of rows whose texts are equal without white space, the first by `order`.

    The key is a 256-bit digest, so long texts are not compared; a task keeps one row of each
    key before the shuffle (the window's group limit), which is what a hot text needs."""
    w = Window.partitionBy("__norm").orderBy(order)
    keyed = df.withColumn("__norm", F.sha2(strip_space(F.coalesce(text, F.lit(""))), 256))
    return keyed.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__norm", "__r")


def last_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__l")).select(*[F.col(c) if c in keys else F.col(f"__l.{c}") for c in df.columns])


def drop_contained(generated: DataFrame, targets: DataFrame) -> DataFrame:
    """`generated` (source_file, function_name, content, generation_mode) without what its target's existing tests hold.

    Texts are compared without white space; rows of mode 'repair' and rows without a target's
    tests stay; rows without a target fall away."""
    known = last_per_key(targets.select("source_file", "function_name", "ordinal", "existing_tests_text"), ["source_file", "function_name"], "ordinal")
    joined = generated.join(known.select("source_file", "function_name", "existing_tests_text"), ["source_file", "function_name"])
    have, own = strip_space(F.coalesce("existing_tests_text", F.lit(""))), strip_space(F.coalesce("content", F.lit("")))
    inside = (own != "") & have.contains(own) & (F.col("generation_mode") != "repair")
    return joined.where(~inside).drop("existing_tests_text")


def filter_duplicates(generated: DataFrame, targets: DataFrame) -> DataFrame:
    """Containment first, then the first of equal contents among what is left."""
    return first_of_equal(drop_contained(generated, targets), "content", "ordinal")
