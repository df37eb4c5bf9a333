"""Several outputs of one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def split_once(df: DataFrame, outcome: Column, names: Sequence[str], path: str) -> dict[str, DataFrame]:
    """The rows of each outcome as a table of its own; df is evaluated once, by the write that puts each outcome into a part of `path`.

    Rows of other outcomes are written but not given back. `path` is on storage that all
    executors share; what stands there is replaced, so a write that was broken off can be done again."""
    marked = df.withColumn("__outcome", outcome)
    marked.write.mode("overwrite").partitionBy("__outcome").parquet(path)
    whole = df.sparkSession.read.schema(marked.schema).parquet(path)
    return {n: whole.where(whole["__outcome"] == n).drop("__outcome") for n in names}
