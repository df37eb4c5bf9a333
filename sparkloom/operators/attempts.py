"""Attempt sequences to outcomes, in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import is_rate_limited, retry_temperature

MOST_ATTEMPTS, PATIENCE = 12, 3


def resolve_attempts(attempts: DataFrame, key: str = "target_id") -> DataFrame:
    """`attempts` (key, attempt, status in valid/invalid/error, reason, content) to a row for each key.

    The first valid attempt wins, unless an invalid one numbered PATIENCE or more came before
    it. Errors use up attempts. A failure reports MOST_ATTEMPTS; attempts_observed says how
    many there were."""
    n, bad = F.col("attempt"), F.col("status") == "invalid"
    agg = attempts.where(n <= MOST_ATTEMPTS).groupBy(key).agg(
        F.min(F.when(F.col("status") == "valid", n)).alias("v"), F.min(F.when(bad & (n >= PATIENCE), n)).alias("t"), F.max("attempt").alias("seen"),
        F.min_by("content", F.when(F.col("status") == "valid", n)).alias("first_valid"), F.max_by("reason", F.when(bad, n)).alias("last_reason"),
    )
    won = F.col("v").isNotNull() & (F.col("t").isNull() | (F.col("v") < F.col("t")))
    out = agg.withColumn("succeeded", won)
    reason = F.when(F.col("succeeded"), "").when(F.col("t").isNotNull(), "skipped_after_3_attempts").otherwise(F.coalesce("last_reason", F.lit("unknown")))
    return out.select(key, "succeeded", F.when(F.col("succeeded"), F.col("v")).otherwise(MOST_ATTEMPTS).alias("attempts"), F.least("seen", F.coalesce(F.when(F.col("succeeded"), F.col("v")), "t", "seen")).alias("attempts_observed"), reason.alias("reason"), F.when(F.col("succeeded"), F.col("first_valid")).alias("content"))


def attempt_plan(attempts: DataFrame) -> DataFrame:
    """Adds the temperature of each attempt and whether its message says that the rate is limited."""
    return attempts.withColumn("temperature", retry_temperature(F.col("attempt"))).withColumn("rate_limited", is_rate_limited(F.coalesce("message", F.lit(""))))


def unresolved_by_file(targets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """file, attempted functions that did not succeed, functions never attempted."""
    j = targets.join(outcomes.select("target_id", "succeeded"), "target_id", "left")
    return j.groupBy("source_file").agg(F.array_sort(F.collect_set(F.when(~F.col("succeeded"), F.col("function_name")))).alias("failed"), F.array_sort(F.collect_set(F.when(F.col("succeeded").isNull(), F.col("function_name")))).alias("not_attempted"))
