"""Validation states and the final gate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import join_first_seen
from ..sources.sinks import metric_rows


def validate(rows: DataFrame, corrupt: Mapping[str, Column], warnings: Mapping[str, Column]) -> DataFrame:
    """Adds ``status`` (corrupt, warning or valid) and ``message``: what holds, each once, in the order given.

    A test that is null doesn't hold.
    """
    holds = lambda tests: F.array_compact(F.array(*[F.when(t, m) for m, t in tests.items()]))
    broken, doubtful = holds(corrupt), holds(warnings)
    status = F.when(F.size(broken) > 0, "corrupt").when(F.size(doubtful) > 0, "warning").otherwise("valid")
    message = F.when(F.size(broken) > 0, join_first_seen(broken)).otherwise(join_first_seen(doubtful))
    return rows.withColumn("status", status).withColumn("message", message)


def gate(numbers: DataFrame, must_be_zero: tuple[str, ...], status: str = "final_status") -> DataFrame:
    """Metrics of a one-row table, followed by its ``status``, PASS or FAIL."""
    fine = F.lit(True)
    for c in must_be_zero:
        fine = fine & (F.col(c) == 0)
    judged = numbers.withColumn(status, F.when(fine, "PASS").otherwise("FAIL"))
    return metric_rows(judged, judged.columns)


def final_gate(cleaned: DataFrame, corrupt: Column, digest: str, surviving: DataFrame) -> DataFrame:
    """The seven metrics of a cleaned corpus, and which of its causes a failure has.

    PASS needs no ``corrupt`` file, no digest on both train and test files
    (``split``), and no ``surviving`` exclusion; other duplicates are counted
    but allowed.
    """
    files = cleaned.agg(F.count(F.lit(1)).alias("total_images"), F.count_if(corrupt).alias("corrupt_images"))
    has = lambda s: F.bool_or(F.col("split") == s)
    groups = cleaned.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count(F.lit(1)).alias("n"), (has("train") & has("test")).alias("leak")).where("n > 1")
    left = groups.agg(F.count(F.lit(1)).alias("exact_duplicate_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("exact_duplicate_files"), F.count_if("leak").alias("train_test_duplicate_groups"))
    numbers = files.crossJoin(left).crossJoin(surviving.agg(F.count(F.lit(1)).alias("audit_exclusions_still_present")))
    return gate(numbers, CAUSES, "validation_status")


#: What a final gate fails for.
CAUSES = ("corrupt_images", "train_test_duplicate_groups", "audit_exclusions_still_present")


def causes(metrics: DataFrame) -> DataFrame:
    """Of a gate's rows those that made it fail, with a ``message``."""
    words = F.initcap(F.replace("metric", F.lit("_"), F.lit(" ")))
    return metrics.where(F.col("metric").isin(*CAUSES) & (F.col("value") != "0")).select("metric", "value", F.concat(words, F.lit(": "), F.col("value")).alias("message"))
