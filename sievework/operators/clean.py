"""Manifests of a cleaned corpus, and what became of every exclusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def excluded(decisions: DataFrame) -> DataFrame:
    return decisions.where(F.col("decision").isin("EXCLUDE", "EXCLUDE_ALL"))


def manifest(files: DataFrame, exclusions: DataFrame, on: str) -> DataFrame:
    """The files that aren't excluded."""
    return files.join(exclusions.select(on), on, "left_anti")


def action_log(files: DataFrame, exclusions: DataFrame, on: str) -> DataFrame:
    """Every file with ``action`` COPIED or EXCLUDED and the ``reason``."""
    marks = exclusions.select(on).distinct().withColumn("_out", F.lit(True))
    out = F.col("_out").isNotNull()
    return files.select(on).join(marks, on, "left").select(on, F.when(out, "EXCLUDED").otherwise("COPIED").alias("action"), F.when(out, "duplicate audit").otherwise("").alias("reason"))


def log_totals(log: DataFrame) -> DataFrame:
    """One row: scanned, copied, excluded, and whether they add up."""
    copied, out = F.count_if(F.col("action") == "COPIED"), F.count_if(F.col("action") == "EXCLUDED")
    return log.agg(F.count(F.lit(1)).alias("scanned"), copied.alias("copied"), out.alias("excluded"), (F.count(F.lit(1)) == copied + out).alias("adds_up"))


def missing(exclusions: DataFrame, files: DataFrame, on: str) -> DataFrame:
    """Exclusions that match no file."""
    return exclusions.select(on).distinct().join(files.select(on), on, "left_anti")


def surviving(exclusions: DataFrame, cleaned: DataFrame, on: str) -> DataFrame:
    """Exclusions that are still among the cleaned files."""
    return exclusions.select(on).distinct().join(cleaned.select(on), on, "left_semi")
