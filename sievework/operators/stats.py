"""Counts and profiles of an inventory."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counters(df: DataFrame, dimensions: Mapping[str, Sequence[str]]) -> DataFrame:
    """Counts by several keys in one pass: ``counter``, ``key`` (parts joined by ``::``) and ``n``.

    Each row is expanded to one key per counter before a single, map-side
    combined aggregation. A key with a null part is not counted.
    """
    keys = [F.struct(F.lit(name).alias("counter"), _joined(cols).alias("key")) for name, cols in dimensions.items()]
    return df.select(F.inline(F.array(*keys))).where("key is not null").groupBy("counter", "key").agg(F.count(F.lit(1)).alias("n"))


def _joined(cols: Sequence[str]) -> Column:
    present = F.lit(True)
    for c in cols:
        present = present & F.col(c).isNotNull()
    return F.when(present, F.concat_ws("::", *[F.col(c).cast("string") for c in cols]))


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def with_threshold(df: DataFrame, count: str, least: int = 100, flag: str = "meets_100_image_threshold") -> DataFrame:
    return df.withColumn(flag, F.col(count) >= least)


def crop_profile(classes: DataFrame, key: str, size: str, healthy: str, least: int = 100) -> DataFrame:
    """Second-level statistics over classes: sums, healthy and other, extremes, classes over the threshold."""
    n = F.col(size)
    return classes.groupBy(key).agg(
        F.sum(n).alias("total_images"),
        F.count(F.lit(1)).alias("number_of_original_classes"),
        F.coalesce(F.sum(F.when(F.col(healthy), n)), F.lit(0)).alias("healthy_images"),
        F.coalesce(F.sum(F.when(~F.coalesce(F.col(healthy), F.lit(False)), n)), F.lit(0)).alias("disease_images"),
        F.min(n).alias("minimum_class_images"),
        F.max(n).alias("maximum_class_images"),
        F.count_if(n >= least).alias("classes_with_enough_images"),
    )


def class_map(classes: DataFrame, key: str, label: str, size: str) -> DataFrame:
    """Per key its classes with their counts as one text, ``label=n`` sorted by label."""
    entries = F.array_sort(F.collect_list(F.concat_ws("=", F.col(label), F.col(size).cast("string"))))
    return classes.where(F.col(label).isNotNull()).groupBy(key).agg(F.array_join(entries, "|").alias("classes"))


def top_k(df: DataFrame, key: Column, k: int = 20) -> DataFrame:
    """The ``k`` most frequent values, ties by value. Null is no value."""
    return df.select(key.alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def predicate_report(df: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """``title`` and ``n`` for each predicate, in one pass over the rows."""
    counted = df.agg(*[F.count_if(p).alias(t) for t, p in predicates.items()])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(t).alias("title"), F.col(t).alias("n")) for t in predicates])))
