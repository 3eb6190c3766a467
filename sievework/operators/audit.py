"""Decisions over duplicate groups: which copy stays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import lookup


def keep_first(items: DataFrame, group: str, item: str, conflict: Column, leakage: Column, preferred: Column, hot: Sequence = ()) -> DataFrame:
    """One decision per item of a group.

    Groups in ``conflict`` lose all items; of groups with ``leakage`` a
    ``preferred`` item stays; of others the smallest item. ``conflict`` and
    ``leakage`` hold for a whole group. Adds ``decision`` (KEEP, EXCLUDE or
    EXCLUDE_ALL), ``keep_item`` (empty if none stays) and ``reason``. Items
    of a null group are left out. ``hot`` names groups of very many items.
    """
    order = F.struct(F.when(leakage & preferred, 0).otherwise(1).alias("rank"), F.col(item).alias("item"))
    first = items.groupBy(group).agg(F.min(order).getField("item").alias("_first"))
    return (
        lookup(items, first, group, hot)
        .withColumn("decision", F.when(conflict, "EXCLUDE_ALL").when(F.col(item) == F.col("_first"), "KEEP").otherwise("EXCLUDE"))
        .withColumn("keep_item", F.when(conflict, "").otherwise(F.col("_first")))
        .withColumn("reason", F.when(conflict, "label conflict").when(leakage, "split leakage").otherwise("exact duplicate"))
        .drop("_first")
    )


def broken_pairs(items: DataFrame, group: str, split: str, leakage: Column) -> DataFrame:
    """Groups with leakage that haven't exactly one train and one test item: ``group``, ``train``, ``test``.

    ``require_pair`` raises for these.
    """
    counts = items.where(leakage & F.col(group).isNotNull()).groupBy(group).agg(*[F.count_if(F.col(split) == s).alias(s) for s in ("train", "test")])
    return counts.where("train != 1 or test != 1")


def require_pair(items: DataFrame, group: str, split: str, leakage: Column) -> DataFrame:
    """``items`` unchanged; raises when it is read if a group with leakage hasn't exactly one train and one test item."""
    whole = Window.partitionBy(group)
    count = lambda s: F.count_if(F.col(split) == s).over(whole)
    judged = items.withColumn("_broken", leakage & ((count("train") != 1) | (count("test") != 1)))
    return judged.where(F.when(F.col("_broken"), F.raise_error(F.lit("a leaking group needs one train and one test item"))).otherwise(F.lit(True))).drop("_broken")


def audit_totals(decisions: DataFrame, group: str) -> DataFrame:
    """One row: groups, files, kept, excluded, groups in conflict, groups with leakage."""
    return decisions.agg(
        F.count_distinct(group).alias("groups"),
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("decision") == "KEEP").alias("kept"),
        F.count_if(F.col("decision") != "KEEP").alias("excluded"),
        F.count_distinct(F.when(F.col("decision") == "EXCLUDE_ALL", F.col(group))).alias("conflict_groups"),
        F.count_distinct(F.when(F.col("reason") == "split leakage", F.col(group))).alias("leakage_groups"),
    )


def group_decisions(decisions: DataFrame, group: str, only: str | None = None) -> DataFrame:
    """Per group its distinct decisions, joined; with ``only``, groups that have that one."""
    sets = decisions.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set("decision")), "|").alias("decisions"), F.bool_or(F.col("decision") == only).alias("_has") if only else F.lit(True).alias("_has"))
    return sets.where("_has").drop("_has")
