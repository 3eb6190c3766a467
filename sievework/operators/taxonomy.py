"""Rule tables, lookups and audits of label taxonomies."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: So many rules at most go to the labels, in one automaton; more are joined.
SENT_RULES = 200_000


def first_rule(labels: DataFrame, label: str, rules: DataFrame) -> DataFrame:
    """Per distinct label the ``value`` of the rule of least ``priority`` whose ``needle`` is in it; null if none.

    ``rules`` has ``priority`` (unique), ``needle`` and ``value`` (text); a
    null needle is in no label, an empty one in all. Labels are de-duplicated
    first.
    """
    distinct = labels.select(F.col(label).alias("label")).where(F.col(label).isNotNull()).distinct()
    usable = rules.select(F.col("priority").cast("bigint").alias("priority"), F.col("needle").cast("string").alias("needle"), F.col("value").cast("string").alias("value")).where("needle is not null")
    if usable.limit(SENT_RULES + 1).count() > SENT_RULES:
        met = distinct.join(usable, F.contains(F.col("label"), F.col("needle")), "left")
        return met.groupBy(F.col("label").alias(label)).agg(F.min_by("value", "priority").alias("value"))
    listed = sorted((r["priority"], r["needle"], r["value"]) for r in usable.collect())

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton, anywhere = ahocorasick.Automaton(), None
        for rule in listed:
            if not rule[1]:
                anywhere = anywhere or rule
            elif rule[1] not in automaton:
                automaton.add_word(rule[1], rule)
        if len(automaton):
            automaton.make_automaton()
        for b in batches:
            found = [min(([anywhere] if anywhere else []) + ([r for _, r in automaton.iter(x)] if len(automaton) else []), default=None) for x in b["label"]]
            yield pd.DataFrame({"label": b["label"], "value": pd.Series([r[2] if r else None for r in found], dtype=object)})

    return distinct.mapInPandas(search, "label string, value string").withColumnRenamed("label", label)


def lookup_where(rows: DataFrame, applies: Column, key: str, table: DataFrame, columns: Sequence[str], strict: bool = True) -> DataFrame:
    """``columns`` replaced from ``table`` (unique ``key``) where ``applies``; other rows pass through.

    With ``strict``, reading a row that applies and has no match raises.
    """
    side = table.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    met = rows.withColumn("_applies", F.coalesce(applies, F.lit(False))).join(side, F.col("_applies") & (F.col(key) == F.col("_key")), "left")
    unmatched = F.col("_applies") & F.col("_key").isNull()
    if strict:
        met = met.where(F.when(unmatched, F.raise_error(F.concat(F.lit("no entry for "), F.coalesce(F.col(key), F.lit("null"))))).otherwise(F.lit(True)))
    new = {c: F.when(F.col("_applies"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return met.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns])


def overlay(rows: DataFrame, fixes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``columns`` replaced where ``fixes`` (unique ``keys``) has the row's keys; its nulls replace nothing."""
    side = fixes.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_new_{c}") for c in columns])
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    met = rows.join(side, on, "left")
    return met.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def fan_in(rows: DataFrame, target: str, source: str) -> DataFrame:
    """Targets that more than one distinct source maps to, with the sources."""
    known = rows.where(F.col(target).isNotNull() & F.col(source).isNotNull())
    groups = known.groupBy(target).agg(F.count_distinct(source).alias("sources"), F.array_join(F.array_sort(F.collect_set(source)), "|").alias("members"))
    return groups.where("sources > 1")


def values_per(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Per key its distinct values, joined, and how many."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), "|").alias("values"), F.count_distinct(value).alias("n"))


def value_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """``field``, ``value`` (``<EMPTY>`` for null and empty) and ``n`` for each column, in one pass."""
    shown = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("<EMPTY>"))
    return rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), shown(c).alias("value")) for c in columns]))).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
