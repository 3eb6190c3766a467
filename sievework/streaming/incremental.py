"""Items that arrive over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(items: DataFrame, digest: str, time: str, late: str = "7 days") -> DataFrame:
    """Each digest's first item; copies that come within ``late`` of it are dropped. Items of null digest pass only once.

    State is kept for ``late`` only, so it is bounded by that much input.
    """
    return items.withWatermark(time, late).dropDuplicatesWithinWatermark([digest])


def windowed_counts(items: DataFrame, time: str, keys: Sequence[str], length: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts per key and tumbling window; a window is final once it is ``late`` behind."""
    counted = items.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n")
