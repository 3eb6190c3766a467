"""Connected components of exact or near pairs.

Alternates two star operations until nothing changes: every node links its
larger neighbours to its smallest one, then its smaller neighbours and itself
to the smallest of them. Each works on an aggregate of the edges and a join,
so no neighbourhood is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop, stage_counted, stage_summed
from .skew import HOT_ROWS, hot_keys, lookup


def _star(edges: DataFrame, rows: int, large: bool) -> DataFrame:
    """One star operation on directed edges ``u``, ``v``, of which there are at most ``rows``."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = lookup(edges, low, "u", hot_keys(edges, "u", rows) if rows >= HOT_ROWS else [])
    if large:
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.where("m < u").select("u", F.col("m").alias("v")))


def connected(pairs: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """``item`` and ``root``, the smallest item of its component, for every item with a partner other than itself.

    A round that leaves the number of edges and their checksum as they were
    is the last one; both are taken while the edges are written.
    """
    links = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")
    # from larger to smaller
    edges, rows, before = stage_summed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        spread, wide = stage_counted(_star(both, 2 * rows, True).distinct(), "large-star")
        # large stars leave edges from larger to smaller, as small stars need them
        after, left, now = stage_summed(_star(spread.where("v < u"), wide, False).distinct(), "small-star")
        drop(edges, spread)
        edges = after
        if (left, now) == (rows, before):
            roots = edges.select(F.col("v").alias("item")).distinct().withColumn("root", F.col("item"))
            return edges.select(F.col("u").alias("item"), F.col("v").alias("root")).unionByName(roots)
        rows, before = left, now
    raise ValueError(f"components still change after {max_rounds} rounds")
