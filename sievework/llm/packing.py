"""Items of varying length into containers of fixed capacity.

The plan is made for lengths and not for items: best-fit decreasing over the
counts of the length histogram, whose size is bounded by the capacity. It
says which slots the items ranked i to j among those of one length take. Items
then get their slot by their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import bits_for, ranked
from ..storage import stage

#: A plan of at most so many runs (48 bytes each) goes to all executors; a larger one is joined.
SENT_RUNS = 500_000
#: Ranks of one length that are joined together with their runs.
RANKS = 1 << 16


def plan_runs(histogram: Mapping[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first container, items per container), and the number of containers.

    Longest first; an item goes to the fullest container that has room for
    it. All items of one length that meet equal containers are one run.
    """
    runs, made = [], 0
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> (first container, count)
    rooms: list[int] = []

    def leave(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, count))

    for length in sorted((k for k, n in histogram.items() if n > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError("lengths must lie between 1 and the capacity")
        left, rank = histogram[length], 1
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
                each = min(room // length, left)
                used = min(count, left // each)
                runs.append((length, rank, used * each, first, each))
                leave(room - each * length, first, used)
                leave(room, first + used, count - used)
                left, rank = left - used * each, rank + used * each
            else:
                each = min(capacity // length, left)
                used = left // each
                runs.append((length, rank, used * each, made, each))
                leave(capacity - each * length, made, used)
                made, left, rank = made + used, left - used * each, rank + used * each
    return runs, made


def slots_of(runs: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The container of each item (group, rank); ``runs`` (group, first rank, count, first container, items per container) are sorted."""
    groups, start = np.unique(runs[:, 0], return_index=True)
    end = np.append(start[1:], len(runs))
    of = np.searchsorted(groups, group)
    low, high = start[of], end[of]
    # the last run that begins at or before the rank, for all items at once
    while (open_ := high - low > 1).any():
        middle = (low + high) // 2
        right = runs[middle, 1] <= rank
        low, high = np.where(open_ & right, middle, low), np.where(open_ & ~right, middle, high)
    found = runs[low]
    return found[:, 3] + (rank - found[:, 1]) // found[:, 4]


def join_runs(ranked_parts: DataFrame, runs: DataFrame) -> DataFrame:
    """``container_id`` by a join: every ``RANKS`` ranks of a group meet the runs that begin among them or last into them."""
    piece = lambda c: F.floor(c / F.lit(RANKS)).cast("bigint")
    last = F.col("first") + F.col("count") - 1
    cut = runs.select("group", "first", "container", "each", F.explode(F.sequence(piece(F.col("first")), piece(last))).alias("_at"))
    begins = cut.select("group", "_at", F.greatest("first", F.col("_at") * RANKS).alias("rank"), F.struct("first", "container", "each").alias("_run"))
    both = ranked_parts.withColumn("_at", piece(F.col("rank"))).unionByName(begins, allowMissingColumns=True)
    # of one rank a run's beginning comes first
    order = Window.partitionBy("group", "_at").orderBy("rank", F.col("_run").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.last("_run", ignorenulls=True).over(order)
    met = both.withColumn("_run", F.when(F.col("_run").isNull(), run)).where("kind is not null")
    return met.withColumn("container_id", F.expr("_run.container + (rank - _run.first) div _run.each")).drop("_run", "_at")


def pack(items: DataFrame, key: str, length: str, capacities: DataFrame) -> DataFrame:
    """One row per piece of an item in each kind of container.

    ``items`` has a ``key`` and an integer ``length``; ``capacities`` has
    ``container`` (a kind) and ``capacity``, few rows. Columns out:
    ``container``, ``container_id`` (from 0 in each kind), ``key``, ``piece``
    (from 0), ``length`` of the piece and ``free``, the room left in that
    container. An item longer than the capacity is cut into full pieces and a
    rest; no other item is cut. Items of null or no length take no room and
    are left out; repeated keys are separate items.
    """
    kinds = sorted((r["container"], r["capacity"]) for r in capacities.where("capacity > 0").select("container", "capacity").collect())
    spark = items.sparkSession
    if not kinds:
        return spark.createDataFrame([], f"container string, container_id bigint, `{key}` {dict(items.dtypes)[key]}, piece int, length bigint, free bigint")
    sized = stage(items.select(F.col(key).alias("key"), F.col(length).cast("bigint").alias("n")).where("n > 0"), "sizes")
    kind = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(c).cast("bigint").alias("capacity")) for i, (_, c) in enumerate(kinds)]))
    each = sized.select("key", "n", kind.alias("k")).select("key", "n", "k.*")
    whole, rest = F.floor(F.col("n") / F.col("capacity")), F.col("n") % F.col("capacity")
    full = each.groupBy("kind", F.col("capacity").alias("length")).agg(F.sum(whole).alias("count"))
    rests = each.where(rest > 0).groupBy("kind", rest.alias("length")).agg(F.count(F.lit(1)).alias("count"))
    counted = full.unionByName(rests).where("count > 0").collect()  # at most one row per length up to the capacities
    runs, pieces = [], 0
    for i, (_, capacity) in enumerate(kinds):
        histogram = {r["length"]: r["count"] for r in counted if r["kind"] == i}
        pieces += sum(histogram.values())
        runs += [(i, *r) for r in plan_runs(histogram, capacity)[0]]
    top = max(c for _, c in kinds) + 1
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    table = np.column_stack([table[:, 0] * top + table[:, 1], table[:, 2:]])
    cut = F.explode(F.sequence(F.lit(0), (whole + F.when(rest > 0, 1).otherwise(0) - 1).cast("int")))
    parts = each.select("key", "n", "kind", "capacity", cut.alias("piece"))
    parts = parts.withColumn("length", F.when(F.col("piece") < whole, F.col("capacity")).otherwise(rest))
    parts = parts.select("key", "kind", "capacity", "piece", "length", (F.col("kind").cast("bigint") * F.lit(top) + F.col("length")).alias("group"), F.xxhash64("key", "piece").alias("order"))
    placed = ranked(parts, ["group"], "order", bits_for(pieces), ties=["key", "piece"])
    if len(table) <= SENT_RUNS:
        shared = spark.sparkContext.broadcast(table)
        slot_of = F.pandas_udf(lambda group, rank: pd.Series(slots_of(shared.value, group.to_numpy(), rank.to_numpy())), "bigint")
        placed = placed.withColumn("container_id", slot_of("group", "rank"))
    else:
        frame = pd.DataFrame(table, columns=["group", "first", "count", "container", "each"])
        placed = join_runs(placed, stage(spark.createDataFrame(frame, "group bigint, first bigint, count bigint, container bigint, each bigint"), "runs"))
    together = Window.partitionBy("kind", "container_id")
    names = F.element_at(F.array(*[F.lit(name) for name, _ in kinds]), F.col("kind") + 1)
    return placed.select(
        names.alias("container"), "container_id", F.col("key").alias(key), "piece", "length", (F.col("capacity") - F.sum("length").over(together)).alias("free")
    )
