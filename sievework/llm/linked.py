"""Pairwise matches to groups: connected components by low-diameter decomposition.

One level grows clusters from exponentially shifted start times: a vertex
draws ``shift ~ Exp(beta)``, capped at ``radius``, and would start a cluster
of its own at time ``radius - shift``; clusters advance by one edge per unit
of time, and a vertex belongs to whichever cluster reaches it first, its own
included. Clusters have at most ``radius`` hops, an edge is cut with
probability about ``beta``. The clusters are contracted to super-vertices, the
cut edges are the next level's graph, and the assignments of all levels are
composed. So a chain of any length costs a number of rounds that grows with
the logarithm of the number of edges, not with its length.

Vertices travel as 64-bit hashes of their names; hashes that two names share
are detected exactly and replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import HOT_ROWS, hot_keys, lookup
from ..storage import drop, stage, stage_counted

#: So many small levels are composed without writing what lies between.
COMPOSED = 4


def start_time(vertex: Column, level: Column, beta: float, radius: int) -> Column:
    """Whole time step at which a vertex starts its own cluster: 0 .. radius."""
    uniform = (F.shiftrightunsigned(F.xxhash64(vertex, level), 11) + 1) / F.lit(float(2**53))
    return (F.lit(radius) - F.least(F.floor(-F.log(uniform) / beta), F.lit(radius))).cast("int")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))), "level")


def _level(edges: DataFrame, count: int, level: int, beta: float, radius: int) -> tuple[DataFrame, list[int]]:
    """Clusters of one level, (vertex, center), staged, and the hot vertices."""
    both = _both_ways(edges)
    # the level is data, so that Spark compiles the same code for all levels
    begins = lambda c: start_time(c, F.col("level"), beta, radius)
    # the first step needs no join: a neighbour's start time follows from its name
    state = (
        both.groupBy("src", "level")
        .agg(F.min(F.when(begins(F.col("dst")) == 0, F.col("dst"))).alias("reached"), F.count(F.lit(1)).alias("degree"))
        .withColumn("start", begins(F.col("src")))
        .select(
            F.col("src").alias("vertex"),
            "start",
            F.when(F.col("start") == 0, F.col("src")).otherwise(F.coalesce("reached", F.when(F.col("start") == 1, F.col("src")))).alias("center"),
            F.when(F.col("start") == 0, 0).when(F.col("reached").isNotNull() | (F.col("start") == 1), 1).alias("at"),
            "degree",
        )
    )
    steps, hot = [], []
    if count >= HOT_ROWS:  # with fewer edges no vertex can be hot
        state = stage(state, f"level{level}-step1")
        steps.append(state)
        hot = [r[0] for r in state.where(F.col("degree") >= max(HOT_ROWS, count // 25)).select("vertex").collect()]  # at most 2 * count / the limit
    reached_at = lambda s: s.where(F.col("at").isNotNull()).select("vertex", "center")
    clusters = reached_at(state)
    for now in range(2, radius + 1):
        fresh = state.where(F.col("at") == now - 1).select(F.col("vertex").alias("dst"), "center").hint("merge")
        reached = lookup(both, fresh, "dst", hot).groupBy(F.col("src").alias("vertex")).agg(F.min("center").alias("reached"))
        rest = state.where(F.col("at").isNull()).select("vertex", "start")
        own = F.when(F.col("start") == now, F.col("vertex"))
        state = rest.join(reached.hint("merge"), "vertex", "left").select("vertex", "start", F.coalesce("reached", own).alias("center"), F.when(F.coalesce("reached", own).isNotNull(), now).alias("at"))
        if now < radius:
            state = stage(state, f"level{level}-step{now}")
            steps.append(state)
        clusters = clusters.unionByName(reached_at(state))
    clusters = stage(clusters, f"level{level}")
    drop(*steps)
    return (clusters if count >= HOT_ROWS else _kept(clusters, clusters.coalesce(1))), hot


def _kept(staged: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` reads what ``staged`` does, and is dropped with it."""
    changed._staged_at = staged._staged_at
    return changed


def _contract(edges: DataFrame, clusters: DataFrame, hot: list[int]) -> DataFrame:
    """Distinct edges between different clusters, smaller end first."""
    cu, cv = F.col("cu"), F.col("cv")
    left = lookup(edges, clusters.select(F.col("vertex").alias("u"), F.col("center").alias("cu")).hint("merge"), "u", hot)
    ends = lookup(left, clusters.select(F.col("vertex").alias("v"), F.col("center").alias("cv")).hint("merge"), "v", hot)
    return ends.where(cu != cv).select(F.least(cu, cv).alias("u"), F.greatest(cu, cv).alias("v"), (F.col("level") + 1).alias("level")).distinct()


def group_linked(pairs: DataFrame, a: str, b: str, beta: float = 0.6, radius: int = 2) -> DataFrame:
    """One row per item linked to another: ``item`` and ``group_item``, the smallest item of its group.

    Parameters: ``pairs`` has one link per row in the string columns ``a`` and
    ``b``; other columns are ignored, whatever their names. Repeated and
    reversed rows count once. A row with a null end or with twice the same
    item links nothing, so its items appear only if other rows link them. An
    empty table gives no rows. The empty string is an item like any other.
    """
    if not 0 < beta or radius < 1:
        raise ValueError("beta must be positive and radius at least 1")
    links = pairs.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).where(F.col("a") != F.col("b"))
    named = links.select(F.xxhash64("a").alias("ha"), "a", F.xxhash64("b").alias("hb"), "b")
    ends = named.select(F.inline(F.array(F.struct(F.col("ha").alias("vertex"), F.col("a").alias("item")), F.struct(F.col("hb").alias("vertex"), F.col("b").alias("item")))))
    items = stage(ends.distinct(), "items")
    clashes = stage(items.groupBy("vertex").count().where("count > 1").select("vertex"), "clashes")
    if clashes.limit(1).count():
        items, named = _without_clashes(items, named, clashes)
    u, v = F.least("ha", "hb").alias("u"), F.greatest("ha", "hb").alias("v")
    edges, count = stage_counted(named.select(u, v).distinct().withColumn("level", F.lit(0)), "edges")
    levels: list[tuple[DataFrame, int]] = []
    while count:
        if count < HOT_ROWS:
            # so little fits one partition, within which Spark needs no shuffle
            edges = _kept(edges, edges.coalesce(1))
        clusters, hot = _level(edges, count, len(levels), beta, radius)
        levels.append((clusters, count))
        cut, count = stage_counted(_contract(edges, clusters, hot), f"cut{len(levels)}")
        drop(edges)
        edges = cut
    roots = pairs.sparkSession.createDataFrame([], "vertex bigint, root bigint")
    drop(edges, clashes)
    read: list[DataFrame] = []
    for k, (clusters, count) in reversed([*enumerate(levels)]):
        upper = roots.select(F.col("vertex").alias("center"), "root")
        hot = hot_keys(clusters, "center", clusters.count()) if count >= HOT_ROWS else []
        roots = lookup(clusters, upper, "center", hot, "left").select("vertex", F.coalesce("root", "center").alias("root"))
        read.append(clusters)
        # every few levels the joins so far are written
        if count >= HOT_ROWS or k % COMPOSED == 0:
            roots = stage(roots, f"roots{k}")
            drop(*read)
            read = [roots]
    members = stage(items.join(roots, "vertex").select("item", "root"), "members")
    drop(items, roots)
    least = members.groupBy("root").agg(F.min("item").alias("group_item"))
    return lookup(members, least, "root", hot_keys(members, "root", members.count())).select("item", "group_item")


def _without_clashes(items: DataFrame, named: DataFrame, clashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give every name whose hash another name shares a second hash, and make sure that is its own."""
    shared = clashes.withColumn("_shared", F.lit(True))

    def again(rows: DataFrame, h: str, name: str) -> DataFrame:
        met = rows.join(shared.withColumnRenamed("vertex", h), h, "left")
        return met.withColumn(h, F.when(F.col("_shared"), F.xxhash64(F.lit("again"), F.col(name))).otherwise(F.col(h))).drop("_shared")

    fixed = stage(again(items, "vertex", "item"), "items")
    drop(items)
    if fixed.groupBy("vertex").count().where("count > 1").limit(1).count():
        raise ValueError("names share both hashes")
    return fixed, again(again(named, "ha", "a"), "hb", "b")
