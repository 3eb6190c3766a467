"""Splits that keep related records together and classes spread.

Records and the entities they name are a bipartite graph. Each record starts
with a label of its own; labels are passed to the entities, and the smallest
back to the records, which then take the label of their label. What holds one
label becomes one vertex, entities with one label are done, and the rest goes
on with labels in another order, so that a chain takes as many rounds as the
logarithm of its length. Records that end with one label are a component. Then
whole components are assigned: those of one main class together, the largest
first, each to the split in which it deviates least from the classes' target
distribution, and moved on as long as that lessens the deviation. Where that
takes several tasks, the large components go first, all in one, the tasks
share what they leave of the targets, and in a second pass make up for what
all together have missed.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import HOT_ROWS, hot_keys, lookup
from ..storage import drop, stage, stage_counted

#: Components that one task assigns one after the other, about.
COMPONENTS_A_TASK = 20_000
#: Where there are several tasks, components of at least this part of all records are assigned before them; so many at most.
LARGE = 10_000
#: Times that a label is replaced by its own label in a round.
JUMPS = 2
#: Passes in which groups are moved to better splits.
PASSES = 5


def propagate_labels(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``record`` and ``label``, the smallest record of its component.

    ``edges`` has ``record`` (orderable) and ``entity``, in any repetition;
    rows with a null are ignored. Rounds grow with the logarithm of the
    longest chain; more than ``max_rounds`` raise.
    """
    known = stage(edges.select("record", "entity").where("record is not null and entity is not null").distinct(), "bipartite")
    records = known.select("record").distinct()
    shared, count = stage_counted(_shared_entities(known.withColumnRenamed("record", "vertex")), "shared")
    drop_later, levels = [], []
    while count:
        if len(levels) == max_rounds:
            raise ValueError(f"labels still change after {max_rounds} rounds")
        many = count >= HOT_ROWS
        # labels are ordered by a hash of their own in every round
        label = F.struct(F.xxhash64("vertex", F.lit(len(levels))).alias("order"), F.col("vertex").alias("label"))
        of_entity = shared.groupBy("entity").agg(F.min(label).alias("low"))
        passed = lookup(shared, of_entity, "entity", hot_keys(shared, "entity", count) if many else [])
        labels = stage(passed.groupBy("vertex").agg(F.min("low").getField("label").alias("label")), "labels")
        hot = hot_keys(labels, "label", labels.count()) if many else []
        for _ in range(JUMPS):
            above = _merged(labels.select(F.col("vertex").alias("label"), F.col("label").alias("next")))
            jumped = stage(lookup(labels, above, "label", hot).select("vertex", F.col("next").alias("label")), "labels")
            drop(labels)
            labels = jumped
            hot = hot_keys(labels, "label", labels.count()) if many else []
        levels.append((labels, hot))
        renamed = lookup(shared, _merged(labels), "vertex", hot_keys(shared, "vertex", count) if many else []).select(F.col("label").alias("vertex"), "entity").distinct()
        rest, count = stage_counted(_shared_entities(renamed), "shared")
        drop(shared)
        shared = rest
    drop(shared)
    roots = None
    for labels, hot in reversed(levels):
        if roots is None:
            roots = labels.select("vertex", F.col("label").alias("root"))
            continue
        upper = _merged(roots.select(F.col("vertex").alias("label"), "root"))
        roots = stage(lookup(labels, upper, "label", hot, "left").select("vertex", F.coalesce("root", "label").alias("root")), "roots")
        drop_later.append(roots)
    if roots is None:
        return records.select("record", F.col("record").alias("label"))
    ended = stage(records.join(_merged(roots.withColumnRenamed("vertex", "record")), "record", "left").select("record", F.coalesce("root", "record").alias("root")), "ended")
    drop(known, *[x for x, _ in levels], *drop_later)
    least = ended.groupBy("root").agg(F.min("record").alias("label"))
    return lookup(ended, least, "root", hot_keys(ended, "root", ended.count())).select("record", "label")


def _merged(df: DataFrame) -> DataFrame:
    """Not to be broadcast: Spark goes by the size of a staged file, which says little of its rows in memory."""
    return df.hint("merge")


def _shared_entities(edges: DataFrame) -> DataFrame:
    """The distinct edges (``vertex``, ``entity``) of entities with more than one vertex."""
    ends = edges.groupBy("entity").agg(F.min("vertex").alias("first"), F.max("vertex").alias("last")).where(F.col("first") != F.col("last"))
    return edges.join(ends.select("entity"), "entity", "left_semi")


def assign(
    groups: Mapping[object, Mapping[str, int]],
    shares: Mapping[str, float],
    weights: Mapping[str, float],
    goals: Mapping[str, Mapping[str, float]] | None = None,
    start: Mapping[object, str] | None = None,
) -> dict[object, str]:
    """A split for each group of class counts; least weighted squared deviation, largest groups first.

    Then groups move to other splits while that lessens the deviation, in at
    most ``PASSES`` passes; with ``start`` they begin where it says.

    ``goals`` says how many records of a class each split should get; without
    it they are the shares of what the groups hold.
    Ties go to the split that is furthest behind its share of the records,
    then to the first by name.
    """
    names = sorted(shares)
    whole = {}
    for counts in groups.values():
        for c, n in counts.items():
            whole[c] = whole.get(c, 0) + n
    if goals is None:
        goals = {s: {c: shares[s] * n for c, n in whole.items()} for s in names}
    everything = sum(whole.values())
    wanted = {s: sum(goals[s].values()) for s in names}
    have = {s: dict.fromkeys(whole, 0) for s in names}
    size = dict.fromkeys(names, 0)
    order = sorted(groups, key=lambda g: (-sum(groups[g].values()), g))

    def added(counts: Mapping[str, int], s: str) -> float:
        """Growth of the squared distance to the class targets, and to the size target, by the group."""
        n = sum(counts.values())
        cost = sum(weights.get(c, 1.0) * k * (2 * (have[s][c] - goals[s][c]) + k) for c, k in counts.items())
        return cost + n * (2 * (size[s] - wanted[s]) + n) / max(everything, 1)

    def put(counts: Mapping[str, int], s: str, sign: int) -> None:
        size[s] += sign * sum(counts.values())
        for c, k in counts.items():
            have[s][c] += sign * k

    out = {}
    for group in order:
        counts = groups[group]
        out[group] = start[group] if start else min((added(counts, s), size[s] - wanted[s], s) for s in names)[2]
        put(counts, out[group], 1)
    for _ in range(PASSES):
        moved = False
        for group in order:
            counts, now = groups[group], out[group]
            put(counts, now, -1)
            costs = {s: added(counts, s) for s in names}
            best = min(names, key=lambda s: (costs[s], s))
            if costs[best] < costs[now] - 1e-9:
                out[group], moved = best, True
            put(counts, out[group], 1)
        if not moved:
            break
    return out


def _goals(rest: DataFrame, placed: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """``task``, ``label`` and ``goal``: the records each split (by name) should get there, whole numbers.

    They add up to what the classes' targets leave after the ``placed``
    components. Rounding runs on from task to task, so that a class with a
    record in each of many tasks is spread over the splits as well.
    """
    names = sorted(shares)
    got = placed.groupBy("label").agg(*[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(F.lit(0))).alias(f"got{i}") for i, s in enumerate(names)])
    left = [F.greatest(F.col("whole") * F.lit(float(shares[s])) - F.coalesce(f"got{i}", F.lit(0)), F.lit(0.0)) for i, s in enumerate(names)]
    cells = rest.groupBy("task", "label").agg(F.sum("n").alias("here"), F.max("whole").alias("whole")).join(got, "label", "left")
    by = Window.partitionBy("label").orderBy(F.xxhash64("task"), "task").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("until", F.sum("here").over(by)).select("task", "label", "here", "until", F.array(*left).alias("left"))
    total = F.aggregate("left", F.lit(0.0), lambda a, x: a + x)
    cells = cells.withColumn("total", total)

    def up_to(i: int, count: Column) -> Column:
        """Records of the first i splits among the first ``count`` of the class."""
        if i == len(names):
            return count.cast("double")
        return F.round(F.aggregate(F.slice("left", 1, i), F.lit(0.0), lambda a, x: a + x) / F.col("total") * count) if i else F.lit(0.0)

    def goal(i: int) -> Column:
        before = F.col("until") - F.col("here")
        return up_to(i + 1, F.col("until")) - up_to(i, F.col("until")) - up_to(i + 1, before) + up_to(i, before)

    return cells.select("task", "label", F.array(*[goal(i) for i in range(len(names))]).alias("goal"))


def _by_split(rows: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """``got``: the sums of ``n`` per split that ``start`` names."""
    return rows.groupBy(*by).agg(F.array(*[F.sum(F.when(F.col("start") == s, F.col("n")).otherwise(F.lit(0))) for s in names]).alias("got"))


def split_records(records: DataFrame, edges: DataFrame, shares: Mapping[str, float], class_sizes: DataFrame, a_task: int = COMPONENTS_A_TASK) -> DataFrame:
    """``record``, ``component`` and ``split`` of every record.

    ``records`` has ``record`` and ``label`` (a class, may be null), one row
    per record; ``edges`` says what belongs together (``record``,
    ``entity``); ``class_sizes`` has ``label`` and ``size`` and makes
    deviations of small classes weigh more. A record without an entity stands
    alone. A component bigger than a split stays whole and the split is over
    its share. No shares, or none above 0, raise; an empty table gives no rows.
    """
    shares = {s: x for s, x in shares.items() if x and x > 0}
    if not shares:
        raise ValueError("no split has a share")
    shares = {s: x / sum(shares.values()) for s, x in shares.items()}
    components = propagate_labels(edges).select("record", F.col("label").alias("component"))
    clean = records.select("record", F.coalesce("label", F.lit("")).alias("label"))
    members = stage(clean.join(_merged(components), "record", "left").select("record", "label", F.coalesce("component", "record").alias("component")), "members")
    counts = stage(members.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n")), "counts")
    main = counts.groupBy("component").agg(F.max(F.struct("n", "label")).getField("label").alias("main"))
    mains = main.groupBy("main").agg(F.count(F.lit(1)).alias("of_main"))
    total = main.count()
    tasks = max(1, -(-total // a_task))
    # small classes share a task, a class of many components gets several
    pieces = F.ceil(F.col("of_main") / F.lit(a_task)).cast("int")
    piece = F.when(pieces > 1, F.pmod(F.xxhash64("component"), pieces)).otherwise(F.lit(0))
    task = F.when(pieces > 1, F.concat_ws("|", F.lit("own"), "main", piece)).otherwise(F.concat_ws("|", F.lit("shared"), F.pmod(F.xxhash64("main"), F.lit(tasks))))
    tasked = main.join(mains, "main").select("component", task.alias("task"))
    sizes = class_sizes.where("label is not null").groupBy("label").agg(F.max("size").alias("size"))
    weighed = counts.join(tasked, "component").join(sizes, "label", "left").select("task", "component", "label", "n", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))
    kind = dict(members.dtypes)["component"]

    names = sorted(shares)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        groups: dict = {}
        for component, label, n in zip(rows["component"].tolist(), rows["label"].tolist(), rows["n"].tolist(), strict=True):
            groups.setdefault(component, {})[label] = n
        here = rows.groupby("label")["n"].sum().to_dict()
        counted = rows.groupby("label")["size"].max().to_dict()
        weights = {c: 1.0 / max(1, counted[c] or here[c]) for c in here}
        goals = None
        if "goal" in rows:
            of_label = dict(zip(rows["label"], rows["goal"], strict=True))
            goals = {s: {c: of_label[c][i] for c in here} for i, s in enumerate(names)}
        start = dict(zip(rows["component"].tolist(), rows["start"].tolist(), strict=True)) if "start" in rows else None
        found = assign(groups, shares, weights, goals, start)
        return pd.DataFrame({"component": [*found], "split": [*found.values()]})

    out = f"component {kind}, split string"
    if tasks == 1:
        assigned = stage(weighed.groupBy("task").applyInPandas(solve, out), "assigned")
    else:
        large = counts.groupBy("component").agg(F.sum("n").alias("all")).where(F.col("all") >= max(2, members.count() / LARGE)).select("component", F.lit(True).alias("large"))
        whole = counts.groupBy("label").agg(F.sum("n").alias("whole"))
        cut = stage(weighed.join(large, "component", "left").join(whole, "label").withColumn("size", F.when(F.col("size") > 0, F.col("size")).otherwise(F.col("whole"))), "weighed")
        first = cut.where("large").withColumn("goal", F.array(*[F.col("whole") * F.lit(float(shares[s])) for s in names]))
        placed = stage(first.groupBy("large").applyInPandas(solve, out), "placed")
        rest = cut.where("large is null").drop("large")
        once = stage(rest.join(_goals(rest, first.join(placed, "component"), shares), ["task", "label"]).groupBy("task").applyInPandas(solve, out), "once")
        # what all tasks together miss is shared by them as well
        begun = stage(rest.join(_merged(once.withColumnRenamed("split", "start")), "component"), "begun")
        got = _by_split(first.join(placed.withColumnRenamed("split", "start"), "component").select("label", "n", "start").unionByName(begun.select("label", "n", "start")), ["label"], names)
        here = _by_split(begun, ["task", "label"], names).join(begun.groupBy("label").agg(F.sum("n").alias("rest"), F.max("whole").alias("whole")), "label")
        both = here.join(got.withColumnRenamed("got", "all"), "label")
        missed = [F.col("got")[i] + (F.col("whole") * F.lit(float(shares[s])) - F.col("all")[i]) * F.aggregate("got", F.lit(0).cast("bigint"), lambda a, x: a + x) / F.col("rest") for i, s in enumerate(names)]
        again = begun.join(both.select("task", "label", F.array(*missed).alias("goal")), ["task", "label"])
        assigned = stage(placed.unionByName(again.groupBy("task").applyInPandas(solve, out)), "assigned")
        drop(cut, placed, once, begun)
    hot = hot_keys(members, "component", members.count())
    return lookup(members, _merged(assigned), "component", hot).select("record", "label", "component", "split")


def spread_report(assigned: DataFrame, shares: Mapping[str, float], class_sizes: DataFrame) -> DataFrame:
    """Per split, and per split and class: the records, the share reached and its target; ``label`` is null for a whole split."""
    known = assigned.sparkSession.createDataFrame([*shares.items()], "split string, target_share double")
    cells = assigned.groupBy("split", "label").agg(F.count(F.lit(1)).alias("records"))
    labels = assigned.select("label").distinct()
    grid = known.crossJoin(labels.unionByName(assigned.sparkSession.createDataFrame([(None,)], "label string")))
    wholes = cells.groupBy("split").agg(F.sum("records").alias("records")).withColumn("label", F.lit(None).cast("string"))
    every = cells.unionByName(wholes.select("split", "label", "records"))
    on = grid["split"].eqNullSafe(every["split"]) & grid["label"].eqNullSafe(every["label"])
    full = grid.join(every, on, "left").select(grid["split"], grid["label"], "target_share", F.coalesce("records", F.lit(0)).alias("records"))
    of_label = F.sum("records").over(Window.partitionBy("label"))
    shared = full.withColumn("share", F.when(of_label > 0, F.col("records") / of_label).otherwise(F.lit(0.0)))
    sizes = class_sizes.where("label is not null").groupBy(F.col("label").alias("_label")).agg(F.max("size").alias("inventory_images"))
    return shared.join(sizes, F.col("label") == F.col("_label"), "left").select("split", "label", "records", "share", "target_share", "inventory_images")
