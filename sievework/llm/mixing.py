"""Sources combined to target shares along a time-varying curriculum.

Each source has a weight schedule over training time from 0 to 1. Its
integral is the source's share of the total, and the inverse of the cumulative
token demand tells at which time a use of a text belongs: the text that ends
a tenth of the source's tokens stands where the schedule has demanded a tenth
of them. Sorting all uses by that time mixes the sources to the schedule at
every point, not only at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import HOT_ROWS, bits_for, lookup, ranked
from ..storage import stage

#: Plans of at most so many sources go to the texts; larger ones are joined.
SENT_PLAN = 10_000
#: How far the steepest default schedule departs from level.
STEEPNESS = 0.5


def plan_mix(supplies: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Per source with target and supply: ``share`` (of those that can deliver), ``wanted``, ``demand`` and ``slope``.

    ``supplies`` has ``source``, ``supply`` (tokens) and ``texts``, ``targets``
    the share and the repeats. ``wanted`` is the share of ``total``, which is
    by default what all these sources supply once; ``demand`` is that or what
    the source can give with its repeats, so a scarce source falls short and
    doesn't shrink the others. Schedules are ``demand * (1 + slope * (2 t -
    1))``; sources of longer texts come later. The slopes, weighted with the
    demands, sum to zero, so the mix is as large at any time.
    """
    every = Window.partitionBy(F.lit(0))
    able = targets.join(supplies, "source").where("target_share > 0 and max_repeats > 0 and supply > 0").withColumn("share", F.col("target_share") / F.sum("target_share").over(every))
    amount = F.sum("supply").over(every) if total is None else F.lit(float(total))
    asked = able.withColumn("wanted", F.col("share") * amount).withColumn("demand", F.least("wanted", F.col("max_repeats").cast("double") * F.col("supply")))
    mean = F.col("supply") / F.col("texts")
    center = F.sum(F.col("demand") * mean).over(every) / F.sum("demand").over(every)
    apart = asked.where("demand > 0").withColumn("apart", mean - center)
    widest = F.coalesce(F.nullif(F.max(F.abs("apart")).over(every), F.lit(0.0)), F.lit(1.0))
    return apart.select("source", "share", "supply", "texts", "wanted", "demand", (STEEPNESS * F.col("apart") / widest).alias("slope"))


def mix(texts: DataFrame, key: str, source: str, tokens: str, targets: DataFrame, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The uses of the texts, and the sources' report.

    Uses: ``key``, ``source``, ``use`` (from 0), ``tokens`` and ``position``
    (0 to 1), sorted by position. Report: per source of the targets or the
    texts the target, the supply, what was wanted and used, the share reached
    and whether it is within a hundredth of the target (null for a source
    without one). Texts without tokens, and of a null source or one without
    target, are not used. A source's texts are used whole, every one as often
    as the others or once more, so its tokens miss the demand by half a text
    at most. ``targets`` has ``source``, ``target_share`` and
    ``max_repeats``, a source once. For ``total`` see ``plan_mix``.
    """
    sized = stage(texts.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(tokens).cast("bigint").alias("tokens")).where("tokens > 0 and source is not null"), "lengths")
    asked = targets.select("source", "target_share", "max_repeats").where("source is not null")
    counts = stage(sized.groupBy("source").agg(F.sum("tokens").alias("supply"), F.count(F.lit(1)).alias("texts")), "supplies")
    planned = stage(plan_mix(counts, asked, total), "plan")
    sources, rows = planned.agg(F.count(F.lit(1)), F.coalesce(F.sum("texts"), F.lit(0))).first()
    hot = [r[0] for r in planned.where(F.col("texts") >= max(HOT_ROWS, 0.02 * rows)).select("source").collect()]  # 50 at most
    plan = planned.select("source", "supply", "demand", "slope")

    in_order = sized.join(F.broadcast(plan), "source") if sources <= SENT_PLAN else lookup(sized, plan, "source", hot)
    placed = ranked(in_order.withColumn("order", F.xxhash64("key")), ["source"], "order", bits_for(rows), ties=["key"], weight=F.col("tokens"), before="before")
    half = F.col("tokens") / F.lit(2.0)
    again = F.floor((F.col("demand") - F.col("before") - half) / F.col("supply"))  # the last use that the demand reaches
    uses = placed.where(again >= 0).select("key", "source", "tokens", "supply", "demand", "slope", "before", F.explode(F.sequence(F.lit(0), again.cast("int"))).alias("use"))
    x = F.least(F.lit(1.0), (F.col("use") * F.col("supply") + F.col("before") + half) / F.col("demand"))
    a = F.col("slope")
    # the schedule demands x of its tokens by the time t with t + slope * (t * t - t) = x
    inverse = F.when(F.abs(a) < 1e-9, x).otherwise((a - 1 + F.sqrt((1 - a) * (1 - a) + 4 * a * x)) / (2 * a))
    out = uses.select(F.col("key").alias(key), "source", "use", "tokens", inverse.alias("position")).orderBy("position", key, "use")

    used = uses.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.count_distinct("key").alias("used_texts"), (F.max("use") + 1).alias("most_uses"))
    report = counts.select("source", "supply").join(asked, "source", "full").join(planned.select("source", "wanted"), "source", "left").join(used, "source", "left")
    all_used = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))
    share = F.when(all_used > 0, F.coalesce("used_tokens", F.lit(0)) / all_used).otherwise(F.lit(0.0))
    report = report.withColumn("share", share).select(
        "source", "target_share", "max_repeats", F.coalesce("supply", F.lit(0)).alias("supply_tokens"), F.coalesce(F.round("wanted"), F.lit(0)).cast("bigint").alias("wanted_tokens"),
        F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("used_texts", F.lit(0)).alias("used_texts"), F.coalesce("most_uses", F.lit(0)).cast("int").alias("most_uses"), "share",
        (F.abs(F.col("share") - F.col("target_share")) <= 0.01).alias("met"),
    )
    return out, report
