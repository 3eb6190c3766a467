"""A sample whose shares of categories match targets.

Each category gets an acceptance probability from its target and its count;
rows are accepted one by one by a hash of their key, slightly more than
needed. The surplus is then cut exactly, in hash order; a category that fell
short of its plan by chance is read again without the bound. So a category's
sample is always the planned number of rows with the smallest hashes, drawn
in proportion to the sample and not to the table. Several samples of one table
are drawn together: it is read once to count and once to draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import HOT_ROWS, bits_for, lookup, ranked
from ..storage import stage

#: Bits of the uniform hash.
HASH_BITS = 60
#: Plans of at most so many rows go to the rows; larger ones are joined.
SENT_PLAN = 10_000
#: A share within so much of its target is met.
TOLERANCE = 0.01


def uniform_hash(*columns: Column | str) -> Column:
    """60 uniform bits of the MD5 of the columns' texts joined with ``|``."""
    joined = F.concat_ws("|", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _cell(by: str | None, category: str) -> Column:
    """One text for the sample and the category; null if either is."""
    text = lambda c: F.col(c).cast("string")
    return F.concat(text(by), F.lit("\0"), text(category)) if by else text(category)


def plan_sample(counts: DataFrame, targets: DataFrame, by: str | None, size: int | None, fraction: float) -> DataFrame:
    """Per target how many rows are ``wanted``, ``planned`` and missing (``deficit``), from the rows ``available`` per ``cell``.

    ``wanted`` is the share of ``size``, or ``min_rows`` if that is more.
    Without a size it is ``fraction`` of the rows that have a target, or what
    it takes that no minimum which can be kept exceeds its category's share.
    """
    named = [by] if by else []
    asked = targets.where(F.col("category").isNotNull()).select(
        *named, "category", "target_share", "min_rows", _cell(by, "category").alias("cell"), F.coalesce("target_share", F.lit(0.0)).alias("_share"), F.coalesce("min_rows", F.lit(0)).alias("_least")
    )
    every = Window.partitionBy(F.col(by) if by else F.lit(0))
    known = asked.join(counts, "cell", "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("bigint"))
    keeps = F.when((F.col("_share") > 0) & (F.col("available") >= F.col("_least")), F.ceil(F.col("_least") / F.col("_share")))
    free = F.greatest(F.floor(F.lit(fraction) * F.sum("available").over(every) + 0.5), F.coalesce(F.max(keeps).over(every), F.lit(0)))
    sized = known.withColumn("size", (free if size is None else F.lit(size)).cast("bigint"))
    wanted = F.greatest(F.floor(F.col("_share") * F.col("size") + 0.5), F.col("_least")).cast("bigint")
    planned = sized.withColumn("wanted", wanted).withColumn("planned", F.least("wanted", "available")).withColumn("deficit", F.col("wanted") - F.col("planned"))
    return planned.select(*named, "category", "target_share", "min_rows", "available", "size", "wanted", "planned", "deficit", "cell")


def sample_to_targets(
    rows: DataFrame, key: str, category: str, targets: DataFrame, by: str | None = None, size: int | None = None, fraction: float = 0.2, seed: str = ""
) -> tuple[DataFrame, DataFrame]:
    """The sampled ``rows`` and the plan (see ``plan_sample``), one row per target.

    ``targets`` has ``category``, ``target_share`` and ``min_rows``, a
    category once. With ``by``, a column of both tables, each of its values
    is a sample of its own. Rows whose category is null or has no target are
    never drawn; rows with the same key are separate rows. With no rows, or
    no targets, the sample is empty and every deficit is full. ``rows`` keeps
    its columns; names starting with ``_sample`` are used inside.
    """
    counts = rows.select(_cell(by, category).alias("cell")).where("cell is not null").groupBy("cell").agg(F.count(F.lit(1)).alias("available"))
    plan = stage(plan_sample(counts, targets, by, size, fraction), "plan")
    top = float(2**HASH_BITS)
    # four standard deviations above the plan, in units of the hash
    reach = F.least(F.lit(top), top * (F.col("planned") + 4 * F.sqrt("planned") + 10) / F.col("available"))
    drawn_of = plan.where("planned > 0").select(F.col("cell").alias("_sample_cell"), F.col("planned").alias("_sample_need"), F.when(F.col("planned") < F.col("available"), reach).otherwise(F.lit(top)).cast("bigint").alias("_sample_bound"), "available")
    numbers = drawn_of.agg(F.count(F.lit(1)), F.coalesce(F.sum("available"), F.lit(0)), F.coalesce(F.sum("_sample_need"), F.lit(0))).first()
    hot = [r[0] for r in drawn_of.where(F.col("available") >= max(HOT_ROWS, 0.02 * numbers[1])).select("_sample_cell").collect()]  # 50 at most
    hashed = rows.withColumn("_sample_cell", _cell(by, category)).withColumn("_sample_hash", uniform_hash(F.lit(seed), key))

    def met(cells: DataFrame) -> DataFrame:
        return hashed.join(F.broadcast(cells), "_sample_cell") if numbers[0] <= SENT_PLAN else lookup(hashed, cells, "_sample_cell", hot)

    drawn = stage(met(drawn_of.drop("available")).where(F.col("_sample_hash") < F.col("_sample_bound")), "drawn")
    got = drawn.groupBy("_sample_cell").agg(F.count(F.lit(1)).alias("_sample_got"))
    short = drawn_of.drop("available").join(got, "_sample_cell", "left").where(F.coalesce("_sample_got", F.lit(0)) < F.col("_sample_need")).drop("_sample_got")
    if short.limit(1).count():
        drawn = drawn.unionByName(met(short).where(F.col("_sample_hash") >= F.col("_sample_bound")))
    drawn = drawn.withColumn("_sample_order", F.shiftleft("_sample_hash", 64 - HASH_BITS))
    ordered = ranked(drawn, ["_sample_cell"], "_sample_order", bits_for(numbers[2]), ties=[key], rank="_sample_rank", before="_sample_before")
    return ordered.where(F.col("_sample_rank") <= F.col("_sample_need")).select(*rows.columns), plan.drop("cell")


def shares_reached(sample: DataFrame, category: str, size: Column, plan: DataFrame, by: str | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """The plan with the sampled rows, their share, and their share of ``size`` (null or negative sizes count 0).

    ``met``: the minimum is kept and the share is within ``tolerance`` of its
    target. ``reason`` if not: ``supply`` (too few rows), ``minimum`` (the
    minimum exceeds the share), ``rounding`` (to whole rows), or ``others``
    (other categories have more or less than their share).
    """
    named = [by] if by else []
    amount = F.when(size > 0, size).otherwise(F.lit(0)).cast("bigint")
    reached = sample.groupBy(*named, F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("sampled"), F.sum(amount).alias("amount"))
    full = plan.join(reached, [*named, "category"], "left").withColumns({"sampled": F.coalesce("sampled", F.lit(0)), "amount": F.coalesce("amount", F.lit(0))})
    every = Window.partitionBy(F.col(by) if by else F.lit(0))
    ratio = lambda c: F.when(F.sum(c).over(every) > 0, F.col(c) / F.sum(c).over(every)).otherwise(F.lit(0.0))
    shared = full.withColumn("share", ratio("sampled")).withColumn("amount_share", ratio("amount"))
    target = F.coalesce("target_share", F.lit(0.0))
    met = (F.col("sampled") >= F.coalesce("min_rows", F.lit(0))) & (F.abs(F.col("share") - target) <= tolerance)
    reason = (
        F.when(met, None)
        .when(F.col("deficit") > 0, "supply")
        .when(F.col("wanted") > F.floor(target * F.col("size") + 0.5), "minimum")
        .when((F.col("size") > 0) & (F.abs(F.col("wanted") / F.nullif(F.col("size"), F.lit(0)) - target) > tolerance), "rounding")
        .otherwise("others")
    )
    return shared.select(*named, "category", "target_share", "min_rows", "available", "wanted", "sampled", "deficit", "share", "amount_share", met.alias("met"), reason.alias("reason"))
