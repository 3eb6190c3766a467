"""Building blocks that keep hot keys out of single tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key with fewer rows than this is never treated as hot.
HOT_ROWS = 20_000


def hot_keys(df: DataFrame, key: str, rows: int, least: int = HOT_ROWS, share: float = 0.02) -> list:
    """Values of ``key`` that hold at least ``least`` rows and ``share`` of the ``rows`` rows.

    At most ``1 / share`` values can qualify, so the list is bounded whatever
    the data. Counting combines on the map side. Null is never hot.
    """
    limit = max(least, int(rows * share))
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= limit)
    return [r[0] for r in counts.select(key).collect()]


def lookup(left: DataFrame, right: DataFrame, key: str, hot: Sequence, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right``, which has one row per ``key``, without a task for a hot key.

    Rows of the ``hot`` keys meet their at most ``len(hot)`` partners by
    broadcast and stay where they are; all other rows take the shuffle join.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(list(hot))
    cold = left.where(~F.coalesce(is_hot, F.lit(False))).join(right, key, how)
    warm = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return cold.unionByName(warm)


def bits_for(rows: int, target: int = 50_000) -> int:
    """Bits of a uniform hash that cut ``rows`` rows into pieces of about ``target``."""
    return max(0, min(30, (max(rows, 1) // target).bit_length()))


def ranked(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    bits: int,
    ties: Sequence[str] = (),
    weight: Column | None = None,
    rank: str = "rank",
    before: str = "before",
) -> DataFrame:
    """Exact 1-based ``rank`` inside each group by a uniform hash, hot groups included.

    ``order`` must be a BIGINT hash column (any sign). Each group is cut into
    ``2 ** bits`` ranges of the hash; counts per range (pre-aggregated before
    their shuffle) give every range its offset, and only rows of one range
    are sorted together. With ``weight``, ``before`` is the sum of the
    weights of all rows ahead in the group.
    """
    piece = F.shiftrightunsigned(F.col(order), 64 - bits) if bits else F.lit(0).cast("bigint")
    cut = df.withColumn("_piece", piece)
    keys = [*by, "_piece"]
    weight = F.lit(0).cast("bigint") if weight is None else weight
    cut = cut.withColumn("_w", weight)
    totals = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_s"))
    ahead = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(ahead), F.lit(0)).cast("bigint").alias("_s0"),
    )
    on = None
    for k in keys:
        same = cut[k].eqNullSafe(offsets[f"_o_{k}"])
        on = same if on is None else on & same
    unsigned = F.shiftrightunsigned(F.col(order), 1)
    within = Window.partitionBy(*keys).orderBy(unsigned, F.col(order), *ties)
    out = cut.join(offsets, on, "inner").select(*[cut[c] for c in cut.columns], "_n0", "_s0")
    out = out.withColumn(rank, F.col("_n0") + F.row_number().over(within))
    running = F.sum("_w").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.withColumn(before, F.col("_s0") + running - F.col("_w"))
    return out.drop("_piece", "_w", "_n0", "_s0")


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: Sequence, spread: str, salts: int = 32) -> DataFrame:
    """Inner join in which both sides may have many rows of a hot key.

    The left rows of the ``hot`` keys are spread over ``salts`` tasks by the
    column ``spread``, each with a copy of the right rows of its key; other
    keys aren't copied. ``spread`` should tell the left rows of a key apart.
    """
    if not hot:
        return left.join(right, key)
    is_hot = F.coalesce(F.col(key).isin(list(hot)), F.lit(False))
    cast = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    copied = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, F.lit(salts - 1)).otherwise(F.lit(0)))))
    return cast.join(copied, [key, "_salt"]).drop("_salt")
