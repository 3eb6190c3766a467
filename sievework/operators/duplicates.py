"""Exact and near duplicates: groups, pairs and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import block_key, hex_halves, yes_no
from ..storage import stage
from .skew import HOT_ROWS, hot_keys, lookup, salted_join


def duplicate_groups(items: DataFrame, digest: str, item: str) -> DataFrame:
    """Digests that stand on more than one item: ``digest``, ``group_size``, ``redundant_files``, ``first_item``."""
    groups = items.where(F.col(digest).isNotNull()).groupBy(F.col(digest).alias("digest"))
    sized = groups.agg(F.count(F.lit(1)).alias("group_size"), F.min(item).alias("first_item"))
    return sized.where("group_size > 1").withColumn("redundant_files", F.col("group_size") - 1)


def duplicate_totals(items: DataFrame, digest: str) -> DataFrame:
    """One row: unique digests, groups, files in groups, redundant files."""
    sizes = items.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count(F.lit(1)).alias("n"))
    more = F.col("n") > 1
    return sizes.agg(
        F.count(F.lit(1)).alias("unique_digests"),
        F.count_if(more).alias("groups"),
        F.coalesce(F.sum(F.when(more, F.col("n"))), F.lit(0)).alias("files_in_groups"),
        F.coalesce(F.sum(F.when(more, F.col("n") - 1)), F.lit(0)).alias("redundant_files"),
    )


def group_profile(items: DataFrame, group: str, raw: str = "raw") -> DataFrame:
    """Per group of more than one item its datasets, splits and labels, and what they imply.

    ``items`` has ``dataset``, ``split`` and ``label``. ``split_leakage``:
    two or more splits other than ``raw``; ``train_and_test``: both present.
    """
    known = items.where(F.col(group).isNotNull())
    sets = known.groupBy(group).agg(F.count(F.lit(1)).alias("group_size"), *[F.array_sort(F.collect_set(c)).alias(f"_{c}") for c in ("dataset", "split", "label")])
    joined = lambda c: F.array_join(f"_{c}", "|").alias(f"{c}s")
    leak = F.size(F.array_remove("_split", raw)) > 1
    both = F.array_contains("_split", "train") & F.array_contains("_split", "test")
    return sets.where("group_size > 1").select(
        group, "group_size", (F.col("group_size") - 1).alias("redundant_files"), joined("dataset"), joined("split"), joined("label"),
        yes_no(leak).alias("split_leakage"), yes_no(F.size("_label") > 1).alias("label_conflict"), yes_no(F.size("_dataset") > 1).alias("cross_dataset"), yes_no(both).alias("train_and_test"),
    )


def number_groups(groups: DataFrame, *order: Column) -> DataFrame:
    """``group_id`` from 1 in the order given, which must be total.

    Ranges of the order are numbered in parallel and offset by the counts of
    the ranges before, so no task sees all groups. The ranges are written
    once, as another run might cut them elsewhere.
    """
    spread = groups.repartitionByRange(*order).sortWithinPartitions(*order)
    # within a partition the id counts up from partition * 2**33
    numbered = spread.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    rows = stage(numbered.withColumn("_row", F.col("_row") - F.shiftleft(F.col("_part").cast("bigint"), 33)), "numbered")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn("group_id", F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")


def copies(items: DataFrame, item: str, fingerprint: str) -> DataFrame:
    """``item``, its ``representative`` (the smallest item of the same fingerprint) and ``copies``, how many share it."""
    known = items.where(F.col(fingerprint).isNotNull() & F.col(item).isNotNull()).select(F.col(item).alias("item"), F.col(fingerprint).alias("hash")).distinct()
    values = known.groupBy("hash").agg(F.min("item").alias("representative"), F.count(F.lit(1)).alias("copies"))
    return known.join(values, "hash").select("item", "representative", "copies")


def bands(high: Column, low: Column, number: int, halves: bool) -> list[Column]:
    """The bits of a fingerprint in so many slices, of the low half only or of both."""

    def cut(half: Column, pieces: int) -> list[Column]:
        edges = [32 * i // pieces for i in range(pieces + 1)]
        return [F.shiftright(half, start).bitwiseAND(F.lit((1 << (end - start)) - 1)) for start, end in zip(edges, edges[1:], strict=False)]

    return cut(high, number // 2) + cut(low, number - number // 2) if halves and number > 1 else cut(low, number)


def near_pairs(items: DataFrame, item: str, fingerprint: str, most: int = 4, digits: int = 8) -> DataFrame:
    """Pairs of different fingerprints that share the leading hex digits and differ in at most ``most`` bits.

    Each fingerprint is represented by its smallest item; ``copies`` tells
    which items share one, so no pair is lost and copies aren't multiplied.
    Of ``most + 1`` slices of the bits at least one is equal in a pair, so
    only fingerprints of one block that share a slice are compared; a pair
    counts where its first equal slice is.
    """
    known = items.where(F.col(fingerprint).isNotNull() & F.col(item).isNotNull())
    high, low = hex_halves(F.col("hash"))
    values = known.groupBy(F.col(fingerprint).alias("hash")).agg(F.min(item).alias("item"))
    values = stage(values.select(block_key(F.col("hash"), digits).alias("block"), "item", high.alias("high"), low.alias("low")), "fingerprints")
    slices = lambda end: bands(F.col(f"high{end}"), F.col(f"low{end}"), most + 1, digits < 8)
    sliced = values.select("block", "item", "high", "low", F.posexplode(F.array(*slices(""))).alias("band", "slice"))
    keyed = sliced.select(F.xxhash64("block", "band", "slice").alias("key"), "block", "band", "item", "high", "low")
    count = values.count() * (most + 1)
    hot = hot_keys(keyed, "key", count) if count >= HOT_ROWS else []
    side = lambda end: keyed.select("key", *[F.col(c).alias(f"{c}_{end}") for c in ("block", "band", "item", "high", "low")])
    distance = F.bit_count(F.col("high_a").bitwiseXOR(F.col("high_b"))) + F.bit_count(F.col("low_a").bitwiseXOR(F.col("low_b")))
    equal = F.array(*[x == y for x, y in zip(slices("_a"), slices("_b"), strict=True)])
    met = salted_join(side("a"), side("b"), "key", hot, "item_a").where((F.col("item_a") < F.col("item_b")) & (F.col("block_a") == F.col("block_b")) & (F.col("band_a") == F.col("band_b")) & (distance <= most))
    return met.where(F.array_position(equal, True) == F.col("band_a") + 1).select(distance.alias("distance"), "item_a", "item_b")


def distance_histogram(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("distance").agg(F.count(F.lit(1)).alias("n"))


def endpoints(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The distinct non-null values of two columns, as ``item``."""
    return pairs.select(F.explode(F.array(a, b)).alias("item")).where("item is not null").distinct()


def involvement(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """In how many pairs each value takes part; a pair with the same value twice counts once."""
    return pairs.select(F.explode(F.array_distinct(F.array(a, b))).alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("pairs"))


def relationships(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """Counts of ``A <-> B`` as the pairs are written; the other way round is another relationship."""
    return pairs.select(F.concat(a, F.lit(" <-> "), b).alias("relationship")).where("relationship is not null").groupBy("relationship").agg(F.count(F.lit(1)).alias("pairs"))


def verify_pairs(pairs: DataFrame, items: DataFrame, item: str, digest: str) -> DataFrame:
    """Pairs of distance 0 with both ends' digests and ``exact_duplicate`` YES or NO (NO if a digest is unknown)."""
    known = items.select(F.col(item).alias("_item"), F.col(digest).alias("_digest")).where("_item is not null").groupBy("_item").agg(F.min("_digest").alias("_digest"))
    at = pairs.where(F.col("distance") == 0)
    rows = at.count()
    # an image may be an end of many pairs
    hot = {c: hot_keys(at, c, rows) if rows >= HOT_ROWS else [] for c in ("image_a", "image_b")}
    for end in ("a", "b"):
        side = known.select(F.col("_item").alias(f"image_{end}"), F.col("_digest").alias(f"sha256_{end}"))
        at = lookup(at, side, f"image_{end}", hot[f"image_{end}"], "left")
    return at.withColumn("exact_duplicate", yes_no(F.coalesce(F.col("sha256_a") == F.col("sha256_b"), F.lit(False))))
