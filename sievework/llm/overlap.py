"""Records of evaluation splits that are also in train, exactly or nearly.

The distinct keys of the evaluation records (content digests, file paths) are
cut into shards, each a compressed full-text index (``fmindex``). The training
records are streamed through backward search in the shard that can hold their
key; a maximal match that spans a whole key says which class of evaluation
records the training record overlaps with. Nothing else connects the two
sides: classes, their members and counts are merged afterwards, and expanded
into pairs only where pairs are asked for.

Both sides are sharded by the same hash of the key, so the work grows in
proportion to the keys. The training records of a hot key are spread over
several copies of its part of the index.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import HOT_ROWS, hot_keys, lookup, salted_join
from ..storage import drop, stage
from .fmindex import FMIndex

#: Bytes of keys, of both sides together, that one shard has on average.
SHARD_BYTES = 3_000_000
#: A hot key's training records are spread over so many copies of the key.
SALTS = 32


def match_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """``ref`` of the streamed rows whose key is indexed, with that key's ``held``; rows with ``held`` are what is indexed."""
    indexed, stream = rows[rows["held"].notna()], rows[rows["held"].isna()]
    if indexed.empty or stream.empty:
        return pd.DataFrame({"ref": [], "held": []}, dtype=str)
    index = FMIndex([k.encode() for k in indexed["key"]])
    number = index.located([k.encode() for k in stream["key"]])
    return pd.DataFrame({"ref": stream["ref"].to_numpy()[number >= 0], "held": indexed["held"].to_numpy()[number[number >= 0]]})


def search_stream(stream: DataFrame, held_out: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``ref`` and ``held`` (texts) of every row of ``stream`` whose key is one of ``held_out``.

    ``stream`` has the texts ``key`` and ``ref``, ``held_out`` has ``key``
    (once each) and ``held``. Null and empty keys match nothing, keys of any
    length are searched whole. Other columns are ignored.
    """
    side = lambda df, ref, held: df.where(F.col("key") != "").select("key", ref.cast("string").alias("ref"), held.cast("string").alias("held"))
    none = F.lit(None)
    streamed = stage(side(stream, F.col("ref"), none), "stream")
    rows, amount = streamed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("key") + 1), F.lit(0))).first()
    shards = max(1, -(-2 * amount // shard_bytes))
    hot = hot_keys(streamed, "key", rows, least=HOT_ROWS // 10)
    is_hot = F.col("key").isin(hot) if hot else F.lit(False)
    last = F.when(is_hot, F.lit(SALTS - 1)).otherwise(F.lit(0))
    spread = streamed.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("ref"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    copied = side(held_out, none, F.col("held")).withColumn("salt", F.explode(F.sequence(F.lit(0), last)))
    placed = spread.unionByName(copied).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    found = stage(placed.groupBy("shard", "salt").applyInPandas(match_shard, "ref string, held string"), "matches")
    drop(streamed)
    return found


class Overlaps(NamedTuple):
    """What is in train too, in classes; a class is the smallest id of the held-out records with one digest."""

    #: ``train_id``, ``class``
    exact: DataFrame
    #: ``held_id``, ``class``: all held-out records with a digest
    members: DataFrame
    #: ``train_id``, ``held_id``, and whether they have the ``same`` digest
    near: DataFrame
    #: ``held_id``, ``path``, ``digest``, ``split``
    held: DataFrame


def find_overlaps(files: DataFrame, links: DataFrame, split_of: Callable[[Column], Column]) -> Overlaps:
    """Overlaps of train with validation and test.

    ``files`` has ``id``, ``path``, ``digest`` and ``split`` (train,
    validation, test; other splits overlap with nothing), one row per id;
    ``links`` has ``a`` and ``b``, paths of near-duplicates, in any order and
    repetition. ``split_of`` tells a path's split as ``files`` does, so links
    within one split are dropped before anything moves. A null path, digest
    or split matches nothing. Empty tables give no rows.
    """
    known = stage(files.where(F.col("split").isin("train", "validation", "test")).select("id", "path", "digest", "split"), "files")
    kind = dict(known.dtypes)["id"]
    train = known.where(F.col("split") == "train").withColumnRenamed("id", "train_id").drop("split")
    held = known.where(F.col("split") != "train").withColumnRenamed("id", "held_id")

    # one comparison, so that each path's split is worked out once
    both = F.concat_ws(">", split_of(F.col("a")), split_of(F.col("b")))
    across = links.select("a", "b").where(both.isin("train>validation", "train>test", "validation>train", "test>train"))
    held_a = split_of(F.col("a")) != "train"
    across = across.select(
        F.when(held_a, F.col("b")).otherwise(F.col("a")).alias("train_path"),
        F.when(held_a, F.col("a")).otherwise(F.col("b")).alias("held_path"),
    ).distinct()

    def classes(c: str) -> DataFrame:
        return held.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("held_id").alias("class"))

    def members(c: str) -> DataFrame:
        rows = held.where(F.col(c).isNotNull())
        return lookup(rows.select(c, "held_id", "digest" if c == "path" else "path"), classes(c), c, hot_keys(rows, c, rows.count()))

    tagged = lambda tag, c: F.concat(F.lit(tag), F.col(c)).alias("key")
    stream = train.select(tagged("d:", "digest"), F.concat(F.lit("d:"), F.col("train_id").cast("string")).alias("ref"))
    stream = stream.unionByName(across.select(tagged("p:", "held_path"), F.concat(F.lit("p:"), F.col("train_path")).alias("ref")))
    indexed = classes("digest").select(tagged("d:", "digest"), F.col("class").alias("held")).unionByName(classes("path").select(tagged("p:", "path"), F.col("class").alias("held")))
    found = search_stream(stream, indexed)
    hits = lambda tag: found.where(F.startswith("ref", F.lit(tag))).select(F.expr("substr(ref, 3)").alias("ref"), F.col("held").cast(kind).alias("class"))
    exact = hits("d:").select(F.col("ref").cast(kind).alias("train_id"), "class")

    met = hits("p:").withColumnRenamed("ref", "path")
    of_train = train.where(F.col("path").isNotNull()).select("path", "train_id", F.col("digest").alias("train_digest"))
    by_path = salted_join(met, of_train, "path", hot_keys(met, "path", met.count()), "class", SALTS).drop("path")
    of_path = members("path").select("held_id", "class", F.col("digest").alias("held_digest"))
    paired = salted_join(by_path, of_path, "class", hot_keys(by_path, "class", by_path.count()), "train_id", SALTS)
    near = paired.select("train_id", "held_id", F.coalesce(F.col("train_digest") == F.col("held_digest"), F.lit(False)).alias("same"))
    return Overlaps(exact, members("digest").select("held_id", "class"), stage(near, "near"), held)


def expanded(found: Overlaps) -> DataFrame:
    """All pairs: ``train_id``, ``held_id``, ``how`` (exact or near); a pair found both ways appears once for each."""
    hot = hot_keys(found.exact, "class", found.exact.count(), least=HOT_ROWS // 10)
    exact = salted_join(found.exact, found.members, "class", hot, "train_id", SALTS)
    return exact.select("train_id", "held_id", F.lit("exact").alias("how")).unionByName(found.near.select("train_id", "held_id", F.lit("near").alias("how")))


def overlap_counts(found: Overlaps) -> DataFrame:
    """Per held-out record with an overlap: ``held_id``, ``pairs``, ``exact`` and ``near`` pairs, without expanding any."""
    sizes = found.exact.groupBy("class").agg(F.count(F.lit(1)).alias("exact"))
    hot = hot_keys(found.members, "class", found.members.count())
    exact = lookup(found.members, sizes, "class", hot).select("held_id", "exact")
    near = found.near.groupBy("held_id").agg(F.count(F.lit(1)).alias("near"), F.count_if("same").alias("both"))
    full = exact.join(near, "held_id", "full").na.fill(0, ["exact", "near", "both"])
    return full.select("held_id", (F.col("exact") + F.col("near") - F.col("both")).alias("pairs"), "exact", "near")


def cross_split_overlaps(files: DataFrame, links: DataFrame, split_of: Callable[[Column], Column]) -> DataFrame:
    """The pairs of ``find_overlaps``: ``train_id``, ``held_id``, ``how``."""
    return expanded(find_overlaps(files, links, split_of))
