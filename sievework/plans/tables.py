"""The tables of a folder, and views that several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import dataset_folder, image_path, label_folder, own_split
from ..functions.text import strip


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def known_digest(c: Column) -> Column:
    """A digest in one spelling; blank is null."""
    text = F.lower(strip(c))
    return F.when(text != "", text)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per review_id of duplicate_review, as delivered last."""
    rows = table(spark, folder, "duplicate_review").where("review_id is not null")
    last = rows.groupBy("review_id").agg(F.max(F.struct("loaded_at", "file", "sha256", "width", "height", "format", "size_bytes")).alias("x"))
    path = image_path(F.col("x.file"))
    return last.select(
        "review_id", path.alias("file"), known_digest(F.col("x.sha256")).alias("digest"), dataset_folder(path).alias("dataset"), own_split(path).alias("split"), label_folder(path).alias("label"),
        F.col("x.width").alias("width"), F.col("x.height").alias("height"), F.col("x.format").alias("format"), F.col("x.size_bytes").alias("size_bytes"),
    )


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """near_duplicate_images with paths in one spelling, as ``pair_id, distance, image_a, image_b, hash_a, hash_b``."""
    return table(spark, folder, "near_duplicate_images").select("pair_id", "distance", image_path(F.col("image_a")).alias("image_a"), image_path(F.col("image_b")).alias("image_b"), "hash_a", "hash_b")


#: The same views in SQL.
def sql_path(c: str) -> str:
    return f"regexp_replace(replace({c}, chr(92), '/'), '^(\\./)+', '')"


SQL_FILES = f"""
  latest as (select review_id, max_by(struct_pack(file, sha256, width, height, format, size_bytes), loaded_at) x from duplicate_review where review_id is not null group by review_id),
  pathed as (select review_id, {sql_path("x.file")} file, nullif(lower(trim(x.sha256, ' ' || chr(9) || chr(10) || chr(13))), '') digest, x.width width, x.height height, x.format format, x.size_bytes size_bytes from latest),
  parted as (select *, string_split(file, '/') p from pathed),
  files as (select review_id, file, digest, p[3] dataset, p[-2] as label, width, height, format, size_bytes,
      case when file is null then null when len(p) < 5 then 'raw' when lower(p[4]) in ('val', 'validation') then 'validation' when lower(p[4]) in ('train', 'test') then lower(p[4]) else 'raw' end split from parted)
"""
SQL_PAIRS = f"pairs as (select pair_id, distance, {sql_path('image_a')} image_a, {sql_path('image_b')} image_b, hash_a, hash_b from near_duplicate_images)"
