"""Scans: blobs, image files, report tables, optional inputs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import digest, suffix
from ..functions.vocabulary import IMAGE_SUFFIXES
from .images import image_check, image_header  # noqa: F401


def list_files(spark: SparkSession, root: str, suffixes: Iterable[str] = IMAGE_SUFFIXES) -> DataFrame:
    """``path``, ``length``, ``modificationTime`` and ``is_image`` of all files below ``root``.

    Contents are not read. Files of no bytes are left out, as Spark's scans
    do; so are they in the other scans here.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", "length", "modificationTime", suffix(F.col("path")).isin(*suffixes).alias("is_image"))


def scan_images(spark: SparkSession, root: str, suffixes: Iterable[str] = IMAGE_SUFFIXES) -> DataFrame:
    """The image files below ``root`` with their ``content``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(suffix(F.col("path")).isin(*suffixes))


def file_digests(spark: SparkSession, root: str, suffixes: Iterable[str] = IMAGE_SUFFIXES) -> DataFrame:
    """``path``, ``length`` and ``sha256`` of the image files."""
    return scan_images(spark, root, suffixes).select("path", "length", digest(F.col("content")).alias("sha256"))


def read_report(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV report with a header; Spark raises if it is missing. No type is inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_optional(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV report, or an empty table of its schema if there is none."""
    try:
        return read_report(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def validated_images(spark: SparkSession, root: str, suffixes: Iterable[str] = IMAGE_SUFFIXES) -> DataFrame:
    """``path``, ``length``, ``status`` (valid, warning, corrupt), ``message``, ``width``, ``height`` and ``format`` of the image files."""
    return scan_images(spark, root, suffixes).select("path", "length", image_check(F.col("content")).alias("check")).select("path", "length", "check.*")
