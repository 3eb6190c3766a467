"""File paths as keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The folder right below the dataset's, which follows the first ``raw`` part, or is the first part if no part is ``raw``.
_BELOW_DATASET = r"(?i)^/*(?:(?:.*?/)??raw/+[^/]+|(?!(?:.*/)?raw(?:/|$))[^/]+)/+([^/]+)/+[^/]"


def image_path(path: Column) -> Column:
    r"""One spelling per file: ``\`` becomes ``/`` and leading ``./`` go. Null stays null."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(slashed.startswith("./"), F.regexp_replace(slashed, r"^(\./)+", "")).otherwise(slashed)


def path_parts(path: Column) -> Column:
    """Non-empty parts of a normalised path."""
    return F.filter(F.split(image_path(path), "/"), lambda p: p != "")


def own_split(path: Column) -> Column:
    """train, validation or test by the folder right below the dataset folder, else raw; null for a null path.

    The dataset folder follows ``raw``; without a ``raw`` folder it is the
    first part. ``val`` counts as validation; case is ignored.
    """
    folder = F.regexp_extract(image_path(path), _BELOW_DATASET, 1)
    names = F.create_map(*[F.lit(x) for x in ("train", "train", "test", "test", "val", "validation", "validation", "validation")])
    return F.when(path.isNotNull(), F.coalesce(F.try_element_at(names, F.lower(folder)), F.lit("raw")))


def dataset_folder(path: Column) -> Column:
    """The part after ``raw`` (the first part if there is none)."""
    parts = path_parts(path)
    return F.get(parts, F.array_position(F.transform(parts, F.lower), "raw").cast("int"))


def label_folder(path: Column) -> Column:
    """The folder that holds the file, null if there is none."""
    return F.try_element_at(path_parts(path), F.lit(-2))
