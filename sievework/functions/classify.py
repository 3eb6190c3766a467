"""Classifiers of paths and labels.

Several notions of a file's split, dataset and crop are in use and differ in
precedence; each has a function of its own, none is silently unified.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import normalize_label, normalize_loose, parts, slashes

#: Split folders by precedence: (folder, name).
TRAIN_FIRST = (("train", "train"), ("validation", "validation"), ("val", "validation"), ("test", "test"))
TEST_FIRST = (("test", "test"), ("train", "train"), ("validation", "validation"), ("val", "validation"))
TRAIN_TEST = (("train", "train"), ("test", "test"), ("validation", "validation"), ("val", "validation"))
REVIEW = (("test", "TEST"), ("train", "TRAIN"))


def chain(rules: Iterable[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first rule that holds."""
    out = None
    for test, value in rules:
        out = F.when(test, value) if out is None else out.when(test, value)
    return otherwise if out is None else out.otherwise(otherwise)


def lower_parts(path: Column) -> Column:
    return F.transform(parts(path), F.lower)


def split_of(path: Column, precedence: Sequence[tuple[str, str]] = TRAIN_FIRST, otherwise: str = "raw") -> Column:
    """The first split folder, by precedence, that is anywhere in the path."""
    p = lower_parts(path)
    return chain([(F.array_contains(p, folder), F.lit(name)) for folder, name in precedence], F.lit(otherwise))


def dataset_leftmost(path: Column, known: Mapping[str, str] = V.DATASETS, otherwise: str = "Unknown") -> Column:
    """The name of the left-most part that is a known dataset folder."""
    names = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    first = F.get(F.filter(lower_parts(path), lambda x: x.isin(*known)), F.lit(0))
    return F.coalesce(F.try_element_at(names, first), F.lit(otherwise))


def dataset_by_priority(path: Column, known: Mapping[str, str] = V.DATASETS, otherwise: str = "Unknown") -> Column:
    """The first known dataset, in the order given, that is anywhere in the path."""
    p = lower_parts(path)
    return chain([(F.array_contains(p, k), F.lit(v)) for k, v in known.items()], F.lit(otherwise))


def dataset_by_substring(path: Column, words: Sequence[tuple[str, str]], otherwise: str = "other") -> Column:
    """The first word, in the order given, that is anywhere in the path's text."""
    text = F.lower(slashes(path))
    return chain([(F.contains(text, F.lit(w)), F.lit(v)) for w, v in words], F.lit(otherwise))


def source_after_root(path: Column, known: Iterable[str], root: str = "raw", otherwise: str = "unknown") -> Column:
    """The part behind the first part that reads ``root``, if it is a known source as written."""
    p = parts(path)
    at = F.array_position(F.transform(p, normalize_loose), root).cast("int")
    found = F.when(at > 0, F.get(p, at))
    return F.when(found.isin(*known), found).otherwise(F.lit(otherwise))


def crop_after_root(path: Column, root: str = "raw", otherwise: str = "unknown") -> Column:
    """The part behind the first part that is ``root`` exactly."""
    p = parts(path)
    at = F.array_position(p, root).cast("int")
    return F.coalesce(F.when(at > 0, F.get(p, at)), F.lit(otherwise))


def crop_below_dataset(path: Column, known: Iterable[str], nested: Iterable[str], root: str = "raw", otherwise: str = "Unknown") -> Column:
    """The known dataset behind ``root`` (any case); for nested ones the part below it."""
    p = parts(path)
    at = F.array_position(F.transform(p, F.lower), root).cast("int")
    dataset = F.when(at > 0, F.get(p, at))
    low = F.lower(dataset)
    below = F.get(p, at + 1)
    known, nested = list(known), list(nested)
    return F.when(low.isin(*nested) & below.isNotNull(), below).when(low.isin(*known), dataset).otherwise(F.lit(otherwise))


def crop_of_label(label: Column, aliases: Mapping[str, str] = V.CROP_ALIASES, first: str | None = "bell pepper", otherwise: str = "unknown") -> Column:
    """The crop of the longest alias that is in the label (ties: the earlier one); ``first`` is tried before all."""
    text = normalize_loose(label)
    order = sorted(aliases, key=lambda a: -len(a))
    order = [first, *[a for a in order if a != first]] if first in aliases else order
    return chain([(F.contains(text, F.lit(a)), F.lit(aliases[a])) for a in order], F.lit(otherwise))


def crop_of(source: Column, label: Column, single: Iterable[str], multi: Iterable[str], otherwise: str = "unknown", **options) -> Column:
    """Single-crop sources are their crop; multi-crop ones go by the label."""
    return F.when(source.isin(*single), F.lower(source)).when(source.isin(*multi), crop_of_label(label, **options)).otherwise(F.lit(otherwise))


def subset_of(path: Column) -> Column:
    p = lower_parts(path)
    return F.when(F.array_contains(p, "augmentedset"), "Augmented").when(F.array_contains(p, "originalset"), "Original").otherwise("Main")


def label_folder_structural(path: Column, known: Iterable[str] = tuple(V.DATASETS), multi: Iterable[str] = V.MULTI_CROP, otherwise: str = "Unknown") -> Column:
    """The folder below the dataset's, past one split folder (multi-crop datasets) or one subset folder (others); never the file itself."""
    p, low = parts(path), lower_parts(path)
    known, multi = list(known), list(multi)
    dataset = F.get(F.filter(low, lambda x: x.isin(*known)), F.lit(0))
    at = F.array_position(low, dataset).cast("int")  # 1-based, so 0-based it is the part behind
    following = F.get(low, at)
    skip = F.when(dataset.isin(*multi), following.isin("train", "test", "validation", "val")).otherwise(following.isin("augmentedset", "originalset"))
    start = at + F.when(skip, 1).otherwise(0)
    return F.coalesce(F.when(start < F.size(p) - 1, F.get(p, start)), F.lit(otherwise))


def parent_folder(path: Column) -> Column:
    return F.try_element_at(parts(path), F.lit(-2))


def is_healthy(label: Column, normalized: bool = False) -> Column:
    """Whether the label's text holds ``healthy`` or ``normal``, wherever."""
    text = normalize_label(label) if normalized else F.lower(label)
    return F.contains(text, F.lit("healthy")) | F.contains(text, F.lit("normal"))


def canonical_label(label: Column, words: Mapping[str, Sequence[str]] = V.DISEASE_WORDS, whole: Mapping[str, str] = V.WHOLE_LABELS, review: str = "REVIEW_REQUIRED") -> Column:
    """STRUCT(canonical_class, type): healthy, then whole labels, then the first rule with a word in the label."""
    text = normalize_label(label)
    out = lambda c, t: F.struct(F.lit(c).alias("canonical_class"), F.lit(t).alias("type"))
    rules = [(is_healthy(label, True), out("healthy", "healthy"))]
    rules += [(text == k, out(v, "disease")) for k, v in whole.items()]
    rules += [(F.contains(text, F.lit(w)), out(c, "disease")) for c, ws in words.items() for w in ws]
    return chain(rules, out(review, "unknown"))


def review_priority(distance: Column) -> Column:
    return F.when(distance == 0, "HIGH").when(distance <= 2, "MEDIUM").otherwise("LOW")


def moved(path: Column, old: str, new: str) -> Column:
    """The path with its prefix replaced; null if it doesn't have that prefix."""
    p = slashes(path)
    return F.when(F.startswith(p, F.lit(old)), F.concat(F.lit(new), F.substr(p, F.lit(len(old) + 1))))
