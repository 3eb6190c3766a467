"""Schemas of the report tables, in column order."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

_TYPES = {"string": StringType(), "int": IntegerType(), "bigint": LongType(), "boolean": BooleanType()}


def _schema(ddl: str) -> StructType:
    """As StructType.fromDDL, which needs a running session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


REPORTS: dict[str, StructType] = {
    name: _schema(ddl)
    for name, ddl in {
        "dataset_inventory": "file string, source string, crop string, class string, width int, height int, format string, status string, warning string",
        "class_analysis": "crop string, source string, class string, images bigint, healthy boolean, meets_100_image_threshold boolean",
        "class_mapping": "source string, crop string, original_class string, canonical_class string, type string",
        "duplicate_images": "hash string, duplicate_group bigint, file string",
        "near_duplicate_images": "distance int, image_a string, image_b string, hash_a string, hash_b string",
        "near_duplicate_analysis": "distance int, image_a string, image_b string, crop_a string, crop_b string, dataset_a string, dataset_b string, review_priority string",
        "near_duplicate_verified": "distance int, image_a string, image_b string, sha256_a string, sha256_b string, exact_duplicate string, dataset_a string, dataset_b string, subset_a string, subset_b string, crop_a string, crop_b string",
        "exact_duplicate_groups": "group_id bigint, group_size bigint, redundant_files bigint, datasets string, subsets string, splits string, labels string, split_leakage string, label_conflict string, cross_dataset string, files string",
        "duplicate_review": "group_id bigint, group_size int, redundant_files int, dataset string, subsets string, splits string, labels string, split_leakage string, label_conflict string, sha256 string, file string, width int, height int, format string, size_bytes bigint",
        "duplicate_audit": "group_id bigint, file string, dataset string, label string, split string, decision string, keep_file string, exclude_file string, reason string",
        "clean_dataset_log": "file string, action string, reason string",
        "final_dataset_validation": "metric string, value string",
        "class_inventory": "dataset string, split string, class string, image_count bigint",
        "class_taxonomy_review": "dataset string, raw_class string, image_count bigint, crop string, category string, canonical_class string, decision string, reason string",
    }.items()
}
