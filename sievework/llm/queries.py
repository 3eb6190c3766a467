"""The queries of the operators for training data, and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import dataset_folder, image_path, label_folder, own_split
from .garbled import examine_texts
from .linked import group_linked
from .mapping import fill, match_values, normalise
from .mixing import mix
from .overlap import Overlaps, expanded, find_overlaps, overlap_counts
from .packing import pack
from .proportions import sample_to_targets, shares_reached
from .splits import propagate_labels, split_records, spread_report
from .tokens import token_lengths

#: A row of near_duplicate_images links its images at a distance from 0 to this.
MAX_DISTANCE = 4


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def image_links(spark: SparkSession, folder: str) -> DataFrame:
    """``a``, ``b``: the two images of each row that counts as a link, in one spelling."""
    pairs = table(spark, folder, "near_duplicate_images").where(F.col("distance").between(0, MAX_DISTANCE))
    return pairs.where(F.col("image_a").isNotNull() & F.col("image_b").isNotNull()).select(image_path(F.col("image_a")).alias("a"), image_path(F.col("image_b")).alias("b"))


def class_rows(spark: SparkSession, folder: str) -> DataFrame:
    """class_analysis with a ``category`` per field that targets can name, each in one spelling.

    Crops: lower case without blanks around. Classes: lower-case words joined
    with ``_``, without the row's crop in front (also followed by ``leaf``) or
    behind. The threshold flag: by ``images`` where that is a possible count,
    as the flag may be null or contradict it.
    """
    words = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    name, crop = words(F.substring_index("class", "___", -1)), F.coalesce(words(F.col("crop")), F.lit(""))
    bare = (
        F.when(crop == "", name)
        .when(F.startswith(name, F.concat(crop, F.lit(" leaf "))), F.substr(name, F.length(crop) + 7))
        .when(F.startswith(name, F.concat(crop, F.lit(" "))), F.substr(name, F.length(crop) + 2))
        .when(F.endswith(name, F.concat(F.lit(" "), crop)), F.substr(name, F.lit(1), F.length(name) - F.length(crop) - 1))
        .otherwise(name)
    )
    flag = F.when(F.col("images") >= 0, F.col("images") >= 100).otherwise(F.col("meets_100_image_threshold"))
    filled = lambda c: F.when(c != "", c)
    return table(spark, folder, "class_analysis").select(
        "analysis_id", "images",
        filled(F.lower(F.trim("crop"))).alias("crop"), filled(F.replace(bare, F.lit(" "), F.lit("_"))).alias("class"), flag.cast("string").alias("meets_100_image_threshold"),
    )


#: target_set of sample_targets and the field it is about.
SAMPLE_SETS = (("by_class", "class"), ("by_crop", "crop"), ("by_threshold", "meets_100_image_threshold"))


def set_targets(spark: SparkSession, folder: str) -> DataFrame:
    spelled = F.regexp_replace(F.lower(F.trim("category")), "[^a-z0-9]+", "_")
    return table(spark, folder, "sample_targets").select("target_set", spelled.alias("category"), "target_share", "min_rows")


def set_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Each row once for each set of targets, with its category there."""
    sets = F.array(*[F.struct(F.lit(name).alias("target_set"), F.col(field).alias("category")) for name, field in SAMPLE_SETS])
    return class_rows(spark, folder).select(F.inline(sets), "analysis_id", "images")


def p1_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sample_to_targets(set_rows(spark, folder), "analysis_id", "category", set_targets(spark, folder), by="target_set")[0]


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    sample, plan = sample_to_targets(set_rows(spark, folder), "analysis_id", "category", set_targets(spark, folder), by="target_set")
    return shares_reached(sample, "category", F.col("images"), plan, by="target_set")


#: What stands for "no entry is meant".
REVIEW = "REVIEW_REQUIRED"
# Parts of a plant; a label of nothing else names no class, as the task says.
PLANT_PARTS = (
    "leaf", "leaves", "fruit", "fruits", "pod", "pods", "stem", "stems", "root", "roots", "flower", "flowers", "seed", "seeds", "bark",
    "plant", "plants", "head", "heads", "tuber", "tubers", "grain", "grains", "crown", "collar", "sheath", "shoot", "shoots", "bud", "buds", "ear", "ears", "bulb", "bulbs",
    "branch", "branches", "twig", "twigs", "trunk", "stalk", "stalks", "boll", "bolls", "cob", "cobs", "panicle", "panicles", "petiole", "petioles", "canopy", "seedling", "seedlings",
)


def free_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The labels that still need an entry: ``table_name``, ``row_id``, ``label``."""
    sides = (("class_mapping", "mapping_id", "original_class"), ("class_taxonomy_review", "taxonomy_id", "raw_class"))
    filled = F.upper(F.regexp_replace("canonical_class", r"(?U)^\s+|\s+$", ""))
    open_rows = [
        table(spark, folder, name)
        .where(F.col("canonical_class").isNull() | filled.isin("", REVIEW))
        .select(F.lit(name).alias("table_name"), F.col(row_id).cast("bigint").alias("row_id"), F.col(label).alias("label"))
        for name, row_id, label in sides
    ]
    return open_rows[0].unionByName(open_rows[1]).where(F.col("label").rlike(r"(?U)\S"))


def crop_words(spark: SparkSession, folder: str) -> DataFrame:
    """``word``: the words of all crops that the two tables name."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"word": [w for c in b["crop"] for w in normalise(c).split()]}, dtype=str)

    crops = [table(spark, folder, name).select("crop") for name in ("class_mapping", "class_taxonomy_review")]
    found = crops[0].unionByName(crops[1]).select(F.lower(F.trim("crop")).alias("crop")).where("crop != ''").distinct()
    return found.mapInPandas(split, "word string").distinct()


def entry_names(spark: SparkSession, folder: str) -> DataFrame:
    listed = table(spark, folder, "canonical_classes")
    aliases = F.coalesce(F.split("aliases", r"\|"), F.array().cast("array<string>"))
    return listed.select(F.col("canonical_class").alias("entry"), F.explode(F.concat(F.array("canonical_class"), aliases)).alias("name"))


def filled_labels(spark: SparkSession, folder: str) -> DataFrame:
    """``table_name``, ``row_id``, ``label`` and its ``canonical_class`` or REVIEW_REQUIRED."""
    rows = free_labels(spark, folder)
    matches = match_values(rows, "label", entry_names(spark, folder), noise=crop_words(spark, folder), parts=PLANT_PARTS, tails=("leaf",))
    return fill(rows, "label", matches).select("table_name", "row_id", "label", F.coalesce("entry", F.lit(REVIEW)).alias("canonical_class"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return filled_labels(spark, folder).drop("label")


def p2_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Labels that mean no entry, and on how many rows each stands."""
    rows = filled_labels(spark, folder).where(F.col("canonical_class") == REVIEW)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("table_name").alias("tables"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = group_linked(image_links(spark, folder), "a", "b")
    return groups.select(F.col("item").alias("image"), F.col("group_item").alias("group_image"))


def reviewed_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per review_id, as delivered last: ``id``, ``path``, ``digest`` and the file's own ``split``."""
    rows = table(spark, folder, "duplicate_review").where(F.col("review_id").isNotNull())
    last = rows.groupBy("review_id").agg(F.max(F.struct("loaded_at", "file", "sha256", "group_id")).alias("last"))
    digest = F.lower(F.regexp_replace("last.sha256", r"^\s+|\s+$", ""))
    return last.select(
        F.col("review_id").alias("id"),
        image_path(F.col("last.file")).alias("path"),
        F.when(digest != "", digest).alias("digest"),
        own_split(F.col("last.file")).alias("split"),
        F.col("last.group_id").alias("group_id"),
    )


def class_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Images per class: the largest count of each dataset, split and class, added up."""
    rows = table(spark, folder, "class_inventory").where(F.col("class").isNotNull() & (F.col("image_count") >= 0))
    cells = rows.groupBy("dataset", F.lower("split").alias("split"), "class").agg(F.max("image_count").alias("images"))
    return cells.groupBy(F.col("class").alias("label")).agg(F.sum("images").alias("size"))


def split_shares(spark: SparkSession, folder: str) -> dict[str, float]:
    rows = table(spark, folder, "split_targets").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 splits")
    return {r["split"]: r["target_share"] for r in rows}


def file_splits(spark: SparkSession, folder: str) -> DataFrame:
    files = reviewed_files(spark, folder).select(F.col("id").alias("record"), label_folder(F.col("path")).alias("label"))
    edges = table(spark, folder, "duplicate_review").select(F.col("review_id").alias("record"), F.col("group_id").alias("entity"))
    return split_records(files, edges, split_shares(spark, folder), class_sizes(spark, folder))


def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    return file_splits(spark, folder).select(F.col("record").alias("review_id"), "component", F.col("label").alias("class"), "split")


def p4_components(spark: SparkSession, folder: str) -> DataFrame:
    """Files that ever were in a group, and the smallest file of all that belong together with it."""
    edges = table(spark, folder, "duplicate_review").select(F.col("review_id").alias("record"), F.col("group_id").alias("entity"))
    return propagate_labels(edges).select(F.col("record").alias("review_id"), F.col("label").alias("component"))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return spread_report(file_splits(spark, folder), split_shares(spark, folder), class_sizes(spark, folder)).withColumnRenamed("label", "class")


def overlaps(spark: SparkSession, folder: str) -> Overlaps:
    return find_overlaps(reviewed_files(spark, folder), image_links(spark, folder), own_split)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = expanded(overlaps(spark, folder))
    return found.select(F.least("train_id", "held_id").alias("review_id_a"), F.greatest("train_id", "held_id").alias("review_id_b")).distinct()


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping pairs per split and dataset of the held-out file, counted by classes."""
    found = overlaps(spark, folder)
    files = found.held.select("held_id", "split", dataset_folder(F.col("path")).alias("dataset"))
    return (
        overlap_counts(found)
        .join(files, "held_id")
        .groupBy("split", "dataset")
        .agg(F.sum("pairs").alias("pairs"), F.sum("exact").alias("exact_pairs"), F.sum("near").alias("near_pairs"), F.count(F.lit(1)).alias("held_out_files"))
    )


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    sized = token_lengths(table(spark, folder, "documents"), "text", ["doc_id"])
    kinds = table(spark, folder, "pack_limits").select("container", F.col("capacity_tokens").alias("capacity"))
    return pack(sized, "doc_id", "tokens", kinds)


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind: containers, tokens in them, room left, and the least number of containers that could do."""
    kinds = table(spark, folder, "pack_limits").select("container", "capacity_tokens")
    boxes = p6_containers(spark, folder).groupBy("container", "container_id").agg(F.sum("length").alias("tokens"), F.max("free").alias("free"))
    return (
        boxes.groupBy("container")
        .agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("free").alias("free"))
        .join(kinds, "container")
        .select("container", "containers", "tokens", "free", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"))
    )


def mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sized = token_lengths(table(spark, folder, "documents"), "text", ["doc_id", "source"])
    return mix(sized, "doc_id", "source", "tokens", table(spark, folder, "mix_targets"))


def p7_uses(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(spark, folder)[0]


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(spark, folder)[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return examine_texts(table(spark, folder, "documents"), "doc_id", "text").select("doc_id")


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    return examine_texts(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", F.col("restored").alias("text"), "complete")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_sample": p1_sample,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_unmatched": p2_unmatched,
    "p3_found": p3_found,
    "p4_splits": p4_splits,
    "p4_report": p4_report,
    "p4_components": p4_components,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_containers": p6_containers,
    "p6_report": p6_report,
    "p7_uses": p7_uses,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_restored": p8_restored,
}

#: The same files and links in SQL.
_PATH = "regexp_replace(replace({0}, chr(92), '/'), '^(\\./)+', '')"
_FILES = f"""
  parts as (select review_id, max_by({_PATH.format('file')}, loaded_at) path,
                   max_by(nullif(lower(trim(sha256, ' ' || chr(9) || chr(10) || chr(13))), ''), loaded_at) digest
            from duplicate_review group by review_id),
  cut as (select *, lower(split_part(path, '/', 4)) folder, length(path) - length(replace(path, '/', '')) slashes from parts),
  files as (select review_id, path, digest, split_part(path, '/', 3) dataset,
                   case when slashes < 4 then 'raw' when folder in ('val', 'validation') then 'validation'
                        when folder in ('train', 'test') then folder else 'raw' end split from cut),
  links as (select distinct {_PATH.format('image_a')} a, {_PATH.format('image_b')} b from near_duplicate_images
            where distance between 0 and 4 and image_a is not null and image_b is not null),
  near as (select a, b from links union select b, a from links),
  train as (select * from files where split = 'train'),
  held as (select * from files where split in ('validation', 'test')),
  found as (select t.review_id train_id, h.review_id held_id, 1 exact, 0 near from train t join held h on t.digest = h.digest
            union all
            select t.review_id, h.review_id, 0, 1 from near n join train t on t.path = n.a join held h on h.path = n.b),
  pairs as (select train_id, held_id, max(exact) exact, max(near) near from found group by all)
"""

_SAMPLE = """
  spelled as (select analysis_id, images, nullif(lower(trim(crop)), '') crop,
                     trim(regexp_replace(lower(list_last(string_split(class, '___'))), '[^a-z0-9]+', ' ', 'g')) name,
                     coalesce(trim(regexp_replace(lower(crop), '[^a-z0-9]+', ' ', 'g')), '') c,
                     (case when images >= 0 then images >= 100 else meets_100_image_threshold end)::varchar flag from class_analysis),
  cut as (select *, case when c = '' then name when starts_with(name, c || ' leaf ') then substr(name, length(c) + 7)
                         when starts_with(name, c || ' ') then substr(name, length(c) + 2)
                         when ends_with(name, ' ' || c) then left(name, length(name) - length(c) - 1) else name end bare from spelled),
  kept as (select analysis_id, images, unnest([{'s': 'by_class', 'c': nullif(replace(bare, ' ', '_'), '')}, {'s': 'by_crop', 'c': crop}, {'s': 'by_threshold', 'c': flag}]) k from cut),
  rows as (select k.s target_set, k.c category, analysis_id, images, ('0x' || substr(md5('|' || analysis_id), 1, 15))::bigint h from kept),
  targets as (select target_set, regexp_replace(lower(trim(category)), '[^a-z0-9]+', '_', 'g') category, target_share, min_rows from sample_targets),
  counted as (select t.*, (select count(*) from rows r where r.target_set = t.target_set and r.category = t.category) available from targets t),
  least as (select target_set, max(ceil(min_rows / target_share)) size from counted where available >= min_rows and target_share > 0 group by all),
  fifth as (select target_set, floor(0.2 * sum(available) + 0.5) size from counted group by all),
  sized as (select c.*, greatest(f.size, coalesce(l.size, 0)) size from counted c join fifth f using (target_set) left join least l using (target_set)),
  wanted as (select *, greatest(floor(target_share * size + 0.5)::bigint, min_rows) wanted from sized),
  ranked as (select r.*, w.wanted, row_number() over (partition by r.target_set, r.category order by h, analysis_id) rank from rows r join wanted w using (target_set, category)),
  sampled as (select * from ranked where rank <= wanted)
"""

#: SQL over the same tables, where SQL can say it on whole tables.
SQL: dict[str, str] = {
    "p1_sample": f"with {_SAMPLE} select target_set, category, analysis_id, images from sampled",
    "p1_report": f"""with {_SAMPLE},
  all_of as (select target_set, count(*) n, sum(case when images > 0 then images else 0 end) a from sampled group by all),
  cells as (select target_set, category, count(*) n, sum(case when images > 0 then images else 0 end) a from sampled group by all),
  told as (select w.target_set, w.category, w.target_share, w.min_rows, w.available, w.size, w.wanted, coalesce(c.n, 0) n,
                  coalesce(c.n / o.n, 0)::double share, coalesce(c.a / o.a, 0)::double amount_share
           from wanted w left join all_of o on o.target_set = w.target_set left join cells c on c.target_set = w.target_set and c.category = w.category),
  judged as (select *, n >= min_rows and share between target_share - 0.01 and target_share + 0.01 met from told)
  select target_set, category, target_share, min_rows, available, wanted, n::bigint sampled, (wanted - n)::bigint deficit, share, amount_share, met,
         case when met then null when n < wanted then 'supply' when min_rows > floor(target_share * size + 0.5) then 'minimum'
              when abs(wanted / size - target_share) > 0.01 then 'rounding' else 'others' end reason from judged""",
    "p3_found": f"""with recursive p as (select {_PATH.format('image_a')} a, {_PATH.format('image_b')} b from near_duplicate_images
      where distance between 0 and 4 and image_a is not null and image_b is not null),
  n as (select i, row_number() over (order by i) k from (select a i from p where a <> b union select b from p where a <> b)),
  d as (select x.k a, y.k b from p join n x on x.i = p.a join n y on y.i = p.b where p.a <> p.b),
  e as (select a, b from d union select b, a from d),
  low(k, r) as (select k, k from n union select e.b, low.r from low join e on e.a = low.k where low.r < e.b)
  select n.i image, m.i group_image from (select k, min(r) r from low group by k) g join n on n.k = g.k join n m on m.k = g.r""",
    "p4_components": """with recursive e as (select distinct review_id r, group_id g from duplicate_review where review_id is not null and group_id is not null),
  n as (select distinct a.r a, b.r b from (select r, g, min(r) over (partition by g) m from e) a join e b on b.r = a.m and b.g = a.g),
  d as (select a, b from n union select b, a from n),
  low(k, r) as (select r, r from e union select d.b, low.r from low join d on d.a = low.k where low.r < d.b)
  select k review_id, min(r) component from low group by k""",
    "p5_found": f"with {_FILES} select least(train_id, held_id) review_id_a, greatest(train_id, held_id) review_id_b from pairs",
    "p5_report": f"""with {_FILES} select h.split, h.dataset, count(*)::bigint pairs, sum(exact)::bigint exact_pairs, sum(near)::bigint near_pairs,
        count(distinct held_id)::bigint held_out_files from pairs join held h on h.review_id = pairs.held_id group by all""",
}
