"""Queries of the curation operators by name, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..functions import vocabulary as V
from ..functions.paths import image_path
from ..operators import audit, clean, duplicates, quality, stats, taxonomy
from ..operators.components import connected
from ..operators.skew import HOT_ROWS, hot_keys, lookup
from ..storage import stage, stage_counted
from .tables import SQL_FILES, SQL_PAIRS, files, pairs, sql_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- inventory


@query("""
  with d as (select doc_id, text, lang, n_chars,
      list_filter([case when text is null then 'no text' end], lambda x: x is not null) c,
      list_filter([case when trim(text) = '' then 'blank text' end, case when lang is null then 'no language' end, case when n_chars <> length(text) then 'length differs' end], lambda x: x is not null) w from documents)
  select doc_id, case when len(c) > 0 then 'corrupt' when len(w) > 0 then 'warning' else 'valid' end status,
         array_to_string(case when len(c) > 0 then c else w end, ' | ') message from d""")
def inventory_status(spark, folder):
    docs = table(spark, folder, "documents")
    checked = quality.validate(
        docs,
        {"no text": F.col("text").isNull()},
        {"blank text": F.trim("text") == "", "no language": F.col("lang").isNull(), "length differs": F.col("n_chars") != F.char_length("text")},
    )
    return checked.select("doc_id", "status", "message")


_COUNTERS = {"dataset": ["dataset"], "split": ["split"], "format": ["format"], "dataset_split": ["dataset", "split"], "dataset_split_label": ["dataset", "split", "label"]}


@query(f"""with {SQL_FILES}
  select 'dataset' counter, dataset "key", count(*) n from files where dataset is not null group by all
  union all select 'split', split, count(*) from files where split is not null group by all
  union all select 'format', format, count(*) from files where format is not null group by all
  union all select 'dataset_split', dataset || '::' || split, count(*) from files where dataset is not null and split is not null group by all
  union all select 'dataset_split_label', dataset || '::' || split || '::' || label, count(*) from files where dataset || split || label is not null group by all""")
def inventory_counters(spark, folder):
    return stats.counters(files(spark, folder), _COUNTERS)


@query("""select dataset, class, sum(image_count)::bigint images, contains(lower(class), 'healthy') or contains(lower(class), 'normal') healthy, sum(image_count) >= 100 meets_100_image_threshold
  from class_inventory group by all""")
def class_counts_threshold(spark, folder):
    rows = table(spark, folder, "class_inventory").groupBy("dataset", "class").agg(F.sum("image_count").alias("images"))
    return stats.with_threshold(rows.withColumn("healthy", C.is_healthy(F.col("class"))), "images")


@query("""select crop, sum(images)::bigint total_images, count(*) number_of_original_classes, coalesce(sum(images) filter (healthy), 0)::bigint healthy_images,
    coalesce(sum(images) filter (not coalesce(healthy, false)), 0)::bigint disease_images, min(images) minimum_class_images, max(images) maximum_class_images,
    count(*) filter (images >= 100) classes_with_enough_images from class_analysis group by crop""")
def crop_stats_two_level(spark, folder):
    return stats.crop_profile(table(spark, folder, "class_analysis"), "crop", "images", "healthy")


@query("""with c as (select crop, class, sum(images) images from class_analysis where class is not null group by all),
  t as (select crop, class || coalesce('=' || images::bigint::varchar, '') e from c)
  select crop, string_agg(e, '|' order by e) classes from t group by crop""")
def crop_class_map(spark, folder):
    sums = table(spark, folder, "class_analysis").groupBy("crop", "class").agg(F.sum("images").alias("images"))
    return stats.class_map(sums, "crop", "class", "images")


@query(f"""with {SQL_FILES} select width || 'x' || height as value, count(*) n from files where width > 0 and height > 0 group by all order by n desc, value limit 20""")
def top20_resolutions(spark, folder):
    known = files(spark, folder).where((F.col("width") > 0) & (F.col("height") > 0))
    return stats.top_k(known, F.concat_ws("x", F.col("width"), F.col("height")))


@query(f"""with {SQL_FILES} select dataset, split, label class, count(*) image_count from files group by all""")
def class_inventory_counts(spark, folder):
    return files(spark, folder).groupBy("dataset", "split", F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("image_count"))


@query("""select class, sum(image_count)::bigint images, count(*) "rows" from class_inventory where class is not null group by class order by images desc nulls last, class""")
def class_inventory_rollup(spark, folder):
    rows = table(spark, folder, "class_inventory").where("class is not null").groupBy("class").agg(F.sum("image_count").alias("images"), F.count(F.lit(1)).alias("rows"))
    return rows.orderBy(F.desc_nulls_last("images"), "class")


@query("""select unnest(['discounted', 'large', 'returned']) title, unnest([count(*) filter (l_discount > 0.05), count(*) filter (l_quantity >= 45), count(*) filter (l_returnflag = 'R')]) n from lineitem""")
def predicate_report(spark, folder):
    tests = {"discounted": F.col("l_discount") > 0.05, "large": F.col("l_quantity") >= 45, "returned": F.col("l_returnflag") == "R"}
    return stats.predicate_report(table(spark, folder, "lineitem"), tests)


# ---------------------------------------------------------------- exact duplicates


@query(f"""with {SQL_FILES}, g as (select digest, count(*) group_size, min(file) first_item, count(*) - 1 redundant_files from files where digest is not null group by digest having count(*) > 1)
  select row_number() over (order by digest) group_id, * from g""")
def exact_dup_groups_numbered(spark, folder):
    groups = duplicates.duplicate_groups(files(spark, folder), "digest", "file")
    return duplicates.number_groups(groups, F.col("digest"))


@query(f"""with {SQL_FILES}, g as (select digest, count(*) n from files where digest is not null group by digest)
  select count(*) unique_digests, count(*) filter (n > 1) "groups", coalesce(sum(n) filter (n > 1), 0)::bigint files_in_groups, coalesce(sum(n - 1) filter (n > 1), 0)::bigint redundant_files from g""")
def exact_dup_totals(spark, folder):
    return duplicates.duplicate_totals(files(spark, folder), "digest")


_SQL_PROFILE = """
  profile as (select digest, count(*) group_size, count(*) - 1 redundant_files, coalesce(string_agg(distinct dataset, '|' order by dataset), '') datasets,
      coalesce(string_agg(distinct split, '|' order by split), '') splits, coalesce(string_agg(distinct label, '|' order by label), '') as labels,
      case when count(distinct case when split <> 'raw' then split end) > 1 then 'YES' else 'NO' end split_leakage, case when count(distinct label) > 1 then 'YES' else 'NO' end label_conflict,
      case when count(distinct dataset) > 1 then 'YES' else 'NO' end cross_dataset,
      case when bool_or(split = 'train') and bool_or(split = 'test') then 'YES' else 'NO' end train_and_test
      from files where digest is not null group by digest having count(*) > 1)"""


@query(f"""with {SQL_FILES}, {_SQL_PROFILE} select row_number() over (order by group_size desc, digest) group_id, * from profile""")
def exact_dup_group_profile(spark, folder):
    profile = duplicates.group_profile(files(spark, folder), "digest")
    return duplicates.number_groups(profile, F.desc("group_size"), F.col("digest"))


@query(f"""with {SQL_FILES}, {_SQL_PROFILE} select count(*) "groups", count(*) filter (split_leakage = 'YES') split_leakage, count(*) filter (label_conflict = 'YES') label_conflict,
  count(*) filter (cross_dataset = 'YES') cross_dataset, count(*) filter (train_and_test = 'YES') train_and_test from profile""")
def split_leakage_groups(spark, folder):
    flags = ("split_leakage", "label_conflict", "cross_dataset", "train_and_test")
    return duplicates.group_profile(files(spark, folder), "digest").agg(F.count(F.lit(1)).alias("groups"), *[F.count_if(F.col(c) == "YES").alias(c) for c in flags])


@query(f"""with {SQL_FILES}, {_SQL_PROFILE} select f.review_id, digest, f.file, f.width, f.height, f.format, f.size_bytes, split_leakage, label_conflict
  from profile join files f using (digest) where split_leakage = 'YES' or label_conflict = 'YES'""")
def suspicious_group_review(spark, folder):
    all_files = files(spark, folder)
    flagged = duplicates.group_profile(all_files, "digest").where("split_leakage = 'YES' or label_conflict = 'YES'").select("digest", "split_leakage", "label_conflict")
    return all_files.join(flagged, "digest").select("review_id", "digest", "file", "width", "height", "format", "size_bytes", "split_leakage", "label_conflict")


@query("""select review_id, s.label, count(*) n from (select review_id, unnest(string_split(labels, '|')) as label from duplicate_review where labels is not null) s where trim(s.label) <> '' group by all""")
def group_labels_exploded(spark, folder):
    listed = table(spark, folder, "duplicate_review").select("review_id", F.explode(T.split_list(F.col("labels"), "|")).alias("label"))
    return stats.count_by(listed, "review_id", "label")


# ---------------------------------------------------------------- near duplicates


def _images(spark, folder):
    p = pairs(spark, folder)
    both = F.array(F.struct(F.col("image_a").alias("image"), F.col("hash_a").alias("hash")), F.struct(F.col("image_b").alias("image"), F.col("hash_b").alias("hash")))
    seen = p.select(F.inline(both)).where("image is not null and hash is not null")
    return seen.groupBy("image").agg(F.min("hash").alias("hash"))


_SQL_IMAGES = f"""{SQL_PAIRS},
  images as (select image, min(hash) hash from (select image_a image, hash_a hash from pairs union all select image_b, hash_b from pairs) where image is not null and hash is not null group by image)"""
_SQL_HEX = "('0x' || substr({0}, {1}, 8))::bigint"
_SQL_HAMMING = f"(bit_count(xor({_SQL_HEX.format('{0}', 1)}, {_SQL_HEX.format('{1}', 1)})) + bit_count(xor({_SQL_HEX.format('{0}', 9)}, {_SQL_HEX.format('{1}', 9)})))::int"


@query(f"""with {_SQL_IMAGES}, v as (select hash, min(image) item from images group by hash)
  select {_SQL_HAMMING.format("a.hash", "b.hash")} distance, a.item item_a, b.item item_b from v a join v b on substr(a.hash, 1, 8) = substr(b.hash, 1, 8) and a.item < b.item
  where {_SQL_HAMMING.format("a.hash", "b.hash")} <= 4 and a.hash <> b.hash""")
def near_dup_pairs_bucketed(spark, folder):
    return duplicates.near_pairs(_images(spark, folder), "image", "hash")


@query(f"""with {_SQL_IMAGES}, v as (select hash, min(image) representative, count(*) copies from images group by hash) select image item, representative, copies from images join v using (hash)""")
def near_dup_copies(spark, folder):
    return duplicates.copies(_images(spark, folder), "image", "hash")


@query(f"""with {SQL_PAIRS} select distance, {_SQL_HAMMING.format("hash_a", "hash_b")} counted, count(*) n from pairs where hash_b is not null and hash_a is not null group by all""")
def hamming_recount(spark, folder):
    known = pairs(spark, folder).where("hash_a is not null and hash_b is not null")
    return stats.count_by(known.select("distance", T.hamming(F.col("hash_a"), F.col("hash_b")).alias("counted")), "distance", "counted")


@query("select distance, count(*) n from near_duplicate_images group by distance")
def near_dup_distance_histogram(spark, folder):
    return duplicates.distance_histogram(table(spark, folder, "near_duplicate_images"))


@query(f"with {SQL_PAIRS} select count(*) items from (select image_a i from pairs union select image_b from pairs) where i is not null")
def near_dup_unique_items(spark, folder):
    return duplicates.endpoints(pairs(spark, folder), "image_a", "image_b").agg(F.count(F.lit(1)).alias("items"))


_SQL_DATASET = "string_split({0}, '/')[3]"


@query(f"""with {SQL_PAIRS}, x as (select {_SQL_DATASET.format("image_a")} a, {_SQL_DATASET.format("image_b")} b from pairs),
  y as (select a v from x union all select b from x where a is distinct from b) select v as value, count(*) pairs from y where v is not null group by v""")
def near_dup_involvement(spark, folder):
    d = lambda c: F.get(F.split(F.col(c), "/"), F.lit(2))
    return duplicates.involvement(pairs(spark, folder), d("image_a"), d("image_b"))


@query(f"""with {SQL_PAIRS} select {_SQL_DATASET.format("image_a")} || ' <-> ' || {_SQL_DATASET.format("image_b")} relationship, count(*) pairs from pairs where distance = 0 and image_a is not null and image_b is not null group by all""")
def near_dup_relationships(spark, folder):
    d = lambda c: F.get(F.split(F.col(c), "/"), F.lit(2))
    return duplicates.relationships(pairs(spark, folder).where("distance = 0"), d("image_a"), d("image_b"))


_SQL_CROP = "case when list_position(string_split({0}, '/'), 'raw') > 0 then coalesce(string_split({0}, '/')[list_position(string_split({0}, '/'), 'raw') + 1], 'unknown') else 'unknown' end"


@query(f"""with {SQL_PAIRS} select pair_id, distance, {_SQL_DATASET.format("image_a")} dataset_a, {_SQL_DATASET.format("image_b")} dataset_b,
  {_SQL_CROP.format("image_a")} crop_a, {_SQL_CROP.format("image_b")} crop_b,
  case when distance = 0 then 'HIGH' when distance <= 2 then 'MEDIUM' else 'LOW' end review_priority from pairs""")
def near_dup_priority(spark, folder):
    d = lambda c: F.get(F.split(F.col(c), "/"), F.lit(2))
    crop = lambda c: C.crop_after_root(F.col(c))
    return pairs(spark, folder).select(
        "pair_id", "distance", d("image_a").alias("dataset_a"), d("image_b").alias("dataset_b"), crop("image_a").alias("crop_a"), crop("image_b").alias("crop_b"),
        C.review_priority(F.col("distance")).alias("review_priority"),
    )


@query(f"""with {SQL_FILES}, {SQL_PAIRS}, k as (select file, min(digest) digest from files group by file)
  select pair_id, image_a, image_b, a.digest sha256_a, b.digest sha256_b, case when coalesce(a.digest = b.digest, false) then 'YES' else 'NO' end exact_duplicate
  from pairs left join k a on a.file = image_a left join k b on b.file = image_b where distance = 0""")
def near_dup_verified(spark, folder):
    return duplicates.verify_pairs(pairs(spark, folder), files(spark, folder), "file", "digest").select("pair_id", "image_a", "image_b", "sha256_a", "sha256_b", "exact_duplicate")


@query(f"""with {SQL_FILES}, {SQL_PAIRS}, k as (select file, min(digest) digest from files group by file),
  v as (select coalesce(a.digest = b.digest, false) e from pairs left join k a on a.file = image_a left join k b on b.file = image_b where distance = 0)
  select count(*) filter (e) exact, count(*) filter (not e) perceptual_only from v""")
def near_dup_exact_split(spark, folder):
    verified = duplicates.verify_pairs(pairs(spark, folder), files(spark, folder), "file", "digest")
    return verified.agg(F.count_if(F.col("exact_duplicate") == "YES").alias("exact"), F.count_if(F.col("exact_duplicate") == "NO").alias("perceptual_only"))


def _sql_split(path: str, order) -> str:
    cases = " ".join(f"when list_contains(p, '{folder}') then '{name}'" for folder, name in order)
    return f"(select case {cases} else '{'RAW' if order is C.REVIEW else 'raw'}' end from (select list_transform(string_split({path}, '/'), lambda x: lower(x)) p))"


@query(f"""with {SQL_PAIRS}, s as (select pair_id, distance, {_sql_split("image_a", C.TEST_FIRST)} a, {_sql_split("image_b", C.TEST_FIRST)} b, image_b from pairs where image_a is not null and image_b is not null)
  select pair_id, a split_a, b split_b from s where distance = 0 and ((a = 'train' and b = 'test') or (a = 'test' and b = 'train'))""")
def near_dup_cross_type_pairs(spark, folder):
    a, b = C.split_of(F.col("image_a"), C.TEST_FIRST), C.split_of(F.col("image_b"), C.TEST_FIRST)
    across = pairs(spark, folder).where("distance = 0 and image_a is not null and image_b is not null").select("pair_id", a.alias("split_a"), b.alias("split_b"))
    return across.where("(split_a = 'train' and split_b = 'test') or (split_a = 'test' and split_b = 'train')")


@query(f"""with {SQL_PAIRS} select distance, image_a, image_b, pair_id from pairs order by distance nulls first, image_a nulls first, image_b nulls first, pair_id limit 20""")
def preview_limit20(spark, folder):
    return pairs(spark, folder).select("distance", "image_a", "image_b", "pair_id").orderBy("distance", "image_a", "image_b", "pair_id").limit(20)


@query(f"""with recursive {SQL_PAIRS}, e as (select distinct image_a a, image_b b from pairs where distance = 0 and image_a <> image_b union select distinct image_b, image_a from pairs where distance = 0 and image_a <> image_b),
  reach as (select a, b from e union select r.a, e.b from reach r join e on r.b = e.a)
  select a item, least(a, min(b)) root from reach group by a""")
def connected_components(spark, folder):
    return connected(pairs(spark, folder).where("distance = 0"), "image_a", "image_b")


# ---------------------------------------------------------------- audit and cleaning


def _members(spark, folder):
    """The files staged, those of duplicate groups with what holds for their group, and the hot digests."""
    all_files, rows = stage_counted(files(spark, folder), "files")
    hot = hot_keys(all_files, "digest", rows) if rows >= HOT_ROWS else []
    grouped = duplicates.group_profile(all_files, "digest").select("digest", "split_leakage", "label_conflict", "train_and_test")
    return all_files, lookup(all_files, grouped, "digest", hot), hot


def _decisions(members, hot):
    return audit.keep_first(members, "digest", "file", F.col("label_conflict") == "YES", F.col("train_and_test") == "YES", F.col("split") == "test", hot)


def _decided(spark, folder):
    _, members, hot = _members(spark, folder)
    return _decisions(members, hot)


_SQL_DECIDED = f"""{SQL_FILES}, {_SQL_PROFILE},
  members as (select f.*, p.label_conflict, p.train_and_test from files f join profile p using (digest)),
  ordered as (select *, first_value(file) over (partition by digest order by case when train_and_test = 'YES' and split = 'test' then 0 else 1 end, file) keep from members),
  decided as (select digest, file, case when label_conflict = 'YES' then 'EXCLUDE_ALL' when file = keep then 'KEEP' else 'EXCLUDE' end decision,
      case when label_conflict = 'YES' then '' else keep end keep_item,
      case when label_conflict = 'YES' then 'label conflict' when train_and_test = 'YES' then 'split leakage' else 'exact duplicate' end reason from ordered)"""


@query(f"with {_SQL_DECIDED} select * from decided")
def audit_decisions(spark, folder):
    return _decided(spark, folder).select("digest", "file", "decision", "keep_item", "reason")


@query(f"""with {_SQL_DECIDED} select count(distinct digest) "groups", count(*) files, count(*) filter (decision = 'KEEP') kept, count(*) filter (decision <> 'KEEP') excluded,
  count(distinct digest) filter (decision = 'EXCLUDE_ALL') conflict_groups, count(distinct digest) filter (reason = 'split leakage') leakage_groups from decided""")
def audit_summary(spark, folder):
    return audit.audit_totals(_decided(spark, folder), "digest")


@query(f"""with {_SQL_DECIDED} select digest, string_agg(distinct decision, '|' order by decision) decisions from decided group by digest having bool_or(decision = 'EXCLUDE_ALL')""")
def audit_exclude_all_groups(spark, folder):
    return audit.group_decisions(_decided(spark, folder), "digest", "EXCLUDE_ALL")


@query(f"""with {_SQL_DECIDED} select digest, count(*) filter (split = 'train') train, count(*) filter (split = 'test') test from members where train_and_test = 'YES'
  group by digest having count(*) filter (split = 'train') <> 1 or count(*) filter (split = 'test') <> 1""")
def audit_broken_pairs(spark, folder):
    _, members, _ = _members(spark, folder)
    return audit.broken_pairs(members, "digest", "split", F.col("train_and_test") == "YES")


@query(f"with {_SQL_DECIDED} select file from files where file not in (select file from decided where decision in ('EXCLUDE', 'EXCLUDE_ALL'))")
def clean_manifest(spark, folder):
    all_files, members, hot = _members(spark, folder)
    return clean.manifest(all_files, clean.excluded(_decisions(members, hot)), "file").select("file")


@query(f"""with {_SQL_DECIDED}, o as (select distinct file from decided where decision <> 'KEEP') select count(*) scanned, count(*) filter (o.file is null) copied, count(*) filter (o.file is not null) excluded, true adds_up
  from files f left join o on o.file = f.file""")
def clean_log_totals(spark, folder):
    all_files, members, hot = _members(spark, folder)
    return clean.log_totals(clean.action_log(all_files, clean.excluded(_decisions(members, hot)), "file"))


@query(f"""with {SQL_FILES}, {SQL_PAIRS} select distinct image_b file from pairs where distance = 0 and image_b is not null and image_b not in (select file from files where file is not null)""")
def missing_exclusions(spark, folder):
    listed = pairs(spark, folder).where("distance = 0 and image_b is not null").select(F.col("image_b").alias("file"))
    return clean.missing(listed, files(spark, folder), "file")


@query(f"""with {SQL_FILES}, {SQL_PAIRS} select distinct 'datasets/clean/' || substr(image_b, 14) file from pairs where distance = 0 and starts_with(image_b, 'datasets/raw/') and image_b in (select file from files)""")
def surviving_exclusions(spark, folder):
    to = lambda c: C.moved(F.col(c), "datasets/raw/", "datasets/clean/").alias("file")
    cleaned = files(spark, folder).select(to("file")).where("file is not null")
    listed = pairs(spark, folder).where("distance = 0").select(to("image_b")).where("file is not null")
    return clean.surviving(listed, cleaned, "file")


@query(f"""with {_SQL_DECIDED}, {SQL_PAIRS}, listed as (select distinct image_b file from pairs where distance = 0 and image_b is not null),
  cleaned as (select * from files where file not in (select file from decided where decision <> 'KEEP')),
  left_over as (select digest, count(*) n, bool_or(split = 'train') and bool_or(split = 'test') leak from cleaned where digest is not null group by digest having count(*) > 1),
  n as (select (select count(*) from cleaned) total, (select count(*) from cleaned where digest is null) corrupt, (select count(*) from left_over) "groups", (select coalesce(sum(n), 0) from left_over) "files",
    (select count(*) from left_over where leak) leakage, (select count(*) from listed where file in (select file from cleaned)) still)
  select unnest(['total_images', 'corrupt_images', 'exact_duplicate_groups', 'exact_duplicate_files', 'train_test_duplicate_groups', 'audit_exclusions_still_present', 'validation_status']) metric,
         unnest([total::varchar, corrupt::varchar, "groups"::varchar, "files"::bigint::varchar, leakage::varchar, still::varchar, case when corrupt = 0 and leakage = 0 and still = 0 then 'PASS' else 'FAIL' end]) as value from n""")
def final_gate_metrics(spark, folder):
    all_files, members, hot = _members(spark, folder)
    cleaned = stage(clean.manifest(all_files, clean.excluded(_decisions(members, hot)), "file"), "cleaned")
    listed = pairs(spark, folder).where("distance = 0 and image_b is not null").select(F.col("image_b").alias("file"))
    return quality.final_gate(cleaned, F.col("digest").isNull(), "digest", clean.surviving(listed, cleaned, "file"))


@query("""select doc_id, sha256(coalesce(text, '')) sha256, octet_length(encode(coalesce(text, ''))) length from documents""")
def content_digests(spark, folder):
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return table(spark, folder, "documents").select("doc_id", T.digest(data).alias("sha256"), F.octet_length(data).cast("bigint").alias("length"))


# ---------------------------------------------------------------- paths and labels


@query(f"""with f as (select review_id, {sql_path("file")} file from duplicate_review), p as (select *, list_filter(string_split(file, '/'), lambda x: x <> '') p from f)
  select review_id, file, len(p) depth, p[-2] as label, lower(regexp_extract(file, '[^/.](\\.[^./]+)$', 1)) suffix from p where file is not null""")
def path_parts(spark, folder):
    f = image_path(F.col("file"))
    return table(spark, folder, "duplicate_review").where("file is not null").select("review_id", f.alias("file"), F.size(T.parts(f)).cast("bigint").alias("depth"), C.parent_folder(f).alias("label"), T.suffix(f).alias("suffix"))


@query(f"""with f as (select review_id, {sql_path("file")} file from duplicate_review where file is not null)
  select review_id, {_sql_split("file", C.TRAIN_FIRST)} train_first, {_sql_split("file", C.TEST_FIRST)} test_first, {_sql_split("file", C.TRAIN_TEST)} train_test, {_sql_split("file", C.REVIEW)} review from f""")
def path_split_variants(spark, folder):
    f = F.col("file")
    return table(spark, folder, "duplicate_review").where("file is not null").select(
        "review_id", C.split_of(f, C.TRAIN_FIRST).alias("train_first"), C.split_of(f, C.TEST_FIRST).alias("test_first"), C.split_of(f, C.TRAIN_TEST).alias("train_test"),
        C.split_of(f, C.REVIEW, "RAW").alias("review"),
    )


_DATASETS = {"canopyone": "CanopyOne", "dryfieldset": "DryfieldSet", "leaflantern": "LeafLantern", "monsoonplots": "MonsoonPlots", "terracescan": "TerraceScan", "acreleaf": "AcreLeaf"}
_SQL_KNOWN = "[" + ", ".join(f"'{k}'" for k in _DATASETS) + "]"
_SQL_NAME = "case {0} " + " ".join(f"when '{k}' then '{v}'" for k, v in _DATASETS.items()) + " end"
_SQL_PRIORITY = "case " + " ".join(f"when list_contains(l, '{k}') then '{v}'" for k, v in _DATASETS.items()) + " else 'Unknown' end"
_SQL_WORDS = "case " + " ".join(f"when contains(lower(file), '{k}') then '{v}'" for k, v in _DATASETS.items()) + " else 'other' end"


@query(f"""with f as (select review_id, {sql_path("file")} file from duplicate_review where file is not null),
  p as (select *, string_split(file, '/') p from f), l as (select *, list_transform(p, lambda x: lower(x)) l from p),
  d as (select *, list_filter(l, lambda x: list_contains({_SQL_KNOWN}, x))[1] d from l),
  a as (select *, list_position(l, d) a from d),
  s as (select *, a + 1 + case when d = 'canopyone' and l[a + 1] in ('train', 'test', 'validation', 'val') then 1 when d <> 'canopyone' and l[a + 1] in ('augmentedset', 'originalset') then 1 else 0 end s from a)
  select review_id, coalesce({_SQL_NAME.format("d")}, 'Unknown') leftmost, {_SQL_PRIORITY} priority, {_SQL_WORDS} substring,
    case when list_contains({list(_DATASETS.values())}, p[3]) then p[3] else 'unknown' end source, coalesce(p[3], 'unknown') crop,
    case when l[3] in ('canopyone') and p[4] is not null then p[4] when list_contains({_SQL_KNOWN}, l[3]) then p[3] else 'Unknown' end crop_below,
    case when list_contains(l, 'augmentedset') then 'Augmented' when list_contains(l, 'originalset') then 'Original' else 'Main' end subset,
    case when d is not null and s < len(p) then p[s] else 'Unknown' end as label from s""")
def path_dataset_variants(spark, folder):
    f = image_path(F.col("file"))
    return table(spark, folder, "duplicate_review").where("file is not null").select(
        "review_id", C.dataset_leftmost(f, _DATASETS).alias("leftmost"), C.dataset_by_priority(f, _DATASETS).alias("priority"), C.dataset_by_substring(f, [*_DATASETS.items()]).alias("substring"),
        C.source_after_root(f, _DATASETS.values()).alias("source"), C.crop_after_root(f).alias("crop"), C.crop_below_dataset(f, _DATASETS, ["canopyone"]).alias("crop_below"),
        C.subset_of(f).alias("subset"), C.label_folder_structural(f, _DATASETS, ["canopyone"]).alias("label"),
    )


_SQL_WS = "\\s\\x0b\\x1c-\\x1f\\x85\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_SQL_LOOSE = f"regexp_replace(replace(replace(lower({{0}}), '_', ' '), '-', ' '), '^[{_SQL_WS}]+|[{_SQL_WS}]+$', '', 'g')"
_SQL_LABEL = f"regexp_replace(regexp_replace(replace(replace(lower({{0}}), '_', ' '), '-', ' '), '[{_SQL_WS}]+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"select mapping_id, {_SQL_LOOSE.replace('{0}', 'original_class')} loose, {_SQL_LABEL.replace('{0}', 'original_class')} as label from class_mapping")
def label_normalize(spark, folder):
    c = F.col("original_class")
    return table(spark, folder, "class_mapping").select("mapping_id", T.normalize_loose(c).alias("loose"), T.normalize_label(c).alias("label"))


_SQL_RULES = (
    "case when contains(n, 'healthy') or contains(n, 'normal') then 'healthy' "
    + " ".join(f"when n = '{k}' then '{v}'" for k, v in V.WHOLE_LABELS.items())
    + " "
    + " ".join(f"when contains(n, '{w}') then '{c}'" for c, ws in V.DISEASE_WORDS.items() for w in ws)
    + " else 'REVIEW_REQUIRED' end"
)
_SQL_RULED = f"n as (select mapping_id, original_class, {_SQL_LABEL.replace('{0}', 'original_class')} n from class_mapping where original_class is not null), r as (select mapping_id, original_class, {_SQL_RULES} canonical from n)"


@query(f"with {_SQL_RULED} select mapping_id, canonical, case canonical when 'healthy' then 'healthy' when 'REVIEW_REQUIRED' then 'unknown' else 'disease' end as type from r")
def rule_mapping_first_match(spark, folder):
    rows = table(spark, folder, "class_mapping").where("original_class is not null").select("mapping_id", C.canonical_label(F.col("original_class")).alias("r"))
    return rows.select("mapping_id", F.col("r.canonical_class").alias("canonical"), F.col("r.type").alias("type"))


@query(f"with {_SQL_RULED} select count(*) filter (canonical = 'REVIEW_REQUIRED') review, count(*) filter (canonical not in ('REVIEW_REQUIRED', 'healthy')) disease, count(*) filter (canonical = 'healthy') healthy from r")
def rule_mapping_stats(spark, folder):
    rows = rule_mapping_first_match(spark, folder)
    return rows.agg(*[F.count_if(F.col("type") == kind).alias(name) for name, kind in (("review", "unknown"), ("disease", "disease"), ("healthy", "healthy"))])


@query(f"""with rules as (select canonical_id priority, replace(canonical_class, '_', ' ') needle, canonical_class v from canonical_classes),
  l as (select distinct {_SQL_LABEL.replace("{0}", "original_class")} as label from class_mapping where original_class is not null)
  select l.label, min_by(v, priority) as value from l left join rules on contains(l.label, needle) group by l.label""")
def rule_table_first_match(spark, folder):
    rules = table(spark, folder, "canonical_classes").select(F.col("canonical_id").alias("priority"), F.replace("canonical_class", F.lit("_"), F.lit(" ")).alias("needle"), F.col("canonical_class").alias("value"))
    labels = table(spark, folder, "class_mapping").select(T.normalize_label(F.col("original_class")).alias("label"))
    return taxonomy.first_rule(labels, "label", rules)


_ALIASES = ["bell pepper", *[a for a in sorted(V.CROP_ALIASES, key=lambda a: -len(a)) if a != "bell pepper"]]
_SQL_ALIAS = "case " + " ".join(f"when contains(n, '{a}') then '{V.CROP_ALIASES[a]}'" for a in _ALIASES) + " else 'unknown' end"


@query(f"select taxonomy_id, {_SQL_ALIAS} crop from (select taxonomy_id, {_SQL_LOOSE.replace('{0}', 'raw_class')} n from class_taxonomy_review where raw_class is not null)")
def alias_longest_match(spark, folder):
    return table(spark, folder, "class_taxonomy_review").where("raw_class is not null").select("taxonomy_id", C.crop_of_label(F.col("raw_class")).alias("crop"))


@query(f"""select taxonomy_id, case when dataset = 'AcreLeaf' then 'acreleaf' when dataset in ('CanopyOne', 'DryfieldSet') then {_SQL_ALIAS} else 'unknown' end crop
  from (select taxonomy_id, dataset, {_SQL_LOOSE.replace('{0}', 'raw_class')} n from class_taxonomy_review)""")
def crop_of_source(spark, folder):
    rows = table(spark, folder, "class_taxonomy_review")
    return rows.select("taxonomy_id", C.crop_of(F.col("dataset"), F.col("raw_class"), ["AcreLeaf"], ["CanopyOne", "DryfieldSet"]).alias("crop"))


@query("select distinct source, crop, original_class from class_mapping order by source nulls first, crop nulls first, original_class nulls first")
def distinct_labels(spark, folder):
    return table(spark, folder, "class_mapping").select("source", "crop", "original_class").distinct().orderBy("source", "crop", "original_class")


# ---------------------------------------------------------------- taxonomy


@query("""select taxonomy_id, dataset, t.canonical_class, case when dataset = 'CanopyOne' then c.category else t.category end category
  from class_taxonomy_review t left join canonical_classes c on dataset = 'CanopyOne' and t.canonical_class = c.canonical_class""")
def taxonomy_lookup_override(spark, folder):
    """Rows of the dataset without an entry get null here; ``strict``, as the operator is by default, raises for them."""
    rows = table(spark, folder, "class_taxonomy_review").select("taxonomy_id", "dataset", "canonical_class", "category")
    entries = table(spark, folder, "canonical_classes").select("canonical_class", "category")
    return taxonomy.lookup_where(rows, F.col("dataset") == "CanopyOne", "canonical_class", entries, ["category"], strict=False)


@query("""with fixes as (select dataset, raw_class, max(canonical_class) canonical_class, max(category) category from class_taxonomy_review
    where dataset is not null and raw_class is not null and decision = 'include' group by all)
  select taxonomy_id, t.dataset, t.raw_class, coalesce(f.canonical_class, t.canonical_class) canonical_class, coalesce(f.category, t.category) category
  from class_taxonomy_review t left join fixes f on t.dataset = f.dataset and t.raw_class = f.raw_class""")
def taxonomy_overlay_fix(spark, folder):
    rows = table(spark, folder, "class_taxonomy_review").select("taxonomy_id", "dataset", "raw_class", "canonical_class", "category", "decision")
    checked = rows.where("dataset is not null and raw_class is not null and decision = 'include'")
    fixes = checked.groupBy("dataset", "raw_class").agg(F.max("canonical_class").alias("canonical_class"), F.max("category").alias("category"))
    return taxonomy.overlay(rows.drop("decision"), fixes, ["dataset", "raw_class"], ["canonical_class", "category"])


@query("""select canonical_class, count(distinct raw_class) sources, string_agg(distinct raw_class, '|' order by raw_class) members from class_taxonomy_review
  where canonical_class is not null and raw_class is not null group by canonical_class having count(distinct raw_class) > 1""")
def taxonomy_fan_in(spark, folder):
    return taxonomy.fan_in(table(spark, folder, "class_taxonomy_review"), "canonical_class", "raw_class")


@query("""select crop, coalesce(string_agg(distinct canonical_class, '|' order by canonical_class), '') "values", count(distinct canonical_class) n from class_taxonomy_review group by crop""")
def taxonomy_classes_per_crop(spark, folder):
    return taxonomy.values_per(table(spark, folder, "class_taxonomy_review"), "crop", "canonical_class")


@query("""select 'category' field, coalesce(nullif(category, ''), '<EMPTY>') as value, count(*) n from class_taxonomy_review group by all
  union all select 'decision', coalesce(nullif(decision, ''), '<EMPTY>'), count(*) from class_taxonomy_review group by all""")
def taxonomy_value_counts(spark, folder):
    return taxonomy.value_counts(table(spark, folder, "class_taxonomy_review"), "category", "decision")


@query("""select taxonomy_id, dataset, raw_class, coalesce(nullif(canonical_class, ''), '<EMPTY>') canonical from class_taxonomy_review
  where canonical_class in ('healthy', '') or lower(crop) = 'lime' or dataset = 'LeafLantern'""")
def taxonomy_anomalies(spark, folder):
    found = F.col("canonical_class").isin("healthy", "") | (F.lower("crop") == "lime") | (F.col("dataset") == "LeafLantern")
    shown = F.coalesce(F.when(F.col("canonical_class") != "", F.col("canonical_class")), F.lit("<EMPTY>"))
    return table(spark, folder, "class_taxonomy_review").where(found).select("taxonomy_id", "dataset", "raw_class", shown.alias("canonical"))


@query("""with k as (select concat_ws('::', o_orderstatus, o_orderpriority) k from orders) select split_part(k, '::', 1) status, substr(k, strpos(k, '::') + 2) priority, count(*) n from k group by all""")
def composite_key_roundtrip(spark, folder):
    status, priority = T.split_pair(F.col("key"))
    keyed = table(spark, folder, "orders").select(T.pair_key(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("key"))
    return stats.count_by(keyed.select(status.alias("status"), priority.alias("priority")), "status", "priority")
