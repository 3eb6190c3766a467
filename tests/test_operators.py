from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sievework.functions.text import hamming
from sievework.operators import audit, clean, duplicates, quality, stats, taxonomy
from sievework.operators.components import connected
from sievework.operators.skew import bits_for, hot_keys, lookup, ranked, salted_join


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("bits", [0, 1, 5])
def test_ranked(spark, bits):
    rng = random.Random(bits)
    data = [(rng.choice(["a", None, "b"]), i, rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(data, "g string, i bigint, w bigint").withColumn("h", F.xxhash64("i"))
    got = ranked(df, ["g"], "h", bits, ties=["i"], weight=F.col("w")).collect()
    assert len(got) == 300
    for g in ("a", "b", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: (r["h"] % 2**64, r["i"]))
        before = 0
        for n, r in enumerate(own, 1):
            assert (r["rank"], r["before"]) == (n, before)
            before += r["w"]


def test_ranked_ties_and_empty(spark):
    same = spark.createDataFrame([(1, i) for i in range(5)], "g int, i int").withColumn("h", F.lit(7).cast("bigint"))
    assert sorted(r["rank"] for r in ranked(same, ["g"], "h", 3, ties=["i"]).collect()) == [1, 2, 3, 4, 5]
    assert ranked(same.where("i > 9"), ["g"], "h", 3).count() == 0
    assert bits_for(0) == 0 and bits_for(10**12) > 20


def test_hot_lookup(spark):
    left = spark.createDataFrame([("x", i) for i in range(50)] + [("y", 1), (None, 2)], "k string, i int")
    right = spark.createDataFrame([("x", 1), ("z", 2)], "k string, v int")
    hot = hot_keys(left, "k", 52, least=10)
    assert hot == ["x"]
    assert lookup(left, right, "k", hot, "left").count() == 52
    assert rows_of(lookup(left, right, "k", hot)) == rows_of(left.join(right, "k"))


def test_salted_join(spark):
    left = spark.createDataFrame([("x", i) for i in range(40)] + [("y", 1), (None, 2)], "k string, i int")
    right = spark.createDataFrame([("x", v) for v in range(5)] + [("y", 9), (None, 3)], "k string, v int")
    want = rows_of(left.join(right, "k"))
    assert len(want) == 201 and rows_of(salted_join(left, right, "k", ["x"], "i", 7).select("k", "i", "v")) == want == rows_of(salted_join(left, right, "k", [], "i"))


def test_counters_and_top(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "x"), ("b", "y")], "p string, q string")
    got = {(r["counter"], r["key"]): r["n"] for r in stats.counters(df, {"p": ["p"], "pq": ["p", "q"]}).collect()}
    assert got == {("p", "a"): 2, ("p", "b"): 1, ("pq", "a::x"): 1, ("pq", "b::y"): 1}
    assert [tuple(r) for r in stats.top_k(df, F.col("q"), 1).collect()] == [("x", 2)]
    assert rows_of(stats.predicate_report(df, {"has p": F.col("p").isNotNull(), "none": F.lit(None).cast("boolean")})) == [("has p", 3), ("none", 0)]


def test_groups(spark):
    items = spark.createDataFrame(
        [("d1", "b", "D", "train", "l"), ("d1", "a", "D", "test", "m"), ("d2", "c", "D", "raw", "l"), (None, "e", "D", "raw", "l"), (None, "f", "D", "raw", "l"), ("d3", "g", "D", "raw", "l"), ("d3", "h", "E", None, "l")],
        "digest string, file string, dataset string, split string, label string",
    )
    assert rows_of(duplicates.duplicate_groups(items, "digest", "file")) == [("d1", 2, "a", 1), ("d3", 2, "g", 1)]
    assert rows_of(duplicates.duplicate_totals(items, "digest")) == [(3, 2, 4, 2)]
    profile = {r["digest"]: r for r in duplicates.group_profile(items, "digest").collect()}
    assert (profile["d1"]["split_leakage"], profile["d1"]["label_conflict"], profile["d1"]["train_and_test"], profile["d1"]["splits"]) == ("YES", "YES", "YES", "test|train")
    assert (profile["d3"]["split_leakage"], profile["d3"]["cross_dataset"], profile["d3"]["splits"]) == ("NO", "YES", "raw")
    assert duplicates.duplicate_totals(items.limit(0), "digest").first()[0] == 0


def test_number_groups(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = duplicates.number_groups(df, F.desc("k")).collect()
    assert all(r["group_id"] == 1000 - r["k"] for r in got) and len(got) == 1000


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)]
    hashes = [f"{b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)):016x}" for b in base for _ in range(6)] + [f"{base[0]:016x}"] * 4
    items = spark.createDataFrame([(f"i{k:03d}", h) for k, h in enumerate(hashes)] + [("n", None)], "item string, hash string")
    first = {}
    for k, h in enumerate(hashes):
        first.setdefault(h, f"i{k:03d}")
    want = set()
    for h, i in first.items():
        for g, j in first.items():
            if i < j and h[:8] == g[:8] and bin(int(h, 16) ^ int(g, 16)).count("1") <= 4:
                want.add((i, j))
    assert {(r["item_a"], r["item_b"]) for r in duplicates.near_pairs(items, "item", "hash").collect()} == want
    copies = {r["item"]: r["representative"] for r in duplicates.copies(items, "item", "hash").collect()}
    assert copies == {f"i{k:03d}": first[h] for k, h in enumerate(hashes)}


def test_involvement_and_relationships(spark):
    p = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "x"), ("x", None)], "a string, b string")
    assert rows_of(duplicates.involvement(p, F.col("a"), F.col("b"))) == [("x", 4), ("y", 2)]
    assert rows_of(duplicates.relationships(p, F.col("a"), F.col("b"))) == [("x <-> x", 1), ("x <-> y", 1), ("y <-> x", 1)]


def test_connected(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    star = [("s", f"t{i}") for i in range(30)]
    p = spark.createDataFrame(chain + [(b, a) for a, b in chain[:5]] + star + [("z", "z"), ("q", None)], "a string, b string")
    got = {r["item"]: r["root"] for r in connected(p, "a", "b").collect()}
    assert got == {f"c{i:03d}": "c000" for i in range(41)} | {x: "s" for x in ["s", *[f"t{i}" for i in range(30)]]}
    assert connected(p.limit(0), "a", "b").count() == 0


def test_audit(spark):
    items = spark.createDataFrame([("g", "b", "test", False, True), ("g", "a", "train", False, True), ("h", "c", "raw", True, False), ("h", "d", "raw", True, False), ("k", "f", "raw", False, False), ("k", "e", "raw", False, False)], "g string, file string, split string, conflict boolean, leak boolean")
    decided = audit.keep_first(items, "g", "file", F.col("conflict"), F.col("leak"), F.col("split") == "test")
    got = {r["file"]: (r["decision"], r["keep_item"]) for r in decided.collect()}
    assert got == {"b": ("KEEP", "b"), "a": ("EXCLUDE", "b"), "c": ("EXCLUDE_ALL", ""), "d": ("EXCLUDE_ALL", ""), "e": ("KEEP", "e"), "f": ("EXCLUDE", "e")}
    assert tuple(audit.audit_totals(decided, "g").first()) == (3, 6, 2, 4, 1, 1)
    assert rows_of(audit.group_decisions(decided, "g", "EXCLUDE_ALL")) == [("h", "EXCLUDE_ALL")]
    assert audit.require_pair(items, "g", "split", F.col("leak")).count() == 6
    with pytest.raises(Exception, match="one train and one test"):
        audit.require_pair(items, "g", "split", F.lit(True)).collect()
    assert audit.broken_pairs(items, "g", "split", F.col("leak")).count() == 0
    assert rows_of(audit.broken_pairs(items, "g", "split", F.lit(True))) == [("h", 0, 0), ("k", 0, 0)]
    hot = audit.keep_first(items, "g", "file", F.col("conflict"), F.col("leak"), F.col("split") == "test", ["g", "h"])
    assert rows_of(hot.select("file", "decision", "keep_item")) == rows_of(decided.select("file", "decision", "keep_item"))
    out = clean.excluded(decided)
    assert rows_of(clean.manifest(items, out, "file").select("file")) == [("b",), ("e",)]
    assert tuple(clean.log_totals(clean.action_log(items, out, "file")).first()) == (6, 2, 4, True)
    assert rows_of(clean.missing(spark.createDataFrame([("zz",), ("a",)], "file string"), items, "file")) == [("zz",)]
    assert rows_of(clean.surviving(out, items, "file")) == [("a",), ("c",), ("d",), ("f",)]


def test_taxonomy(spark, monkeypatch):
    rules = spark.createDataFrame([(2, "spot", "spot"), (1, "leaf spot", "leaf_spot")], "priority int, needle string, value string")
    labels = spark.createDataFrame([("leaf spot",), ("black spot",), ("x",), (None,), ("x",)], "label string")
    assert rows_of(taxonomy.first_rule(labels, "label", rules)) == [("black spot", "spot"), ("leaf spot", "leaf_spot"), ("x", None)]
    odd = rules.unionByName(spark.createDataFrame([(3, "", "any"), (4, None, "none"), (5, "spot", "later")], rules.schema))
    want = [("black spot", "spot"), ("leaf spot", "leaf_spot"), ("x", "any")]
    assert rows_of(taxonomy.first_rule(labels, "label", odd)) == want
    monkeypatch.setattr(taxonomy, "SENT_RULES", 2)
    assert rows_of(taxonomy.first_rule(labels, "label", odd)) == want
    monkeypatch.undo()
    assert rows_of(taxonomy.first_rule(labels, "label", rules.limit(0))) == [("black spot", None), ("leaf spot", None), ("x", None)]
    rows = spark.createDataFrame([("A", "k", "old"), ("B", "k", "old"), (None, "k", "old")], "d string, key string, v string")
    table = spark.createDataFrame([("k", "new")], "key string, v string")
    assert rows_of(taxonomy.lookup_where(rows, F.col("d") == "A", "key", table, ["v"])) == [("A", "k", "new"), ("B", "k", "old"), (None, "k", "old")]
    with pytest.raises(Exception, match="no entry"):
        taxonomy.lookup_where(rows, F.col("d") == "A", "key", table.where("key = 'z'"), ["v"]).collect()
    assert rows_of(taxonomy.overlay(rows, table.withColumn("d", F.lit("B")), ["d", "key"], ["v"])) == [("A", "k", "old"), ("B", "k", "new"), (None, "k", "old")]
    assert rows_of(taxonomy.value_counts(rows, "d")) == [("d", "<EMPTY>", 1), ("d", "A", 1), ("d", "B", 1)]


def test_quality(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "i int, t string")
    got = quality.validate(rows, {"null": F.col("t").isNull()}, {"empty": F.col("t") == "", "short": F.length("t") < 2})
    assert rows_of(got.select("i", "status", "message")) == [(1, "corrupt", "null"), (2, "warning", "empty | short"), (3, "warning", "short")]
    numbers = spark.createDataFrame([(3, 0)], "files int, corrupt int")
    assert [tuple(r) for r in quality.gate(numbers, ("corrupt",)).collect()] == [("files", "3"), ("corrupt", "0"), ("final_status", "PASS")]


def test_hamming_is_symmetric(spark):
    df = spark.createDataFrame([("00ff00ff00ff00ff", "ff00ff00ff00ff00")], "a string, b string")
    assert df.select(hamming(F.col("a"), F.col("b")), hamming(F.col("b"), F.col("a"))).first()[:] == (64, 64)


def test_final_gate(spark):
    files = spark.createDataFrame([("a", "d", "train"), ("b", "d", "test"), ("c", None, "raw"), ("e", "f", "raw"), ("g", "f", "raw")], "file string, digest string, split string")
    left = spark.createDataFrame([("a",)], "file string")
    told = quality.final_gate(files, F.col("digest").isNull(), "digest", left)
    assert [tuple(r) for r in told.collect()] == [
        ("total_images", "5"), ("corrupt_images", "1"), ("exact_duplicate_groups", "2"), ("exact_duplicate_files", "4"),
        ("train_test_duplicate_groups", "1"), ("audit_exclusions_still_present", "1"), ("validation_status", "FAIL"),
    ]
    assert [r["message"] for r in quality.causes(told).collect()] == ["Corrupt Images: 1", "Train Test Duplicate Groups: 1", "Audit Exclusions Still Present: 1"]
    fine = quality.final_gate(files.where("split = 'raw' and digest is not null"), F.col("digest").isNull(), "digest", left.limit(0))
    assert fine.collect()[-1]["value"] == "PASS" and quality.causes(fine).count() == 0


@pytest.mark.parametrize("most, digits", [(1, 8), (4, 4), (3, 10)])
def test_near_pairs_of_other_forms(spark, monkeypatch, most, digits):
    monkeypatch.setattr(duplicates, "HOT_ROWS", 10)
    rng = random.Random(most)
    base = rng.getrandbits(64)
    hashes = sorted({f"{base ^ sum(1 << b for b in rng.sample(range(50), rng.randint(0, 4))):016x}" for _ in range(150)})
    want = {(f"i{i:03d}", f"i{j:03d}") for i, g in enumerate(hashes) for j, h in enumerate(hashes) if i < j and g[:digits] == h[:digits] and bin(int(g, 16) ^ int(h, 16)).count("1") <= most}
    items = spark.createDataFrame([(f"i{k:03d}", h) for k, h in enumerate(hashes)], "item string, hash string")
    got = [(r["item_a"], r["item_b"]) for r in duplicates.near_pairs(items, "item", "hash", most, digits).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
