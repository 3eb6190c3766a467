from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sievework.llm.proportions import sample_to_targets, shares_reached, uniform_hash


def make(spark, rows):
    return spark.createDataFrame(rows, "id bigint, c string, category string, available int")


TARGETS = [("a", 0.5, 0), ("b", 0.3, 7), ("rare", 0.1, 5), ("absent", 0.05, 2), ("tiny", 0.0, 1)]


def targets(spark, rows=TARGETS):
    return spark.createDataFrame(rows, "category string, target_share double, min_rows int")


def test_sample(spark):
    rows = [(i, "a" if i % 3 else "b", "x", i) for i in range(3000)] + [(5000 + i, "rare", "x", 0) for i in range(4)] + [(6000 + i, "tiny", None, 0) for i in range(3)]
    rows += [(7000, None, None, None), (7001, "untargeted", None, None), (1, "a", "again", 1)]
    df = make(spark, rows)
    sample, plan = sample_to_targets(df, "id", "c", targets(spark), size=100)
    got = sample.collect()
    assert sample.columns == df.columns
    per = {}
    for r in got:
        per.setdefault(r["c"], []).append(r)
    assert {k: len(v) for k, v in per.items()} == {"a": 50, "b": 30, "rare": 4, "tiny": 1}
    report = {r["category"]: r for r in plan.collect()}
    assert (report["rare"]["wanted"], report["rare"]["deficit"], report["absent"]["deficit"], report["tiny"]["planned"]) == (10, 6, 5, 1)
    # brute force: the rows of the smallest hashes
    hashed = [(r["h"], r["id"]) for r in df.where("c = 'a'").select("id", uniform_hash(F.lit(""), "id").alias("h")).collect()]
    assert sorted(i for _, i in sorted(hashed)[:50]) == sorted(r["id"] for r in per["a"])
    reached = {r["category"]: r for r in shares_reached(sample, "c", F.col("available"), plan).collect()}
    assert reached["a"]["share"] == pytest.approx(50 / 85)
    told = {k: (r["met"], r["reason"]) for k, r in reached.items()}
    # what two categories lack raises the shares of the others beyond their targets; the minimum of "tiny" is 0.012 of 85 rows
    assert told == {"a": (False, "others"), "b": (False, "others"), "rare": (False, "supply"), "absent": (False, "supply"), "tiny": (False, "minimum")}


def test_falling_short_is_made_good(spark, monkeypatch):
    from sievework.llm import proportions

    # with a bound far too low the first reading falls short
    monkeypatch.setattr(proportions, "HASH_BITS", 60)
    df = make(spark, [(i, "a", None, 0) for i in range(500)])
    real = proportions.uniform_hash
    monkeypatch.setattr(proportions, "uniform_hash", lambda *c: real(*c).bitwiseOR(F.lit(1 << 59)))
    sample, _ = proportions.sample_to_targets(df, "id", "c", targets(spark, [("a", 1.0, 0)]), size=50)
    assert sample.count() == 50


def test_empty(spark):
    df = make(spark, [(1, "a", None, 1)])
    sample, plan = sample_to_targets(df.limit(0), "id", "c", targets(spark))
    assert sample.count() == 0 and plan.where("deficit = wanted").count() == 5
    sample, plan = sample_to_targets(df, "id", "c", targets(spark).limit(0))
    assert sample.count() == 0 and plan.count() == 0
    assert shares_reached(sample, "c", F.col("available"), plan).count() == 0


def test_minima_and_rounding_are_told(spark):
    df = make(spark, [(i, "abcd"[i % 4], None, 1) for i in range(400)])
    goals = targets(spark, [("a", 0.52, 0), ("b", 0.4, 0), ("c", 0.08, 5)])
    sample, plan = sample_to_targets(df, "id", "c", goals, size=10)
    told = {r["category"]: (r["sampled"], r["met"], r["reason"]) for r in shares_reached(sample, "c", F.col("available"), plan).collect()}
    assert told == {"a": (5, False, "rounding"), "b": (4, False, "others"), "c": (5, False, "minimum")}
    # without a size it is large enough for the minimum to be a share
    sample, plan = sample_to_targets(df, "id", "c", goals, fraction=0.01)
    told = {r["category"]: (r["sampled"], r["met"], r["reason"]) for r in shares_reached(sample, "c", F.col("available"), plan).collect()}
    assert told == {"a": (33, True, None), "b": (25, True, None), "c": (5, True, None)}


@pytest.mark.parametrize("sent", [0, 100])
def test_several_samples_at_once(spark, monkeypatch, sent):
    from sievework.llm import proportions

    monkeypatch.setattr(proportions, "SENT_PLAN", sent)
    monkeypatch.setattr(proportions, "HOT_ROWS", 50)
    rows = [(i, "ab"[i % 2], "x" if i % 3 else "y", 1) for i in range(300)]
    both = spark.createDataFrame([(s, i, a if s == "one" else b) for i, a, b, _ in rows for s in ("one", "two")] + [(None, 1, "a"), ("one", 1, None)], "s string, id bigint, c string")
    goals = [("one", "a", 0.5, 0), ("one", "b", 0.5, 0), ("two", "x", 0.9, 0), ("two", "y", 0.1, 0)]
    g = spark.createDataFrame(goals, "s string, category string, target_share double, min_rows int")
    sample, plan = sample_to_targets(both, "id", "c", g, by="s", fraction=0.1)
    per = {(r["s"], r["c"]): r["count"] for r in sample.groupBy("s", "c").count().collect()}
    assert per == {("one", "a"): 15, ("one", "b"): 15, ("two", "x"): 27, ("two", "y"): 3}
    for s, field in (("one", 1), ("two", 2)):
        alone, _ = sample_to_targets(make(spark, [(r[0], r[field], None, 1) for r in rows]), "id", "c", g.where(F.col("s") == s).drop("s"), fraction=0.1)
        assert sorted(r["id"] for r in alone.collect()) == sorted(r["id"] for r in sample.where(F.col("s") == s).collect())
