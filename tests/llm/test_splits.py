from __future__ import annotations

import random

import pytest

from sievework.llm.splits import assign, propagate_labels, split_records, spread_report

SHARES = {"train": 0.7, "validation": 0.1, "test": 0.2}


def test_propagation(spark):
    edges = [(i, f"e{i // 2}") for i in range(20)] + [(i, f"f{(i + 1) // 2}") for i in range(20)] + [(50, "g"), (51, "g"), (50, "g"), (None, "e1"), (60, None)]
    got = {r["record"]: r["label"] for r in propagate_labels(spark.createDataFrame(edges, "record int, entity string")).collect()}
    assert got == {i: 0 for i in range(20)} | {50: 50, 51: 50}
    with pytest.raises(ValueError, match="rounds"):
        propagate_labels(spark.createDataFrame(edges, "record int, entity string"), max_rounds=0)


def test_long_chains_take_few_rounds(spark):
    chain = spark.range(20_000).selectExpr("id record", "explode(array(id, id + 1)) entity")
    got = propagate_labels(chain, max_rounds=12)
    assert got.count() == 20_000 and {r["label"] for r in got.select("label").distinct().collect()} == {0}


def test_assign_keeps_shares():
    rng = random.Random(1)
    groups = {i: {rng.choice("abc"): rng.randint(1, 6)} for i in range(2000)}
    out = assign(groups, SHARES, {})
    for c in "abc":
        whole = sum(g.get(c, 0) for g in groups.values())
        for s, share in SHARES.items():
            assert abs(sum(g.get(c, 0) for k, g in groups.items() if out[k] == s) / whole - share) < 0.01


def sizes(spark, rows=(("a", 10), ("b", None), (None, 3))):
    return spark.createDataFrame([*rows], "label string, size bigint")


@pytest.mark.parametrize("a_task", [40, 10**6])
def test_split_records(spark, a_task):
    rng = random.Random(2)
    records = [(i, rng.choice(["a", "a", "a", "b", "c", None]), "x") for i in range(1500)]
    edges = [(i, rng.randrange(400), i) for i in range(1400)] + [(0, 1, 5), (0, 2, 5)]
    r = spark.createDataFrame(records, "record bigint, label string, split string")
    e = spark.createDataFrame(edges, "record bigint, entity bigint, component int")
    out = split_records(r, e, SHARES, sizes(spark), a_task)
    got = {x["record"]: (x["component"], x["split"]) for x in out.collect()}
    assert len(got) == out.count() == 1500
    where = {}
    for i, entity, _ in edges:
        assert where.setdefault(entity, got[i]) == got[i]
    assert got[0] == where[1] == where[2]
    assert all(got[i][0] == i for i in range(1400, 1500))
    for s, share in SHARES.items():
        assert abs(sum(x[1] == s for x in got.values()) / 1500 - share) < 0.03
    report = {(x["split"], x["label"]): x for x in spread_report(out, SHARES, sizes(spark)).collect()}
    assert report["test", None]["records"] == sum(x[1] == "test" for x in got.values()) and report["train", "a"]["inventory_images"] == 10


def test_edges_of_the_domain(spark):
    r = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "record bigint, label string")
    e = spark.createDataFrame([(1, 9), (2, 9)], "record bigint, entity bigint")
    none = e.limit(0)
    assert split_records(r.limit(0), none, SHARES, sizes(spark)).count() == 0
    assert split_records(r, none, SHARES, sizes(spark).limit(0)).count() == 3
    one = split_records(r, e, {"only": 1.0, "zero": 0.0}, sizes(spark)).collect()
    assert {x["split"] for x in one} == {"only"}
    with pytest.raises(ValueError):
        split_records(r, e, {"zero": 0.0}, sizes(spark))


def test_tasks_make_up_for_a_giant_and_spread_minorities(spark):
    # a third of the records is one component; every other one is of four, with a record of the rare class in each fortieth
    records = [(i, "a") for i in range(4000)] + [(4000 + i, "rare" if i % 160 == 0 else f"c{i // 4 % 5}") for i in range(8000)]
    edges = [(i, -1) for i in range(4000)] + [(4000 + i, i // 4) for i in range(8000)]
    r, e = spark.createDataFrame(records, "record bigint, label string"), spark.createDataFrame(edges, "record bigint, entity bigint")
    got = split_records(r, e, {"train": 0.4, "validation": 0.2, "test": 0.4}, sizes(spark).limit(0), 20).collect()
    assert len(got) == 12000
    for c in ("c0", "c1", "c2", "c3", "c4", "rare"):
        rows = [x["split"] for x in got if x["label"] == c]
        assert abs(rows.count("train") / len(rows) - 0.4) < 0.1 and abs(rows.count("validation") / len(rows) - 0.2) < 0.1
    r = spark.createDataFrame([(i, "a") for i in range(12000)], "record bigint, label string")
    rows = [x["split"] for x in split_records(r, e, SHARES, sizes(spark).limit(0), 20).collect()]
    assert all(abs(rows.count(s) / 12000 - share) < 0.005 for s, share in SHARES.items())
