from __future__ import annotations

import random

import pytest

from sievework.llm.mixing import mix, plan_mix


def plan_of(spark, supplies, goals, total=None):
    """plan_mix by source; supplies are (tokens, texts), goals (share, repeats)."""
    left = spark.createDataFrame([(s, *x) for s, x in supplies.items()], "source string, supply bigint, texts bigint")
    right = spark.createDataFrame([(s, *x) for s, x in goals.items()], "source string, target_share double, max_repeats int")
    return {r["source"]: r for r in plan_mix(left, right, total).collect()}


def test_plan(spark):
    plan = plan_of(spark, {"a": (1000, 10), "b": (300, 30), "c": (0, 0)}, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 4), "d": (None, 1)})
    assert set(plan) == {"a", "b"}
    assert sum(p["share"] for p in plan.values()) == pytest.approx(1) and sum(p["demand"] * p["slope"] for p in plan.values()) == pytest.approx(0)
    assert plan["a"]["demand"] == pytest.approx(1300 * 5 / 8) and plan["b"]["demand"] == pytest.approx(1300 * 3 / 8)
    assert plan_of(spark, {}, {"a": (1.0, 1)}) == {} == plan_of(spark, {"a": (5, 1)}, {"a": (1.0, 0)})
    assert plan_of(spark, {"a": (1000, 10)}, {"a": (1.0, 3)}, total=500)["a"][1:] == (1.0, 1000, 10, 500.0, 500.0, 0.0)


def test_a_scarce_source_falls_short_alone(spark):
    plan = plan_of(spark, {"a": (10**9, 10**6), "b": (5, 1)}, {"a": (0.5, 1), "b": (0.5, 3)})
    assert plan["a"]["demand"] == pytest.approx(5e8, rel=1e-6) and plan["b"]["demand"] == 15 and plan["b"]["wanted"] == pytest.approx(5e8, rel=1e-6)
    goals = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame([(i, "a", 10) for i in range(1000)] + [(-1, "b", 5), (-2, "untargeted", 7)], "id int, source string, n int")
    uses, report = mix(df, "id", "source", "n", goals)
    told = {r["source"]: r for r in report.collect()}
    assert told["a"]["used_tokens"] == pytest.approx(5000, abs=10) and told["b"]["used_tokens"] == 15 and told["b"]["wanted_tokens"] == 5003
    assert told["b"]["most_uses"] == 3 and not told["b"]["met"] and told["untargeted"]["met"] is None
    assert uses.count() == told["a"]["used_texts"] + 3


def texts(spark, rng):
    rows = [(i, rng.choice(["long", "short", "short", None, "extra"]), 0, "x") for i in range(3000)]
    rows = [(i, s, rng.randint(50, 150) if s == "long" else rng.choice([None, 0, rng.randint(1, 20)]), u) for i, s, _, u in rows]
    return rows, spark.createDataFrame(rows, "id int, source string, n int, use string")


def test_mix(spark):
    rows, df = texts(spark, random.Random(3))
    goals = [("long", 0.6, 1), ("short", 0.3, 5), ("gone", 0.1, 3)]
    uses, report = mix(df, "id", "source", "n", spark.createDataFrame(goals, "source string, target_share double, max_repeats int"))
    got = uses.collect()
    size = {i: (s, n) for i, s, n, _ in rows}
    seen = {}
    for r in got:
        assert (r["source"], r["tokens"]) == size[r["id"]]
        seen.setdefault(r["id"], []).append(r["use"])
    assert all(sorted(u) == list(range(len(u))) for u in seen.values())
    assert max(len(u) for i, u in seen.items() if size[i][0] == "long") <= 1 and max(map(len, seen.values())) <= 5
    amount = {s: sum(r["tokens"] for r in got if r["source"] == s) for s in ("long", "short")}
    assert amount["long"] / sum(amount.values()) == pytest.approx(2 / 3, abs=0.01)
    spots = [r["position"] for r in got]
    assert spots == sorted(spots) and 0 <= spots[0] and spots[-1] <= 1
    # any stretch follows the schedule: by time t, t + slope * (t * t - t) of a source's tokens are used
    supplies = {s: (sum(n or 0 for _, x, n, _ in rows if x == s), sum(1 for _, x, n, _ in rows if x == s and n)) for s in ("long", "short")}
    slopes = {s: p["slope"] for s, p in plan_of(spark, supplies, {s: (w, m) for s, w, m in goals}).items()}
    for t in (0.25, 0.5, 0.75):
        for s, a in slopes.items():
            assert sum(r["tokens"] for r in got if r["source"] == s and r["position"] <= t) / amount[s] == pytest.approx(t + a * (t * t - t), abs=0.02)
    told = {r["source"]: r for r in report.collect()}
    assert set(told) == {"long", "short", "extra", "gone"} and not told["gone"]["met"] and told["extra"]["used_tokens"] == 0
    assert told["long"]["used_tokens"] == amount["long"]


def test_empty(spark):
    goals = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame([(1, "a", 5)], "id int, source string, n int")
    uses, report = mix(df.limit(0), "id", "source", "n", goals)
    assert uses.count() == 0 and [r["met"] for r in report.collect()] == [False]
    uses, report = mix(df, "id", "source", "n", goals.limit(0))
    assert uses.count() == 0 and report.first()["used_tokens"] == 0
    assert sorted(r["use"] for r in mix(df, "id", "source", "n", goals)[0].collect()) == [0, 1]
