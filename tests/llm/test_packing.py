from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm.packing import pack, plan_runs


def unfold(runs):
    """Container of each (length, rank)."""
    return {(length, rank + k): first + k // each for length, rank, count, first, each in runs for k in range(count)}


def best_fit(histogram, capacity):
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [i for i, r in enumerate(rooms) if r >= length]
            if fits:
                i = min(fits, key=lambda i: rooms[i])
                rooms[i] -= length
            else:
                rooms.append(capacity - length)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 25), max_size=12), st.just(30))
def test_plan_is_best_fit_decreasing(histogram, capacity):
    runs, made = plan_runs(histogram, capacity)
    where = unfold(runs)
    assert Counter(length for length, _ in where) == Counter({k: n for k, n in histogram.items() if n})
    assert all((k, r) in where for k, n in histogram.items() for r in range(1, n + 1))
    filled = defaultdict(int)
    for (length, _), box in where.items():
        filled[box] += length
    assert set(filled) == set(range(made)) and all(x <= capacity for x in filled.values())
    assert sorted(capacity - x for x in filled.values()) == best_fit(histogram, capacity)


def test_lengths_out_of_range():
    with pytest.raises(ValueError):
        plan_runs({31: 1}, 30)
    assert plan_runs({}, 30) == ([], 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_pack(spark, seed):
    rng = random.Random(seed)
    items = [(i, rng.choice([None, 0, 5, 5, 5, 5, 7, 31, 90, rng.randint(1, 200)]), "piece") for i in range(400)] + [(3, 5, "again")]
    kinds = [("small", 30), ("big", 100), ("none", 0), (None, None)]
    df = spark.createDataFrame(items, "key int, n int, free string")
    got = pack(df, "key", "n", spark.createDataFrame(kinds, "container string, capacity int")).collect()
    for kind, capacity in kinds[:2]:
        own = [r for r in got if r["container"] == kind]
        boxes = defaultdict(int)
        for r in own:
            boxes[r["container_id"]] += r["length"]
        assert all(r["free"] == capacity - boxes[r["container_id"]] >= 0 for r in own)
        want = Counter()
        for i, n, _ in items:
            if n:
                want.update([(i, p, capacity) for p in range(n // capacity)] + ([(i, n // capacity, n % capacity)] if n % capacity else []))
        assert Counter((r["key"], r["piece"], r["length"]) for r in own) == want
        histogram = Counter(r["length"] for r in own)
        assert sorted(capacity - x for x in boxes.values()) == best_fit(histogram, capacity)
    assert {r["container"] for r in got} == {"small", "big"}


def test_empty(spark):
    kinds = spark.createDataFrame([("k", 10)], "container string, capacity int")
    items = spark.createDataFrame([("a", 3)], "id string, n int")
    assert pack(items.limit(0), "id", "n", kinds).count() == 0
    assert pack(items, "id", "n", kinds.limit(0)).count() == 0
    assert pack(items, "id", "n", kinds).count() == 1


@pytest.mark.parametrize("sent", [0, 500_000])
def test_many_large_kinds(spark, monkeypatch, sent):
    from sievework.llm import packing

    monkeypatch.setattr(packing, "SENT_RUNS", sent)
    monkeypatch.setattr(packing, "RANKS", 7)
    rng = random.Random(6)
    items = [(i, rng.choice([400_000, 400_000, 600_000, 999_999, rng.randint(1, 1_500_000)])) for i in range(120)]
    kinds = [(f"k{i:02}", 1_000_000 - i) for i in range(16)]
    got = pack(spark.createDataFrame(items, "key int, n int"), "key", "n", spark.createDataFrame(kinds, "container string, capacity int")).collect()
    for kind, capacity in kinds:
        own = [r for r in got if r["container"] == kind]
        boxes = defaultdict(int)
        for r in own:
            boxes[r["container_id"]] += r["length"]
        assert all(r["free"] == capacity - boxes[r["container_id"]] >= 0 for r in own)
        assert sum(boxes.values()) == sum(n for _, n in items)
        assert sorted(capacity - x for x in boxes.values()) == best_fit(Counter(r["length"] for r in own), capacity)
