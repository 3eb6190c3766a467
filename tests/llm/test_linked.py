from __future__ import annotations

import random

import pytest

from sievework.llm.linked import group_linked


def brute(pairs):
    up = {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        up.setdefault(a, a)
        up.setdefault(b, b)
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def graph(seed, n=400):
    rng = random.Random(seed)
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(n)]
    star = [("hub", f"s{i}") for i in range(n)]
    loose = [(f"r{rng.randrange(n)}", f"r{rng.randrange(n)}") for _ in range(n)]
    pairs = chain + star + loose + [(b, a) for a, b in chain[:50]] + chain[:50] + [("x", "x"), ("y", None), (None, None), ("", "e"), ("é", "z\\w")]
    rng.shuffle(pairs)
    return pairs


@pytest.mark.parametrize("seed", [0, 30])
def test_group_linked(spark, seed):
    pairs = graph(seed)
    df = spark.createDataFrame([(a, b, 1, "v") for a, b in pairs], "a string, b string, vertex int, item string")
    got = group_linked(df, "a", "b").collect()
    want = brute(pairs)
    assert len(got) == len(want) and {r["item"]: r["group_item"] for r in got} == want


def test_hot_vertex(spark, monkeypatch):
    from sievework.llm import linked
    from sievework.operators import skew

    monkeypatch.setattr(linked, "HOT_ROWS", 5)
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (5, 0.02))
    pairs = graph(5, 150)
    got = group_linked(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()
    assert {r["item"]: r["group_item"] for r in got} == brute(pairs)


def test_equal_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sievework.llm import linked

    real = F.xxhash64
    # two names share their first hash, and only that
    monkeypatch.setattr(linked.F, "xxhash64", lambda *c: F.when(F.col(c[0]).isin("p", "q"), F.lit(7).cast("bigint")).otherwise(real(*c)) if len(c) == 1 and isinstance(c[0], str) else real(*c))
    pairs = [("p", "a"), ("q", "b"), ("b", "c")]
    got = group_linked(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()
    assert {r["item"]: r["group_item"] for r in got} == brute(pairs)


def test_nothing_to_link(spark):
    for rows in ([], [("a", "a"), (None, "b")]):
        assert group_linked(spark.createDataFrame(rows, "a string, b string"), "a", "b").count() == 0
    with pytest.raises(ValueError):
        group_linked(spark.createDataFrame([], "a string, b string"), "a", "b", beta=0)

