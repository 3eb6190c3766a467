from __future__ import annotations

import random

import numpy as np
import pytest

from sievework.functions.paths import own_split
from sievework.llm.fmindex import FMIndex, suffix_array
from sievework.llm.overlap import cross_split_overlaps, find_overlaps, match_shard, overlap_counts, search_stream


def test_suffix_array():
    rng = random.Random(1)
    for text in (b"a", b"aaaa", b"banana", bytes(rng.choice(b"ab") for _ in range(2000)), b"abc" * 300):
        assert [*suffix_array(np.frombuffer(text, np.uint8))] == sorted(range(len(text)), key=lambda i: text[i:])


def test_search_against_brute_force():
    rng = random.Random(2)
    keys = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 9))).encode() for _ in range(200)]
    index = FMIndex(keys)
    text = b"\xff" + b"\xff".join(keys) + b"\xff\xfe"
    count = lambda p: sum(text.startswith(p, i) for i in range(len(text)))
    patterns = ["".join(rng.choice("abéx") for _ in range(rng.randint(1, 7))).encode() for _ in range(200)] + [b""]
    for p, length, n in zip(patterns, *index.search(patterns), strict=True):
        longest = max((k for k in range(len(p) + 1) if k == 0 or count(p[-k:])), default=0)
        # shorter suffixes of a match match too, so the longest is the maximal one
        assert length == longest and (n == count(p[len(p) - longest :]) or not longest)
    at = index.located([*keys, b"nope", keys[0] + b"x"])
    assert [keys[i] for i in at[:-2]] == keys and [*at[-2:]] == [-1, -1]


def test_the_index_is_small():
    rng = random.Random(3)
    keys = ["p:datasets/raw/Set/" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789_-") for _ in range(40)) for _ in range(4000)]
    index = FMIndex([k.encode() for k in keys])
    assert index.nbytes() < 1.5 * sum(map(len, keys))
    assert [*index.located([k.encode() for k in keys[:300]])] == [*range(300)]


def test_rows_come_through_the_index(monkeypatch):
    import pandas as pd

    from sievework.llm import overlap

    rows = pd.DataFrame({"key": ["a", "b", "a", "ab", "b"], "ref": [None, None, "x", "y", "z"], "held": ["1", "2", None, None, None]})
    assert match_shard(rows).values.tolist() == [["x", "1"], ["z", "2"]]
    monkeypatch.setattr(overlap.FMIndex, "located", lambda self, keys: np.full(len(keys), -1))
    assert match_shard(rows).empty


@pytest.mark.parametrize("shard_bytes", [50, 10**6])
def test_search_stream(spark, monkeypatch, shard_bytes):
    from sievework.llm import overlap

    monkeypatch.setattr(overlap, "HOT_ROWS", 50)
    train = [("a", "1"), ("a", "2"), ("bb", "3"), ("é" * 3000, "4"), (None, "5"), ("", "6"), ("a\nb", "7")] + [("hot", str(i)) for i in range(100, 200)]
    held = [("a", 1), ("b", 2), ("é" * 3000, 3), (None, 4), ("", 5), ("a\nb", 6), ("hot", 7)]
    t, h = spark.createDataFrame([(*x, 0) for x in train], "key string, ref string, held int"), spark.createDataFrame(held, "key string, held int")
    want = sorted([("1", "1"), ("2", "1"), ("4", "3"), ("7", "6")] + [(str(i), "7") for i in range(100, 200)])
    assert sorted(tuple(r) for r in search_stream(t, h, shard_bytes).collect()) == want
    assert search_stream(t.limit(0), h).count() == 0 and search_stream(t, h.limit(0)).count() == 0


def brute(files, links):
    out = set()
    by = lambda s: [f for f in files if f[3] in s]
    pairs = {(a, b) for a, b in links} | {(b, a) for a, b in links}
    for t in by({"train"}):
        for h in by({"validation", "test"}):
            if t[2] is not None and t[2] == h[2]:
                out.add((t[0], h[0], "exact"))
            if (t[1], h[1]) in pairs:
                out.add((t[0], h[0], "near"))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_cross_split_overlaps(spark, monkeypatch, hot):
    from sievework.llm import overlap

    if hot:
        monkeypatch.setattr(overlap, "HOT_ROWS", 20)
    rng = random.Random(4)
    files = []
    for i in range(300):
        split = rng.choice(["train", "test", "validation", "raw"])
        path = rng.choice([None, f"datasets/raw/D/{split}/c/{i}.jpg"] + [f"datasets/raw/D/{split}/c/{i}.jpg"] * 9) if split != "raw" else f"datasets/raw/D/c/{i}.jpg"
        files.append((i, path, rng.choice([None, "hot", "hot", f"d{rng.randrange(60)}"]), split))
    known = [f[1] for f in files if f[1]]
    links = [(rng.choice(known), rng.choice(known)) for _ in range(400)] + [(known[0], "datasets/raw/D/test/c/unknown.jpg")]
    f = spark.createDataFrame(files, "id bigint, path string, digest string, split string")
    l = spark.createDataFrame(links, "a string, b string")
    got = [tuple(r) for r in cross_split_overlaps(f, l, own_split).select("train_id", "held_id", "how").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(files, links)
    assert cross_split_overlaps(f.limit(0), l, own_split).count() == 0
    pairs = {}
    for t, h, _ in got:
        pairs.setdefault(h, set()).add(t)
    counts = {r["held_id"]: r for r in overlap_counts(find_overlaps(f, l, own_split)).where("pairs > 0").collect()}
    assert {h: r["pairs"] for h, r in counts.items()} == {h: len(x) for h, x in pairs.items()}
    assert sum(r["exact"] for r in counts.values()) == sum(how == "exact" for *_, how in got)
