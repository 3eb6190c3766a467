from __future__ import annotations

import math
import random

import pytest

from sievework.llm.mapping import edit_similarity, fill, grams, match_values, names_every_word, normalise, readings, resembles
from sievework.llm.queries import PLANT_PARTS

NAMES = [("leaf_rust", "leaf_rust"), ("leaf_rust", "puccinia"), ("stem_borer", "stem_borer"), ("healthy", "healthy"), ("healthy", "no symptoms"), ("mosaic_virus", "mosaic_virus"), ("ergot", "ergot"), ("pod_borer", "pod borer"), ("none", None), (None, "x")]


def test_normalise():
    assert normalise("12. LeafRust_v2 (Wheát)!!") == "leaf rust wheat"
    assert normalise("???") == "" == normalise("")
    kinds = {"wheat": "noise", "heavy": "decoration"}
    told = lambda x: readings([(w, kinds.get(w)) for w in normalise(x).split()], {"leaf"})
    assert told("Heavy Wheat leaf LEAF MINER") == ["leaf miner", "leaf leaf miner"]
    assert told("wheat") == [] == told("")


def test_grams_ignore_word_order():
    assert grams("mosaic virus") == grams("virus mosaic")


@pytest.mark.parametrize("a, b, distance", [("abc", "abc", 0), ("ergot", "egrot", 1), ("rust", "rst", 1), ("", "", 0), ("abcd", "acbx", 2)])
def test_edit_similarity(a, b, distance):
    assert edit_similarity(a, b) == pytest.approx(1 - distance / max(len(a), len(b), 1))


def test_match_values(spark):
    names = spark.createDataFrame(NAMES, "entry string, name string")
    expected = {
        "Leaf Rust": "leaf_rust", "rust, leaf": "leaf_rust", "WHEAT___leaf_urst": "leaf_rust", "Puccnia": "leaf_rust", "egrot": "ergot", "MosaicVirus 3": "mosaic_virus",
        "No symptom": "healthy", "heavy stem borrer": "stem_borer", "": None, "   ": None, "wheat leaf": None, "Wheat": None, "stem": None, "pods": None, "borer": None,
        "New folder (3)": None, "x" * 5000: None, "गेहूं": None, "leaf rust " * 2000: None,
    }
    rows = spark.createDataFrame([(k, i, "e") for i, k in enumerate([*expected, *expected, None])], "text string, label int, entry string")
    got = {r["label"]: r["entry"] for r in match_values(rows, "text", names, noise=["wheat"], parts=PLANT_PARTS, tails=["leaf"]).collect()}
    expected.pop("leaf rust " * 2000), got.pop("leaf rust " * 2000)  # said so often, either answer is right
    assert got == expected
    assert match_values(rows.limit(0), "text", names).count() == 0
    assert {r["entry"] for r in match_values(rows, "text", names.limit(0)).collect()} == {None}


def test_ties_are_not_matched(spark):
    names = spark.createDataFrame([("a", "black spot"), ("b", "black spot")], "entry string, name string")
    rows = spark.createDataFrame([("black spot",)], "t string")
    assert match_values(rows, "t", names).first()["entry"] is None


def test_fill(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "i int, t string")
    matches = spark.createDataFrame([("a", "A"), ("b", None)], "label string, entry string")
    assert sorted((r["i"], r["entry"]) for r in fill(rows, "t", matches).collect()) == [(1, "A"), (2, "A"), (3, None), (4, None)]


def test_hand_work_is_met(spark, data):
    """Rows that people have mapped before must get the same entry."""
    from pyspark.sql import functions as F

    from sievework.llm.queries import crop_words, entry_names, table

    folder = data.replace("sf0.001", "sf0.01")
    rows = table(spark, folder, "class_mapping").where("trim(canonical_class) not in ('', 'REVIEW_REQUIRED') and trim(original_class) != ''")
    found = match_values(rows, "original_class", entry_names(spark, folder), noise=crop_words(spark, folder), parts=PLANT_PARTS, tails=["leaf"])
    joined = rows.join(found, rows["original_class"] == found["label"])
    total, right = joined.count(), joined.where(F.col("entry") == F.col("canonical_class")).count()
    assert total > 100 and right >= 0.99 * total


def brute(readings_of, names, threshold=0.85, margin=0.05, least=0.2, least_plain=0.3):
    """Every reading beside every name."""
    vectors, rare = {n: grams(n) for _, n in names}, {}
    for v in vectors.values():
        for g in v:
            rare[g] = rare.get(g, 0) + 1
    weight = lambda v: {g: k**0.5 * (math.log(1 + len(vectors) / rare[g]) if g in rare else math.log(1 + 2 * len(vectors))) for g, k in v.items()}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    meant = {n: weight(v) for n, v in vectors.items()}
    out = {}
    for label, words in readings_of.items():
        w, best = weight(grams(words)), {}
        for entry, name in names:
            cosine = sum(x * meant[name].get(g, 0) for g, x in w.items()) / norm(w) / norm(meant[name])
            v, n = grams(words), vectors[name]
            plain = sum((k * n[g]) ** 0.5 for g, k in v.items()) / (sum(v.values()) * sum(n.values())) ** 0.5
            if (cosine >= least or plain >= least_plain) and names_every_word(words, name):
                best[entry] = max(best.get(entry, 0), cosine + edit_similarity(words.replace(" ", ""), name.replace(" ", "")))
        top = sorted(best, key=lambda e: (-best[e], e))
        out[label] = top[0] if top and best[top[0]] >= threshold and best[top[0]] - (best[top[1]] if len(top) > 1 else 0) >= margin else None
    return out


@pytest.mark.parametrize("others", [20, 2000])
def test_look_alikes_crowd_nothing_out(spark, others):
    rng = random.Random(others)
    names = {("ergot", "ergot")} | {(n, n) for n in ("egr" + "".join(rng.choice("abcdfhilmn") for _ in range(7)) + "rot" for _ in range(others))}
    # many names of one entry are no lead over it
    names |= {("rust", f"rust of kind {chr(97 + i)}") for i in range(15)}
    names = sorted(names)
    values = ["egrot", "ergto", "rust of kind", "rust kind c", "none like this"] + [n[:-2] for _, n in rng.sample(names, 30)]
    got = match_values(spark.createDataFrame([(v,) for v in values], "t string"), "t", spark.createDataFrame(names, "entry string, name string"))
    assert {r["label"]: r["entry"] for r in got.collect()} == (want := brute({v: normalise(v) for v in values}, names))
    assert want["ergto"] == "ergot" and want["rust kind c"] == "rust"


def test_decorations_come_from_the_values(spark):
    names = spark.createDataFrame([("leaf_rust", "leaf rust"), ("stem_borer", "stem borer"), ("mildew", "mildew")], "entry string, name string")
    rows = [f"quarantined {x} {c}" for x in ("leaf rust", "stem borer", "mildew", "mldw") for c in ("alpha", "beta")] + ["quarantined"]
    got = {r["label"]: r for r in match_values(spark.createDataFrame([(r,) for r in rows], "t string"), "t", names, noise=["alpha", "beta"]).collect()}
    assert got["quarantined leaf rust alpha"]["entry"] == "leaf_rust" and got["quarantined leaf rust alpha"]["score"] == pytest.approx(2)
    assert got["quarantined mldw beta"]["entry"] == "mildew" and got["quarantined"]["entry"] is None
    assert resembles("mldw", "mildew") and resembles("shlorosis", "chlorosis") and not resembles("quarantined", "rust")
