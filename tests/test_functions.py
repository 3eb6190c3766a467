from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import classify as C
from sievework.functions import text as T
from sievework.functions.fingerprint import perceptual_hash, perceptual_hash_of
from sievework.functions.paths import dataset_folder, image_path, label_folder, own_split


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("c"))).collect()]


def test_image_path(spark):
    assert one(spark, image_path, None, "", "./a/b", ".\\a\\b", "././a", "a/./b", "../a") == [None, "", "a/b", "a/b", "a", "a/./b", "../a"]


def test_own_split(spark):
    paths = [None, "", "x.jpg", "datasets/raw/D/Val/c/x.jpg", "datasets/raw/D/c/x.jpg", "datasets\\raw\\D\\TEST\\c\\x.jpg", "raw/D/train/x.jpg", "datasets/raw/D/train", "datasets/raw/train/c/x.jpg"]
    assert one(spark, own_split, *paths) == [None, "raw", "raw", "validation", "raw", "test", "train", "raw", "raw"]
    assert one(spark, dataset_folder, *paths[3:6]) == ["D", "D", "D"]
    assert one(spark, label_folder, None, "x.jpg", "a/x.jpg") == [None, None, "a"]


def test_split_precedence(spark):
    path = "datasets/raw/D/test/train/val/x.jpg"
    found = [one(spark, lambda c, o=o: C.split_of(c, o), path)[0] for o in (C.TRAIN_FIRST, C.TEST_FIRST, C.TRAIN_TEST, C.REVIEW)]
    assert found == ["train", "test", "train", "TEST"]


def test_normalise(spark):
    assert one(spark, T.normalize_loose, " A__b-C\t", None, "") == ["a  b c", None, ""]
    assert one(spark, T.normalize_label, " A__b-\t C ", "Pepper__bell___healthy") == ["a b c", "pepper bell healthy"]


def test_labels(spark):
    assert one(spark, C.is_healthy, "unhealthy", "abnormal", "rust", None) == [True, True, False, None]
    assert [tuple(r) for r in one(spark, C.canonical_label, "Tomato___healthy", "corn rust leaf", "x Fussarium  Wilt", "??")] == [("healthy", "healthy"), ("rust", "disease"), ("fusarium_wilt", "disease"), ("REVIEW_REQUIRED", "unknown")]
    # the longer alias wins, and two spaces keep "bell pepper" from matching
    assert one(spark, C.crop_of_label, "Corn_rust", "Bell_pepper leaf", "Pepper__bell___healthy", "pineapple", "") == ["maize", "bell_pepper", "pepper", "apple", "unknown"]


def test_datasets(spark):
    paths = ["datasets/raw/Rice/mango/x.jpg", "a/b.jpg", None]
    assert one(spark, C.dataset_leftmost, *paths) == ["Rice", "Unknown", "Unknown"]
    assert one(spark, C.dataset_by_priority, *paths) == ["Mango", "Unknown", "Unknown"]
    assert one(spark, C.label_folder_structural, "raw/PlantDoc/train/c/x.jpg", "raw/Rice/AugmentedSet/c/x.jpg", "raw/Rice/x.jpg", "raw/Rice/train/c/x.jpg") == ["c", "c", "Unknown", "train"]
    assert one(spark, lambda c: C.moved(c, "datasets/raw/", "clean/"), "datasets/raw/a", "other/a", "datasets\\raw\\b") == ["clean/a", None, "clean/b"]


def test_suffix_and_lists(spark):
    assert one(spark, T.suffix, "a/b.JPG", "a.b/c", ".hidden", "x.tar.gz", "") == [".jpg", "", "", ".gz", ""]
    assert one(spark, T.split_list, "a || b||c ||  || d", None, "") == [["a", "b||c", "d"], None, []]
    assert one(spark, lambda c: T.split_pair(c)[1], "a::b::c", "a") == ["b::c", None]


def test_hamming(spark):
    rows = spark.createDataFrame([("ffffffffffffffff", "0000000000000000"), ("8000000000000001", "0000000000000000"), (None, "0000000000000000")], "a string, b string")
    assert [r[0] for r in rows.select(T.hamming(F.col("a"), F.col("b"))).collect()] == [64, 2, None]


def test_perceptual_hash(spark):
    rng = np.random.default_rng(1)
    smooth = np.kron(rng.random((8, 8)) * 255, np.ones((30, 40)))
    a, b = perceptual_hash(smooth), perceptual_hash(smooth + rng.normal(0, 1, smooth.shape))
    far = perceptual_hash(rng.random((64, 64)) * 255)
    distance = lambda x, y: bin(int(x, 16) ^ int(y, 16)).count("1")
    assert distance(a, b) <= 6 < distance(a, far)
    decode = lambda raw: np.frombuffer(raw, np.uint8).reshape(8, 8) if len(raw) == 64 else None
    rows = spark.createDataFrame([(bytes(range(64)),), (b"x",), (None,)], "content binary")
    got = [r[0] for r in rows.select(perceptual_hash_of(F.col("content"), decode)).collect()]
    assert len(got[0]) == 16 and got[1:] == [None, None]


@pytest.mark.parametrize("size", [(1, 1), (3, 500), (33, 31)])
def test_perceptual_hash_of_odd_sizes(size):
    assert len(perceptual_hash(np.arange(size[0] * size[1]).reshape(size) % 255)) == 16
