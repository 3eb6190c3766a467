from __future__ import annotations

import hashlib
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from sievework.schemas import REPORTS
from sievework.sources import readers, sinks
from sievework.storage import drop, shared_folder, stage


def png(w: int, h: int) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (w + 1) * h)) + chunk(b"IEND", b"")


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "raw"
    for name, body in {"A/train/x/a (1).PNG": png(3, 5), "A/b.jpg": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x07\x00\x09\x01\x01\x11\x00", "A/notes.txt": b"n", "A/c.mpo": b"?", "A/empty.png": b""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    return root


def test_scans(spark, tree):
    listed = {r["path"].rsplit("/", 1)[1]: r["is_image"] for r in readers.list_files(spark, str(tree)).collect()}
    assert listed == {"a (1).PNG": True, "b.jpg": True, "notes.txt": False, "c.mpo": True}
    strict = readers.list_files(spark, str(tree), (".jpg", ".png")).where("is_image")
    assert strict.count() == 2
    digests = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in readers.file_digests(spark, str(tree)).collect()}
    assert digests["a (1).PNG"] == hashlib.sha256(png(3, 5)).hexdigest() and len(digests) == 3


def test_headers(spark, tree):
    scanned = readers.scan_images(spark, str(tree)).select("path", readers.image_header(F.col("content")).alias("h")).select("path", "h.*")
    got = {r["path"].rsplit("/", 1)[1]: tuple(r)[1:] for r in scanned.collect()}
    assert got == {"a (1).PNG": (3, 5, "PNG"), "b.jpg": (9, 7, "JPEG"), "c.mpo": (None, None, None)}


def test_report_round_trip(spark, tmp_path):
    schema = REPORTS["class_analysis"]
    rows = [("a", "s, \"q\"", "cé", 3, True, False), (None, "s", "", None, None, None)]
    sinks.write_report(spark.createDataFrame(rows, schema), str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part-*"))
    assert "True" in text and "true" not in text
    back = {tuple(r) for r in readers.read_report(spark, str(tmp_path / "r"), schema).collect()}
    assert back == {("a", "s, \"q\"", "cé", 3, True, False), (None, "s", None, None, None, None)}
    assert readers.read_optional(spark, str(tmp_path / "none"), schema).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_report(spark, str(tmp_path / "none"), schema)


def test_json_and_metrics(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    doc = json.loads(sinks.summary_json({"total": F.count(F.lit(1)), "keys": F.array_sort(F.collect_set("k"))}, df).first()[0])
    assert doc == {"total": 3, "keys": ["a", "b"]}
    assert [tuple(r) for r in sinks.metric_rows(df.agg(F.count(F.lit(1)).alias("n")), ["n"]).collect()] == [("n", "3")]


def test_copy_tree(spark, tree, tmp_path):
    manifest = spark.createDataFrame([("A/b.jpg",)], "file string")
    sinks.copy_tree(manifest, str(tree), str(tmp_path / "clean"))
    assert (tmp_path / "clean/A/b.jpg").read_bytes() == (tree / "A/b.jpg").read_bytes()
    with pytest.raises(ValueError, match="lies in"):
        sinks.copy_tree(manifest, str(tree), str(tree).upper() + "/x")


def test_stage(spark):
    staged = stage(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), "t")
    assert staged.orderBy("a").collect()[1]["b"] == "x" and staged._staged_at.startswith(shared_folder(spark))
    drop(staged, spark.range(1), None)
    with pytest.raises(Exception):
        staged.count()
