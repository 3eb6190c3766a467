from __future__ import annotations

from datetime import datetime

from sievework.streaming.incremental import first_seen, windowed_counts


def run(spark, tmp_path, transform, mode):
    schema = "digest string, at timestamp"
    rows = [("a", datetime(2024, 1, 1, 1)), ("a", datetime(2024, 1, 1, 2)), ("b", datetime(2024, 1, 2, 1)), ("a", datetime(2024, 1, 9, 1))]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = transform(stream).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(tuple(r) for r in spark.table("out").collect())


def test_first_seen(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: first_seen(s, "digest", "at", "30 days"), "append")
    assert [d for d, _ in got] == ["a", "b"]


def test_windowed_counts(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: windowed_counts(s, "at", ["digest"]), "complete")
    assert [(d, n) for _, d, n in got] == [("a", 2), ("b", 1), ("a", 1)]
