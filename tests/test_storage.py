from __future__ import annotations

import os
import threading

import pytest

from sievework.storage import _CLEANUP, drop, release, run_folder, shuffle_files_dropped, stage, stage_counted


def staged(spark):
    folder = run_folder(spark).removeprefix("file://")
    return sorted(os.listdir(folder)) if os.path.exists(folder) else []


def test_staged_tables_go(spark):
    release(spark)
    a, n = stage_counted(spark.range(1000).where("id % 3 = 0"), "a")
    b = stage(spark.range(5), "b")
    assert n == 334 == a.count() and [x[0] for x in staged(spark)] == ["a", "b"]
    drop(a, None, spark.range(1))
    assert [x[0] for x in staged(spark)] == ["b"] and b.count() == 5
    release(spark)
    assert staged(spark) == []
    assert stage_counted(spark.range(0), "none")[1] == 0
    release(spark)


def test_setting_comes_back_from_threads_and_errors(spark):
    before = spark.conf.get(_CLEANUP, None)
    inside, leave = threading.Event(), threading.Event()

    def other():
        with shuffle_files_dropped(spark):
            inside.set()
            leave.wait(60)

    thread = threading.Thread(target=other)
    thread.start()
    inside.wait(60)
    with pytest.raises(ZeroDivisionError), shuffle_files_dropped(spark):
        1 // 0
    assert spark.conf.get(_CLEANUP) == "true"
    leave.set()
    thread.join()
    assert spark.conf.get(_CLEANUP, None) == before
