"""Chunks for themselves: a bad one is noted, the others are committed, and a rerun writes what failed."""

import datetime as dt
import os

import pytest

from hazecast.session import scratch_path
from hazecast.sinks import files as K

T0 = dt.datetime(2024, 1, 1)


def rows(spark, n):
    return spark.createDataFrame([("c", T0 + dt.timedelta(hours=i // 2), float(i)) for i in range(n)], "city string, timestamp timestamp_ntz, aqi double").repartition(4)


def test_a_bad_chunk_and_a_rerun(spark):
    path, written = scratch_path(spark, "ledger"), []

    def sink(df, folder):
        written.append(folder[-6:])
        if folder.endswith("2"):
            raise ValueError("no room")
        df.write.mode("overwrite").parquet(folder)
    got = {r.chunk: r for r in K.chunked_write(rows(spark, 450), path, "first", chunk_rows=100, write=sink).collect()}
    assert sorted(written) == [f"{c:06d}" for c in range(5)]
    assert [got[c].status for c in range(5)] == ["committed", "committed", "failed", "committed", "committed"]
    assert [got[c].rows for c in range(5)] == [100, 100, 100, 100, 50] and got[2].error == "ValueError: no room"
    before = {f: os.stat(f"{path}/chunk=000000/{f}").st_mtime_ns for f in os.listdir(f"{path}/chunk=000000")}
    written.clear()
    again = {r.chunk: (r.status, r.attempt) for r in K.chunked_write(rows(spark, 450), path, "first", chunk_rows=100).collect()}
    assert again == {c: ("committed", 2 if c == 2 else 1) for c in range(5)}
    assert before == {f: os.stat(f"{path}/chunk=000000/{f}").st_mtime_ns for f in os.listdir(f"{path}/chunk=000000")}
    stored = sorted((r.chunk, r.aqi) for r in spark.read.parquet(path).collect())
    assert [v for _, v in sorted(stored, key=lambda r: r[1])] == [float(i) for i in range(450)]
    assert sorted(v for c, v in stored if c == 1) == [float(i) for i in range(100, 200)]
    assert K.chunked_write(rows(spark, 450), path, "first", chunk_rows=100, write=lambda *a: pytest.fail("nothing is left")).count() == 5


def test_runs_keep_ledgers_of_their_own(spark):
    path = scratch_path(spark, "ledger-runs")
    assert K.read_ledger(spark, path, "a").count() == 0
    assert K.chunked_write(rows(spark, 30), path, "a", chunk_rows=10).count() == 3
    assert K.chunked_write(rows(spark, 40), path, "b", chunk_rows=10).count() == 4
    assert K.read_ledger(spark, path, "a").count() == 3 and spark.read.parquet(path).count() == 40


def test_no_rows(spark):
    assert K.chunked_write(rows(spark, 1).where("aqi < 0"), scratch_path(spark, "ledger-none"), "a").count() == 0
