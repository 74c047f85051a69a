"""Versions of tables: moved keys, null partitions, failures between files, pruned deletes, writers side by side."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from hazecast.session import scratch_path
from hazecast.sinks import files as K
from hazecast.sinks import versions as V

STORE = "id long, value double, day string"


def put(spark, target, rows, seq=None):
    return K.upsert(spark, target, spark.createDataFrame(rows, STORE), ["id"], seq, ["day"])


def rows(df):
    return sorted(map(tuple, df.select("id", "value", "day").collect()))


def local(path):
    return path.removeprefix("file:")


def data_files(target):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(local(target))
            for f in names if f.endswith(".parquet") and "/_" not in d[len(local(target)):]}


def test_null_partition_loses_nothing(spark):
    target = scratch_path(spark, "v-null")
    put(spark, target, [(1, 1.0, None), (2, 2.0, "a")])
    assert rows(put(spark, target, [(3, 3.0, None)])) == [(1, 1.0, None), (2, 2.0, "a"), (3, 3.0, None)]
    assert rows(spark.read.parquet(target)) == [(1, 1.0, None), (2, 2.0, "a"), (3, 3.0, None)]


def test_a_key_that_moves_is_there_once(spark):
    target = scratch_path(spark, "v-moved")
    put(spark, target, [(1, 1.0, "a"), (2, 2.0, "a"), (3, 3.0, "b")])
    assert rows(put(spark, target, [(1, 9.0, "b")])) == [(1, 9.0, "b"), (2, 2.0, "a"), (3, 3.0, "b")]
    assert rows(put(spark, target, [(1, 8.0, None), (3, 7.0, "c")])) == [(1, 8.0, None), (2, 2.0, "a"), (3, 7.0, "c")]
    assert rows(put(spark, target, [(1, 6.0, "b")])) == [(1, 6.0, "b"), (2, 2.0, "a"), (3, 7.0, "c")]
    assert rows(spark.read.parquet(target)) == rows(V.read_table(spark, target))


def test_moves_against_a_dictionary(spark):
    """Many batches, deletes between them, and the index put together several times."""
    import random
    rng, target, want = random.Random(2), scratch_path(spark, "v-many"), {}
    for turn in range(7):
        batch = {rng.randint(0, 30): (float(turn), rng.choice(["x", "y/z", "a b", "50%", "k=v", None])) for _ in range(9)}
        want |= batch
        got = put(spark, target, [(k, *v) for k, v in batch.items()])
        if turn in (2, 5):
            got = K.delete_where(spark, target, F.col("id") % 5 == turn)
            want = {k: v for k, v in want.items() if k % 5 != turn}
        assert rows(got) == sorted((k, *v) for k, v in want.items())


def test_index_parts_are_put_together(spark, monkeypatch):
    monkeypatch.setattr(V, "PARTS", 2)
    target = scratch_path(spark, "v-parts")
    for turn in range(4):
        put(spark, target, [(1, float(turn), f"p{turn}"), (10 + turn, 0.0, "q")])
    v = V.VersionedTable(spark, target).current()
    assert len(v.index["parts"]) == 1 and v.index["rows"] == 5 and len(os.listdir(f"{local(target)}/{V.INDEX}")) == 1


def test_special_folder_names_and_a_table_of_others(spark):
    target = scratch_path(spark, "v-plain")
    spark.createDataFrame([(1, 1.0, "a b/c%d+e"), (2, 2.0, "x")], STORE).write.partitionBy("day").parquet(target)
    assert rows(put(spark, target, [(1, 5.0, "a b/c%d+e"), (2, 6.0, "a b/c%d+e")])) == [(1, 5.0, "a b/c%d+e"), (2, 6.0, "a b/c%d+e")]
    # what others append is part of the table
    spark.createDataFrame([(7, 7.0, "x")], STORE).write.mode("append").partitionBy("day").parquet(target)
    assert len(rows(V.read_table(spark, target))) == 3
    assert rows(put(spark, target, [(7, 8.0, "y")])) == [(1, 5.0, "a b/c%d+e"), (2, 6.0, "a b/c%d+e"), (7, 8.0, "y")]


@pytest.mark.parametrize("managed", [True, False])
def test_a_failure_between_two_files_shows_the_old_version(spark, monkeypatch, managed):
    target = scratch_path(spark, "v-between")
    start = [(i, 0.0, d) for i, d in enumerate(["a", "b", "c"])]
    if managed:
        put(spark, target, start)
    else:
        spark.createDataFrame(start, STORE).write.partitionBy("day").parquet(target)
    calls, move = [], V.VersionedTable._move

    def fails(self, source, to):
        calls.append(to)
        if len(calls) == 2:
            raise OSError("lost")
        move(self, source, to)
    monkeypatch.setattr(V.VersionedTable, "_move", fails)
    change = [(i, 1.0, d) for i, d in enumerate(["a", "b", "c"])]
    with pytest.raises(OSError, match="lost"):
        put(spark, target, change)
    assert len(calls) == 2 and rows(V.read_table(spark, target)) == start
    monkeypatch.setattr(V.VersionedTable, "_move", move)
    assert rows(put(spark, target, change)) == change  # what was moved has gone
    assert rows(spark.read.parquet(target)) == change


def test_a_failure_after_the_commit_shows_the_new_version(spark, monkeypatch):
    target = scratch_path(spark, "v-after")
    put(spark, target, [(1, 0.0, "a")])
    clean = V.VersionedTable.clean
    monkeypatch.setattr(V.VersionedTable, "clean", lambda self, v: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        put(spark, target, [(1, 1.0, "a"), (2, 1.0, "b")])
    assert rows(V.read_table(spark, target)) == [(1, 1.0, "a"), (2, 1.0, "b")]
    monkeypatch.setattr(V.VersionedTable, "clean", clean)
    assert rows(put(spark, target, [(3, 3.0, "c")])) == [(1, 1.0, "a"), (2, 1.0, "b"), (3, 3.0, "c")]
    assert rows(spark.read.parquet(target)) == [(1, 1.0, "a"), (2, 1.0, "b"), (3, 3.0, "c")]


def test_of_two_writers_one_gives_up(spark):
    target = scratch_path(spark, "v-two")
    put(spark, target, [(1, 0.0, "a")])
    table = V.VersionedTable(spark, target)
    base = table.current()
    put(spark, target, [(2, 0.0, "a")])
    with pytest.raises(V.Conflict):
        table.commit(base, None, list(base.files))
    same = V.Version(table.latest(), {})
    with pytest.raises(V.Conflict):
        table._write(same)
    assert len(rows(V.read_table(spark, target))) == 2


def test_delete_leaves_untouched_files_alone(spark):
    target = scratch_path(spark, "v-delete")
    T0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, T0 + dt.timedelta(hours=i), f"{i // 24:02d}") for i in range(96)], "id long, ts timestamp_ntz, day string")
    K.write_table(df.repartition("day"), target, ["day"])
    before = data_files(target)
    out = K.delete_where(spark, target, F.col("ts") < F.lit(T0 + dt.timedelta(hours=30)).cast("timestamp_ntz"))
    assert out.count() == 66 and spark.read.parquet(target).count() == 66
    after = data_files(target)
    day = lambda files: {f.split("day=")[1][:2] for f in files}
    same = {f: t for f, t in after.items() if f in before}
    assert day(after) == {"01", "02", "03"} and day(same) == {"02", "03"} and all(before[f] == t for f, t in same.items())
    assert not os.path.exists(f"{local(target)}/day=00")
    # a predicate on the partition alone drops files unread, and one without a match changes nothing
    K.delete_where(spark, target, F.col("day") == "02")
    assert set(data_files(target)) < set(after) and V.read_table(spark, target).count() == 42
    version = V.VersionedTable(spark, target).latest()
    K.delete_where(spark, target, F.col("id") < 0)
    assert V.VersionedTable(spark, target).latest() == version
    K.delete_where(spark, target, F.lit(True))
    assert V.read_table(spark, target).columns == ["id", "ts", "day"] and V.read_table(spark, target).count() == 0
    assert K.upsert(spark, target, df.limit(3), ["id"], None, ["day"]).count() == 3


def test_nulls_do_not_match_a_delete(spark):
    target = scratch_path(spark, "v-null-delete")
    put(spark, target, [(1, None, "a"), (2, 2.0, "a"), (3, 3.0, None)])
    assert rows(K.delete_where(spark, target, F.col("value") > 2.5)) == [(1, None, "a"), (2, 2.0, "a")]
