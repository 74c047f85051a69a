"""Plan checks: no single-partition exchange on the scale path, pushdown, no Python on the hot path."""

import datetime as dt

from pyspark.sql import functions as F

from hazecast.operators.windows import fill_forward_backward, series_row_features
from hazecast.session import scratch_path
from hazecast.sinks.files import write_table
from hazecast.sources.bindings import obs_hourly

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def _exchanges(df):
    """(partitioning, input columns) of every shuffle in the physical plan."""
    import re
    txt = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    blocks = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: (\w+)", txt)
    return [(part, cols) for cols, part in blocks]


def test_halo_windows_have_no_single_partition(spark):
    from hazecast.sources.bindings import station_hourly
    s = station_hourly(spark, SF)
    halo = series_row_features(s, ["station"], "timestamp", ["timestamp"], "aqi", lags=(72,), rolls=(72,))
    assert all(p != "SinglePartition" for p, _ in _exchanges(halo))
    # one key value holding every row: still no single-partition exchange
    h = obs_hourly(spark, SF)
    one = series_row_features(h, ["city"], "timestamp", ["timestamp"], "aqi", lags=(72,), rolls=(72,))
    assert all(p != "SinglePartition" for p, _ in _exchanges(one))
    plain = series_row_features(h, [], "timestamp", ["timestamp"], "aqi", lags=(72,), method="plain")
    assert any(p == "SinglePartition" and "aqi" in c for p, c in _exchanges(plain))


def test_fill_uses_keyed_partitions(spark):
    from hazecast.sources.bindings import station_hourly
    f = fill_forward_backward(station_hourly(spark, SF), ["station"], "timestamp", ["timestamp"], ["pm25"])
    assert all(p != "SinglePartition" for p, _ in _exchanges(f))


def test_store_scan_prunes_and_pushes(spark):
    path = scratch_path(spark, "plan-store")
    df = spark.createDataFrame([("c", dt.datetime(2024, 1, d), float(d), d) for d in range(1, 29)],
                               "city string, timestamp timestamp_ntz, aqi double, day int")
    write_table(df, path, ["city", "day"])
    q = spark.read.parquet(path).filter((F.col("day") <= 5) & (F.col("aqi") > 2)).select("timestamp", "aqi")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "isnotnull(day" in plan
    assert "PushedFilters: [IsNotNull(aqi), GreaterThan(aqi,2.0)]" in plan
    assert q.count() == 3


def test_preprocess_python_only_in_knn(spark):
    from hazecast.plans.preprocess import preprocess
    from hazecast.queries.composite import silver
    g = preprocess(silver(spark, SF))
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan  # no row/column Python UDFs
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_no_nested_loop_or_cartesian_joins(spark):
    """Joins on the city key stay equi-joins (city comes from data, not a folded literal)."""
    import __spark_entry__ as E
    for name in ("asof_lag", "range_mean", "knn_impute", "reference_row", "fill_forward_backward", "engineer_live"):
        txt = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in txt and "CartesianProduct" not in txt, name


def test_per_key_tables_do_not_shuffle_the_rows(spark):
    """Without automatic broadcasts, no join on the city alone shuffles rows: the per-key side is
    counted and sent to the tasks."""
    from hazecast.models.prep import chronological_split
    from hazecast.operators.filters import iqr_filter
    from hazecast.operators.joins import with_reference_row
    h = obs_hourly(spark, SF)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = {"fences": iqr_filter(h, ["city"], "aqi"), "split": chronological_split(h, 0.8)[0],
                 "fill": fill_forward_backward(h, ["city"], "timestamp", ["timestamp"], ["pm25"]),
                 "reference": with_reference_row(h, h.groupBy("city").agg(F.max("aqi").alias("top")))}
        for name, df in plans.items():
            txt = df._jdf.queryExecution().executedPlan().toString()
            import re
            assert not re.search(r"(SortMergeJoin|ShuffledHashJoin) \[city#\d+\]", txt), name
            assert "BroadcastHashJoin" in txt, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
