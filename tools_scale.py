"""Scale probe: halo-blocked vs single-partition window on one long synthetic series.

Usage: python tools_scale.py [rows]   (prints one JSON line; results must be identical)
"""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import functions as F

from hazecast.operators.windows import series_row_features
from hazecast.session import build_session


def main() -> None:
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 10_000_000
    spark = build_session(shuffle_partitions=64)
    base = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    df = spark.range(n).select(
        F.lit("one_city").alias("city"),
        F.timestamp_add("HOUR", F.col("id"), base).alias("timestamp"),
        F.when(F.col("id") % 17 == 0, F.lit(None)).otherwise((F.abs(F.xxhash64("id")) % 500).cast("double")).alias("aqi"))
    kw = dict(lags=(72, 96), rolls=(72, 96), min_periods=24)
    out = {}
    for method in ("halo", "plain"):
        t = time.perf_counter()
        r = series_row_features(df, ["city"], "timestamp", ["timestamp"], "aqi", method=method, **kw)
        chk = r.agg(F.sum(F.xxhash64("timestamp", "aqi_lag_72h", "aqi_lag_96h", "aqi_rolling_72h",
                                     "aqi_rolling_96h") % 1000003).alias("s"), F.count("*").alias("n")).first()
        out[method] = {"sec": round(time.perf_counter() - t, 2), "checksum": int(chk["s"]), "rows": int(chk["n"])}
    out["identical"] = out["halo"]["checksum"] == out["plain"]["checksum"]
    print(json.dumps({"rows": n, **out}))


if __name__ == "__main__":
    main()
