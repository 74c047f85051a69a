"""Structured Streaming versions of the hourly ingest.

All jobs are restartable: progress lives in the checkpoint folder they are given,
so a later run continues where the last one stopped.  Sinks are idempotent
(upserts keyed by the row key with an explicit order), so a replayed micro-batch
changes nothing, and late rows correct what they belong to: none is dropped.
``trigger(availableNow=True)`` drains what has landed and stops, which is how a
scheduled hourly run uses them.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.aqi import aqi_category, pm25_to_aqi
from ..functions.calendar import trunc_hour
from ..functions.rounding import DIGITS, as_decimal, round_half_even
from ..operators.windows import bucket_of
from ..session import broadcast_if_small, scratch_path, staged_table
from ..sinks.files import upsert
from ..sinks.versions import Version, VersionedTable, file_system


def _drain(writer, checkpoint: str):
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


def stream_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json",
                 glob: str | None = None, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def _month(ts):
    """Partition value of the tables that streams keep: only touched months are rewritten."""
    return F.date_format(ts, "yyyy-MM")


def stream_ingest(spark: SparkSession, landed: str, table: str, city: str, checkpoint: str | None = None) -> DataFrame:
    """Landed air-pollution payloads -> canonical rows -> upserted table (key city, timestamp).

    With the ``checkpoint`` of an earlier run only files that landed since are read.
    """
    from ..sources.payloads import COMPONENT_NAMES, from_epoch_seconds
    src = stream_files(spark, landed, S.AIR_POLLUTION).filter(F.size("list") > 0)
    comp = F.get(F.col("list"), 0)["components"]
    rows = src.select(F.lit(city).alias("city"), from_epoch_seconds(F.col("dt")).alias("timestamp"),
                      F.col("dt").alias("ingest_seq"),
                      *[F.coalesce(comp[s], F.lit(0.0)).alias(n) for s, n in COMPONENT_NAMES.items()])
    rows = rows.withColumn("aqi", pm25_to_aqi(F.col("pm25"), 0, "reference")).withColumns(
        {n: round_half_even(F.col(n), 2) for n in COMPONENT_NAMES.values()}).withColumn("_month", _month("timestamp"))

    def sink(batch: DataFrame, batch_id: int):
        upsert(batch.sparkSession, table, batch, ["city", "timestamp"], "ingest_seq", ["_month"])
    _drain(rows.writeStream.foreachBatch(sink), checkpoint or scratch_path(spark, "ckpt-ingest"))
    return spark.read.parquet(table).drop("_month")


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint folder, whatever run of it this is."""
    return spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]


#: files of a day's readings, and of the sums, that are put together into one
MANY_FILES = 32


class HourlySums:
    """Readings (event_id, ts, value) that arrive in micro-batches, and their sums per hour.

    Two tables beside ``table``, both versions of plain folders: ``-readings``, a log by day in which a
    row is a reading that is new or has another value (``was``) than before, and ``-sums``, the changes
    that each micro-batch makes to its hours' sums and numbers.  A micro-batch adds files to both and
    rewrites none; of the log it reads the days that it touches.  Each table notes the last
    micro-batch of each stream that it holds, so a replay adds nothing, wherever the first try ended.
    """

    def __init__(self, spark: SparkSession, table: str, run: str):
        self.spark, self.run = spark, run
        self.log = VersionedTable(spark, f"{table.rstrip('/')}-readings")
        self.sums = VersionedTable(spark, f"{table.rstrip('/')}-sums")

    def _append(self, table: VersionedTable, base: Version, df: DataFrame, by: str, batch_id: int) -> None:
        stage = f"{table.path}__new-{batch_id}-{uuid.uuid4().hex[:8]}"
        df.write.partitionBy(by).parquet(stage)
        table.commit(base, stage, schema=df.schema, notes={self.run: batch_id})

    def _put_together(self, table: VersionedTable, by: str, plan) -> None:
        """Rewrite the folders that have got many files as one file each."""
        base = table.current()
        count = Counter(f.rpartition("/")[0] for f in base.files)
        files = [f for f in base.files if count[f.rpartition("/")[0]] > MANY_FILES]
        if files:
            stage = f"{table.path}__new-{uuid.uuid4().hex[:8]}"
            plan(table.read(files, base)).repartition(by).write.partitionBy(by).parquet(stage)
            table.commit(base, stage, files)

    def add(self, batch: DataFrame, batch_id: int) -> DataFrame | None:
        """Take in a micro-batch; the hours (timestamp, _month) that it changes."""
        part = f"{self.run}-{batch_id}"
        base = self.log.current()
        day = F.date_format("ts", "yyyyMMdd").alias("_day")
        if base.notes.get(self.run, -1) < batch_id:
            new = batch.groupBy("event_id", "ts").agg(F.max_by("value", F.struct(F.col("value").isNotNull(), "value")).alias("value")).select("*", day)
            if base.files:
                days = {f"_day={r[0] or '__HIVE_DEFAULT_PARTITION__'}" for r in new.select("_day").distinct().collect()}  # a row per day
                files = [f for f in base.files if f.rpartition("/")[0] in days]
            old = self.log.read(files, base) if base.files and files else self.spark.createDataFrame([], READING)
            held = (old.join(new.select("event_id", "ts"), ["event_id", "ts"], "left_semi").groupBy("event_id", "ts")
                    .agg(F.max_by(F.struct("value"), "_seq").alias("_old")))
            fresh = (new.join(held, ["event_id", "ts"], "left").where(F.col("_old").isNull() | ~F.col("_old.value").eqNullSafe(F.col("value")))
                     .select("event_id", "ts", F.col("value").cast("double").alias("value"), F.col("_old.value").alias("was"),
                             F.lit(part).alias("_part"), F.lit(base.number + 1).cast("long").alias("_seq"), "_day"))
            self._append(self.log, base, fresh, "_day", batch_id)
        base = self.log.current()
        mine = self.log.read(version=base).where(F.col("_part") == part)
        hour = trunc_hour(F.col("ts")).alias("timestamp")
        changed = staged_table(mine.select(hour, as_decimal(F.col("value")).alias("v"), as_decimal(F.col("was")).alias("w"))
                               .groupBy("timestamp").agg(F.sum(F.coalesce("v", F.lit(0)) - F.coalesce("w", F.lit(0))).cast(f"decimal(38,{DIGITS})").alias("s"),
                                                         F.sum(F.col("v").isNotNull().cast("long") - F.col("w").isNotNull().cast("long")).alias("n"))
                               .withColumn("_month", _month("timestamp")), "hourly-changes")
        base = self.sums.current()
        if base.notes.get(self.run, -1) < batch_id:
            self._append(self.sums, base, changed, "_month", batch_id)
        return changed.select("timestamp", "_month")

    def means(self, hours: DataFrame) -> DataFrame:
        """(timestamp, _month, pm25, n_readings) of some hours."""
        total = (self.sums.read().join(hours, ["_month", "timestamp"], "left_semi").groupBy("timestamp", "_month")
                 .agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
        return total.select("timestamp", "_month", (F.col("s").cast("double") / F.nullif(F.col("n"), F.lit(0))).alias("pm25"),
                            F.col("n").alias("n_readings"))

    def tidy(self) -> None:
        self._put_together(self.log, "_day", lambda df: df)
        self._put_together(self.sums, "_month", lambda df: df.groupBy("timestamp", "_month").agg(F.sum("s").cast(f"decimal(38,{DIGITS})").alias("s"),
                                                                                                F.sum("n").alias("n")).select("timestamp", "s", "n", "_month"))


READING = "event_id long, ts timestamp_ntz, value double, was double, _part string, _seq long, _day string"


def stream_hourly(events: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Hourly means of readings (event_id, ts, value), right however late a reading comes.

    Sums and numbers per hour are kept by ``HourlySums``; each micro-batch adds its changes, and the hours
    that it touches are upserted into ``table``.  What is written grows with the batch, not with the days
    that it touches.  A reading sent again with another value replaces the first (of one batch the largest
    counts); a replay or a second run adds nothing twice.  NaN and what a decimal does not hold
    (1e17 and more) count as missing.
    """
    spark = events.sparkSession

    def sink(batch: DataFrame, batch_id: int):
        own = batch.sparkSession
        sums = HourlySums(own, table, _run_of(own, checkpoint))
        hours = sums.add(batch, batch_id)
        upsert(own, table, sums.means(hours), ["timestamp"], None, ["_month"])
        sums.tidy()
    _drain(events.select("event_id", "ts", "value").writeStream.foreachBatch(sink), checkpoint)
    return spark.read.parquet(table).drop("_month")


LAST_INDEX = "city string, last struct<timestamp:timestamp_ntz,aqi:double>"


def change_rates(rows: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (city, timestamp, aqi) with aqi_change_rate and late, and the last index per city after them.

    A row moves a city's last index if it has one and is later than all before it (of one hour the
    smallest index moves); the rate is the index minus the last index before the row, first 0; a row not
    later than that is late.  The window is by (city, day) and a summary of one row per (city, day)
    carries the last index on, so a busy city is spread over its days.
    """
    aqi = F.when(~F.isnan("aqi"), F.col("aqi"))
    known = rows.withColumn("_aqi", aqi).join(broadcast_if_small(last), "city", "left")
    known = known.withColumn("_bk", bucket_of(F.col("timestamp")))
    first = Window.partitionBy("city", "_bk", "timestamp").orderBy(F.col("_aqi").asc_nulls_last())
    after = F.col("last").isNull() | (F.col("timestamp") > F.col("last.timestamp"))
    moves = F.col("_aqi").isNotNull() & after & (F.row_number().over(first) == 1)
    known = known.withColumn("_moves", F.when(moves, F.struct("timestamp", F.col("_aqi").alias("aqi"))))
    upto = Window.partitionBy("city", "_bk").orderBy("timestamp", F.col("_moves").isNull(), "_aqi").rowsBetween(Window.unboundedPreceding, -1)
    inner = known.withColumn("_in", F.last("_moves", ignorenulls=True).over(upto))
    days = known.groupBy("city", "_bk").agg(F.max("_moves").alias("_top"))
    before = Window.partitionBy("city").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("city", "_bk", F.last("_top", ignorenulls=True).over(before).alias("_carried"))
    out = inner.join(carried, ["city", "_bk"], "left").withColumn("_before", F.coalesce("_in", "_carried", "last"))
    rate = round_half_even(F.coalesce(F.col("_aqi") - F.col("_before.aqi"), F.lit(0.0)), 2)
    late = F.coalesce(F.col("timestamp") <= F.col("_before.timestamp"), F.lit(False))
    now = (days.groupBy("city").agg(F.max("_top").alias("_top")).join(last, "city", "full")
           .select("city", F.coalesce("_top", "last").alias("last")).where("last is not null"))
    return out.select("city", "timestamp", "aqi", rate.alias("aqi_change_rate"), late.alias("late")), now


def stream_change_rate(readings: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Change rate of the index along each city's readings, in micro-batches.

    The state, the last index per city, lies in the checkpoint folder, a folder per micro-batch: a
    replayed batch starts from the same state.  Rows are upserted by (city, timestamp) with their
    micro-batch as order; of several readings of one hour in one batch the last by value is kept."""
    spark = readings.sparkSession
    state = f"{checkpoint.rstrip('/')}/last-index"

    def sink(batch: DataFrame, batch_id: int):
        own = batch.sparkSession
        at = lambda n: f"{state}/batch={n}"
        last = own.read.schema(LAST_INDEX).parquet(at(batch_id - 1)) if batch_id else own.createDataFrame([], LAST_INDEX)
        rows, now = change_rates(staged_table(batch.select("city", "timestamp", "aqi"), "change-batch"), last)
        b = rows.withColumns({"_batch": F.lit(int(batch_id)).cast("long"), "_month": _month("timestamp")})
        upsert(own, table, b, ["city", "timestamp"], "_batch", ["_month"])
        now.write.mode("overwrite").parquet(at(batch_id))
        if batch_id > 1:
            fs, Path = file_system(own, state)
            fs.delete(Path(at(batch_id - 2)), True)
    _drain(readings.writeStream.foreachBatch(sink), checkpoint)
    return spark.read.parquet(table).drop("_batch", "_month")


def stream_upsert(rows: DataFrame, table: str, checkpoint: str, keys: Sequence[str], seq: str,
                  partition_by: Sequence[str] = ()) -> DataFrame:
    """Replay-safe last-write-wins sink: every micro-batch is upserted by key, ordered by ``seq``.
    With ``partition_by`` only the partitions that a batch touches are rewritten."""
    spark = rows.sparkSession

    def sink(batch: DataFrame, batch_id: int):
        upsert(batch.sparkSession, table, batch, list(keys), seq, list(partition_by))
    _drain(rows.writeStream.foreachBatch(sink), checkpoint)
    return spark.read.parquet(table)


def stream_alerts(readings: DataFrame, table: str, checkpoint: str, threshold: float = 150) -> DataFrame:
    spark = readings.sparkSession
    alerts = readings.filter(F.col("aqi") > threshold).withColumn("category", aqi_category(F.col("aqi")))
    _drain(alerts.writeStream.format("parquet").option("path", table), checkpoint)
    return spark.read.parquet(table)
