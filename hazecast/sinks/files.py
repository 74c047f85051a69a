"""Table maintenance on plain Parquet/CSV folders.

Plain Parquet has no MERGE, so every change is *stage, validate, commit*: the new content
of what a change touches is written beside the target first, checked, moved in and committed as
the table's next version (see ``versions``).  A failure before the commit leaves the old version to
``read_table``; of two writers the later one fails.  The CSV backup is one folder, replaced by a rename.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sanitise import bad_value_count, coerce_types, sanitise
from ..operators.windows import global_row_number
from ..session import scratch_path, staged_table
from .versions import KeyIndex, Version, VersionedTable, exists as _exists, file_system as _fs


def _replace_folder(spark: SparkSession, new: str, target: str) -> None:
    """Put folder ``new`` in the place of ``target``; the old one goes last."""
    fs, Path = _fs(spark, target)
    fs.mkdirs(Path(target).getParent())
    old = f"{target}__old-{uuid.uuid4().hex[:8]}"
    had = fs.exists(Path(target))
    if had and not fs.rename(Path(target), Path(old)):
        raise RuntimeError(f"{target} could not be set aside")
    if not fs.rename(Path(new), Path(target)):
        if had:
            fs.rename(Path(old), Path(target))
        raise RuntimeError(f"{new} could not take the place of {target}")
    if had:
        fs.delete(Path(old), True)


def _replace(table: VersionedTable, base: Version, stage: str | None, remove: Sequence[str], **more) -> Version:
    """Commit a staged change as the next version of the table."""
    return table.commit(base, stage, remove, **more)


def _beside(target: str) -> str:
    return f"{target.rstrip('/')}__new-{uuid.uuid4().hex[:8]}"


def _dir(file: str) -> str:
    return file.rpartition("/")[0]


def _partition_names(v: Version) -> list[str]:
    """Partition columns that the files' folders name."""
    return [p.partition("=")[0] for p in _dir(next(iter(v.files), "")).split("/") if "=" in p]


def _keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key; a null order comes first, and equal ones are told apart by their values."""
    others = [c for c in df.columns if c not in keys and c not in ("_src",)]
    st = F.struct(*[F.col(c) for c in others])
    ordering = F.struct(*[x for o in order for x in (F.col(o).isNotNull(), F.col(o))], F.xxhash64(*others))
    return df.groupBy(*keys).agg(F.max_by(st, ordering).alias("_k")).select(*keys, "_k.*")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite",
                fmt: str = "parquet") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)


def _merged(existing: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows updated by a batch of one row per key.  Columns are those of both; a column that
    the batch lacks keeps its stored value."""
    lacking = [c for c in existing.columns if c not in batch.columns]
    stored = existing.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in existing.columns if c not in keys],
                             F.lit(True).alias("_had"))
    new = batch.withColumn("_new", F.lit(True))
    j = stored.join(new, list(keys), "full")
    names = [c for c in existing.columns if c not in keys] + [c for c in batch.columns if c not in existing.columns]
    out = []
    for c in names:
        if c in lacking:
            out.append(F.col(f"_old_{c}").alias(c))
        elif c in existing.columns:
            out.append(F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*keys, *out)


def upsert(spark: SparkSession, target: str, batch: DataFrame, keys: Sequence[str], seq: str | None = None,
           partition_by: Sequence[str] = ()) -> DataFrame:
    """Last write wins per key over the whole table: the batch beats stored rows, wherever they lie;
    inside the batch the largest ``seq`` wins.

    With ``partition_by`` a key index (key to partition folder) tells where the batch's keys lie now.
    The folders that the batch goes to and those that it leaves are read back, merged and rewritten as
    one version; null partition values are a folder like others.  Before the commit every key of the
    batch and of the folders read must be staged once, and by the index the table must hold as many
    rows as keys.  Keys are taken as non-null.  Returns the new content of the table.
    """
    keys, partition_by = list(keys), list(partition_by)
    table = VersionedTable(spark, target)
    base = table.current()
    last = _keep_last(batch, keys, [seq] if seq else []).select(*batch.columns)
    folder = scratch_path(spark, "upsert-batch")
    write_table(last, folder, partition_by)
    batch = spark.read.schema(last.schema).parquet(folder).select(*last.columns)
    names, schema = list(batch.columns), batch.schema
    merged, want, touched, index, moved, fresh = batch, batch.select(*keys), [], None, None, 0
    keyed = KeyIndex(table, keys, partition_by)
    if base.files:
        stored = table.schema(base)
        names = stored.names + [c for c in names if c not in stored.names]
        if partition_by:
            index = base.index if keyed.usable(base) else keyed.build(base)
            now = keyed.located(spark.read.schema(batch.schema).parquet(folder), VersionedTable(spark, folder).root)
            was = keyed.holding(keyed.read(index).join(now.select(*keys), keys, "left_semi")).withColumnRenamed("_dir", "_was")
            moved = staged_table(now.join(was, keys, "left").where(~F.col("_dir").eqNullSafe(F.col("_was"))), "upsert-moved")
            fresh = moved.where("_was is null").count()
            # a row per folder that the batch touches
            dirs = {r[0] for r in now.select("_dir").distinct().unionByName(moved.where("_was is not null").select(F.col("_was").alias("_dir"))
                                                                            .distinct()).collect()}
            touched = [f for f in base.files if _dir(f) in dirs]
        else:
            touched = list(base.files)
        own = {f.name: f for f in batch.schema.fields if f.name in partition_by}  # not as a folder's name reads
        existing = table._read(touched, T.StructType([own.get(f.name, f) for f in stored.fields])) if touched else \
            spark.createDataFrame([], stored)
        merged = _merged(existing, batch, keys).select(*names)
        want = existing.select(*keys).unionByName(want)
        schema = merged.schema
    stage = _beside(target)
    write_table(merged, stage, partition_by)
    got = spark.read.schema(schema).parquet(stage).select(*keys, F.lit(1).alias("_got"), F.lit(0).alias("_want"))
    both = got.unionByName(want.select(*keys, F.lit(0).alias("_got"), F.lit(1).alias("_want")))
    wrong = both.groupBy(*keys).agg(F.sum("_got").alias("_got"), F.max("_want").alias("_want")).where("_got <> 1 or _want <> 1")
    if not wrong.isEmpty():
        raise RuntimeError("the staged upsert lost or repeated keys; target left unchanged")
    rows = VersionedTable(spark, stage)
    rows = rows._count(rows._visible())
    total = base.rows - sum(base.files[f] for f in touched) + sum(rows.values())
    if index is not None:
        if total != index["rows"] + fresh:
            raise RuntimeError("the table would not hold each key once; target left unchanged")
        index = keyed.extended(index, moved.select(*keys, "_dir"), base.number + 1, total)
    _replace(table, base, stage, touched, schema=T.StructType([T.StructField(f.name, f.dataType) for f in schema]), rows=rows, index=index)
    return table.read()


def merge_csv_backup(spark: SparkSession, path: str, batch: DataFrame,
                     keys: Sequence[str] = ("city", "timestamp")) -> DataFrame:
    """CSV backup: existing + new, one row per key (new wins), written whole, sorted by key."""
    from ..sources.payloads import read_store_csv
    keys = list(keys)
    merged = _keep_last(batch, keys, []).select(*batch.columns)
    if _exists(spark, path):
        existing = read_store_csv(spark, path)
        existing = existing.select(*[c for c in existing.columns if c in batch.columns or c in keys])
        merged = _merged(existing, merged, keys).select(*batch.columns)
    stage = _beside(path)
    (merged.repartitionByRange(*keys).sortWithinPartitions(*keys)
     .write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(stage))
    _replace_folder(spark, stage, path)
    return read_store_csv(spark, path)


def batched_write(df: DataFrame, path: str, batch_size: int = 100, fmt: str = "parquet",
                  order: Sequence[str] = ("timestamp", "city")) -> DataFrame:
    """Write in time order, ``batch_size`` rows a file; rows come from an ``Observation``, and
    batches are the files found afterwards.

    Rows are numbered without a global sort, and whole batches are dealt over the tasks.  Failed
    tasks are retried by Spark, so a batch is never silently skipped; the returned counts are
    what was committed.
    """
    spark = df.sparkSession
    numbered = global_row_number(df, [], order[0], list(order), out="_rn")
    batch = F.floor((F.col("_rn") - 1) / F.lit(batch_size))
    dealt = numbered.withColumn("_rn", batch).repartitionByRange("_rn").sortWithinPartitions("_rn").drop("_rn")
    obs = Observation("batched_write")
    dealt.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option(
        "maxRecordsPerFile", batch_size).format(fmt).save(path)
    rows = obs.get["rows"]
    fs, Path = _fs(spark, path)
    files = len(fs.globStatus(Path(f"{path}/part-*"))) if rows else 0
    return spark.createDataFrame([(int(rows), int(files), int(batch_size))],
                                 "rows BIGINT, batches BIGINT, batch_size INT")


LEDGER = "_ledger"
LEDGER_ROW = "run string, chunk long, attempt long, rows long, status string, error string"


def read_ledger(spark: SparkSession, path: str, run: str) -> DataFrame:
    """The last attempt of each chunk of a run: (run, chunk, attempt, rows, status, error)."""
    notes = spark.read.schema(LEDGER_ROW).json(f"{path.rstrip('/')}/{LEDGER}/*.json") if _fs_glob(spark, f"{path.rstrip('/')}/{LEDGER}/*.json") else \
        spark.createDataFrame([], LEDGER_ROW)
    last = notes.where(F.col("run") == run).groupBy("run", "chunk").agg(F.max_by(F.struct("attempt", "rows", "status", "error"), "attempt").alias("l"))
    return last.select("run", "chunk", "l.*")


def _fs_glob(spark: SparkSession, pattern: str) -> list:
    fs, Path = _fs(spark, pattern)
    return list(fs.globStatus(Path(pattern)) or [])


def _write_chunk(df: DataFrame, folder: str, fmt: str) -> None:
    df.write.mode("overwrite").format(fmt).save(folder)


def chunked_write(df: DataFrame, path: str, run: str, order: Sequence[str] = ("timestamp", "city"), chunk_rows: int = 100_000,
                  write=None, fmt: str = "parquet", side_by_side: int = 4) -> DataFrame:
    """Write in time order, ``chunk_rows`` rows to a chunk, each chunk for itself: one that fails is noted
    and the others go on.

    The chunks and their errors are kept in a ledger beside the data; a call with the same ``run``
    writes only the chunks that are not noted as committed, and returns the ledger.  ``write(df, folder)``
    puts a chunk down (default: overwrites the folder ``chunk=<n>``, so an attempt that broke off leaves
    nothing behind).  Rows are numbered by ``order`` and, among equals, by their values, so every call
    deals the same input alike; the numbered rows are staged once, by chunk.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    write = write or (lambda rows, folder: _write_chunk(rows, folder, fmt))
    tied = df.withColumn("_tie", F.xxhash64(*df.columns))
    numbered = global_row_number(tied, [], order[0], [*order, "_tie"], out="_rn").drop("_tie")
    numbered = numbered.withColumn("_chunk", F.floor((F.col("_rn") - 1) / F.lit(chunk_rows)).cast("long"))
    staged = scratch_path(spark, "chunks")
    numbered.repartition("_chunk").sortWithinPartitions("_chunk", "_rn").write.partitionBy("_chunk").parquet(staged)
    numbered = spark.read.schema(T.StructType([*numbered.schema.fields])).parquet(staged)
    sizes = {r["_chunk"]: r["count"] for r in numbered.groupBy("_chunk").count().collect()}  # a row per chunk
    done = {r["chunk"]: r for r in read_ledger(spark, path, run).collect()}
    todo = [c for c in sorted(sizes) if c not in done or done[c]["status"] != "committed"]
    fs, Path = _fs(spark, path)
    fs.mkdirs(Path(f"{path}/{LEDGER}"))

    def one(chunk: int) -> None:
        status, error = "committed", None
        try:
            write(numbered.where(F.col("_chunk") == chunk).drop("_chunk", "_rn"), f"{path}/chunk={chunk:06d}")
        except Exception as e:  # noqa: BLE001 - whatever the sink raises belongs to this chunk
            status, error = "failed", f"{type(e).__name__}: {e}"[:500]
        attempt = done[chunk]["attempt"] + 1 if chunk in done else 1
        note = {"run": run, "chunk": chunk, "attempt": attempt, "rows": sizes[chunk], "status": status, "error": error}
        out = fs.create(Path(f"{path}/{LEDGER}/{uuid.uuid4().hex}.json"))
        out.write(bytearray(json.dumps(note).encode()))
        out.close()

    with ThreadPoolExecutor(side_by_side) as pool:
        list(pool.map(inheritable_thread_target(spark)(one), todo))
    return read_ledger(spark, path, run)


def delete_where(spark: SparkSession, path: str, predicate, partition_by: Sequence[str] = ()) -> DataFrame:
    """Remove rows matching ``predicate`` (null counts as no match).

    Matching rows are counted per file first, with the predicate pushed into the scan, so partitions
    and row groups that can't match are not read.  Files of which all rows match leave the table as they
    are, files without a match stay untouched, and only the rest is rewritten."""
    table = VersionedTable(spark, path)
    base = table.current()
    df = table.read(version=base)
    hit = table.by_file(df.where(predicate))
    if not hit:
        return df
    mixed = [f for f, n in hit.items() if n < base.files[f]]
    stage = rows = None
    if mixed:
        stage = _beside(path)
        kept = table.read(mixed, base).where(~F.coalesce(predicate, F.lit(False)))
        folders = _partition_names(base)  # rows stay in their folders, whatever type its name reads as
        kept = kept.withColumns({p: table.folder_value(p) for p in folders}) if folders else kept
        write_table(kept, stage, folders or partition_by)
        rows = VersionedTable(spark, stage)
        rows = rows._count(rows._visible())
        if sum(rows.values()) != sum(base.files[f] - hit[f] for f in mixed):
            raise RuntimeError("the staged delete lost or repeated rows; target left unchanged")
    index = base.index
    if index:
        keyed = KeyIndex(table, index["keys"], index["partition_by"])
        gone = df.where(predicate).select(*keyed.keys, F.lit(None).cast("string").alias("_dir"))
        index = keyed.extended(index, gone, base.number + 1, base.rows - sum(hit.values()))
    _replace(table, base, stage, list(hit), schema=df.schema, rows=rows, index=index)
    return table.read()


def reload_table(spark: SparkSession, csv_path: str, target: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Typed reload: cast, sanitise, check zero bad values, then replace the whole table."""
    from ..sources.payloads import read_store_csv
    typed = sanitise(coerce_types(read_store_csv(spark, csv_path)))
    stage = _beside(target)
    write_table(typed, stage, partition_by)
    bad = bad_value_count(spark.read.parquet(stage)).first()["bad_values"]
    if bad:
        raise RuntimeError(f"{bad} NaN/Inf values after sanitising; target left unchanged")
    table = VersionedTable(spark, target)
    base = table.current()
    _replace(table, base, stage, list(base.files), schema=typed.schema)
    return table.read()


def save_importance(imp: DataFrame, path: str) -> None:
    """Feature importances, the largest first (one row per model feature)."""
    (imp.select("feature", "shap_value").orderBy(F.desc("shap_value"), "feature").coalesce(1)
     .write.mode("overwrite").option("header", True).csv(path))
