"""Incremental loading: idempotent upserts by micro-batch, and the offset of the next sync.

An extension: late rows of any age are merged, so no watermark is set.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import upsert


BUCKETS, KEPT_VERSIONS = 64, 2


def _fs(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the versions that are whole, oldest first."""
    fs, path = _fs(spark, f"{root}/versions")
    names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [n for n in names if fs.exists(hadoop(f"{root}/versions/{n}/_SUCCESS"))]


def _folders(spark: SparkSession, root: str, version: str) -> dict[int, str]:
    """Of a version the folder of each bucket; a row a bucket."""
    rows = spark.read.schema("bucket int, folder string").parquet(f"{root}/versions/{version}").collect()
    return {r["bucket"]: r["folder"] for r in rows}


def _read(spark: SparkSession, root: str, folders: dict[int, str], schema: str) -> DataFrame:
    paths = [f"{root}/data/{folder}/bucket={b}" for b, folder in sorted(folders.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The newest version of the table below ``root``; empty before the first."""
    versions = _versions(spark, root)
    return _read(spark, root, _folders(spark, root, versions[-1]) if versions else {}, schema)


def merge_batch(batch: DataFrame, number: int, root: str, schema: str, key: str, version: str, source: str, trusted: str = "api", buckets: int = BUCKETS) -> None:
    """Merge rows into the table: only the buckets of their keys are read and written anew, and a version names each bucket's folder.

    Versions before the last ``KEPT_VERSIONS`` and the folders that only they name are deleted.
    """
    spark = batch.sparkSession
    of_key = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    batch = batch.withColumn("bucket", of_key).persist()
    try:
        touched = [r[0] for r in batch.select("bucket").distinct().collect()]
        versions = _versions(spark, root)
        folders = _folders(spark, root, versions[-1]) if versions else {}
        old = _read(spark, root, {b: f for b, f in folders.items() if b in touched}, schema).withColumn("bucket", of_key)
        merged = upsert(old, batch.select(old.columns), key, version, source, trusted)
        if touched:
            folder = uuid.uuid4().hex
            merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/data/{folder}")
            folders |= dict.fromkeys(touched, folder)
    finally:
        batch.unpersist()
    rows = spark.createDataFrame(sorted(folders.items()), "bucket int, folder string")
    rows.coalesce(1).write.parquet(f"{root}/versions/v{number:010d}-{uuid.uuid4().hex[:8]}")
    _clean(spark, root)


def _clean(spark: SparkSession, root: str) -> None:
    versions = _versions(spark, root)
    named = {v: {(b, f) for b, f in _folders(spark, root, v).items()} for v in versions}
    kept = set().union(*(named[v] for v in versions[-KEPT_VERSIONS:])) if versions else set()
    fs, _ = _fs(spark, root)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for v in versions[:-KEPT_VERSIONS]:
        for b, f in named[v] - kept:
            fs.delete(hadoop(f"{root}/data/{f}/bucket={b}"), True)
        fs.delete(hadoop(f"{root}/versions/{v}"), True)


def upsert_stream(stream: DataFrame, root: str, checkpoint: str, schema: str, key: str, version: str, source: str, trusted: str = "api") -> StreamingQuery:
    """Merge each micro-batch into the table below ``root``; a batch that is run again gives the same table."""

    def merge(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, root, schema, key, version, source, trusted)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_from(log: DataFrame, rows: DataFrame, overlap_hours: int = 1, days: int = 2):
    """Where the next sync starts: an hour before the start of the last completed run, else the newest update seen, else ``days`` ago."""
    run = log.where("completed_at IS NOT NULL").agg(F.max("started_at").alias("t")).select((F.col("t") - F.expr(f"INTERVAL {overlap_hours} HOURS")).alias("t"))
    seen = rows.agg(F.max("last_updated").alias("u"))
    return run.crossJoin(seen).select(F.coalesce("t", "u", F.current_timestamp() - F.expr(f"INTERVAL {days} DAYS")).alias("since")).first()["since"]


def logged_sync(spark: SparkSession, log: str, run: str, work) -> None:
    """Do ``work()`` between two rows of the run log: one that it started, and one, once it is done, that it is complete."""
    row = lambda done: spark.range(1).select(F.lit(run).alias("run"), F.current_timestamp().alias("at"), F.lit(done).alias("completed"))
    row(False).write.mode("append").parquet(log)
    work()
    row(True).write.mode("append").parquet(log)


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """Runs with started_at and completed_at (null while a run goes on or after it failed)."""
    rows = spark.read.schema("run string, at timestamp, completed boolean").parquet(log)
    return rows.groupBy("run").agg(F.min(F.when(~F.col("completed"), F.col("at"))).alias("started_at"), F.max(F.when(F.col("completed"), F.col("at"))).alias("completed_at"))


def quota(calls: DataFrame, at: str, daily: int, kept_days: int = 30) -> DataFrame:
    """Calls used and left by day, for the last ``kept_days`` days that were seen."""
    day = F.to_date(at)
    last = calls.agg(F.max(day).alias("_last"))
    rows = calls.select(day.alias("_day")).crossJoin(F.broadcast(last)).where(F.col("_day") >= F.date_sub("_last", kept_days))
    used = F.count(F.lit(1))
    return rows.groupBy(F.date_format("_day", "yyyy-MM-dd").alias("day")).agg(used.alias("used"), F.greatest(F.lit(daily) - used, F.lit(0)).alias("remaining"))
