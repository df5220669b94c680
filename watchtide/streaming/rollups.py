"""Rollups kept up to date by Structured Streaming, equal to the batch ones.

Every micro-batch writes the partial aggregates of its own rows below its batch id; readers add them up. There is no
state that could expire, so a late row changes its rollup like any other; it is also kept apart as late.
"""

from __future__ import annotations

from collections.abc import Callable

from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession, functions as F

DELAY = "10 minutes"
#: Batches after which parts are folded into a base.
COMPACT_EVERY = 16


def events_per_minute(feed: DataFrame) -> DataFrame:
    return feed.groupBy(F.window("timestamp", "1 minute").start.alias("minute"), "source", "level").agg(F.count("*").alias("event_count"))


def events_per_10s(feed: DataFrame) -> DataFrame:
    return feed.groupBy(F.window("timestamp", "10 seconds").start.alias("ts"), "source").agg(F.count("*").alias("event_count"))


def severity_hourly(security: DataFrame) -> DataFrame:
    return security.groupBy(F.window("timestamp", "1 hour").start.alias("hour"), "category", "severity").agg(F.count("*").alias("event_count"))


def entity_freq(actions: DataFrame) -> DataFrame:
    """Distinct actions as a mergeable sketch."""
    return actions.groupBy(F.window("timestamp", "1 minute").start.alias("window_start"), "source_ip", "user_id", "hostname").agg(
        F.count("*").alias("event_count"), F.hll_sketch_agg("action").alias("actions_sketch"), F.min("low").alias("min_severity"), F.max("high").alias("max_severity"))


def merged_counts(parts: DataFrame) -> DataFrame:
    """Partial rows of one key as one: event_count is a sum, all else is the key."""
    return parts.groupBy(*[c for c in parts.columns if c != "event_count"]).agg(F.sum("event_count").alias("event_count"))


def merged_entity_freq(parts: DataFrame) -> DataFrame:
    """Partial rows of `entity_freq` as one, with the sketch still open."""
    return parts.groupBy("window_start", "source_ip", "user_id", "hostname").agg(
        F.sum("event_count").alias("event_count"), F.hll_union_agg("actions_sketch").alias("actions_sketch"), F.min("min_severity").alias("min_severity"), F.max("max_severity").alias("max_severity"))


def _numbers(path: str, name: str, whole: bool = True) -> list[int]:
    """Numbers of the folders `name=...` below a path, in order; `whole` ones only are those whose writer has ended."""
    system, place = files.FileSystem.from_uri(path)
    found = system.get_file_info(files.FileSelector(place, allow_not_found=True))
    numbers = sorted(int(x.base_name[len(name) + 1 :]) for x in found if x.base_name.startswith(f"{name}="))
    if not whole:
        return numbers
    marks = system.get_file_info([f"{place}/{name}={n}/_SUCCESS" for n in numbers])
    return [n for n, m in zip(numbers, marks) if m.type == files.FileType.File]


def _remove(path: str) -> None:
    system, place = files.FileSystem.from_uri(path)
    system.delete_dir(place)


def _folders(path: str, before: int | None = None) -> list[str]:
    """Folders that make up the rollup: the newest whole base, and the parts after it (of batches before one)."""
    fits = lambda n: before is None or n < before
    bases = [n for n in _numbers(f"{path}/base", "upto") if fits(n)]
    upto = bases[-1] if bases else -1
    parts = [n for n in _numbers(f"{path}/parts", "batch") if n > upto and fits(n)]
    return ([f"{path}/base/upto={upto}"] if bases else []) + [f"{path}/parts/batch={n}" for n in parts]


def compact(spark: SparkSession, path: str, batch_id: int, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Fold the base and all parts of earlier batches into a new base.

    A base counts once its writer has ended, so a compaction that is cut off changes nothing and is written anew. What the
    base before the last one covers is removed: readers that began before still find what they listed.
    """
    upto = batch_id - 1
    folders = _folders(path, batch_id)
    if len(folders) > 1:
        merge(spark.read.parquet(*folders)).write.mode("overwrite").parquet(f"{path}/base/upto={upto}")
    bases = _numbers(f"{path}/base", "upto")
    if len(bases) > 1:
        for n in bases[:-2]:
            _remove(f"{path}/base/upto={n}")
        for n in _numbers(f"{path}/parts", "batch", whole=False):
            if n <= bases[-2]:
                _remove(f"{path}/parts/batch={n}")


def keep_rollup(rows: DataFrame, rollup: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, ts: str = "timestamp", delay: str = DELAY, merge: Callable[[DataFrame], DataFrame] | None = None, every: int = COMPACT_EVERY, **trigger):
    """Write the partial rollup of every micro-batch, and its late rows: those older than all batches before by more than the delay.

    Everything lies below the batch id, so a batch that is tried again replaces what it wrote. With `merge`, every so many batches
    the parts are folded into one base, so a reader lists no more than twice as many folders however long the stream runs. The
    newest time so far is one row, carried on from batch to batch.
    """
    spark = rows.sparkSession
    newest = "seen timestamp"

    def work(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if merge is not None and batch_id and batch_id % every == 0:
                compact(spark, path, batch_id, merge)
            rollup(batch).write.mode("overwrite").parquet(f"{path}/parts/batch={batch_id}")
            marks = [n for n in _numbers(f"{path}/marks", "batch") if n < batch_id]
            before = spark.read.schema(newest).parquet(f"{path}/marks/batch={marks[-1]}") if marks else spark.createDataFrame([], newest)
            limit = before.agg((F.max("seen") - F.expr(f"INTERVAL {delay}")).alias("_limit"))
            batch.crossJoin(F.broadcast(limit)).where(F.col(ts) < F.col("_limit")).drop("_limit").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")  # one row
            batch.select(F.col(ts).alias("seen")).unionByName(before).agg(F.max("seen").alias("seen")).coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")
            for n in marks[:-1]:
                _remove(f"{path}/marks/batch={n}")
        finally:
            batch.unpersist()

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(work).trigger(**(trigger or {"availableNow": True})).start()


def read_rollup(spark: SparkSession, path: str, keys: list[str], total: str = "event_count") -> DataFrame:
    """Counts over all batches."""
    return read_parts(spark, path).groupBy(*keys).agg(F.sum(total).alias(total))


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(*_folders(path))


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/late").drop("batch")


def stream_dedup(rows: DataFrame, path: str, checkpoint: str, key: str = "event_id", ts: str = "timestamp", **trigger):
    """Each key of a day once, however late a copy comes; copies of an event have the same time.

    Rows newer than everything seen so far have no earlier copy and are not compared. The others are compared with the keys
    written on their own days only, whose folders are read by name; so a batch costs what it has itself and what its late rows'
    days hold, not what the stream has written.
    """
    spark = rows.sparkSession
    columns = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields], "day date", "batch long"])
    newest = "seen timestamp"

    def work(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("day", F.to_date(ts)).dropDuplicates(["day", key]).withColumn("batch", F.lit(batch_id).cast("long")).persist()
        try:
            marks = [n for n in _numbers(f"{path}/_seen", "batch") if n < batch_id]
            seen = spark.read.schema(newest).parquet(f"{path}/_seen/batch={marks[-1]}").first()["seen"] if marks else None
            old = batch.where(F.lit(False)) if not marks else batch.where(F.col(ts).isNull() | (F.col(ts) <= F.lit(seen))) if seen else batch
            days = [r["day"] for r in old.select("day").distinct().collect()]  # as many as the late rows have
            system, place = files.FileSystem.from_uri(path)
            named = [f"day={d or '__HIVE_DEFAULT_PARTITION__'}" for d in days]
            there = [n for n, i in zip(named, system.get_file_info([f"{place}/{n}" for n in named])) if i.type == files.FileType.Directory]
            new = batch
            if there:
                before = spark.read.schema(columns).option("basePath", path).parquet(*[f"{path}/{n}" for n in there]).where(F.col("batch") < batch_id)
                known = before.select(F.col("day").alias("_day"), F.col(key).alias("_key"))
                new = batch.join(known, F.col("day").eqNullSafe(F.col("_day")) & F.col(key).eqNullSafe(F.col("_key")), "left_anti")
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
            top = batch.agg(F.max(ts).alias("seen"))
            if seen:
                top = top.select(F.greatest("seen", F.lit(seen)).alias("seen"))
            top.coalesce(1).write.mode("overwrite").parquet(f"{path}/_seen/batch={batch_id}")
            for n in marks[:-1]:
                _remove(f"{path}/_seen/batch={n}")
        finally:
            batch.unpersist()

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(work).trigger(**(trigger or {"availableNow": True})).start()
