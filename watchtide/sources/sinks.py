"""Outputs: partitioned tables, keyed messages, exports and retention."""

from __future__ import annotations

from datetime import date

from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession, functions as F

from watchtide.functions.expr import moment

SORT_KEYS = {
    "raw_logs": ["source", "level", "timestamp"], "security_events": ["severity", "category", "timestamp"],
    "process_events": ["hostname", "timestamp"], "network_events": ["hostname", "timestamp"],
}
# Days until a table moves to warm, cold, and is deleted; null means never.
RETENTION = [
    ("raw_logs", 7, 30, 90), ("security_events", 7, 30, 180), ("process_events", 7, 30, 90), ("network_events", 7, 30, 90),
    ("triage_scores", 7, 30, 90), ("hunter_investigations", 7, 30, 365), ("verifier_results", 7, 30, 365), ("evidence_anchors", 7, 30, 365),
]


def write_table(df: DataFrame, path: str, table: str, batch_id: int | None = None, ts: str = "timestamp", mode: str = "append") -> None:
    """Append one batch, partitioned by day and sorted for skipping.

    A batch id gives the batch a folder of its own, which a retry overwrites: no duplicates.
    """
    df = df.withColumn("event_date", F.to_date(ts))
    keys = [k for k in SORT_KEYS.get(table, []) if k in df.columns]
    if keys:
        df = df.sortWithinPartitions("event_date", *keys)
    target = f"{path}/{table}"
    if batch_id is not None:
        target, mode = f"{target}/batch={batch_id}", "overwrite"
    df.write.mode(mode).partitionBy("event_date").parquet(target)


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{table}").drop("batch", "event_date")


def keyed_messages(df: DataFrame, key: str) -> DataFrame:
    """(key, value) rows for a message sink."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def message_sink(messages: DataFrame, kind: str, **options) -> None:
    """Write (key, value) messages to a topic of a message broker, or as JSON lines below a folder."""
    if kind == "kafka":
        messages.select("key", "value").write.format("kafka").option("kafka.bootstrap.servers", options["servers"]).option("topic", options["topic"]).save()
    elif kind == "json":
        messages.select("key", "value").write.mode(options.get("mode", "append")).json(options["path"])
    else:
        raise ValueError(f"unknown sink kind: {kind}")


def report_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def ndjson_export(df: DataFrame, path: str) -> None:
    """JSON lines; times keep their microseconds."""
    df.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def proof_documents(anchors: DataFrame, leaves: int = 5) -> DataFrame:
    """One JSON document per batch with its first leaves."""
    doc = F.struct("batch_id", F.col("table_name").alias("table"), "time_from", "time_to", "event_count", "merkle_root", "merkle_depth", "prev_merkle_root", F.col("event_count").alias("leaf_count"), F.slice("leaf_hashes", 1, leaves).alias("sample_leaves"))
    return anchors.select("batch_id", F.to_json(doc).alias("proof"))


def retention_policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RETENTION, "table_name string, warm_days int, cold_days int, delete_days int")


def retention_plan(partitions: DataFrame, policy: DataFrame, as_of) -> DataFrame:
    """Tier of every (table, day) partition."""
    age = F.datediff(F.to_date(moment(as_of)), F.col("event_date"))
    tier = (
        F.when(age >= F.col("delete_days"), "delete").when(age >= F.col("cold_days"), "cold")
        .when(age >= F.col("warm_days"), "warm").otherwise("hot")
    )
    return partitions.join(policy, "table_name").withColumn("age_days", age).withColumn("tier", tier).select("table_name", "event_date", "age_days", "tier")


TIERS = ("warm", "cold")


def _days(path: str, table: str) -> list[tuple[str, date]]:
    """Folder, relative to the path, and day of every day partition of a table, within batches or not."""
    system, place = files.FileSystem.from_uri(path)
    found = system.get_file_info(files.FileSelector(f"{place}/{table}", recursive=True, allow_not_found=True))
    days = [x.path for x in found if x.type == files.FileType.Directory and x.base_name.startswith("event_date=2")]
    return [(d[len(place) + 1 :], date.fromisoformat(d[-10:])) for d in days]


def apply_retention(spark: SparkSession, path: str, policy: DataFrame, as_of) -> DataFrame:
    """Bring every day of every table of the policy to its tier: whole partitions are moved below `tier=warm` and `tier=cold`, or removed.

    Only folders are touched, no rows are read. A folder is moved in one step, so a job that was cut off goes on where it
    was; days that are in their tier already stay. Returns (table_name, event_date, tier, folders) of what was there.
    """
    system, place = files.FileSystem.from_uri(path)
    places = {"hot": "", **{t: f"tier={t}/" for t in TIERS}}
    there = [(r["table_name"], day, home, rest) for r in policy.select("table_name").distinct().collect() for home in places.values() for rest, day in _days(path + (f"/{home[:-1]}" if home else ""), r["table_name"])]
    kinds = "table_name string, event_date date, home string, folder string"
    plan = spark.createDataFrame(there, kinds)
    tiers = retention_plan(plan.select("table_name", "event_date").distinct(), policy, as_of).select("table_name", "event_date", "tier")
    rows = plan.join(tiers, ["table_name", "event_date"]).collect()  # a row per folder
    for r in rows:
        source = f"{place}/{r['home']}{r['folder']}"
        if r["tier"] == "delete":
            system.delete_dir(source)
        elif places[r["tier"]] != r["home"]:
            target = f"{place}/{places[r['tier']]}{r['folder']}"
            if system.get_file_info(target).type == files.FileType.Directory:  # of a job that was cut off
                system.delete_dir(target)
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            system.move(source, target)
    return spark.createDataFrame([(r["table_name"], r["event_date"], r["tier"]) for r in rows], "table_name string, event_date date, tier string").groupBy("table_name", "event_date", "tier").agg(F.count("*").alias("folders"))
