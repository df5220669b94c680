"""Time-bucketed rollups. Each is one partial + final aggregation and can be merged again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchtide.functions.expr import moment, since


def _minute_part(df: DataFrame, source: Column, level: Column, ts: str) -> DataFrame:
    return df.select(F.col(ts).alias("timestamp"), source.alias("source"), level.alias("level"))


def event_feed(raw: DataFrame, security: DataFrame, process: DataFrame, network: DataFrame, ts: str = "timestamp") -> DataFrame:
    """The four tables as (timestamp, source, level), the common input of the rate rollups."""
    return (
        _minute_part(raw, F.col("source"), F.col("level"), ts)
        .unionByName(_minute_part(security, F.col("source"), F.col("category"), ts))
        .unionByName(_minute_part(process, F.lit("process"), F.when(F.col("is_suspicious") == 1, "SUSPICIOUS").otherwise("NORMAL"), ts))
        .unionByName(_minute_part(network, F.col("protocol"), F.col("direction"), ts))
    )


def events_per_minute(feed: DataFrame) -> DataFrame:
    return feed.groupBy(F.date_trunc("minute", "timestamp").alias("minute"), "source", "level").agg(
        F.count("*").alias("event_count")
    )


def events_per_10s(feed: DataFrame) -> DataFrame:
    return feed.groupBy(F.window("timestamp", "10 seconds").start.alias("ts"), "source").agg(
        F.count("*").alias("event_count")
    )


def security_severity_hourly(security: DataFrame) -> DataFrame:
    return security.groupBy(F.date_trunc("hour", "timestamp").alias("hour"), "category", "severity").agg(
        F.count("*").alias("event_count")
    )


def entity_actions(security: DataFrame, network: DataFrame, process: DataFrame) -> DataFrame:
    """Rows of (timestamp, source_ip, user_id, hostname, action, low, high) from three tables."""
    flag = F.when(F.col("is_suspicious") == 1, 4).otherwise(0)
    return (
        security.select("timestamp", F.col("ip_address").alias("source_ip"), "user_id", "hostname",
                        F.col("category").alias("action"), F.col("severity").cast("int").alias("low"), F.col("severity").cast("int").alias("high"))
        .unionByName(network.select("timestamp", F.col("src_ip").alias("source_ip"), F.lit("").alias("user_id"), "hostname",
                                    F.col("protocol").alias("action"), F.lit(0).alias("low"), flag.alias("high")))
        .unionByName(process.select("timestamp", F.lit("").alias("source_ip"), F.col("uid").cast("string").alias("user_id"), "hostname",
                                    F.col("binary_path").alias("action"), F.lit(0).alias("low"), flag.alias("high")))
    )


def entity_freq(actions: DataFrame, sketch: bool = False) -> DataFrame:
    """Per minute and entity. ``sketch`` keeps a mergeable HLL state instead of the exact count."""
    distinct = F.hll_sketch_agg("action").alias("actions_sketch") if sketch else F.count_distinct("action").alias("unique_actions")
    return actions.groupBy(F.date_trunc("minute", "timestamp").alias("window_start"), "source_ip", "user_id", "hostname").agg(
        F.count("*").alias("event_count"), distinct, F.min("low").alias("min_severity"), F.max("high").alias("max_severity")
    )


def merge_entity_freq(parts: DataFrame) -> DataFrame:
    """Merge partial rows of ``entity_freq(sketch=True)``."""
    return parts.groupBy("window_start", "source_ip", "user_id", "hostname").agg(
        F.sum("event_count").alias("event_count"),
        F.hll_sketch_estimate(F.hll_union_agg("actions_sketch")).alias("unique_actions"),
        F.min("min_severity").alias("min_severity"), F.max("max_severity").alias("max_severity"),
    )


def template_rarity_table(events: DataFrame) -> DataFrame:
    return events.groupBy("template_id", "source_type").agg(
        F.count("*").alias("occurrence_count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")
    )


def entity_baseline_hourly(security: DataFrame) -> DataFrame:
    """Per entity and hour of day: days seen, mean and variance of the hourly counts."""
    per_day = security.groupBy("user_id", "hostname", F.date_trunc("hour", "timestamp").alias("hour")).agg(F.count("*").alias("c"))
    n, s, q = F.col("day_count"), F.col("event_sum"), F.col("event_sum_sq")
    return (
        per_day.groupBy("user_id", "hostname", F.hour("hour").alias("hour_of_day"))
        .agg(F.count("*").alias("day_count"), F.sum("c").alias("event_sum"), F.sum(F.col("c") * F.col("c")).alias("event_sum_sq"))
        .withColumn("mean_count", s / n)
        .withColumn("var_count", q / n - (s / n) * (s / n))
    )


def triage_score_rollup(scored: DataFrame) -> DataFrame:
    return scored.groupBy(F.date_trunc("hour", "timestamp").alias("hour"), "source_type", "action").agg(
        F.count("*").alias("event_count"), F.sum("combined_score").alias("score_sum"), F.max("combined_score").alias("score_max")
    )


def feature_staleness(tables: dict[str, tuple[DataFrame, str]], as_of, limit_s: int = 300) -> DataFrame:
    """Age of the newest row per table; one row each."""
    parts = [df.agg(F.max(ts).alias("max_ts")).select(F.lit(name).alias("table_name"), "max_ts") for name, (df, ts) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    age = F.unix_timestamp(moment(as_of)) - F.unix_timestamp("max_ts")
    return out.select("table_name", "max_ts", age.alias("staleness_seconds"), (age > limit_s).cast("int").alias("is_stale"))


def spc_baseline(actions: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Mean and sample deviation of the per-minute counts of an entity."""
    per_minute = (
        actions.where(since("timestamp", as_of, f"{hours} HOURS"))
        .groupBy("hostname", "source_ip", F.date_trunc("minute", "timestamp").alias("minute"))
        .agg(F.count("*").alias("c"))
    )
    return per_minute.groupBy("hostname", "source_ip").agg(
        F.avg("c").alias("baseline_mean"), F.coalesce(F.stddev_samp("c"), F.lit(0.0)).alias("baseline_stddev")
    )


def host_network_context(network: DataFrame, hop_cap: int = 5) -> DataFrame:
    return network.groupBy("hostname").agg(
        F.count("*").alias("event_count"), F.count_distinct("dst_ip").alias("unique_destinations"),
        F.count_distinct("src_ip").alias("unique_src_ips"), F.count_distinct("dst_port").alias("unique_ports"),
    ).withColumn("hop_count", F.least("unique_destinations", F.lit(hop_cap)))


def host_score_history(scored: DataFrame) -> DataFrame:
    s = F.col("adjusted_score")
    esc = F.count_if(F.col("action") == "escalate")
    return scored.groupBy("hostname").agg(
        esc.alias("escalation_count"), F.avg(s).alias("mean_score"), F.count("*").alias("event_count"),
        F.count_if(s >= 0.90).alias("high_severity_count"), F.count_if((s >= 0.80) & (s < 0.90)).alias("medium_severity_count"),
        F.greatest(esc - 1, F.lit(0)).alias("correlated_alert_count"),
    )
