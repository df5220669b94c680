"""Analyst reports. Small results come from rollups; every top-k has a tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchtide.functions.expr import moment, since
from watchtide.functions.ranking import exact_percentiles

RANGES = {"1h": "1 HOUR", "4h": "4 HOURS", "24h": "24 HOURS", "7d": "7 DAYS", "30d": "30 DAYS"}
_HOURS = {"1h": 1, "4h": 4, "24h": 24, "7d": 168, "30d": 720}


def _recent(df: DataFrame, as_of, window: str | None, ts: str = "timestamp") -> DataFrame:
    return df if window is None else df.where(since(ts, as_of, window))


def top_k(df: DataFrame, keys: list[str], measure: Column, k: int, name: str = "cnt") -> DataFrame:
    """k largest groups; equal measures are ordered by key."""
    return df.groupBy(*keys).agg(measure.alias(name)).orderBy(F.desc(name), *keys).limit(k)


def counts(df: DataFrame, keys: list[str], as_of=None, window: str | None = None, where: Column | None = None, k: int | None = None) -> DataFrame:
    """Row counts by key in a time range, optionally the k largest."""
    df = _recent(df, as_of, window)
    if where is not None:
        df = df.where(where)
    if k is None:
        return df.groupBy(*keys).agg(F.count("*").alias("cnt")) if keys else df.agg(F.count("*").alias("cnt"))
    return top_k(df, keys, F.count("*"), k)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("cnt")).select(F.lit(name).alias("tbl"), "cnt")
        out = part if out is None else out.unionByName(part)
    return out


def ingest_rate(per_minute: DataFrame, per_10s: DataFrame, metrics: DataFrame, as_of) -> DataFrame:
    """Events per second from the first source that has any, in order of preference."""
    now = moment(as_of)
    full = per_minute.where((F.col("minute") >= now - F.expr("INTERVAL 2 MINUTES")) & (F.col("minute") < F.date_trunc("minute", now))).agg((F.sum("event_count") / 60).alias("t0"))
    bins = per_10s.where(since("ts", as_of, "5 MINUTES")).groupBy("ts").agg(F.sum("event_count").alias("n"))
    in_last = lambda s: F.col("ts") >= now - F.expr(f"INTERVAL {s} SECONDS")
    span = F.unix_timestamp(F.max(F.when(in_last(60), F.col("ts")))) - F.unix_timestamp(F.min(F.when(in_last(60), F.col("ts")))) + 10
    fine = bins.agg(
        (F.sum(F.when(in_last(10), F.col("n"))) / 10).alias("t1"),
        (F.sum(F.when(in_last(60), F.col("n"))) / F.greatest(F.lit(10), span)).alias("t2"),
        (F.avg("n") / 10).alias("t3"),
    )
    latest = metrics.where((F.col("metric") == "producer_eps") & since("ts", as_of, "5 MINUTES")).agg(F.max_by("value", "ts").alias("t4"))
    # one row each
    one = full.crossJoin(fine).crossJoin(latest)
    positive = [F.when(F.col(c) > 0, F.col(c)) for c in ("t0", "t2", "t3", "t1", "t4")]
    return one.select(F.coalesce(*positive, F.lit(0.0)).alias("eps"))


def active_alerts(hourly: DataFrame, as_of, rng: str = "24h", min_severity: int = 2) -> DataFrame:
    """Alerts in this period and the one before, with the change in percent; one scan."""
    now, h = moment(as_of), _HOURS[rng]
    this = F.col("hour") >= now - F.expr(f"INTERVAL {h} HOURS")
    rows = hourly.where((F.col("severity") >= min_severity) & (F.col("hour") >= now - F.expr(f"INTERVAL {2 * h} HOURS")))
    one = rows.agg(
        F.coalesce(F.sum(F.when(this, F.col("event_count"))), F.lit(0)).alias("active_alerts"),
        F.coalesce(F.sum(F.when(~this, F.col("event_count"))), F.lit(0)).alias("prev_alerts"),
    )
    trend = F.round((F.col("active_alerts") - F.col("prev_alerts")) / F.col("prev_alerts") * 100)
    return one.withColumn("trend_pct", F.when(F.col("prev_alerts") == 0, F.lit(0.0)).otherwise(trend))


def top_sources(per_minute: DataFrame, as_of, window: str = "24 HOURS", k: int = 10) -> DataFrame:
    return top_k(per_minute.where(since("minute", as_of, window)), ["source"], F.sum("event_count"), k)


def severity_distribution(hourly: DataFrame, as_of, window: str = "24 HOURS") -> DataFrame:
    return hourly.where(since("hour", as_of, window)).groupBy("severity").agg(F.sum("event_count").alias("cnt"))


def events_timeline(rollup: DataFrame, as_of, bucket: str, window: str) -> DataFrame:
    return rollup.where(since(bucket, as_of, window)).groupBy(F.col(bucket).alias("bucket")).agg(F.sum("event_count").alias("cnt"))


def mitre_top_techniques(security: DataFrame, as_of, window: str = "7 DAYS", k: int = 10) -> DataFrame:
    rows = _recent(security, as_of, window).where(F.col("mitre_technique") != "")
    return (
        rows.groupBy(F.col("mitre_technique").alias("technique"), F.col("mitre_tactic").alias("tactic"))
        .agg(F.count("*").alias("cnt"), F.max("severity").alias("max_severity"))
        .orderBy(F.desc("cnt"), "technique", "tactic").limit(k)
    )


def mitre_tactic_heatmap(security: DataFrame, as_of, window: str = "24 HOURS") -> DataFrame:
    return _recent(security, as_of, window).where(F.col("mitre_tactic") != "").groupBy(F.col("mitre_tactic").alias("tactic")).agg(
        F.count_distinct("mitre_technique").alias("techniques"), F.count("*").alias("alerts")
    )


def risky_entities(security: DataFrame, as_of, window: str = "24 HOURS", k: int = 8) -> DataFrame:
    """Users and hosts by weighted severity; both come from one scan."""
    weight = F.when(F.col("severity") == 4, 25).when(F.col("severity") == 3, 10).when(F.col("severity") == 2, 4).when(F.col("severity") == 1, 1).otherwise(0)
    both = F.array(
        F.struct(F.lit("user").alias("entity_type"), F.col("user_id").alias("entity")),
        F.struct(F.lit("host").alias("entity_type"), F.col("hostname").alias("entity")),
    )
    rows = _recent(security, as_of, window).select(weight.alias("weight"), F.inline(both)).where(F.col("entity") != "")
    return (
        rows.groupBy("entity", "entity_type").agg(F.sum("weight").alias("risk"), F.count("*").alias("cnt"))
        .orderBy(F.desc("risk"), "entity", "entity_type").limit(k)
    )


def risk_score(hourly: DataFrame, as_of, window: str = "24 HOURS") -> DataFrame:
    w = F.when(F.col("severity") == 4, 40).when(F.col("severity") == 3, 20).when(F.col("severity") == 2, 8).otherwise(2)
    one = hourly.where(since("hour", as_of, window)).agg(F.sum(F.col("event_count") * w).alias("w"), F.sum("event_count").alias("n"))
    return one.select(F.coalesce(F.least(F.lit(100.0), F.round(F.col("w") / F.col("n") * 2.5)), F.lit(0.0)).alias("risk_score"))


def mttr(security: DataFrame, as_of, window: str = "24 HOURS") -> DataFrame:
    spans = (
        _recent(security, as_of, window).where(F.col("severity") >= 3).groupBy("category")
        .agg(F.count("*").alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).where("n >= 2")
    )
    # seconds between the two clock readings, as whole-second boundaries crossed
    return spans.agg(F.coalesce(F.avg(F.unix_timestamp("b") - F.unix_timestamp("a")), F.lit(0.0)).alias("mttr_sec"))


def alert_summary(security: DataFrame, as_of, window: str = "24 HOURS") -> DataFrame:
    s = F.col("severity")
    return _recent(security, as_of, window).agg(
        F.count("*").alias("total"), F.count_if(s == 4).alias("critical"), F.count_if(s == 3).alias("high"), F.count_if(s == 2).alias("medium")
    )


def top_indicators(security: DataFrame, as_of, window: str = "7 DAYS", k: int = 15) -> DataFrame:
    rows = _recent(security, as_of, window).where((F.col("severity") >= 2) & (F.col("hostname") != ""))
    return rows.groupBy("hostname").agg(F.count("*").alias("hits"), F.max("severity").alias("max_severity")).orderBy(F.desc("hits"), "hostname").limit(k)


def attacks_by_hour(security: DataFrame, as_of, window: str = "24 HOURS", k: int = 50) -> DataFrame:
    rows = _recent(security, as_of, window).where((F.col("severity") >= 3) & (F.col("mitre_technique") != ""))
    return (
        rows.groupBy(F.date_trunc("hour", "timestamp").alias("hour"), F.col("mitre_technique").alias("technique")).agg(F.count("*").alias("cnt"))
        .orderBy(F.desc("hour"), F.desc("cnt"), "technique").limit(k)
    )


def evidence_summary(anchors: DataFrame) -> DataFrame:
    verified = F.count_if(F.col("status") == "Verified")
    return anchors.agg(
        F.count("*").alias("batches"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("events_anchored"),
        F.coalesce(F.avg("event_count"), F.lit(0.0)).alias("avg_batch_size"), verified.alias("verified"),
        F.coalesce(F.round(verified * 100 / F.count("*"), 2), F.lit(0.0)).alias("verified_pct"),
    )


def net_top_bytes(network: DataFrame, key: str, as_of, window: str = "24 HOURS", k: int = 10) -> DataFrame:
    return top_k(_recent(network, as_of, window), [key], F.sum("bytes_sent"), k, "total")


def scenario_report(scored: DataFrame, scenario: Column, other: str = "other") -> DataFrame:
    s = scored.withColumn("scenario", scenario)
    p95 = exact_percentiles(s, ["scenario"], "combined_score", {"p95": 0.95}).withColumn("p95", F.round("p95", 4))
    avg4 = lambda c: F.round(F.avg(c), 4)
    return (
        s.groupBy("scenario").agg(
            F.count("*").alias("cnt"), avg4("combined_score").alias("avg_combined"), avg4("lgbm_score").alias("avg_lgbm"),
            avg4("eif_score").alias("avg_eif"), avg4("arf_score").alias("avg_arf"), F.round(F.min("combined_score"), 4).alias("min_score"),
            F.round(F.max("combined_score"), 4).alias("max_score"),
            F.count_if(F.col("action") == "discard").alias("n_discard"), F.count_if(F.col("action") == "monitor").alias("n_monitor"),
            F.count_if(F.col("action") == "escalate").alias("n_escalate"),
        ).where(F.col("scenario") != other).join(p95, "scenario")
    )


def top_scored_events(scored: DataFrame, k: int = 10) -> DataFrame:
    return scored.select("event_id", "hostname", "source_ip", "combined_score", "action").orderBy(F.desc("combined_score"), "event_id").limit(k)


def recent_alerts(security: DataFrame, as_of, window: str = "24 HOURS", min_severity: int = 2, k: int = 100) -> DataFrame:
    rows = _recent(security, as_of, window).where(F.col("severity") >= min_severity)
    return rows.select("event_id", "timestamp", "severity", "category", "description", "hostname", "mitre_technique").orderBy(F.desc("timestamp"), "event_id").limit(k)


def evidence_chain_list(anchors: DataFrame, k: int = 1000) -> DataFrame:
    return (
        anchors.withColumn("file_name", F.element_at(F.split("s3_key", "/"), -1)).drop("s3_key")
        .orderBy(F.desc("time_from"), "table_name", "batch_id").limit(k)
    )


def data_integrity_check(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Found against expected rows per table and tag; missing groups count as zero."""
    got = found.groupBy(*keys).agg(F.count("*").alias("found"))
    loss = (F.col("expected") - F.col("found")) * 100.0 / F.col("expected")
    return (
        expected.join(got, keys, "left").withColumn("found", F.coalesce("found", F.lit(0)))
        .withColumn("loss_pct", F.when(F.col("expected") > 0, loss).otherwise(0.0))
        .withColumn("passed", (F.col("found") >= F.col("expected")).cast("int"))
    )


def dashboard_metrics(raw: DataFrame, security: DataFrame, process: DataFrame, network: DataFrame, anchors: DataFrame, metrics: DataFrame, as_of, rng: str = "24h") -> dict[str, DataFrame]:
    """Every figure of the dashboard, by name; the caller may persist the rollups it shares."""
    from watchtide.operators import rollups as A

    window = RANGES[rng]
    feed = A.event_feed(raw, security, process, network)
    minute, ten, hourly = A.events_per_minute(feed), A.events_per_10s(feed), A.security_severity_hourly(security)
    return {
        "table_counts": table_counts({"raw_logs": raw, "security_events": security, "process_events": process, "network_events": network}), "ingest_rate": ingest_rate(minute, ten, metrics, as_of),
        "active_alerts": active_alerts(hourly, as_of, rng), "top_sources": top_sources(minute, as_of, window), "severity_distribution": severity_distribution(hourly, as_of, window), "events_timeline": events_timeline(ten, as_of, "ts", "6 HOURS"),
        "critical_alert_count": counts(security, [], as_of, "1 HOUR", F.col("severity") >= 3), "mitre_top_techniques": mitre_top_techniques(security, as_of), "mitre_tactic_heatmap": mitre_tactic_heatmap(security, as_of, window),
        "risky_entities": risky_entities(security, as_of, window), "risk_score": risk_score(hourly, as_of, window), "mttr": mttr(security, as_of, window), "evidence_summary": evidence_summary(anchors),
    }


def soc_report(raw: DataFrame, security: DataFrame, process: DataFrame, network: DataFrame, anchors: DataFrame, as_of) -> dict[str, DataFrame]:
    return {
        "summary": alert_summary(security, as_of, "7 DAYS"), "tables": table_counts({"raw_logs": raw, "security_events": security, "process_events": process, "network_events": network}), "evidence": evidence_summary(anchors),
        "categories": counts(security, ["category"], as_of, "7 DAYS", k=10), "severities": counts(security, ["severity"], as_of, "7 DAYS"), "recent_alerts": recent_alerts(security, as_of, "7 DAYS", 3, 50), "techniques": mitre_top_techniques(security, as_of, k=20),
    }


def threat_intel_report(security: DataFrame, as_of) -> dict[str, DataFrame]:
    return {"techniques": mitre_top_techniques(security, as_of, k=20), "indicators": top_indicators(security, as_of), "attacks_by_hour": attacks_by_hour(security, as_of)}


def long_report(sections: dict[str, DataFrame]) -> DataFrame:
    """Sections as rows of (section, row) with each row as JSON, for one export file."""
    out = None
    for name, df in sections.items():
        part = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out
