"""Rollups, reports, search, sorting and set operations over the event views."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchtide.operators import reports as R, rollups as A, search as P
from watchtide.plans.registry import query
from watchtide.sources.views import AS_OF, Tables

T0 = f"TIMESTAMP '{AS_OF}'"


def feed(t: Tables):
    return A.event_feed(t.raw, t.security, t.process, t.network)


FEED = """feed AS (SELECT timestamp, source, level FROM fx_raw UNION ALL SELECT timestamp, source, category FROM fx_security
 UNION ALL SELECT timestamp, 'process', CASE WHEN is_suspicious = 1 THEN 'SUSPICIOUS' ELSE 'NORMAL' END FROM fx_process
 UNION ALL SELECT timestamp, protocol, direction FROM fx_network)"""
PER_10S = "time_bucket(INTERVAL 10 SECOND, timestamp)"


@query("events_per_minute", f"""WITH {FEED} SELECT CAST(date_trunc('minute', timestamp) AS VARCHAR) AS minute, source, level, count(*) AS event_count FROM feed GROUP BY ALL""")
def events_per_minute(t):
    return A.events_per_minute(feed(t))


@query("events_per_10s", f"""WITH {FEED} SELECT CAST({PER_10S} AS VARCHAR) AS ts, source, count(*) AS event_count FROM feed GROUP BY ALL""")
def events_per_10s(t):
    return A.events_per_10s(feed(t))


@query("security_severity_hourly", """SELECT CAST(date_trunc('hour', timestamp) AS VARCHAR) AS hour, category, CAST(severity AS BIGINT) AS severity, count(*) AS event_count FROM fx_security GROUP BY ALL""")
def security_severity_hourly(t):
    return A.security_severity_hourly(t.security)


ACTIONS = """actions AS (SELECT timestamp, ip_address AS source_ip, user_id, hostname, category AS action, severity AS low, severity AS high FROM fx_security
 UNION ALL SELECT timestamp, src_ip, '', hostname, protocol, 0, CASE WHEN is_suspicious = 1 THEN 4 ELSE 0 END FROM fx_network
 UNION ALL SELECT timestamp, '', CAST(uid AS VARCHAR), hostname, binary_path, 0, CASE WHEN is_suspicious = 1 THEN 4 ELSE 0 END FROM fx_process)"""


def actions(t: Tables):
    return A.entity_actions(t.security, t.network, t.process)


@query("entity_freq", f"""WITH {ACTIONS} SELECT CAST(date_trunc('minute', timestamp) AS VARCHAR) AS window_start, source_ip, user_id, hostname, count(*) AS event_count,
 count(DISTINCT action) AS unique_actions, CAST(min(low) AS BIGINT) AS min_severity, CAST(max(high) AS BIGINT) AS max_severity FROM actions GROUP BY ALL""")
def entity_freq(t):
    return A.entity_freq(actions(t))


ENTITY_FREQ = f"""WITH {ACTIONS} SELECT CAST(date_trunc('minute', timestamp) AS VARCHAR) AS window_start, source_ip, user_id, hostname, count(*) AS event_count,
 count(DISTINCT action) AS unique_actions, CAST(min(low) AS BIGINT) AS min_severity, CAST(max(high) AS BIGINT) AS max_severity FROM actions GROUP BY ALL"""


# a sketch counts a few values without error
@query("entity_freq_merged", ENTITY_FREQ)
def entity_freq_merged(t):
    """Per-table partial states with sketches, merged like an incremental run does."""
    return A.merge_entity_freq(A.entity_freq(actions(t), sketch=True))


@query("template_rarity_table", """SELECT template_id, source_type, count(*) AS occurrence_count, CAST(min(timestamp) AS VARCHAR) AS first_seen, CAST(max(timestamp) AS VARCHAR) AS last_seen FROM fx_scores GROUP BY ALL""")
def template_rarity_table(t):
    return A.template_rarity_table(t.scores)


@query("entity_baseline_hourly", """WITH h AS (SELECT user_id, hostname, date_trunc('hour', timestamp) AS hr, count(*) AS c FROM fx_security GROUP BY ALL)
SELECT user_id, hostname, CAST(hour(hr) AS BIGINT) AS hour_of_day, count(*) AS day_count, CAST(sum(c) AS BIGINT) AS event_sum, CAST(sum(c*c) AS BIGINT) AS event_sum_sq,
 round(sum(c)::DOUBLE / count(*), 6) AS mean_count, round(sum(c*c)::DOUBLE / count(*) - (sum(c)::DOUBLE / count(*)) * (sum(c)::DOUBLE / count(*)), 6) AS var_count FROM h GROUP BY user_id, hostname, hour(hr)""")
def entity_baseline_hourly(t):
    return A.entity_baseline_hourly(t.security)


@query("feature_staleness", f"""SELECT table_name, CAST(max_ts AS VARCHAR) AS max_ts, CAST(date_diff('second', date_trunc('second', max_ts), {T0}) AS BIGINT) AS staleness_seconds,
 CAST(date_diff('second', date_trunc('second', max_ts), {T0}) > 300 AS BIGINT) AS is_stale FROM (
 SELECT 'features_entity_freq' AS table_name, max(date_trunc('minute', timestamp)) AS max_ts FROM fx_security
 UNION ALL SELECT 'features_template_rarity', max(timestamp) FROM fx_scores UNION ALL SELECT 'events_per_10s', max({PER_10S}) FROM fx_raw)""")
def feature_staleness(t):
    # a maximum of bucket starts is the bucket of the maximum, so no rollup is rebuilt
    sec = t.security.select(F.date_trunc("minute", "timestamp").alias("w"))
    ten = t.raw.select(F.window("timestamp", "10 seconds").start.alias("ts"))
    return A.feature_staleness({"features_entity_freq": (sec, "w"), "features_template_rarity": (t.scores, "timestamp"), "events_per_10s": (ten, "ts")}, AS_OF)


def four(t: Tables):
    return {"raw_logs": t.raw, "security_events": t.security, "process_events": t.process, "network_events": t.network}


COUNTS = "SELECT 'raw_logs' AS tbl, count(*) AS cnt FROM fx_raw UNION ALL SELECT 'security_events', count(*) FROM fx_security UNION ALL SELECT 'process_events', count(*) FROM fx_process UNION ALL SELECT 'network_events', count(*) FROM fx_network"


@query("table_counts", COUNTS)
def table_counts(t):
    return R.table_counts(four(t))


@query("total_events", f"SELECT CAST(sum(cnt) AS BIGINT) AS cnt FROM ({COUNTS})")
def total_events(t):
    return R.table_counts(four(t)).agg(F.sum("cnt").alias("cnt"))


@query("union_all_aggregates", """SELECT entity, entity_type, count(*) AS cnt, CAST(max(timestamp) AS VARCHAR) AS last_seen FROM (
 SELECT user_id AS entity, 'user' AS entity_type, timestamp FROM fx_security WHERE user_id <> '' UNION ALL SELECT hostname, 'host', timestamp FROM fx_security) GROUP BY ALL""")
def union_all_aggregates(t):
    user = t.security.where("user_id <> ''").select(F.col("user_id").alias("entity"), F.lit("user").alias("entity_type"), "timestamp")
    host = t.security.select(F.col("hostname").alias("entity"), F.lit("host").alias("entity_type"), "timestamp")
    return user.unionByName(host).groupBy("entity", "entity_type").agg(F.count("*").alias("cnt"), F.max("timestamp").alias("last_seen"))


def metrics(t: Tables):
    return t.base("events").where("event_type = 'click'").select(F.lit("producer_eps").alias("metric"), F.col("ts").cast("timestamp").alias("ts"), "value")


@query("ingest_rate", f"""WITH {FEED}, m AS (SELECT date_trunc('minute', timestamp) AS minute, count(*) AS n FROM feed GROUP BY 1),
 b AS (SELECT {PER_10S} AS ts, count(*) AS n FROM feed WHERE {PER_10S} >= {T0} - INTERVAL 5 MINUTE GROUP BY 1),
 x AS (SELECT (SELECT sum(n) / 60.0 FROM m WHERE minute >= {T0} - INTERVAL 2 MINUTE AND minute < date_trunc('minute', {T0})) AS t0,
  (SELECT sum(n) / 10.0 FROM b WHERE ts >= {T0} - INTERVAL 10 SECOND) AS t1,
  (SELECT sum(n)::DOUBLE / greatest(10, epoch(max(ts)) - epoch(min(ts)) + 10) FROM b WHERE ts >= {T0} - INTERVAL 60 SECOND) AS t2,
  (SELECT avg(n) / 10.0 FROM b) AS t3,
  (SELECT arg_max(value, ts) FROM events WHERE event_type = 'click' AND ts >= {T0} - INTERVAL 5 MINUTE) AS t4)
SELECT round(CAST(CASE WHEN t0 > 0 THEN t0 WHEN t2 > 0 THEN t2 WHEN t3 > 0 THEN t3 WHEN t1 > 0 THEN t1 WHEN t4 > 0 THEN t4 ELSE 0 END AS DOUBLE), 6) AS eps FROM x""")
def ingest_rate(t):
    f = feed(t)
    return R.ingest_rate(A.events_per_minute(f), A.events_per_10s(f), metrics(t), AS_OF)


HOURLY = "h AS (SELECT date_trunc('hour', timestamp) AS hour, category, severity, count(*) AS n FROM fx_security GROUP BY ALL)"
hourly = lambda t: A.security_severity_hourly(t.security)


@query("active_alerts", f"""WITH {HOURLY}, x AS (SELECT coalesce(sum(n) FILTER (hour >= {T0} - INTERVAL 7 DAY), 0) AS a, coalesce(sum(n) FILTER (hour < {T0} - INTERVAL 7 DAY), 0) AS p
 FROM h WHERE severity >= 2 AND hour >= {T0} - INTERVAL 14 DAY)
SELECT CAST(a AS BIGINT) AS active_alerts, CAST(p AS BIGINT) AS prev_alerts, CAST(CASE WHEN p = 0 THEN 0 ELSE round((a - p)::DOUBLE / p * 100) END AS DOUBLE) AS trend_pct FROM x""")
def active_alerts(t):
    return R.active_alerts(hourly(t), AS_OF, "7d")


@query("period_over_period", f"""SELECT category, CAST(count(*) FILTER (timestamp >= {T0} - INTERVAL 15 DAY) AS BIGINT) AS current_cnt, CAST(count(*) FILTER (timestamp < {T0} - INTERVAL 15 DAY) AS BIGINT) AS previous_cnt
 FROM fx_security WHERE timestamp >= {T0} - INTERVAL 30 DAY GROUP BY category""")
def period_over_period(t):
    cut = F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 15 DAYS")
    return R._recent(t.security, AS_OF, "30 DAYS").groupBy("category").agg(
        F.count_if(F.col("timestamp") >= cut).alias("current_cnt"), F.count_if(F.col("timestamp") < cut).alias("previous_cnt"))


MINUTES = f"{FEED}, m AS (SELECT date_trunc('minute', timestamp) AS minute, source, count(*) AS n FROM feed GROUP BY ALL)"


@query("top_sources", f"""WITH {MINUTES} SELECT source, CAST(sum(n) AS BIGINT) AS cnt FROM m WHERE minute >= {T0} - INTERVAL 7 DAY GROUP BY source ORDER BY cnt DESC, source LIMIT 10""")
def top_sources(t):
    return R.top_sources(A.events_per_minute(feed(t)), AS_OF, "7 DAYS")


@query("severity_distribution", f"WITH {HOURLY} SELECT CAST(severity AS BIGINT) AS severity, CAST(sum(n) AS BIGINT) AS cnt FROM h WHERE hour >= {T0} - INTERVAL 24 HOUR GROUP BY severity")
def severity_distribution(t):
    return R.severity_distribution(hourly(t), AS_OF)


@query("severity_distribution_7d", f"SELECT CAST(severity AS BIGINT) AS severity, count(*) AS cnt FROM fx_security WHERE timestamp >= {T0} - INTERVAL 7 DAY GROUP BY severity")
def severity_distribution_7d(t):
    return R.counts(t.security, ["severity"], AS_OF, "7 DAYS")


@query("events_timeline", f"""WITH {FEED} SELECT CAST({PER_10S} AS VARCHAR) AS bucket, count(*) AS cnt FROM feed WHERE {PER_10S} >= {T0} - INTERVAL 6 HOUR GROUP BY 1""")
def events_timeline(t):
    return R.events_timeline(A.events_per_10s(feed(t)), AS_OF, "ts", "6 HOURS")


@query("events_timeline_minutes", f"""WITH {MINUTES} SELECT CAST(minute AS VARCHAR) AS bucket, CAST(sum(n) AS BIGINT) AS cnt FROM m WHERE minute >= {T0} - INTERVAL 30 DAY GROUP BY 1""")
def events_timeline_minutes(t):
    return R.events_timeline(A.events_per_minute(feed(t)), AS_OF, "minute", "30 DAYS")


@query("critical_alert_count", f"SELECT count(*) AS cnt FROM fx_security WHERE severity >= 3 AND timestamp >= {T0} - INTERVAL 1 HOUR")
def critical_alert_count(t):
    return R.counts(t.security, [], AS_OF, "1 HOUR", F.col("severity") >= 3)


@query("mitre_top_techniques", f"""SELECT mitre_technique AS technique, mitre_tactic AS tactic, count(*) AS cnt, CAST(max(severity) AS BIGINT) AS max_severity FROM fx_security
 WHERE mitre_technique <> '' AND timestamp >= {T0} - INTERVAL 7 DAY GROUP BY ALL ORDER BY cnt DESC, technique, tactic LIMIT 10""")
def mitre_top_techniques(t):
    return R.mitre_top_techniques(t.security, AS_OF)


@query("mitre_tactic_heatmap", f"SELECT mitre_tactic AS tactic, count(DISTINCT mitre_technique) AS techniques, count(*) AS alerts FROM fx_security WHERE mitre_tactic <> '' AND timestamp >= {T0} - INTERVAL 30 DAY GROUP BY 1")
def mitre_tactic_heatmap(t):
    return R.mitre_tactic_heatmap(t.security, AS_OF, "30 DAYS")


@query("risky_entities", f"""SELECT entity, entity_type, CAST(sum(w) AS BIGINT) AS risk, count(*) AS cnt FROM (
 SELECT unnest([user_id, hostname]) AS entity, unnest(['user', 'host']) AS entity_type, CASE severity WHEN 4 THEN 25 WHEN 3 THEN 10 WHEN 2 THEN 4 WHEN 1 THEN 1 ELSE 0 END AS w
 FROM fx_security WHERE timestamp >= {T0} - INTERVAL 7 DAY) WHERE entity <> '' GROUP BY ALL ORDER BY risk DESC, entity, entity_type LIMIT 8""")
def risky_entities(t):
    return R.risky_entities(t.security, AS_OF, "7 DAYS")


@query("risk_score", f"""WITH {HOURLY} SELECT CAST(coalesce(least(100, round(sum(n * CASE severity WHEN 4 THEN 40 WHEN 3 THEN 20 WHEN 2 THEN 8 ELSE 2 END)::DOUBLE / sum(n) * 2.5)), 0) AS DOUBLE) AS risk_score
 FROM h WHERE hour >= {T0} - INTERVAL 7 DAY""")
def risk_score(t):
    return R.risk_score(hourly(t), AS_OF, "7 DAYS")


@query("mttr", f"""SELECT round(avg(d), 6) AS mttr_sec FROM (SELECT date_diff('second', min(timestamp), max(timestamp)) AS d FROM fx_security
 WHERE severity >= 3 AND timestamp >= {T0} - INTERVAL 7 DAY GROUP BY category HAVING count(*) >= 2)""")
def mttr(t):
    return R.mttr(t.security, AS_OF, "7 DAYS")


@query("alert_summary", f"""SELECT count(*) AS total, count(*) FILTER (severity = 4) AS critical, count(*) FILTER (severity = 3) AS high, count(*) FILTER (severity = 2) AS medium
 FROM fx_security WHERE timestamp >= {T0} - INTERVAL 24 HOUR""")
def alert_summary(t):
    return R.alert_summary(t.security, AS_OF)


@query("alert_severity_counts", f"SELECT CAST(severity AS BIGINT) AS severity, count(*) AS cnt FROM fx_security WHERE severity >= 2 AND timestamp >= {T0} - INTERVAL 24 HOUR GROUP BY severity")
def alert_severity_counts(t):
    return R.counts(t.security, ["severity"], AS_OF, "24 HOURS", F.col("severity") >= 2)


@query("top_indicators", f"SELECT hostname, count(*) AS hits, CAST(max(severity) AS BIGINT) AS max_severity FROM fx_security WHERE severity >= 2 AND hostname <> '' AND timestamp >= {T0} - INTERVAL 7 DAY GROUP BY hostname ORDER BY hits DESC, hostname LIMIT 15")
def top_indicators(t):
    return R.top_indicators(t.security, AS_OF)


@query("attacks_by_hour", f"""SELECT CAST(date_trunc('hour', timestamp) AS VARCHAR) AS hour, mitre_technique AS technique, count(*) AS cnt FROM fx_security
 WHERE severity >= 3 AND mitre_technique <> '' AND timestamp >= {T0} - INTERVAL 7 DAY GROUP BY ALL ORDER BY hour DESC, cnt DESC, technique LIMIT 50""")
def attacks_by_hour(t):
    return R.attacks_by_hour(t.security, AS_OF, "7 DAYS")


@query("top_categories", f"SELECT category, count(*) AS cnt FROM fx_security WHERE timestamp >= {T0} - INTERVAL 7 DAY GROUP BY category ORDER BY cnt DESC, category LIMIT 10")
def top_categories(t):
    return R.counts(t.security, ["category"], AS_OF, "7 DAYS", k=10)


@query("evidence_summary", """SELECT count(*) AS batches, CAST(sum(event_count) AS BIGINT) AS events_anchored, round(avg(event_count), 6) AS avg_batch_size, count(*) FILTER (status = 'Verified') AS verified,
 round(count(*) FILTER (status = 'Verified') * 100.0::DOUBLE / count(*), 2) AS verified_pct FROM fx_anchors""")
def evidence_summary(t):
    return R.evidence_summary(t.anchors)


@query("events_by_source", f"SELECT source, count(*) AS cnt FROM fx_raw WHERE timestamp >= {T0} - INTERVAL 1 DAY GROUP BY source ORDER BY cnt DESC, source LIMIT 20")
def events_by_source(t):
    return R.counts(t.raw, ["source"], AS_OF, "24 HOURS", k=20)


@query("events_by_level", f"SELECT level, count(*) AS cnt FROM fx_raw WHERE timestamp >= {T0} - INTERVAL 1 DAY GROUP BY level")
def events_by_level(t):
    return R.counts(t.raw, ["level"], AS_OF, "24 HOURS")


@query("events_last_hour_by_minute", f"SELECT CAST(date_trunc('minute', timestamp) AS VARCHAR) AS minute, count(*) AS cnt FROM fx_raw WHERE timestamp >= {T0} - INTERVAL 1 HOUR GROUP BY 1")
def events_last_hour_by_minute(t):
    return R.counts(t.raw.withColumn("minute", F.date_trunc("minute", "timestamp")), ["minute"], AS_OF, "1 HOUR")


@query("event_count_24h", f"SELECT count(*) AS cnt FROM fx_raw WHERE timestamp >= {T0} - INTERVAL 1 DAY")
def event_count_24h(t):
    return R.counts(t.raw, [], AS_OF, "24 HOURS")


@query("high_severity_count", f"SELECT count(*) AS cnt FROM fx_security WHERE severity >= 3 AND timestamp >= {T0} - INTERVAL 7 DAY")
def high_severity_count(t):
    return R.counts(t.security, [], AS_OF, "7 DAYS", F.col("severity") >= 3)


@query("top_attacked_users", f"SELECT user_id, count(*) AS cnt FROM fx_security WHERE severity >= 3 AND timestamp >= {T0} - INTERVAL 1 DAY GROUP BY user_id ORDER BY cnt DESC, user_id LIMIT 10")
def top_attacked_users(t):
    return R.counts(t.security, ["user_id"], AS_OF, "24 HOURS", F.col("severity") >= 3, k=10)


@query("technique_distribution", f"SELECT mitre_technique, count(*) AS cnt FROM fx_security WHERE mitre_technique <> '' AND timestamp >= {T0} - INTERVAL 7 DAY GROUP BY 1")
def technique_distribution(t):
    return R.counts(t.security, ["mitre_technique"], AS_OF, "7 DAYS", F.col("mitre_technique") != "")


@query("high_confidence_alerts", f"SELECT count(*) AS cnt FROM fx_security WHERE ai_confidence > 0.8 AND timestamp >= {T0} - INTERVAL 7 DAY")
def high_confidence_alerts(t):
    return R.counts(t.security, [], AS_OF, "7 DAYS", F.col("ai_confidence") > 0.8)


@query("net_top_talkers", f"SELECT src_ip, CAST(sum(bytes_sent) AS BIGINT) AS total FROM fx_network WHERE timestamp >= {T0} - INTERVAL 1 DAY GROUP BY src_ip ORDER BY total DESC, src_ip LIMIT 10")
def net_top_talkers(t):
    return R.net_top_bytes(t.network, "src_ip", AS_OF)


@query("net_top_destinations", f"SELECT dst_ip, CAST(sum(bytes_sent) AS BIGINT) AS total FROM fx_network WHERE timestamp >= {T0} - INTERVAL 1 DAY GROUP BY dst_ip ORDER BY total DESC, dst_ip LIMIT 10")
def net_top_destinations(t):
    return R.net_top_bytes(t.network, "dst_ip", AS_OF)


@query("geo_distribution", f"SELECT geo_country, count(*) AS cnt FROM fx_network WHERE timestamp >= {T0} - INTERVAL 1 DAY GROUP BY 1")
def geo_distribution(t):
    return R.counts(t.network, ["geo_country"], AS_OF, "24 HOURS")


@query("suspicious_connections", f"SELECT count(*) AS cnt FROM fx_network WHERE is_suspicious = 1 AND timestamp >= {T0} - INTERVAL 7 DAY")
def suspicious_connections(t):
    return R.counts(t.network, [], AS_OF, "7 DAYS", F.col("is_suspicious") == 1)


@query("suspicious_processes", f"SELECT hostname, count(*) AS cnt FROM fx_process WHERE is_suspicious = 1 AND timestamp >= {T0} - INTERVAL 7 DAY GROUP BY hostname")
def suspicious_processes(t):
    return R.counts(t.process, ["hostname"], AS_OF, "7 DAYS", F.col("is_suspicious") == 1)


@query("proc_by_host", f"SELECT hostname, count(*) AS cnt FROM fx_process WHERE timestamp >= {T0} - INTERVAL 1 DAY GROUP BY hostname ORDER BY cnt DESC, hostname LIMIT 10")
def proc_by_host(t):
    return R.counts(t.process, ["hostname"], AS_OF, "24 HOURS", k=10)


@query("source_category_counts", "SELECT source, category, count(*) AS cnt FROM fx_security GROUP BY ALL")
def source_category_counts(t):
    return R.counts(t.security, ["source", "category"])


@query("spc_baseline", f"""WITH {ACTIONS}, m AS (SELECT hostname, source_ip, date_trunc('minute', timestamp) AS mi, count(*) AS c FROM actions WHERE timestamp >= {T0} - INTERVAL 7 DAY GROUP BY ALL)
SELECT hostname, source_ip, round(avg(c), 6) AS baseline_mean, round(coalesce(stddev_samp(c), 0), 6) AS baseline_stddev FROM m GROUP BY ALL""")
def spc_baseline(t):
    return A.spc_baseline(actions(t), AS_OF, hours=168)


@query("host_network_context", """SELECT hostname, count(*) AS event_count, count(DISTINCT dst_ip) AS unique_destinations, count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_port) AS unique_ports,
 least(count(DISTINCT dst_ip), 5) AS hop_count FROM fx_network GROUP BY hostname""")
def host_network_context(t):
    return A.host_network_context(t.network)


# ---- projections, filters, search -------------------------------------------------------


@query("table_projection", """SELECT event_id, CAST(timestamp AS VARCHAR) AS timestamp, hostname, src_ip, CAST(src_port AS BIGINT) AS src_port, dst_ip, CAST(dst_port AS BIGINT) AS dst_port, protocol, direction,
 CAST(bytes_sent AS BIGINT) AS bytes_sent, CAST(bytes_received AS BIGINT) AS bytes_received, dns_query FROM fx_network""")
def table_projection(t):
    return P.table_projection(t.network, "network_events")


@query("recent_filter", f"SELECT event_id, level FROM fx_raw WHERE timestamp >= {T0} - INTERVAL 4 HOUR")
def recent_filter(t):
    return R._recent(t.raw, AS_OF, R.RANGES["4h"]).select("event_id", "level")


@query("time_range_filter", "SELECT event_id, source FROM fx_raw WHERE timestamp >= TIMESTAMP '2024-01-10 12:00:00' AND timestamp <= TIMESTAMP '2024-01-20 00:00:00'")
def time_range_filter(t):
    return P.time_range_filter(t.raw, "2024-01-10T12:00:00Z", "2024-01-20").select("event_id", "source")


@query("keyword_search", "SELECT event_id, source FROM fx_raw WHERE concat_ws(' ', source, message, user_id) ILIKE '%FAILED_password%'")
def keyword_search(t):
    return P.keyword_search(t.raw, "raw_logs", "FAILED_password").select("event_id", "source")


@query("severity_filter", "SELECT event_id, CAST(severity AS BIGINT) AS severity FROM fx_security WHERE severity >= 3")
def severity_filter(t):
    return P.severity_filter(t.security, "security_events", "3.7").select("event_id", "severity")


SEARCH = "concat_ws(' ', source, description, hostname, user_id, category, mitre_tactic, mitre_technique) ILIKE '%login%' OR concat_ws(' ', source, description, hostname, user_id, category, mitre_tactic, mitre_technique) ILIKE '%host-1%'"


@query("event_search", """SELECT event_id, CAST(timestamp AS VARCHAR) AS timestamp, CAST(severity AS BIGINT) AS severity, category, source AS log_source, description AS raw, hostname, user_id, mitre_tactic, mitre_technique
 FROM fx_security WHERE concat_ws(' ', source, description, hostname, user_id, category, mitre_tactic, mitre_technique) ILIKE '%host-1%' AND severity >= 2
 AND timestamp >= TIMESTAMP '2024-01-05 00:00:00' ORDER BY fx_security.timestamp DESC, event_id LIMIT 50 OFFSET 100""")
def event_search(t):
    return P.event_search(t.security, "security_events", "host-1", 2, "2024-01-05", None, 50, 100)[0]


@query("event_search_total", """SELECT count(*) AS total FROM fx_security WHERE concat_ws(' ', source, description, hostname, user_id, category, mitre_tactic, mitre_technique) ILIKE '%host-1%' AND severity >= 2
 AND timestamp >= TIMESTAMP '2024-01-05 00:00:00'""")
def event_search_total(t):
    return P.event_search(t.security, "security_events", "host-1", 2, "2024-01-05")[1]


@query("page", "SELECT event_id, level FROM fx_raw ORDER BY timestamp DESC, event_id LIMIT 50 OFFSET 200")
def page(t):
    return t.raw.orderBy(F.desc("timestamp"), "event_id").offset(200).limit(50).select("event_id", "level")


@query("page_after", "SELECT event_id, level FROM fx_raw WHERE timestamp < TIMESTAMP '2024-01-15 00:00:00' OR (timestamp = TIMESTAMP '2024-01-15 00:00:00' AND event_id > 0) ORDER BY timestamp DESC, event_id LIMIT 50")
def page_after(t):
    return P.page_after(t.raw, "2024-01-15 00:00:00", 0).select("event_id", "level")


@query("alert_worklist", """SELECT event_id, CAST(timestamp AS VARCHAR) AS timestamp, CAST(severity AS BIGINT) AS severity, hostname, source,
 CASE severity WHEN 4 THEN 'New' WHEN 3 THEN 'Investigating' WHEN 2 THEN 'Acknowledged' ELSE 'Resolved' END AS state FROM fx_security WHERE severity = 3 AND source = 'src1'""")
def alert_worklist(t):
    return P.alert_worklist(t.security, state="Investigating", source="src1")


UNION = """SELECT event_id, timestamp, source AS log_source, '' AS hostname, 0 AS severity, message AS raw, 'raw_logs' AS _table FROM fx_raw
 UNION ALL SELECT event_id, timestamp, source, hostname, severity, description, 'security_events' FROM fx_security
 UNION ALL SELECT event_id, timestamp, '', hostname, is_suspicious, concat(binary_path, ' ', arguments), 'process_events' FROM fx_process
 UNION ALL SELECT event_id, timestamp, protocol, hostname, is_suspicious, concat(src_ip, ':', src_port, ' → ', dst_ip, ':', dst_port, ' ', dns_query), 'network_events' FROM fx_network"""
FEED_OUT = "event_id, CAST(timestamp AS VARCHAR) AS timestamp, log_source, hostname, CAST(severity AS BIGINT) AS severity, raw, _table"


@query("union_events", f"SELECT {FEED_OUT} FROM ({UNION})")
def union_events(t):
    return P.union_events(t.raw, t.security, t.process, t.network)


@query("live_feed_filter", f"SELECT {FEED_OUT} FROM ({UNION}) WHERE contains(lower(raw), 'malware') OR contains(lower(hostname), 'malware') OR contains(lower(log_source), 'malware')")
def live_feed_filter(t):
    return P.live_feed_filter(union_events(t), "Malware")


@query("feed_dedup", f"SELECT event_id, min(CAST(timestamp AS VARCHAR)) AS timestamp FROM ({UNION}) GROUP BY event_id")
def feed_dedup(t):
    return P.feed_dedup(union_events(t).select("event_id", "timestamp"))


@query("latest_per_table", f"""WITH u AS ({UNION}), r AS (SELECT *, row_number() OVER (PARTITION BY _table ORDER BY timestamp DESC, event_id) AS rn FROM u WHERE timestamp >= TIMESTAMP '2024-01-30 00:00:00')
SELECT {FEED_OUT} FROM r WHERE rn <= 25 ORDER BY r.timestamp DESC, _table, event_id LIMIT 100""")
def latest_per_table(t):
    return P.latest_per_table(t.raw, t.security, t.process, t.network, "2024-01-30 12:00:00")


@query("latest_single_table", "SELECT event_id, level, source FROM fx_raw WHERE timestamp >= TIMESTAMP '2024-01-30 00:00:00' ORDER BY timestamp DESC, event_id LIMIT 100")
def latest_single_table(t):
    return P.latest_rows(t.raw, "2024-01-30 12:00:00", 100).select("event_id", "level", "source")


@query("recent_alerts", f"""SELECT event_id, CAST(timestamp AS VARCHAR) AS timestamp, CAST(severity AS BIGINT) AS severity, category, description, hostname, mitre_technique FROM fx_security
 WHERE severity >= 3 AND timestamp >= {T0} - INTERVAL 7 DAY ORDER BY fx_security.timestamp DESC, event_id LIMIT 50""")
def recent_alerts(t):
    return R.recent_alerts(t.security, AS_OF, "7 DAYS", 3, 50)


@query("top_k", "SELECT CAST(c_nationkey AS BIGINT) AS nation, CAST(count(*) AS BIGINT) AS cnt FROM customer GROUP BY 1 ORDER BY cnt DESC, nation LIMIT 5")
def top_k(t):
    return R.top_k(t.base("customer").select(F.col("c_nationkey").alias("nation")), ["nation"], F.count("*"), 5)


@query("evidence_chain_list", """SELECT batch_id, table_name, CAST(time_from AS VARCHAR) AS time_from, CAST(event_count AS BIGINT) AS event_count, status, split_part(s3_key, '/', 2) AS file_name
 FROM fx_anchors ORDER BY fx_anchors.time_from DESC, table_name, batch_id LIMIT 1000""")
def evidence_chain_list(t):
    return R.evidence_chain_list(t.anchors)


@query("ioc_list_filter", """SELECT s_suppkey AS ioc_id, CASE WHEN s_nationkey % 2 = 0 THEN 'ip' ELSE 'domain' END AS ioc_type FROM supplier
 WHERE (contains(lower(s_name), 'supplier#00000001') OR s_nationkey % 5 = 0) AND s_nationkey % 2 = 0""")
def ioc_list_filter(t):
    iocs = t.base("supplier").select(
        F.col("s_suppkey").alias("ioc_id"), F.when(F.col("s_nationkey") % 2 == 0, "ip").otherwise("domain").alias("ioc_type"),
        F.col("s_name").alias("ioc_value"), F.when(F.col("s_nationkey") % 5 == 0, F.array(F.lit("Seen-Supplier#00000001"))).otherwise(F.array(F.lit("x"))).alias("tags"))
    return P.ioc_list_filter(iocs, "Supplier#00000001", "ip").select("ioc_id", "ioc_type")


@query("vector_filter", "SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings WHERE label >= 3 AND vec_id < 400")
def vector_filter(t):
    return P.vector_filter(t.base("embeddings"), "label >= 3 AND vec_id < 400", ["label", "vec_id"]).select("vec_id", "label")


@query("pattern_count", "SELECT count(*) AS cnt FROM fx_raw WHERE message LIKE '%deny%'")
def pattern_count(t):
    return P.pattern_count(t.raw, "message", "%deny%")


@query("pattern_count_process", f"SELECT count(*) AS cnt FROM fx_process WHERE binary_path LIKE '%powershell%' AND timestamp >= {T0} - INTERVAL 7 DAY")
def pattern_count_process(t):
    return P.pattern_count(R._recent(t.process, AS_OF, "7 DAYS"), "binary_path", "%powershell%")


@query("drop_debug", "SELECT event_id, level FROM fx_raw WHERE level <> 'DEBUG'")
def drop_debug(t):
    from watchtide.operators.normalize import drop_debug

    return drop_debug(t.raw).select("event_id", "level")


@query("distinct_values", "SELECT DISTINCT hostname, mitre_tactic FROM fx_security")
def distinct_values(t):
    return t.security.select("hostname", "mitre_tactic").distinct()


@query("suspicious_ip_join", f"""SELECT s.ip AS src_ip, sec_count, net_count FROM
 (SELECT ip_address AS ip, count(*) AS sec_count FROM fx_security WHERE severity >= 3 AND timestamp >= {T0} - INTERVAL 7 DAY GROUP BY 1) s
 JOIN (SELECT src_ip AS ip, count(*) AS net_count FROM fx_network WHERE timestamp >= {T0} - INTERVAL 7 DAY GROUP BY 1) n USING (ip) ORDER BY sec_count DESC, src_ip LIMIT 10""")
def suspicious_ip_join(t):
    from watchtide.operators.lookups import suspicious_ip_join

    sec = R._recent(t.security.where("severity >= 3"), AS_OF, "7 DAYS")
    return suspicious_ip_join(sec, R._recent(t.network, AS_OF, "7 DAYS"))


@query("data_integrity_check", """SELECT level, source, expected, coalesce(found, 0) AS found, CAST(round(CASE WHEN expected > 0 THEN (expected - coalesce(found, 0)) * 100.0::DOUBLE / expected ELSE 0 END, 6) AS DOUBLE) AS loss_pct,
 CAST(coalesce(found, 0) >= expected AS BIGINT) AS passed FROM (SELECT level, source, count(*) AS expected FROM fx_raw GROUP BY ALL)
 LEFT JOIN (SELECT level, source, count(*) AS found FROM fx_raw WHERE level <> 'DEBUG' GROUP BY ALL) USING (level, source)""")
def data_integrity_check(t):
    expected = t.raw.groupBy("level", "source").agg(F.count("*").alias("expected"))
    return R.data_integrity_check(t.raw.where("level <> 'DEBUG'"), expected, ["level", "source"])
