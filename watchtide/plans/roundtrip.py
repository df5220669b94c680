"""Sources and sinks run over the given tables: written, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from watchtide.operators import converters as C, models as M, normalize as N, reports as R, typed as Y
from watchtide.plans.ingest import NORM, as_json, classified
from watchtide.plans.models import assembled
from watchtide.plans.registry import query
from watchtide.plans.reports import metrics
from watchtide.plans.streams import place, stream
from watchtide.plans.triage import RESULTS
from watchtide.session import written_once
from watchtide.sources import readers, sinks
from watchtide.sources.views import AS_OF, Tables
from watchtide.streaming import metrics as TM, pipelines as P, rollups as TR

T0 = f"TIMESTAMP '{AS_OF}'"


@query("table_sink", "SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS event_date, event_id, CAST(severity AS BIGINT) AS severity, category, hostname, user_id FROM fx_security")
def table_sink(t):
    """Written twice under the same batch id, as after a retry: still once in the table."""
    where = place(t)
    for _ in range(2):
        sinks.write_table(t.security, where, "security_events", batch_id=0)
    return t.spark.read.parquet(f"{where}/security_events").select(F.col("event_date").cast("string").alias("event_date"), "event_id", "severity", "category", "hostname", "user_id")


_AGE = "date_diff('day', CAST(timestamp AS DATE), DATE '2024-01-31')"


@query("retention_apply", f"SELECT CASE WHEN {_AGE} >= 10 THEN 'cold' WHEN {_AGE} >= 3 THEN 'warm' ELSE 'hot' END AS tier, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS event_date, event_id, message FROM fx_raw WHERE {_AGE} < 20")
def retention_apply(t):
    """Days written, brought to their tiers in two goes, and read back from where they are."""
    where = place(t)
    sinks.write_table(t.raw, where, "raw_logs", batch_id=0)
    policy = t.spark.createDataFrame([("raw_logs", 3, 10, 20)], "table_name string, warm_days int, cold_days int, delete_days int")
    for as_of in ("2024-01-20 12:00:00", "2024-01-31 12:00:00"):
        sinks.apply_retention(t.spark, where, policy, as_of)
    parts = [t.spark.read.parquet(f"{where}/{home}raw_logs").withColumn("tier", F.lit(tier)) for tier, home in (("hot", ""), ("warm", "tier=warm/"), ("cold", "tier=cold/"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("tier", F.col("event_date").cast("string").alias("event_date"), "event_id", "message")


@query("log_file_source", "SELECT message AS value, count(*) AS cnt FROM fx_raw GROUP BY 1")
def log_file_source(t):
    where = place(t)
    t.raw.select("message").write.text(where)
    return readers.log_file_source(t.spark, where, glob="*.txt").groupBy("value").agg(F.count("*").alias("cnt"))


@query("csv_dataset_source", "SELECT user_id, count(*) AS cnt, round(sum(value), 4) AS total FROM events GROUP BY 1")
def csv_dataset_source(t):
    where = place(t)
    df = t.base("events").select(F.col("user_id").alias(" user_id "), F.col("value").alias("value"))
    df.repartition(3).write.option("header", "true").csv(where)
    back = readers.csv_dataset_source(t.spark, where, "*.csv", "part-")
    return back.groupBy(F.col("user_id").cast("bigint").alias("user_id")).agg(F.count("*").alias("cnt"), F.round(F.sum(F.col("value").cast("double")), 4).alias("total"))


@query("report_export", "SELECT hostname, count(*) AS cnt FROM fx_security GROUP BY 1")
def report_export(t):
    where = place(t)
    sinks.report_export(R.counts(t.security, ["hostname"]), where)
    return t.spark.read.option("header", "true").csv(where).select("hostname", F.col("cnt").cast("bigint").alias("cnt"))


@query("ndjson_export", "SELECT event_id, level, source FROM fx_raw")
def ndjson_export(t):
    where = place(t)
    sinks.ndjson_export(t.raw.select("event_id", "level", "source"), where)
    return readers.ndjson_source(t.spark, where, "event_id bigint, level string, source string")


@query("kafka_events_source", "SELECT topic, CAST(part AS BIGINT) AS part, pos, CAST(ingest_ts AS VARCHAR) AS ingest_ts, value FROM fx_messages")
def kafka_events_source(t):
    """The source factory over files; the connector for a broker takes the same envelope."""
    where = place(t)
    t.messages.select("topic", F.col("part").cast("int").alias("part"), "pos", "ingest_ts", "value").write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{where}/in")
    s = readers.source_factory(t.spark, "json", path=f"{where}/in")
    s.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/offsets").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{where}/out").select("topic", "part", "pos", "ingest_ts", "value")


def feed(df, path: str, batches: int = 3) -> int:
    """Write a table as files of its own partitions; returns the files per micro-batch that make so many batches."""
    df.write.parquet(path)
    return -(-max(1, df.rdd.getNumPartitions()) // batches)


@query("stream_micro_batch", "SELECT coalesce(json_extract_string(value, '$.message'), '') AS message, coalesce(json_extract_string(value, '$.level'), 'INFO') AS level, coalesce(json_extract_string(value, '$.source'), 'unknown') AS source FROM fx_messages WHERE json_valid(value)")
def stream_micro_batch(t):
    """A third of the files per micro-batch; the batches add up to the whole."""
    where = place(t)
    files = feed(t.messages.select("topic", F.col("part").cast("int").alias("part"), "pos", "ingest_ts", "value"), f"{where}/in")
    s = readers.source_factory(t.spark, "parquet", path=f"{where}/in", max_files=files)
    P.stream_ingest(s, f"{where}/out", f"{where}/offsets", {"raw-logs": "raw_logs"}).awaitTermination()
    return t.spark.read.parquet(f"{where}/out/raw_logs").select("message", "level", "source")


@query("late_data", """WITH l AS (SELECT max(timestamp) - INTERVAL 10 MINUTE AS m FROM fx_security WHERE event_id % 2 = 0)
SELECT event_id, CAST(timestamp AS VARCHAR) AS timestamp, CAST(timestamp < m AS BIGINT) AS is_late FROM fx_security, l WHERE event_id % 2 = 1""")
def late_data(t):
    """The odd events come in a second batch, after the newest even one; all count, and the late ones are kept apart."""
    where = place(t)
    rows = t.security.select("event_id", "timestamp", "category", "severity")
    for part in (0, 1):
        rows.where(F.col("event_id") % 2 == part).write.parquet(f"{where}/in/{part}")
        s = t.spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{where}/in")
        TR.keep_rollup(s, lambda df: df.groupBy("event_id", "timestamp").agg(F.count("*").alias("event_count")), f"{where}/out", f"{where}/offsets").awaitTermination()
    late = TR.late_rows(t.spark, f"{where}/out").select("event_id", F.lit(1).alias("is_late"))
    counted = TR.read_rollup(t.spark, f"{where}/out", ["event_id", "timestamp"]).where(F.col("event_id") % 2 == 1)
    return counted.join(late, "event_id", "left").select("event_id", "timestamp", F.coalesce("is_late", F.lit(0)).alias("is_late"))


@query("throughput_metrics")
def throughput_metrics(t):
    """Progress of a streaming query as metric rows."""
    where, listener = place(t), TM.ThroughputListener()
    t.spark.streams.addListener(listener)
    try:
        s = TM.observed(stream(t).messages.select("value"))
        s.writeStream.queryName(f"rates_{uuid.uuid4().hex[:8]}").format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/offsets").trigger(availableNow=True).start().awaitTermination()
        t.spark.range(1).count()
        for _ in range(50):
            if listener.rows:
                break
            import time

            time.sleep(0.1)
    finally:
        t.spark.streams.removeListener(listener)
    return listener.table(t.spark).select("metric", "value")


@query("project_event", f"WITH {NORM} SELECT event_type, event_id, CAST(ts AS VARCHAR) AS timestamp, source_type, CAST(original_log_level AS BIGINT) AS original_log_level FROM c WHERE NOT (event_type = 'raw' AND level = 'DEBUG')")
def project_event(t):
    """Messages are parsed and classified once, then read by each type."""
    out = None
    for kind, df in N.route_by_type(written_once(classified(t))).items():
        part = df.select(F.lit(kind).alias("event_type"), "event_id", "timestamp", "source_type", "original_log_level")
        out = part if out is None else out.unionByName(part)
    return out


@query("typed_rows", " UNION ALL ".join(f"SELECT '{n}' AS tbl, {len(cols)}::BIGINT AS columns, (SELECT count(*) FROM fx_scores) AS cnt" for n, cols in Y.COLUMNS.items()))
def typed_rows(t):
    """The same sparse message through every builder: all columns, all rows, defaults elsewhere."""
    rows, out = as_json(t.scores, "hostname", "source_ip"), None
    for name, cols in Y.COLUMNS.items():
        df = Y.typed_rows(rows, name)
        part = df.select(F.struct(*df.columns).alias("r")).groupBy(F.lit(name).alias("tbl"), F.lit(len(df.columns)).alias("columns")).agg(F.count("r").alias("cnt"))
        out = part if out is None else out.unionByName(part)
    return out


@query("dataset_to_event", """SELECT event_id, concat('Firewall alert: ', event_type, ' - 10.0.0.', user_id % 8, ':', event_id % 60000, ' → 8.8.8.8:53 proto=UDP service=dns state=CON bytes_sent=', event_id, ' bytes_recv=1') AS message, 'WARNING' AS level, event_id % 60000 AS src_port FROM events WHERE event_type <> 'view'
 UNION ALL SELECT event_id, concat('Firewall: connection 10.0.0.', user_id % 8, ':', event_id % 60000, ' → 8.8.8.8:53 proto=UDP service=dns state=CON dur=0.5s'), 'INFO', event_id % 60000 FROM events WHERE event_type = 'view'""")
def dataset_to_event(t):
    e, normal = F.col("event_id"), F.col("event_type") == "view"
    df = t.base("events").select(
        F.concat(F.lit("10.0.0."), F.col("user_id") % 8).alias("srcip"), F.lit("8.8.8.8").alias("dstip"), (e % 60000).cast("string").alias("sport"), F.lit("53").alias("dsport"), F.lit("udp").alias("proto"), F.lit("dns").alias("service"), F.lit("CON").alias("state"),
        F.when(normal, "Normal").otherwise(F.col("event_type")).alias("attack_cat"), F.when(normal, "0").otherwise("1").alias("label"), e.cast("string").alias("sbytes"), F.lit("1").alias("dbytes"), F.lit("0.5").alias("dur"))
    df = C.dataset_to_event(df, "unsw").select(F.from_json("value", "message string, level string, src_port bigint, bytes_sent bigint").alias("j")).select("j.*")
    return df.withColumnRenamed("bytes_sent", "event_id")


_IP = "concat('10.0.0.', user_id % 8)"
_EVTX = f"""SELECT 'windows_event' AS source_type, CASE event_id % 5
   WHEN 0 THEN concat('An account failed to log on. Computer=', h, ' TargetUser=', u, ' IP=', ip, ' EventID=4625 Channel=Security', tac, ' TargetUser=', u, ' Process=', pr, ' CommandLine=', cmd)
   WHEN 1 THEN concat('An account was successfully logged on. Computer=', h, ' TargetUser=', u, ' IP=', ip, ' LogonType=3')
   WHEN 2 THEN concat('A new process has been created. Computer=', h, ' Process=', pr, ' CommandLine=', cmd)
   WHEN 3 THEN concat('Process Create: Computer=', h, ' Image=', pr, ' CommandLine=', cmd, ' User=', u)
   ELSE concat('Windows Event Log: Computer=', h, ' EventID=7045 Channel=Security', tac, ' TargetUser=', u, ' Process=', pr, ' CommandLine=', cmd) END AS message,
  h AS hostname, CASE WHEN tac <> '' THEN 'WARNING' ELSE 'INFO' END AS level, NULL AS src_ip, NULL AS dst_ip, NULL::BIGINT AS src_port, NULL::BIGINT AS dst_port, NULL AS protocol, CASE WHEN ip <> '-' THEN ip END AS ip_address, NULL AS dns_query
 FROM (SELECT *, concat('host-', user_id % 8) AS h, concat('user', user_id) AS u, CASE WHEN event_id % 3 = 0 THEN '-' ELSE {_IP} END AS ip, 'C:/run.exe' AS pr, concat('run ', event_id) AS cmd, CASE WHEN event_type = 'view' THEN '' ELSE concat(' Tactic=', event_type) END AS tac FROM events)"""
_DNS = f"""SELECT 'dns', CASE WHEN event_id % 50 > 35 THEN concat('DNS query: suspicious domain=', d, ' entropy=', printf('%.2f', (event_id % 50) / 10.0), ' ip=', {_IP}, ' ttl=60 country=NL') ELSE concat('DNS query: domain=', d, ' ip=', {_IP}, ' ttl=60 country=NL') END,
  'dns-resolver-01', CASE WHEN event_id % 50 > 35 THEN 'WARNING' ELSE 'INFO' END, NULL, {_IP}, NULL, 53, 'UDP', NULL, d FROM (SELECT *, concat('d', event_id, '.example') AS d FROM events)"""
_NETFLOW = f"""SELECT 'netflow', concat('NetFlow: ', {_IP}, ':', event_id % 60000, ' → 8.8.8.8:443 proto=tcp kind=', event_type, ' n=', event_id), 'netflow-collector-01', 'INFO', {_IP}, '8.8.8.8', event_id % 60000, 443, 'TCP', NULL, NULL FROM events"""
_APACHE = """SELECT 'apache', CASE WHEN event_id % 3 = 0 THEN concat('Apache: [12:00] [', lv, '] core', event_id) ELSE concat('Apache: request ', event_id) END, 'web-01', CASE event_id % 4 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'INFO' WHEN 2 THEN 'CRITICAL' ELSE 'INFO' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL
 FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'notice' WHEN 2 THEN ' Crit' ELSE 'other' END AS lv FROM events)"""
_CICIDS = """SELECT 'ids_ips', CASE event_id % 4 WHEN 0 THEN 'DDoS attack detected: DDoS from 192.168.* to 10.0.*:80 - syn flood pattern' WHEN 1 THEN 'Port scan detected from 192.168.* targeting 10.0.* - multiple ports probed'
  WHEN 2 THEN concat('IDS Alert: Bot attack detected - dst_port=80 fwd_pkts=', event_id, ' bwd_pkts=2 flow_bytes/s=9 src=192.168.* dst=10.0.*') ELSE concat('Network flow: dst_port=80 fwd_pkts=', event_id, ' bwd_pkts=2 flow_dur=7 src=192.168.* dst=10.0.*') END,
  'ids-sensor-01', CASE WHEN event_id % 4 < 3 THEN 'WARNING' ELSE 'INFO' END, '192.168.*', '10.0.*', -1, 80, 'TCP', NULL, NULL FROM events"""
_KDD = """SELECT 'ids_ips', CASE WHEN event_type = 'view' THEN concat('IDS: normal traffic - proto=TCP service=ssh flag=S0 duration=', event_id, 's src=172.16.* dst=10.10.*')
  ELSE concat('IDS alert: ', event_type, ' (1) detected - proto=TCP service=ssh flag=S0 src_bytes=', event_id, ' dst_bytes=3 src=172.16.* dst=10.10.*:22') END, 'ids-01', CASE WHEN event_type = 'view' THEN 'INFO' ELSE 'WARNING' END, '172.16.*', '10.10.*', -1, 22, 'TCP', NULL, NULL FROM events"""


@query("dataset_to_event_formats", " UNION ALL ".join([_EVTX, _DNS, _NETFLOW, _APACHE, _CICIDS, _KDD]))
def dataset_to_event_formats(t):
    """Every row of events in the form of each of the other six datasets. Only what is drawn from a row's hash is masked:
    the last two parts of made-up addresses, and made-up source ports, if they lie in their range."""
    df, e, kind = t.base("events"), F.col("event_id"), F.col("event_type")
    say, pick = (lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])), (lambda n, *x: F.element_at(F.array(*[F.lit(v) for v in x]), (e % n + 1).cast("int")))
    ip, view = say("10.0.0.", F.col("user_id") % 8), kind == "view"
    user, run = say("user", F.col("user_id")), F.lit("C:/run.exe")
    given = {
        "evtx": df.select(pick(5, "4625", "4624", "4688", "1", "7045").alias("EventID"), say("host-", F.col("user_id") % 8).alias("Computer"), F.when(view, "").otherwise(kind).alias("EVTX_Tactic"), say("run ", e).alias("CommandLine"), user.alias("TargetUserName"), user.alias("User"),
                          F.when(e % 3 == 0, "-").otherwise(ip).alias("IpAddress"), run.alias("NewProcessName"), run.alias("Image"), F.lit(3).alias("LogonType")),
        "dns": df.select(say("b'd", e, ".example.'").alias("Domain"), ip.alias("IP"), F.lit(60).alias("TTL"), F.lit("NL").alias("Country"), ((e % 50) / 10.0).alias("entropy")),
        "nf_ton_iot": df.select(ip.alias("src"), (e % 60000).alias("sp"), F.lit("8.8.8.8").alias("dst"), F.lit(443).alias("dp"), F.lit("tcp").alias("pr"), kind.alias("kind"), e.alias("n")),
        "apache_structured": df.select(pick(4, "error", "notice", " Crit", "other").alias("Level"), F.when(e % 3 == 0, "").otherwise(say("request ", e)).alias("Content"), F.lit("12:00").alias("Time"), say("core", e).alias("Component")),
        "cicids": df.select(pick(4, "DDoS", " PortScan", "Bot ", "BENIGN").alias("Label"), F.lit(" 80").alias("Destination Port"), e.alias("Total Fwd Packets"), F.lit(2).alias("Total Backward Packets"), F.lit(9).alias("Flow Bytes/s"), F.lit(7).alias("Flow Duration")),
        "nsl_kdd": df.select(F.lit("tcp").alias("protocol_type"), F.lit("ssh").alias("service"), F.lit("S0").alias("flag"), F.when(view, "0").otherwise("1").alias("label"), kind.alias("attack_type"), e.alias("src_bytes"), F.lit(3).alias("dst_bytes"), e.alias("duration")),
    }
    fields = "source_type string, message string, hostname string, level string, src_ip string, dst_ip string, src_port bigint, dst_port bigint, protocol string, ip_address string, dns_query string"
    out = None
    for name, rows in given.items():
        part = C.dataset_to_event(rows, name).select(F.from_json("value", fields).alias("j")).select("j.*")
        if name in ("cicids", "nsl_kdd"):
            made = lambda c: F.regexp_replace(c, r"\b(192\.168|10\.0|172\.16|10\.10)(\.\d{1,3}){2}", "$1.*")
            part = part.withColumns({c: made(c) for c in ("message", "src_ip", "dst_ip")}).withColumn("src_port", F.when(F.col("src_port").between(1024, 65535), -1).otherwise(F.col("src_port")).cast("bigint"))
        out = part if out is None else out.unionByName(part)
    return out


@query("dataset_to_features", """SELECT event_id::DOUBLE AS src_bytes, least(value * 10, 1e9)::DOUBLE AS dst_bytes, 17.0::DOUBLE AS protocol, 9.0::DOUBLE AS source_type_numeric, round(value / 1000, 6) AS duration, CASE WHEN event_type = 'view' THEN 'normal' ELSE event_type END AS attack_type, CAST(event_type <> 'view' AS BIGINT) AS label, 'nf_ton_iot' AS source_dataset FROM events""")
def dataset_to_features(t):
    df = t.base("events").select(F.col("event_id").alias("IN_BYTES"), (F.col("value") * 10).alias("OUT_BYTES"), F.lit(17).alias("PROTOCOL"), F.col("value").alias("FLOW_DURATION_MILLISECONDS"),
                                 F.when(F.col("event_type") == "view", "Benign").otherwise(F.col("event_type")).alias("Attack"), F.lit(1).alias("Label"))
    return C.dataset_to_features(df, "nf_ton_iot").select("src_bytes", "dst_bytes", "protocol", "source_type_numeric", "duration", "attack_type", "label", "source_dataset")


# weights and caps of the published heuristic for the features that assembled rows have; the others are 0, distances 1
_ASSEMBLED = """0.15 * greatest(0, least(adjusted_score, 1)) + 0.04 * greatest(0, least(combined_score, 1)) + 0.04 * 1.0 + 0.05 * greatest(0, least(ioc_match * ioc_confidence / 100.0, 1)) + 0.02 * greatest(0, least(template_rarity, 1))
 + 0.02 * least(d / 50.0, 1) + 0.01 * least(s / 50.0, 1) + 0.02 * least(least(d, 5) / 10.0, 1) + 0.03 * least(e / 20.0, 1) + 0.01 * least(1 / 10.0, 1) + 0.02 * greatest(0, least(m, 1)) + 0.02 * least(2 / 10.0, 1) + 0.02 * 1.0
 + 0.01 * (1.0 - 0.0)"""


@query("score_with_model", f"""WITH {RESULTS}, cx AS (SELECT hostname, count(DISTINCT dst_ip) AS d, count(DISTINCT src_ip) AS s FROM fx_network GROUP BY 1), hs AS (SELECT hostname, count(*) FILTER (action = 'escalate') AS e, avg(adjusted_score) AS m FROM res GROUP BY 1)
SELECT event_id, round(greatest(0.0, least({_ASSEMBLED}, 1.0))::DOUBLE, 6) AS hunter_score, 'heuristic' AS model_used FROM res LEFT JOIN cx USING (hostname) LEFT JOIN hs USING (hostname)""")
def score_with_model(t):
    """Without a model the heuristic scores."""
    return M.score_with_model(assembled(t)).select("event_id", "hunter_score", "model_used")


def report(t: Tables, sections):
    return R.long_report(sections).groupBy("section").agg(F.count("*").alias("rows"))


@query("dashboard_metrics")
def dashboard_metrics(t):
    return R.long_report(R.dashboard_metrics(t.raw, t.security, t.process, t.network, t.anchors, metrics(t), AS_OF))


@query("soc_report", f"""WITH s AS (SELECT * FROM fx_security WHERE timestamp >= {T0} - INTERVAL 7 DAY) SELECT 'summary' AS section, 1::BIGINT AS rows UNION ALL SELECT 'tables', 4 UNION ALL SELECT 'evidence', 1 UNION ALL SELECT 'categories', least(10, count(DISTINCT category)) FROM s
 UNION ALL SELECT 'severities', count(DISTINCT severity) FROM s UNION ALL SELECT 'recent_alerts', least(50, count(*) FILTER (severity >= 3)) FROM s UNION ALL SELECT 'techniques', least(20, count(DISTINCT (mitre_technique, mitre_tactic)) FILTER (mitre_technique <> '')) FROM s""")
def soc_report(t):
    return report(t, R.soc_report(t.raw, t.security, t.process, t.network, t.anchors, AS_OF))


@query("threat_intel_report", f"""WITH s AS (SELECT * FROM fx_security WHERE timestamp >= {T0} - INTERVAL 7 DAY) SELECT 'techniques' AS section, least(20, count(DISTINCT (mitre_technique, mitre_tactic)) FILTER (mitre_technique <> '')) AS rows FROM s UNION ALL SELECT 'indicators', least(15, count(DISTINCT hostname) FILTER (severity >= 2 AND hostname <> '')) FROM s
 UNION ALL SELECT 'attacks_by_hour', least(50, count(DISTINCT (date_trunc('hour', timestamp), mitre_technique)) FILTER (severity >= 3 AND mitre_technique <> '' AND timestamp >= {T0} - INTERVAL 24 HOUR)) FROM s""")
def threat_intel_report(t):
    return report(t, R.threat_intel_report(t.security, AS_OF))
