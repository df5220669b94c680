"""Turn open JSON messages into normalised events. Pure column expressions, so the same
code runs in batch and in a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchtide.functions.expr import IPV4_IN_TEXT, IPV4_TEXT, computed, first_case, valid_ip

EVENT_TYPES = ["security", "process", "network", "raw"]
# Fixed patterns: RFC 3164 and ISO headers in front of a message body.
SYSLOG_START, SYSLOG_BODY = r"^\w{3}\s+\d", r"^(?:\w{3}\s+\d{1,2}\s+[\d:]+\s+\S+\s+\S+(?:\[\d+\])?:\s*)(.*)"
ISO_START, ISO_BODY = r"^\d{4}[-/]", r"^(?:\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}\S*\s+\S+[\s:]+)(.*)"
HEADER_SOURCES = ["syslog", "file", "journald"]


def field(name: str) -> Column:
    """Field of the open message, as text; null when missing."""
    return F.try_element_at("fields", F.lit(name))


def first_field(*names: str, default=None) -> Column:
    found = [field(n) for n in names]
    return F.coalesce(*found, F.lit(default)) if default is not None else F.coalesce(*found)


def has_any(*names: str) -> Column:
    return F.coalesce(*[field(n) for n in names]).isNotNull()


def int_or(text: Column, default: int) -> Column:
    """Whole numbers only; anything else becomes the default."""
    return F.coalesce(F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("bigint")), F.lit(default).cast("bigint"))


def parse_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """One parse of the JSON text into a map; the map is null for a broken message."""
    return computed(df, {"fields": F.from_json(value, "map<string,string>")})


def merge_json_message(df: DataFrame, unless: Column | None = None) -> DataFrame:
    """Fields of a JSON object inside ``message`` override those of the event."""
    text = field("message")
    looks = text.startswith("{") | text.startswith("[")
    inner = F.when(looks if unless is None else looks & ~unless, F.from_json(text, "map<string,string>"))
    df = computed(df, {"_inner": inner})
    keep = F.map_filter("fields", lambda k, _: ~F.map_contains_key("_inner", k))
    return computed(df, {"fields": F.when(F.col("_inner").isNotNull(), F.map_concat(keep, "_inner")).otherwise(F.col("fields"))}).drop("_inner")


def normalize_timestamp(ingest_ts: str) -> Column:
    return F.coalesce(F.try_to_timestamp(field("timestamp")), F.col(ingest_ts))


def normalize_hostname() -> Column:
    return first_field("hostname", "host", "container_name", "_HOSTNAME", default="unknown")


def extract_ip() -> Column:
    """Address field as given; the first dotted quad of the text when there is no source field."""
    found = F.nullif(F.regexp_extract(field("message"), IPV4_IN_TEXT, 1), F.lit(""))
    return F.coalesce(field("ip_address"), F.when(~has_any("src_ip", "source_ip"), found))


def normalize_level() -> Column:
    raw = F.upper(first_field("level", "severity", "priority", "PRIORITY", default="INFO"))
    return first_case(
        [
            (raw.isin("CRITICAL", "ERROR", "WARNING", "INFO", "DEBUG"), raw),
            (raw.isin("0", "1", "2"), F.lit("CRITICAL")),
            (raw == "3", F.lit("ERROR")),
            (raw == "4", F.lit("WARNING")),
            (raw.isin("5", "6"), F.lit("INFO")),
            (raw == "7", F.lit("DEBUG")),
            (raw.rlike("EMERG|CRIT|ALERT"), F.lit("CRITICAL")),
            (raw.contains("ERR"), F.lit("ERROR")),
            (raw.contains("WARN"), F.lit("WARNING")),
            (raw.rlike("DEBUG|TRACE"), F.lit("DEBUG")),
        ],
        F.lit("INFO"),
    )


def level_number(level: Column) -> Column:
    return F.when(level == "CRITICAL", 4).when(level == "ERROR", 3).when(level == "WARNING", 2).otherwise(0)


def original_log_level() -> Column:
    """0-4 from the raw level, else the clamped severity, else the syslog priority."""
    name = F.upper(field("level"))
    sev, pri = field("severity").try_cast("bigint"), field("priority").try_cast("bigint")
    by_name = (
        F.when(name.isin("CRITICAL", "ALERT", "EMERG", "CRIT"), 4).when(name.isin("ERROR", "ERR"), 3)
        .when(name.isin("WARNING", "WARN"), 2).otherwise(0)
    )
    by_priority = F.when(pri <= 2, 4).when(pri == 3, 3).when(pri == 4, 2).otherwise(0)
    return (
        F.when(name.isNotNull(), by_name)
        .when(field("severity").isNotNull(), F.coalesce(F.greatest(F.least(sev, F.lit(4)), F.lit(0)), F.lit(0)).cast("int"))
        .when(field("priority").isNotNull(), F.when(pri.isNull(), 0).otherwise(by_priority))
        .otherwise(0)
    )


def normalize_source(default: str = "vector") -> Column:
    return F.coalesce(F.nullif(field("appname"), F.lit("")), first_field("_SYSTEMD_UNIT", "container_name", "source_type", "source", default=default))


def strip_syslog_header(message: Column, source_type: Column) -> Column:
    def body(pattern):
        inner = F.regexp_extract(message, pattern, 1)
        return F.when(message.rlike(pattern), inner).otherwise(message)

    return (
        F.when(~source_type.isin(*HEADER_SOURCES), message)
        .when(message.rlike(SYSLOG_START), body(SYSLOG_BODY))
        .when(message.rlike(ISO_START), body(ISO_BODY))
        .otherwise(message)
    )


def preclassified(hint: str = "event_type_hint") -> Column:
    """The sender already named one of the four types."""
    return F.coalesce(field(hint).isin(*EVENT_TYPES), F.lit(False))


def normalize(df: DataFrame, ingest_ts: str = "ingest_ts", hint: str = "event_type_hint", default_source: str = "vector") -> DataFrame:
    """All common columns of an event; ``fields`` stays for the type-specific ones."""
    df = computed(df, {"is_preclassified": preclassified(hint), "given_type": field(hint), "source_type": first_field("source_type", default="unknown"), "raw_log_level": original_log_level()})
    skip = F.col("is_preclassified")
    df = merge_json_message(df, unless=skip)
    message = F.coalesce(field("message"), F.when(skip, F.lit("")).otherwise(F.to_json("fields")))
    df = computed(
        df,
        {
            "timestamp": normalize_timestamp(ingest_ts),
            "hostname": F.when(skip, first_field("hostname", default="unknown")).otherwise(normalize_hostname()),
            "ip_address": F.when(skip, field("ip_address")).otherwise(extract_ip()),
            "level": F.when(skip, F.upper(first_field("level", default="INFO"))).otherwise(normalize_level()),
            "source": F.when(skip, first_field("source", default=default_source)).otherwise(normalize_source(default_source)),
            "message": message,
        },
    )
    return df.withColumns(
        {
            "original_log_level": F.when(skip, F.col("raw_log_level")).otherwise(level_number(F.col("level"))),
            "message_body": F.when(skip, F.col("message")).otherwise(strip_syslog_header(F.col("message"), F.col("source_type"))),
        }
    ).drop("raw_log_level")


def normalize_process(df: DataFrame) -> DataFrame:
    """Columns of a process event from their aliases."""
    ints = {"pid": (["pid", "PID", "_PID"], 0), "ppid": (["ppid", "PPID"], 0), "uid": (["uid", "UID", "_UID"], 0), "gid": (["gid", "GID"], 0), "exit_code": (["exit_code", "EXIT_STATUS"], -1)}
    texts = {"binary_path": ["binary_path", "exe", "_EXE", "COMM"], "arguments": ["arguments", "cmdline", "_CMDLINE"], "cwd": ["cwd"], "container_id": ["container_id", "CONTAINER_ID"], "pod_name": ["pod_name"], "namespace": ["namespace"], "syscall": ["syscall"]}
    return df.withColumns({**{c: int_or(first_field(*names), d) for c, (names, d) in ints.items()}, **{c: first_field(*names, default="") for c, names in texts.items()}})


def normalize_network(df: DataFrame) -> DataFrame:
    """Columns of a network event from their aliases; ports out of range become 0."""
    port = lambda *names: F.when(int_or(first_field(*names), 0).between(0, 65535), int_or(first_field(*names), 0)).otherwise(F.lit(0).cast("bigint"))
    return df.withColumns(
        {
            "src_ip": valid_ip(first_field("src_ip", "source_ip", "client_ip")),
            "dst_ip": valid_ip(first_field("dst_ip", "dest_ip", "destination_ip", "server_ip")),
            "src_port": port("src_port", "source_port", "client_port"),
            "dst_port": port("dst_port", "dest_port", "destination_port", "server_port"),
            "protocol": F.upper(first_field("protocol", "proto", default="TCP")),
            "direction": first_field("direction", default="outbound"),
            "bytes_sent": int_or(first_field("bytes_sent", "bytes_out"), 0),
            "bytes_received": int_or(first_field("bytes_received", "bytes_in"), 0),
            "duration_ms": int_or(first_field("duration_ms", "duration"), 0),
            "pid": int_or(field("pid"), 0),
            "dns_query": first_field("dns_query", "query", default=""),
            "geo_country": first_field("geo_country", "country", default=""),
            **{c: first_field(c, default="") for c in ("binary_path", "container_id", "pod_name", "namespace")},
        }
    )


def build_metadata(event_type: Column) -> Column:
    """Original source type, and more for security events; missing entries are left out."""
    named = {"user_id": "user_id", "request_id": "request_id", "container_name": "container_name", "container_id": "container_id", "syslog_facility": "facility", "appname": "appname", "procid": "procid", "docker_image": "image"}
    pairs = [F.lit("original_source_type"), F.col("source_type"), F.lit("ip_address"), F.when(F.col("ip_address").isNotNull(), valid_ip("ip_address"))]
    for key, source in named.items():
        pairs += [F.lit(key), field(source)]
    full = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    return F.when(event_type == "security", full).otherwise(F.create_map(*pairs[:2]))


COMMON = ["event_id", "timestamp"]
OUTPUT_COLUMNS = {
    "security": ["severity", "category", "source", "description", "user_id", "ip_address", "hostname", "mitre_tactic", "mitre_technique", "ai_confidence", "ai_explanation"],
    "process": ["hostname", "pid", "ppid", "uid", "gid", "binary_path", "arguments", "cwd", "exit_code", "container_id", "pod_name", "namespace", "syscall", "is_suspicious", "detection_rule"],
    "network": ["hostname", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "direction", "bytes_sent", "bytes_received", "duration_ms", "pid", "binary_path", "container_id", "pod_name", "namespace", "dns_query", "geo_country", "is_suspicious", "detection_rule"],
    "raw": ["level", "source", "ip_address", "message"],
}
TAIL = ["message_body", "source_type", "original_log_level", "metadata"]


def project_event(classified: DataFrame, event_type: str) -> DataFrame:
    """Closed schema of one type; unknown fields are dropped, raw DEBUG lines too."""
    df = classified.where(F.col("event_type") == event_type)
    df = df.withColumns({"metadata": build_metadata(F.lit(event_type)), "is_suspicious": F.lit(0), "detection_rule": F.lit("")})
    if event_type == "security":
        df = df.withColumns({
            "category": F.coalesce("category", field("category"), F.lit("unknown")), "description": F.coalesce("description", field("description"), F.col("message")),
            "severity": F.coalesce("severity", int_or(field("severity"), 0).cast("int")), "user_id": first_field("user_id", default=""), "ip_address": valid_ip("ip_address"),
            "mitre_tactic": F.coalesce("mitre_tactic", field("mitre_tactic"), F.lit("")), "mitre_technique": F.coalesce("mitre_technique", field("mitre_technique"), F.lit("")),
            "ai_confidence": F.lit(0.0), "ai_explanation": F.lit("")})
    elif event_type == "process":
        df = normalize_process(df)
    elif event_type == "network":
        df = normalize_network(df)
    else:
        df = drop_debug(df).withColumn("ip_address", valid_ip("ip_address"))
    return df.select(*COMMON, *OUTPUT_COLUMNS[event_type], *TAIL)


def drop_debug(df: DataFrame) -> DataFrame:
    return df.where(F.col("level") != "DEBUG")


def route_counts(classified: DataFrame) -> DataFrame:
    """Rows each typed table gets, in one pass."""
    kept = (F.col("event_type") != "raw") | (F.col("level") != "DEBUG")
    return classified.where(kept).groupBy("event_type").agg(F.count("*").alias("cnt"))


def route_by_type(classified: DataFrame) -> dict[str, DataFrame]:
    """The four typed tables; the caller persists ``classified`` within a micro-batch."""
    return {t: project_event(classified, t) for t in EVENT_TYPES}
