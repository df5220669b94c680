"""Typed table rows from JSON messages, driven by one table of columns.

Column: (name, JSON fields tried in order, kind, default).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchtide.functions.expr import NIL_UUID
from watchtide.operators.normalize import field, int_or, parse_messages

_S = lambda *names, d="": [(n, [n], "text", d) for n in names]
_I = lambda *names: [(n, [n], "int", 0) for n in names]
_D = lambda *names: [(n, [n], "double", 0.0) for n in names]
_ID, _TS, _META = ("event_id", ["_event_id"], "uuid", NIL_UUID), ("timestamp", ["timestamp"], "time", None), ("metadata", ["metadata"], "map", None)

COLUMNS = {
    "raw_logs": [_ID, _TS, ("received_at", [], "now", None), ("level", ["level"], "text", "INFO"), ("source", ["source"], "text", "unknown"), *_S("message"), _META,
                 ("user_id", ["metadata.user_id"], "text", ""), ("ip_address", ["ip_address", "metadata.ip_address"], "text", "0.0.0.0"), ("request_id", ["metadata.request_id"], "text", ""),
                 ("anchor_tx_id", [], "text", ""), ("anchor_batch_hash", [], "text", "")],
    "security_events": [_ID, _TS, *_I("severity"), *_S("category", "source", d="unknown"), *_S("description", "user_id"), *_S("ip_address", d="0.0.0.0"), *_S("hostname", "mitre_tactic", "mitre_technique"),
                        *_D("ai_confidence"), *_S("ai_explanation"), ("anchor_tx_id", [], "text", ""), _META],
    "process_events": [_ID, _TS, *_S("hostname"), *_I("pid", "ppid", "uid", "gid"), *_S("binary_path", "arguments", "cwd"), ("exit_code", ["exit_code"], "int", -1), *_S("container_id", "pod_name", "namespace", "syscall"),
                       *_I("is_suspicious"), *_S("detection_rule"), ("anchor_tx_id", [], "text", ""), _META],
    "network_events": [_ID, _TS, *_S("hostname"), *_S("src_ip", d="0.0.0.0"), *_I("src_port"), *_S("dst_ip", d="0.0.0.0"), *_I("dst_port"), *_S("protocol", d="TCP"), *_S("direction", d="outbound"),
                       *_I("bytes_sent", "bytes_received", "duration_ms", "pid"), *_S("binary_path", "container_id", "pod_name", "namespace", "dns_query", "geo_country"), *_I("is_suspicious"), *_S("detection_rule"), ("anchor_tx_id", [], "text", ""), _META],
    "triage_scores": [("event_id", ["event_id"], "uuid", NIL_UUID), _TS, *_S("source_type", "hostname", "source_ip", "user_id", "template_id"), *_D("template_rarity", "combined_score", "lgbm_score", "eif_score", "arf_score", "score_std_dev", "agreement", "ci_lower", "ci_upper"),
                      ("asset_multiplier", ["asset_multiplier"], "double", 1.0), *_D("adjusted_score"), *_S("action", d="discard"), *_I("ioc_match", "ioc_confidence"), *_S("mitre_tactic", "mitre_technique", "shap_top_features", "shap_summary"),
                      *_I("features_stale"), *_S("model_version"), *_I("disagreement_flag")],
    "hunter_investigations": [("alert_id", ["alert_id"], "uuid", NIL_UUID), ("started_at", ["started_at"], "time", None), ("completed_at", ["completed_at"], "maybe_time", None), *_S("status", d="pending"), *_S("hostname", "source_ip", "user_id"), *_D("trigger_score"),
                              *_S("severity", d="info"), *_S("finding_type", "summary", "evidence_json"), ("correlated_events", ["correlated_events"], "uuids", None), ("mitre_tactics", ["mitre_tactics"], "texts", None), ("mitre_techniques", ["mitre_techniques"], "texts", None),
                              *_S("recommended_action"), *_D("confidence")],
    "verifier_results": [("investigation_id", ["investigation_id"], "uuid", NIL_UUID), ("alert_id", ["alert_id"], "uuid", NIL_UUID), ("started_at", ["started_at"], "time", None), ("completed_at", ["completed_at"], "maybe_time", None), *_S("status", d="pending"), *_S("verdict", d="inconclusive"),
                         *_D("confidence"), *_I("evidence_verified"), ("merkle_batch_ids", ["merkle_batch_ids"], "texts", None), *_S("timeline_json", "ioc_correlations"), *_S("priority", d="P4"), *_S("recommended_action", "analyst_summary")],
    "feedback_labels": [("event_id", ["event_id"], "uuid", NIL_UUID), ("score_id", ["score_id"], "maybe_uuid", None), _TS, *_S("label", d="unknown"), *_S("confidence", d="medium"), *_S("analyst_id", "notes"), *_D("original_combined", "original_lgbm", "original_eif", "original_arf")],
}
# Values an enumerated column may hold, in order.
ENUMS = {
    "action": ["discard", "monitor", "escalate"],
    "label": ["true_positive", "false_positive", "unknown"],
    "priority": ["P1", "P2", "P3", "P4"],
}


def _value(names: list[str]) -> Column:
    found = []
    for n in names:
        meta, _, key = n.partition(".")
        found.append(F.try_element_at("metadata_map", F.lit(key)) if key else field(meta))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _uuid(text: Column) -> Column:
    t = F.trim(text)
    return F.when((F.length(t) == 36) & (F.substring(t, 9, 1) == "-"), t)


def _typed(names, kind, default, ingest_ts) -> Column:
    v = _value(names)
    if kind == "int":
        return int_or(v, default)
    if kind == "double":
        return F.coalesce(v.try_cast("double"), F.lit(default))
    if kind == "uuid":
        return F.coalesce(_uuid(v), F.lit(default))
    if kind == "maybe_uuid":
        return _uuid(v)
    if kind == "time":
        return F.coalesce(F.try_to_timestamp(v), F.col(ingest_ts))
    if kind == "maybe_time":
        return F.when(v.isNotNull(), F.coalesce(F.try_to_timestamp(v), F.col(ingest_ts)))
    if kind == "now":
        return F.col(ingest_ts)
    if kind == "map":
        return F.col("metadata_map")
    if kind in ("texts", "uuids"):
        items = F.coalesce(F.from_json(v, "array<string>"), F.array().cast("array<string>"))
        return items if kind == "texts" else F.transform(items, lambda x: F.coalesce(_uuid(x), F.lit(NIL_UUID)))
    return F.coalesce(v, F.lit(default))


def _parsed(df: DataFrame, value: str) -> DataFrame:
    empty = F.create_map().cast("map<string,string>")
    return parse_messages(df, value).withColumn("metadata_map", F.coalesce(F.from_json(field("metadata"), "map<string,string>"), empty))


def _bad_enum(table: str) -> Column:
    """Name of the first column whose value is none of its enumeration, else null."""
    checks = [F.when(~F.coalesce(_value(names), F.lit(default)).isin(*ENUMS[name]), name) for name, names, _, default in COLUMNS[table] if name in ENUMS]
    return F.coalesce(*checks) if checks else F.lit(None).cast("string")


def typed_rows(df: DataFrame, table: str, value: str = "value", ingest_ts: str = "ingest_ts", event_id: Column | None = None) -> DataFrame:
    """Rows of one table; broken messages and values outside an enumeration are left out (see dead_letters)."""
    df = _parsed(df, value).where(F.col("fields").isNotNull() & _bad_enum(table).isNull())
    if event_id is not None:
        df = df.withColumn("fields", F.map_concat(F.map_filter("fields", lambda k, _: k != "_event_id"), F.create_map(F.lit("_event_id"), event_id)))
    return df.select(*[_typed(names, kind, default, ingest_ts).alias(name) for name, names, kind, default in COLUMNS[table]])


def dead_letters(df: DataFrame, value: str = "value", topic: str = "topic", ingest_ts: str = "ingest_ts", topics: dict[str, str] | None = None) -> DataFrame:
    """Messages that become no row, whole, with the stage that failed and why.

    ``topics`` maps topics to tables: with it, messages of other topics and rows with a value outside an
    enumeration are dead letters too.
    """
    df = _parsed(df, value)
    stages = [(F.col("fields").isNull(), "json_parse", F.concat(F.lit("not a JSON object: "), F.col(value)))]
    if topics is not None:
        stages.insert(0, (~F.coalesce(F.col(topic).isin(*topics), F.lit(False)), "topic", F.concat(F.lit("no table for topic: "), F.coalesce(F.col(topic), F.lit("null")))))
        for name, table in topics.items():
            bad = _bad_enum(table)
            stages.append(((F.col(topic) == name) & bad.isNotNull(), "row_build", F.concat(F.lit("not a value of "), bad)))
    pick = lambda k: F.coalesce(*[F.when(s[0], s[k] if k == 2 else F.lit(s[k])) for s in stages])
    return df.withColumn("failed_stage", pick(1)).where("failed_stage IS NOT NULL").select(
        F.col(ingest_ts).alias("timestamp"), "failed_stage", F.col(topic).alias("source_topic"), pick(2).alias("error_message"), F.col(value).alias("raw_payload"), F.lit(0).alias("retry_count"))
