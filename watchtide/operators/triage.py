"""Feature rows, score fusion and routing of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from watchtide.functions.expr import clamp, lookup, moment, since
from watchtide.operators import lookups as J
from watchtide.operators.netfeatures import conn_window_100, conn_window_2s

# Feature order of the scoring models.
FEATURES = [
    "hour_of_day", "day_of_week", "severity_numeric", "source_type_numeric", "src_bytes", "dst_bytes", "event_freq_1m", "protocol", "dst_port",
    "template_rarity", "threat_intel_flag", "duration", "same_srv_rate", "diff_srv_rate", "serror_rate", "rerror_rate", "count", "srv_count",
    "dst_host_count", "dst_host_srv_count",
]
WINDOW_FEATURES = FEATURES[12:]
# Numeric codes of source types, protocols and levels.
SOURCE_TYPES = {
    "syslog": 1, "linux_auth": 1, "windows_event": 2, "winlogbeat": 2, "wineventlog": 2, "firewall": 3, "cef": 3, "active_directory": 4, "ldap": 4,
    "dns": 5, "dns_logs": 5, "cloudtrail": 6, "aws_cloudtrail": 6, "kubernetes": 7, "k8s_audit": 7, "nginx": 8, "apache": 8, "web_server": 8,
    "netflow": 9, "ipfix": 9, "ids_ips": 10, "zeek": 10, "snort": 10, "suricata": 10, "sshd": 1, "sudo": 1, "pam": 1, "auditd": 1, "sysmon": 2,
    "docker_logs": 1, "journald": 1, "http_json": 1, "file_logs": 1, "unknown": 1,
}
TOPIC_DEFAULT = {"raw-logs": 1, "security-events": 2, "process-events": 1, "network-events": 9}
PROTOCOLS = {"tcp": 6, "udp": 17, "icmp": 1, "igmp": 2, "gre": 47, "esp": 50, "ah": 51, "sctp": 132}
SEVERITIES = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4, "debug": 0, "0": 0, "1": 1, "2": 2, "3": 3, "4": 4}
SEVERITIES_FIXED = {**SEVERITIES, "warning": 2, "error": 3}
# Fixed values of fusion and routing.
WEIGHTS = {"lgbm": 0.60, "eif": 0.15, "arf": 0.25}
CONFIDENCE_RAMP = 10_000
RARE_BELOW, RARITY_BOOST, IOC_BOOST, IOC_MULTIPLIER = 0.15, 0.10, 0.15, 1.5
ISOLATION_AT, ISOLATION_FLOOR = 0.65, 0.45
DISAGREEMENT, ESCALATE_FROM = 0.30, 0.5
LABEL_HIGH, LABEL_LOW = 0.80, 0.20
BYTES_MAX = 1e9
RESULT_COLUMNS = [
    "event_id", "timestamp", "source_type", "hostname", "source_ip", "user_id", "template_id", "template_rarity", "combined_score", "lgbm_score", "eif_score", "arf_score",
    "score_std_dev", "agreement", "ci_lower", "ci_upper", "asset_multiplier", "adjusted_score", "action", "ioc_match", "ioc_confidence", "mitre_tactic", "mitre_technique",
    "features_stale", "model_version", "disagreement_flag",
]


def map_source_type(c, topic: Column | None = None) -> Column:
    """1-10; unknown names fall back to the default of their topic."""
    name = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    fallback = F.lit(1) if topic is None else F.coalesce(lookup(topic, TOPIC_DEFAULT), F.lit(1))
    return F.coalesce(lookup(name, SOURCE_TYPES), fallback)


def map_protocol(c) -> Column:
    return F.coalesce(lookup(F.lower(F.col(c) if isinstance(c, str) else c), PROTOCOLS), F.lit(6))


def map_severity(c, compat: bool = False) -> Column:
    """0-4. ``compat`` leaves ``warning`` and ``error`` unmapped, as the original did."""
    col = F.col(c) if isinstance(c, str) else c
    number = F.floor(col.try_cast("double"))
    named = F.coalesce(lookup(F.lower(F.trim(col.cast("string"))), SEVERITIES if compat else SEVERITIES_FIXED), F.lit(0))
    return F.when(number.isNotNull(), clamp(number, 0, 4).cast("int")).otherwise(named)


def _double(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def triage_features(events: DataFrame, topic: str, ts: str = "timestamp") -> DataFrame:
    """The 20 features next to the event columns.

    Needs ``template_rarity`` and ``threat_intel_flag`` when known; network events need the
    window features of ``network_features``.
    """
    have, net = set(events.columns), topic == "network-events"
    pick = lambda *names, default: F.coalesce(*[F.col(n).cast("string") for n in names if n in have], F.lit(default))
    seconds = _double(pick("duration_ms", "duration", default="0")) / 1000.0 if net else F.lit(0.0)
    sized = _double(pick("bytes_sent", default="0")) if net else F.length(pick("message", "message_body", "description", default="")).cast("double")
    features = {
        "hour_of_day": F.hour(ts), "day_of_week": F.weekday(ts), "severity_numeric": map_severity(pick("original_log_level", "level", "severity", default="info")),
        "source_type_numeric": map_source_type(pick("source_type", "source", default="unknown"), F.lit(topic)),
        "src_bytes": clamp(sized, 0.0, BYTES_MAX), "dst_bytes": clamp(_double(pick("bytes_received", default="0")), 0.0, BYTES_MAX) if net else F.lit(0.0),
        "event_freq_1m": F.when(seconds > 0, 60.0 / seconds).otherwise(0.0), "protocol_code": map_protocol(pick("protocol", default="tcp")),
        "dst_port_code": _double(pick("dst_port", "dest_port", default="0")), "template_rarity": _double(pick("template_rarity", default="0.5")),
        "threat_intel_flag": pick("threat_intel_flag", default="0"), "duration": seconds,
        **{n: F.col(n) if net else F.lit(0.0) for n in WINDOW_FEATURES},
    }
    source = {"protocol": "protocol_code", "dst_port": "dst_port_code"}
    out = events.withColumns({f"_f_{n}": features[source.get(n, n)].cast("double") for n in FEATURES})
    keep = [c for c in events.columns if c not in FEATURES]
    return out.select(*keep, *[F.col(f"_f_{n}").alias(n) for n in FEATURES])


def network_features(network: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Network events with both connection windows."""
    return conn_window_100(conn_window_2s(network, ts), ts)


def sanitize_features(df: DataFrame, columns: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """NaN and null become 0, infinities a large finite number."""
    fix = lambda c: F.when(c.isNull() | F.isnan(c), 0.0).when(c == float("inf"), 1e9).when(c == float("-inf"), -1e9).otherwise(c)
    return df.withColumns({n: fix(F.col(n)) for n in columns})


def calibrated_sigmoid(raw, mean: float, std: float, flip: bool = False) -> Column:
    """Path length to a score in [0, 1] with fixed training statistics."""
    c = F.col(raw) if isinstance(raw, str) else raw
    z = (c - mean) / std if std > 1e-8 else c - mean
    score = 1.0 / (1.0 + F.exp(z))
    return clamp(1.0 - score if flip else score, 0.0, 1.0)


def model_confidence(samples, ramp: int = CONFIDENCE_RAMP) -> Column:
    c = F.col(samples) if isinstance(samples, str) else F.lit(samples)
    return F.least(F.lit(1.0), c / ramp) if ramp > 0 else F.lit(1.0)


def score_fusion(df: DataFrame, confidence: Column | float = 1.0, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Weighted score, spread and interval. Weight the third model has not earned goes to the others."""
    conf = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    rest = weights["lgbm"] + weights["eif"]
    third = conf * weights["arf"]
    free = weights["arf"] - third
    w = {"lgbm": weights["lgbm"] + free * (weights["lgbm"] / rest), "eif": weights["eif"] + free * (weights["eif"] / rest), "arf": third}
    scores = [F.col(f"{m}_score") for m in w]
    mean = (scores[0] + scores[1] + scores[2]) / 3
    spread = F.sqrt(((scores[0] - mean) ** 2 + (scores[1] - mean) ** 2 + (scores[2] - mean) ** 2) / 3)
    df = df.withColumns({"combined_score": scores[0] * w["lgbm"] + scores[1] * w["eif"] + scores[2] * w["arf"], "score_std_dev": spread})
    c, s = F.col("combined_score"), F.col("score_std_dev")
    return df.withColumns({"agreement": 1.0 - s, "ci_lower": clamp(c - 1.96 * s, 0.0, 1.0), "ci_upper": clamp(c + 1.96 * s, 0.0, 1.0)})


def adjusted_score(df: DataFrame, rarity_as: str = "inverse_frequency") -> DataFrame:
    """Boosts for template rarity and indicators, asset multiplier, floor for isolation outliers.

    The boost applies to rarity values below the limit. With ``rarity_as="frequency"`` the
    column holds 1 - frequency and is turned round first, so rare templates are boosted.
    """
    rarity = F.col("template_rarity") if rarity_as == "inverse_frequency" else 1.0 - F.col("template_rarity")
    ioc = F.col("ioc_match") == 1
    boost = F.when(rarity < RARE_BELOW, RARITY_BOOST * (1.0 - rarity / RARE_BELOW)).otherwise(0.0) + F.when(ioc, IOC_BOOST).otherwise(0.0)
    mult = F.when(ioc, F.greatest("asset_multiplier", F.lit(IOC_MULTIPLIER))).otherwise(F.col("asset_multiplier"))
    df = df.withColumn("asset_multiplier", mult)
    value = F.least(F.lit(1.0), (F.col("combined_score") + boost) * F.col("asset_multiplier"))
    return df.withColumn("adjusted_score", F.when(F.col("eif_score") >= ISOLATION_AT, F.greatest(value, F.lit(ISOLATION_FLOOR))).otherwise(value))


def routing_action(df: DataFrame) -> DataFrame:
    """Escalate, monitor or discard; disagreement lifts a high monitor; allow-listed events are discarded."""
    a = F.col("adjusted_score")
    apart = F.col("score_std_dev") >= DISAGREEMENT
    base = F.when(a >= F.col("anomalous_threshold"), "escalate").when(a >= F.col("suspicious_threshold"), "monitor").otherwise("discard")
    df = df.withColumn("action", F.when(apart & (base == "monitor") & (a >= ESCALATE_FROM), "escalate").otherwise(base))
    listed = F.col("is_allowed") == 1
    neutral = {"adjusted_score": F.col("combined_score"), "action": F.lit("discard"), "asset_multiplier": F.lit(1.0), "ioc_match": F.lit(0), "ioc_confidence": F.lit(0), "mitre_tactic": F.lit(""), "mitre_technique": F.lit("")}
    df = df.withColumn("disagreement_flag", F.when(listed, 0).otherwise(apart.cast("int")))
    return df.withColumns({n: F.when(listed, v).otherwise(F.col(n)) for n, v in neutral.items()})


def triage_result(scores: DataFrame, thresholds: DataFrame, assets: DataFrame, iocs: DataFrame, allowlist: DataFrame, as_of, confidence: Column | float = 1.0, model_version: str = "v1") -> DataFrame:
    """Scored events to routed results."""
    df = score_fusion(scores, confidence)
    df = J.threshold_lookup(df, thresholds)
    df = J.asset_pattern_join(df, assets)
    df = J.ioc_enrich(df, iocs, as_of)
    df = J.allowlist_match(df, allowlist, as_of)
    df = routing_action(adjusted_score(df))
    return df.withColumns({"features_stale": F.lit(0), "model_version": F.lit(model_version)}).select(*RESULT_COLUMNS)


def score_events(featured: DataFrame, scorer: str) -> DataFrame:
    """Model scores by a registered scorer: a function of the frame, or a fitted transformer."""
    from watchtide.operators.models import SCORERS

    if scorer not in SCORERS:
        raise ValueError(f"no scorer is registered as {scorer!r}")
    found = SCORERS[scorer]
    return found.transform(featured) if hasattr(found, "transform") else found(featured)


def route_events(windowed: DataFrame, topic: str, scorer: str, dims: dict[str, DataFrame], as_of) -> DataFrame:
    """Events with their connection windows to routed results: features, scores, fusion, lookups, action, topics."""
    featured = sanitize_features(triage_features(windowed, topic))
    return score_router(triage_result(score_events(featured, scorer), dims["thresholds"], dims["assets"], dims["iocs"], dims["allowlist"], as_of))


def pseudo_labels(results: DataFrame, source: str = "lgbm_pseudo") -> DataFrame:
    """1, 0, or -1 for the ambiguous zone; or from the action."""
    s = F.col("lgbm_score")
    by_score = F.when(s >= LABEL_HIGH, 1).when(s <= LABEL_LOW, 0).otherwise(-1)
    label = by_score if source == "lgbm_pseudo" else F.when(F.col("action") == "escalate", 1).otherwise(0)
    return results.withColumn("pseudo_label", label)


def feature_row_sink(features: DataFrame, results: DataFrame) -> DataFrame:
    """Replay rows: time, id, source type, the ordered features and a stored label."""
    labelled = pseudo_labels(results).select("event_id", "source_type", F.greatest("pseudo_label", F.lit(0)).alias("label"))
    return features.drop("source_type").join(labelled, "event_id").select("timestamp", "event_id", "source_type", *FEATURES, "label")


def replay_window(rows: DataFrame, as_of, hours: int = 24, max_rows: int = 50_000, ts: str = "timestamp") -> DataFrame:
    return rows.where(since(ts, as_of, f"{hours} HOURS") & (F.col(ts) <= moment(as_of))).orderBy(ts, "event_id").limit(max_rows)


def score_router(results: DataFrame) -> DataFrame:
    """One row per event and topic: every score, and escalations to two more topics."""
    extra = F.when(F.col("action") == "escalate", F.array(F.lit("anomaly-alerts"), F.lit("hunter-tasks"))).otherwise(F.array().cast("array<string>"))
    return results.withColumn("topic", F.explode(F.concat(F.array(F.lit("triage-scores")), extra)))
