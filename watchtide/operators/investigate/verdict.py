"""From signals to a verdict: ordered features, heuristic score, decision and narrative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchtide.functions.expr import lookup
from watchtide.operators.investigate.signals import merge_ids, severity_word

# Feature order, heuristic weight and cap (None: already within 0 and 1).
FEATURES = [
    ("adjusted_score", 0.15, None), ("base_score", 0.04, None), ("entity_risk", 0.04, None), ("ioc_boost", 0.05, None), ("temporal_boost", 0.02, None), ("destination_risk", 0.02, None),
    ("off_hours_boost", 0.01, None), ("high_severity_count", 0.02, None), ("medium_severity_count", 0.01, None), ("distinct_categories", 0.01, None), ("event_count", 0.01, 1000.0),
    ("correlated_alert_count", 0.01, 50.0), ("template_risk", 0.02, None),
    ("graph_unique_destinations", 0.02, 50.0), ("graph_unique_src_ips", 0.01, 50.0), ("graph_has_ioc_neighbor", 0.04, None), ("graph_hop_count", 0.02, 10.0), ("graph_high_risk_neighbors", 0.02, 10.0),
    ("graph_escalation_count", 0.02, 20.0), ("graph_lateral_movement_score", 0.03, None), ("graph_c2_candidate_score", 0.03, None),
    ("temporal_escalation_count", 0.03, 20.0), ("temporal_unique_categories", 0.01, 10.0), ("temporal_tactic_diversity", 0.01, None), ("temporal_mean_score", 0.02, None),
    ("similarity_attack_embed_dist", 0.04, None), ("similarity_historical_dist", 0.03, None), ("similarity_log_embed_matches", 0.01, 20.0), ("similarity_confirmed_neighbor_count", 0.03, 10.0),
    ("similarity_min_confirmed_dist", 0.02, None), ("similarity_false_positive_count", -0.03, 10.0), ("similarity_label_confidence", 0.03, None),
    ("mitre_match_count", 0.02, 10.0), ("mitre_tactic_breadth", 0.02, None), ("campaign_host_count", 0.03, 20.0), ("campaign_tactic_count", 0.02, 10.0),
    ("sigma_hit_count", 0.04, 5.0), ("sigma_max_severity", 0.03, None), ("spc_z_score", 0.03, 10.0), ("spc_is_anomaly", 0.03, None), ("spc_baseline_mean", 0.0, None), ("spc_baseline_stddev", 0.0, None),
]
FEATURE_ORDER = [name for name, *_ in FEATURES]
# Features taken from the scored event under another name, and those it does not carry.
PASSED = {"base_score": "combined_score", "entity_risk": "asset_multiplier", "template_risk": "template_rarity"}
ABSENT = ["temporal_boost", "destination_risk", "off_hours_boost", "high_severity_count", "medium_severity_count", "distinct_categories", "event_count", "correlated_alert_count"]

# Severity and advice per finding.
FINDING_SEVERITY = {
    "CONFIRMED_ATTACK": "critical", "ACTIVE_CAMPAIGN": "critical", "BEHAVIOURAL_ANOMALY": "high", "SIGMA_MATCH": "high",
    "ANOMALOUS_PATTERN": "medium", "NORMAL_BEHAVIOUR": "low", "FALSE_POSITIVE": "low",
}
RECOMMENDED_ACTION = {
    "CONFIRMED_ATTACK": "Immediately isolate the affected host and revoke active sessions. Escalate to Incident Response and preserve forensic artefacts.",
    "ACTIVE_CAMPAIGN": "Activate the coordinated-attack runbook. Isolate all hosts listed in correlated_events, block source IPs at the perimeter, and alert the SOC lead.",
    "BEHAVIOURAL_ANOMALY": "Investigate the anomalous behaviour on the host. Review recent user activity and correlate with HR records if applicable. Escalate if additional IOCs are discovered.",
    "SIGMA_MATCH": "Validate the Sigma rule match against raw logs. If confirmed, treat as BEHAVIOURAL_ANOMALY and escalate.",
    "ANOMALOUS_PATTERN": "Monitor the entity for further anomalous activity over the next 2 hours. Create a low-priority tracking ticket.",
    "NORMAL_BEHAVIOUR": "No action required. Continue standard monitoring.",
    "FALSE_POSITIVE": "No action required.  Consider tuning the originating triage rule.",
}
ACTION_HINT = {
    "CONFIRMED_ATTACK": "isolate + escalate to IR", "ACTIVE_CAMPAIGN": "activate coordinated-attack runbook", "BEHAVIOURAL_ANOMALY": "investigate + monitor", "SIGMA_MATCH": "validate rule match",
    "ANOMALOUS_PATTERN": "monitor 2h + low-pri ticket", "NORMAL_BEHAVIOUR": "no action", "FALSE_POSITIVE": "tune triage rule",
}
FAST_PATH_ACTION = "Immediately isolate the host and escalate to Incident Response."
FAST_PATH_SCORE = 0.95


def hunter_features(signals: DataFrame) -> DataFrame:
    """Adds ``feature_vector``, the 42 values in order."""
    have = set(signals.columns)

    def value(name: str) -> Column:
        if name == "ioc_boost":
            return F.col("ioc_match") * F.col("ioc_confidence") / 100.0
        if name in ABSENT:
            return F.lit(0.0)
        source = PASSED.get(name, name)
        return F.coalesce(F.col(source).cast("double"), F.lit(0.0)) if source in have else F.lit(0.0)

    return signals.withColumn("feature_vector", F.array(*[value(n).cast("double") for n in FEATURE_ORDER]))


def heuristic_score(vector: str = "feature_vector") -> Column:
    """Weighted sum of capped features; distances count the nearer the better."""
    total = F.lit(0.0)
    for i, (name, weight, cap) in enumerate(FEATURES):
        raw = F.get(vector, F.lit(i))
        scaled = F.least(raw / cap, F.lit(1.0)) if cap else F.greatest(F.lit(0.0), F.least(raw, F.lit(1.0)))
        # any name with "dist" is inverted, distinct_categories too, as the published scorer does
        total = total + weight * ((1.0 - scaled) if "dist" in name and weight > 0 else scaled)
    return F.greatest(F.lit(0.0), F.least(total, F.lit(1.0)))


def verdict_fusion(score: str = "hunter_score") -> Column:
    """Finding from rule hits, baseline deviation and score; a campaign overrides all."""
    s, hit, odd = F.col(score), F.col("sigma_hit_count") > 0, F.col("spc_is_anomaly") == 1
    return (
        F.when(F.col("is_campaign") == 1, "ACTIVE_CAMPAIGN")
        .when((F.col("sigma_max_severity") >= 3) | (hit & odd), "CONFIRMED_ATTACK")
        .when(hit, "BEHAVIOURAL_ANOMALY")
        .when(odd, F.when(s >= 0.75, "CONFIRMED_ATTACK").otherwise("ANOMALOUS_PATTERN"))
        .when(s >= 0.85, "CONFIRMED_ATTACK").when(s >= 0.65, "BEHAVIOURAL_ANOMALY").otherwise("NORMAL_BEHAVIOUR")
    )


def severity_and_action(df: DataFrame) -> DataFrame:
    f = F.col("finding_type")
    return df.withColumns({"severity": F.coalesce(lookup(f, FINDING_SEVERITY), F.lit("medium")), "recommended_action": F.coalesce(lookup(f, RECOMMENDED_ACTION), F.lit("Investigate further."))})


def fast_path_verdict(with_hits: DataFrame) -> DataFrame:
    """An extra, immediate verdict for every alert with a high or critical rule hit."""
    titles = F.array_join(F.transform("sigma_hits", lambda h: h["title"]), "; ")
    brief = F.transform("sigma_hits", lambda h: F.struct(h["rule_id"].alias("rule_id"), h["title"].alias("title"), h["severity"].alias("severity")))
    return with_hits.where("sigma_max_severity >= 3").select(
        F.col("event_id").alias("alert_id"), "hostname", "source_ip", "user_id", F.col("adjusted_score").alias("trigger_score"), F.lit("critical").alias("severity"), F.lit("CONFIRMED_ATTACK").alias("finding_type"),
        F.concat(F.lit("High-severity Sigma rule hit on "), F.col("hostname"), F.lit(" – immediate escalation. "), titles).alias("summary"),
        F.to_json(F.struct(F.lit(True).alias("fast_path"), brief.alias("sigma_hits"))).alias("evidence_json"), F.lit(FAST_PATH_ACTION).alias("recommended_action"),
        F.lit(FAST_PATH_SCORE).alias("confidence"), F.lit(1).alias("is_fast_path"),
    )


def _fmt(pattern: str, *cols) -> Column:
    return F.format_string(pattern, *cols)


def _num(c: str) -> Column:
    return F.col(c).cast("double")


def narrative() -> Column:
    """Plain notes on an alert: who and what, each signal that spoke up, those that did not, techniques, campaign and advice."""
    c, num, whole = F.col, _num, lambda x: F.col(x).cast("bigint")
    named = lambda x: F.coalesce(F.nullif(c(x), F.lit("")), F.lit("unknown"))
    who = _fmt("%s on host %s (address %s, user %s): severity %s, %.3f after triage at %.3f.", c("finding_type"), c("hostname"), named("source_ip"), named("user_id"), c("severity"), num("hunter_score"), num("adjusted_score"))
    what = F.when(c("message") != "", _fmt("The %s event says: %s", c("source_type"), c("message")))
    rules = F.transform("sigma_hits", lambda h: F.concat(F.lit("- rule "), h["rule_id"], F.lit(", "), severity_word(h["severity"]), F.lit(" ("), h["category"], F.lit("): "), h["title"]))
    ids = F.coalesce("related_alert_ids", F.array().cast("array<bigint>"))
    connected = (c("graph_unique_destinations") > 0) | (c("graph_has_ioc_neighbor") == 1)
    rising, alike, unusual = c("temporal_escalation_count") > 0, c("similarity_confirmed_neighbor_count") > 0, c("spc_is_anomaly") == 1
    network = F.concat(
        _fmt("- network: %d destinations over %d hosts", whole("graph_unique_destinations"), whole("graph_hop_count")), F.when(c("graph_has_ioc_neighbor") == 1, ", an indicator among them").otherwise(""),
        F.when(c("graph_lateral_movement_score") > 0, _fmt(", lateral movement %.2f", num("graph_lateral_movement_score"))).otherwise(""), F.when(c("graph_c2_candidate_score") > 0, _fmt(", command channel %.2f", num("graph_c2_candidate_score"))).otherwise(""),
        F.when(c("graph_high_risk_neighbors") > 0, _fmt(", %d risky neighbours", whole("graph_high_risk_neighbors"))).otherwise(""))
    earlier = F.concat(
        _fmt("- time: %d higher alerts before, of %d kinds and %d tactics, mean %.3f", whole("temporal_escalation_count"), whole("temporal_unique_categories"), whole("temporal_tactic_diversity"), num("temporal_mean_score")),
        F.when(F.size(ids) > 0, F.concat(F.lit("; related: "), F.array_join(ids.cast("array<string>"), ", "))).otherwise(""))
    signals = F.concat(rules, F.array_compact(F.array(
        F.when(unusual, _fmt("- rate: %.2f deviations from a mean of %.1f a minute (deviation %.1f)", num("spc_z_score"), num("spc_baseline_mean"), num("spc_baseline_stddev"))), F.when(connected, network), F.when(rising, earlier),
        F.when(alike, _fmt("- likeness: %d confirmed attacks nearby, the nearest at %.3f, labels agree to %.2f", whole("similarity_confirmed_neighbor_count"), num("similarity_min_confirmed_dist"), num("similarity_label_confidence"))),
        F.when(c("similarity_false_positive_count") > 0, _fmt("- likeness: %d false alarms nearby lower the score", whole("similarity_false_positive_count"))))))
    silent = F.array_compact(F.array(F.when(F.size("sigma_hits") == 0, "rules"), F.when(~unusual, "rate"), F.when(~connected, "network"), F.when(~rising, "time"), F.when(~alike, "likeness")))
    techniques = F.when(c("mitre_match_count") > 0, F.concat(F.lit("Techniques "), F.array_join("mitre_techniques", ", "), F.lit(" in "), F.array_join("mitre_tactics", ", "), F.lit(".")))
    campaign = F.when(c("is_campaign") == 1, F.concat(
        F.lit("Campaign "), c("campaign_id"), _fmt(": %d hosts, %d tactics", whole("campaign_host_count"), whole("campaign_tactic_count")), F.when(F.size("related_hosts") > 0, F.concat(F.lit("; "), F.array_join("related_hosts", ", "))).otherwise(""), F.lit(".")))
    return F.concat_ws(
        "\n", who, what, F.when(F.size(signals) > 0, F.concat(F.lit("Signals:\n"), F.array_join(signals, "\n"))), F.when(F.size(silent) > 0, F.concat(F.lit("Nothing from: "), F.array_join(silent, ", "), F.lit("."))), techniques, campaign,
        _fmt("Scored by %s. Advice: %s.", c("model_used"), F.coalesce(lookup(c("finding_type"), ACTION_HINT), F.lit("look into it"))))


def judge(signals: DataFrame, score: Column | None = None, model: str = "heuristic") -> DataFrame:
    """Score, finding, severity and advice for alerts that carry all signals."""
    df = hunter_features(signals)
    df = df.withColumns({"hunter_score": heuristic_score() if score is None else score, "model_used": F.lit(model)})
    return severity_and_action(df.withColumn("finding_type", verdict_fusion()))


def evidence_json() -> Column:
    brief = F.transform("sigma_hits", lambda h: F.struct(h["rule_id"].alias("rule_id"), h["title"].alias("title"), h["severity"].alias("severity")))
    return F.to_json(F.struct(
        brief.alias("sigma_hits"), "spc_z_score", "graph_hop_count", (F.col("graph_has_ioc_neighbor") == 1).alias("has_ioc_neighbor"), (F.col("is_campaign") == 1).alias("campaign_detected"), F.col("model_used").alias("ml_model")))


def investigations(judged: DataFrame) -> DataFrame:
    """Full verdict rows. Related alerts and hosts stay apart, as their ids differ in kind."""
    t = F.col("adjusted_score")
    return judged.select(
        F.col("event_id").alias("alert_id"), F.col("timestamp").alias("started_at"), F.lit("completed").alias("status"), "hostname", "source_ip", "user_id", t.alias("trigger_score"), "severity", "finding_type",
        narrative().alias("summary"), evidence_json().alias("evidence_json"), F.col("related_alert_ids").alias("correlated_events"), F.col("related_hosts").alias("correlated_hosts"), merge_ids().alias("correlated_all"),
        "mitre_tactics", "mitre_techniques", "recommended_action", F.col("hunter_score").alias("confidence"), "hunter_score", "feature_vector", F.lit(0).alias("is_fast_path"), "model_used")
