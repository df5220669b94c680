"""All signals of all alerts in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from watchtide.operators.investigate import signals as S
from watchtide.operators.investigate.scope import scope

SLIM = ["event_id", "hostname", "source_ip", "user_id", "timestamp", "adjusted_score"]


def gather_signals(alerts: DataFrame, network: DataFrame, scored: DataFrame, actions: DataFrame, iocs: DataFrame, as_of, rules=S.MITRE_RULES, similarity: DataFrame | None = None, baseline_hours: int = 24, noisy_limit: int = S.NOISY) -> DataFrame:
    """Alerts with every signal.

    Each signal is computed on the few columns it needs and joined back by ``event_id``;
    the wide alert rows are shuffled once, not once per window. Facts are limited to what the alerts can see.
    """
    slim = alerts.select(*SLIM)
    within = scope(slim)
    net = network.select("event_id", "timestamp", "hostname", "src_ip", "dst_ip", "dst_port", "protocol", "dns_query", "detection_rule")
    facts = scored.select(*SLIM, "source_type", "mitre_tactic", "action", "ioc_match")
    parts = [
        S.sigma_rules(alerts.select("event_id", "hostname", "source_ip", "timestamp", "message"), net, within=within),
        S.spc_evaluate(slim.select("event_id", "hostname", "source_ip", "timestamp"), net, actions, as_of, baseline_hours, within=within),
        S.graph_features(slim.select("event_id", "hostname", "source_ip", "timestamp"), net, facts, iocs, as_of, noisy_limit, within=within),
        S.temporal_correlation(slim, facts, within=within),
        S.campaign_detection(slim.select("event_id", "source_ip", "timestamp"), facts, net, within=within),
    ]
    if similarity is not None:
        parts.append(similarity)
    out = S.mitre_mapping(alerts, rules)
    for part in parts:
        out = out.join(part.select("event_id", *[c for c in part.columns if c not in out.columns]), "event_id", "left")
    if similarity is None:
        return S.without_similarity(out)
    one = {"similarity_attack_embed_dist", "similarity_historical_dist", "similarity_min_confirmed_dist"}
    return out.withColumns({c: F.coalesce(c, F.lit(1.0 if c in one else 0.0)) for c in S.SIMILARITY})
