"""Investigation of escalated alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchtide.operators import rollups as A, triage as G
from watchtide.operators.investigate import attack_graph as K, signals as S, verdict as V
from watchtide.operators.investigate.run import gather_signals
from watchtide.operators.investigate.scope import scope
from watchtide.plans.registry import query
from watchtide.plans.triage import RESULTS, rnd
from watchtide.plans.reports import ACTIONS, actions
from watchtide.session import cut_lineage, written_once
from watchtide.sources.views import AS_OF, Tables

T0 = f"TIMESTAMP '{AS_OF}'"
ALERTS = f"{RESULTS}, alerts AS (SELECT * FROM res WHERE adjusted_score >= 0.65)"
IN_WINDOW = "f.timestamp BETWEEN a.timestamp - INTERVAL 15 MINUTE AND a.timestamp"


def scored(t: Tables):
    full = G.triage_result(t.scores, t.thresholds, t.assets, t.iocs, t.allowlist, AS_OF)
    return full.join(t.scores.select("event_id", "message"), "event_id")


FACTS = ["event_id", "hostname", "source_ip", "user_id", "timestamp", "adjusted_score", "source_type", "mitre_tactic", "action", "ioc_match"]


def facts(t: Tables):
    """The few columns of the scores that windows read several times, written once for the query at hand."""
    return cut_lineage(scored(t).select(*FACTS))


def network(t: Tables):
    return t.network


def alerts(t: Tables):
    return S.investigation_gate(scored(t))


#: Columns of an alert that rules and baselines read.
ASKS = ["event_id", "hostname", "source_ip", "user_id", "timestamp", "source_type", "adjusted_score", "message"]


def asks(t: Tables):
    """The alerts' columns that windows read, written once: their keys bound the facts, then they meet them."""
    return cut_lineage(alerts(t).select(*ASKS))


@query("investigation_gate", f"WITH {ALERTS} SELECT event_id, round(adjusted_score, 6) AS adjusted_score FROM alerts")
def investigation_gate(t):
    return alerts(t).select("event_id", "adjusted_score")


# ---- detection rules -------------------------------------------------------------------

RULE_SQL = {}
for _r in S.RULES.values():
    on = " AND ".join(f"f.{'src_ip' if k == 'source_ip' else k} = a.{k}" for k in _r.keys)
    what = f"count(DISTINCT f.{_r.distinct})" if _r.distinct else "count(f.event_id)"
    words = " OR ".join(f"contains(lower(a.message), '{k}')" for k in _r.keywords)
    RULE_SQL[_r.id] = (f"(SELECT {what} FROM fx_network f WHERE {on} AND {IN_WINDOW} AND f.{_r.where})".replace("AND f.detection_rule", "AND f.detection_rule").replace("AND f.protocol = 'DNS' AND length(dns_query)", "AND f.protocol = 'DNS' AND length(f.dns_query)"), words, _r)
_FIRED = [f"CASE WHEN ({words}) OR m{i} > {r.more_than} THEN {{}} END" for i, (sql, words, r) in enumerate(RULE_SQL.values())]
SIGMA = f"""{ALERTS}, mm AS (SELECT a.*, {', '.join(f'{sql} AS m{i}' for i, (sql, _, _r) in enumerate(RULE_SQL.values()))} FROM alerts a),
sg AS (SELECT a.*, list_filter([{', '.join(c.format(repr(r.id)) for c, r in zip(_FIRED, S.RULES.values()))}], lambda x: x IS NOT NULL) AS ids, list_filter([{', '.join(c.format(r.level) for c, r in zip(_FIRED, S.RULES.values()))}], lambda x: x IS NOT NULL) AS lv FROM mm a)"""


@query("sigma_rules", f"WITH {SIGMA} SELECT event_id, array_to_string(ids, '|') AS rule_ids, CAST(len(ids) AS BIGINT) AS sigma_hit_count, CAST(coalesce(list_max(lv), 0) AS BIGINT) AS sigma_max_severity FROM sg")
def sigma_rules(t):
    return S.sigma_rules(asks(t), network(t)).select("event_id", F.transform("sigma_hits", lambda h: h["rule_id"]).alias("rule_ids"), "sigma_hit_count", "sigma_max_severity")


@query("sigma_rule_pack", f"WITH {SIGMA} SELECT rule_id, count(*) AS alerts FROM (SELECT unnest(ids) AS rule_id FROM sg) GROUP BY 1")
def sigma_rule_pack(t):
    return S.sigma_rule_hits(S.sigma_rules(asks(t), network(t))).groupBy("rule_id").agg(F.count("*").alias("alerts"))


_WORD = {v: k for k, v in S.SEVERITY.items()}
_HIT = " UNION ALL ".join(f"SELECT timestamp, event_id, source_type, hostname, '{r.id}' AS rule_id, '{r.title}' AS rule_name, '{_WORD[r.level]}' AS severity, '{S._tactic(r)}' AS mitre_tactic, '{S._technique(r)}' AS mitre_technique, m{i} AS matched_events FROM sg a WHERE ({words}) OR m{i} > {r.more_than}" for i, (_, words, r) in enumerate(RULE_SQL.values()))


@query("sigma_rule_hits", f"WITH {SIGMA} SELECT CAST(timestamp AS VARCHAR) AS hit_time, event_id AS alert_id, rule_id, rule_name, source_type, hostname, severity, mitre_tactic, mitre_technique, matched_events FROM ({_HIT})")
def sigma_rule_hits(t):
    return S.sigma_rule_hits(S.sigma_rules(asks(t), network(t)))


@query("rule_alert_join", f"WITH {SIGMA} SELECT event_id, m0, m1, m2, m3, m4, m5, m6 FROM sg")
def rule_alert_join(t):
    """Measure of every rule for every alert."""
    out, span = asks(t), S.minutes(15)
    hits = S.sigma_rules(out, network(t), {r.id: S.Rule(r.id, r.title, r.severity, r.category, keys=r.keys, where=r.where, distinct=r.distinct, more_than=-1) for r in S.RULES.values()}, window_min=span // 60_000_000)
    return hits.select("event_id", *[F.get("sigma_hits", F.lit(i))["matched_events"].alias(f"m{i}") for i in range(7)])


@query("fast_path_verdict", f"WITH {SIGMA} SELECT event_id AS alert_id, hostname, 'CONFIRMED_ATTACK' AS finding_type, 'critical' AS severity, 0.95::DOUBLE AS confidence, CAST(1 AS BIGINT) AS is_fast_path FROM sg WHERE list_max(lv) >= 3")
def fast_path_verdict(t):
    return V.fast_path_verdict(S.sigma_rules(asks(t), network(t))).select("alert_id", "hostname", "finding_type", "severity", "confidence", "is_fast_path")


# ---- window signals --------------------------------------------------------------------

ALERT_WINDOW = "alert_window_join"


@query(ALERT_WINDOW, f"""WITH {ALERTS} SELECT a.event_id, count(f.event_id) AS events, CAST(coalesce(sum(f.bytes_sent), 0) AS BIGINT) AS bytes_sent, count(DISTINCT f.dst_port) AS ports FROM alerts a LEFT JOIN fx_network f ON f.hostname = a.hostname AND {IN_WINDOW} GROUP BY a.event_id""")
def alert_window_join(t):
    """Facts of the alert's host in the 15 minutes before it."""
    from watchtide.functions.timeline import distinct_deltas, sum_deltas, sweep

    span, keys, ts = S.minutes(15), ["hostname"], "timestamp"
    few = asks(t).select("event_id", "hostname", "timestamp")
    some = scope(few).near(network(t), keys, span)
    sums = sum_deltas(some, keys, ts, span, {"events": F.lit(1), "bytes_sent": F.col("bytes_sent")})
    kinds = distinct_deltas(some, keys, ts, span, {"ports": F.col("dst_port")})
    return sweep(few, keys, ts, span, [sums, kinds]).select("event_id", "events", "bytes_sent", "ports")


SPC = f"""{ALERTS}, {ACTIONS}, mi AS (SELECT hostname, source_ip, date_trunc('minute', timestamp) AS m, count(*) AS c FROM actions WHERE timestamp >= {T0} - INTERVAL 720 HOUR GROUP BY ALL),
bl AS (SELECT hostname, source_ip, avg(c) AS mean, coalesce(stddev_samp(c), 0) AS sd FROM mi GROUP BY ALL),
sp AS (SELECT a.event_id, (SELECT count(*) FROM fx_network f WHERE f.hostname = a.hostname AND f.src_ip = a.source_ip AND f.timestamp BETWEEN a.timestamp - INTERVAL 60 MINUTE AND a.timestamp) AS obs, coalesce(mean, 0) AS mean, coalesce(sd, 0) AS sd FROM alerts a LEFT JOIN bl USING (hostname, source_ip))"""


@query("spc_evaluate", f"WITH {SPC} SELECT event_id, obs AS spc_observed, round(mean, 6) AS spc_baseline_mean, round(sd, 6) AS spc_baseline_stddev, round(CASE WHEN sd > 0 THEN (obs - mean) / sd ELSE 0 END, 6) AS spc_z_score, CAST(CASE WHEN sd > 0 THEN (obs - mean) / sd > 3 ELSE false END AS BIGINT) AS spc_is_anomaly FROM sp")
def spc_evaluate(t):
    return S.spc_evaluate(asks(t), network(t), actions(t), AS_OF, baseline_hours=720).select("event_id", "spc_observed", "spc_baseline_mean", "spc_baseline_stddev", "spc_z_score", "spc_is_anomaly")


@query("temporal_correlation", f"""WITH {ALERTS}, j AS (SELECT a.event_id, f.event_id AS fid, f.source_type, f.mitre_tactic, CAST(round(f.adjusted_score * 1000000) AS BIGINT) AS sc, f.adjusted_score AS fs, a.adjusted_score AS as_, f.source_ip = a.source_ip AS same_ip
 FROM alerts a JOIN res f ON f.hostname = a.hostname AND (f.source_ip = a.source_ip OR f.user_id = a.user_id) AND {IN_WINDOW})
SELECT event_id, count(*) FILTER (same_ip AND fs > round(as_, 4) + 1e-9) AS temporal_escalation_count, count(DISTINCT source_type) AS temporal_unique_categories, count(DISTINCT mitre_tactic) AS temporal_tactic_diversity, round(sum(sc)::DOUBLE / count(*) / 1000000, 6) AS temporal_mean_score FROM j GROUP BY event_id""")
def temporal_correlation(t):
    f = facts(t)
    return S.temporal_correlation(S.investigation_gate(f), f).select("event_id", "temporal_escalation_count", "temporal_unique_categories", "temporal_tactic_diversity", "temporal_mean_score")


@query("related_alerts", f"""WITH {ALERTS}, j AS (SELECT a.event_id, f.event_id AS fid, row_number() OVER (PARTITION BY a.event_id ORDER BY f.timestamp DESC, f.event_id DESC) AS rn
 FROM alerts a JOIN res f ON f.hostname = a.hostname AND (f.source_ip = a.source_ip OR f.user_id = a.user_id) AND {IN_WINDOW}) SELECT event_id, string_agg(fid, '|' ORDER BY rn) AS related_alert_ids FROM j WHERE rn <= 50 GROUP BY event_id""")
def related_alerts(t):
    f = facts(t)
    return S.temporal_correlation(S.investigation_gate(f), f).select("event_id", "related_alert_ids")


GRAPH_NOISE = 1200
GRAPH = f"""{ALERTS}, li AS (SELECT DISTINCT lower(trim(ioc_value)) AS v FROM fx_iocs WHERE ioc_type = 'ip' AND expires_at > {T0}), noisy AS (SELECT source_ip FROM res GROUP BY 1 HAVING count(*) > {GRAPH_NOISE}),
g AS (SELECT a.event_id, (SELECT count(DISTINCT f.dst_ip) FROM fx_network f WHERE f.src_ip = a.source_ip AND {IN_WINDOW}) AS d0, (SELECT count(DISTINCT f.hostname) FROM fx_network f WHERE f.src_ip = a.source_ip AND {IN_WINDOW}) AS hops,
 (SELECT count(DISTINCT f.src_ip) FROM fx_network f WHERE f.hostname = a.hostname AND {IN_WINDOW}) AS srcs, a.source_ip IN (SELECT v FROM li) AS ioc, a.source_ip IN (SELECT source_ip FROM noisy) AS noise,
 (SELECT count(*) FROM res f WHERE f.hostname = a.hostname AND f.adjusted_score >= 0.75 AND (f.ioc_match = 1 OR f.source_ip IN (SELECT v FROM li)) AND {IN_WINDOW}) AS hr,
 (SELECT count(*) FROM res f WHERE f.hostname = a.hostname AND f.adjusted_score >= 0.75 AND (f.ioc_match = 1 OR f.source_ip IN (SELECT v FROM li)) AND f.action = 'escalate' AND {IN_WINDOW}) AS esc FROM alerts a),
gr AS (SELECT *, CASE WHEN ioc OR NOT noise THEN d0 ELSE 0 END AS d FROM g)"""


@query("graph_features", f"""WITH {GRAPH} SELECT event_id, CAST(d AS BIGINT) AS graph_unique_destinations, srcs AS graph_unique_src_ips, CAST(ioc AS BIGINT) AS graph_has_ioc_neighbor, hops AS graph_hop_count, hr AS graph_high_risk_neighbors, esc AS graph_escalation_count,
 least(1.0, hops / 10.0::DOUBLE)::DOUBLE AS graph_lateral_movement_score, CASE WHEN d >= 3 AND hops >= 2 THEN least(1.0, d / 10.0::DOUBLE * (1 + ioc::INT)) ELSE 0 END::DOUBLE AS graph_c2_candidate_score FROM gr""")
def graph_features(t):
    f = facts(t)
    return S.graph_features(S.investigation_gate(f), network(t), f, t.iocs, AS_OF, noisy_limit=GRAPH_NOISE).select("event_id", *[c for c in V.FEATURE_ORDER if c.startswith("graph_")])


# ---- mapping and campaigns -------------------------------------------------------------

RULES = S.reachable_rules()
TRIG = "list_filter([CASE WHEN ioc_match = 1 THEN 'known_malicious_ip' END, CASE WHEN hour(timestamp) NOT BETWEEN 8 AND 17 THEN 'off_hours' END, " + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(message), '{w}')" for w in ws) + f" THEN '{n}' END" for ws, n in S.TEMPLATE_TRIGGERS) + ", CASE WHEN score_std_dev > 0.3 OR disagreement_flag = 1 THEN 'std_dev_high' END, CASE WHEN eif_score > 0.7 THEN 'eif_high' END], lambda x: x IS NOT NULL)"
MITRE = f"""{ALERTS}, tr AS (SELECT *, {TRIG} AS act FROM alerts), ru AS (SELECT * FROM (VALUES {', '.join(f"('{r[0]}', {r[1]}, {r[2]!r}, {r[3]}, '{r[4]}', '{r[6]}', {S.CONFIDENCE[r[7]]})" for r in RULES)}) AS t(rule_id, priority, feats, thr, tech, tac, conf)),
ma AS (SELECT a.event_id, ru.*, row_number() OVER (PARTITION BY a.event_id ORDER BY priority, rule_id) AS rn, len(act) > 0 AS has FROM tr a JOIN ru ON thr <= round(a.adjusted_score, 4) AND (len(act) = 0 OR list_has_any(feats, act))),
mk AS (SELECT event_id, rule_id, tac, tech, rn FROM ma WHERE rn <= CASE WHEN has THEN 25 ELSE 5 END)"""


@query("active_triggers", f"WITH {MITRE} SELECT event_id, array_to_string(act, '|') AS active_triggers FROM tr")
def active_triggers(t):
    return alerts(t).select("event_id", S.active_triggers().alias("active_triggers"))


@query("rule_overlap_join", f"WITH {MITRE} SELECT event_id, rule_id FROM mk")
def rule_overlap_join(t):
    return S.rule_overlap(alerts(t), RULES).select("event_id", F.explode("mitre_matches").alias("m")).select("event_id", "m.rule_id")


@query("top_k_per_group", f"WITH {MITRE} SELECT event_id, string_agg(rule_id, '|' ORDER BY rn) AS best FROM mk WHERE rn <= 3 GROUP BY event_id")
def top_k_per_group(t):
    best = F.transform(F.slice("mitre_matches", 1, 3), lambda m: m["rule_id"])
    return S.rule_overlap(alerts(t), RULES).where(F.size("mitre_matches") > 0).select("event_id", best.alias("best"))


@query("mitre_mapping", f"""WITH {MITRE}, al2 AS (SELECT event_id, rule_id, tac, tech, rn FROM mk UNION ALL SELECT event_id, 'triage_passthrough', mitre_tactic, mitre_technique, 99 FROM alerts WHERE mitre_tactic <> '' AND NOT EXISTS (SELECT 1 FROM mk WHERE mk.event_id = alerts.event_id AND mk.tac = alerts.mitre_tactic)),
 tt AS (SELECT event_id, tac, min(rn) AS o FROM al2 GROUP BY ALL), qq AS (SELECT event_id, tech, min(rn) AS o FROM al2 GROUP BY ALL)
SELECT a.event_id, (SELECT count(*) FROM al2 WHERE al2.event_id = a.event_id) AS mitre_match_count, (SELECT count(*) FROM tt WHERE tt.event_id = a.event_id AND tac <> '') AS mitre_tactic_breadth,
 coalesce((SELECT string_agg(tac, '|' ORDER BY o) FROM tt WHERE tt.event_id = a.event_id), '') AS mitre_tactics, coalesce((SELECT string_agg(tech, '|' ORDER BY o) FROM qq WHERE qq.event_id = a.event_id), '') AS mitre_techniques FROM alerts a""")
def mitre_mapping(t):
    return S.mitre_mapping(alerts(t), RULES).select("event_id", "mitre_match_count", "mitre_tactic_breadth", "mitre_tactics", "mitre_techniques")


CAMPAIGN = f"""{ALERTS}, hc AS (SELECT a.event_id, f.hostname AS h, count(*) AS n FROM alerts a JOIN fx_network f ON f.src_ip = a.source_ip AND {IN_WINDOW} GROUP BY ALL HAVING count(*) >= 3),
cp AS (SELECT a.event_id, any_value(a.source_ip) AS ip, count(DISTINCT f.hostname) AS hosts, count(DISTINCT f.mitre_tactic) AS tactics FROM alerts a JOIN res f ON f.source_ip = a.source_ip AND {IN_WINDOW} JOIN hc ON hc.event_id = a.event_id AND hc.h = f.hostname GROUP BY a.event_id)"""


@query("campaign_detection", f"WITH {CAMPAIGN} SELECT a.event_id, coalesce(hosts, 0) AS campaign_host_count, coalesce(tactics, 0) AS campaign_tactic_count, CAST(coalesce(hosts, 0) >= 2 AND coalesce(tactics, 0) >= 2 AS BIGINT) AS is_campaign FROM alerts a LEFT JOIN cp USING (event_id)")
def campaign_detection(t):
    f = facts(t)
    return S.campaign_detection(S.investigation_gate(f), f, network(t)).select("event_id", "campaign_host_count", "campaign_tactic_count", "is_campaign")


@query("campaign_hosts", f"""WITH {CAMPAIGN}, rh AS (SELECT a.event_id, f.hostname AS h FROM alerts a JOIN cp ON cp.event_id = a.event_id AND cp.hosts >= 2 AND cp.tactics >= 2 JOIN res f ON f.source_ip = a.source_ip AND {IN_WINDOW} GROUP BY ALL) SELECT event_id, string_agg(h, '|' ORDER BY h) AS related_hosts FROM rh GROUP BY event_id""")
def campaign_hosts(t):
    f = facts(t)
    return S.campaign_detection(S.investigation_gate(f), f, network(t)).where("is_campaign = 1").select("event_id", "related_hosts")


@query("merge_ids", "SELECT conv_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), '|') AS merged FROM (SELECT conv_id, list(role) AS a, list(CAST(turn AS VARCHAR)) AS b FROM conversations GROUP BY conv_id)")
def merge_ids(t):
    lists = t.base("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("a"), F.array_sort(F.collect_set(F.col("turn").cast("string"))).alias("b"))
    return lists.select("conv_id", F.array_sort(S.merge_ids("a", "b")).alias("merged"))


# ---- verdicts --------------------------------------------------------------------------


def all_signals(t: Tables):
    """Alerts with every signal. The scores are joined once; alerts and facts read their own columns and rows of them."""
    known = written_once(scored(t))
    return gather_signals(S.investigation_gate(known), network(t), known.select(*FACTS), actions(t), t.iocs, AS_OF, RULES, baseline_hours=720, noisy_limit=GRAPH_NOISE)


# every signal of every alert, and the 42 features in their order
_PARTS = "".join(x[len(ALERTS):] for x in (SIGMA, SPC, GRAPH, MITRE, CAMPAIGN))
HUNT = f"""{ALERTS}{_PARTS},
 tj AS (SELECT a.event_id, f.source_type, f.mitre_tactic, CAST(round(f.adjusted_score * 1000000) AS BIGINT) AS sc, f.adjusted_score AS fs, a.adjusted_score AS as_, f.source_ip = a.source_ip AS same_ip
  FROM alerts a JOIN res f ON f.hostname = a.hostname AND (f.source_ip = a.source_ip OR f.user_id = a.user_id) AND {IN_WINDOW}),
 te AS (SELECT event_id, count(*) FILTER (same_ip AND fs > round(as_, 4) + 1e-9) AS rises, count(DISTINCT source_type) AS kinds, count(DISTINCT mitre_tactic) AS tactics, sum(sc)::DOUBLE / count(*) / 1000000 AS mean FROM tj GROUP BY 1),
 mx AS (SELECT event_id, rule_id, tac FROM mk UNION ALL SELECT event_id, 'triage_passthrough', mitre_tactic FROM alerts WHERE mitre_tactic <> '' AND NOT EXISTS (SELECT 1 FROM mk WHERE mk.event_id = alerts.event_id AND mk.tac = alerts.mitre_tactic)),
 mc AS (SELECT event_id, count(*) AS matches, count(DISTINCT tac) FILTER (tac <> '') AS breadth FROM mx GROUP BY 1),
 hunt AS (SELECT a.event_id, a.adjusted_score, a.combined_score AS base_score, a.asset_multiplier AS entity_risk, a.ioc_match * a.ioc_confidence / 100.0 AS ioc_boost, 0 AS temporal_boost, 0 AS destination_risk, 0 AS off_hours_boost, 0 AS high_severity_count, 0 AS medium_severity_count,
  0 AS distinct_categories, 0 AS event_count, 0 AS correlated_alert_count, a.template_rarity AS template_risk, gr.d AS graph_unique_destinations, gr.srcs AS graph_unique_src_ips, gr.ioc::INT AS graph_has_ioc_neighbor, gr.hops AS graph_hop_count, gr.hr AS graph_high_risk_neighbors, gr.esc AS graph_escalation_count,
  least(1.0, gr.hops / 10.0::DOUBLE) AS graph_lateral_movement_score, CASE WHEN gr.d >= 3 AND gr.hops >= 2 THEN least(1.0, gr.d / 10.0::DOUBLE * (1 + gr.ioc::INT)) ELSE 0 END AS graph_c2_candidate_score, coalesce(te.rises, 0) AS temporal_escalation_count, coalesce(te.kinds, 0) AS temporal_unique_categories,
  coalesce(te.tactics, 0) AS temporal_tactic_diversity, coalesce(te.mean, 0) AS temporal_mean_score, 1 AS similarity_attack_embed_dist, 1 AS similarity_historical_dist, 0 AS similarity_log_embed_matches, 0 AS similarity_confirmed_neighbor_count, 1 AS similarity_min_confirmed_dist, 0 AS similarity_false_positive_count,
  0 AS similarity_label_confidence, coalesce(mc.matches, 0) AS mitre_match_count, coalesce(mc.breadth, 0) AS mitre_tactic_breadth, coalesce(cp.hosts, 0) AS campaign_host_count, coalesce(cp.tactics, 0) AS campaign_tactic_count, len(sg.ids) AS sigma_hit_count, coalesce(list_max(sg.lv), 0) AS sigma_max_severity,
  CASE WHEN sp.sd > 0 THEN (sp.obs - sp.mean) / sp.sd ELSE 0 END AS spc_z_score, CASE WHEN sp.sd > 0 AND (sp.obs - sp.mean) / sp.sd > 3 THEN 1 ELSE 0 END AS spc_is_anomaly, sp.mean AS spc_baseline_mean, sp.sd AS spc_baseline_stddev
  FROM alerts a JOIN gr USING (event_id) JOIN sg USING (event_id) JOIN sp USING (event_id) LEFT JOIN te USING (event_id) LEFT JOIN mc USING (event_id) LEFT JOIN cp USING (event_id))"""
_HUNT_COLUMNS = ["adjusted_score", "base_score", "entity_risk", "ioc_boost", "temporal_boost", "destination_risk", "off_hours_boost", "high_severity_count", "medium_severity_count", "distinct_categories", "event_count", "correlated_alert_count", "template_risk", "graph_unique_destinations", "graph_unique_src_ips", "graph_has_ioc_neighbor", "graph_hop_count",
                 "graph_high_risk_neighbors", "graph_escalation_count", "graph_lateral_movement_score", "graph_c2_candidate_score", "temporal_escalation_count", "temporal_unique_categories", "temporal_tactic_diversity", "temporal_mean_score", "similarity_attack_embed_dist", "similarity_historical_dist", "similarity_log_embed_matches",
                 "similarity_confirmed_neighbor_count", "similarity_min_confirmed_dist", "similarity_false_positive_count", "similarity_label_confidence", "mitre_match_count", "mitre_tactic_breadth", "campaign_host_count", "campaign_tactic_count", "sigma_hit_count", "sigma_max_severity", "spc_z_score", "spc_is_anomaly", "spc_baseline_mean", "spc_baseline_stddev"]


@query("hunter_features", f"WITH {HUNT} SELECT event_id, {', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in _HUNT_COLUMNS)} FROM hunt")
def hunter_features(t):
    return V.hunter_features(all_signals(t)).select("event_id", *[F.get("feature_vector", F.lit(i)).alias(n) for i, n in enumerate(V.FEATURE_ORDER)])


def _scaled(i, name, weight, cap, raw):
    s = f"least({raw} / {cap}, 1.0)" if cap else f"greatest(0.0, least({raw}, 1.0))"
    return f"{weight} * (1.0 - {s})" if "dist" in name and weight > 0 else f"{weight} * {s}"


H_RAW = {n: f"(((event_id * {7 + 2 * i}) % {97 + i})::DOUBLE / {10 if cap else 90})" for i, (n, _, cap) in enumerate(V.FEATURES)}


@query("heuristic_score", f"SELECT event_id, round(greatest(0.0, least({' + '.join(_scaled(i, n, w, c, H_RAW[n]) for i, (n, w, c) in enumerate(V.FEATURES))}, 1.0)), 6) AS hunter_score FROM events")
def heuristic_score(t):
    e = F.col("event_id")
    vec = F.array(*[((e * (7 + 2 * i)) % (97 + i)).cast("double") / (10 if cap else 90) for i, (_, _, cap) in enumerate(V.FEATURES)])
    return t.base("events").select("event_id", vec.alias("feature_vector")).select("event_id", V.heuristic_score().alias("hunter_score"))


FIND = """CASE WHEN event_id % 13 = 0 THEN 'ACTIVE_CAMPAIGN' WHEN sev >= 3 OR (hits > 0 AND odd) THEN 'CONFIRMED_ATTACK' WHEN hits > 0 THEN 'BEHAVIOURAL_ANOMALY' WHEN odd THEN CASE WHEN s >= 0.75 THEN 'CONFIRMED_ATTACK' ELSE 'ANOMALOUS_PATTERN' END
 WHEN s >= 0.85 THEN 'CONFIRMED_ATTACK' WHEN s >= 0.65 THEN 'BEHAVIOURAL_ANOMALY' ELSE 'NORMAL_BEHAVIOUR' END"""
FIND_IN = "(SELECT event_id, value / 500 AS s, event_id % 3 AS hits, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 + event_id % 4 END AS sev, event_id % 5 < 2 AS odd FROM events)"


def verdict_inputs(t: Tables):
    e = F.col("event_id")
    return t.base("events").select(
        "event_id", (F.col("value") / 500).alias("hunter_score"), (e % 3).alias("sigma_hit_count"), F.when(e % 3 == 0, 0).otherwise(1 + e % 4).alias("sigma_max_severity"),
        (e % 5 < 2).cast("int").alias("spc_is_anomaly"), (e % 13 == 0).cast("int").alias("is_campaign"))


@query("verdict_fusion", f"SELECT event_id, {FIND} AS finding_type FROM {FIND_IN}")
def verdict_fusion(t):
    return verdict_inputs(t).select("event_id", V.verdict_fusion().alias("finding_type"))


def _map_case(col, table, default):
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


@query("severity_and_action", f"WITH x AS (SELECT event_id, {FIND} AS finding_type FROM {FIND_IN}) SELECT event_id, finding_type, {_map_case('finding_type', V.FINDING_SEVERITY, 'medium')} AS severity, {_map_case('finding_type', V.RECOMMENDED_ACTION, '')} AS recommended_action FROM x")
def severity_and_action(t):
    return V.severity_and_action(verdict_inputs(t).select("event_id", V.verdict_fusion().alias("finding_type")))


# (feature, weight, cap or None for 0 to 1; distances count the nearer the better)
_WEIGHTS = [("adjusted_score", 0.15, None), ("base_score", 0.04, None), ("entity_risk", 0.04, None), ("ioc_boost", 0.05, None), ("template_risk", 0.02, None), ("graph_unique_destinations", 0.02, 50), ("graph_unique_src_ips", 0.01, 50), ("graph_has_ioc_neighbor", 0.04, None), ("graph_hop_count", 0.02, 10),
            ("graph_high_risk_neighbors", 0.02, 10), ("graph_escalation_count", 0.02, 20), ("graph_lateral_movement_score", 0.03, None), ("graph_c2_candidate_score", 0.03, None), ("temporal_escalation_count", 0.03, 20), ("temporal_unique_categories", 0.01, 10), ("temporal_tactic_diversity", 0.01, None), ("temporal_mean_score", 0.02, None),
            ("mitre_match_count", 0.02, 10), ("mitre_tactic_breadth", 0.02, None), ("campaign_host_count", 0.03, 20), ("campaign_tactic_count", 0.02, 10), ("sigma_hit_count", 0.04, 5), ("sigma_max_severity", 0.03, None), ("spc_z_score", 0.03, 10), ("spc_is_anomaly", 0.03, None)]
_TERMS = " + ".join(f"{w} * least({n} / {c}.0, 1.0)" if c else f"{w} * greatest(0.0, least({n}, 1.0))" for n, w, c in _WEIGHTS)
JUDGED = f"""{HUNT}, rated AS (SELECT *, greatest(0.0, least({_TERMS} + 0.01, 1.0)) AS s FROM hunt),
 ju AS (SELECT *, CASE WHEN campaign_host_count >= 2 AND campaign_tactic_count >= 2 THEN 'ACTIVE_CAMPAIGN' WHEN sigma_max_severity >= 3 OR (sigma_hit_count > 0 AND spc_is_anomaly = 1) THEN 'CONFIRMED_ATTACK' WHEN sigma_hit_count > 0 THEN 'BEHAVIOURAL_ANOMALY'
  WHEN spc_is_anomaly = 1 THEN CASE WHEN s >= 0.75 THEN 'CONFIRMED_ATTACK' ELSE 'ANOMALOUS_PATTERN' END WHEN s >= 0.85 THEN 'CONFIRMED_ATTACK' WHEN s >= 0.65 THEN 'BEHAVIOURAL_ANOMALY' ELSE 'NORMAL_BEHAVIOUR' END AS finding_type FROM rated),
 jd AS (SELECT *, CASE finding_type WHEN 'CONFIRMED_ATTACK' THEN 'critical' WHEN 'ACTIVE_CAMPAIGN' THEN 'critical' WHEN 'BEHAVIOURAL_ANOMALY' THEN 'high' WHEN 'ANOMALOUS_PATTERN' THEN 'medium' ELSE 'low' END AS severity FROM ju)"""


@query("verdicts", f"WITH {JUDGED} SELECT event_id, round(s::DOUBLE, 6) AS hunter_score, finding_type, severity FROM jd")
def verdicts(t):
    """Score, finding and severity of every alert from all its signals."""
    return V.judge(all_signals(t)).select("event_id", "hunter_score", "finding_type", "severity")


@query("narrative")
def narrative(t):
    return V.judge(all_signals(t)).select("event_id", V.narrative().alias("summary"))


@query("investigations")
def investigations(t):
    """Verdict rows of every alert."""
    return V.investigations(V.judge(all_signals(t))).drop("feature_vector")


@query("attack_graph_nodes")
def attack_graph_nodes(t):
    return K.attack_graph_nodes(K.with_graph(V.judge(all_signals(t))))


@query("attack_graph_edges")
def attack_graph_edges(t):
    return K.attack_graph_edges(K.with_graph(V.judge(all_signals(t))))


@query("attack_graph_sigma_edges", f"""WITH {SIGMA}, ex AS (SELECT event_id, hostname, unnest(ids) AS rule_id, unnest(lv) AS level, unnest(range(len(ids))) AS i FROM sg)
SELECT event_id AS inv_id, concat('host-', regexp_replace(hostname, '[^A-Za-z0-9_]', '_', 'g')) AS src, concat('sigma-', i, '-', regexp_replace(rule_id, '[^A-Za-z0-9_]', '_', 'g')) AS dst, concat('Sigma: ', CASE level WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END) AS label FROM ex""")
def attack_graph_sigma_edges(t):
    edges = K.attack_graph_edges(K.with_graph(V.judge(all_signals(t))))
    return edges.where("type = 'detection'").select("inv_id", "src", "dst", "label")


@query("attack_graph_mermaid")
def attack_graph_mermaid(t):
    return K.attack_graph_mermaid(K.with_graph(V.judge(all_signals(t))))


def cases(t: Tables):
    hour = F.date_trunc("hour", "timestamp")
    parts = t.security.where("severity >= 3").groupBy(hour.cast("string").alias("case_id")).agg(
        F.array_sort(F.collect_set(F.nullif("user_id", F.lit("")))).alias("users"), F.array_sort(F.collect_set("hostname")).alias("hosts"), F.array_sort(F.collect_set("mitre_technique")).alias("tags"))
    return parts


CASES = """cs AS (SELECT CAST(date_trunc('hour', timestamp) AS VARCHAR) AS case_id, coalesce(list_sort(list(DISTINCT user_id) FILTER (user_id <> '')), []) AS users, list_sort(list(DISTINCT hostname)) AS hosts, list_sort(list(DISTINCT mitre_technique)) AS tags FROM fx_security WHERE severity >= 3 GROUP BY 1)"""


@query("case_graph", f"""WITH {CASES} SELECT case_id, concat('user-', i) AS id, 'user' AS type, u AS label FROM (SELECT case_id, unnest(users) AS u, unnest(range(len(users))) AS i FROM cs)
 UNION ALL SELECT case_id, concat('host-', i), 'host', u FROM (SELECT case_id, unnest(hosts) AS u, unnest(range(len(hosts))) AS i FROM cs) UNION ALL SELECT case_id, 'technique', 'technique', array_to_string(tags, chr(10)) FROM cs WHERE len(tags) > 0""")
def case_graph(t):
    return K.case_graph(cases(t))[0]


@query("case_graph_edges", f"""WITH {CASES} SELECT case_id, concat('user-', i) AS src, 'host-0' AS dst, 'Session' AS label FROM (SELECT case_id, unnest(range(len(users))) AS i FROM cs)
 UNION ALL SELECT case_id, concat('host-', i), concat('host-', i + 1), 'Lateral' FROM (SELECT case_id, unnest(range(len(hosts) - 1)) AS i FROM cs) UNION ALL SELECT case_id, concat('host-', len(hosts) - 1), 'technique', tags[1] FROM cs""")
def case_graph_edges(t):
    return K.case_graph(cases(t))[1]


@query("merged_case", """WITH x AS (SELECT CAST(date_trunc('day', timestamp) AS VARCHAR) AS case_id, user_id, hostname, mitre_technique FROM fx_security WHERE severity >= 3)
SELECT case_id, array_to_string(coalesce(list_sort(list(DISTINCT user_id) FILTER (user_id <> '')), []), '|') AS users, array_to_string(list_sort(list(DISTINCT hostname)), '|') AS hosts, array_to_string(list_sort(list(DISTINCT mitre_technique)), '|') AS tags FROM x GROUP BY 1""")
def merged_case(t):
    return K.merge_cases(cases(t).withColumn("selection", F.date_trunc("day", F.col("case_id").cast("timestamp")).cast("string")))
