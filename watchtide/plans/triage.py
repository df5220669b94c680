"""Lookup joins, connection windows, templates, features, fusion and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchtide.operators import lookups as J, netfeatures as W, reports as R, rollups as A, templates as L, triage as G
from watchtide.operators.models import register_scorer
from watchtide.plans.registry import query
from watchtide.sources.views import AS_OF, Tables

T0 = f"TIMESTAMP '{AS_OF}'"

# ---- SQL of the routed results, used here and by the investigation checks ----------------

LOOKUPS = f"""th AS (SELECT source_type, arg_max(suspicious_threshold, version) AS s_th, arg_max(anomalous_threshold, version) AS a_th FROM fx_thresholds GROUP BY 1),
am AS (SELECT h.hostname, arg_min(a.multiplier, a.hostname_pattern) AS mult FROM (SELECT DISTINCT hostname FROM fx_scores) h JOIN fx_assets a ON h.hostname ILIKE a.hostname_pattern GROUP BY 1),
ioc AS (SELECT lower(trim(ioc_value)) AS v, max(confidence) AS conf FROM fx_iocs WHERE expires_at > {T0} GROUP BY 1),
al AS (SELECT DISTINCT entry_type, entry_value FROM fx_allowlist WHERE active = 1 AND (expires_at IS NULL OR expires_at > {T0}))"""
FUSED = """fu AS (SELECT *, lgbm_score * 0.6 + eif_score * 0.15 + arf_score * 0.25 AS combined_score, (lgbm_score + eif_score + arf_score) / 3 AS m FROM fx_scores),
fs AS (SELECT *, sqrt((power(lgbm_score - m, 2) + power(eif_score - m, 2) + power(arf_score - m, 2)) / 3) AS score_std_dev FROM fu)"""
RESULTS = f"""{LOOKUPS}, {FUSED},
lk AS (SELECT fs.*, coalesce(s_th, 0.39) AS s_th, coalesce(a_th, 0.89) AS a_th, coalesce(mult, 1.0) AS mult, coalesce(i1.conf, i2.conf) AS conf,
 (EXISTS (SELECT 1 FROM al WHERE entry_type = 'ip' AND entry_value = source_ip) OR EXISTS (SELECT 1 FROM al WHERE entry_type = 'user' AND entry_value = user_id AND user_id <> '') OR EXISTS (SELECT 1 FROM al WHERE entry_type = 'host' AND entry_value = fs.hostname)
  OR EXISTS (SELECT 1 FROM al WHERE entry_type = 'template' AND entry_value = template_id) OR EXISTS (SELECT 1 FROM al WHERE entry_type = 'source' AND entry_value = fs.source_type)) AS allowed
 FROM fs LEFT JOIN th USING (source_type) LEFT JOIN am ON am.hostname = fs.hostname LEFT JOIN ioc i1 ON i1.v = lower(source_ip) LEFT JOIN ioc i2 ON i2.v = lower(dst_ip)),
ad AS (SELECT *, CASE WHEN conf IS NOT NULL THEN greatest(mult, 1.5) ELSE mult END AS mu, CASE WHEN template_rarity < 0.15 THEN 0.1 * (1 - template_rarity / 0.15) ELSE 0 END + CASE WHEN conf IS NOT NULL THEN 0.15 ELSE 0 END AS boost FROM lk),
sc AS (SELECT *, CASE WHEN eif_score >= 0.65 THEN greatest(least(1.0, (combined_score + boost) * mu), 0.45) ELSE least(1.0, (combined_score + boost) * mu) END AS adj FROM ad),
ro AS (SELECT *, CASE WHEN adj >= a_th THEN 'escalate' WHEN adj >= s_th THEN 'monitor' ELSE 'discard' END AS act FROM sc),
res AS (SELECT event_id, timestamp, source_type, hostname, source_ip, dst_ip, user_id, template_id, template_rarity, message, combined_score, lgbm_score, eif_score, arf_score, score_std_dev, 1 - score_std_dev AS agreement,
 least(greatest(combined_score - 1.96 * score_std_dev, 0), 1) AS ci_lower, least(greatest(combined_score + 1.96 * score_std_dev, 0), 1) AS ci_upper, CASE WHEN allowed THEN 1.0 ELSE mu END AS asset_multiplier,
 CASE WHEN allowed THEN combined_score ELSE adj END AS adjusted_score, CASE WHEN allowed THEN 'discard' WHEN act = 'monitor' AND score_std_dev >= 0.3 AND adj >= 0.5 THEN 'escalate' ELSE act END AS action,
 CAST(CASE WHEN NOT allowed AND conf IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS ioc_match, CAST(CASE WHEN allowed THEN 0 ELSE coalesce(conf, 0) END AS BIGINT) AS ioc_confidence,
 CASE WHEN allowed THEN '' ELSE mitre_tactic END AS mitre_tactic, CASE WHEN allowed THEN '' ELSE mitre_technique END AS mitre_technique, CAST(0 AS BIGINT) AS features_stale, 'v1' AS model_version,
 CAST(CASE WHEN NOT allowed AND score_std_dev >= 0.3 THEN 1 ELSE 0 END AS BIGINT) AS disagreement_flag FROM ro)"""


def results(t: Tables):
    return G.triage_result(t.scores, t.thresholds, t.assets, t.iocs, t.allowlist, AS_OF)


def rnd(*cols):
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in cols)


@query("triage_result", f"""WITH {RESULTS} SELECT event_id, CAST(timestamp AS VARCHAR) AS timestamp, source_type, hostname, source_ip, user_id, template_id, {rnd('template_rarity', 'combined_score', 'lgbm_score', 'eif_score', 'arf_score', 'score_std_dev', 'agreement', 'ci_lower', 'ci_upper', 'asset_multiplier', 'adjusted_score')},
 action, ioc_match, ioc_confidence, mitre_tactic, mitre_technique, features_stale, model_version, disagreement_flag FROM res""")
def triage_result(t):
    return results(t)


@query("routing_action", f"WITH {RESULTS} SELECT source_type, action, count(*) AS cnt, CAST(sum(disagreement_flag) AS BIGINT) AS flagged FROM res GROUP BY ALL")
def routing_action(t):
    return results(t).groupBy("source_type", "action").agg(F.count("*").alias("cnt"), F.sum("disagreement_flag").alias("flagged"))


@query("adjusted_score", f"WITH {RESULTS} SELECT event_id, {rnd('adj', 'mu')} FROM ro")
def adjusted_score(t):
    df = J.ioc_enrich(J.asset_pattern_join(G.score_fusion(t.scores), t.assets), t.iocs, AS_OF)
    return G.adjusted_score(df).select("event_id", F.col("adjusted_score").alias("adj"), F.col("asset_multiplier").alias("mu"))


_BOOSTED = "least(1.0, combined_score + CASE WHEN 1 - template_rarity < 0.15 THEN 0.1 * (1 - (1 - template_rarity) / 0.15) ELSE 0 END)"


@query("adjusted_score_by_frequency", f"WITH {FUSED} SELECT event_id, round(CASE WHEN eif_score >= 0.65 THEN greatest({_BOOSTED}, 0.45) ELSE {_BOOSTED} END, 6) AS adj FROM fs")
def adjusted_score_by_frequency(t):
    df = G.score_fusion(t.scores).withColumns({"ioc_match": F.lit(0), "asset_multiplier": F.lit(1.0)})
    return G.adjusted_score(df, rarity_as="frequency").select("event_id", F.col("adjusted_score").alias("adj"))


@query("score_fusion", """WITH w AS (SELECT *, 0.4 AS c, 0.25 * 0.4 AS w3, 0.25 - 0.25 * 0.4 AS free, (lgbm_score + eif_score + arf_score) / 3 AS m FROM fx_scores),
 x AS (SELECT *, lgbm_score * (0.6 + free * (0.6 / 0.75)) + eif_score * (0.15 + free * (0.15 / 0.75)) + arf_score * w3 AS combined_score, sqrt((power(lgbm_score - m, 2) + power(eif_score - m, 2) + power(arf_score - m, 2)) / 3) AS s FROM w)
SELECT event_id, round(CAST(combined_score AS DOUBLE), 6) AS combined_score, round(s, 6) AS score_std_dev, round(1 - s, 6) AS agreement, round(CAST(least(greatest(combined_score - 1.96 * s, 0), 1) AS DOUBLE), 6) AS ci_lower, round(CAST(least(greatest(combined_score + 1.96 * s, 0), 1) AS DOUBLE), 6) AS ci_upper FROM x""")
def score_fusion(t):
    return G.score_fusion(t.scores, G.model_confidence(4000)).select("event_id", "combined_score", "score_std_dev", "agreement", "ci_lower", "ci_upper")


@query("model_confidence", "SELECT hostname, least(1.0, count(*) / 1000.0)::DOUBLE AS confidence FROM fx_scores GROUP BY 1")
def model_confidence(t):
    return t.scores.groupBy("hostname").agg(F.count("*").alias("n")).select("hostname", G.model_confidence("n", 1000).alias("confidence"))


@query("calibrated_sigmoid", "SELECT event_id, round(1 / (1 + exp((eif_score - 0.393821) / 0.05784)), 6) AS score, round(1 - 1 / (1 + exp((eif_score - 0.393821) / 0.05784)), 6) AS flipped FROM fx_scores")
def calibrated_sigmoid(t):
    return t.scores.select("event_id", G.calibrated_sigmoid("eif_score", 0.393821, 0.05784).alias("score"), G.calibrated_sigmoid("eif_score", 0.393821, 0.05784, flip=True).alias("flipped"))


@query("ensemble_scores", "SELECT event_id, round(0.6 * greatest(least(lgbm_score, 1), 0) + 0.15 * greatest(least(eif_score, 1), 0) + 0.25 * greatest(least(arf_score, 1), 0), 6)::DOUBLE AS combined_score FROM fx_scores")
def ensemble_scores(t):
    """Three model columns from the fixture, clipped and fused; trained models are in the model plans."""
    return G.score_fusion(t.scores.withColumns({f"{m}_score": F.greatest(F.least(f"{m}_score", F.lit(1.0)), F.lit(0.0)) for m in G.WEIGHTS})).select("event_id", "combined_score")


@query("score_router_sink", f"WITH {RESULTS} SELECT event_id, action, round(adjusted_score, 6) AS adjusted_score, unnest(CASE WHEN action = 'escalate' THEN ['triage-scores', 'anomaly-alerts', 'hunter-tasks'] ELSE ['triage-scores'] END) AS topic FROM res")
def score_router_sink(t):
    return G.score_router(results(t)).select("event_id", "action", "adjusted_score", "topic")


@query("pseudo_labels", "SELECT event_id, CAST(CASE WHEN lgbm_score >= 0.8 THEN 1 WHEN lgbm_score <= 0.2 THEN 0 ELSE -1 END AS BIGINT) AS pseudo_label FROM fx_scores")
def pseudo_labels(t):
    return G.pseudo_labels(t.scores).select("event_id", "pseudo_label")


@query("triage_score_rollup", f"WITH {RESULTS} SELECT CAST(date_trunc('hour', timestamp) AS VARCHAR) AS hour, source_type, action, count(*) AS event_count, round(sum(combined_score), 6) AS score_sum, round(max(combined_score), 6) AS score_max FROM res GROUP BY ALL")
def triage_score_rollup(t):
    return A.triage_score_rollup(results(t))


@query("host_score_history", f"""WITH {RESULTS} SELECT hostname, count(*) FILTER (action = 'escalate') AS escalation_count, round(avg(adjusted_score), 6) AS mean_score, count(*) AS event_count, count(*) FILTER (adjusted_score >= 0.9) AS high_severity_count,
 count(*) FILTER (adjusted_score >= 0.8 AND adjusted_score < 0.9) AS medium_severity_count, greatest(count(*) FILTER (action = 'escalate') - 1, 0) AS correlated_alert_count FROM res GROUP BY hostname""")
def host_score_history(t):
    return A.host_score_history(results(t))


@query("scenario_report", f"""WITH {RESULTS} SELECT CASE source_ip WHEN '10.0.0.1' THEN 'port_scan' WHEN '10.0.0.2' THEN 'brute_force' WHEN '10.0.0.3' THEN 'normal' ELSE 'other' END AS scenario, count(*) AS cnt, round(avg(combined_score), 4) AS avg_combined, round(avg(lgbm_score), 4) AS avg_lgbm,
 round(avg(eif_score), 4) AS avg_eif, round(avg(arf_score), 4) AS avg_arf, round(min(combined_score), 4) AS min_score, round(max(combined_score), 4) AS max_score, round(quantile_cont(combined_score, 0.95), 4) AS p95, count(*) FILTER (action = 'discard') AS n_discard, count(*) FILTER (action = 'monitor') AS n_monitor,
 count(*) FILTER (action = 'escalate') AS n_escalate FROM res GROUP BY 1 HAVING scenario <> 'other'""")
def scenario_report(t):
    ip = F.col("source_ip")
    return R.scenario_report(results(t), F.when(ip == "10.0.0.1", "port_scan").when(ip == "10.0.0.2", "brute_force").when(ip == "10.0.0.3", "normal").otherwise("other"))


@query("top_scored_events", f"WITH {RESULTS} SELECT event_id, hostname, source_ip, round(combined_score, 6) AS combined_score, action FROM res ORDER BY res.combined_score DESC, event_id LIMIT 10")
def top_scored_events(t):
    return R.top_scored_events(results(t))


# ---- lookups ---------------------------------------------------------------------------


@query("event_score_join", "SELECT n.event_id, n.protocol, round(s.lgbm_score, 6) AS lgbm_score FROM fx_network n JOIN fx_scores s USING (event_id)")
def event_score_join(t):
    return J.event_score_join(t.network.select("event_id", "protocol"), t.scores.select("event_id", "lgbm_score"))


@query("threshold_lookup", f"WITH {LOOKUPS} SELECT event_id, coalesce(s_th, 0.39) AS suspicious_threshold, coalesce(a_th, 0.89) AS anomalous_threshold FROM fx_scores LEFT JOIN th USING (source_type)")
def threshold_lookup(t):
    return J.threshold_lookup(t.scores.select("event_id", "source_type"), t.thresholds).drop("source_type")


@query("threshold_coverage", "SELECT source_type, count(*) AS events FROM fx_scores WHERE source_type NOT IN (SELECT source_type FROM fx_thresholds) GROUP BY 1")
def threshold_coverage(t):
    return J.threshold_coverage(t.scores, t.thresholds)


@query("asset_pattern_join", f"WITH {LOOKUPS} SELECT event_id, s.hostname, CAST(coalesce(mult, 1.0) AS DOUBLE) AS asset_multiplier FROM fx_scores s LEFT JOIN am ON am.hostname = s.hostname")
def asset_pattern_join(t):
    return J.asset_pattern_join(t.scores.select("event_id", "hostname"), t.assets)


@query("first_match", "SELECT hostname, arg_min(multiplier, hostname_pattern) AS value FROM (SELECT DISTINCT hostname FROM fx_scores) h JOIN fx_assets a ON h.hostname ILIKE a.hostname_pattern GROUP BY 1")
def first_match(t):
    return J.asset_multipliers(t.scores, t.assets).withColumnRenamed("asset_multiplier", "value")


@query("ioc_enrich", f"WITH {LOOKUPS} SELECT event_id, CAST(coalesce(i1.conf, i2.conf) IS NOT NULL AS BIGINT) AS ioc_match, CAST(coalesce(i1.conf, i2.conf, 0) AS BIGINT) AS ioc_confidence FROM fx_scores LEFT JOIN ioc i1 ON i1.v = source_ip LEFT JOIN ioc i2 ON i2.v = dst_ip")
def ioc_enrich(t):
    return J.ioc_enrich(t.scores, t.iocs, AS_OF).select("event_id", "ioc_match", "ioc_confidence")


@query("allowlist_match", f"WITH {RESULTS} SELECT event_id, CAST(allowed AS BIGINT) AS is_allowed FROM ro")
def allowlist_match(t):
    return J.allowlist_match(t.scores, t.allowlist, AS_OF).select("event_id", "is_allowed")


@query("ioc_semi_join", f"WITH {LOOKUPS} SELECT event_id, src_ip FROM fx_network WHERE src_ip IN (SELECT lower(ioc_value) FROM fx_iocs WHERE ioc_type = 'ip' AND expires_at > {T0})")
def ioc_semi_join(t):
    return J.ioc_semi_join(t.network, t.iocs, AS_OF).select("event_id", "src_ip")


NOISE = 1200


@query("noisy_source_anti_join", f"""SELECT event_id, src_ip FROM fx_network WHERE src_ip IN (SELECT ioc_value FROM fx_iocs WHERE ioc_type = 'ip' AND expires_at > {T0})
 OR src_ip NOT IN (SELECT source_ip FROM fx_scores GROUP BY 1 HAVING count(*) > {NOISE})""")
def noisy_source_anti_join(t):
    return J.noisy_source_anti_join(t.network, t.scores, t.iocs, AS_OF, limit=NOISE).select("event_id", "src_ip")


@query("campaign_join", "SELECT s.event_id, s.hostname, s.source_ip FROM fx_scores s JOIN (SELECT hostname, src_ip FROM fx_network GROUP BY ALL HAVING count(*) >= 60) n ON s.hostname = n.hostname AND s.source_ip = n.src_ip")
def campaign_join(t):
    return J.campaign_join(t.scores, t.network, min_events=60).select("event_id", "hostname", "source_ip")


@query("latest_version", "SELECT user_id, arg_max(event_id, ts) AS event_id, CAST(max(ts) AS VARCHAR) AS ts FROM events GROUP BY user_id")
def latest_version(t):
    return J.latest_rows_by_key(t.base("events").select("user_id", "event_id", "ts"), ["user_id"], "ts")


@query("baseline_join", f"""WITH m AS (SELECT hostname, src_ip AS source_ip, date_trunc('minute', timestamp) AS mi, count(*) AS c FROM fx_network WHERE timestamp >= {T0} - INTERVAL 168 HOUR GROUP BY ALL), b AS (SELECT hostname, source_ip, avg(c) AS a, coalesce(stddev_samp(c), 0) AS s FROM m GROUP BY ALL)
SELECT event_id, round(coalesce(a, 0), 6) AS baseline_mean, round(coalesce(s, 0), 6) AS baseline_stddev FROM fx_scores LEFT JOIN b USING (hostname, source_ip)""")
def baseline_join(t):
    base = A.spc_baseline(t.network.withColumnRenamed("src_ip", "source_ip"), AS_OF, 168)
    return J.baseline_join(t.scores.select("event_id", "hostname", "source_ip"), base).select("event_id", "baseline_mean", "baseline_stddev")


# ---- connection windows ----------------------------------------------------------------

SERVICE = "CASE dst_port WHEN 445 THEN 'smb' WHEN 53 THEN 'dns' WHEN 443 THEN 'https' WHEN 80 THEN 'http' WHEN 22 THEN 'ssh' END"
ERROR = """CASE WHEN bytes_sent = 0 AND bytes_received = 0 AND duration_ms < 1 THEN 'syn_error' WHEN contains(lower(message), 'syn') AND (contains(lower(message), 'error') OR contains(lower(message), 'timeout')) THEN 'syn_error'
 WHEN contains(lower(message), 'reject') OR contains(lower(message), 'refused') OR contains(lower(message), 'rst') THEN 'rej_error' ELSE 'normal' END"""
W1 = f"""e AS (SELECT *, {SERVICE} AS service, {ERROR} AS error_type, epoch_us(timestamp) AS us FROM fx_network),
w1 AS (SELECT *, count(*) OVER p AS n, count(*) OVER s AS sn, count(*) FILTER (error_type = 'syn_error') OVER p AS se, count(*) FILTER (error_type = 'rej_error') OVER p AS re FROM e
 WINDOW p AS (PARTITION BY src_ip, dst_ip ORDER BY us RANGE BETWEEN 2000000 PRECEDING AND CURRENT ROW), s AS (PARTITION BY src_ip, dst_ip, service ORDER BY us RANGE BETWEEN 2000000 PRECEDING AND CURRENT ROW))"""
W2 = """w2 AS (SELECT event_id, len(list_distinct(list(src_ip) OVER h)) AS hc, len(list_filter(list(service) OVER h, lambda x: x = service)) AS hs FROM e WINDOW h AS (PARTITION BY dst_ip ORDER BY us, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))"""
W1_COLS = """CAST(n AS BIGINT) AS count, CAST(sn AS BIGINT) AS srv_count, round(sn / n, 6) AS same_srv_rate, round(1 - sn / n, 6) AS diff_srv_rate, round(se / n, 6) AS serror_rate, round(re / n, 6) AS rerror_rate"""


@query("conn_error_type", f"SELECT event_id, {ERROR} AS error_type FROM fx_network")
def conn_error_type(t):
    return t.network.select("event_id", W.conn_error_type().alias("error_type"))


@query("conn_window_2s", f"WITH {W1} SELECT event_id, {W1_COLS} FROM w1")
def conn_window_2s(t):
    return W.conn_window_2s(t.network).select("event_id", "count", "srv_count", "same_srv_rate", "diff_srv_rate", "serror_rate", "rerror_rate")


@query("conn_window_100", f"WITH {W1}, {W2} SELECT event_id, hc AS dst_host_count, hs AS dst_host_srv_count FROM w2")
def conn_window_100(t):
    # a small chunk makes the copies across chunks matter at every scale
    return W.conn_window_100(t.network, chunk=500).select("event_id", "dst_host_count", "dst_host_srv_count")


# ---- features --------------------------------------------------------------------------


def flagged_network(t: Tables):
    """Network events with indicator flag and template rarity."""
    counts = A.template_rarity_table(t.scores).groupBy("template_id").agg(F.sum("occurrence_count").alias("n"))
    total = t.scores.agg(F.count("*").alias("total"))
    rarity = counts.crossJoin(F.broadcast(total)).select("template_id", (1 - F.col("n") / F.col("total")).alias("template_rarity"))  # one row
    net = J.ioc_enrich(t.network, t.iocs, AS_OF, "src_ip", "dst_ip").withColumnRenamed("ioc_match", "threat_intel_flag").drop("ioc_confidence")
    net = net.withColumn("template_id", F.concat(F.lit("T"), F.col("event_id") % 21)).withColumn("template_rarity", F.lit(None).cast("double"))
    return L.template_rarity_lookup(net, rarity)


RARITY = "ra AS (SELECT template_id, 1 - count(*) / (SELECT count(*) FROM fx_scores) AS rarity FROM fx_scores GROUP BY 1)"


@query("triage_features", f"""WITH {LOOKUPS}, {RARITY}, {W1}, {W2} SELECT event_id, CAST(hour(timestamp) AS DOUBLE) AS hour_of_day, CAST(isodow(timestamp) - 1 AS DOUBLE) AS day_of_week, CAST(0 AS DOUBLE) AS severity_numeric, CAST(1 AS DOUBLE) AS source_type_numeric,
 CAST(bytes_sent AS DOUBLE) AS src_bytes, CAST(bytes_received AS DOUBLE) AS dst_bytes, round(CASE WHEN duration_ms > 0 THEN 60.0::DOUBLE / (duration_ms / 1000.0::DOUBLE) ELSE 0 END, 6) AS event_freq_1m, CAST(CASE protocol WHEN 'UDP' THEN 17 ELSE 6 END AS DOUBLE) AS protocol, CAST(dst_port AS DOUBLE) AS dst_port,
 round(rarity, 6) AS template_rarity, CAST(CASE WHEN i1.conf IS NOT NULL OR i2.conf IS NOT NULL THEN 1 ELSE 0 END AS DOUBLE) AS threat_intel_flag, round(duration_ms / 1000.0::DOUBLE, 6) AS duration, round(sn / n, 6) AS same_srv_rate, round(1 - sn / n, 6) AS diff_srv_rate, round(se / n, 6) AS serror_rate,
 round(re / n, 6) AS rerror_rate, CAST(n AS DOUBLE) AS count, CAST(sn AS DOUBLE) AS srv_count, CAST(hc AS DOUBLE) AS dst_host_count, CAST(hs AS DOUBLE) AS dst_host_srv_count
 FROM w1 JOIN w2 USING (event_id) LEFT JOIN ioc i1 ON i1.v = src_ip LEFT JOIN ioc i2 ON i2.v = dst_ip LEFT JOIN ra ON ra.template_id = concat('T', event_id % 21)""")
def triage_features(t):
    return G.triage_features(G.network_features(flagged_network(t)), "network-events").select("event_id", *G.FEATURES)


@query("triage_features_raw", f"""SELECT event_id, CAST(hour(timestamp) AS DOUBLE) AS hour_of_day, CAST({"CASE level WHEN 'CRITICAL' THEN 4 WHEN 'ERROR' THEN 3 WHEN 'WARNING' THEN 2 ELSE 0 END"} AS DOUBLE) AS severity_numeric,
 CAST(CASE source WHEN 'nginx' THEN 8 WHEN 'firewall' THEN 3 WHEN 'dns' THEN 5 WHEN 'kubernetes' THEN 7 ELSE 1 END AS DOUBLE) AS source_type_numeric, CAST(length(message) AS DOUBLE) AS src_bytes, CAST(6 AS DOUBLE) AS protocol, CAST(0 AS DOUBLE) AS count, 0.5::DOUBLE AS template_rarity FROM fx_raw""")
def triage_features_raw(t):
    return G.triage_features(t.raw, "raw-logs").select("event_id", "hour_of_day", "severity_numeric", "source_type_numeric", "src_bytes", "protocol", "count", "template_rarity")


@query("feature_row_sink", f"""WITH {W1} SELECT CAST(w1.timestamp AS VARCHAR) AS timestamp, event_id, s.source_type, CAST(n AS DOUBLE) AS count, CAST(CASE WHEN s.lgbm_score >= 0.8 THEN 1 ELSE 0 END AS BIGINT) AS label FROM w1 JOIN fx_scores s USING (event_id)""")
def feature_row_sink(t):
    features = G.triage_features(G.network_features(t.network.withColumn("source_type", F.lit("netflow"))), "network-events")
    return G.feature_row_sink(features, t.scores).select("timestamp", "event_id", "source_type", "count", "label")


@query("sanitize_features", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1e9 WHEN 2 THEN -1e9 ELSE round(value, 6) END::DOUBLE AS value FROM events")
def sanitize_features(t):
    m = F.col("event_id") % 4
    bad = F.when(m == 0, float("nan")).when(m == 1, float("inf")).when(m == 2, float("-inf")).otherwise(F.col("value"))
    return G.sanitize_features(t.base("events").select("event_id", bad.alias("value")), ["value"])


@query("replay_window", f"SELECT event_id, source_type FROM fx_scores WHERE timestamp >= {T0} - INTERVAL 24 HOUR AND timestamp <= {T0} ORDER BY timestamp, event_id LIMIT 50000")
def replay_window(t):
    return G.replay_window(t.scores, AS_OF).select("event_id", "source_type")


# ---- templates -------------------------------------------------------------------------


def sql_mask(c):
    """The masks without look-around: separators are captured, and put back, twice where they may overlap."""
    steps = [
        (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>", 1), (L.MASKS[1][0], "<IPV6>", 1), (L.MASKS[2][0], "<MAC>", 1), (L.MASKS[3][0], "<TIMESTAMP>", 1), (L.MASKS[4][0], "<TIMESTAMP>", 1),
        (r"([^A-Za-z0-9])0x[0-9a-fA-F]{8,}([^A-Za-z0-9]|$)", r"\1<HEX>\2", 2), (r"([^A-Za-z0-9.])\d{5,}([^A-Za-z0-9.:]|$)", r"\1<NUM>\2", 2), (L.MASKS[7][0], "<UUID>", 1), (L.MASKS[8][0], "<PATH>", 1), (r":\d{2,5}([^0-9]|$)", r":<PORT>\1", 2),
    ]
    c = f"trim({c})"
    for pattern, name, times in steps:
        for _ in range(times):
            c = f"regexp_replace({c}, '{pattern}', '{name}', 'g')"
    return c


@query("template_mask", f"SELECT event_id, {sql_mask('message')} AS masked FROM fx_raw")
def template_mask(t):
    return t.raw.select("event_id", L.template_mask("message").alias("masked"))


@query("log_template_groups", f"SELECT md5(array_to_string(regexp_split_to_array(masked, '\\s+'), ' ')) AS sig, count(*) AS size FROM (SELECT {sql_mask('message')} AS masked FROM fx_raw) WHERE masked <> '' GROUP BY 1")
def log_template_groups(t):
    return L.signatures(t.raw, "message").select("sig", "size")


@query("log_templates")
def log_templates(t):
    """Templates of log messages and of whole conversation and document texts."""
    lines = t.raw.select("message").unionByName(t.spread("conversations").select(F.col("text").alias("message"))).unionByName(t.spread("documents").select(F.col("text").alias("message")))
    return L.log_templates(lines)


_PREFIX = "array_to_string(list_transform(tokens[:2], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), ' ')"
_AGREE = "len(list_filter(range(1, len(s.tokens) + 1), lambda i: l.tokens[i] = s.tokens[i])) / len(s.tokens)"
#: The r-th signature of every bucket against the leaders before it, r by r.
TEMPLATES = f"""RECURSIVE lines AS MATERIALIZED (SELECT event_id, masked, regexp_split_to_array(masked, '\\s+') AS tokens FROM (SELECT event_id, {sql_mask("coalesce(message, '')")} AS masked FROM fx_raw)),
sigs AS MATERIALIZED (SELECT md5(array_to_string(tokens, ' ')) AS sig, any_value(tokens) AS tokens, count(*) AS size FROM lines WHERE masked <> '' GROUP BY 1),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY size DESC, sig) AS r FROM (SELECT *, len(tokens) || ' ' || {_PREFIX} AS bucket FROM sigs)),
go AS (
  SELECT DISTINCT bucket, CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(sig VARCHAR, tokens VARCHAR[])[]) AS leaders, '' AS sig, '' AS cluster FROM placed
  UNION ALL SELECT bucket, r, CASE WHEN found IS NULL THEN list_append(leaders, me) ELSE leaders END, sig, coalesce(found, sig)
  FROM (SELECT s.bucket, s.r, go.leaders, s.sig, {{'sig': s.sig, 'tokens': s.tokens}} AS me, list_filter(go.leaders, lambda l: {_AGREE} >= 0.4)[1].sig AS found FROM go JOIN placed s ON s.bucket = go.bucket AND s.r = go.r + 1)
),
members AS MATERIALIZED (SELECT go.cluster, placed.* FROM go JOIN placed USING (sig)),
shapes AS (SELECT cluster, i, CASE WHEN count(DISTINCT tokens[i]) > 1 THEN '<*>' ELSE min(tokens[i]) END AS token FROM (SELECT cluster, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM members) GROUP BY ALL),
named AS (SELECT cluster, string_agg(token, ' ' ORDER BY i) AS template FROM shapes GROUP BY 1),
rare AS (SELECT cluster, 1 - sum(size) / (SELECT sum(size) FROM sigs) AS rarity FROM members GROUP BY 1)"""


@query("template_assignment", f"""WITH {TEMPLATES} SELECT event_id, CASE WHEN masked = '' THEN 'empty' ELSE 'T' || substr(m.cluster, 1, 12) END AS template_id, CASE WHEN masked = '' THEN '<EMPTY>' ELSE template END AS template,
 CASE WHEN masked = '' THEN 0.5 ELSE rarity END AS template_rarity FROM lines LEFT JOIN members m ON m.sig = md5(array_to_string(lines.tokens, ' ')) LEFT JOIN named ON named.cluster = m.cluster LEFT JOIN rare ON rare.cluster = m.cluster""")
def template_assignment(t):
    """Every raw line with template and rarity."""
    return L.assign_templates(t.dealt(t.raw), L.log_templates(t.dealt(t.raw))).select("event_id", "template_id", "template", "template_rarity")


@query("template_rarity_lookup", f"WITH {RARITY} SELECT event_id, round(coalesce(rarity, 0.5), 6) AS template_rarity FROM fx_scores LEFT JOIN ra ON ra.template_id = fx_scores.template_id AND ra.template_id <> 'T5'")
def template_rarity_lookup(t):
    total = t.scores.agg(F.count("*").alias("total"))
    rarity = t.scores.where("template_id <> 'T5'").groupBy("template_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row
    return L.template_rarity_lookup(t.scores, rarity.select("template_id", (1 - F.col("n") / F.col("total")).alias("template_rarity"))).select("event_id", "template_rarity")


# ---- from event to routed score ------------------------------------------------------------


def linear_scorer(df):
    """A scorer whose scores follow from the windows, so that SQL can say the same."""
    return df.withColumns({"lgbm_score": F.least(F.lit(1.0), F.col("count") / 4), "eif_score": F.least(F.lit(1.0), F.col("dst_host_count") / 20), "arf_score": F.col("same_srv_rate")})


register_scorer("linear", linear_scorer)
EVENT_CONTEXT = ["event_id", "source_type", "source_ip", "user_id", "template_id", "template_rarity", "mitre_tactic", "mitre_technique"]
EVENT_RESULTS = f"""{W1}, {W2}, ev AS (SELECT s.* REPLACE (least(1.0, n / 4.0::DOUBLE) AS lgbm_score, least(1.0, hc / 20.0::DOUBLE) AS eif_score, sn / n AS arf_score) FROM fx_scores s JOIN w1 USING (event_id) JOIN w2 USING (event_id)),
{RESULTS.replace("fx_scores", "ev")}"""
EVENT_ROUTES = f"""WITH {EVENT_RESULTS} SELECT event_id, topic, action, {rnd('combined_score', 'adjusted_score')}, ioc_match, disagreement_flag
 FROM (SELECT *, unnest(CASE WHEN action = 'escalate' THEN ['triage-scores', 'anomaly-alerts', 'hunter-tasks'] ELSE ['triage-scores'] END) AS topic FROM res)"""
ROUTE_COLUMNS = ["event_id", "topic", "action", "combined_score", "adjusted_score", "ioc_match", "disagreement_flag"]


def with_context(t: Tables, windowed, scores=None):
    """What collectors add to a network event before it is scored."""
    have = [c for c in EVENT_CONTEXT if c not in windowed.columns or c == "event_id"]
    return windowed.join((t.scores if scores is None else scores).select(*have), "event_id")


def dims(t: Tables) -> dict:
    return {"thresholds": t.thresholds, "assets": t.assets, "iocs": t.iocs, "allowlist": t.allowlist}


@query("event_routes", EVENT_ROUTES)
def event_routes(t):
    """Network events to features, scores of a registered scorer, fused and routed results."""
    return G.route_events(with_context(t, G.network_features(t.network)), "network-events", "linear", dims(t), AS_OF).select(*ROUTE_COLUMNS)
