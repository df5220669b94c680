"""Sampling, labels, metrics, calibration, drift and training."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchtide.functions.ranking import exact_percentiles
from watchtide.operators import converters as C, evaluate as E, models as M, rollups as A, triage as G
from watchtide.operators.investigate.verdict import FEATURE_ORDER
from watchtide.plans.investigate import ALERTS, network, scored
from watchtide.plans.registry import query
from watchtide.plans.triage import RESULTS
from watchtide.session import cut_lineage
from watchtide.sources.views import AS_OF, Tables

T0 = f"TIMESTAMP '{AS_OF}'"
EVAL = "ev AS (SELECT doc_id, source, lang, quality AS label, (n_chars % 1000)::DOUBLE / 1000 AS score FROM labels JOIN documents USING (doc_id))"


def evaluated(t: Tables):
    """Labelled documents with a score from their length."""
    docs = t.base("documents").select("doc_id", "source", "lang", ((F.col("n_chars") % 1000).cast("double") / 1000).alias("score"))
    return t.base("labels").select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id")


@query("binary_metrics", f"""WITH {EVAL}, th AS (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (score < threshold AND label = 0) AS tn, count(*) FILTER (score < threshold AND label = 1) AS fn FROM ev, th GROUP BY 1),
 r AS (SELECT *, tp + fp + tn + fn AS n, (tp + tn) / (tp + fp + tn + fn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, fp / (fp + tn) AS fpr FROM c)
SELECT threshold, tp, fp, tn, fn, n, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM r""")
def binary_metrics(t):
    return E.binary_metrics(evaluated(t), "score", "label", [0.3, 0.5, 0.7])


@query("auc_ap", f"""WITH {EVAL}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM ev),
 s AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) AS n FROM ev GROUP BY 1), c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn FROM s)
SELECT round((SELECT (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))::DOUBLE FROM r), 6) AS auc_roc,
 round((SELECT sum(p::DOUBLE / (SELECT sum(p) FROM s) * cp::DOUBLE / cn) FROM c), 6) AS avg_precision""")
def auc_ap(t):
    return E.auc_ap(evaluated(t), "score", "label")


@query("per_group_detection", f"WITH {EVAL} SELECT source, count(*) AS n, round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0 END) FILTER (label = 1), 6) AS detection_rate, round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0 END) FILTER (label = 0), 6) AS fpr, round(avg(score), 6) AS mean_score FROM ev GROUP BY source HAVING count(*) >= 5")
def per_group_detection(t):
    return E.per_group_detection(evaluated(t), "source", "score", "label")


@query("leakage_check", f"WITH {EVAL}, m AS (SELECT lang, coalesce(avg(score) FILTER (label = 0), 0) AS normal_mean, coalesce(avg(score) FILTER (label = 1), 0) AS attack_mean FROM ev GROUP BY 1) SELECT lang, round(normal_mean, 6) AS normal_mean, round(attack_mean, 6) AS attack_mean, round(abs(attack_mean - normal_mean), 6) AS delta, CASE WHEN abs(attack_mean - normal_mean) < 1 THEN 'OK' ELSE 'WARN' END AS status FROM m")
def leakage_check(t):
    return E.leakage_check(evaluated(t), "lang", "score", "label")


@query("calibrate_thresholds", f"""WITH {EVAL}, p AS (SELECT quantile_cont(score, 0.95) FILTER (label = 0) AS n95, quantile_cont(score, 0.25) FILTER (label = 1) AS m25, quantile_cont(score, 0.5) FILTER (label = 1) AS m50 FROM ev),
 q AS (SELECT round(n95, 2) AS suspicious, CASE WHEN round(n95, 2) >= round(m50, 2) THEN round(greatest(m25, round(n95, 2) + 0.05), 2) ELSE round(m50, 2) END AS anomalous FROM p), f AS (SELECT ev.*, q.* FROM ev, q)
SELECT any_value(suspicious) AS suspicious, any_value(anomalous) AS anomalous, round(avg((score >= suspicious)::INT) FILTER (label = 1), 6) AS detect_suspicious, round(avg((score >= anomalous)::INT) FILTER (label = 1), 6) AS detect_anomalous, round(avg((score >= suspicious)::INT) FILTER (label = 0), 6) AS fpr_suspicious, round(avg((score >= anomalous)::INT) FILTER (label = 0), 6) AS fpr_anomalous FROM f""")
def calibrate_thresholds(t):
    return E.calibrate_thresholds(evaluated(t), "score", "label")


@query("score_percentiles", f"WITH {RESULTS} SELECT source_type, round(quantile_cont(combined_score, 0.5), 6) AS p50, round(quantile_cont(combined_score, 0.95), 6) AS p95, round(quantile_cont(combined_score, 0.99), 6) AS p99 FROM res GROUP BY 1")
def score_percentiles(t):
    return exact_percentiles(scored(t), ["source_type"], "combined_score", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("stratified_sample", "WITH x AS (SELECT event_id, event_type, md5(concat('42|', event_id)) AS h, row_number() OVER (PARTITION BY event_type ORDER BY md5(concat('42|', event_id))) AS rn FROM events) SELECT event_id, event_type FROM x WHERE rn <= 150")
def stratified_sample(t):
    return E.stratified_sample(t.base("events").select("event_id", "event_type"), ["event_type"], 150, ["event_id"])


@query("holdout_split", "WITH x AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(concat('42|', event_id))) AS rn FROM events) SELECT event_id FROM x WHERE rn > 150")
def holdout_split(t):
    events = t.base("events").select("event_id", "event_type")
    return E.holdout_split(events, E.stratified_sample(events, ["event_type"], 150, ["event_id"]), ["event_id"]).select("event_id")


def _print_sql(name: str, columns: dict[str, str]) -> str:
    row = ", ".join(f"coalesce(CAST({x} AS VARCHAR), '?')" for x in columns.values())
    return f"""SELECT '{name}' AS dataset, {len(columns)}::BIGINT AS columns, count(*) AS rows, sha256(concat_ws('|', '{name}', '{','.join(columns)}', CAST(count(*) AS VARCHAR), CAST(sum(h::HUGEINT) AS VARCHAR), CAST(min(h) AS VARCHAR), CAST(max(h) AS VARCHAR))) AS fingerprint
 FROM (SELECT CAST('0x' || substr(md5(concat_ws('|', {row})), 1, 14) AS BIGINT) AS h FROM {name})"""


@query("dataset_fingerprint", _print_sql("labels", {c: c for c in ("doc_id", "quality", "toxic")}) + " UNION ALL " + _print_sql("events", {"event_id": "event_id", "ts": "epoch_us(ts)", "user_id": "user_id", "event_type": "event_type", "value": "CAST(value AS DECIMAL(38,9))", "props": "props"}))
def dataset_fingerprint(t):
    return E.dataset_fingerprint(t.base("labels"), "labels").unionByName(E.dataset_fingerprint(t.base("events"), "events"))


FEATS = "fe AS (SELECT event_id, timestamp AS recorded_at, adjusted_score, combined_score, template_rarity, lgbm_score, eif_score FROM res)"
NAMES = ["adjusted_score", "combined_score", "template_rarity", "lgbm_score", "eif_score"]
LONG = " UNION ALL ".join(f"SELECT 'p' AS side, '{n}' AS feature, {n}::DOUBLE AS v FROM fb UNION ALL SELECT 'q', '{n}', {n}::DOUBLE FROM fn" for n in NAMES)
HIST = f"""lo AS ({LONG}), rg AS (SELECT feature, min(v) AS lo, max(v) + 1e-8 AS hi FROM lo GROUP BY 1), bn AS (SELECT feature, side, least(floor((v - lo) / ((hi - lo) / 10)), 9)::BIGINT AS bin, (hi - lo) / 10 AS w FROM lo JOIN rg USING (feature)),
gr AS (SELECT feature, (hi - lo) / 10 AS w, unnest(range(10)) AS bin FROM rg), ct AS (SELECT gr.feature, gr.bin, any_value(gr.w) AS w, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 'q') AS q FROM gr LEFT JOIN bn ON bn.feature = gr.feature AND bn.bin = gr.bin GROUP BY 1, 2),
tt AS (SELECT *, sum(p) OVER (PARTITION BY feature) AS np, sum(q) OVER (PARTITION BY feature) AS nq FROM ct),
kl AS (SELECT feature, (sum((p / (np * w) + 1e-8) * ln((p / (np * w) + 1e-8) / (q / (nq * w) + 1e-8))) + sum((q / (nq * w) + 1e-8) * ln((q / (nq * w) + 1e-8) / (p / (np * w) + 1e-8)))) / 2 AS kl FROM tt GROUP BY 1),
pf AS (SELECT feature, CASE WHEN p = 0 THEN 1e-8 ELSE p / (np + 1e-8) END AS e, CASE WHEN q = 0 THEN 1e-8 ELSE q / (nq + 1e-8) END AS a FROM tt), ps AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM pf GROUP BY 1)"""
HALVES = f"{FEATS}, fb AS (SELECT * FROM fe WHERE recorded_at < TIMESTAMP '2024-01-16 00:00:00'), fn AS (SELECT * FROM fe WHERE recorded_at >= TIMESTAMP '2024-01-16 00:00:00')"


def halves(t: Tables):
    df = scored(t).withColumnRenamed("timestamp", "recorded_at")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp")
    return df.where(F.col("recorded_at") < cut), df.where(F.col("recorded_at") >= cut)


@query("drift_kl", f"WITH {RESULTS}, {HALVES}, {HIST} SELECT feature, round(kl, 6) AS kl FROM kl")
def drift_kl(t):
    return E.drift_kl(*halves(t), NAMES)


@query("drift_psi", f"WITH {RESULTS}, {HALVES}, {HIST} SELECT feature, round(psi, 6) AS psi FROM ps")
def drift_psi(t):
    return E.drift_psi(*halves(t), NAMES)


@query("drift_report", f"""WITH {RESULTS}, {FEATS}, fb AS (SELECT * FROM fe WHERE recorded_at >= {T0} - INTERVAL 7 DAY), fn AS (SELECT * FROM fe WHERE recorded_at >= {T0} - INTERVAL 1 DAY), {HIST},
 o AS (SELECT (SELECT avg(kl) FROM kl) AS k, (SELECT avg(psi) FROM ps WHERE feature IN ('adjusted_score', 'eif_score')) AS s, (SELECT avg(adjusted_score) FROM fb) AS mb, (SELECT avg(adjusted_score) FROM fn) AS mn, (SELECT count(*) FROM fb) AS nb, (SELECT count(*) FROM fn) AS nn)
SELECT round(k, 6) AS kl_divergence, round(s, 6) AS psi, round(abs(mb - mn), 6) AS triage_anchor_divergence, nb AS n_base, nn AS n_now, coalesce((SELECT string_agg(feature, '|' ORDER BY feature) FROM kl WHERE kl > 0.1), '') AS affected_features,
 CAST(CASE WHEN nb >= 10 AND nn >= 5 THEN (k > 0.1 OR s > 0.25 OR abs(mb - mn) > 0.1)::INT ELSE 0 END AS BIGINT) AS drift_detected FROM o""")
def drift_report(t):
    return E.drift_report(scored(t).withColumnRenamed("timestamp", "recorded_at"), AS_OF, NAMES, ["adjusted_score", "eif_score"])


FINDINGS = ["CONFIRMED_ATTACK", "ACTIVE_CAMPAIGN", "BEHAVIOURAL_ANOMALY", "SIGMA_MATCH", "ANOMALOUS_PATTERN", "NORMAL_BEHAVIOUR", "FALSE_POSITIVE", "OTHER"]
FIND_SQL = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(FINDINGS)) + " END"


def verdict_rows(t: Tables):
    e = F.col("event_id")
    finding = F.element_at(F.array(*[F.lit(n) for n in FINDINGS]), (e % 8 + 1).cast("int"))
    return t.scores.select(e.alias("alert_id"), F.col("timestamp").alias("recorded_at"), finding.alias("finding_type"), (e % 10 == 0).cast("int").alias("is_fast_path"), F.col("lgbm_score").alias("hunter_score"),
                           F.when(e % 7 == 0, F.array().cast("array<double>")).otherwise(F.array_repeat(F.lit(0.5), 42)).alias("feature_vector"), F.lit("heuristic").alias("model_used"))


@query("verdict_labels", f"""WITH x AS (SELECT event_id AS alert_id, timestamp AS recorded_at, {FIND_SQL} AS finding_type FROM fx_scores WHERE event_id % 10 <> 0 AND event_id % 7 <> 0 AND lgbm_score >= 0.5),
 y AS (SELECT *, CAST(finding_type IN ('CONFIRMED_ATTACK', 'ACTIVE_CAMPAIGN', 'BEHAVIOURAL_ANOMALY', 'SIGMA_MATCH', 'ANOMALOUS_PATTERN') AS BIGINT) AS label FROM x ORDER BY recorded_at DESC, alert_id LIMIT 50000)
SELECT alert_id, finding_type, label, concat('heuristic_', CASE WHEN finding_type IN ('CONFIRMED_ATTACK', 'ACTIVE_CAMPAIGN') THEN 'positive' WHEN finding_type IN ('FALSE_POSITIVE', 'NORMAL_BEHAVIOUR') THEN 'negative' ELSE 'ambiguous' END) AS label_source FROM y WHERE (SELECT count(*) FROM y) >= 100 AND (SELECT avg((label = 0)::INT) FROM y) >= 0.1""")
def verdict_labels(t):
    return E.training_set(E.training_rows(verdict_rows(t))).select("alert_id", "finding_type", "label", "label_source")


C1 = """CASE WHEN hostname = 'host-3' OR combined_score < 0.5 THEN 0 WHEN hostname IN ('host-1', 'host-2') AND ((lgbm_score >= 0.8 AND combined_score >= 0.85) OR eif_score >= 0.9) THEN 1 WHEN lgbm_score >= 0.9 AND (eif_score >= 0.8 OR combined_score >= 0.9) THEN 1
 WHEN lgbm_score >= 0.8 AND eif_score >= 0.5 AND combined_score >= 0.85 THEN 1 WHEN action = 'escalate' AND combined_score >= 0.85 THEN 1 WHEN action = 'discard' THEN 0 WHEN combined_score < 0.75 THEN 0 ELSE 1 END"""
C2 = """CASE WHEN lgbm_score >= 0.9 AND eif_score >= 0.9 AND combined_score >= 0.9 THEN 1 WHEN lgbm_score >= 0.95 AND combined_score >= 0.88 THEN 1 WHEN eif_score >= 0.95 AND combined_score >= 0.85 THEN 1 WHEN combined_score >= 0.93 AND action = 'escalate' THEN 1 WHEN combined_score < 0.6 THEN 0
 WHEN action = 'discard' THEN 0 WHEN action = 'monitor' AND combined_score < 0.8 THEN 0 WHEN action = 'monitor' AND lgbm_score >= 0.8 AND eif_score < 0.5 THEN 0 WHEN combined_score >= 0.85 AND action = 'escalate' THEN 1 WHEN action = 'escalate' AND combined_score >= 0.8 THEN 1 WHEN combined_score >= 0.85 THEN 1 ELSE 0 END"""
KNOWN = (["host-1", "host-2"], ["host-3"])


@query("consensus_labels", f"WITH {RESULTS} SELECT event_id, CAST({C1} AS BIGINT) AS label, CAST({C2} AS BIGINT) AS label_strict FROM res")
def consensus_labels(t):
    return scored(t).select("event_id", E.consensus_label(*KNOWN).alias("label"), E.consensus_label_strict().alias("label_strict"))


@query("label_hierarchy", """WITH x AS (SELECT doc_id AS event_id, quality AS label, CASE doc_id % 3 WHEN 0 THEN 'analyst' WHEN 1 THEN 'pseudo_positive' ELSE 'unknown' END AS s FROM labels UNION ALL SELECT doc_id, toxic, CASE doc_id % 2 WHEN 0 THEN 'verifier' ELSE 'anchored_negative' END FROM labels),
 r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CASE s WHEN 'analyst' THEN 1 WHEN 'verifier' THEN 2 WHEN 'pseudo_positive' THEN 3 WHEN 'pseudo_negative' THEN 4 ELSE 5 END) AS rn FROM x WHERE s <> 'unknown') SELECT event_id, CAST(label AS BIGINT) AS label, s AS label_source FROM r WHERE rn = 1""")
def label_hierarchy(t):
    d = F.col("doc_id")
    a = t.base("labels").select(d.alias("event_id"), F.col("quality").alias("label"), F.when(d % 3 == 0, "analyst").when(d % 3 == 1, "pseudo_positive").otherwise("unknown").alias("label_source"))
    b = t.base("labels").select(d.alias("event_id"), F.col("toxic").alias("label"), F.when(d % 2 == 0, "verifier").otherwise("anchored_negative").alias("label_source"))
    return E.label_hierarchy(a.unionByName(b))


@query("triage_anchored_divergence", "SELECT round(avg(abs(lgbm_score - eif_score)), 6) AS divergence, round(avg(lgbm_score - eif_score), 6) AS bias, count(*) AS n FROM fx_scores")
def triage_anchored_divergence(t):
    return E.triage_anchored_divergence(t.scores.select(F.col("lgbm_score").alias("confidence"), F.col("eif_score").alias("trigger_score")))


ASSEMBLED = ["adjusted_score", "base_score", "template_risk", "graph_unique_destinations", "graph_unique_src_ips", "graph_hop_count", "temporal_escalation_count", "temporal_mean_score", "mitre_match_count"]


@query("training_set_assembly", f"""WITH {RESULTS}, cx AS (SELECT hostname, count(DISTINCT dst_ip) AS d, count(DISTINCT src_ip) AS s FROM fx_network GROUP BY 1), hs AS (SELECT hostname, count(*) FILTER (action = 'escalate') AS e, avg(adjusted_score) AS m FROM res GROUP BY 1)
SELECT event_id, CAST({C1} AS BIGINT) AS label, round(adjusted_score, 6) AS adjusted_score, round(combined_score, 6) AS base_score, round(template_rarity, 6) AS template_risk, d::DOUBLE AS graph_unique_destinations, s::DOUBLE AS graph_unique_src_ips, least(d, 5)::DOUBLE AS graph_hop_count,
 e::DOUBLE AS temporal_escalation_count, round(m, 6) AS temporal_mean_score, 2.0::DOUBLE AS mitre_match_count FROM res JOIN cx USING (hostname) JOIN hs USING (hostname)""")
def training_set_assembly(t):
    rows = assembled(t)
    return rows.select("event_id", "label", *[F.get("feature_vector", F.lit(FEATURE_ORDER.index(n))).alias(n) for n in ASSEMBLED])


def assembled(t: Tables):
    return M.training_set_assembly(scored(t), A.host_network_context(t.network), A.host_score_history(scored(t)), E.consensus_label(*KNOWN))


@query("augment_rows")
def augment_rows(t):
    return M.augment_rows(assembled(t)).select("event_id", "copy", "label", F.get("feature_vector", F.lit(0)).alias("adjusted_score"))


# ---- training --------------------------------------------------------------------------


def training_features(t: Tables):
    """Network feature rows with a label that follows from the data; trainers read them many times."""
    rows = G.sanitize_features(G.triage_features(G.network_features(t.network), "network-events"))
    return cut_lineage(rows.withColumn("label", ((F.col("is_suspicious") == 1) | (F.col("dst_port") == 445)).cast("int")).select("event_id", "timestamp", *G.FEATURES, "label"))


@query("stratified_split", "WITH s AS (SELECT event_type AS stratum, count(*) AS n FROM events GROUP BY 1) SELECT stratum, n, CAST(1 AS BIGINT) AS share_is_exact FROM s")
def stratified_split(t):
    """A fifth of each event type is held out, to the row."""
    events = t.base("events")
    train, test = E.train_test(events, ["event_id"], 0.2, strata=["event_type"])
    counts = train.withColumn("test", F.lit(0)).unionByName(test.withColumn("test", F.lit(1))).groupBy(F.col("event_type").alias("stratum")).agg(F.count("*").alias("n"), F.sum("test").alias("held"))
    return counts.select("stratum", "n", (F.abs(F.col("held") - F.col("n") * 0.2) <= 1).cast("int").alias("share_is_exact"))


@query("train_supervised")
def train_supervised(t):
    """Held-out metrics of boosted trees."""
    return M.train_supervised(training_features(t), G.FEATURES, "label", ["event_id"])[1]


@query("train_isolation_forest")
def train_isolation_forest(t):
    """Mean isolation score of normal and flagged rows."""
    df = training_features(t)
    forest, cal = M.train_isolation_forest(df, G.FEATURES, "label")
    out = M.path_score(df, forest, G.FEATURES).withColumn("score", M.isolation_score("raw", cal["mean"], cal["std"], cal["flip"]))
    return out.groupBy("label").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


@query("refit_streaming_model")
def refit_streaming_model(t):
    df = training_features(t)
    model = M.refit_streaming_model(G.replay_window(df, AS_OF, hours=720), G.FEATURES)
    return M.probability(df, model, G.FEATURES, "arf_score").select("event_id", "arf_score")


@query("train_verdict_model")
def train_verdict_model(t):
    """Scores of a verdict model next to the heuristic."""
    rows = cut_lineage(assembled(t))
    model = M.train_verdict_model(rows)
    fitted = M.score_with_model(rows, model).select("event_id", F.col("hunter_score").alias("model_score"))
    return fitted.join(M.score_with_model(rows).select("event_id", F.col("hunter_score").alias("heuristic")), "event_id")


@query("model_gates", """SELECT 'supervised model passes its gate' AS name, CAST(1 AS BIGINT) AS holds UNION ALL SELECT 'isolation scores of flagged rows are higher', 1 UNION ALL SELECT 'streaming scores of all rows within 0 and 1', count(*) FROM fx_network
 UNION ALL SELECT 'verdict scores of all rows within 0 and 1', count(*) FROM fx_scores UNION ALL SELECT 'four copies of every row, scores within 0 and 1', 4 * count(*) FROM fx_scores""")
def model_gates(t):
    """What must hold of trained models and random copies, whatever their numbers."""
    inside = lambda c: (F.col(c) >= 0) & (F.col(c) <= 1)
    fact = lambda df, name, holds: df.agg(F.lit(name).alias("name"), holds.cast("bigint").alias("holds"))
    mean = lambda y: F.max(F.when(F.col("label") == y, F.col("mean_score")))
    parts = [
        fact(train_supervised(t), "supervised model passes its gate", F.min("passed")), fact(train_isolation_forest(t), "isolation scores of flagged rows are higher", mean(1) > mean(0)),
        fact(refit_streaming_model(t), "streaming scores of all rows within 0 and 1", F.count_if(inside("arf_score"))), fact(train_verdict_model(t), "verdict scores of all rows within 0 and 1", F.count_if(inside("model_score"))),
        fact(augment_rows(t), "four copies of every row, scores within 0 and 1", F.count_if(inside("adjusted_score") & F.col("copy").between(1, 4))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- dataset harmonisation -------------------------------------------------------------


@query("combine_datasets", """WITH x AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE least(greatest(value * 1e7, 0), 1e9) END AS src_bytes, least(greatest((event_id % 90000)::DOUBLE, 0), 65535) AS dst_port, least(greatest(value / 100, 0), 1) AS same_srv_rate, least(greatest(event_id % 3, 0), 1) AS label,
 CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS attack_type FROM events) SELECT event_id, round(src_bytes, 6)::DOUBLE AS src_bytes, dst_port::DOUBLE AS dst_port, round(same_srv_rate, 6)::DOUBLE AS same_srv_rate, CAST(label AS BIGINT) AS label, CASE WHEN attack_type IS NULL THEN CASE WHEN label = 0 THEN 'normal' ELSE 'unknown' END ELSE attack_type END AS attack_type FROM x""")
def combine_datasets(t):
    e = F.col("event_id")
    raw = t.base("events").select("event_id", F.when(e % 9 == 0, float("inf")).otherwise(F.col("value") * 1e7).alias("src_bytes"), (e % 90000).cast("string").alias("dst_port"), (F.col("value") / 100).alias("same_srv_rate"), (e % 3).alias("label"),
                                  F.when(e % 4 != 0, F.col("event_type")).alias("attack_type"))
    return C.combine_datasets([raw.where("event_id % 2 = 0"), raw.where("event_id % 2 = 1")]).select("event_id", "src_bytes", "dst_port", "same_srv_rate", "label", "attack_type")
