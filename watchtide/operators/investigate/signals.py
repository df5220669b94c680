"""Signals about an alert from the facts in the minutes before it.

Every measure is a sliding aggregate over event time (see functions.timeline), so a host
or address that owns a third of the facts does not end up in one task and no pair of
alert and fact is formed.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator
from dataclasses import dataclass, field as dc_field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from watchtide.functions.expr import first_case, lookup, uuid5
from watchtide.functions.timeline import distinct_deltas, sum_deltas, sweep, window_values
from watchtide.operators.investigate.correlate import GROUP_ROWS, correlate
from watchtide.operators.investigate.scope import Scope, scope
from watchtide.operators.lookups import active_iocs, noisy_sources
from watchtide.operators.rollups import spc_baseline

GATE = 0.65
WINDOW_MINUTES = 15
SPC_SIGMA = 3.0
NOISY = 50
#: Newest related alerts that an alert lists; a window may hold any number of them.
RELATED = 50
HIGH_RISK = 0.75
MICRO = 1_000_000


def minutes(n: int) -> int:
    return n * 60_000_000


def investigation_gate(scored: DataFrame, gate: float = GATE) -> DataFrame:
    return scored.where(F.col("adjusted_score") >= gate)


def _facts(network: DataFrame) -> DataFrame:
    return network.withColumnRenamed("src_ip", "source_ip")


# ---- detection rules -------------------------------------------------------------------

SEVERITY = {"low": 1, "medium": 2, "high": 3, "critical": 4}


@dataclass(frozen=True)
class Rule:
    """Keywords over the alert text, a windowed predicate over network events, or both."""

    id: str
    title: str
    severity: str
    category: str
    keywords: tuple[str, ...] = ()
    condition: str = "or"
    keys: tuple[str, ...] = ("hostname", "source_ip")
    where: str | None = None
    distinct: str | None = None
    more_than: int = 0
    tags: tuple[str, ...] = dc_field(default=())

    @property
    def level(self) -> int:
        return SEVERITY[self.severity.lower()]


RULES: dict[str, Rule] = {}


def register_rule(rule: Rule | dict) -> Rule:
    """Add a rule; a dict must name id, title, severity and category."""
    if isinstance(rule, dict):
        missing = {"id", "title", "severity", "category"} - set(rule)
        if missing:
            raise ValueError(f"rule lacks {sorted(missing)}")
        rule = Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in rule.items()})
    if rule.severity.lower() not in SEVERITY:
        raise ValueError(f"unknown severity {rule.severity!r}")
    RULES[rule.id] = rule
    return rule


def load_rules(spark: SparkSession, folder: str) -> list[Rule]:
    """Register the rules of a folder of JSON files, one rule per file. A rule pack is small: the folder is read by the driver."""
    rows = spark.read.text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("file")).orderBy("file").collect()
    return [register_rule({k: v for k, v in json.loads(r["value"]).items() if k in Rule.__dataclass_fields__}) for r in rows]


# The rule pack.
for _rule in (
    Rule("cisco-ios-brute-001", "Cisco IOS Brute Force Login Attempt", "high", "cisco", ("login failed", "authentication failure", "% login invalid"), where="detection_rule ILIKE '%login%fail%'", more_than=5, tags=("attack.t1110", "attack.credential_access")),
    Rule("dns-tunnel-001", "Suspicious DNS Tunnelling Activity", "high", "dns", ("dns tunnel", "nxdomain flood", "txt record exfil"), where="protocol = 'DNS' AND length(dns_query) > 120", more_than=20, tags=("attack.t1071.004", "attack.command_and_control")),
    Rule("fw-bypass-001", "Firewall Policy Bypass Attempt", "high", "firewall", ("policy bypass", "deny then allow", "access-list violated"), where="detection_rule ILIKE '%deny%'", tags=("attack.t1562.004", "attack.defense_evasion")),
    Rule("fortinet-ips-001", "FortiGate IPS Exploit Detected", "critical", "fortinet", ("ips signature", "exploit detected", "attack signature hit"), where="detection_rule ILIKE '%IPS%signature%'", tags=("attack.t1190", "attack.initial_access")),
    Rule("huawei-snmp-001", "Huawei Device SNMP Community String Sweep", "medium", "huawei", ("snmp community", "snmp get", "community mismatch"), where="detection_rule ILIKE '%snmp%'", distinct="detection_rule", more_than=5, tags=("attack.t1046", "attack.discovery")),
    Rule("juniper-bgp-001", "Juniper BGP Route Hijack Attempt", "critical", "juniper", ("bgp update unexpected", "bgp prefix hijack", "invalid as_path"), where="detection_rule ILIKE '%bgp%update%'", tags=("attack.t1599", "attack.network_effects")),
    Rule("zeek-smb-lateral-001", "Zeek Lateral Movement via SMB", "high", "zeek", ("smb lateral", "smb tree connect", "admin$ share"), keys=("source_ip",), where="dst_port = 445", distinct="dst_ip", more_than=3, tags=("attack.t1021.002", "attack.lateral_movement")),
):
    register_rule(_rule)


def _technique(rule: Rule) -> str:
    return next((t.split(".", 1)[1].upper() for t in rule.tags if t.startswith("attack.t") and t[8:9].isdigit()), "")


def _tactic(rule: Rule) -> str:
    return next((t.split(".", 1)[1].replace("_", "-") for t in rule.tags if not t[8:9].isdigit()), "")


def sigma_rules(alerts: DataFrame, network: DataFrame, rules: dict[str, Rule] | None = None, haystack: tuple[str, ...] = ("message",), window_min: int = WINDOW_MINUTES, ts: str = "timestamp", within: Scope | None = None) -> DataFrame:
    """Alerts with ``sigma_hits`` (array), ``sigma_hit_count`` and ``sigma_max_severity``."""
    pack, facts, span = list((rules or RULES).values()), _facts(network), minutes(window_min)
    within = within or scope(alerts, ts)
    # keywords are looked for first, so that sweeps carry an answer per rule and not the text
    text, words = F.lower(F.concat_ws(" ", *[c for c in haystack if c in alerts.columns])), []
    for r in pack:
        test = F.lit(r.condition == "and" and bool(r.keywords))
        for k in r.keywords:
            test = (test & text.contains(k.lower())) if r.condition == "and" else (test | text.contains(k.lower()))
        words.append(test)
    out = alerts.withColumn("_w", F.array(*words))
    for keys in sorted({r.keys for r in pack if r.where}):
        mine = {f"_m{i}": r for i, r in enumerate(pack) if r.where and r.keys == keys}
        some = within.near(facts.where(" OR ".join(f"({r.where})" for r in mine.values())), keys, span, ts)
        sums = {n: F.expr(r.where).cast("int") for n, r in mine.items() if not r.distinct}
        kinds = {n: F.when(F.expr(r.where), F.col(r.distinct)) for n, r in mine.items() if r.distinct}
        deltas = ([sum_deltas(some, keys, ts, span, sums)] if sums else []) + ([distinct_deltas(some, keys, ts, span, kinds)] if kinds else [])
        out = sweep(out, keys, ts, span, deltas)
    hits = []
    for i, r in enumerate(pack):
        tests = [F.get("_w", F.lit(i))] if r.keywords else []
        if r.where:
            tests.append(F.col(f"_m{i}") > r.more_than)
        if not tests:
            continue
        fired = tests[0] if len(tests) == 1 else (tests[0] & tests[1] if r.condition == "and" else tests[0] | tests[1])
        matched = F.col(f"_m{i}") if r.where else F.lit(0).cast("bigint")
        hits.append(F.when(fired, F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.title).alias("title"), F.lit(r.level).alias("severity"), F.lit(r.category).alias("category"),
                                           F.lit(_tactic(r)).alias("mitre_tactic"), F.lit(_technique(r)).alias("mitre_technique"), matched.alias("matched_events"))))
    out = out.withColumn("sigma_hits", F.array_compact(F.array(*hits))).drop("_w", *[f"_m{i}" for i in range(len(pack))])
    worst = F.coalesce(F.array_max(F.transform("sigma_hits", lambda h: h["severity"])), F.lit(0))
    return out.withColumns({"sigma_hit_count": F.size("sigma_hits"), "sigma_max_severity": worst})


def sigma_rule_hits(with_hits: DataFrame) -> DataFrame:
    """One row per alert and fired rule."""
    words = {v: k for k, v in SEVERITY.items()}
    h = F.col("h")
    return with_hits.select(F.col("timestamp").alias("hit_time"), F.col("event_id").alias("alert_id"), "source_type", "hostname", F.explode("sigma_hits").alias("h")).select(
        "hit_time", "alert_id", h["rule_id"].alias("rule_id"), h["title"].alias("rule_name"), "source_type", "hostname", lookup(h["severity"], words).alias("severity"),
        h["mitre_tactic"].alias("mitre_tactic"), h["mitre_technique"].alias("mitre_technique"), h["matched_events"].alias("matched_events"))


# ---- statistical baseline --------------------------------------------------------------


def spc_evaluate(alerts: DataFrame, network: DataFrame, actions: DataFrame, as_of, baseline_hours: int = 24, observed_minutes: int = 60, sigma: float = SPC_SIGMA, ts: str = "timestamp", within: Scope | None = None) -> DataFrame:
    """z-score of the connections of (host, source) in the last hour against its per-minute baseline."""
    keys = ["hostname", "source_ip"]
    facts = (within or scope(alerts, ts)).near(_facts(network).select(*keys, ts), keys, minutes(observed_minutes), ts)
    out = sweep(alerts, keys, ts, minutes(observed_minutes), [sum_deltas(facts, keys, ts, minutes(observed_minutes), {"spc_observed": F.lit(1)})])
    out = out.join(spc_baseline(actions, as_of, baseline_hours), keys, "left")
    mean, std = F.coalesce("baseline_mean", F.lit(0.0)), F.coalesce("baseline_stddev", F.lit(0.0))
    out = out.withColumns({"spc_baseline_mean": mean, "spc_baseline_stddev": std}).drop("baseline_mean", "baseline_stddev")
    # an entity without a baseline has no deviation
    z = F.when(F.col("spc_baseline_stddev") > 0, (F.col("spc_observed") - F.col("spc_baseline_mean")) / F.col("spc_baseline_stddev")).otherwise(0.0)
    out = out.withColumn("spc_z_score", z)
    return out.withColumn("spc_is_anomaly", (F.col("spc_z_score") > sigma).cast("int"))


# ---- other alerts on the same host -----------------------------------------------------


def temporal_correlation(alerts: DataFrame, scored: DataFrame, window_min: int = WINDOW_MINUTES, ts: str = "timestamp", within: Scope | None = None) -> DataFrame:
    """Higher alerts of the same host and source; variety, mean score and ids of those sharing host and (source or user).

    Facts and alerts meet once per host and time bucket; one more shuffle puts the rows of an event id together.
    """
    span, within = minutes(window_min), within or scope(alerts, ts)
    scored = within.near(scored, ["hostname"], span, ts)
    groups = max(4 * int(alerts.sparkSession.conf.get("spark.sql.shuffle.partitions")), within.rows // GROUP_ROWS)
    out = correlate(alerts, scored, span, RELATED, groups, MICRO, ts)
    # alerts of one id share what they found; a null id has nothing to share
    same, known = Window.partitionBy("event_id"), F.col("event_id").isNotNull()
    kinds = F.array_distinct(F.flatten(F.collect_list(F.when(known, F.col("_kinds"))).over(same)))
    listed = F.collect_list(F.when(known & (F.size("_items") > 0), F.struct(F.unix_micros(ts).alias("t"), F.col("_ages").alias("ages"), F.col("_items").alias("items")))).over(same)
    out = out.withColumns({"temporal_escalation_count": F.coalesce(F.sum(F.when(known, F.col("_higher"))).over(same), F.lit(0)), "_kinds": kinds, "_lists": listed})
    dated = F.transform("_lists", lambda x: F.zip_with(x["ages"], x["items"], lambda age, item: F.struct((x["t"] - age).alias("t"), item.alias("i"))))
    newest = F.transform(F.slice(F.sort_array(F.array_distinct(F.flatten(dated)), asc=False), 1, RELATED), lambda r: r["i"])
    several = F.size("_lists") > 1
    return out.withColumns({
        "temporal_mean_score": F.when(F.col("_n") > 0, F.col("_s") / F.col("_n") / MICRO).otherwise(0.0),
        "temporal_unique_categories": F.size(F.filter("_kinds", lambda k: k.startswith("s|"))).cast("bigint"),
        "temporal_tactic_diversity": F.size(F.filter("_kinds", lambda k: k.startswith("m|"))).cast("bigint"),
        "related_alert_ids": F.when(several, newest).otherwise(F.get("_lists", F.lit(0))["items"]),
    }).select(*alerts.columns, "temporal_mean_score", "temporal_escalation_count", "temporal_unique_categories", "temporal_tactic_diversity", "related_alert_ids")


# ---- network graph ---------------------------------------------------------------------


def graph_features(alerts: DataFrame, network: DataFrame, scored: DataFrame, iocs: DataFrame, as_of, noisy_limit: int = NOISY, window_min: int = WINDOW_MINUTES, ts: str = "timestamp", check_expiry: bool = True, within: Scope | None = None) -> DataFrame:
    """Reach of the source, sources on the host, indicator links and the scores derived from them."""
    span, net = minutes(window_min), _facts(network).select("hostname", "source_ip", "dst_ip", ts)
    live = active_iocs(iocs, as_of, ("ip",), check_expiry).select(F.col("ioc_value").alias("_i"), F.lit(1).alias("_is_ioc"))
    within = within or scope(alerts, ts)
    reach = distinct_deltas(within.near(net, ["source_ip"], span, ts), ["source_ip"], ts, span, {"_dst": F.col("dst_ip"), "graph_hop_count": F.col("hostname")})
    out = sweep(alerts, ["source_ip"], ts, span, [reach])
    risky = within.near(scored.where(F.col("adjusted_score") >= HIGH_RISK), ["hostname"], span, ts).join(live, F.lower("source_ip") == F.col("_i"), "left").where((F.col("ioc_match") == 1) | F.col("_is_ioc").isNotNull())
    on_host = distinct_deltas(within.near(net, ["hostname"], span, ts), ["hostname"], ts, span, {"graph_unique_src_ips": F.col("source_ip")})
    risk = sum_deltas(risky, ["hostname"], ts, span, {"graph_high_risk_neighbors": F.lit(1), "graph_escalation_count": (F.col("action") == "escalate").cast("int")})
    out = sweep(out, ["hostname"], ts, span, [on_host, risk])
    noisy = noisy_sources(scored, noisy_limit).select(F.col("source_ip").alias("_s"), F.lit(1).alias("_noisy"))
    out = out.join(live, F.lower("source_ip") == F.col("_i"), "left").join(noisy, F.col("source_ip") == F.col("_s"), "left")
    ioc = F.coalesce("_is_ioc", F.lit(0))
    out = out.withColumns({"graph_has_ioc_neighbor": ioc, "graph_unique_destinations": F.when((ioc == 1) | F.col("_noisy").isNull(), F.col("_dst")).otherwise(0)})
    d, h = F.col("graph_unique_destinations"), F.col("graph_hop_count")
    return out.withColumns({
        "graph_lateral_movement_score": F.least(F.lit(1.0), h / 10.0),
        "graph_c2_candidate_score": F.when((d >= 3) & (h >= 2), F.least(F.lit(1.0), d / 10.0 * (1 + F.col("graph_has_ioc_neighbor")))).otherwise(0.0),
    }).drop("_dst", "_i", "_is_ioc", "_s", "_noisy")


# ---- ATT&CK mapping --------------------------------------------------------------------

# Fixed values: (id, priority, trigger features, threshold, technique, name, tactic, confidence).
MITRE_RULES = [
    ("brute_force", 10, ["event_freq_1m", "template_auth"], 10.0, "T1110", "Brute Force", "credential-access", "HIGH"),
    ("lateral_movement", 20, ["unique_hosts_5m", "template_lateral"], 3.0, "T1021", "Remote Services", "lateral-movement", "HIGH"),
    ("c2_traffic", 30, ["known_malicious_ip", "outbound"], 1.0, "T1071", "Application Layer Protocol", "command-and-control", "HIGH"),
    ("account_creation", 40, ["template_user_created", "off_hours"], 1.0, "T1136", "Create Account", "persistence", "MEDIUM"),
    ("privilege_esc", 50, ["template_priv_escalation"], 1.0, "T1068", "Exploitation for Priv Esc", "privilege-escalation", "HIGH"),
    ("data_exfil", 60, ["template_data_exfil", "large_payload"], 1.0, "T1041", "Exfiltration Over C2 Channel", "exfiltration", "HIGH"),
    ("zero_day", 70, ["eif_high", "lgbm_low", "novel_template"], 0.0, "T1190", "Exploit Public-Facing App", "initial-access", "MEDIUM"),
    ("network_recon", 80, ["template_port_scan", "multi_port"], 1.0, "T1046", "Network Service Discovery", "discovery", "HIGH"),
    ("model_disagreement", 90, ["std_dev_high"], 0.35, "UNKNOWN_TTP", "Model Disagreement", "", "LOW"),
]
CONFIDENCE = {"LOW": 0.3, "MEDIUM": 0.6, "HIGH": 0.9}
# Words in a template and the trigger they set.
TEMPLATE_TRIGGERS = [
    (["auth", "login", "password", "credential"], "template_auth"), (["lateral", "smb", "rdp", "remote"], "template_lateral"), (["user_created", "new_user", "account"], "template_user_created"),
    (["priv", "escalat", "sudo"], "template_priv_escalation"), (["exfil", "upload", "transfer"], "template_data_exfil"), (["scan", "port", "recon", "discovery"], "template_port_scan"), (["outbound", "c2", "beacon"], "outbound"),
]


def reachable_rules(rules=MITRE_RULES) -> list[tuple]:
    """The same rules with thresholds above 1 lowered to 0, since scores end at 1."""
    return [(*r[:3], 0.0 if r[3] >= 1.0 else r[3], *r[4:]) for r in rules]


def active_triggers(template: str = "message", ts: str = "timestamp") -> Column:
    """Trigger names of an alert, in fixed order; off-hours by event time."""
    text, hour = F.lower(F.coalesce(F.col(template), F.lit(""))), F.hour(ts)
    flags = [(F.col("ioc_match") == 1, "known_malicious_ip"), (~hour.between(8, 17), "off_hours")]
    for words, name in TEMPLATE_TRIGGERS:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        flags.append((hit, name))
    flags += [((F.col("score_std_dev") > 0.3) | (F.col("disagreement_flag") == 1), "std_dev_high"), (F.col("eif_score") > 0.7, "eif_high")]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in flags]))


_RULE_COLUMNS = "rule_id string, priority int, trigger_features array<string>, trigger_threshold double, mitre_id string, mitre_name string, mitre_tactic string, confidence string"
_USEFUL = "feature string, priority int, rule_id string, threshold double"


def rule_table(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame([(r[0], int(r[1]), list(r[2]), float(r[3]), *r[4:]) for r in rules], _RULE_COLUMNS)


def _useful(rows: pa.Table, best: int, fallback: int) -> pa.Table:
    """Rules of each feature that can be among its best at some score: fewer than so many come before them with a threshold as low."""
    rows = rows.sort_by([("feature", "ascending"), ("priority", "ascending"), ("rule_id", "ascending")])
    keep, lows, now = [], [], None
    for feature, threshold in zip(rows["feature"].to_pylist(), rows["threshold"].to_pylist()):
        if feature != now:
            now, lows = feature, []
        before = bisect.bisect_right(lows, threshold)
        keep.append(before < (fallback if feature == ANY else best))
        if keep[-1]:
            lows.insert(before, threshold)
    return rows.filter(pa.array(keep, pa.bool_()))


#: The feature under which a rule is found by its threshold alone.
ANY = "*"


def rule_index(rules: DataFrame, best: int = 25, fallback: int = 5) -> DataFrame:
    """(feature, priority, rule_id, threshold) of the rules that can be picked through a feature, however many there are.

    Tasks drop what cannot be among the best of what they have, then a feature's rest is thinned once more.
    """
    long = rules.select(F.explode(F.array_distinct(F.concat("trigger_features", F.array(F.lit(ANY))))).alias("feature"), "priority", "rule_id", F.col("trigger_threshold").cast("double").alias("threshold"))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _useful(pa.Table.from_batches([batch]), best, fallback).to_batches()

    return long.mapInArrow(thin, _USEFUL).groupBy("feature").applyInArrow(lambda t: _useful(t, best, fallback), _USEFUL)


def rule_overlap(alerts: DataFrame, rules=MITRE_RULES, best: int = 25, fallback: int = 5) -> DataFrame:
    """Rules whose threshold the score reaches and that share an active trigger, by priority; without
    any trigger the first few by threshold alone. `rules` is a list or a table of any size: an index from
    feature to rules meets the alerts' triggers in a join, and each alert keeps its best."""
    spark = alerts.sparkSession
    table = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    out = alerts if "active_triggers" in alerts.columns else alerts.withColumn("active_triggers", active_triggers())
    named = F.size("active_triggers") > 0
    asks = out.select("event_id", F.round("adjusted_score", 4).alias("_score"), F.explode(F.when(named, F.col("active_triggers")).otherwise(F.array(F.lit(ANY)))).alias("feature"))
    found = asks.join(rule_index(table, best, fallback), "feature").where(F.col("threshold") <= F.col("_score"))
    found = found.groupBy("event_id", "priority", "rule_id").agg((F.max("feature") == ANY).alias("_any"))
    place = F.row_number().over(Window.partitionBy("event_id").orderBy("priority", "rule_id"))
    found = found.withColumn("_n", place).where((F.col("_n") <= best) & (~F.col("_any") | (F.col("_n") <= fallback)))
    strength = lookup(F.col("confidence"), CONFIDENCE)
    whole = table.select("rule_id", F.struct("rule_id", F.col("trigger_features").alias("features"), F.col("trigger_threshold").cast("double").alias("threshold"), F.col("mitre_id").alias("technique"), F.col("mitre_tactic").alias("tactic"), F.coalesce(strength, F.lit(0.3)).alias("confidence")).alias("r"))
    listed = found.join(whole, "rule_id").groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("_n", "r"))).alias("_m"))  # at most `best`
    out = out.join(listed, "event_id", "left").withColumn("mitre_matches", F.transform("_m", lambda x: x["r"])).drop("_m")
    none = F.array().cast(out.schema["mitre_matches"].dataType)
    return out.withColumn("mitre_matches", F.coalesce("mitre_matches", none))


def mitre_mapping(alerts: DataFrame, rules=MITRE_RULES) -> DataFrame:
    """Rule matches plus the alert's own tactic when no match covers it; counts and ordered unique arrays."""
    out = rule_overlap(alerts, rules)
    slim = F.transform("mitre_matches", lambda r: F.struct(r["rule_id"].alias("rule_id"), r["tactic"].alias("tactic"), r["technique"].alias("technique"), r["confidence"].alias("confidence")))
    own = F.struct(F.lit("triage_passthrough").alias("rule_id"), F.trim("mitre_tactic").alias("tactic"), F.trim("mitre_technique").alias("technique"),
                   F.when(F.col("ioc_confidence") > 0, F.col("ioc_confidence") / 100.0).otherwise(0.5).alias("confidence"))
    covered = F.exists("mitre_matches", lambda r: r["tactic"] == F.trim("mitre_tactic"))
    out = out.withColumn("mitre_matches", F.when((F.trim("mitre_tactic") != "") & ~covered, F.concat(slim, F.array(own))).otherwise(slim))
    tactics = F.array_distinct(F.transform("mitre_matches", lambda r: r["tactic"]))
    return out.withColumns({
        "mitre_match_count": F.size("mitre_matches"), "mitre_tactic_breadth": F.size(F.filter(tactics, lambda x: x != "")),
        "mitre_tactics": tactics, "mitre_techniques": F.array_distinct(F.transform("mitre_matches", lambda r: r["technique"])),
    })


# ---- campaigns -------------------------------------------------------------------------


def _running(deltas: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys, "_b").orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return deltas.select(*keys, "_b", "_t", *[F.sum(n).over(w).alias(n) for n in names])


def _switches(running: DataFrame, keys: list[str], on: Column, name: str) -> DataFrame:
    """+1 where a condition starts to hold and -1 where it stops, within a time bucket."""
    w = Window.partitionBy(*keys, "_b").orderBy("_t")
    state = running.withColumn("_on", on.cast("bigint"))
    # rows of the same time show the same state, so only the first of them can differ from the row before
    change = F.col("_on") - F.coalesce(F.lag("_on").over(w), F.lit(0))
    return state.withColumn(name, change).where(F.col(name) != 0).select(*keys, "_b", "_t", name)


def campaign_detection(alerts: DataFrame, scored: DataFrame, network: DataFrame, min_events: int = 3, window_min: int = WINDOW_MINUTES, ts: str = "timestamp", most_hosts: int | None = None, within: Scope | None = None) -> DataFrame:
    """Hosts and tactics of a source over hosts it contacted at least three times in the window.

    A host counts while both its connection count and its score count are high enough; those
    intervals are turned into changes and summed per source, level by level. ``most_hosts``
    shortens the list of hosts to the first by name; by default it has all of them.
    """
    span, pair = minutes(window_min), ["source_ip", "hostname"]
    within = within or scope(alerts, ts)
    scored, facts = within.near(scored, ["source_ip"], span, ts), within.near(_facts(network), ["source_ip"], span, ts)
    seen = sum_deltas(scored.select(*pair, "mitre_tactic", ts), [*pair, "mitre_tactic"], ts, span, {"_s": F.lit(1)})
    busy = sum_deltas(facts.select(*pair, ts), pair, ts, span, {"_n": F.lit(1)})
    busy = _switches(_running(busy, pair, ["_n"]), pair, F.col("_n") >= min_events, "_n")
    # per host and tactic: busy at the same time as scored
    tactics = seen.select(*pair, "mitre_tactic", "_b").distinct()
    fine = [*pair, "mitre_tactic"]
    busy_fine = busy.join(tactics, [*pair, "_b"]).select(*fine, "_b", "_t", F.lit(0).cast("bigint").alias("_s"), "_n")
    both = _running(seen.select(*fine, "_b", "_t", "_s", F.lit(0).cast("bigint").alias("_n")).unionByName(busy_fine), fine, ["_s", "_n"])
    cells = _switches(both, fine, (F.col("_s") > 0) & (F.col("_n") > 0), "_c")
    by_host = _switches(_running(cells.select(*pair, "_b", "_t", "_c"), pair, ["_c"]), pair, F.col("_c") > 0, "campaign_host_count")
    by_tactic = _switches(_running(cells.select("source_ip", "mitre_tactic", "_b", "_t", "_c"), ["source_ip", "mitre_tactic"], ["_c"]), ["source_ip", "mitre_tactic"], F.col("_c") > 0, "campaign_tactic_count")
    deltas = [by_host.drop("hostname"), by_tactic.drop("mitre_tactic")]
    out = sweep(alerts, ["source_ip"], ts, span, deltas)
    hit = (F.col("campaign_host_count") >= 2) & (F.col("campaign_tactic_count") >= 2)
    out = out.withColumn("is_campaign", hit.cast("int"))
    out = out.withColumn("campaign_id", F.when(hit, uuid5(F.concat(F.col("source_ip"), F.lit(f"_{window_min}")))))
    asks = out.where("is_campaign = 1").select("event_id", "source_ip", ts)
    hosts = window_values(asks, scored.select("source_ip", F.col("hostname").alias("related"), ts), "source_ip", ts, span, "related", "event_id")
    few = hosts.groupBy("event_id").agg(F.array_sort(F.collect_set("related")).alias("related_hosts"))
    if most_hosts is not None:
        few = few.withColumn("related_hosts", F.slice("related_hosts", 1, most_hosts))
    return out.join(few, "event_id", "left").withColumn("related_hosts", F.coalesce("related_hosts", F.array().cast("array<string>")))


# ---- similarity ------------------------------------------------------------------------

SIMILARITY = ["similarity_attack_embed_dist", "similarity_historical_dist", "similarity_log_embed_matches", "similarity_confirmed_neighbor_count", "similarity_min_confirmed_dist", "similarity_false_positive_count", "similarity_label_confidence"]


def similarity_features(ids: DataFrame, attacks: DataFrame, history: DataFrame, logs: DataFrame, key: str = "query_id") -> DataFrame:
    """Neighbour distances (key, distance) from three searches to features; defaults for none."""
    d = F.col("distance")
    near, close = F.count_if(d < 0.3), F.count_if(d < 0.5)
    a = attacks.groupBy(key).agg(
        F.min("distance").alias("similarity_attack_embed_dist"), near.alias("similarity_confirmed_neighbor_count"),
        F.coalesce(F.min(F.when(d < 0.3, d)), F.lit(1.0)).alias("similarity_min_confirmed_dist"), F.when(close > 0, near / close).otherwise(0.0).alias("similarity_label_confidence"))
    h = history.groupBy(key).agg(F.min("distance").alias("similarity_historical_dist"))
    g = logs.groupBy(key).agg(F.count_if(d < 0.4).alias("similarity_log_embed_matches"))
    out = ids.select(key).distinct().join(a, key, "left").join(h, key, "left").join(g, key, "left")
    one = {c: F.coalesce(c, F.lit(1.0)) for c in ("similarity_attack_embed_dist", "similarity_historical_dist", "similarity_min_confirmed_dist")}
    none = {c: F.coalesce(c, F.lit(0)) for c in ("similarity_log_embed_matches", "similarity_confirmed_neighbor_count")}
    return out.withColumns({**one, **none, "similarity_false_positive_count": F.lit(0), "similarity_label_confidence": F.coalesce("similarity_label_confidence", F.lit(0.0))})


def without_similarity(alerts: DataFrame) -> DataFrame:
    """The defaults used when no vector tables are given."""
    one = {"similarity_attack_embed_dist", "similarity_historical_dist", "similarity_min_confirmed_dist"}
    return alerts.withColumns({c: F.lit(1.0 if c in one else 0.0) for c in SIMILARITY})


def merge_ids(a: str = "related_alert_ids", b: str = "related_hosts") -> Column:
    """Union without repeats."""
    return F.array_union(F.col(a).cast("array<string>"), F.col(b).cast("array<string>"))


def severity_word(level: Column) -> Column:
    return first_case([(level == v, F.lit(k)) for k, v in SEVERITY.items()], level.cast("string"))
