"""Decide the event type, category, severity and ATT&CK tags of a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchtide.functions.expr import computed, contains_any, first_case
from watchtide.operators.normalize import field, has_any

RESULT = "struct<event_type:string,category:string,severity:int,mitre_tactic:string,mitre_technique:string>"

# Keyword groups in order of precedence with the tags they give.
# (keywords, category, severity, tactic, technique)
KEYWORD_RULES = [
    ("brute force|account locked", "auth", 4, "credential-access", "T1110"),
    ("failed password|authentication failure|invalid user|login failed|access denied", "auth", 3, "credential-access", "T1078"),
    ("accepted password|accepted publickey|session opened|login successful", "auth", 1, "initial-access", "T1078"),
    ("malware|virus|trojan|ransomware|cryptominer|reverse shell|c2 beacon", "malware", 4, "execution", "T1059"),
    ("exfiltration|data leak|large upload|unusual transfer", "exfiltration", 4, "exfiltration", "T1041"),
    ("dns tunnel", "network-attack", 3, "command-and-control", "T1071.004"),
    ("lateral movement", "network-attack", 3, "lateral-movement", "T1021"),
    ("port scan|syn flood|ddos", "network-attack", 3, "discovery", "T1046"),
    ("firewall|iptables|nftables", "firewall", 2, "defense-evasion", "T1562"),
]
# Fixed patterns of the fallback rules.
PRIVILEGE = r"(?i)\bsudo[\s:\[]\b|privilege.escalat|\bsu:\s"
BLOCKED = r"(?i)blocked.*connection|connection.*blocked"
PROCESS_TEXT = r"(?i)(?:exec.*pid|process started|command=|comm=)"
NETWORK_TEXT = r"(?i)(?:tcp|udp)\s+(?:connect|listen|accept)|connection\s+\S*\s*(?:port|:)"
PID_FIELDS = ["pid", "PID", "_PID"]
FLOW_FIELDS = ["src_ip", "dst_ip", "src_port", "dst_port", "source_ip", "dest_ip"]


def _result(event_type, category=None, severity=None, tactic=None, technique=None) -> Column:
    lit = lambda v, kind: (v if isinstance(v, Column) else F.lit(v)).cast(kind)
    return F.struct(
        lit(event_type, "string").alias("event_type"), lit(category, "string").alias("category"), lit(severity, "int").alias("severity"),
        lit(tactic, "string").alias("mitre_tactic"), lit(technique, "string").alias("mitre_technique"),
    )


def classify_by_label() -> Column:
    """Labels set by the source; null when they name nothing malicious."""
    cat, label = field("attack_cat"), F.lower(F.coalesce(field("Label"), field("label")))
    by_category = F.when(~cat.isin("", "Normal", "normal"), _result("security", F.lower(cat), 3, "unknown", ""))
    by_label = F.when(~label.isin("", "benign", "normal", "0"), _result("security", F.lower(F.coalesce(field("attack_type"), label)), 3, "unknown", ""))
    return F.when(cat.isNotNull(), by_category).otherwise(by_label)


def _words(text: str) -> list[str]:
    return text.split("|")


def classify_by_regex(scan: Column) -> Column:
    """Keywords in the lower-cased message."""
    return first_case([(contains_any(scan, _words(words)), _result("security", *tags)) for words, *tags in KEYWORD_RULES])


def scan_text(message: str = "message") -> Column:
    return F.lower(message)


def classify_fallback(scan: Column) -> Column:
    return first_case(
        [
            (scan.rlike(PRIVILEGE), _result("security", "privilege-escalation", 2, "privilege-escalation", "T1548")),
            (scan.rlike(BLOCKED), _result("security", "firewall", 2, "defense-evasion", "T1562")),
            (has_any(*PID_FIELDS), _result("process")),
            (has_any(*FLOW_FIELDS), _result("network")),
            (scan.rlike(PROCESS_TEXT), _result("process")),
            (scan.rlike(NETWORK_TEXT), _result("network")),
        ],
        _result("raw"),
    )


def default_severity(level: str = "level") -> Column:
    c = F.col(level)
    return F.when(c == "CRITICAL", 4).when(c == "ERROR", 3).when(c == "WARNING", 2).otherwise(0)


def classify(normalized: DataFrame) -> DataFrame:
    """Label, then keywords, then fields and text; a type given by the sender is kept."""
    given = F.when(F.col("is_preclassified"), _result(F.col("given_type")))
    df = computed(normalized, {"_scan": scan_text()})
    scan = F.col("_scan")
    df = computed(df, {"_c": F.coalesce(given, classify_by_label(), classify_by_regex(scan), classify_fallback(scan))}).drop("_scan")
    df = df.select("*", "_c.event_type", "_c.category", F.col("_c.severity").alias("_sev"), "_c.mitre_tactic", "_c.mitre_technique").drop("_c")
    plain = ~F.col("is_preclassified") & (F.col("event_type") != "security")
    described = F.when(~F.col("is_preclassified") & (F.col("event_type") == "security"), F.col("message"))
    return df.withColumns({"severity": F.when(plain, default_severity()).otherwise(F.col("_sev")), "description": described}).drop("_sev", "given_type")
