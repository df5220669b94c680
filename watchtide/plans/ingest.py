"""Normalisation, classification, Windows events, typed rows and file-level sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchtide.functions import expr as X
from watchtide.operators import classify as C, normalize as N, triage as G, typed as Y, winevents as W
from watchtide.operators.netfeatures import port_service
from watchtide.plans.registry import query
from watchtide.session import written_once
from watchtide.sources import readers, sinks
from watchtide.sources.views import AS_OF, Tables

# ---- SQL of the whole chain, used by the checks ----------------------------------------


def f(*names, default=None):
    parts = [p for n in names for p in (f"k->>'$.{n}'", f"j->>'$.{n}'")]
    return f"coalesce({', '.join(parts)}{'' if default is None else ', ' + repr(default)})"


def i(text, default):
    return f"coalesce(CASE WHEN regexp_matches({text}, '^\\s*[+-]?[0-9]+\\s*$') THEN TRY_CAST(trim({text}) AS BIGINT) END, {default})"


IP_RE = r"'^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$'"


def ip(text):
    return f"CASE WHEN regexp_matches({text}, {IP_RE}) THEN {text} ELSE '0.0.0.0' END"


RAW_LEVEL = """CASE WHEN j->>'$.level' IS NOT NULL THEN CASE WHEN upper(j->>'$.level') IN ('CRITICAL','ALERT','EMERG','CRIT') THEN 4 WHEN upper(j->>'$.level') IN ('ERROR','ERR') THEN 3 WHEN upper(j->>'$.level') IN ('WARNING','WARN') THEN 2 ELSE 0 END
 WHEN j->>'$.severity' IS NOT NULL THEN coalesce(greatest(least(TRY_CAST(j->>'$.severity' AS BIGINT), 4), 0), 0)
 WHEN j->>'$.priority' IS NOT NULL THEN CASE WHEN TRY_CAST(j->>'$.priority' AS BIGINT) <= 2 THEN 4 WHEN TRY_CAST(j->>'$.priority' AS BIGINT) = 3 THEN 3 WHEN TRY_CAST(j->>'$.priority' AS BIGINT) = 4 THEN 2 ELSE 0 END ELSE 0 END"""


def keyword_case(column):
    arms = []
    for words, cat, sev, tac, tec in C.KEYWORD_RULES:
        value = {"category": repr(cat), "severity": sev, "mitre_tactic": repr(tac), "mitre_technique": repr(tec), "event_type": "'security'"}[column]
        arms.append(f"WHEN regexp_matches(scan, '(?i){words}') THEN {value}")
    return " ".join(arms)


def fallback_case(column):
    rules = [
        (f"regexp_matches(scan, '{C.PRIVILEGE}')", ("security", "privilege-escalation", 2, "privilege-escalation", "T1548")),
        (f"regexp_matches(scan, '{C.BLOCKED}')", ("security", "firewall", 2, "defense-evasion", "T1562")),
        (f"{f('pid', 'PID', '_PID')} IS NOT NULL", ("process",)), (f"{f(*C.FLOW_FIELDS)} IS NOT NULL", ("network",)),
        (f"regexp_matches(scan, '{C.PROCESS_TEXT}')", ("process",)), (f"regexp_matches(scan, '{C.NETWORK_TEXT}')", ("network",)),
    ]
    pos = ["event_type", "category", "severity", "mitre_tactic", "mitre_technique"].index(column)
    return " ".join(f"WHEN {cond} THEN {repr(v[pos]) if pos < len(v) else 'NULL'}" for cond, v in rules)


def label_case(column):
    value = {"event_type": "'security'", "severity": "3", "mitre_tactic": "'unknown'", "mitre_technique": "''"}
    by_cat = value.get(column, f"lower({f('attack_cat')})")
    by_lab = value.get(column, f"lower(coalesce({f('attack_type')}, {f('Label', 'label')}))")
    return f"WHEN bad_cat THEN {by_cat} WHEN bad_label THEN {by_lab}"


def class_col(column):
    given = "hint" if column == "event_type" else "NULL"
    end = "'raw'" if column == "event_type" else "NULL"
    return f"CASE WHEN skip THEN {given} {label_case(column)} {keyword_case(column)} {fallback_case(column)} ELSE {end} END AS {'sev' if column == 'severity' else column}"


NORM = f"""p AS (SELECT event_id, ingest_ts, TRY_CAST(value AS JSON) AS j FROM fx_messages WHERE json_valid(value)),
q AS (SELECT *, j->>'$.event_type_hint' AS hint, coalesce(j->>'$.event_type_hint' IN ('security', 'process', 'network', 'raw'), false) AS skip FROM p),
r AS (SELECT *, CASE WHEN NOT skip AND starts_with(j->>'$.message', '{{') THEN TRY_CAST(j->>'$.message' AS JSON) END AS k, {RAW_LEVEL} AS raw_level, coalesce(j->>'$.source_type', 'unknown') AS source_type FROM q),
s AS (SELECT *, coalesce(TRY_CAST({f('timestamp')} AS TIMESTAMP), ingest_ts) AS ts,
 CASE WHEN skip THEN {f('hostname', default='unknown')} ELSE {f('hostname', 'host', 'container_name', '_HOSTNAME', default='unknown')} END AS hostname, {f('message')} AS message,
 CASE WHEN skip THEN {f('ip_address')} ELSE coalesce({f('ip_address')}, CASE WHEN {f('src_ip', 'source_ip')} IS NULL THEN nullif(regexp_extract({f('message')}, '\\b([0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}})\\b', 1), '') END) END AS ip_address,
 CASE WHEN skip THEN upper({f('level', default='INFO')}) ELSE upper({f('level', 'severity', 'priority', 'PRIORITY', default='INFO')}) END AS lv,
 CASE WHEN skip THEN {f('source', default='vector')} ELSE coalesce(nullif({f('appname')}, ''), {f('_SYSTEMD_UNIT', 'container_name', 'source_type', 'source', default='vector')}) END AS source FROM r),
n AS (SELECT *, CASE WHEN skip OR lv IN ('CRITICAL','ERROR','WARNING','INFO','DEBUG') THEN lv WHEN lv IN ('0','1','2') THEN 'CRITICAL' WHEN lv = '3' THEN 'ERROR' WHEN lv = '4' THEN 'WARNING' WHEN lv IN ('5','6') THEN 'INFO' WHEN lv = '7' THEN 'DEBUG'
  WHEN regexp_matches(lv, 'EMERG|CRIT|ALERT') THEN 'CRITICAL' WHEN contains(lv, 'ERR') THEN 'ERROR' WHEN contains(lv, 'WARN') THEN 'WARNING' WHEN regexp_matches(lv, 'DEBUG|TRACE') THEN 'DEBUG' ELSE 'INFO' END AS level,
 CASE WHEN skip OR source_type NOT IN ('syslog','file','journald') THEN message
  WHEN regexp_matches(message, '{N.SYSLOG_START}') THEN CASE WHEN regexp_matches(message, '{N.SYSLOG_BODY}') THEN regexp_extract(message, '{N.SYSLOG_BODY}', 1) ELSE message END
  WHEN regexp_matches(message, '{N.ISO_START}') THEN CASE WHEN regexp_matches(message, '{N.ISO_BODY}') THEN regexp_extract(message, '{N.ISO_BODY}', 1) ELSE message END ELSE message END AS message_body,
 message AS scan, coalesce({f('attack_cat')} NOT IN ('', 'Normal', 'normal'), false) AS bad_cat,
 coalesce({f('attack_cat')} IS NULL AND lower({f('Label', 'label')}) NOT IN ('', 'benign', 'normal', '0'), false) AS bad_label FROM s),
l AS (SELECT *, CASE WHEN skip THEN raw_level ELSE CASE level WHEN 'CRITICAL' THEN 4 WHEN 'ERROR' THEN 3 WHEN 'WARNING' THEN 2 ELSE 0 END END AS original_log_level,
 {', '.join(class_col(c) for c in ('event_type', 'category', 'severity', 'mitre_tactic', 'mitre_technique'))} FROM n),
c AS (SELECT *, CASE WHEN NOT skip AND event_type <> 'security' THEN CASE level WHEN 'CRITICAL' THEN 4 WHEN 'ERROR' THEN 3 WHEN 'WARNING' THEN 2 ELSE 0 END ELSE sev END AS severity,
 CASE WHEN NOT skip AND event_type = 'security' THEN message END AS description FROM l)"""


def parsed(t: Tables):
    return N.parse_messages(t.messages).where(F.col("fields").isNotNull())


def normalized(t: Tables):
    return N.normalize(parsed(t))


def classified(t: Tables):
    return C.classify(normalized(t))


def norm_query(name, sql_cols, *cols):
    @query(name, f"WITH {NORM} SELECT event_id, {sql_cols} FROM c")
    def run(t):
        return normalized(t).select("event_id", *cols)

    return run


norm_query("normalize_timestamp", "CAST(ts AS VARCHAR) AS timestamp", "timestamp")
norm_query("merge_json_message", "hostname, level", "hostname", "level")
norm_query("normalize_hostname", "hostname", "hostname")
norm_query("extract_ip", "ip_address", "ip_address")
norm_query("normalize_level", "level", "level")
norm_query("original_log_level", "CAST(original_log_level AS BIGINT) AS original_log_level", "original_log_level")
norm_query("normalize_source", "source", "source")
norm_query("strip_syslog_header", "message_body", "message_body")


@query("classify_by_label", f"""WITH {NORM} SELECT event_id, CASE {label_case('category')} END AS category, CAST(CASE {label_case('severity')} END AS BIGINT) AS severity FROM c""")
def classify_by_label(t):
    return normalized(t).withColumn("c", C.classify_by_label()).select("event_id", "c.category", "c.severity")


TAGS = ("category", "severity", "mitre_tactic", "mitre_technique")


def _tag_sql(case):
    return ", ".join(f"CAST(CASE {case(c)} END AS {'BIGINT' if c == 'severity' else 'VARCHAR'}) AS {c}" for c in TAGS)


@query("classify_by_regex", f"WITH {NORM} SELECT event_id, {_tag_sql(keyword_case)} FROM c")
def classify_by_regex(t):
    return normalized(t).withColumn("c", C.classify_by_regex(C.scan_text())).select("event_id", *[f"c.{x}" for x in TAGS])


@query("classify_fallback", f"WITH {NORM} SELECT event_id, CASE {fallback_case('event_type')} ELSE 'raw' END AS event_type, {_tag_sql(fallback_case)} FROM c")
def classify_fallback(t):
    return normalized(t).withColumn("c", C.classify_fallback(C.scan_text())).select("event_id", "c.event_type", *[f"c.{x}" for x in TAGS])


@query("default_severity", f"WITH {NORM} SELECT event_id, CAST(CASE level WHEN 'CRITICAL' THEN 4 WHEN 'ERROR' THEN 3 WHEN 'WARNING' THEN 2 ELSE 0 END AS BIGINT) AS severity FROM c")
def default_severity(t):
    return normalized(t).select("event_id", C.default_severity().alias("severity"))


@query("classify", f"WITH {NORM} SELECT event_id, event_type, category, CAST(severity AS BIGINT) AS severity, mitre_tactic, mitre_technique, description FROM c")
def classify(t):
    return classified(t).select("event_id", "event_type", "category", "severity", "mitre_tactic", "mitre_technique", "description")


@query("preclassified_bypass", f"WITH {NORM} SELECT event_id, event_type, hostname, level, source FROM c WHERE skip")
def preclassified_bypass(t):
    return classified(t).where("is_preclassified").select("event_id", "event_type", "hostname", "level", "source")


@query("route_by_type", f"WITH {NORM} SELECT event_type, event_id, CASE WHEN event_type = 'raw' THEN message ELSE hostname END AS text FROM c WHERE NOT (event_type = 'raw' AND level = 'DEBUG')")
def route_by_type(t):
    """The rows of the four typed tables."""
    out = None
    for kind, df in N.route_by_type(written_once(classified(t))).items():
        part = df.select(F.lit(kind).alias("event_type"), "event_id", F.col("message" if kind == "raw" else "hostname").alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


@query("route_counts", f"WITH {NORM} SELECT event_type, count(*) AS cnt FROM c WHERE NOT (event_type = 'raw' AND level = 'DEBUG') GROUP BY 1")
def route_counts(t):
    return N.route_counts(classified(t))


PORT = lambda t: f"CASE WHEN {t} BETWEEN 0 AND 65535 THEN {t} ELSE 0 END"
PROC_SQL = f"""CAST({i(f('pid', 'PID', '_PID'), 0)} AS BIGINT) AS pid, CAST({i(f('ppid', 'PPID'), 0)} AS BIGINT) AS ppid, CAST({i(f('uid', 'UID', '_UID'), 0)} AS BIGINT) AS uid, CAST({i(f('exit_code', 'EXIT_STATUS'), -1)} AS BIGINT) AS exit_code,
 {f('binary_path', 'exe', '_EXE', 'COMM', default='')} AS binary_path, {f('arguments', 'cmdline', '_CMDLINE', default='')} AS arguments"""
NET_SQL = f"""{ip(f('src_ip', 'source_ip', 'client_ip'))} AS src_ip, {ip(f('dst_ip', 'dest_ip', 'destination_ip', 'server_ip'))} AS dst_ip,
 CAST({PORT(i(f('src_port', 'source_port', 'client_port'), 0))} AS BIGINT) AS src_port, CAST({PORT(i(f('dst_port', 'dest_port', 'destination_port', 'server_port'), 0))} AS BIGINT) AS dst_port,
 upper({f('protocol', 'proto', default='TCP')}) AS protocol, {f('direction', default='outbound')} AS direction, CAST({i(f('bytes_sent', 'bytes_out'), 0)} AS BIGINT) AS bytes_sent, CAST({i(f('duration_ms', 'duration'), 0)} AS BIGINT) AS duration_ms,
 {f('dns_query', 'query', default='')} AS dns_query"""


@query("normalize_process", f"WITH {NORM} SELECT event_id, {PROC_SQL} FROM c")
def normalize_process(t):
    return N.normalize_process(parsed_merged(t)).select("event_id", "pid", "ppid", "uid", "exit_code", "binary_path", "arguments")


@query("normalize_network", f"WITH {NORM} SELECT event_id, {NET_SQL} FROM c")
def normalize_network(t):
    return N.normalize_network(parsed_merged(t)).select("event_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "direction", "bytes_sent", "duration_ms", "dns_query")


def parsed_merged(t):
    return N.merge_json_message(parsed(t))


@query("project_event_security", f"""WITH {NORM} SELECT event_id, CAST(ts AS VARCHAR) AS timestamp, CAST(coalesce(severity, 0) AS BIGINT) AS severity, coalesce(category, 'unknown') AS category, source, coalesce(description, message) AS description,
 {f('user_id', default='')} AS user_id, {ip('ip_address')} AS ip_address, hostname, coalesce(mitre_tactic, '') AS mitre_tactic, coalesce(mitre_technique, '') AS mitre_technique, message_body, source_type, CAST(original_log_level AS BIGINT) AS original_log_level FROM c WHERE event_type = 'security'""")
def project_event_security(t):
    return N.project_event(classified(t), "security").drop("metadata", "ai_confidence", "ai_explanation")


@query("project_event_process", f"WITH {NORM} SELECT event_id, CAST(ts AS VARCHAR) AS timestamp, hostname, {PROC_SQL}, message_body FROM c WHERE event_type = 'process'")
def project_event_process(t):
    return N.project_event(classified(t), "process").select("event_id", "timestamp", "hostname", "pid", "ppid", "uid", "exit_code", "binary_path", "arguments", "message_body")


@query("project_event_network", f"WITH {NORM} SELECT event_id, CAST(ts AS VARCHAR) AS timestamp, hostname, {NET_SQL}, message_body FROM c WHERE event_type = 'network'")
def project_event_network(t):
    return N.project_event(classified(t), "network").select("event_id", "timestamp", "hostname", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "direction", "bytes_sent", "duration_ms", "dns_query", "message_body")


@query("project_event_raw", f"WITH {NORM} SELECT event_id, CAST(ts AS VARCHAR) AS timestamp, level, source, {ip('ip_address')} AS ip_address, message, message_body, source_type, CAST(original_log_level AS BIGINT) AS original_log_level FROM c WHERE event_type = 'raw' AND level <> 'DEBUG'")
def project_event_raw(t):
    return N.project_event(classified(t), "raw").drop("metadata")


@query("build_metadata")
def build_metadata(t):
    return classified(t).select("event_id", N.build_metadata(F.col("event_type")).alias("metadata"))


# ---- Windows ---------------------------------------------------------------------------

D = lambda n, d="": f"coalesce(event_data::JSON->>'$.{n}', {d!r})"


def sql_fill(template):
    import re

    parts = []
    for piece in re.split(r"(\{[^}]*\})", template):
        if piece == "{PROTOCOL}":
            parts.append(f"upper({D('Protocol', 'TCP')})")
        elif piece.startswith("{"):
            name, _, default = piece[1:-1].partition("=")
            first = ", ".join(f"event_data::JSON->>'$.{n}'" for n in name.split("|"))
            parts.append(f"coalesce({first}, '{default}')")
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return "concat(" + ", ".join(parts) + ")"


def sql_case(rules, pos, end="NULL"):
    arms = " ".join(f"WHEN {k} THEN {sql_fill(v[5]) if pos == 5 else ('NULL' if v[pos] is None else repr(v[pos]))}" for k, v in rules.items())
    return f"CASE eid {arms} ELSE {end} END"


REG = "eid IN (12, 13, 14)"
TGT = f"lower({D('TargetObject')})"
REG_ARM = lambda i, base: f"CASE WHEN contains({TGT}, '\\run') THEN {[4, base, 'T1547.001'][i] if i != 2 else repr('T1547.001')} WHEN contains({TGT}, '\\services\\') THEN {[base, base, repr('T1543.003')][i]} WHEN contains({TGT}, '\\schedule\\taskcache') THEN {[base, base, repr('T1053.005')][i]} WHEN contains({TGT}, '\\image file execution') THEN {[4, repr('defense-evasion'), repr('T1546.012')][i]} WHEN contains({TGT}, '\\windows defender') THEN {[4, repr('defense-evasion'), repr('T1562.001')][i]} ELSE {base} END"
PIPE = "(eid IN (17, 18) AND (" + " OR ".join(f"contains(lower({D('PipeName')}), '{p}')" for p in W.MALICIOUS_PIPES) + "))"
UNSIGNED = f"lower({D('Signed', 'true')}) = 'false'"


@query("sysmon_events", f"""WITH w AS (SELECT *, {sql_case(W.SYSMON, 2)} AS s0, {sql_case(W.SYSMON, 3)} AS t0, {sql_case(W.SYSMON, 4)} AS q0 FROM fx_winlog WHERE channel = 'sysmon')
SELECT event_id, CAST(eid AS BIGINT) AS eid, CASE WHEN {PIPE} THEN 'security' ELSE {sql_case(W.SYSMON, 0, "'raw'")} END AS event_type, CASE WHEN {PIPE} THEN 'command-and-control' ELSE {sql_case(W.SYSMON, 1)} END AS category,
 CAST(CASE WHEN {PIPE} THEN 4 WHEN eid = 6 AND {UNSIGNED} THEN 4 WHEN {REG} THEN {REG_ARM(0, 's0')} ELSE s0 END AS BIGINT) AS severity,
 CASE WHEN {PIPE} THEN 'command-and-control' WHEN {REG} THEN {REG_ARM(1, 't0')} ELSE t0 END AS mitre_tactic,
 CASE WHEN {PIPE} THEN 'T1570' WHEN {REG} THEN {REG_ARM(2, 'q0')} ELSE q0 END AS mitre_technique,
 CASE WHEN {PIPE} THEN concat('Suspicious named pipe ', CASE eid WHEN 17 THEN 'created' ELSE 'connected' END, ': ', {D('PipeName')}, ' by ', {D('Image')})
  WHEN eid = 10 AND contains(lower({D('TargetImage')}), 'lsass') THEN {sql_fill(chr(76) + "SASS credential dump attempt: {SourceImage} accessed lsass.exe (GrantedAccess:{GrantedAccess})")} WHEN eid = 99 THEN '' ELSE {sql_case(W.SYSMON, 5)} END AS message,
 CASE WHEN eid IN (17, 18, 23, 26) THEN 'WARNING' ELSE 'INFO' END AS level, CAST(CASE WHEN eid = 7 AND {UNSIGNED} THEN 1 ELSE 0 END AS BIGINT) AS is_suspicious,
 CASE WHEN eid = 22 THEN '0.0.0.0' WHEN eid = 3 THEN {D('SourceIp', '0.0.0.0')} END AS src_ip, CAST(CASE WHEN eid = 22 THEN 53 WHEN eid = 3 THEN CAST({D('DestinationPort', '0')} AS INT) END AS BIGINT) AS dst_port,
 CASE WHEN eid = 22 THEN 'outbound' WHEN eid = 3 THEN CASE WHEN {D('Initiated', 'true')} = 'false' THEN 'inbound' ELSE 'outbound' END END AS direction FROM w""")
def sysmon_events(t):
    df = W.sysmon_events(t.winlog.where("channel = 'sysmon'"))
    # the text of an unknown id is JSON, whose spacing differs between engines
    return df.withColumn("message", F.when(F.col("eid") == 99, "").otherwise(F.col("message"))).select(
        "event_id", "eid", *W.TAGS, "message", "level", "is_suspicious", "src_ip", "dst_port", "direction")


@query("windows_security_events", f"""SELECT event_id, CAST(eid AS BIGINT) AS eid, {sql_case(W.SECURITY, 0, "'raw'")} AS event_type, {sql_case(W.SECURITY, 1)} AS category, CAST({sql_case(W.SECURITY, 2)} AS BIGINT) AS severity, {sql_case(W.SECURITY, 3)} AS mitre_tactic,
 {sql_case(W.SECURITY, 4)} AS mitre_technique, CASE WHEN eid = 5156 THEN '' ELSE {sql_case(W.SECURITY, 5)} END AS message,
 CASE WHEN eid IN (4624, 4625) THEN {D('TargetUserName')} WHEN eid IN (4648, 4672, 4688, 4720, 4726, 4732, 4733) THEN {D('SubjectUserName')} ELSE '' END AS user_id, CASE WHEN eid IN (4624, 4625) THEN {D('IpAddress', '0.0.0.0')} ELSE '0.0.0.0' END AS ip_address
 FROM fx_winlog WHERE channel = 'security'""")
def windows_security_events(t):
    df = W.windows_security_events(t.winlog.where("channel = 'security'"))
    return df.withColumn("message", F.when(F.col("eid") == 5156, "").otherwise(F.col("message"))).select("event_id", "eid", *W.TAGS, "message", "user_id", "ip_address")


def _script_sql():
    s = f"lower({D('ScriptBlockText')})"
    arms = []
    for words, tech in W.SCRIPT_RULES:
        conds = [" AND ".join(f"contains({s}, '{x}')" for x in (w if isinstance(w, list) else [w])) for w in words]
        arms.append(f"WHEN {' OR '.join('(' + c + ')' for c in conds)} THEN '{tech}'")
    return f"CASE WHEN eid <> 4104 THEN NULL {' '.join(arms)} END"


@query("powershell_events", f"""WITH w AS (SELECT *, {_script_sql()} AS tech FROM fx_winlog WHERE channel = 'powershell')
SELECT event_id, CAST(eid AS BIGINT) AS eid, CASE WHEN tech IS NULL THEN 'raw' ELSE 'security' END AS event_type, CASE WHEN tech IS NOT NULL THEN 'execution' END AS category, CAST(CASE WHEN tech IS NOT NULL THEN 4 END AS BIGINT) AS severity,
 tech AS mitre_technique, CASE WHEN eid = 4104 THEN concat('PowerShell script block: ', {D('ScriptBlockText')}) ELSE '' END AS message FROM w""")
def powershell_events(t):
    df = W.powershell_events(t.winlog.where("channel = 'powershell'"))
    return df.withColumn("message", F.when(F.col("eid") == 4104, F.col("message")).otherwise("")).select("event_id", "eid", "event_type", "category", "severity", "mitre_technique", "message")


def _process_sql():
    b, a, p = "lower(binary_path)", "lower(arguments)", "lower(parent_binary)"
    any_of = lambda fn, c, ws: "(" + " OR ".join(f"{fn}({c}, '{w}')" for w in ws) + ")"
    rules = [(f"ends_with({b}, '{n}.exe')", f"lolbin_{n}") for n in W.LOLBINS]
    rules.append((any_of("ends_with", b, ["powershell.exe", "pwsh.exe"]) + " AND " + any_of("contains", a, W.SHELL_FLAGS), "suspicious_powershell"))
    rules += [(f"contains({a}, '{w}')", "recon_" + w.replace(" ", "_").replace("-", "")) for w in W.RECON]
    rules.append((f"{any_of('contains', b, ['mimikatz', 'procdump', 'lazagne'])} OR contains({a}, 'sekurlsa') OR (contains({b}, 'rundll32') AND contains({a}, 'comsvcs.dll'))", "credential_dumping"))
    rules.append((any_of("ends_with", p, W.OFFICE) + " AND " + any_of("ends_with", b, W.SPAWNED), "office_macro_spawn"))
    rules.append((any_of("contains", b, W.DROP_FOLDERS), "exec_from_suspicious_path"))
    return "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in reversed(rules)) + " ELSE '' END"


@query("suspicious_process", f"SELECT event_id, {_process_sql()} AS detection_rule, CAST({_process_sql()} <> '' AS BIGINT) AS is_suspicious FROM fx_process")
def suspicious_process(t):
    return W.suspicious_process(t.process).select("event_id", "detection_rule", "is_suspicious")


SYSMON_TYPE = f"CASE WHEN {PIPE} THEN 'security' ELSE {sql_case(W.SYSMON, 0, chr(39) + 'raw' + chr(39))} END"


@query("windows_events_by_type", f"""WITH p AS (SELECT event_id, {D('Image')} AS binary_path, {D('CommandLine')} AS arguments, {D('ParentImage')} AS parent_binary FROM fx_winlog WHERE channel = 'sysmon' AND eid = 1),
 r AS (SELECT event_id, CAST({_process_sql()} <> '' AS BIGINT) AS started FROM p),
 w AS (SELECT channel, {SYSMON_TYPE} AS event_type, CASE WHEN eid = 1 THEN started WHEN eid = 7 AND {UNSIGNED} THEN 1 ELSE 0 END AS is_suspicious FROM fx_winlog LEFT JOIN r USING (event_id) WHERE channel = 'sysmon'
 UNION ALL SELECT channel, {sql_case(W.SECURITY, 0, "'raw'")}, 0 FROM fx_winlog WHERE channel = 'security'
 UNION ALL SELECT channel, CASE WHEN {_script_sql()} IS NULL THEN 'raw' ELSE 'security' END, 0 FROM fx_winlog WHERE channel = 'powershell')
SELECT channel, event_type, CAST(is_suspicious AS BIGINT) AS is_suspicious, count(*) AS cnt FROM w GROUP BY ALL""")
def windows_events_by_type(t):
    """All channels through one chain."""
    return W.windows_events(t.winlog).groupBy("channel", "event_type", "is_suspicious").agg(F.count("*").alias("cnt"))


# ---- typed rows ------------------------------------------------------------------------

def eid():
    return X.event_id("topic", "part", "pos")


@query("deterministic_event_id", r"""WITH x AS (SELECT event_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(concat_ws(':', topic, part, pos))) AS h FROM fx_messages)
SELECT event_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS uid FROM x""")
def deterministic_event_id(t):
    return t.messages.select("event_id", eid().alias("uid"))


@query("typed_rows_raw_logs", """SELECT CAST(coalesce(TRY_CAST(json_extract_string(value, '$.timestamp') AS TIMESTAMP), ingest_ts) AS VARCHAR) AS timestamp, coalesce(json_extract_string(value, '$.level'), 'INFO') AS level, coalesce(json_extract_string(value, '$.source'), 'unknown') AS source,
 coalesce(json_extract_string(value, '$.message'), '') AS message, coalesce(json_extract_string(value, '$.ip_address'), '0.0.0.0') AS ip_address FROM fx_messages WHERE json_valid(value)""")
def typed_rows_raw_logs(t):
    return Y.typed_rows(t.messages, "raw_logs", event_id=eid()).select("timestamp", "level", "source", "message", "ip_address")


def as_json(df, *cols):
    return df.select(F.col("event_id").alias("row_id"), F.lit("t").alias("topic"), F.lit("2024-01-31 00:00:00").cast("timestamp").alias("ingest_ts"), F.to_json(F.struct(*cols)).alias("value"))


@query("typed_rows_security_events", """SELECT CAST(timestamp AS VARCHAR) AS timestamp, CAST(severity AS BIGINT) AS severity, category, source, description, user_id, ip_address, hostname, mitre_tactic, mitre_technique, round(ai_confidence, 6) AS ai_confidence FROM fx_security""")
def typed_rows_security_events(t):
    ts = F.col("timestamp").cast("string").alias("timestamp")
    rows = as_json(t.security, ts, "severity", "category", "source", "description", "user_id", "ip_address", "hostname", "mitre_tactic", "mitre_technique", F.col("ai_confidence").cast("string").alias("ai_confidence"))
    return Y.typed_rows(rows, "security_events").drop("event_id", "metadata", "ai_explanation", "anchor_tx_id")


@query("typed_rows_process_events", """SELECT hostname, pid, ppid, uid, gid, binary_path, arguments, CAST(-1 AS BIGINT) AS exit_code, container_id, CAST(is_suspicious AS BIGINT) AS is_suspicious, '' AS cwd FROM fx_process""")
def typed_rows_process_events(t):
    rows = as_json(t.process, "hostname", F.col("pid").cast("string").alias("pid"), "ppid", "uid", "gid", "binary_path", "arguments", F.lit("x").alias("exit_code"), "container_id", "is_suspicious")
    return Y.typed_rows(rows, "process_events").select("hostname", "pid", "ppid", "uid", "gid", "binary_path", "arguments", "exit_code", "container_id", "is_suspicious", "cwd")


@query("typed_rows_network_events", """SELECT hostname, src_ip, CAST(src_port AS BIGINT) AS src_port, dst_ip, CAST(dst_port AS BIGINT) AS dst_port, protocol, direction, CAST(bytes_sent AS BIGINT) AS bytes_sent, CAST(duration_ms AS BIGINT) AS duration_ms, dns_query, geo_country, detection_rule FROM fx_network""")
def typed_rows_network_events(t):
    cols = ["hostname", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "direction", "bytes_sent", "duration_ms", "dns_query", "geo_country", "detection_rule"]
    return Y.typed_rows(as_json(t.network, *cols), "network_events").select(*cols)


@query("typed_rows_triage_scores", """SELECT source_type, hostname, source_ip, user_id, template_id, round(template_rarity, 6) AS template_rarity, round(lgbm_score, 6) AS lgbm_score, CAST(1 AS DOUBLE) AS asset_multiplier, 'discard' AS action, CAST(0 AS BIGINT) AS ioc_match FROM fx_scores""")
def typed_rows_triage_scores(t):
    rows = as_json(t.scores, "source_type", "hostname", "source_ip", "user_id", "template_id", "template_rarity", "lgbm_score", F.lit("high").alias("asset_multiplier"))
    return Y.typed_rows(rows, "triage_scores").select("source_type", "hostname", "source_ip", "user_id", "template_id", "template_rarity", "lgbm_score", "asset_multiplier", "action", "ioc_match")


@query("typed_rows_hunter_investigations", """SELECT '00000000-0000-0000-0000-000000000000' AS alert_id, CAST(timestamp AS VARCHAR) AS started_at, CAST(NULL AS VARCHAR) AS completed_at, 'pending' AS status, hostname, source_ip, round(lgbm_score, 6) AS trigger_score, 'info' AS severity,
 concat('6ba7b810-9dad-11d1-80b4-00c04fd430c8|00000000-0000-0000-0000-000000000000') AS correlated_events, concat(mitre_tactic, '|x') AS mitre_tactics, '' AS mitre_techniques FROM fx_scores""")
def typed_rows_hunter_investigations(t):
    rows = as_json(t.scores, F.col("event_id").alias("alert_id"), F.col("timestamp").cast("string").alias("started_at"), "hostname", "source_ip", F.col("lgbm_score").alias("trigger_score"),
                   F.array(F.lit("6ba7b810-9dad-11d1-80b4-00c04fd430c8"), F.lit("host-1")).alias("correlated_events"), F.array("mitre_tactic", F.lit("x")).alias("mitre_tactics"))
    return Y.typed_rows(rows, "hunter_investigations").select("alert_id", "started_at", "completed_at", "status", "hostname", "source_ip", "trigger_score", "severity", "correlated_events", "mitre_tactics", "mitre_techniques")


@query("verifier_and_feedback_tables", """SELECT 'verifier_results' AS tbl, 'inconclusive' AS verdict, 'P4' AS priority, round(lgbm_score, 6) AS score, hostname AS note, CAST(NULL AS VARCHAR) AS score_id FROM fx_scores
 UNION ALL SELECT 'feedback_labels', 'unknown', 'medium', round(eif_score, 6), user_id, CASE WHEN event_id % 2 = 0 THEN '6ba7b810-9dad-11d1-80b4-00c04fd430c8' END FROM fx_scores""")
def verifier_and_feedback_tables(t):
    v = Y.typed_rows(as_json(t.scores, F.col("lgbm_score").alias("confidence"), F.col("hostname").alias("analyst_summary")), "verifier_results")
    sid = F.when(F.col("event_id") % 2 == 0, "6ba7b810-9dad-11d1-80b4-00c04fd430c8").otherwise("short").alias("score_id")
    fb = Y.typed_rows(as_json(t.scores, F.col("eif_score").alias("original_eif"), F.col("user_id").alias("notes"), sid), "feedback_labels")
    a = v.select(F.lit("verifier_results").alias("tbl"), "verdict", "priority", F.col("confidence").alias("score"), F.col("analyst_summary").alias("note"), F.lit(None).cast("string").alias("score_id"))
    return a.unionByName(fb.select(F.lit("feedback_labels").alias("tbl"), F.col("label").alias("verdict"), F.col("confidence").alias("priority"), F.col("original_eif").alias("score"), F.col("notes").alias("note"), "score_id"))


@query("dead_letter_sink", """SELECT CAST(ingest_ts AS VARCHAR) AS timestamp, 'json_parse' AS failed_stage, topic AS source_topic, concat('not a JSON object: ', value) AS error_message, value AS raw_payload, CAST(0 AS BIGINT) AS retry_count FROM fx_messages WHERE NOT json_valid(value)""")
def dead_letter_sink(t):
    return Y.dead_letters(t.messages)


# ---- sources and sinks -----------------------------------------------------------------


@query("ndjson_source", """SELECT json_extract_string(value, '$.seq')::BIGINT AS seq, json_extract_string(value, '$.source_type') AS source_type, json_extract_string(value, '$.message') AS message FROM fx_messages WHERE json_valid(value)""")
def ndjson_source(t):
    """The declared-schema parse of the line source, applied to message text."""
    return t.messages.select(F.from_json("value", "seq bigint, source_type string, message string").alias("j")).where("j.source_type IS NOT NULL").select("j.*")


@query("multiline_merge", r"""WITH x AS (SELECT *, CAST(sum(CASE WHEN regexp_matches(text, '^(?:[A-M])') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS group_no FROM conversations)
SELECT conv_id, group_no, min(turn) AS first_seq, count(*) AS line_count, string_agg(text, chr(10) ORDER BY turn) AS message FROM x GROUP BY conv_id, group_no""")
def multiline_merge(t):
    return readers.multiline_merge(t.base("conversations"), "conv_id", "turn", "text", start="^(?:[A-M])")


@query("raw_line_source", r"""WITH x AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS message FROM documents) SELECT doc_id, message, count(*) AS copies FROM x WHERE message <> '' AND NOT starts_with(message, '#') GROUP BY ALL""")
def raw_line_source(t):
    lines = t.base("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    return readers.raw_line_source(lines).groupBy("doc_id", "message").agg(F.count("*").alias("copies"))


@query("round_robin_interleave", """SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents""")
def round_robin_interleave(t):
    return readers.round_robin_interleave(t.base("documents").select("source", "doc_id"), "source", "doc_id", F.expr("doc_id div 100"))


_PROFILE = [("doc_id", 0), ("quality", 0), ("toxic", 0), ("lang", 0), ("source", 0), ("n_chars", 0)]


@query("dataset_profile", "WITH x AS (SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars FROM labels l JOIN documents d USING (doc_id)) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values, min(CAST({c} AS VARCHAR)) AS sample, CAST({k} AS BIGINT) AS label_like FROM x" for c, k in _PROFILE))
def dataset_profile(t):
    return readers.dataset_profile(t.base("labels").join(t.base("documents").drop("text"), "doc_id"))


RET = ", ".join(f"('{n}', {a}, {b}, {c})" for n, a, b, c in sinks.RETENTION)


@query("retention_plan", f"""WITH pol AS (SELECT * FROM (VALUES {RET}) AS t(table_name, warm_days, cold_days, delete_days)), part AS (SELECT DISTINCT 'raw_logs' AS table_name, CAST(o_orderdate AS DATE) AS event_date FROM orders UNION SELECT DISTINCT 'security_events', CAST(timestamp AS DATE) FROM fx_security)
SELECT table_name, CAST(event_date AS VARCHAR) AS event_date, date_diff('day', event_date, DATE '2024-01-31') AS age_days, CASE WHEN date_diff('day', event_date, DATE '2024-01-31') >= delete_days THEN 'delete' WHEN date_diff('day', event_date, DATE '2024-01-31') >= cold_days THEN 'cold'
 WHEN date_diff('day', event_date, DATE '2024-01-31') >= warm_days THEN 'warm' ELSE 'hot' END AS tier FROM part JOIN pol USING (table_name)""")
def retention_plan(t):
    raw = t.base("orders").select(F.lit("raw_logs").alias("table_name"), F.to_date("o_orderdate").alias("event_date"))
    sec = t.security.select(F.lit("security_events").alias("table_name"), F.to_date("timestamp").alias("event_date"))
    return sinks.retention_plan(raw.unionByName(sec).distinct(), sinks.retention_policy(t.spark), AS_OF)


@query("keyed_sink", """SELECT category AS key, event_id, hostname, CAST(severity AS BIGINT) AS severity FROM fx_security""")
def keyed_sink(t):
    """Keys and what the messages hold."""
    sent = F.from_json("value", "event_id bigint, hostname string, severity bigint").alias("m")
    return sinks.keyed_messages(t.security, "category").select("key", sent).select("key", "m.*")


# ---- category maps ---------------------------------------------------------------------


def sql_map(name, table, default):
    return f"CASE {name} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in table.items()) + f" ELSE {default} END"


@query("map_source_type", f"SELECT event_id, CAST({sql_map('lower(trim(source))', G.SOURCE_TYPES, 9)} AS BIGINT) AS code FROM fx_raw")
def map_source_type(t):
    return t.raw.select("event_id", G.map_source_type("source", F.lit("network-events")).alias("code"))


@query("map_protocol", f"SELECT event_id, CAST({sql_map('lower(protocol)', G.PROTOCOLS, 6)} AS BIGINT) AS code FROM fx_network")
def map_protocol(t):
    return t.network.select("event_id", G.map_protocol("protocol").alias("code"))


@query("map_severity", f"SELECT event_id, CAST({sql_map('lower(level)', G.SEVERITIES_FIXED, 0)} AS BIGINT) AS code, CAST({sql_map('lower(level)', G.SEVERITIES, 0)} AS BIGINT) AS compat FROM fx_raw")
def map_severity(t):
    return t.raw.select("event_id", G.map_severity("level").alias("code"), G.map_severity("level", compat=True).alias("compat"))


@query("port_service", "SELECT event_id, CASE dst_port WHEN 445 THEN 'smb' WHEN 53 THEN 'dns' WHEN 443 THEN 'https' WHEN 80 THEN 'http' WHEN 22 THEN 'ssh' END AS service, CASE src_port WHEN 1433 THEN 'mssql' WHEN 1521 THEN 'oracle' WHEN 3306 THEN 'mysql' WHEN 3389 THEN 'rdp' WHEN 5432 THEN 'postgres' WHEN 5900 THEN 'vnc' WHEN 6379 THEN 'redis' WHEN 8080 THEN 'http_alt' WHEN 8443 THEN 'https_alt' WHEN 9092 THEN 'kafka' WHEN 9200 THEN 'elasticsearch' WHEN 27017 THEN 'mongodb' ELSE concat('port_', src_port) END AS src_service FROM fx_network")
def port_service_query(t):
    return t.network.select("event_id", port_service().alias("service"), port_service("src_port").alias("src_service"))


@query("ip_to_long", "SELECT event_id, CAST(split_part(ip_address, '.', 1)::BIGINT * 16777216 + split_part(ip_address, '.', 2)::BIGINT * 65536 + split_part(ip_address, '.', 3)::BIGINT * 256 + split_part(ip_address, '.', 4)::BIGINT AS BIGINT) AS n FROM fx_security")
def ip_to_long(t):
    return t.security.select("event_id", X.ip_to_long("ip_address").alias("n"))
