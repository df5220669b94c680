"""Security-event views over the given tables, one SQL text for Spark and DuckDB.

The views only derive columns; every row of ``events`` becomes one row of each view, so
work grows with the table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

# Report time of the queries: the end of the last day in the tables.
AS_OF = "2024-01-31 00:00:00"


class _Dialect:
    """The few places where the two SQL dialects differ."""

    def __init__(self, name: str):
        self.spark = name == "spark"

    def us(self, ts: str) -> str:
        return f"unix_micros({ts})" if self.spark else f"epoch_us({ts})"

    def from_us(self, n: str) -> str:
        return f"timestamp_micros({n})" if self.spark else f"make_timestamp({n})"

    def div(self, a: str, b: int) -> str:
        return f"(({a}) div {b})" if self.spark else f"(({a}) // {b})"

    def ts(self, c: str) -> str:
        return f"CAST({c} AS TIMESTAMP)"


def _pick(selector: str, values: list[str], size: int | None = None) -> str:
    """CASE over ``selector`` with one quoted text per branch."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {selector} % {size or len(values)} {arms} ELSE '' END"


MESSAGES = [
    "Failed password for root from 10.1.2.3 port 22 ssh2",
    "Account locked after brute force on host web-1",
    "Accepted publickey for deploy from 10.9.8.7 port 50022",
    "Malware signature found in /var/tmp/upload/file.bin",
    "Possible data leak: large upload to 203.0.113.9:443",
    "Port scan from 198.51.100.7 on 1024 ports",
    "Lateral movement suspected between db-1 and db-2",
    "DNS tunnel pattern in queries from 10.0.0.5",
    "iptables: packet dropped IN=eth0",
    "sudo: session for operator escalated",
    "Inbound connection from 192.0.2.4 was blocked",
    "process started comm=cron",
    "tcp connect 10.2.2.2:8080 established",
    "Jan 12 10:11:12 web-1 nginx[321]: GET /index.html 200",
    "2024-01-05T10:00:00Z app-2 worker: job 12345678 finished in 00:11:22:33:44:55",
    "healthcheck ok id 550e8400-e29b-41d4-a716-446655440000 took 15000 ms",
    "service reload complete at 2024-01-05 10:00:00.123 with 0x1f2e3d4c5b",
    "user bob created new account",
    "connection rejected by peer rst",
    "syn timeout waiting for handshake",
    "deny rule matched for policy bypass",
]

BINARIES = [
    "C:~Windows~System32~certutil.exe", "C:~Windows~System32~powershell.exe",
    "C:~Windows~System32~cmd.exe", "C:~Users~Public~tool.exe",
    "C:~Program Files~app~app.exe", "C:~tools~mimikatz.exe",
    "C:~Windows~System32~rundll32.exe", "C:~Windows~Temp~setup.exe",
    "C:~Windows~System32~wscript.exe", "/usr/bin/python3", "C:~Windows~explorer.exe",
]
ARGUMENTS = [
    "-urlcache -f http://example.test/a", "-nop -w hidden -enc SQBFAFgA", "/c whoami /all",
    "/c net user admin", "--run", "sekurlsa::logonpasswords", "comsvcs.dll MiniDump",
    "/quiet", "script.vbs", "-m http.server", "arp -a", "nltest /dclist", "/c dir",
]
PARENTS = [
    "C:~Windows~explorer.exe", "C:~Program Files~Office~WINWORD.EXE",
    "C:~Program Files~Office~EXCEL.EXE", "C:~Windows~services.exe",
]
SCRIPTS = [
    "Invoke-Mimikatz -DumpCreds", "IEX (New-Object Net.WebClient)", "DownloadString http://x.test",
    "powershell -enc AAAA", "Set-ExecutionPolicy Bypass", "Add-Type DllImport kernel32",
    "VirtualAlloc 0x1000", "Get-ChildItem C:~", "Write-Output ok",
]
REGISTRY = [
    "HKLM~Software~Microsoft~Windows~CurrentVersion~Run~x", "HKLM~System~Services~abc~y",
    "HKLM~Software~Schedule~TaskCache~z", "HKLM~Software~Image File Execution Options~a",
    "HKLM~Software~Windows Defender~b", "HKCU~Software~Other~c",
]
PIPES = ["~msse-1234", "~PSEXESVC", "~srvsvc", "~postex_77", "~lsass"]
SYSMON_IDS = [1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 17, 18, 22, 23, 24, 25, 26, 99]
SECURITY_IDS = [4624, 4625, 4648, 4672, 4688, 4720, 4726, 4732, 4733, 1102, 5156]
POWERSHELL_IDS = [4104, 4104, 4104, 4103, 400]


def view_sql(dialect: str) -> dict[str, str]:
    """Text of every view, by name; a view may use views named before it."""
    d = _Dialect(dialect)
    e = "event_id"
    us, day_us = d.us(d.ts("ts")), 86_400_000_000
    # bursts: a day shrinks to 43 s and starts at a different hour each day
    day = d.div(us, day_us)
    burst = d.from_us(f"{day} * {day_us} + (({day} * 7) % 24) * 3600000000 + {d.div(f'({us}) % {day_us}', 2000)}")
    bs = "chr(92)"

    def win(text: str) -> str:
        """Back-slashes for paths, written as ~ in the lists above."""
        return f"replace({text}, '~', {bs})"

    def js(text: str) -> str:
        """The same inside a JSON text, where a back-slash is doubled."""
        return f"replace({text}, '~', concat({bs}, {bs}))"

    ids = lambda values: " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))

    tables = {
        "fx_security": f"""
SELECT {e}, {d.ts('ts')} AS timestamp,
  CASE event_type WHEN 'error' THEN 4 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS severity,
  event_type AS category, concat('src', CAST({e} % 8 AS STRING)) AS source,
  {_pick(e, MESSAGES)} AS description,
  CASE WHEN user_id % 11 = 0 THEN '' ELSE concat('u', CAST(user_id AS STRING)) END AS user_id,
  concat('10.0.', CAST(user_id % 4 AS STRING), '.', CAST(user_id % 250 AS STRING)) AS ip_address,
  concat('host-', CAST(user_id % 22 AS STRING)) AS hostname,
  CASE event_type WHEN 'error' THEN 'credential-access' WHEN 'signup' THEN 'persistence' WHEN 'purchase' THEN 'exfiltration' WHEN 'click' THEN 'discovery' ELSE '' END AS mitre_tactic,
  CASE WHEN event_type = 'view' THEN '' WHEN event_type = 'error' THEN CASE WHEN {e} % 3 = 0 THEN 'T1110' ELSE 'T1078' END
       WHEN event_type = 'signup' THEN 'T1136' WHEN event_type = 'purchase' THEN 'T1041' ELSE 'T1046' END AS mitre_technique,
  value / 500 AS ai_confidence
FROM events""",
        "fx_network": f"""
SELECT {e}, {burst} AS timestamp, concat('host-', CAST(user_id % 22 AS STRING)) AS hostname,
  CASE WHEN user_id % 11 = 0 THEN '' ELSE concat('u', CAST(user_id AS STRING)) END AS user_id,
  concat('10.0.0.', CAST(user_id % 8 AS STRING)) AS src_ip, 1024 + {e} % 40000 AS src_port,
  concat('172.16.0.', CAST({e} % 4 AS STRING)) AS dst_ip,
  CASE event_type WHEN 'error' THEN 445 WHEN 'signup' THEN 53 WHEN 'purchase' THEN 443 WHEN 'click' THEN 80 ELSE 22 END AS dst_port,
  CASE WHEN event_type = 'signup' THEN CASE WHEN {e} % 2 = 0 THEN 'DNS' ELSE 'UDP' END ELSE 'TCP' END AS protocol,
  CASE WHEN {e} % 3 = 0 THEN 'inbound' ELSE 'outbound' END AS direction,
  CASE WHEN {e} % 13 = 0 THEN 0 ELSE CAST(FLOOR(value * 100) AS BIGINT) END AS bytes_sent,
  CASE WHEN {e} % 13 = 0 THEN 0 ELSE CAST(FLOOR(value * 10) AS BIGINT) END AS bytes_received,
  CASE WHEN {e} % 13 = 0 THEN 0 ELSE {e} % 3000 END AS duration_ms,
  CASE WHEN event_type = 'signup' THEN concat(CASE WHEN {e} % 5 < 2 THEN repeat('a', 130) ELSE 'www' END, '.example.test') ELSE '' END AS dns_query,
  {_pick('user_id', ['US', 'DE', 'IN', 'BR', 'JP', 'FR', 'GB'])} AS geo_country,
  CASE WHEN {e} % 50 = 0 THEN 1 ELSE 0 END AS is_suspicious,
  CASE {e} % 17 WHEN 0 THEN 'login attempt fail' WHEN 1 THEN 'IPS exploit signature' WHEN 2 THEN concat('snmp sweep ', CAST(user_id % 9 AS STRING))
    WHEN 3 THEN CASE WHEN {e} % 5 = 0 THEN 'bgp peer update' ELSE '' END WHEN 4 THEN CASE WHEN {e} % 7 = 0 THEN 'acl deny' ELSE '' END ELSE '' END AS detection_rule,
  {_pick(e, MESSAGES)} AS message
FROM events""",
        "fx_process": f"""
SELECT {e}, {d.ts('ts')} AS timestamp, concat('host-', CAST(user_id % 22 AS STRING)) AS hostname,
  {e} % 65000 AS pid, {e} % 977 AS ppid, user_id AS uid, user_id % 10 AS gid,
  {win(_pick(e, BINARIES))} AS binary_path, {_pick(e, ARGUMENTS)} AS arguments,
  {win(_pick(e, PARENTS))} AS parent_binary, concat('ctr-', CAST(user_id % 5 AS STRING)) AS container_id,
  CASE WHEN {e} % 200 = 0 THEN 1 ELSE 0 END AS is_suspicious
FROM events""",
        "fx_raw": f"""
SELECT {e}, {d.ts('ts')} AS timestamp,
  {_pick(e, ['INFO', 'WARNING', 'ERROR', 'CRITICAL', 'DEBUG', 'INFO', 'INFO'])} AS level,
  {_pick(f'{e} + user_id', ['nginx', 'sshd', 'kernel', 'postgres', 'cron', 'firewall', 'dns', 'kubernetes', 'syslog'])} AS source,
  {_pick(e, MESSAGES)} AS message,
  CASE WHEN user_id % 11 = 0 THEN '' ELSE concat('u', CAST(user_id AS STRING)) END AS user_id,
  concat('10.0.', CAST(user_id % 4 AS STRING), '.', CAST(user_id % 250 AS STRING)) AS ip_address,
  concat('req-', CAST({e} % 1000 AS STRING)) AS request_id
FROM events""",
        "fx_messages": f"""
SELECT {e}, 'raw-logs' AS topic, {e} % 12 AS part, {d.div(e, 12)} AS pos, {d.ts('ts')} AS ingest_ts,
  CASE WHEN {e} % 97 = 0 THEN concat('not json ', CAST({e} AS STRING)) ELSE concat('{{"seq":', CAST({e} AS STRING),
    CASE WHEN {e} % 10 = 0 THEN ',"timestamp":"yesterday"' WHEN {e} % 10 = 1 THEN '' ELSE concat(',"timestamp":"', replace(CAST({d.ts('ts')} AS STRING), ' ', 'T'), 'Z"') END,
    ',"source_type":"', {_pick(e, ['syslog', 'file', 'http_json', 'journald', 'docker_logs'])}, '"',
    CASE {e} % 5 WHEN 0 THEN concat(',"hostname":"h', CAST(user_id % 22 AS STRING), '"') WHEN 1 THEN ',"host":"alias-host"' WHEN 2 THEN ',"container_name":"ctr-7"' WHEN 3 THEN ',"_HOSTNAME":"journal-host"' ELSE '' END,
    CASE {e} % 11 WHEN 0 THEN ',"level":"err"' WHEN 1 THEN ',"level":"Warn"' WHEN 2 THEN ',"severity":"3"' WHEN 3 THEN ',"priority":"6"' WHEN 4 THEN ',"level":"emergency"' WHEN 5 THEN ',"level":"DEBUG"' WHEN 6 THEN ',"PRIORITY":"7"' WHEN 7 THEN ',"level":"2"' WHEN 8 THEN ',"level":"notice"' WHEN 9 THEN ',"priority":"4"' ELSE '' END,
    CASE {e} % 6 WHEN 0 THEN ',"appname":"sshd"' WHEN 1 THEN ',"_SYSTEMD_UNIT":"cron.service"' WHEN 2 THEN ',"source":"edge"' ELSE '' END,
    CASE WHEN {e} % 29 = 0 THEN ',"attack_cat":"Exploits"' WHEN {e} % 29 = 1 THEN ',"attack_cat":"Normal"' WHEN {e} % 29 = 2 THEN ',"Label":"DDoS","attack_type":"Flood"' WHEN {e} % 29 = 3 THEN ',"label":"benign"' WHEN {e} % 29 = 4 THEN ',"label":"1"' ELSE '' END,
    CASE WHEN {e} % 7 = 0 THEN concat(',"pid":"', CAST({e} % 30000 AS STRING), '","exe":"/usr/sbin/cron","cmdline":"cron -f","uid":"', CAST(user_id AS STRING), '"') WHEN {e} % 7 = 1 THEN ',"PID":"abc","COMM":"bash"' ELSE '' END,
    CASE WHEN {e} % 8 = 0 THEN concat(',"src_ip":"10.0.0.', CAST(user_id % 8 AS STRING), '","dest_ip":"172.16.0.9","source_port":"70000","dest_port":"', CAST({e} % 9000 AS STRING), '","proto":"udp","bytes_out":"', CAST(user_id AS STRING), '","duration":"17"')
         WHEN {e} % 8 = 1 THEN ',"source_ip":"not-an-ip","destination_ip":"8.8.8.8","server_port":"53","query":"example.test"' ELSE '' END,
    CASE WHEN {e} % 31 = 0 THEN ',"event_type_hint":"network"' WHEN {e} % 31 = 1 THEN ',"event_type_hint":"process"' WHEN {e} % 31 = 2 THEN ',"event_type_hint":"other"' ELSE '' END,
    CASE WHEN user_id % 3 = 0 THEN concat(',"user_id":"u', CAST(user_id AS STRING), '"') ELSE '' END,
    ',"message":"', CASE WHEN {e} % 19 = 0 THEN concat('{{', {bs}, '"hostname', {bs}, '":', {bs}, '"inner-host', {bs}, '",', {bs}, '"level', {bs}, '":', {bs}, '"ERROR', {bs}, '"}}') ELSE {_pick(e, MESSAGES)} END, '"}}') END AS value
FROM events""",
        "fx_winlog": f"""
SELECT {e}, {d.ts('ts')} AS timestamp,
  CASE {e} % 3 WHEN 0 THEN 'sysmon' WHEN 1 THEN 'security' ELSE 'powershell' END AS channel,
  CASE {e} % 3 WHEN 0 THEN CASE {d.div(e, 3)} % {len(SYSMON_IDS)} {ids(SYSMON_IDS)} END
    WHEN 1 THEN CASE {d.div(e, 3)} % {len(SECURITY_IDS)} {ids(SECURITY_IDS)} END
    ELSE CASE {d.div(e, 3)} % {len(POWERSHELL_IDS)} {ids(POWERSHELL_IDS)} END END AS eid,
  concat('WIN-', CAST(user_id % 22 AS STRING)) AS computer,
  concat('{{"Image":"', {js(_pick(e, BINARIES))}, '","CommandLine":"', {_pick(e, ARGUMENTS)}, '","ParentImage":"', {js(_pick(e, PARENTS))},
    '","ProcessId":"', CAST({e} % 65000 AS STRING), '","ParentProcessId":"', CAST({e} % 977 AS STRING),
    '","User":"u', CAST(user_id AS STRING), '","Signed":"', CASE WHEN {e} % 2 = 0 THEN 'false' ELSE 'true' END,
    '","TargetImage":"', {js(_pick(e, ['C:~Windows~lsass.exe', 'C:~Windows~notepad.exe']))}, '","SourceImage":"', {js(_pick(e, BINARIES))},
    '","TargetObject":"', {js(_pick(d.div(e, 3), REGISTRY))}, '","PipeName":"', {js(_pick(d.div(e, 3), PIPES))},
    '","SourceIp":"10.0.0.', CAST(user_id % 8 AS STRING), '","DestinationIp":"8.8.4.4","DestinationPort":"', CAST({e} % 9000 AS STRING),
    '","Protocol":"tcp","Initiated":"', CASE WHEN {e} % 4 = 0 THEN 'false' ELSE 'true' END,
    '","QueryName":"q', CAST({e} % 50 AS STRING), '.example.test","TargetUserName":"t', CAST(user_id % 40 AS STRING), '","SubjectUserName":"s', CAST(user_id % 30 AS STRING),
    '","IpAddress":"192.0.2.', CAST(user_id % 200 AS STRING), '","LogonType":"', CAST({e} % 11 AS STRING), '","ScriptBlockText":"', {js(_pick(e, SCRIPTS))}, '"}}') AS event_data
FROM events""",
    }
    tables["fx_scores"] = f"""
SELECT {e}, timestamp, hostname, src_ip AS source_ip, dst_ip, user_id,
  {_pick(f'{e} + dst_port', ['syslog', 'windows_event', 'firewall', 'dns', 'netflow', 'custom-app'])} AS source_type,
  concat('T', CAST({e} % {len(MESSAGES)} AS STRING)) AS template_id, message,
  CAST(({e} * 37) % 100 AS DOUBLE) / 100 AS template_rarity,
  CASE WHEN {e} % 9 < 2 THEN 0.8 + CAST(({e} * 7919) % 200 AS DOUBLE) / 1000 ELSE CAST(({e} * 7919) % 1000 AS DOUBLE) / 1000 END AS lgbm_score,
  CASE WHEN {e} % 9 = 0 THEN 0.7 + CAST(({e} * 104729) % 300 AS DOUBLE) / 1000 ELSE CAST(({e} * 104729) % 1000 AS DOUBLE) / 1000 END AS eif_score,
  CASE WHEN {e} % 9 < 2 THEN 0.6 + CAST(({e} * 1299709) % 400 AS DOUBLE) / 1000 ELSE CAST(({e} * 1299709) % 1000 AS DOUBLE) / 1000 END AS arf_score,
  CASE WHEN dst_port = 445 THEN 'lateral-movement' WHEN dst_port = 53 THEN 'command-and-control' WHEN dst_port = 443 THEN 'exfiltration' ELSE '' END AS mitre_tactic,
  CASE WHEN dst_port = 445 THEN 'T1021' WHEN dst_port = 53 THEN 'T1071' WHEN dst_port = 443 THEN 'T1041' ELSE '' END AS mitre_technique
FROM fx_network"""
    tables["fx_anchors"] = """
SELECT concat('BATCH-', CASE WHEN o_orderkey % 2 = 0 THEN 'raw_logs' ELSE 'security_events' END, '-', CAST(o_orderkey AS STRING)) AS batch_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'raw_logs' ELSE 'security_events' END AS table_name, CAST(o_orderdate AS TIMESTAMP) AS time_from,
  1 + o_custkey % 500 AS event_count, CASE WHEN o_orderstatus = 'F' THEN 'Verified' ELSE 'Anchored' END AS status,
  concat('merkle-proofs/', CAST(o_orderkey AS STRING), '.json') AS s3_key
FROM orders"""
    # dimension tables, derived from the given ones
    tables["fx_thresholds"] = """
SELECT source_type, CAST(suspicious AS DOUBLE) AS suspicious_threshold, CAST(anomalous AS DOUBLE) AS anomalous_threshold, version
FROM (VALUES ('syslog', 0.65, 0.85, 1), ('syslog', 0.60, 0.82, 2), ('windows_event', 0.70, 0.90, 1), ('firewall', 0.60, 0.80, 1),
  ('dns', 0.68, 0.87, 1), ('netflow', 0.65, 0.85, 1), ('kubernetes', 0.75, 0.92, 1)) AS t(source_type, suspicious, anomalous, version)"""
    tables["fx_assets"] = """
SELECT DISTINCT concat('host-', CAST(c_nationkey % 22 AS STRING)) AS hostname_pattern,
  CAST(1 + (c_nationkey % 5) AS DOUBLE) / 4 + 0.75 AS multiplier FROM customer WHERE c_nationkey < 8
UNION ALL SELECT 'HOST-1%' AS hostname_pattern, CAST(1.2 AS DOUBLE) AS multiplier
UNION ALL SELECT 'host-_' AS hostname_pattern, CAST(1.1 AS DOUBLE) AS multiplier"""
    tables["fx_iocs"] = f"""
SELECT DISTINCT 'ip' AS ioc_type, concat('10.0.0.', CAST(s_nationkey % 25 AS STRING)) AS ioc_value,
  40 + s_nationkey AS confidence, CASE WHEN s_nationkey % 3 = 0 THEN TIMESTAMP '2024-01-10 00:00:00' ELSE TIMESTAMP '2024-06-01 00:00:00' END AS expires_at
FROM supplier WHERE s_nationkey < 6
UNION ALL SELECT 'ip', '172.16.0.3', 90, TIMESTAMP '2024-06-01 00:00:00'
UNION ALL SELECT 'domain', 'www.example.test', 60, TIMESTAMP '2024-06-01 00:00:00'"""
    tables["fx_allowlist"] = """
SELECT entry_type, entry_value, active, CAST(expires_at AS TIMESTAMP) AS expires_at
FROM (VALUES ('host', 'host-7', 1, NULL), ('user', 'u21', 1, NULL), ('template', 'T3', 1, '2024-06-01 00:00:00'),
  ('ip', '10.0.0.6', 0, NULL), ('source', 'custom-app', 1, '2024-01-02 00:00:00')) AS t(entry_type, entry_value, active, expires_at)"""
    return tables


BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


# Views whose rows are parsed and matched against many patterns.
HEAVY = {"fx_messages", "fx_winlog"}


class Tables:
    """The given tables and the views over them, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._texts = spark, sf_dir.rstrip("/"), view_sql("spark")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table for work that is heavy per row."""
        return self.dealt(self.base(name))

    def dealt(self, df: DataFrame) -> DataFrame:
        """Rows dealt out when the files give fewer splits than there are cores; large inputs have enough splits and stay."""
        cores = self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)

    def view(self, name: str) -> DataFrame:
        """One fixture view; the names it reads are bound to this folder's tables."""
        import re

        sql = self._texts[name]
        used = {n for n in re.findall(r"\b\w+\b", sql) if n in BASE_TABLES or (n in self._texts and n != name)}
        read = self.spread if name in HEAVY else self.base
        frames = {n: read(n) if n in BASE_TABLES else self.view(n) for n in used}
        return _bind(self.spark, sql, frames)

    security = cached_property(lambda self: self.view("fx_security"))
    network = cached_property(lambda self: self.view("fx_network"))
    process = cached_property(lambda self: self.view("fx_process"))
    raw = cached_property(lambda self: self.view("fx_raw"))
    messages = cached_property(lambda self: self.view("fx_messages"))
    winlog = cached_property(lambda self: self.view("fx_winlog"))
    scores = cached_property(lambda self: self.view("fx_scores"))
    anchors = cached_property(lambda self: self.view("fx_anchors"))
    thresholds = cached_property(lambda self: self.view("fx_thresholds"))
    assets = cached_property(lambda self: self.view("fx_assets"))
    iocs = cached_property(lambda self: self.view("fx_iocs"))
    allowlist = cached_property(lambda self: self.view("fx_allowlist"))


def _bind(spark: SparkSession, sql: str, frames: dict[str, DataFrame]) -> DataFrame:
    """Run ``sql`` with frames in place of table names, without leaving names in the catalog."""
    import re
    import uuid

    tag = uuid.uuid4().hex[:8]
    for name, frame in frames.items():
        bound = f"_{name}_{tag}"
        frame.createOrReplaceTempView(bound)
        sql = re.sub(rf"\bFROM {name}\b", f"FROM {bound}", sql)
    try:
        return spark.sql(sql)
    finally:
        for name in frames:
            spark.catalog.dropTempView(f"_{name}_{tag}")
