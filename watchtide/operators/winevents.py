"""Windows event channels: process monitoring, security log and script logging.

Every event id is one line of a table: type, category, severity, tactic, technique and
the text shown to an analyst. ``{Name}`` is a field of the event data.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from watchtide.functions.expr import computed, contains_any, first_case, lookup

# Fixed values: (type, category, severity, tactic, technique, text) per event id.
SYSMON = {
    1: ("process", None, None, None, None, "Process created: {Image} {CommandLine} (PID:{ProcessId=0} PPID:{ParentProcessId=0} Parent:{ParentImage} User:{User})"),
    2: ("security", "defense-evasion", 3, "defense-evasion", "T1070.006", "File creation time modified: {TargetFilename} by {Image} (previous: {PreviousCreationUtcTime} new: {CreationUtcTime})"),
    3: ("network", None, None, None, None, "{Image} {SourceIp=0.0.0.0}:{SourcePort=0} -> {DestinationIp=0.0.0.0}:{DestinationPort=0} {PROTOCOL}"),
    5: ("process", None, None, None, None, "Process terminated: {Image} (PID:{ProcessId=0})"),
    6: ("security", "persistence", 2, "persistence", "T1547.006", "Driver loaded: {ImageLoaded} (Signed:{Signed=true} Signature:{Signature} Hash:{Hashes})"),
    7: ("process", None, None, None, None, "{Image} loaded DLL: {ImageLoaded} (Signed:{Signed=true})"),
    8: ("security", "defense-evasion", 4, "defense-evasion", "T1055", "Remote thread injection: {SourceImage} -> {TargetImage} (SourcePID:{SourceProcessId} TargetPID:{TargetProcessId} StartAddress:{StartAddress})"),
    9: ("security", "credential-access", 3, "credential-access", "T1003", "Raw disk access: {Image} reading {Device} (PID:{ProcessId})"),
    10: ("security", "credential-access", 4, "credential-access", "T1003.001", "Process access: {SourceImage} -> {TargetImage} (GrantedAccess:{GrantedAccess} CallTrace:{CallTrace})"),
    11: ("raw", None, None, None, None, "File created: {TargetFilename} by {Image} (PID:{ProcessId})"),
    12: ("security", "persistence", 3, "persistence", "T1547.001", "Registry CreateKey/DeleteKey: {TargetObject} by {Image}"),
    13: ("security", "persistence", 3, "persistence", "T1547.001", "Registry SetValue: {TargetObject} by {Image}"),
    14: ("security", "persistence", 3, "persistence", "T1547.001", "Registry RenameKey: {TargetObject} by {Image}"),
    15: ("security", "defense-evasion", 3, "defense-evasion", "T1564.004", "Alternate Data Stream: {TargetFilename} by {Image} Hash:{Hash}"),
    17: ("raw", None, None, None, None, "Named pipe created: {PipeName} by {Image} (PID:{ProcessId})"),
    18: ("raw", None, None, None, None, "Named pipe connected: {PipeName} by {Image} (PID:{ProcessId})"),
    22: ("network", None, None, None, None, "{Image} DNS query: {QueryName} (status:{QueryStatus=0} result:{QueryResults=0.0.0.0})"),
    23: ("raw", None, None, None, None, "File deleted [archived]: {TargetFilename} by {Image} (PID:{ProcessId} Hash:{Hashes})"),
    24: ("security", "collection", 3, "collection", "T1115", "Clipboard accessed by: {Image} (PID:{ProcessId})"),
    25: ("security", "defense-evasion", 4, "defense-evasion", "T1055.012", "Process tampering detected ({Type=Unknown}): {Image} (PID:{ProcessId})"),
    26: ("raw", None, None, None, None, "File deleted: {TargetFilename} by {Image} (PID:{ProcessId} Hash:{Hashes})"),
}
SECURITY = {
    4624: ("security", "auth", 1, "initial-access", "T1078", "Logon success: {TargetUserName} (LogonType:{LogonType=?} IP:{IpAddress=0.0.0.0} Domain:{TargetDomainName})"),
    4625: ("security", "auth", 3, "credential-access", "T1110", "Logon failure: {TargetUserName} (IP:{IpAddress=0.0.0.0} Reason:{FailureReason|Status=unknown} SubStatus:{SubStatus})"),
    4648: ("security", "credential-access", 2, "credential-access", "T1078.002", "Explicit credential logon: {SubjectUserName} -> {TargetUserName}@{TargetServerName} via {ProcessName}"),
    4672: ("security", "privilege-escalation", 2, "privilege-escalation", "T1134", "Special privileges assigned to: {SubjectUserName} (Privileges:{PrivilegeList})"),
    4688: ("process", None, None, None, None, "Process created (4688): {NewProcessName} {CommandLine}"),
    4720: ("security", "persistence", 3, "persistence", "T1136.001", "Account created: {TargetUserName} by {SubjectUserName}"),
    4726: ("security", "persistence", 3, "persistence", "T1136.001", "Account deleted: {TargetUserName} by {SubjectUserName}"),
    4732: ("security", "privilege-escalation", 3, "privilege-escalation", "T1098", "User {MemberName|MemberSid} added to group: {TargetUserName} by {SubjectUserName}"),
    4733: ("security", "privilege-escalation", 3, "privilege-escalation", "T1098", "User {MemberName|MemberSid} removed from group: {TargetUserName} by {SubjectUserName}"),
    1102: ("security", "defense-evasion", 4, "defense-evasion", "T1070.001", "Security audit log cleared by {SubjectUserName=SYSTEM}"),
}
# Registry parts, in order, with (severity, tactic, technique) they change.
REGISTRY_RULES = [
    (["\\run", "\\runonce"], 4, None, "T1547.001"),
    (["\\services\\"], None, None, "T1543.003"),
    (["\\schedule\\taskcache"], None, None, "T1053.005"),
    (["\\image file execution"], 4, "defense-evasion", "T1546.012"),
    (["\\windows defender"], 4, "defense-evasion", "T1562.001"),
]
MALICIOUS_PIPES = ["\\msse-", "\\psexesvc", "\\msagent_", "\\postex_"]
# Script patterns in order with their technique; a list inside means all of them.
SCRIPT_RULES = [
    (["invoke-mimikatz", "sekurlsa"], "T1003.001"),
    (["invoke-expression", "iex(", "iex ("], "T1059.001"),
    (["downloadstring", "downloadfile", "webclient", "invoke-webrequest"], "T1105"),
    (["-enc", "encodedcommand", "frombase64"], "T1059.001"),
    ([["bypass", "executionpolicy"]], "T1562.001"),
    ([["add-type", "dllimport"]], "T1106"),
    (["invoke-shellcode", "virtualalloc", "createthread"], "T1055"),
]
# Fixed values of the suspicious-process rules.
LOLBINS = ["certutil", "mshta", "regsvr32", "rundll32", "wscript", "cscript", "msbuild", "installutil", "regasm", "regsvcs", "eventvwr", "fodhelper", "cmstp", "msconfig", "dfsvc", "ieexec", "control", "pcalua", "forfiles", "bash", "wsl", "bitsadmin", "xwizard"]
SHELL_FLAGS = ["-enc", "-encodedcommand", "hidden", "-nop", "bypass"]
RECON = ["whoami", "net user", "net group", "net localgroup", "ipconfig", "systeminfo", "tasklist", "netstat", "nltest", "dsquery", "arp -a", "nslookup", "net share", "qprocess", "quser"]
OFFICE = ["winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe"]
SPAWNED = ["cmd.exe", "powershell.exe", "wscript.exe", "cscript.exe", "mshta.exe"]
DROP_FOLDERS = ["\\temp\\", "\\tmp\\", "\\downloads\\", "\\users\\public\\"]
TAGS = ["event_type", "category", "severity", "mitre_tactic", "mitre_technique"]


def data(name: str, default: str = "") -> Column:
    """Field of the event data; ``a|b`` takes the first present."""
    return F.coalesce(*[F.try_element_at("data", F.lit(n)) for n in name.split("|")], F.lit(default))


def data_int(name: str) -> Column:
    return F.coalesce(data(name).try_cast("int"), F.lit(0))


def fill(template: str) -> Column:
    """Text with fields put in."""
    parts = []
    for piece in re.split(r"(\{[^}]*\})", template):
        if piece == "{PROTOCOL}":
            parts.append(F.upper(data("Protocol", "TCP")))
        elif piece.startswith("{"):
            name, _, default = piece[1:-1].partition("=")
            parts.append(data(name, default))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def _tagged(df: DataFrame, rules: dict, unknown: str) -> DataFrame:
    """Tags and text of each event id; unknown ids stay raw with their data as text."""
    eid = F.col("eid")
    table = {k: v[:5] for k, v in rules.items()}
    kinds = dict(zip(TAGS, ["string", "string", "int", "string", "string"]))
    out = {}
    for i, (name, kind) in enumerate(kinds.items()):
        known = {k: v[i] for k, v in table.items() if v[i] is not None}
        out[name] = lookup(eid, known).cast(kind)
    text = first_case([(eid == k, fill(v[5])) for k, v in rules.items()], F.concat(F.lit(unknown), eid.cast("string"), F.lit(": "), F.to_json("data")))
    return computed(df, {**out, "event_type": F.coalesce(out["event_type"], F.lit("raw")), "message": text})


def parse_event_data(df: DataFrame) -> DataFrame:
    empty = F.create_map().cast("map<string,string>")
    return computed(df, {"data": F.coalesce(F.from_json("event_data", "map<string,string>"), empty)})


def sysmon_events(df: DataFrame) -> DataFrame:
    """Process-monitor events with type-specific columns; needs eid, computer, event_data."""
    df = _tagged(parse_event_data(df), SYSMON, "Sysmon EventID ")
    eid, target, pipe = F.col("eid"), F.lower(data("TargetObject")), F.lower(data("PipeName"))
    unsigned = F.lower(data("Signed", "true")) == "false"
    registry, piped = eid.isin(12, 13, 14), eid.isin(17, 18) & contains_any(pipe, MALICIOUS_PIPES)
    dump = (eid == 10) & F.lower(data("TargetImage")).contains("lsass")

    def refined(i, base):
        hits = [(contains_any(target, words), F.lit(rule[i]) if rule[i] is not None else F.col(base)) for words, *rule in REGISTRY_RULES]
        return F.when(registry, first_case(hits, F.col(base)))

    pipe_text = F.concat(F.lit("Suspicious named pipe "), F.when(eid == 17, "created").otherwise("connected"), F.lit(": "), data("PipeName"), F.lit(" by "), data("Image"))
    is_process = F.col("event_type") == "process"
    is_flow = F.col("event_type") == "network"
    dns = eid == 22
    df = computed(
        df,
        {
            "event_type": F.when(piped, "security").otherwise(F.col("event_type")),
            "category": F.when(piped, "command-and-control").otherwise(F.col("category")),
            "severity": F.when(piped, 4).when((eid == 6) & unsigned, 4).when(registry, refined(0, "severity")).otherwise(F.col("severity")),
            "mitre_tactic": F.when(piped, "command-and-control").when(registry, refined(1, "mitre_tactic")).otherwise(F.col("mitre_tactic")),
            "mitre_technique": F.when(piped, "T1570").when(registry, refined(2, "mitre_technique")).otherwise(F.col("mitre_technique")),
            "message": F.when(piped, pipe_text).when(dump, fill("LSASS credential dump attempt: {SourceImage} accessed lsass.exe (GrantedAccess:{GrantedAccess})")).otherwise(F.col("message")),
            "level": F.when(eid.isin(17, 18, 23, 26), "WARNING").otherwise("INFO"),
            "source": F.lit("sysmon"),
            "hostname": F.coalesce("computer", F.lit("")),
            "pid": F.when(is_process | is_flow, data_int("ProcessId")),
            "ppid": F.when(eid == 1, data_int("ParentProcessId")).when(is_process, 0),
            "binary_path": F.when(is_process | is_flow, data("Image")),
            "parent_binary": F.when(eid == 1, data("ParentImage")),
            "arguments": F.when(eid == 1, data("CommandLine")).when(eid == 7, F.concat(F.lit("DLL_LOAD:"), data("ImageLoaded"))).when(is_process, ""),
            "exit_code": F.when(eid == 5, 0).when(is_process, -1),
            "syscall": F.when(eid == 1, "CreateProcess").when(eid == 5, "TerminateProcess").when(eid == 7, "LoadLibrary"),
            "src_ip": F.when(dns, "0.0.0.0").when(is_flow, data("SourceIp", "0.0.0.0")),
            "dst_ip": F.when(dns, data("QueryResults", "0.0.0.0")).when(is_flow, data("DestinationIp", "0.0.0.0")),
            "src_port": F.when(dns, 0).when(is_flow, data_int("SourcePort")),
            "dst_port": F.when(dns, 53).when(is_flow, data_int("DestinationPort")),
            "protocol": F.when(dns, "DNS").when(is_flow, F.upper(data("Protocol", "TCP"))),
            "direction": F.when(dns, "outbound").when(is_flow, F.when(F.lower(data("Initiated", "true")).isin("false", "0", "no"), "inbound").otherwise("outbound")),
            "dns_query": F.when(dns, data("QueryName")),
            "is_suspicious": F.when((eid == 7) & unsigned, 1).otherwise(0),
            "detection_rule": F.when((eid == 7) & unsigned, "unsigned_dll_load").otherwise(""),
            "user_id": F.when(eid.isin(1, 3, 5), data("User")).otherwise(""),
        },
    )
    return df


def windows_security_events(df: DataFrame) -> DataFrame:
    df = _tagged(parse_event_data(df), SECURITY, "Windows Security EventID ")
    eid = F.col("eid")
    new = eid == 4688
    return df.withColumns(
        {
            "source": F.lit("windows-security"), "hostname": F.coalesce("computer", F.lit("")), "level": F.lit("INFO"),
            "user_id": F.when(eid.isin(4624, 4625), data("TargetUserName")).when(eid.isin(4648, 4672, 4688, 4720, 4726, 4732, 4733), data("SubjectUserName")).otherwise(""),
            "ip_address": F.when(eid.isin(4624, 4625), data("IpAddress", "0.0.0.0")).otherwise("0.0.0.0"),
            "pid": F.when(new, data_int("NewProcessId")), "ppid": F.when(new, data_int("ProcessId")), "binary_path": F.when(new, data("NewProcessName")),
            "arguments": F.when(new, data("CommandLine")), "syscall": F.when(new, "CreateProcess"),
        }
    )


def powershell_events(df: DataFrame) -> DataFrame:
    df = parse_event_data(df)
    eid, script = F.col("eid"), F.lower(data("ScriptBlockText"))

    def hit(words):
        cond = F.lit(False)
        for w in words:
            every = F.lit(True)
            for part in w if isinstance(w, list) else [w]:
                every = every & script.contains(part)
            cond = cond | every
        return cond

    technique = F.when(eid == 4104, first_case([(hit(words), F.lit(t)) for words, t in SCRIPT_RULES]))
    bad = F.col("mitre_technique").isNotNull()
    text = (
        F.when(eid == 4104, fill("PowerShell script block: {ScriptBlockText}"))
        .when(eid == 4103, F.concat(F.lit("PowerShell module: "), F.coalesce(F.try_element_at("data", F.lit("Payload")), F.to_json("data"))))
        .otherwise(F.concat(F.lit("PowerShell EventID "), eid.cast("string"), F.lit(": "), F.to_json("data")))
    )
    return df.withColumn("mitre_technique", technique).withColumns(
        {
            "event_type": F.when(bad, "security").otherwise("raw"), "category": F.when(bad, "execution"), "severity": F.when(bad, 4),
            "mitre_tactic": F.when(bad, "execution"), "message": text, "source": F.lit("powershell"), "hostname": F.coalesce("computer", F.lit("")), "level": F.lit("INFO"),
        }
    )


def process_rules(binary="binary_path", arguments="arguments", parent="parent_binary") -> Column:
    """Names of the rules a process start matches, in rule order."""
    b, a, p = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in (binary, arguments, parent))
    ends = lambda c, names: F.coalesce(*[F.when(c.endswith(n), True) for n in names], F.lit(False))
    rules = [(b.endswith(f"{n}.exe"), f"lolbin_{n}") for n in LOLBINS]
    rules.append((ends(b, ["powershell.exe", "pwsh.exe"]) & contains_any(a, SHELL_FLAGS), "suspicious_powershell"))
    rules += [(a.contains(w), "recon_" + w.replace(" ", "_").replace("-", "")) for w in RECON]
    rules.append((contains_any(b, ["mimikatz", "procdump", "lazagne"]) | a.contains("sekurlsa") | (b.contains("rundll32") & a.contains("comsvcs.dll")), "credential_dumping"))
    rules.append((ends(p, OFFICE) & ends(b, SPAWNED), "office_macro_spawn"))
    rules.append((contains_any(b, DROP_FOLDERS), "exec_from_suspicious_path"))
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))


def suspicious_process(df: DataFrame, **columns: str) -> DataFrame:
    """The last matching rule names the detection."""
    df = computed(df, {"_rules": process_rules(**columns)})
    last = F.coalesce(F.try_element_at("_rules", F.lit(-1)), F.lit(""))
    return df.withColumns({"is_suspicious": (F.size("_rules") > 0).cast("int"), "detection_rule": last}).drop("_rules")


def windows_events(df: DataFrame) -> DataFrame:
    """All channels with one output schema, routed by the ``channel`` column."""
    sysmon = sysmon_events(df.where("channel = 'sysmon'"))
    started = (F.col("eid") == 1) & (F.col("event_type") == "process")
    scored = suspicious_process(sysmon.where(started)).unionByName(sysmon.where(~started))
    parts = [scored, windows_security_events(df.where("channel = 'security'")), powershell_events(df.where("channel = 'powershell'"))]
    out = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return out.withColumn("is_suspicious", F.coalesce("is_suspicious", F.lit(0))).drop("data")
