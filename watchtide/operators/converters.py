"""Public intrusion and log datasets to feature rows and to events.

A harmoniser is a function from the dataset's DataFrame to the 20 features, ``label``,
``attack_type`` and ``source_dataset``. Values a dataset does not have (hour, severity)
come from a hash of the row when ``noise`` is on, else from a fixed middle value, so no
feature depends on the label.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from watchtide.functions.expr import clamp, contains_any, first_case, lookup
from watchtide.operators.triage import BYTES_MAX, FEATURES, PROTOCOLS

UNIT_FEATURES = ["same_srv_rate", "diff_srv_rate", "serror_rate", "rerror_rate", "template_rarity"]
HARMONIZERS: dict[str, Callable[[DataFrame, bool], DataFrame]] = {}
CONVERTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_converter(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    CONVERTERS[name] = fn


def num(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """Numeric column; text, NaN, infinity and a missing column give the default."""
    if name not in df.columns:
        return F.lit(float(default))
    c = F.col(f"`{name}`").try_cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), float(default)).otherwise(c)


def text(df: DataFrame, *names: str, default: str = "") -> Column:
    found = [F.col(f"`{n}`").cast("string") for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(default))


def _spread(df: DataFrame, salt: int) -> Column:
    """Number in [0, 1) that depends on the row only."""
    return F.pmod(F.xxhash64(F.lit(salt), *[F.col(f"`{c}`").cast("string") for c in df.columns]), F.lit(100_000)) / 100_000.0


def _frame(df: DataFrame, noise: bool, dataset: str, label: Column, attack: Column, **values: Column) -> DataFrame:
    spare = {
        "hour_of_day": F.floor(_spread(df, 1) * 24) if noise else F.lit(12.0), "day_of_week": F.floor(_spread(df, 2) * 7) if noise else F.lit(2.0), "protocol": F.lit(6.0), "template_rarity": F.lit(0.5),
    }
    cols = [(values.get(f, spare.get(f, F.lit(0.0)))).cast("double").alias(f) for f in FEATURES]
    return df.select(*cols, label.cast("int").alias("label"), attack.alias("attack_type"), F.lit(dataset).alias("source_dataset"))


def _vary(df: DataFrame, noise: bool, base, width: float, low: float, high: float, salt: int) -> Column:
    base = base if isinstance(base, Column) else F.lit(float(base))
    return clamp(base + (_spread(df, salt) - 0.5) * 2 * width, low, high) if noise else base


def _share(a: Column, b: Column) -> Column:
    return clamp(a / b, 0.0, 1.0)


def _harmonizer(name: str):
    def keep(fn):
        HARMONIZERS[name] = fn
        return fn

    return keep


def _protocol(c: Column) -> Column:
    return F.coalesce(lookup(F.lower(c), PROTOCOLS), F.lit(6))


@_harmonizer("cicids2017")
def _cicids(df: DataFrame, noise: bool = True) -> DataFrame:
    y = num(df, "binary_label").cast("int")
    fwd = F.greatest(num(df, "Total Fwd Packets", 1), F.lit(1.0))
    return _frame(
        df, noise, "cicids2017", y, F.when(y == 1, text(df, "attack_type", "Label", default="unknown")).otherwise("normal"), severity_numeric=_vary(df, noise, 1.0, 1.0, 0, 4, 3), source_type_numeric=F.lit(9.0),
        src_bytes=clamp(num(df, "Total Length of Fwd Packets"), 0.0, BYTES_MAX), dst_bytes=clamp(num(df, "Total Length of Bwd Packets"), 0.0, BYTES_MAX), event_freq_1m=clamp(num(df, "Flow Packets/s"), 0.0, 1e5),
        dst_port=clamp(num(df, "Destination Port"), 0.0, 65535.0), template_rarity=_vary(df, noise, 0.5, 0.2, 0, 1, 4), duration=clamp(num(df, "Flow Duration") / 1e6, 0.0, 1e6), same_srv_rate=_share(num(df, "Subflow Fwd Packets"), fwd),
        serror_rate=_share(num(df, "SYN Flag Count"), fwd), rerror_rate=_share(num(df, "RST Flag Count"), fwd), count=num(df, "Total Fwd Packets") + num(df, "Total Backward Packets"), srv_count=num(df, "Total Fwd Packets"),
        dst_host_count=F.lit(1.0), dst_host_srv_count=F.lit(1.0))


@_harmonizer("nsl_kdd")
def _nsl_kdd(df: DataFrame, noise: bool = True) -> DataFrame:
    y = num(df, "binary_label").cast("int")
    unit = {c: clamp(num(df, c), 0.0, 1.0) for c in ("same_srv_rate", "diff_srv_rate", "serror_rate", "rerror_rate")}
    return _frame(
        df, noise, "nsl_kdd", y, F.when(y == 1, text(df, "attack_type", default="unknown")).otherwise("normal"), severity_numeric=_vary(df, noise, 1.0, 1.0, 0, 4, 3), source_type_numeric=F.lit(10.0), src_bytes=clamp(num(df, "src_bytes"), 0.0, BYTES_MAX),
        dst_bytes=clamp(num(df, "dst_bytes"), 0.0, BYTES_MAX), event_freq_1m=num(df, "count"), protocol=_protocol(text(df, "protocol_type", default="tcp")), duration=num(df, "duration"), count=num(df, "count"), srv_count=num(df, "srv_count"),
        dst_host_count=num(df, "dst_host_count"), dst_host_srv_count=num(df, "dst_host_srv_count"), **unit)


@_harmonizer("unsw_nb15")
def _unsw(df: DataFrame, noise: bool = True) -> DataFrame:
    y = num(df, "binary_label" if "binary_label" in df.columns else "label").cast("int")
    per = F.greatest(num(df, "ct_srv_src"), F.lit(1.0))
    return _frame(
        df, noise, "unsw_nb15", y, F.when(y == 0, "normal").otherwise(text(df, "attack_type" if "attack_type" in df.columns else "attack_cat", default="unknown")), severity_numeric=_vary(df, noise, 1.0, 1.0, 0, 4, 3), source_type_numeric=F.lit(3.0),
        src_bytes=clamp(num(df, "sbytes"), 0.0, BYTES_MAX), dst_bytes=clamp(num(df, "dbytes"), 0.0, BYTES_MAX), event_freq_1m=per, protocol=_protocol(text(df, "proto", default="tcp")), dst_port=clamp(num(df, "dsport"), 0.0, 65535.0),
        duration=clamp(num(df, "dur"), 0.0, 1e9), same_srv_rate=_share(num(df, "ct_dst_ltm"), per), diff_srv_rate=_share(num(df, "ct_dst_sport_ltm"), per), count=per, srv_count=num(df, "ct_srv_dst"), dst_host_count=num(df, "ct_dst_ltm"), dst_host_srv_count=num(df, "ct_src_ltm"))


def _netflow(name: str):
    def run(df: DataFrame, noise: bool = True) -> DataFrame:
        attack = text(df, "Attack" if "Attack" in df.columns else "attack_type", default="unknown")
        benign = F.lower(attack).isin("benign", "normal", "0")
        y = F.when(benign, 0).otherwise(num(df, "binary_label" if "binary_label" in df.columns else "Label").cast("int"))
        ms = num(df, "FLOW_START_MILLISECONDS")
        at, known = F.timestamp_millis(ms.cast("bigint")), ms > 1e12
        return _frame(
            df, noise, name, y, F.when(benign, "normal").otherwise(attack), hour_of_day=F.when(known, F.hour(at)).otherwise(F.floor(_spread(df, 1) * 24) if noise else F.lit(12)), day_of_week=F.when(known, F.weekday(at)).otherwise(F.floor(_spread(df, 2) * 7) if noise else F.lit(2)),
            severity_numeric=_vary(df, noise, 1.0, 1.0, 0, 4, 3), source_type_numeric=F.lit(9.0), src_bytes=clamp(num(df, "IN_BYTES"), 0.0, BYTES_MAX), dst_bytes=clamp(num(df, "OUT_BYTES"), 0.0, BYTES_MAX), event_freq_1m=num(df, "IN_PKTS") + num(df, "OUT_PKTS"),
            protocol=num(df, "PROTOCOL"), dst_port=clamp(num(df, "L4_DST_PORT"), 0.0, 65535.0), template_rarity=_vary(df, noise, 0.5, 0.2, 0, 1, 4), duration=clamp(num(df, "FLOW_DURATION_MILLISECONDS") / 1000.0, 0.0, 1e6),
            count=num(df, "IN_PKTS"), srv_count=num(df, "OUT_PKTS"), dst_host_count=F.lit(1.0), dst_host_srv_count=F.lit(1.0))

    return run


HARMONIZERS["nf_unsw_nb15_v3"] = _netflow("nf_unsw_nb15_v3")
HARMONIZERS["nf_ton_iot"] = _netflow("nf_ton_iot")


@_harmonizer("csic2010")
def _csic(df: DataFrame, noise: bool = True) -> DataFrame:
    y, given = num(df, "classification").cast("int"), num(df, "lenght")  # the dataset spells it so
    size = F.when(given > 0, given).otherwise(F.length(text(df, "content")).cast("double"))
    return _frame(df, noise, "csic2010", y, F.when(y == 1, "web_attack").otherwise("normal"), source_type_numeric=F.lit(8.0), src_bytes=clamp(size, 0.0, BYTES_MAX), dst_port=F.lit(80.0), template_rarity=clamp(F.length(text(df, "URL")) / 200.0, 0.0, 1.0))


@_harmonizer("evtx")
def _evtx(df: DataFrame, noise: bool = True) -> DataFrame:
    port = F.when(num(df, "DestPort") > 0, num(df, "DestPort")).otherwise(num(df, "DestinationPort"))
    kind = F.concat(F.lit("evtx_"), F.regexp_replace(F.lower(text(df, "EVTX_Tactic", default="unknown")), " ", "_"))
    return _frame(df, noise, "evtx", F.lit(1), kind, severity_numeric=F.when(num(df, "EventID").isin(4625.0, 4771.0, 4776.0), 2.0).otherwise(0.0), source_type_numeric=F.lit(2.0), src_bytes=_vary(df, noise, 1050.0, 950.0, 100, 2000, 5),
                  dst_port=clamp(port, 0.0, 65535.0), template_rarity=_vary(df, noise, 0.4, 0.2, 0, 1, 4))


# Words that mark an attack line in the log datasets.
LINUX_ATTACK = ["authentication failure", "failed password", "invalid user", "failed login", "refused connect", "illegal user", "did not receive identification", "connection closed"]
SSH_ATTACK = ["invalid user", "failed password", "authentication failure", "failed publickey", "bad protocol", "did not receive identification", "connection closed", "refused connect", "illegal user", "reverse mapping checking"]
APACHE_ERROR = ["error", "failed", "denied", "not found", "timeout", "refused"]
APACHE_LEVELS = {"emerg": 4.0, "alert": 3.5, "crit": 3.0, "error": 2.5, "warn": 1.5, "notice": 0.5, "info": 0.0}


def _log_hour(df: DataFrame) -> Column:
    found = F.regexp_extract(text(df, "Time"), r"(\d+):", 1).try_cast("double")
    return F.coalesce(found, F.lit(12.0)) % 24


def _log_size(content: Column) -> Column:
    return clamp(F.length(content), 10, 5000)


@_harmonizer("loghub_linux")
def _linux(df: DataFrame, noise: bool = True) -> DataFrame:
    content, ssh = F.lower(text(df, "Content")), F.lower(text(df, "Component")).contains("ssh")
    bad = contains_any(content, LINUX_ATTACK)
    base = F.when(content.rlike("failure|failed"), 2.5).when(content.rlike("error|refused"), 1.5).otherwise(0.5)
    return _frame(df, noise, "loghub_linux", bad.cast("int"), F.when(bad & ssh, "ssh_brute_force").when(bad, "auth_failure").otherwise("normal"), hour_of_day=_log_hour(df), severity_numeric=_vary(df, noise, base, 1.0, 0, 4, 3),
                  source_type_numeric=F.lit(1.0), src_bytes=_log_size(content), dst_port=F.when(ssh, 22.0).otherwise(0.0), template_rarity=_vary(df, noise, 0.5, 0.3, 0, 1, 4))


@_harmonizer("loghub_apache")
def _apache(df: DataFrame, noise: bool = True) -> DataFrame:
    content, level = F.lower(text(df, "Content")), F.lower(text(df, "Level", default="notice"))
    bad = level.isin("error", "crit", "alert", "emerg") | contains_any(content, APACHE_ERROR)
    return _frame(df, noise, "loghub_apache", bad.cast("int"), F.when(bad, "web_error").otherwise("normal"), severity_numeric=_vary(df, noise, F.coalesce(lookup(level, APACHE_LEVELS), F.lit(0.5)), 0.6, 0, 4, 3), source_type_numeric=F.lit(8.0),
                  src_bytes=_log_size(content), dst_port=F.lit(80.0), template_rarity=_vary(df, noise, 0.5, 0.3, 0, 1, 4))


@_harmonizer("dns_exfil")
def _dns(df: DataFrame, noise: bool = True) -> DataFrame:
    y = num(df, "_label").cast("int")
    at = F.try_to_timestamp(text(df, "timestamp"))
    return _frame(
        df, noise, "dns_exfil", y, F.when(y == 1, "dns_exfiltration").otherwise("normal"), hour_of_day=F.coalesce(F.hour(at).cast("double"), F.floor(_spread(df, 1) * 24).cast("double") if noise else F.lit(12.0)),
        day_of_week=F.coalesce(F.weekday(at).cast("double"), F.floor(_spread(df, 2) * 7).cast("double") if noise else F.lit(2.0)), source_type_numeric=F.lit(5.0), src_bytes=clamp(num(df, "subdomain_length"), 0, 500), dst_bytes=clamp(num(df, "len"), 0, 1000),
        event_freq_1m=clamp(num(df, "FQDN_count", 1), 1, 10_000), protocol=F.lit(17.0), dst_port=F.lit(53.0), template_rarity=clamp(clamp(num(df, "entropy"), 0, 8) / 5.0, 0.0, 1.0), count=clamp(num(df, "labels", 1), 0, 50),
        srv_count=clamp(num(df, "numeric") + num(df, "special"), 0, 500), dst_host_count=F.lit(1.0), dst_host_srv_count=F.lit(1.0))


@_harmonizer("openssh")
def _openssh(df: DataFrame, noise: bool = True) -> DataFrame:
    content = F.lower(text(df, "Content"))
    bad = contains_any(content, SSH_ATTACK)
    base = F.when(content.rlike("failure|failed|invalid"), 2.5).when(content.rlike("refused|closed|bad protocol"), 1.5).when(content.rlike("accepted|session opened"), 0.0).otherwise(0.5)
    kind = F.when(bad & content.rlike("invalid user|illegal user"), "ssh_brute_force").when(bad, "ssh_auth_failure").otherwise("normal")
    return _frame(df, noise, "openssh", bad.cast("int"), kind, hour_of_day=_log_hour(df), severity_numeric=_vary(df, noise, base, 1.0, 0, 4, 3), source_type_numeric=F.lit(1.0), src_bytes=_log_size(content), dst_port=F.lit(22.0), template_rarity=_vary(df, noise, 0.5, 0.3, 0, 1, 4))


@_harmonizer("hdfs")
def _hdfs(df: DataFrame, noise: bool = True) -> DataFrame:
    y = F.lower(text(df, "Label", default="Normal")).isin("anomaly", "fail", "failure").cast("int")
    trace = text(df, "Features")
    events = clamp(F.size(F.split(trace, ",")), 1, 10_000)
    return _frame(df, noise, "hdfs", y, F.when(y == 1, "hdfs_anomaly").otherwise("normal"), source_type_numeric=F.lit(1.0), src_bytes=clamp(F.length(trace), 10, 5000), dst_port=F.lit(8020.0), template_rarity=clamp(events / 100.0, 0.0, 1.0), duration=clamp(num(df, "Latency"), 0.0, 1e9))


def dataset_to_features(df: DataFrame, name: str, noise: bool = True) -> DataFrame:
    return HARMONIZERS[name](df, noise)


def combine_datasets(frames: list[DataFrame]) -> DataFrame:
    """One validated table: numbers only, in range, with a label and an attack type."""
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f, allowMissingColumns=True)

    def clean(name: str) -> Column:
        c = num(df, name)
        if name in ("src_bytes", "dst_bytes"):
            return clamp(c, 0.0, BYTES_MAX)
        if name == "dst_port":
            return clamp(c, 0.0, 65535.0)
        return clamp(c, 0.0, 1.0) if name in UNIT_FEATURES else c

    df = df.withColumns({n: clean(n) for n in FEATURES})
    df = df.withColumn("label", clamp(F.coalesce(F.col("label").try_cast("int"), F.lit(0)), 0, 1))
    kind = F.coalesce("attack_type", F.lit("unknown"))
    return df.withColumn("attack_type", F.when((F.col("label") == 0) & (kind == "unknown"), "normal").otherwise(kind))


def count_violations(df: DataFrame) -> DataFrame:
    """Rows with a null or non-finite feature; zero after combine_datasets."""
    bad = F.lit(False)
    for n in FEATURES:
        bad = bad | F.col(n).isNull() | F.isnan(n) | (F.abs(n) == float("inf"))
    return df.agg(F.count_if(bad).alias("violations"))


# ---- events ----------------------------------------------------------------------------


def _address(df: DataFrame, prefix: str, salt: int) -> Column:
    """Made-up address that is the same for the same row."""
    part = lambda i: (F.floor(_spread(df, salt + i) * 254) + 1).cast("string")
    return F.concat(F.lit(prefix + "."), part(0), F.lit("."), part(1))


def _event(df: DataFrame, source_type: str, **columns: Column) -> DataFrame:
    """One JSON message per row; null fields are left out."""
    return df.select(F.to_json(F.struct(F.lit(source_type).alias("source_type"), *[c.alias(n) for n, c in columns.items()])).alias("value"))


def _int(c: Column) -> Column:
    return F.when(c.rlike(r"^\d+$"), c.try_cast("int")).otherwise(0)


def evtx_events(df: DataFrame) -> DataFrame:
    eid, host, tactic, cmd = text(df, "EventID", default="0"), text(df, "Computer", default="unknown"), text(df, "EVTX_Tactic"), text(df, "CommandLine")
    user, ip, proc = text(df, "TargetUserName"), text(df, "IpAddress"), text(df, "ProcessName", "NewProcessName")
    some = lambda label, c: F.when(c != "", F.concat(F.lit(f"{label}="), c))
    parts = F.concat_ws(" ", F.concat(F.lit("EventID="), eid), F.concat(F.lit("Channel="), text(df, "Channel", default="Security")), some("Tactic", tactic), some("TargetUser", user), some("SubjectUser", text(df, "SubjectUserName")), some("Process", proc), some("CommandLine", cmd))
    message = first_case([
        (eid.contains("4625"), F.concat(F.lit("An account failed to log on. Computer="), host, F.lit(" TargetUser="), user, F.lit(" IP="), ip, F.lit(" "), parts)),
        (eid.contains("4624"), F.concat(F.lit("An account was successfully logged on. Computer="), host, F.lit(" TargetUser="), user, F.lit(" IP="), ip, F.lit(" LogonType="), text(df, "LogonType"))),
        (eid.contains("4688"), F.concat(F.lit("A new process has been created. Computer="), host, F.lit(" Process="), proc, F.lit(" CommandLine="), cmd)),
        (eid == "1", F.concat(F.lit("Process Create: Computer="), host, F.lit(" Image="), text(df, "Image"), F.lit(" CommandLine="), cmd, F.lit(" User="), text(df, "User")))],
        F.concat(F.lit("Windows Event Log: Computer="), host, F.lit(" "), parts))
    return _event(df, "windows_event", message=message, hostname=host, level=F.when(tactic != "", "WARNING").otherwise("INFO"), timestamp=F.nullif(text(df, "SystemTime"), F.lit("")), ip_address=F.when(~ip.isin("", "-"), ip))


def cicids_events(df: DataFrame) -> DataFrame:
    label, port = F.trim(text(df, "Label", default="BENIGN")), F.trim(text(df, "Destination Port", default="0"))
    fwd, bwd, bad = text(df, "Total Fwd Packets", default="0"), text(df, "Total Backward Packets", default="0"), label != "BENIGN"
    src, dst = _address(df, "192.168", 10), _address(df, "10.0", 20)
    message = first_case([
        (bad & label.contains("DDoS"), F.concat(F.lit("DDoS attack detected: "), label, F.lit(" from "), src, F.lit(" to "), dst, F.lit(":"), port, F.lit(" - syn flood pattern"))),
        (bad & label.contains("PortScan"), F.concat(F.lit("Port scan detected from "), src, F.lit(" targeting "), dst, F.lit(" - multiple ports probed"))),
        (bad, F.concat(F.lit("IDS Alert: "), label, F.lit(" attack detected - dst_port="), port, F.lit(" fwd_pkts="), fwd, F.lit(" bwd_pkts="), bwd, F.lit(" flow_bytes/s="), text(df, "Flow Bytes/s", default="0"), F.lit(" src="), src, F.lit(" dst="), dst))],
        F.concat(F.lit("Network flow: dst_port="), port, F.lit(" fwd_pkts="), fwd, F.lit(" bwd_pkts="), bwd, F.lit(" flow_dur="), text(df, "Flow Duration", default="0"), F.lit(" src="), src, F.lit(" dst="), dst))
    return _event(df, "ids_ips", message=message, hostname=F.lit("ids-sensor-01"), src_ip=src, dst_ip=dst, dst_port=_int(port), src_port=(F.floor(_spread(df, 30) * 64_000) + 1024).cast("int"), protocol=F.lit("TCP"), level=F.when(bad, "WARNING").otherwise("INFO"), Label=F.when(bad, label))


def dns_events(df: DataFrame) -> DataFrame:
    raw, ip = text(df, "Domain", default="unknown"), text(df, "IP", default="0.0.0.0")
    domain = F.when(raw.startswith("b'"), F.rtrim(F.regexp_replace(raw, r"^b'(.*?)\.*'$", "$1"))).otherwise(raw)
    bits, odd = num(df, "entropy"), num(df, "entropy") > 3.5
    tail = F.concat(F.lit(" ip="), ip, F.lit(" ttl="), text(df, "TTL", default="0"), F.lit(" country="), text(df, "Country"))
    message = F.when(odd, F.concat(F.lit("DNS query: suspicious domain="), domain, F.format_string(" entropy=%.2f", bits), tail)).otherwise(F.concat(F.lit("DNS query: domain="), domain, tail))
    return _event(df, "dns", message=message, hostname=F.lit("dns-resolver-01"), dns_query=domain, dst_ip=F.when(ip.isin("", "nan"), "0.0.0.0").otherwise(ip), dst_port=F.lit(53), protocol=F.lit("UDP"), level=F.when(odd, "WARNING").otherwise("INFO"))


def unsw_events(df: DataFrame) -> DataFrame:
    src, dst, sp, dp = text(df, "srcip", default="0.0.0.0"), text(df, "dstip", default="0.0.0.0"), text(df, "sport", default="0"), text(df, "dsport", default="0")
    cat, label, proto = F.trim(text(df, "attack_cat", default="Normal")), text(df, "label", default="0"), F.upper(text(df, "proto", default="tcp"))
    named = ~cat.isin("", "Normal")
    bad = (label == "1") | named
    flow = F.concat(src, F.lit(":"), sp, F.lit(" → "), dst, F.lit(":"), dp, F.lit(" proto="), proto, F.lit(" service="), text(df, "service", default="-"), F.lit(" state="), text(df, "state"))
    sent, got = text(df, "sbytes", default="0"), text(df, "dbytes", default="0")
    message = F.when(bad, F.concat(F.lit("Firewall alert: "), cat, F.lit(" - "), flow, F.lit(" bytes_sent="), sent, F.lit(" bytes_recv="), got)).otherwise(F.concat(F.lit("Firewall: connection "), flow, F.lit(" dur="), text(df, "dur", default="0"), F.lit("s")))
    return _event(df, "firewall", message=message, hostname=F.lit("fw-01"), src_ip=src, dst_ip=dst, src_port=_int(sp), dst_port=_int(dp), protocol=proto, bytes_sent=_int(sent), bytes_received=_int(got), level=F.when(bad, "WARNING").otherwise("INFO"), attack_cat=F.when(named, cat), label=F.when(bad, label))


# Ports of the services named in the dataset.
KDD_PORTS = {"http": 80, "ftp": 21, "smtp": 25, "ssh": 22, "dns": 53, "telnet": 23}


def nsl_kdd_events(df: DataFrame) -> DataFrame:
    proto, service, label, kind = F.upper(text(df, "protocol_type", default="tcp")), text(df, "service", default="other"), text(df, "label", default="normal"), text(df, "attack_type", default="normal")
    bad = ~label.isin("normal", "0")
    src, dst = _address(df, "172.16", 10), _address(df, "10.10", 20)
    port = F.coalesce(lookup(service, KDD_PORTS), F.when(service == "private", F.floor(_spread(df, 30) * 64_000) + 1024).otherwise(F.floor(_spread(df, 30) * 1024) + 1).cast("int"))
    common = F.concat(F.lit("proto="), proto, F.lit(" service="), service, F.lit(" flag="), text(df, "flag", default="SF"))
    message = F.when(bad, F.concat(F.lit("IDS alert: "), kind, F.lit(" ("), label, F.lit(") detected - "), common, F.lit(" src_bytes="), text(df, "src_bytes", default="0"), F.lit(" dst_bytes="), text(df, "dst_bytes", default="0"), F.lit(" src="), src, F.lit(" dst="), dst, F.lit(":"), port.cast("string"))).otherwise(
        F.concat(F.lit("IDS: normal traffic - "), common, F.lit(" duration="), text(df, "duration", default="0"), F.lit("s src="), src, F.lit(" dst="), dst))
    return _event(df, "ids_ips", message=message, hostname=F.lit("ids-01"), src_ip=src, dst_ip=dst, src_port=(F.floor(_spread(df, 40) * 64_000) + 1024).cast("int"), dst_port=port, protocol=proto, level=F.when(bad, "WARNING").otherwise("INFO"), label=F.when(bad, label), attack_type=F.when(bad, kind))


def nf_ton_iot_events(df: DataFrame) -> DataFrame:
    """The first five columns are the flow, by position; the next five go into the text."""
    names = df.columns
    if len(names) < 5:
        raise ValueError("needs at least five columns")
    src, sp, dst, dp, proto = (text(df, n) for n in names[:5])
    rest = F.concat_ws(" ", *[F.concat(F.lit(f"{n}="), text(df, n)) for n in names[5:10]])
    message = F.concat(F.lit("NetFlow: "), src, F.lit(":"), sp, F.lit(" → "), dst, F.lit(":"), dp, F.lit(" proto="), proto, F.lit(" "), rest)
    return _event(df, "netflow", message=message, hostname=F.lit("netflow-collector-01"), src_ip=src, dst_ip=dst, src_port=_int(sp), dst_port=_int(dp), protocol=F.upper(proto), level=F.lit("INFO"))


# Levels of the web server log.
WEB_LEVELS = {"error": "ERROR", "notice": "INFO", "warn": "WARNING", "crit": "CRITICAL", "info": "INFO", "debug": "DEBUG"}


def apache_events(df: DataFrame) -> DataFrame:
    level, content = text(df, "Level", default="notice"), text(df, "Content")
    body = F.when(content != "", content).otherwise(F.concat(F.lit("["), text(df, "Time"), F.lit("] ["), level, F.lit("] "), text(df, "Component")))
    return _event(df, "apache", message=F.concat(F.lit("Apache: "), body), hostname=F.lit("web-01"), level=F.coalesce(lookup(F.lower(F.trim(level)), WEB_LEVELS), F.lit("INFO")))


for _name, _fn in {"evtx": evtx_events, "cicids": cicids_events, "dns": dns_events, "unsw": unsw_events, "nsl_kdd": nsl_kdd_events, "nf_ton_iot": nf_ton_iot_events, "apache_structured": apache_events}.items():
    register_converter(_name, _fn)


def dataset_to_event(df: DataFrame, name: str) -> DataFrame:
    return CONVERTERS[name](df)
