"""Projections, filters and the event search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from watchtide.functions.expr import moment

# Fixed columns of each table in search results: (column, alias).
PROJECTIONS = {
    "raw_logs": [("event_id", "event_id"), ("timestamp", "timestamp"), ("level", "level"), ("source", "log_source"), ("message", "raw"), ("user_id", "user_id"), ("ip_address", "ip_address"), ("request_id", "request_id")],
    "security_events": [("event_id", "event_id"), ("timestamp", "timestamp"), ("severity", "severity"), ("category", "category"), ("source", "log_source"), ("description", "raw"), ("hostname", "hostname"), ("user_id", "user_id"), ("mitre_tactic", "mitre_tactic"), ("mitre_technique", "mitre_technique")],
    "process_events": [("event_id", "event_id"), ("timestamp", "timestamp"), ("hostname", "hostname"), ("pid", "pid"), ("ppid", "ppid"), ("binary_path", "binary_path"), ("arguments", "raw"), ("container_id", "container_id"), ("is_suspicious", "is_suspicious")],
    "network_events": [("event_id", "event_id"), ("timestamp", "timestamp"), ("hostname", "hostname"), ("src_ip", "src_ip"), ("src_port", "src_port"), ("dst_ip", "dst_ip"), ("dst_port", "dst_port"), ("protocol", "protocol"), ("direction", "direction"), ("bytes_sent", "bytes_sent"), ("bytes_received", "bytes_received"), ("dns_query", "dns_query")],
}
# Columns searched by a keyword.
SEARCH_COLUMNS = {
    "raw_logs": ["source", "message", "user_id"],
    "security_events": ["source", "description", "hostname", "user_id", "category", "mitre_tactic", "mitre_technique"],
    "process_events": ["hostname", "binary_path", "arguments", "container_id"],
    "network_events": ["hostname", "protocol", "dns_query", "direction"],
}
MAX_LIMIT, MAX_OFFSET = 200, 100_000
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd"]


def table_projection(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[F.col(c).alias(a) for c, a in PROJECTIONS[table]])


def parse_best_effort(text) -> Column:
    """First format that fits, else null."""
    c = F.lit(text) if isinstance(text, str) else text
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in TIME_FORMATS])


def time_range_filter(df: DataFrame, start: str | None = None, end: str | None = None, ts: str = "timestamp") -> DataFrame:
    """Inclusive range; both bounds are literals, so they reach the scan."""
    if start:
        df = df.where(F.col(ts) >= parse_best_effort(start))
    if end:
        df = df.where(F.col(ts) <= parse_best_effort(end))
    return df


def keyword_search(df: DataFrame, table: str, text: str) -> DataFrame:
    """Case-insensitive; ``%`` and ``_`` in the text keep their LIKE meaning."""
    return df.where(F.concat_ws(" ", *SEARCH_COLUMNS[table]).ilike(f"%{text}%")) if text else df


def severity_filter(df: DataFrame, table: str, severity) -> DataFrame:
    if severity is None or table != "security_events":
        return df
    try:
        level = int(float(severity))
    except (TypeError, ValueError):
        level = 0
    return df.where(F.col("severity") >= max(0, min(4, level)))


def matching_events(df: DataFrame, table: str, text: str = "", severity=None, start=None, end=None) -> DataFrame:
    return time_range_filter(severity_filter(keyword_search(df, table, text), table, severity), start, end)


def event_search(df: DataFrame, table: str, text: str = "", severity=None, start=None, end=None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """One page of hits, newest first, and the total. A page beyond the bounds is refused: `page_after` goes as deep as needed."""
    if not 1 <= limit <= MAX_LIMIT or not 0 <= offset <= MAX_OFFSET:
        raise ValueError(f"a page has 1 to {MAX_LIMIT} rows and starts at most at {MAX_OFFSET}; use page_after beyond")
    hits = matching_events(df, table, text, severity, start, end)
    page = table_projection(hits, table).orderBy(F.desc("timestamp"), "event_id").offset(offset).limit(limit)
    return page, hits.agg(F.count("*").alias("total"))


def page_after(df: DataFrame, last_ts, last_id, limit: int = 50) -> DataFrame:
    """Key-set paging: cost does not grow with depth, unlike an offset."""
    ts = moment(last_ts)
    later = (F.col("timestamp") < ts) | ((F.col("timestamp") == ts) & (F.col("event_id") > F.lit(last_id)))
    return df.where((F.col("timestamp") <= ts) & later).orderBy(F.desc("timestamp"), "event_id").limit(limit)


def alert_worklist(security: DataFrame, state: str | None = None, hostname: str | None = None, source: str | None = None, sort: str = "severity") -> DataFrame:
    s = F.col("severity")
    out = security.withColumn("state", F.when(s == 4, "New").when(s == 3, "Investigating").when(s == 2, "Acknowledged").otherwise("Resolved"))
    for column, wanted in (("state", state), ("hostname", hostname), ("source", source)):
        if wanted is not None:
            out = out.where(F.col(column) == wanted)
    order = [F.desc("severity"), F.desc("timestamp")] if sort == "severity" else [F.desc("timestamp")]
    return out.select("event_id", "timestamp", "severity", "hostname", "source", "state").orderBy(*order, "event_id")


def live_feed_filter(feed: DataFrame, text: str) -> DataFrame:
    q = text.lower()
    return feed.where(F.lower("raw").contains(q) | F.lower("hostname").contains(q) | F.lower("log_source").contains(q))


def ioc_list_filter(iocs: DataFrame, text: str = "", ioc_type: str | None = None) -> DataFrame:
    if text:
        q = text.lower()
        iocs = iocs.where(F.lower("ioc_value").contains(q) | F.exists("tags", lambda t: F.lower(t).contains(q)))
    return iocs if ioc_type is None else iocs.where(F.col("ioc_type") == ioc_type)


_FILTER = re.compile(r"^\s*(\w+)\s*(=|!=|<>|<=|>=|<|>|LIKE)\s*('[^']*'|-?\d+(?:\.\d+)?)\s*$", re.IGNORECASE)


def vector_filter(df: DataFrame, text: str | None, allowed: list[str]) -> DataFrame:
    """``column op value`` terms joined by AND; only listed columns and literal values pass."""
    if not text:
        return df
    for term in re.split(r"\s+AND\s+", text.strip(), flags=re.IGNORECASE):
        m = _FILTER.match(term)
        if m is None or m.group(1) not in allowed:
            raise ValueError(f"filter is not allowed: {term!r}")
        df = df.where(F.expr(f"`{m.group(1)}` {m.group(2)} {m.group(3)}"))
    return df


def pattern_count(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(F.col(column).like(pattern)).agg(F.count("*").alias("cnt"))


def union_events(raw: DataFrame, security: DataFrame, process: DataFrame, network: DataFrame) -> DataFrame:
    """Common feed of the four tables."""
    def part(df, source, host, severity, text, table):
        return df.select("event_id", "timestamp", source.alias("log_source"), host.alias("hostname"), severity.cast("int").alias("severity"), text.alias("raw"), F.lit(table).alias("_table"))

    c, empty = F.col, F.lit("")
    flow = F.concat(c("src_ip"), F.lit(":"), c("src_port"), F.lit(" → "), c("dst_ip"), F.lit(":"), c("dst_port"), F.lit(" "), c("dns_query"))
    return (
        part(raw, c("source"), empty, F.lit(0), c("message"), "raw_logs")
        .unionByName(part(security, c("source"), c("hostname"), c("severity"), c("description"), "security_events"))
        .unionByName(part(process, empty, c("hostname"), c("is_suspicious"), F.concat_ws(" ", "binary_path", "arguments"), "process_events"))
        .unionByName(part(network, c("protocol"), c("hostname"), c("is_suspicious"), flow, "network_events"))
    )


def latest_rows(df: DataFrame, day, k: int) -> DataFrame:
    """Newest k rows of a day."""
    return df.where(F.col("timestamp") >= F.date_trunc("day", moment(day))).orderBy(F.desc("timestamp"), "event_id").limit(k)


def latest_per_table(raw, security, process, network, day, per_table: int = 25, total: int = 100) -> DataFrame:
    """Newest rows of each table, cut before they are merged."""
    cut = [latest_rows(df, day, per_table) for df in (raw, security, process, network)]
    return union_events(*cut).orderBy(F.desc("timestamp"), "_table", "event_id").limit(total)


def feed_dedup(feed: DataFrame) -> DataFrame:
    """Each event once; the earliest copy by arrival wins."""
    rest = [c for c in feed.columns if c != "event_id"]
    return feed.groupBy("event_id").agg(F.min(F.struct(*rest)).alias("r")).select("event_id", "r.*")
