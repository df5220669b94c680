"""Joins with reference tables: thresholds, assets, indicators, allow-list, scores.

No size is assumed for the reference tables. Equality joins carry no hint, so the
optimizer broadcasts a side only below its configured size and splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchtide.functions.expr import latest_version, moment

DEFAULT_THRESHOLDS = (0.39, 0.89)


def event_score_join(events: DataFrame, scores: DataFrame) -> DataFrame:
    return events.join(scores, "event_id")


def threshold_lookup(events: DataFrame, thresholds: DataFrame, version: str = "version", default=DEFAULT_THRESHOLDS) -> DataFrame:
    """Newest thresholds of the event's source type, else the defaults."""
    current = latest_version(thresholds, ["source_type"], version).select("source_type", "suspicious_threshold", "anomalous_threshold")
    out = events.join(current, "source_type", "left")
    return out.withColumns({
        "suspicious_threshold": F.coalesce("suspicious_threshold", F.lit(default[0])),
        "anomalous_threshold": F.coalesce("anomalous_threshold", F.lit(default[1])),
    })


def threshold_coverage(events: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Source types that fall back to the defaults, with their rows."""
    used = events.groupBy("source_type").agg(F.count("*").alias("events"))
    return used.join(thresholds.select("source_type").distinct(), "source_type", "left_anti")


#: Comparisons of a name with a pattern that one key makes; keys with more are split over salts.
COMPARISONS = 1_000_000


def _trigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def _pattern_keys(hosts: DataFrame, assets: DataFrame, comparisons: int = COMPARISONS) -> tuple[DataFrame, DataFrame]:
    """Names (hostname, gram, salt) and patterns (hostname_pattern, multiplier, gram, salt) that meet."""
    names = hosts.select("hostname", F.explode(F.concat(_trigrams(F.lower("hostname")), F.array(F.lit("")))).alias("gram"))
    common = names.groupBy("gram").agg(F.count("*").alias("n"))
    literals = F.split(F.lower("hostname_pattern"), r"[%_\\\\]+")
    grams = F.flatten(F.transform(literals, _trigrams))
    rules = assets.select("hostname_pattern", "multiplier", F.explode(F.when(F.size(grams) > 0, grams).otherwise(F.array(F.lit("")))).alias("gram"))
    rated = rules.join(common, "gram", "left").groupBy("hostname_pattern", "multiplier").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("k"))
    picked = rated.where("k.n > 0").select("hostname_pattern", "multiplier", "k.n", "k.gram")  # a literal part that no name has matches nothing
    keys = picked.groupBy("gram").agg(F.ceil(F.max("n") * F.count("*") / comparisons).alias("salts"))
    split = lambda df: df.join(keys, "gram")
    names = split(names).select("hostname", "gram", F.pmod(F.xxhash64("hostname"), F.col("salts")).alias("salt"))
    patterns = split(picked).select("hostname_pattern", "multiplier", "gram", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    return names, patterns


def asset_multipliers(hostnames: DataFrame, assets: DataFrame) -> DataFrame:
    """First matching LIKE pattern (by text) of each distinct host name.

    A pattern can only match names that have all three-letter pieces of its literal parts. The one that fewest names have is
    its key, so patterns of one naming scheme meet at what tells them apart, and no pair of name and pattern is
    formed that does not share it. Patterns without such a piece meet all names. A key with many names and patterns is split.
    """
    hosts = hostnames.select("hostname").where("hostname <> ''").distinct()
    names, patterns = _pattern_keys(hosts, assets)
    hit = names.join(patterns, ["gram", "salt"]).where(F.ilike("hostname", "hostname_pattern"))
    return hit.groupBy("hostname").agg(F.min_by("multiplier", "hostname_pattern").alias("asset_multiplier"))


def asset_pattern_join(events: DataFrame, assets: DataFrame) -> DataFrame:
    out = events.join(asset_multipliers(events, assets), "hostname", "left")
    return out.withColumn("asset_multiplier", F.coalesce("asset_multiplier", F.lit(1.0)))


def active_iocs(iocs: DataFrame, as_of, types=("ip", "domain", "hash"), check_expiry: bool = True) -> DataFrame:
    """One row per live indicator value; the highest confidence of repeated ones."""
    live = iocs.where(F.col("ioc_type").isin(*types))
    if check_expiry:
        live = live.where(F.col("expires_at") > moment(as_of))
    return live.groupBy(F.lower(F.trim("ioc_value")).alias("ioc_value")).agg(F.max("confidence").alias("confidence"))


def ioc_enrich(events: DataFrame, iocs: DataFrame, as_of, src: str = "source_ip", dst: str = "dst_ip") -> DataFrame:
    """Match the source first, then the destination."""
    live = active_iocs(iocs, as_of)
    out = events
    for col, name in ((src, "_src_conf"), (dst, "_dst_conf")):
        side = live.select(F.col("ioc_value").alias("_k"), F.col("confidence").alias(name))
        out = out.join(side, F.lower(F.trim(F.col(col))) == F.col("_k"), "left").drop("_k")
    conf = F.coalesce("_src_conf", "_dst_conf")
    return out.withColumn("ioc_match", conf.isNotNull().cast("int")).withColumn("ioc_confidence", F.coalesce(conf, F.lit(0)).cast("int")).drop("_src_conf", "_dst_conf")


def allowlist_match(events: DataFrame, allowlist: DataFrame, as_of, columns: dict[str, str] | None = None) -> DataFrame:
    """Flag events with any allow-listed address, user, host, template or source."""
    columns = columns or {"ip": "source_ip", "user": "user_id", "host": "hostname", "template": "template_id", "source": "source_type"}
    live = allowlist.where((F.col("active") == 1) & (F.col("expires_at").isNull() | (F.col("expires_at") > moment(as_of))))
    out, flag = events, F.lit(False)
    for kind, col in columns.items():
        side = live.where(F.col("entry_type") == kind).select(F.col("entry_value").alias("_k")).distinct().withColumn(f"_is_{kind}", F.lit(True))
        out = out.join(side, F.col(col) == F.col("_k"), "left").drop("_k")
        flag = flag | (F.coalesce(F.col(f"_is_{kind}"), F.lit(False)) & (F.col(col) != ""))
    return out.withColumn("is_allowed", flag.cast("int")).drop(*[f"_is_{k}" for k in columns])


def ioc_semi_join(events: DataFrame, iocs: DataFrame, as_of, column: str = "src_ip", check_expiry: bool = True) -> DataFrame:
    live = active_iocs(iocs, as_of, ("ip",), check_expiry).select(F.col("ioc_value").alias("_k"))
    return events.join(live, F.lower(F.col(column)) == F.col("_k"), "left_semi")


def noisy_sources(scores: DataFrame, limit: int = 50) -> DataFrame:
    return scores.groupBy("source_ip").agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select("source_ip")


def noisy_source_anti_join(events: DataFrame, scores: DataFrame, iocs: DataFrame, as_of, limit: int = 50, column: str = "src_ip") -> DataFrame:
    """Keep rows whose source is an indicator or is not noisy."""
    ioc = active_iocs(iocs, as_of, ("ip",)).select(F.col("ioc_value").alias("_i"), F.lit(True).alias("_is_ioc"))
    noisy = noisy_sources(scores, limit).select(F.col("source_ip").alias("_s"), F.lit(True).alias("_is_noisy"))
    out = events.join(ioc, F.lower(F.col(column)) == F.col("_i"), "left").join(noisy, F.col(column) == F.col("_s"), "left")
    return out.where(F.col("_is_ioc").isNotNull() | F.col("_is_noisy").isNull()).drop("_i", "_is_ioc", "_s", "_is_noisy")


def suspicious_ip_join(security: DataFrame, network: DataFrame, k: int = 10) -> DataFrame:
    sec = security.groupBy(F.col("ip_address").alias("src_ip")).agg(F.count("*").alias("sec_count"))
    net = network.groupBy("src_ip").agg(F.count("*").alias("net_count"))
    return sec.join(net, "src_ip").orderBy(F.desc("sec_count"), "src_ip").limit(k)


def campaign_join(scores: DataFrame, network: DataFrame, as_of=None, window: str | None = None, min_events: int = 3) -> DataFrame:
    """Scores on hosts that got at least ``min_events`` connections from the same source."""
    if window is not None:
        from watchtide.functions.expr import since

        scores, network = scores.where(since("timestamp", as_of, window)), network.where(since("timestamp", as_of, window))
    busy = network.groupBy("hostname", F.col("src_ip").alias("source_ip")).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_events)
    return scores.join(busy.drop("_n"), ["hostname", "source_ip"])


def baseline_join(alerts: DataFrame, baseline: DataFrame) -> DataFrame:
    out = alerts.join(baseline, ["hostname", "source_ip"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("baseline_mean", "baseline_stddev")})


def latest_rows_by_key(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    return latest_version(df, keys, version)
