"""Column helpers shared by the operators. All stay inside code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

IPV4_TEXT = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
IPV4_IN_TEXT = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
NIL_UUID = "00000000-0000-0000-0000-000000000000"
# RFC 4122 name space for host names
UUID_NAMESPACE_DNS = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def moment(as_of) -> Column:
    """A report time given as text, datetime or column."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(as_of).cast("timestamp")


def since(ts, as_of, interval: str) -> Column:
    """``ts >= as_of - interval``; folds to one literal, so it reaches the scan."""
    return _col(ts) >= moment(as_of) - F.expr(f"INTERVAL {interval}")


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def ip_to_long(ip) -> Column:
    """Dotted quad to a number; null for anything else."""
    parts = F.split(_col(ip), r"\.")
    octets = [F.get(parts, F.lit(i)).try_cast("bigint") for i in range(4)]
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    valid = _col(ip).rlike(IPV4_TEXT)
    for o in octets:
        valid = valid & o.between(0, 255)
    return F.when(valid, value)


def valid_ip(ip) -> Column:
    """The text when it looks like IPv4, else 0.0.0.0."""
    return F.when(_col(ip).rlike(IPV4_TEXT), _col(ip)).otherwise(F.lit("0.0.0.0"))


def uuid5(name, namespace: str = UUID_NAMESPACE_DNS) -> Column:
    """Name-based identifier (RFC 4122, version 5) from a text column."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(space, F.encode(_col(name), "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.substr(F.lit("89ab"), (nibble % 4) + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def event_id(topic, partition, offset, namespace: str = UUID_NAMESPACE_DNS) -> Column:
    """Stable id from the position in the stream, the same in every consumer."""
    return uuid5(F.concat_ws(":", _col(topic), _col(partition), _col(offset)), namespace)


def lookup(key, table: Mapping, default=None) -> Column:
    """Fixed map as a literal column; for maps whose size is part of the code."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), _col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def contains_any(text, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | _col(text).contains(word)
    return hit


def first_case(rules: Sequence[tuple[Column, Column]], otherwise=None) -> Column:
    """Ordered rules: the first whose condition holds gives the value."""
    chain = None
    for cond, value in rules:
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    return chain if otherwise is None else chain.otherwise(otherwise)


def clamp(c, low, high) -> Column:
    return F.least(F.greatest(_col(c), F.lit(low)), F.lit(high))


def micros(ts) -> Column:
    return F.unix_micros(_col(ts))


def latest_version(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Last row per key by version (last write wins)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.col(version)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def computed(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns so that each is evaluated once per row.

    A later filter on a plain derived column is rewritten onto its whole expression and
    evaluates it again; columns from a generator are not.
    """
    keep = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))
