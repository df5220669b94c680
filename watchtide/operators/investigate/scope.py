"""Facts that can matter to a set of alerts.

Alerts are few and facts are many. Before any shuffle, facts are limited to the alerts' time range, as a predicate of literals that
reaches the scan, and to the keys and time buckets that alerts look at, by a semi join: with a broadcast while the alerts'
keys are a bounded table, else by a shuffled join. What is left has every fact of every alert's window, so window
measures stay the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from watchtide.session import cut_lineage

KEYS = ("hostname", "source_ip", "user_id")
#: Buckets of keys up to which facts are limited by a broadcast.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Scope:
    """Keys and times of alerts, and the range of their times; `places` counts keys and minutes."""

    asked: DataFrame
    low: int | None  # microseconds
    high: int | None
    places: int
    bound: int = BROADCAST_ROWS
    rows: int = 0  # alerts with a time

    def near(self, facts: DataFrame, keys: Sequence[str], window_us: int, ts: str = "timestamp") -> DataFrame:
        """Facts of an alert's keys (null is a key too) in its window's time buckets: all that its window has, and some around it."""
        if self.low is None:
            return facts.where(F.lit(False))
        span = window_us + 1
        bucket = lambda c: F.expr(f"{c} div {span}")
        # a window ends in one bucket and starts in it or the one before; an alert's minute ends in the bucket of its last microsecond at most
        first, last = bucket("(_minute * 60000000)") - 1, bucket("(_minute * 60000000 + 59999999)")
        asked = self.asked.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.explode(F.sequence(first, last)).alias("_k_b")).distinct()
        if self.places * (2 + 60_000_000 // span) <= self.bound:
            asked = F.broadcast(asked)
        some = facts.where(F.col(ts).between(F.timestamp_micros(F.lit(self.low - window_us)), F.timestamp_micros(F.lit(self.high))))
        same = F.expr(f"unix_micros({ts}) div {span}") == F.col("_k_b")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        return some.join(asked, same, "left_semi")


def scope(alerts: DataFrame, ts: str = "timestamp", bound: int = BROADCAST_ROWS) -> Scope:
    """One pass over the alerts; their keys and minutes go to the shared folder."""
    found = alerts.withColumn("_minute", F.expr(f"unix_micros({ts}) div 60000000"))
    found = found.groupBy(*[k for k in KEYS if k in alerts.columns], "_minute").agg(F.min(ts).alias("_low"), F.max(ts).alias("_high"), F.count("*").alias("_rows"))
    found = cut_lineage(found.where("_minute IS NOT NULL"))
    low, high, places, rows = found.agg(F.unix_micros(F.min("_low")), F.unix_micros(F.max("_high")), F.count("*"), F.sum("_rows")).first()
    return Scope(found.drop("_low", "_high", "_rows"), low, high, places, bound, rows or 0)
