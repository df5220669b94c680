"""Tamper evidence: leaf hashes, Merkle roots per time window, and a hash chain per table."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from watchtide.functions.expr import moment
from watchtide.functions.timeline import segment_rank, text_segments
from watchtide.session import cut_lineage

WINDOW_S = 1800
STORED_LEAVES = 100
EMPTY_ROOT = hashlib.sha256(b"EMPTY_BATCH").hexdigest()
# Fields of a leaf per table, after id and time.
LEAF_FIELDS = {
    "raw_logs": ["source", "level", "message"],
    "security_events": ["severity", "category", "source", "description", "mitre_tactic", "mitre_technique"],
    "process_events": ["hostname", "pid", "ppid", "binary_path", "arguments"],
    "network_events": ["hostname", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"],
}
_FAN = 10  # levels reduced per shuffle
_DEEPEST = 40
#: Leaves of a batch that one task numbers, about, and segments of a batch at most (beyond, a segment is sorted with spill).
SEGMENT_LEAVES, SEGMENTS = 250_000, 1024


def event_leaf_hash(table: str, sep: str = "") -> Column:
    parts = [F.col("event_id").cast("string"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS")]
    parts += [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in LEAF_FIELDS[table]]
    return F.upper(F.sha2(F.concat_ws(sep, *parts) if sep else F.concat(*parts), 256))


def leaves(events: DataFrame, table: str, window_s: int = WINDOW_S, after=None, sep: str = "") -> DataFrame:
    """(table_name, batch_no, time_from, time_to, event_id, leaf) in fixed windows.

    Windows start at the first event, or at the end of the last anchored window.
    """
    if after is not None:
        # a window end is exclusive, so an event at that very moment is not anchored yet
        events = events.where(F.col("timestamp") >= moment(after))
    bounds = events.agg(F.min("timestamp").alias("_lo"), F.max("timestamp").alias("_hi"))
    start = F.unix_timestamp("_lo") if after is None else F.unix_timestamp(moment(after))
    bounds = bounds.select(start.alias("_t0"), (F.unix_timestamp("_hi") + 1).alias("_t1"))
    df = events.crossJoin(F.broadcast(bounds))  # one row
    no = F.expr(f"(unix_timestamp(timestamp) - _t0) div {window_s}")
    lo = F.col("_t0") + F.col("batch_no") * window_s
    return df.withColumn("batch_no", no).select(
        F.lit(table).alias("table_name"), "batch_no", F.timestamp_seconds(lo).alias("time_from"), F.timestamp_seconds(F.least(lo + window_s, F.col("_t1"))).alias("time_to"),
        F.col("event_id").cast("string").alias("event_id"), event_leaf_hash(table, sep).alias("leaf"))


def _pair_up(nodes: Column) -> Column:
    """One level of the tree; a single node stays."""
    half = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(nodes) / 2 - 1, F.lit(0.0)).cast("int")),
        lambda i: F.sha2(F.concat(F.get(nodes, i * 2), F.get(nodes, i * 2 + 1)), 256),
    )
    return F.when(F.size(nodes) > 1, half).otherwise(nodes)


def largest_batch(rows: DataFrame, keys: list[str]) -> int:
    """Leaves of the largest batch; the leaves themselves are not hashed for it."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def merkle_roots(numbered: DataFrame, keys: list[str], leaf: str = "leaf", index: str = "idx", largest: int | None = None) -> DataFrame:
    """Root and depth per batch from leaves numbered from 0.

    Leaves are padded to a power of two with the last one. A group of 1024 neighbours is
    reduced inside one row, so a batch of any size needs a few shuffles and no task holds
    more than one group; padding above a group is one hash carried along. There are as many
    rounds as the largest batch needs, which is counted unless the caller knows it.
    """
    largest = largest_batch(numbered, keys) if largest is None else largest
    rounds = max(1, -(-(largest - 1).bit_length() // _FAN)) if largest else 1
    size = numbered.groupBy(*keys).agg(F.count("*").alias("n"), F.max_by(leaf, index).alias("pad"))
    # the smallest depth whose tree holds all leaves, found with whole numbers
    depth = F.aggregate(F.sequence(F.lit(1), F.lit(_DEEPEST)), F.lit(0), lambda d, i: F.when((d == 0) & (F.pow(F.lit(2.0), i) >= F.col("n")), i).otherwise(d))
    size = size.withColumn("depth", depth)
    width = 1 << _FAN
    nodes = numbered.select(*keys, F.col(index).cast("bigint").alias("i"), F.col(leaf).alias("h")).join(size.withColumn("left", F.col("depth")), keys)
    for _ in range(rounds):
        same = [F.first(c).alias(c) for c in ("n", "pad", "depth", "left")]
        packed = nodes.groupBy(*keys, F.expr(f"i div {width}").alias("g")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("items"), *same)
        want = F.pow(F.lit(2.0), F.least(F.col("left"), F.lit(_FAN))).cast("int")
        full = F.concat(F.transform("items", lambda x: x["h"]), F.array_repeat("pad", want - F.size("items")))
        top = F.aggregate(F.sequence(F.lit(1), F.lit(_FAN)), full, lambda acc, _: _pair_up(acc))
        # the padding of the next round is the hash of a whole group of padding
        pad = F.aggregate(F.sequence(F.lit(1), F.lit(_FAN)), F.col("pad"), lambda p, _: F.sha2(F.concat(p, p), 256))
        nodes = packed.select(*keys, F.col("g").alias("i"), F.get(top, F.lit(0)).alias("h"), "n", pad.alias("pad"), "depth", F.greatest(F.col("left") - _FAN, F.lit(0)).alias("left"))
    return nodes.select(*keys, F.col("h").alias("root"), F.col("depth").alias("merkle_depth"), F.col("n").alias("event_count"))


_BATCH = ["table_name", "batch_no", "time_from", "time_to"]


def number_leaves(leaf_rows: DataFrame, keys: list[str] = _BATCH, largest: int | None = None) -> DataFrame:
    """Leaves numbered by event id inside their batch; ids are ordered as text. A batch has as many segments as its size asks for."""
    largest = largest_batch(leaf_rows, keys) if largest is None else largest
    if largest <= SEGMENT_LEAVES:
        return leaf_rows.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy("event_id")) - 1)
    segments = text_segments(leaf_rows, "event_id", (parts := min(SEGMENTS, -(-largest // SEGMENT_LEAVES))), 32 * parts)
    return segment_rank(leaf_rows, keys, ["event_id"], segments, "rn").withColumn("idx", F.col("rn") - 1).drop("rn")


_CHAIN = "table_name string, batch_no bigint, time_from timestamp, time_to timestamp, root string, merkle_depth int, event_count bigint, prev_merkle_root string, merkle_root string"


def _fold(first: dict[str, str]):
    def chain(batches: pd.DataFrame) -> pd.DataFrame:
        batches = batches.sort_values("batch_no")
        prev, before, out = first.get(batches["table_name"].iloc[0], "") if len(batches) else "", [], []
        for root in batches["root"]:
            before.append(prev)
            prev = hashlib.sha256((prev + root).encode()).hexdigest() if prev else root
            out.append(prev)
        return batches.assign(prev_merkle_root=before, merkle_root=out)

    return chain


def chain_roots(roots: DataFrame, first: dict[str, str] | None = None) -> DataFrame:
    """Chain the roots of a table in time order. The chain is sequential by nature and holds
    one row per time window, however many events there are."""
    cols = [c.split()[0] for c in _CHAIN.split(", ")][:7]
    return roots.select(*cols).groupBy("table_name").applyInPandas(_fold(first or {}), _CHAIN)


def chain_previous_root(anchors: DataFrame) -> DataFrame:
    """Root of the batch before, per table in time order."""
    w = Window.partitionBy("table_name").orderBy("time_from", "batch_id")
    return anchors.withColumn("prev_merkle_root", F.coalesce(F.lag("merkle_root").over(w), F.lit("")))


def anchor_batches(leaf_rows: DataFrame, first: dict[str, str] | None = None, stored: int = STORED_LEAVES) -> DataFrame:
    """Anchor rows: chained root, depth, count and the first and last leaves of every batch."""
    keys = _BATCH
    largest = largest_batch(leaf_rows, keys)
    numbered = cut_lineage(number_leaves(leaf_rows, keys, largest).select(*keys, "idx", "leaf"))  # for the roots and for the ends
    chained = chain_roots(merkle_roots(numbered, keys, largest=largest), first)
    ends = numbered.join(chained.select(*keys, "event_count"), keys).where((F.col("event_count") <= 2 * stored) | (F.col("idx") < stored) | (F.col("idx") >= F.col("event_count") - stored))
    kept = ends.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "leaf"))), lambda x: x["leaf"]).alias("leaf_hashes"))
    batch_id = F.concat(F.lit("BATCH-"), F.col("table_name"), F.lit("-"), F.date_format("time_from", "yyyyMMdd-HHmmss"))
    return chained.join(kept, keys).select(batch_id.alias("batch_id"), "table_name", "time_from", "time_to", "event_count", "merkle_root", "merkle_depth", "leaf_hashes", F.lit("Anchored").alias("status"), "prev_merkle_root", F.lit("").alias("s3_key"))


def anchor_new(tables: dict[str, DataFrame], anchors: DataFrame) -> DataFrame:
    """Anchor rows for the events after the last anchored window of each table, chained to its last root.

    A table without anchors starts at its first event. What is read from the anchors is one row per table.
    """
    last = {r["table_name"]: r for r in anchors.groupBy("table_name").agg(F.max("time_to").cast("string").alias("t"), F.max_by("merkle_root", "time_to").alias("root")).collect()}
    rows = None
    for table, events in tables.items():
        part = leaves(events, table, after=last[table]["t"] if table in last else None)
        rows = part if rows is None else rows.unionByName(part)
    return anchor_batches(rows, {table: r["root"] for table, r in last.items()})


def _batch_of(leaf: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each event with the batch whose window holds it: an equality join on the minute, then the exact bounds."""
    batch = anchors.select(F.struct("batch_id", "time_from", "time_to").alias("b"))
    minutes = F.sequence(F.date_trunc("minute", "b.time_from"), F.date_trunc("minute", "b.time_to"), F.expr("INTERVAL 1 MINUTE"))
    rows = leaf.withColumn("_minute", F.date_trunc("minute", "timestamp")).join(batch.select("b", F.explode(minutes).alias("_minute")), "_minute")
    return rows.where((F.col("timestamp") >= F.col("b.time_from")) & (F.col("timestamp") < F.col("b.time_to"))).drop("_minute")


def verify_batches(anchors: DataFrame, events: dict[str, DataFrame], sep: str = "") -> DataFrame:
    """Recompute every anchored batch from the events and compare root and count."""
    out = None
    for table, df in events.items():
        leaf = df.select("timestamp", F.col("event_id").cast("string").alias("event_id"), event_leaf_hash(table, sep).alias("leaf"))
        part = _batch_of(leaf, anchors.where(F.col("table_name") == table)).select(F.lit(table).alias("table_name"), F.col("b.batch_id").alias("batch_id"), "event_id", "leaf")
        out = part if out is None else out.unionByName(part)
    keys = ["table_name", "batch_id"]
    largest = largest_batch(out, keys)
    roots = merkle_roots(number_leaves(out, keys, largest), keys, largest=largest).withColumnRenamed("event_count", "actual_count").drop("merkle_depth")
    joined = anchors.join(roots, ["table_name", "batch_id"], "left")
    plain = F.coalesce("root", F.lit(EMPTY_ROOT))
    computed = F.when(F.col("prev_merkle_root") != "", F.sha2(F.concat("prev_merkle_root", plain), 256)).otherwise(plain)
    joined = joined.withColumns({"computed_root": computed, "actual_count": F.coalesce("actual_count", F.lit(0))})
    ok = F.col("computed_root") == F.col("merkle_root")
    return joined.select("batch_id", "table_name", F.col("merkle_root").alias("stored_root"), "computed_root", F.col("event_count").alias("stored_count"), "actual_count", ok.cast("int").alias("verified"), F.when(ok, "PASS").otherwise("FAIL").alias("status"))


def anchor_status(tables: dict[str, DataFrame], anchors: DataFrame) -> DataFrame:
    """Range and count per table, how much is anchored, and events after the last anchored window."""
    done = anchors.groupBy("table_name").agg(F.count("*").alias("batches"), F.max("time_to").alias("anchored_to"))
    out = None
    for name, df in tables.items():
        mine = done.where(F.col("table_name") == name)
        last = mine.agg(F.max("anchored_to").alias("anchored_to"), F.coalesce(F.max("batches"), F.lit(0)).alias("batches"))
        part = df.select("timestamp").crossJoin(F.broadcast(last)).groupBy("anchored_to", "batches").agg(  # one row
            F.min("timestamp").alias("first_event"), F.max("timestamp").alias("last_event"), F.count("*").alias("events"),
            F.count_if(F.col("anchored_to").isNull() | (F.col("timestamp") >= F.col("anchored_to"))).alias("new_events"))
        part = part.select(F.lit(name).alias("table_name"), "first_event", "last_event", "events", "batches", "anchored_to", "new_events")
        out = part if out is None else out.unionByName(part)
    return out
