"""Exact sliding-window measures that hold up when one key owns a large share of the rows.

Time is cut into buckets no longer than the window, so a key is spread over as many tasks
as it has busy buckets. Every fact becomes an increase when it
enters the window and a decrease when it leaves; a probe reads the running total. No pair
of probe and fact is ever formed: the work is linear in facts plus probes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchtide.functions.expr import micros


PARTS = 8  # buckets per window, for windows of a minute and more


def _width(window_us: int) -> int:
    """Length of a time bucket. Long windows are cut finer, so a busy key gives smaller tasks."""
    span = window_us + 1
    return span if window_us < 60_000_000 else -(-span // PARTS)


def _with_time(df: DataFrame, ts: str, width: int) -> DataFrame:
    df = df.withColumn("_t", micros(ts))
    return df.withColumn("_b", F.expr(f"_t div {width}"))


def _changes(spans: DataFrame, keys: Sequence[str], names: Sequence[str], width: int) -> DataFrame:
    """Rows (keys, _b, _t, _e, measures) present over ``[_t, _e)`` as increases and decreases per bucket.

    What is still present when a bucket starts is summed per key first and carried in as one row.
    """
    spans = spans.withColumn("_eb", F.expr(f"_e div {width}"))
    enter = F.struct(F.col("_b"), F.col("_t"), *names)
    leave = F.struct(F.col("_eb").alias("_b"), F.col("_e").alias("_t"), *[(-F.col(n)).alias(n) for n in names])
    both = spans.select(*keys, F.inline(F.array(enter, leave)))
    over = spans.where(F.col("_eb") > F.col("_b")).groupBy(*keys, "_b", "_eb").agg(*[F.sum(n).alias(n) for n in names])
    over = over.select(*keys, F.explode(F.sequence(F.col("_b") + 1, F.col("_eb"))).alias("_b"), *names)
    return both.unionByName(over.select(*keys, "_b", (F.col("_b") * width).alias("_t"), *names))


def sum_deltas(facts: DataFrame, keys: Sequence[str], ts: str, window_us: int, measures: dict[str, Column]) -> DataFrame:
    """Changes of whole-number sums over ``[t - window, t]``."""
    width, names = _width(window_us), list(measures)
    f = _with_time(facts, ts, width).select(*keys, "_b", "_t", (F.col("_t") + window_us + 1).alias("_e"), *[m.cast("bigint").alias(n) for n, m in measures.items()])
    return _changes(f, keys, names, width)


def distinct_deltas(facts: DataFrame, keys: Sequence[str], ts: str, window_us: int, values: dict[str, Column]) -> DataFrame:
    """Changes of distinct counts; a null value is not counted.

    A value counts from its occurrence to its next one, at most one window long, so at any
    time it is counted once.
    """
    width, names = _width(window_us), list(values)
    ahead_by = -(-(window_us + 1) // width)
    long = F.filter(F.array(*[F.struct(F.lit(n).alias("_m"), v.cast("string").alias("_v")) for n, v in values.items()]), lambda s: s["_v"].isNotNull())
    f = _with_time(facts, ts, width).select(*keys, "_b", "_t", F.inline(long)).distinct()
    group = [*keys, "_m", "_v"]
    # the first occurrence in each of the next buckets, seen from this one
    first = f.groupBy(*group, "_b").agg(F.min("_t").alias("_t"))
    ahead = first.select(*group, F.explode(F.sequence(F.col("_b") - ahead_by, F.col("_b") - 1)).alias("_b"), "_t", F.lit(True).alias("_ahead"))
    both = f.withColumn("_ahead", F.lit(False)).unionByName(ahead)
    nxt = F.lead("_t").over(Window.partitionBy(*group, "_b").orderBy("_t"))
    end = F.col("_t") + window_us + 1
    spans = both.withColumn("_e", F.least(F.coalesce(nxt, end), end)).where(~F.col("_ahead"))
    spans = spans.select(*keys, "_b", "_t", "_e", *[F.when(F.col("_m") == n, 1).otherwise(0).cast("bigint").alias(n) for n in names])
    return _changes(spans, keys, names, width)


def sweep(probes: DataFrame, keys: Sequence[str], ts: str, window_us: int, deltas: Sequence[DataFrame], sub_keys: Sequence[str] = (), sub_names: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Probes with every measure of ``deltas`` as of their own time.

    ``sub_names`` are read per ``keys + sub_keys``; they share the shuffle of the others. ``parts`` fixes the number of tasks.
    """
    width, all_keys = _width(window_us), [*keys, *sub_keys]
    carried = [c for c in probes.columns if c not in all_keys]
    rows = None
    names: list[str] = []
    for d in deltas:
        names += [n for n in d.columns if n not in (*all_keys, "_b", "_t")]
    for d in deltas:
        d = d.select(*all_keys, "_b", "_t", *[F.col(n) if n in d.columns else F.lit(0).cast("bigint").alias(n) for n in names])
        rows = d if rows is None else rows.unionByName(d)
    p = _with_time(probes, ts, width).select(*all_keys, "_b", "_t", *[F.lit(0).cast("bigint").alias(n) for n in names], F.struct(*carried).alias("_p"), F.lit(True).alias("_asks"))
    rows = rows.unionByName(p, allowMissingColumns=True)
    rows = rows.repartition(parts, *keys, "_b") if parts else rows
    to_now = lambda by: Window.partitionBy(*by, "_b").orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    wide, fine = to_now(keys), to_now(all_keys)
    # probes are told by a flag of their own, so that columns of theirs that nobody reads are not shuffled
    out = rows.select(*all_keys, "_p", "_asks", *[F.sum(n).over(fine if n in sub_names else wide).alias(n) for n in names])
    return out.where("_asks").select(*all_keys, *[F.col(f"_p.{c}").alias(c) for c in carried], *names)


def _shifted(df: DataFrame, counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the total (`_n`) of the earlier segments of their key as `_shift`; a null key is a key."""
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1))
    shift = counted.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_seg").alias("_k_seg"), F.coalesce(before, F.lit(0)).alias("_shift"))
    same = F.col("_seg").eqNullSafe(F.col("_k_seg"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(shift, same).drop("_k_seg", *[f"_k_{k}" for k in keys])


def segment_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, name: str = "rn") -> DataFrame:
    """1-based row number per key, without one task per key.

    ``bucket`` must grow with the order. Rows are numbered inside a bucket and shifted by
    the rows of the earlier buckets, which are counted by an aggregation.
    """
    df = df.withColumn("_seg", bucket)
    counted = df.groupBy(*keys, "_seg").agg(F.count("*").alias("_n"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_seg").orderBy(*order))
    return _shifted(df.withColumn("_in", inside), counted, keys).withColumn(name, F.col("_shift") + F.col("_in")).drop("_seg", "_in", "_shift")


def text_segments(df: DataFrame, column: str, parts: int = 128, sample: int = 4096) -> Column:
    """Segment number of a text, in order, for `segment_rank`: ranges between the quantiles of a bounded sample.

    The ranges follow the texts that are there, so ids with a common beginning spread as well as others.
    """
    if parts <= 1:
        return F.lit(0)
    rows = df.select(F.col(column).cast("string").alias("x")).where("x IS NOT NULL").orderBy(F.xxhash64("x")).limit(sample).collect()
    some = sorted({r["x"] for r in rows}, key=lambda x: x.encode())
    cuts = [some[len(some) * k // parts] for k in range(1, parts)] if some else []
    cuts, text = list(dict.fromkeys(cuts)), F.col(column).cast("string")

    def between(lo: int, hi: int) -> Column:
        """How many of the cuts lie at or before the text, by halving."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(text < cuts[mid], between(lo, mid)).otherwise(between(mid + 1, hi))

    return between(0, len(cuts))


def rank_chunks(ranked: DataFrame, n: int, chunk: int = 10_000, rank: str = "rn") -> DataFrame:
    """Ranked rows in chunks (`_c`), each with the last n - 1 rows of the one before as copies (`_copy`), for windows of n rows."""
    ranked = ranked.withColumn("_c", F.expr(f"({rank} - 1) div {chunk}")).withColumn("_copy", F.lit(False))
    tail = ranked.where(F.expr(f"({rank} - 1) % {chunk} >= {chunk - n + 1}")).withColumn("_c", F.col("_c") + 1).withColumn("_copy", F.lit(True))
    return ranked.unionByName(tail)


def last_n(ranked: DataFrame, keys: Sequence[str], n: int, measures: dict[str, Callable], rank: str = "rn", chunk: int = 10_000) -> DataFrame:
    """Measures over the last n rows of a key, current row included."""
    w = Window.partitionBy(*keys, "_c").orderBy(rank).rowsBetween(-(n - 1), 0)
    out = rank_chunks(ranked, n, chunk, rank).withColumns({name: make(w) for name, make in measures.items()})
    return out.where(~F.col("_copy")).drop("_c", "_copy")


def running_count(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, condition: Column, name: str) -> DataFrame:
    """Rows up to and including this one that meet a condition, per key, without one task per key."""
    df = df.withColumn("_seg", bucket).withColumn("_hit", F.when(condition, 1).otherwise(0))
    counted = df.groupBy(*keys, "_seg").agg(F.sum("_hit").alias("_n"))
    inside = F.sum("_hit").over(Window.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return _shifted(df.withColumn("_in", inside), counted, keys).withColumn(name, F.col("_shift") + F.col("_in")).drop("_seg", "_in", "_shift", "_hit")


def window_values(probes: DataFrame, facts: DataFrame, key: str, ts: str, window_us: int, value: str, probe_id: str) -> DataFrame:
    """(probe, value) for every distinct value a key had in the probe's window.

    A window ends in a bucket and starts in it or the one before. So a value is there when its first time in the probe's
    bucket is not after the probe, or its last time in the bucket before is in the window: two times per value and bucket
    meet a probe, and what a probe finds is found in one task.
    """
    span = window_us + 1
    place = lambda df: df.withColumn("_t", micros(ts)).withColumn("_b", F.expr(f"(_t - pmod(_t, {span})) div {span}"))
    f = place(facts).groupBy(key, F.col(value).alias("_v"), "_b").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    none = F.lit(None).cast("bigint")
    sides = f.select(key, "_v", "_b", "_first", none.alias("_last")).unionByName(f.select(key, "_v", (F.col("_b") + 1).alias("_b"), none.alias("_first"), "_last"))
    seen = sides.groupBy(key, "_v", "_b").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    p = place(probes.select(probe_id, key, ts)).select(probe_id, key, "_b", "_t")
    here = (F.col("_first") <= F.col("_t")) | (F.col("_last") >= F.col("_t") - window_us)
    return p.join(seen, [key, "_b"]).where(here & F.col(probe_id).isNotNull()).select(probe_id, F.col("_v").alias(value))


def window_recent(probes: DataFrame, facts: DataFrame, keys: Sequence[str], ts: str, window_us: int, item: str, probe_id: str, n: int) -> DataFrame:
    """Newest n items of a key in the probe's window, at or before the probe, as an array of (time, item)."""
    span = window_us + 1
    f = _with_time(facts, ts, span).select(*keys, "_b", "_t", F.col(item).alias("_i"))
    newest = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(F.desc("_t"), F.desc("_i")))
    tail = f.withColumn("_r", newest).where(F.col("_r") <= n).drop("_r").withColumn("_b", F.col("_b") + 1)
    none = F.lit(None).cast(dict(probes.dtypes)[probe_id]).alias(probe_id)
    rows = f.unionByName(tail).select("*", none, F.lit(0).alias("_o"))
    # a probe sorts after every fact of its own time
    asks = _with_time(probes, ts, span).select(*keys, "_b", "_t", F.lit(None).cast(dict(f.dtypes)["_i"]).alias("_i"), probe_id, F.lit(1).alias("_o"))
    rows = rows.unionByName(asks)
    # facts are numbered apart from probes, so a frame of n facts can be looked up by number
    to_now = Window.partitionBy(*keys, "_b").orderBy("_t", "_o", "_i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_k", F.sum(1 - F.col("_o")).over(to_now))
    frame = Window.partitionBy(*keys, "_b").orderBy("_k").rangeBetween(-(n - 1), 0)
    got = F.collect_list(F.when(F.col("_o") == 0, F.struct(F.col("_t").alias("t"), F.col("_i").alias("i")))).over(frame)
    out = rows.withColumn("_got", got).where(F.col("_o") == 1)
    return out.select(probe_id, F.filter("_got", lambda s: s["t"] >= F.col("_t") - window_us).alias("recent"))
