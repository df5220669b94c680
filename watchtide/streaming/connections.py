"""Connection windows of a stream, as keyed state with expiry.

A destination's rows wait in its state until the watermark has passed them; then nothing earlier can come, and they get the
same windows as in a batch, in whatever order they came. State holds the waiting rows, as they came, and of those done what a later
window can see: the last `n` - 1 rows and those of the last window. Only destinations with new or due rows are read or written.
An event-time timer wakes a destination when its first waiting row is due, and forgets it after `keep` without a row.

Defined cases: rows that come later than the delay are dropped by the watermark and counted in the progress of the query
(numRowsDroppedByWatermark); a destination that is quiet for longer than `keep` starts anew; null addresses are keys of their
own, a null source is no distinct one, as in the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from watchtide.functions.expr import micros
from watchtide.operators.netfeatures import HOST_WINDOW, TIME_WINDOW_US, conn_error_type, port_service

NOW = {"availableNow": True}
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A row's time with all its digits, through JSON and back.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: Rows of a destination that are packed together, and whose windows are computed at a time.
PIECE, PART = 10_000, 200_000
FEATURES = "count long, srv_count long, same_srv_rate double, diff_srv_rate double, serror_rate double, rerror_rate double, dst_host_count int, dst_host_srv_count int"


def features(rows: pd.DataFrame, n: int = HOST_WINDOW, window_us: int = TIME_WINDOW_US) -> pd.DataFrame:
    """Both windows of a destination's rows, ordered by (t, id)."""
    size = len(rows)
    place, t = np.arange(size), rows["t"].to_numpy(np.int64)
    t = t - (t[0] if size else 0)
    span = int(t[-1]) + window_us + 2 if size else 1
    code = lambda values: pd.factorize(values, use_na_sentinel=False)[0].astype(np.int64)

    def recent(group: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
        """Sums over the rows of the same group in the last window, rows of the same time included."""
        at = np.lexsort((t, group))
        line = group[at] * span + t[at]
        low, high = np.searchsorted(line, group * span + t - window_us), np.searchsorted(line, group * span + t, "right")
        low = np.maximum(low, np.searchsorted(line, group * span))
        sums = [np.concatenate([[0], np.cumsum(w[at])]) for w in weights]
        return [s[high] - s[low] for s in sums]

    source, service = code(rows["src"]), code(rows["service"])
    one = np.ones(size, np.int64)
    count, syn, rej = recent(source, [one, rows["syn"].to_numpy(np.int64), rows["rej"].to_numpy(np.int64)])
    (same,) = recent(code(source * (service.max(initial=0) + 1) + service), [one])
    # last n rows: a source counts from its row to its next one, n rows at most
    order = np.lexsort((place, source))
    following = np.full(size, size + n)
    close = source[order][1:] == source[order][:-1]
    following[order[:-1][close]] = order[1:][close]
    known = rows["src"].notna().to_numpy()
    ends = np.minimum(following, place + n)
    gone = np.bincount(ends[known], minlength=size + 1)[:size]
    hosts = np.cumsum(known) - np.cumsum(gone)
    order = np.lexsort((place, service))
    line = service[order] * (size + n) + place[order]
    alike = np.searchsorted(line, service * (size + n) + place, "right") - np.searchsorted(line, service * (size + n) + np.maximum(place - n + 1, 0))
    alike = np.where(rows["service"].notna(), alike, 0)
    return pd.DataFrame({"count": count, "srv_count": same, "same_srv_rate": same / count, "diff_srv_rate": 1 - same / count, "serror_rate": syn / count, "rerror_rate": rej / count, "dst_host_count": hosts.astype(np.int32), "dst_host_srv_count": alike.astype(np.int32)}, index=rows.index)


def _in_parts(rows: pd.DataFrame, n: int, window_us: int, part: int = PART) -> pd.DataFrame:
    """Features of ordered rows, so many at a time, each part with the rows before it that its windows reach."""
    t, found, a = rows["t"].to_numpy(), [], 0
    while a < len(rows):
        b = int(np.searchsorted(t, t[min(a + part, len(rows)) - 1], "right"))  # rows of one time see each other
        low = max(0, min(int(np.searchsorted(t, t[a] - window_us)), a - n + 1))
        found.append(features(rows.iloc[low:b], n, window_us).iloc[a - low :])
        a = b
    return pd.concat(found)


def _pack(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpack(blob: bytes, *columns: str) -> pd.DataFrame:
    """The rows, or only some of their columns."""
    names = pa.ipc.open_stream(blob).schema.names if columns else []
    return pa.ipc.open_stream(blob, options=pa.ipc.IpcReadOptions(included_fields=[names.index(c) for c in columns] if columns else None)).read_pandas()


#: Columns that windows read; the payload, most of a row, stays packed until its row goes out.
THIN = ("t", "id", "src", "service", "syn", "rej")


class ConnectionWindows(StatefulProcessor):
    """State of one destination: `waiting` (pieces of packed rows, a list that batches append to), `done` (packed) and `due` (first waiting and last time).

    A piece has at most `PIECE` rows. Of all waiting rows only what windows read is unpacked together; payloads are unpacked piece by piece.
    """

    def __init__(self, n: int, window_us: int, keep_us: int):
        self.n, self.window_us, self.keep_us = n, window_us, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.done = handle.getValueState("done", "rows binary")
        self.due = handle.getValueState("due", "first long, last long, timer long")

    def _wake(self, first: int | None, last: int) -> None:
        """One timer: for the first waiting row, else for forgetting."""
        at = (last + self.keep_us if first is None else first) // 1000 + 1
        before = self.due.get()[2] if self.due.exists() else None
        if before != at:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
        self.due.update((first, last, at))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = last = None
        for some in rows:
            for at in range(0, len(some), PIECE):
                new = some.iloc[at : at + PIECE].drop(columns=["dst_ip", "at"])
                self.waiting.appendValue((_pack(new),))
                low, high = int(new["t"].min()), int(new["t"].max())
                first, last = (low, high) if first is None else (min(first, low), max(last, high))
        if first is None:
            return iter(())
        if self.due.exists():
            known = self.due.get()
            first, last = min(first, first if known[0] is None else known[0]), max(last, known[1])
        self._wake(first, last)
        return iter(())

    def _keep(self, pieces: list[bytes], ready: list[np.ndarray]) -> list[tuple[bytes]]:
        """Pieces of the rows that are not ready, small ones put together."""
        kept, held, size = [], [], 0
        for blob, done in zip(pieces, ready):
            if done.all():
                continue
            held.append(_unpack(blob)[~done])
            size += len(held[-1])
            if size >= PIECE:
                kept.append((_pack(pd.concat(held)),))
                held, size = [], 0
        return kept + [(_pack(pd.concat(held)),)] if held else kept

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        pieces = [x[0] for x in self.waiting.get()]
        _, last, _ = self.due.get()
        self.due.update((None, last, None))  # this timer is gone
        if not pieces:
            if last + self.keep_us < now:
                for state in (self.waiting, self.done, self.due):
                    state.clear()
            else:
                self._wake(None, last)
            return
        thin = [_unpack(blob, *THIN) for blob in pieces]
        ready = [(x["t"] <= now).to_numpy() for x in thin]
        later = min((int(x["t"][~y].min()) for x, y in zip(thin, ready) if not y.all()), default=None)
        rows = [x[y].assign(piece=k, at=np.flatnonzero(y)) for k, (x, y) in enumerate(zip(thin, ready)) if y.any()]
        del thin
        if rows:
            if self.done.exists():
                rows.insert(0, _unpack(self.done.get()[0], *THIN).assign(piece=-1, at=0))
            rows = pd.concat(rows, ignore_index=True).sort_values(["t", "id"], kind="stable", ignore_index=True)
            t = rows["t"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(t) > self.keep_us) + 1).tolist(), len(rows)]  # after such a pause it starts anew
            found = pd.concat([_in_parts(rows[a:b], self.n, self.window_us) for a, b in zip(cuts[:-1], cuts[1:])])
            seen = ((np.arange(len(rows)) > len(rows) - self.n) & (np.arange(len(rows)) >= cuts[-2])) | (t >= now - self.window_us)
            self.done.update((_pack(rows.loc[seen, list(THIN)]),))
            piece, at = rows["piece"].to_numpy(), rows["at"].to_numpy()
            del rows
            order = np.argsort(piece, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(piece[order])) + 1):
                k = piece[mine[0]]
                if k < 0:
                    continue  # done before
                yield pd.concat([_unpack(pieces[k], "payload").iloc[at[mine]].reset_index(drop=True), found.iloc[mine].reset_index(drop=True)], axis=1)
        if later is not None:
            self.waiting.put(self._keep(pieces, ready))
            self._wake(later, last)
        else:
            self.waiting.clear()
            self._wake(None, last)

    def close(self) -> None:
        pass


def windowed_stream(network: DataFrame, ts: str = "timestamp", event_id: str = "event_id", delay: str = "10 seconds", keep: str = "7 days", n: int = HOST_WINDOW, window_us: int = TIME_WINDOW_US) -> DataFrame:
    """The stream's rows with both windows, each once, when the watermark has passed it."""
    spark = network.sparkSession
    keep_us = spark.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {keep}"))).first()[0]
    kind = network.schema[event_id].dataType
    least = F.lit("") if isinstance(kind, T.StringType) else F.lit(-(2**63)).cast(kind)
    error = conn_error_type()
    rows = network.withWatermark(ts, delay).select(
        "dst_ip", F.col(ts).alias("at"), micros(ts).alias("t"), F.coalesce(event_id, least).alias("id"), F.col("src_ip").alias("src"), port_service().alias("service"),
        (error == "syn_error").cast("int").alias("syn"), (error == "rej_error").cast("int").alias("rej"), F.to_json(F.struct(*network.columns), JSON).alias("payload"))
    processor = ConnectionWindows(n, window_us, keep_us)
    found = rows.groupBy("dst_ip").transformWithStateInPandas(processor, f"payload string, {FEATURES}", "Append", "EventTime")
    row = F.from_json("payload", network.schema, JSON)
    whole = found.select(row.alias("row"), *[c for c in found.columns if c != "payload"]).select("row.*", *[c for c in found.columns if c != "payload"])
    return whole.select(*network.columns, port_service().alias("service"), conn_error_type().alias("error_type"), *[c for c in found.columns if c != "payload"])


def stream_conn_features(network: DataFrame, out: str, checkpoint: str, ts: str = "timestamp", delay: str = "10 seconds", keep: str = "7 days", **trigger):
    """Connection windows written per micro-batch below its id, so a retry replaces its output."""
    spark = network.sparkSession
    if spark.conf.get(PROVIDER, "") != STORE:
        spark.conf.set(PROVIDER, STORE)  # lists and timers need it

    def work(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return windowed_stream(network, ts, delay=delay, keep=keep).writeStream.option("checkpointLocation", checkpoint).foreachBatch(work).trigger(**(trigger or NOW)).start()
