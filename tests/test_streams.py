"""Streams with state: out of order, late and repeated rows over many batches, against the batch results."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from watchtide.operators import triage as G
from watchtide.operators.netfeatures import conn_window_100
from watchtide.streaming import connections as C, rollups as R

KINDS = "event_id long, s double, src_ip string, dst_ip string, dst_port int, bytes_sent long, bytes_received long, duration_ms long, message string"
T0 = 1_700_000_000
WINDOWS = ["count", "srv_count", "same_srv_rate", "diff_srv_rate", "serror_rate", "rerror_rate", "dst_host_count", "dst_host_srv_count"]


def connections(rnd, n, sources=30):
    """One destination has a third of all rows, one comes back after a pause, and times repeat."""
    out = []
    for k in range(n):
        dst = rnd.choice(["hot", "hot", "a", "b", "c", None])
        s = T0 + rnd.choice([rnd.random() * 900, float(rnd.randrange(900))])
        out.append((k, s, rnd.choice([*(f"s{i}" for i in range(sources)), "s0", "s0", None]), dst, rnd.choice([22, 80, 80, 443, 9999]), rnd.choice([0, 5]), 0, rnd.choice([0, 3]), rnd.choice(["ok", "SYN timeout", "connection refused", None])))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, KINDS).withColumn("timestamp", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s")


def feed(spark, tmp_path, batches):
    for k, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = frame(spark, batches[0]).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def rows_of(df):
    return sorted(tuple(r[c] for c in ["event_id", "timestamp", "message", "service", "error_type", *WINDOWS]) for r in df.select("event_id", "timestamp", "message", "service", "error_type", *WINDOWS).collect())


def test_windows_of_shuffled_input_are_those_of_the_batch(spark, tmp_path):
    rnd = random.Random(3)
    rows = connections(rnd, 3000)
    arrival = sorted(rows, key=lambda r: r[1] + rnd.random() * 100)
    batches = [arrival[k * 300 : k * 300 + 300] for k in range(10)]
    end = (-1, T0 + 5000.0, "x", "end", 1, 1, 1, 1, "end")
    batches.append([end])
    stream = feed(spark, tmp_path, batches)
    C.stream_conn_features(stream, f"{tmp_path}/out", f"{tmp_path}/cp", delay="110 seconds").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.groupBy("batch").count().count() >= 8  # rows come out as the watermark passes them
    a, b = rows_of(got.where("event_id >= 0")), rows_of(G.network_features(frame(spark, rows)))
    assert len(a) == len(b)
    assert [(x, y) for x, y in zip(a, b) if x != y][:2] == []
    # after a stop the state goes on
    more = connections(rnd, 200)
    more = [(5000 + r[0], r[1] + 5100, *r[2:]) for r in more]
    feed(spark, tmp_path, [more, [(-2, T0 + 9000.0, "x", "end", 1, 1, 1, 1, "end")]])
    C.stream_conn_features(stream, f"{tmp_path}/out", f"{tmp_path}/cp", delay="110 seconds").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").where("event_id >= 0")
    assert rows_of(got) == rows_of(G.network_features(frame(spark, rows + more)))


def test_quiet_destinations_are_forgotten(spark, tmp_path):
    def burst(first, at, dst):
        return [(first + k, at + k * 0.1, f"s{k}", dst, 80, 1, 1, 1, "m") for k in range(5)]

    batches = [burst(0, T0, "a"), burst(10, T0 + 100, "b"), burst(20, T0 + 10_000, "b"), burst(30, T0 + 10_100, "a"), [(-1, T0 + 20_000.0, "x", "end", 1, 1, 1, 1, "end")]]
    C.stream_conn_features(feed(spark, tmp_path, batches), f"{tmp_path}/out", f"{tmp_path}/cp", delay="1 second", keep="2 hours").awaitTermination()
    got = {r["event_id"]: r["dst_host_count"] for r in spark.read.parquet(f"{tmp_path}/out").where("event_id >= 0").collect()}
    assert len(got) == 20 and got[4] == 5 and got[34] == 5 and got[30] == 1 and got[24] == 5 and got[20] == 1


@pytest.mark.parametrize("n", [1, 3, 100])
def test_rank_sweep_counts_as_sets_do(spark, n):
    rnd = random.Random(n)
    rows = connections(rnd, 900, sources=6)
    got = {r["event_id"]: (r["dst_host_count"], r["dst_host_srv_count"]) for r in conn_window_100(frame(spark, rows), n=n, chunk=37 + n).collect()}
    df = conn_window_100(frame(spark, rows), n=n)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan
    by = {}
    for r in sorted(rows, key=lambda r: (int(r[1] * 1_000_000), r[0])):
        by.setdefault(r[3], []).append(r)
    for line in by.values():
        for i, r in enumerate(line):
            last = line[max(0, i - n + 1) : i + 1]
            assert got[r[0]] == (len({x[2] for x in last} - {None}), sum(x[4] == r[4] for x in last))


def test_features_of_one_destination():
    rng = np.random.default_rng(1)
    size, n, window = 700, 20, 50
    rows = pd.DataFrame({"t": np.sort(rng.integers(0, 2000, size)), "id": np.arange(size), "src": rng.choice(["a", "b", "c", None], size), "service": rng.choice(["x", "y", "z"], size), "syn": rng.integers(0, 2, size), "rej": rng.integers(0, 2, size)})
    got = C.features(rows, n, window)
    same = lambda a, b: a == b or (a is None and b is None)
    for i, r in rows.iterrows():
        seen = rows[(rows["t"] <= r["t"]) & (rows["t"] >= r["t"] - window) & np.array([same(x, r["src"]) for x in rows["src"]])]
        last = rows.iloc[max(0, i - n + 1) : i + 1]
        want = (len(seen), (seen["service"] == r["service"]).sum(), seen["syn"].sum() / len(seen), seen["rej"].sum() / len(seen), last["src"].nunique(), (last["service"] == r["service"]).sum())
        assert want == tuple(got.loc[i, ["count", "srv_count", "serror_rate", "rerror_rate", "dst_host_count", "dst_host_srv_count"]])


def events(rnd, n, first):
    return [(first + k, T0 + rnd.randrange(0, 3 * 86_400), f"s{rnd.randrange(4)}") for k in range(n)]


def test_compacted_rollups_over_many_batches(spark, tmp_path):
    """Late and repeated rows over twelve batches; readers list a bounded number of folders, also when a compaction is cut off."""
    rnd = random.Random(2)
    kinds = "event_id long, s long, source string"
    stamped = lambda rows: spark.createDataFrame(rows, kinds).select("event_id", "source", F.timestamp_seconds("s").alias("timestamp"))
    per_hour = lambda df: df.groupBy(F.window("timestamp", "1 hour").start.alias("hour"), "source").agg(F.count("*").alias("event_count"))
    rows, sizes, dedup = [], [], []
    for k in range(12):
        new = events(rnd, 40, k * 100) + rows[:: 7 + k]  # and copies of earlier ones
        stamped(new).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows += new
        s = lambda: spark.readStream.schema(stamped(new).schema).parquet(f"{tmp_path}/in")
        R.keep_rollup(s(), per_hour, f"{tmp_path}/out", f"{tmp_path}/cp", merge=R.merged_counts, every=3).awaitTermination()
        R.stream_dedup(s(), f"{tmp_path}/once", f"{tmp_path}/cp2").awaitTermination()
        sizes.append(len(R._folders(f"{tmp_path}/out")))
        if k == 7:  # a base that was not written to its end
            (tmp_path / "out/base/upto=7").mkdir(parents=True)
    got = sorted(map(tuple, R.read_rollup(spark, f"{tmp_path}/out", ["hour", "source"]).collect()))
    assert got == sorted(map(tuple, per_hour(stamped(rows)).collect()))
    assert max(sizes) <= 4 and len(list((tmp_path / "out/parts").glob("batch=*"))) <= 7 and len(list((tmp_path / "out/marks").glob("batch=*"))) <= 2
    once = [r["event_id"] for r in spark.read.parquet(f"{tmp_path}/once").collect()]
    assert sorted(once) == sorted({r[0] for r in rows})
