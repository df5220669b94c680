"""Work that is done once per row, however many readers follow, and tasks and lists that stay bounded."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from watchtide.functions import timeline as T
from watchtide.operators import models as M, netfeatures as W, triage as G
from watchtide.operators.investigate import attack_graph as K, signals as S
from watchtide.plans import ingest, investigate, models, roundtrip, streams, triage
from watchtide.sources.views import Tables
from watchtide.streaming import connections as C


@pytest.fixture()
def tables(spark, tmp_path):
    rnd, kinds = random.Random(3), ["error", "view", "signup", "purchase", "click"]
    rows = [(k, dt.datetime(2024, 1, 1 + k % 3, k % 24, rnd.randrange(60), k % 60), rnd.randrange(90), kinds[rnd.randrange(5)], round(rnd.random() * 500, 2), "{}") for k in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(1).write.parquet(f"{tmp_path}/part.parquet")  # a view's column has this table's name
    return Tables(spark, str(tmp_path))


def test_messages_are_parsed_once_for_all_types(tables):
    for query in (roundtrip.project_event, ingest.route_by_type):
        out = query(tables)
        assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()
        kinds = {r["event_type"] for r in out.select("event_type").distinct().collect()}
        assert kinds == {"security", "process", "network", "raw"}
        kept = ingest.classified(tables).where("event_type <> 'raw' OR level <> 'DEBUG'")
        assert out.select("event_id", "event_type").exceptAll(kept.select("event_id", "event_type")).isEmpty() and out.count() == kept.count()


def test_isolation_forest_scores_a_row_once(spark, monkeypatch):
    seen, real = spark.sparkContext.accumulator(0), M.path_score

    def counted(df, *args, **more):
        out = real(df, *args, **more)

        def tally(batches):
            for rows in batches:
                seen.add(len(rows))
                yield rows

        return out.mapInPandas(tally, out.schema)

    monkeypatch.setattr(M, "path_score", counted)
    df = spark.range(2000).select((F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 13).cast("double").alias("b"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    forest, found = M.train_isolation_forest(df, ["a", "b"], "label", trees=5, sample=32)
    assert len(forest) == 5 and seen.value == 2000 and 0 <= found["threshold"] <= 1


def test_isolation_paths_by_hand():
    import numpy as np

    tree = {"d": [0], "w": [1.0], "c": 0.5, "l": {"n": 1}, "r": {"d": [1, 0], "w": [1.0, 0.0], "c": 0.0, "l": {"n": 2}, "r": {"n": 1}}}
    x = np.array([[0.0, 9.0], [1.0, -1.0], [1.0, 1.0]])
    assert M._lengths(tree, x).tolist() == [1.0, 3.0, 2.0] and len(M._lengths(tree, x[:0])) == 0


def test_connection_windows_shuffle_what_is_read(tables):
    plan = W.conn_window_2s(tables.network.withColumn("unread", F.col("event_id") * 7)).select("event_id", "count")._jdf.queryExecution().optimizedPlan().toString()
    assert "unread" not in plan and "geo_country" not in plan


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rule_sweeps_do_not_carry_the_text(spark):
    at = dt.datetime(2024, 1, 1)
    alerts = spark.createDataFrame([(1, "h", "a", at, "Login FAILED again")], "event_id long, hostname string, source_ip string, timestamp timestamp, message string")
    net = spark.createDataFrame([(9, at, "h", "a", "d", 445, "TCP", "", "x")], "event_id long, timestamp timestamp, hostname string, src_ip string, dst_ip string, dst_port int, protocol string, dns_query string, detection_rule string")
    packs = {"one": S.Rule("one", "t", "low", "c", ("login failed",), where="dst_port = 445"), "both": S.Rule("both", "t", "low", "c", ("login", "absent"), condition="and"), "any": S.Rule("any", "t", "low", "c", ("absent", "failed"))}
    out = S.sigma_rules(alerts, net, packs).select("event_id", "sigma_hits.rule_id")
    assert "message" not in plan_of(out).split("Union")[0]  # above the sweep's shuffle
    assert [tuple(r) for r in out.collect()] == [(1, ["one", "any"])]


def test_values_of_a_window_need_no_running_rows(spark):
    """Also before 1970, and for null keys, values and ids."""
    rnd = random.Random(6)
    seconds = lambda: dt.datetime(1970, 1, 1) + dt.timedelta(seconds=rnd.randrange(-40, 40))
    facts = [(rnd.choice(["x", "y", None]), rnd.choice(["p", "q", "r", None]), seconds()) for _ in range(60)]
    probes = [(k if k % 7 else None, rnd.choice(["x", "y", None]), seconds()) for k in range(60)]
    out = T.window_values(spark.createDataFrame(probes, "id long, k string, ts timestamp"), spark.createDataFrame(facts, "k string, v string, ts timestamp"), "k", "ts", 9_000_000, "v", "id")
    assert "Window" not in plan_of(out)
    want = {(i, v) for i, k, t in probes if i is not None and k for k2, v, s in facts if k2 == k and 0 <= (t - s).total_seconds() <= 9}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)


def test_scores_are_joined_once_for_all_signals(tables, monkeypatch):
    calls, real = [], investigate.scored
    monkeypatch.setattr(investigate, "scored", lambda t: calls.append(1) or real(t))
    monkeypatch.setattr(investigate, "gather_signals", lambda alerts, network, facts, *rest, **more: (alerts, facts))
    for c in ("region", "nation", "customer", "supplier"):
        tables.spark.sql("SELECT 1L AS c_nationkey, 1L AS s_nationkey").write.mode("overwrite").parquet(f"{tables.sf_dir}/{c}.parquet")
    alerts, facts = investigate.all_signals(tables)
    assert len(calls) == 1 and facts.count() == 400
    assert alerts.exceptAll(investigate.alerts(tables)).isEmpty() and alerts.count() == investigate.alerts(tables).count() > 0


def routes(df):
    return sorted(map(tuple, df.collect()))


def test_stream_input_of_many_files_is_ten_batches(tables, monkeypatch):
    """Parts of several files, some of them without a row, still come one after another."""
    monkeypatch.setattr(streams, "FILE_ROWS", 10)
    got = streams.stream_conn_features(tables)
    want = G.network_features(tables.network).select(*got.columns)
    assert routes(got.where("event_id >= 0")) == routes(want)
    where = got.inputFiles()[0].split("/out/")[0]
    assert len(tables.spark.read.parquet(f"{where}/in").inputFiles()) == 40


def test_context_of_a_batch(tables, tmp_path):
    """A batch meets the context of its times, and that of ids that come twice; nothing else."""
    spark, base = tables.spark, tables.base("events")
    again = base.where("event_id % 50 = 0").withColumn("ts", F.expr("ts + INTERVAL 1 DAY"))
    lost = base.where("event_id % 50 = 1").withColumn("event_id", F.lit(None).cast("long"))
    base.unionByName(again).unionByName(lost).unionByName(base.where("event_id = 3")).write.parquet(f"{tmp_path}/more/events.parquet")
    spark.range(1).write.parquet(f"{tmp_path}/more/part.parquet")
    t = Tables(spark, f"{tmp_path}/more")
    add = streams.dated_context(t)
    for day in ("2024-01-01", "2024-01-03", "2025-01-01"):
        batch = G.network_features(t.network).where(F.to_date("timestamp") == day)
        assert routes(add(batch).select("event_id", "source_ip", "count", "template_rarity")) == routes(triage.with_context(t, batch).select("event_id", "source_ip", "count", "template_rarity"))


class Kept:
    """Stand-in for a state variable."""

    def __init__(self):
        self.rows = None

    def exists(self):
        return self.rows is not None

    def get(self):
        return self.rows if self.rows is not None else []

    def update(self, row):
        self.rows = row

    put = update

    def appendValue(self, row):
        self.rows = [*(self.rows or []), row]

    def clear(self):
        self.rows = None


class Handle:
    def __getattr__(self, name):
        return (lambda *_: Kept()) if name.startswith("get") else (lambda *_: None)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_destination_keeps_and_sends_pieces():
    import numpy as np
    import pandas as pd

    rng, size = np.random.default_rng(4), 3 * C.PIECE + 17
    rows = pd.DataFrame({"dst_ip": "x", "at": 0, "t": rng.integers(0, 50_000_000, size), "id": np.arange(size), "src": rng.choice(["a", "b", None], size), "service": rng.choice(["y", "z"], size),
                         "syn": rng.integers(0, 2, size), "rej": rng.integers(0, 2, size)})
    rows["payload"] = rows["id"].astype(str)
    one = C.ConnectionWindows(100, 2_000_000, 10**12)
    one.init(Handle())
    assert list(one.handleInputRows(("x",), iter([rows[:25_000], rows[25_000:]]), None)) == []
    assert len(one.waiting.get()) == 4 and all(len(C._unpack(b)) <= C.PIECE for (b,) in one.waiting.get())
    out = [*one.handleExpiredTimer(("x",), Now(20_000), None)]
    left = [C._unpack(b) for (b,) in one.waiting.get()]
    assert max(map(len, out)) <= C.PIECE and sum(map(len, left)) == (rows["t"] > 20_000_000).sum()
    out += [*one.handleExpiredTimer(("x",), Now(60_000), None)]
    assert not one.waiting.exists()
    got = pd.concat(out).assign(id=lambda x: x["payload"].astype(int)).sort_values("id", ignore_index=True)
    line = rows.sort_values(["t", "id"], kind="stable", ignore_index=True)
    want = pd.concat([line[["id"]], C.features(line)], axis=1).sort_values("id", ignore_index=True)
    assert got[want.columns].equals(want)


def test_isolation_walk_equals_recursion():
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 5)) * [1, 100, 1, 1e6, 1]
    tree = M._grow(x[:256], 0, 8, np.random.default_rng(5), 2)

    def length(node, row, depth=0):
        if "n" in node:
            return depth + M._mean_path(node["n"])
        side = sum(row[d] * w for d, w in zip(node["d"], node["w"])) <= node["c"]
        return length(node["l"] if side else node["r"], row, depth + 1)

    assert M._walk(M._flat(tree), x).tolist() == [length(tree, row) for row in x]
    assert M._lengths({"n": 3}, x[:2]).tolist() == [M._mean_path(3)] * 2


class Called(Exception):
    pass


def whole_job(spark, monkeypatch, query, **wanted):
    """The query trains with the operator's own rounds, trees, depths and samples."""
    import inspect

    real = getattr(M, query)

    def called(*args, **more):
        given = inspect.signature(real).bind(*args, **more)
        given.apply_defaults()
        raise Called({k: given.arguments[k] for k in wanted})

    monkeypatch.setattr(M, query, called)
    monkeypatch.setattr(models, "training_features", lambda t: spark.range(3))
    monkeypatch.setattr(models, "assembled", lambda t: spark.range(3))
    with pytest.raises(Called) as found:
        getattr(models, query)(None)
    assert found.value.args[0] == wanted


def test_isolation_forest_is_whole(spark, monkeypatch):
    whole_job(spark, monkeypatch, "train_isolation_forest", trees=300, sample=256)


def test_supervised_rounds_are_whole(spark, monkeypatch):
    whole_job(spark, monkeypatch, "train_supervised", rounds=100, depth=6)


def test_verdict_rounds_are_whole(spark, monkeypatch):
    whole_job(spark, monkeypatch, "train_verdict_model", rounds=300, depth=6)


def test_graph_text_cleans_only_what_can_be_unclean(spark):
    row = {
        "event_id": 7, "hostname": "web-1 [a]", "source_ip": None, "user_id": "", "adjusted_score": 0.9, "finding_type": "ACTIVE_CAMPAIGN", "hunter_score": 0.5, "model_used": "heuristic",
        "related_alert_ids": [12, -3], "related_hosts": ["db|2", "x"], "is_campaign": 1, "campaign_id": "c#1", "campaign_host_count": 2, "campaign_tactic_count": 2, "temporal_escalation_count": 1, "temporal_unique_categories": 1,
        "temporal_mean_score": 0.25, "graph_has_ioc_neighbor": 1,
    }
    zero = ["spc_is_anomaly", "graph_unique_destinations", "graph_hop_count", "similarity_confirmed_neighbor_count", "mitre_match_count"]
    real = ["spc_z_score", "spc_baseline_mean", "spc_baseline_stddev", "graph_lateral_movement_score", "graph_c2_candidate_score", "similarity_min_confirmed_dist", "similarity_label_confidence"]
    row |= {c: 0 for c in zero} | {c: 0.0 for c in real}
    kinds = {str: "string", int: "long", float: "double", type(None): "string"}
    schema = ", ".join(f"{k} {'array<long>' if k == 'related_alert_ids' else 'array<string>' if k == 'related_hosts' else kinds[type(v)]}" for k, v in row.items())
    df = spark.createDataFrame([tuple(row.values())], schema).withColumns({
        "sigma_hits": F.expr("array(named_struct('rule_id', 'r-1', 'title', 'T (x)', 'severity', 4, 'category', 'c'))"), "mitre_matches": F.expr("array(named_struct('rule_id', 'a', 'tactic', 'lateral-movement', 'technique', 'T1', 'confidence', 0.5D))")})
    out = K.attack_graph_mermaid(K.with_graph(df))
    lines = out.first()["mermaid"].split("\n")
    for line in ('    alert_0_12(["alert 12"])', '    alert_1__3(["alert -3"])', '    alert_1__3 -.->|"correlated"| temporal_summary', '    camp_host_0_db_2(["db2"])', '    campaign -->|"coordinated"| camp_host_0_db_2',
                 '    sigma_0_r_1[/"SIGMA: T x<br/>severity: critical"/]', '    sigma_0_r_1 -.->|"triggers"| mitre_lateral_movement', '    host_web_1__a_ -->|"campaign c1"| campaign', '    graph_ioc{{"IOC Neighbour Detected"}}'):
        assert line in lines, line
    assert lines[-3:] == [f"    style {x},stroke:#333,color:#fff" for x in ("sigma_0_r_1 fill:#dc3545", "graph_ioc fill:#ff0000", "campaign fill:#ff4500")]
    # ids are cleaned when they are made, and whole numbers need no pattern
    text = spark.createDataFrame([], K.with_graph(df).schema)
    assert "A-Za-z0-9_" not in K.attack_graph_mermaid(text)._jdf.queryExecution().analyzed().toString()


def test_streamed_investigation_reads_scores_that_were_joined_once(spark, monkeypatch, tmp_path):
    from types import SimpleNamespace

    rows = spark.range(5).select(F.col("id").alias("event_id"), *[F.lit(c).alias(c) for c in investigate.FACTS[1:]])

    def signals(alerts, network, facts, *rest, **more):
        raise Called(facts)

    monkeypatch.setattr(streams, "scored", lambda t: rows.join(rows.select("event_id", F.lit("m").alias("message")), "event_id"))
    monkeypatch.setattr(streams, "network", lambda t: None)
    monkeypatch.setattr(streams, "actions", lambda t: None)
    monkeypatch.setattr(streams, "place", lambda t: str(tmp_path))
    monkeypatch.setattr(streams, "gather_signals", signals)
    monkeypatch.setattr(streams.P, "stream_investigation", lambda scored, signals, out, offsets: signals(scored))
    with pytest.raises(Called) as found:
        streams.stream_investigation(SimpleNamespace(spark=spark, iocs=None))
    facts = found.value.args[0]
    assert "Join" not in facts._jdf.queryExecution().analyzed().toString() and facts.columns == investigate.FACTS
    assert facts.orderBy("event_id").collect() == rows.orderBy("event_id").collect()
