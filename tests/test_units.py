"""Operators on small hand-made frames, against brute force."""

import hashlib
import json
import math
import random
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from watchtide.functions import expr as X, ranking as K, timeline as T
from watchtide.operators import classify as C, converters as D, evaluate as E, evidence as V, lookups as J, netfeatures as W, normalize as N, search as S, templates as L, triage as G, typed as Y, vectors as Q, winevents as WE
from watchtide.operators.investigate import signals as I, verdict as H
from watchtide.sources import readers


def facts(spark, n=400, seed=1, span=60):
    """Events of few keys, one of which owns most of them."""
    rnd = random.Random(seed)
    rows = [(i, "hot" if rnd.random() < 0.7 else f"k{rnd.randint(0, 3)}", f"v{rnd.randint(0, 5)}", round(rnd.uniform(0, span), 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, k string, v string, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long") + 1_700_000_000_000_000))
    return rows, df


def test_sliding_sums_and_distinct_counts(spark):
    rows, df = facts(spark)
    span = 5_000_000
    out = T.sweep(df.select("id", "k", "ts"), ["k"], "ts", span, [T.sum_deltas(df, ["k"], "ts", span, {"n": F.lit(1)}), T.distinct_deltas(df, ["k"], "ts", span, {"d": F.col("v")})])
    got = {r["id"]: (r["n"], r["d"]) for r in out.collect()}
    for i, k, _, s in rows:
        inside = [r for r in rows if r[1] == k and s - 5 - 1e-9 <= r[3] <= s + 1e-9]
        assert got[i] == (len(inside), len({r[2] for r in inside}))


def test_window_values_and_recent(spark):
    rows, df = facts(spark, seed=2)
    span = 5_000_000
    probes = df.select("id", "k", "ts")
    got = {}
    for r in T.window_values(probes, df.select("k", "v", "ts"), "k", "ts", span, "v", "id").collect():
        got.setdefault(r["id"], set()).add(r["v"])
    recent = {r["id"]: [(x["t"], x["i"]) for x in r["recent"]] for r in T.window_recent(probes, df.select("k", "ts", F.col("id").alias("item")), ["k"], "ts", span, "item", "id", 7).collect()}
    for i, k, _, s in rows:
        inside = [r for r in rows if r[1] == k and s - 5 - 1e-9 <= r[3] <= s + 1e-9]
        assert got[i] == {r[2] for r in inside}
        newest = sorted(inside, key=lambda r: (r[3], r[0]))[-7:]
        assert [x[1] for x in recent[i]] == [r[0] for r in newest]


def test_segment_rank_and_last_n(spark):
    rows, df = facts(spark, seed=3)
    ranked = T.segment_rank(df, ["k"], ["ts", "id"], F.expr("unix_micros(ts) div 7000000"))
    out = T.last_n(ranked, ["k"], 10, {"m": lambda w: F.size(F.collect_set("v").over(w))}, chunk=16)
    got = {r["id"]: (r["rn"], r["m"]) for r in out.collect()}
    for key in {r[1] for r in rows}:
        mine = sorted([r for r in rows if r[1] == key], key=lambda r: (r[3], r[0]))
        for n, r in enumerate(mine):
            assert got[r[0]] == (n + 1, len({x[2] for x in mine[max(0, n - 9) : n + 1]}))


def test_connection_windows_do_not_depend_on_bucket_or_chunk(spark):
    rnd = random.Random(4)
    rows = [(i, f"s{rnd.randint(0, 2)}", "d0" if rnd.random() < 0.8 else "d1", rnd.choice([22, 80, 443]), rnd.randint(0, 20_000_000)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, src_ip string, dst_ip string, dst_port int, us long").withColumn("timestamp", F.timestamp_micros("us"))
    df = df.withColumns({"message": F.lit("x"), "bytes_sent": F.lit(1), "bytes_received": F.lit(1), "duration_ms": F.lit(5)})
    a = {r["event_id"]: (r["count"], r["srv_count"]) for r in W.conn_window_2s(df).collect()}
    for i, s, d, p, t in rows:
        inside = [r for r in rows if r[1] == s and r[2] == d and t - 2_000_000 <= r[4] <= t]
        assert a[i] == (len(inside), sum(r[3] == p for r in inside))
    b = [sorted((r["event_id"], r["dst_host_count"], r["dst_host_srv_count"]) for r in W.conn_window_100(df, n=20, bucket=u, chunk=c).collect()) for u, c in (("hour", 10_000), ("second", 32))]
    assert b[0] == b[1]


def merkle(leaves):
    depth = max(1, math.ceil(math.log2(len(leaves)))) if len(leaves) > 1 else 1
    level = leaves + [leaves[-1]] * (2**depth - len(leaves))
    while len(level) > 1:
        level = [hashlib.sha256((level[i] + level[i + 1]).encode()).hexdigest() for i in range(0, len(level), 2)]
    return level[0], depth


def test_merkle_roots_equal_a_plain_tree(spark):
    sizes = [1, 2, 3, 4, 5, 8, 31, 1024, 1025, 2500]
    rows = [(n, i, hashlib.sha256(f"{n}-{i}".encode()).hexdigest()) for n in sizes for i in range(n)]
    out = V.merkle_roots(spark.createDataFrame(rows, "b int, idx long, leaf string"), ["b"]).collect()
    assert len(out) == len(sizes)
    for r in out:
        assert (r["root"], r["merkle_depth"]) == merkle([x[2] for x in rows if x[0] == r["b"]])


def test_segments_and_rounds_follow_the_largest_batch(spark, monkeypatch):
    rows = [(b, f"e{i}") for b, n in ((0, 3000), (1, 1), (2, 7)) for i in range(n)]
    leaf = spark.createDataFrame(rows, "b int, event_id string").withColumn("leaf", F.sha2("event_id", 256)).repartition(5)
    plain = V.number_leaves(leaf, ["b"])
    monkeypatch.setattr(V, "SEGMENT_LEAVES", 100)
    split = V.number_leaves(leaf, ["b"])
    assert sorted(map(str, plain.select("b", "idx", "event_id").collect())) == sorted(map(str, split.select("b", "idx", "event_id").collect()))
    want = {b: merkle([hashlib.sha256(e.encode()).hexdigest() for e in sorted(e for c, e in rows if c == b)]) for b in range(3)}
    assert {r["b"]: (r["root"], r["merkle_depth"]) for r in V.merkle_roots(split, ["b"]).collect()} == want
    small = split.where("b > 0")
    assert {r["b"]: (r["root"], r["merkle_depth"]) for r in V.merkle_roots(small, ["b"]).collect()} == {b: want[b] for b in (1, 2)}
    rounds = [V.merkle_roots(plain, ["b"], largest=n)._jdf.queryExecution().analyzed().toString().count("collect_list") for n in (1024, 1025, 2**20 + 1)]
    assert rounds == [1, 2, 3]
    assert V.merkle_roots(split.where("b > 5"), ["b"]).count() == 0


def test_changed_event_fails_verification(spark):
    ev = spark.createDataFrame([(i, i * 400, f"m{i}") for i in range(40)], "event_id int, s int, message string")
    ev = ev.select("event_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("timestamp"), F.lit("src").alias("source"), F.lit("INFO").alias("level"), "message")
    anchors = V.anchor_batches(V.leaves(ev, "raw_logs"))
    good = V.verify_batches(anchors, {"raw_logs": ev}).collect()
    assert len(good) == 9 and all(r["verified"] == 1 for r in good)
    bad = V.verify_batches(anchors, {"raw_logs": ev.withColumn("message", F.when(F.col("event_id") == 7, "changed").otherwise(F.col("message")))}).collect()
    assert sum(r["verified"] == 0 for r in bad) == 1


def test_uuid5_and_ip(spark):
    df = spark.createDataFrame([("raw-logs:3:17",), ("x",), ("10.0.0.1_15",)], "n string")
    for r in df.select("n", X.uuid5("n").alias("u")).collect():
        assert r["u"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, r["n"]))
    ips = spark.createDataFrame([("1.2.3.4",), ("300.1.1.1",), ("abc",)], "ip string").select(X.ip_to_long("ip").alias("n")).collect()
    assert [r["n"] for r in ips] == [16909060, None, None]


@pytest.mark.parametrize("message,expected", [
    ("Failed password for root", ("security", "auth", 3, "T1078")), ("account locked", ("security", "auth", 4, "T1110")), ("session opened for x", ("security", "auth", 1, "T1078")),
    ("ransomware seen", ("security", "malware", 4, "T1059")), ("data leak", ("security", "exfiltration", 4, "T1041")), ("syn flood", ("security", "network-attack", 3, "T1046")),
    ("lateral movement", ("security", "network-attack", 3, "T1021")), ("dns tunnel and lateral movement", ("security", "network-attack", 3, "T1071.004")), ("nftables drop", ("security", "firewall", 2, "T1562")),
    ("x" * 600 + " malware", ("security", "malware", 4, "T1059")), ("connection was blocked", ("security", "firewall", 2, "T1562")), ("process started", ("process", None, 0, None)), ("udp listen on 5", ("network", None, 0, None)),
])
def test_classification_branches(spark, message, expected):
    df = spark.createDataFrame([(json.dumps({"message": message}),)], "value string").withColumn("ingest_ts", F.current_timestamp())
    r = C.classify(N.normalize(N.parse_messages(df))).first()
    assert (r["event_type"], r["category"], r["severity"], r["mitre_technique"]) == expected


@pytest.mark.parametrize("binary,args,parent,rule", [
    ("C:\\a\\certutil.exe", "", "", "lolbin_certutil"), ("C:\\powershell.exe", "-NoP -enc", "", "suspicious_powershell"), ("C:\\x.exe", "net user", "", "recon_net_user"), ("C:\\x.exe", "arp -a", "", "recon_arp_a"),
    ("C:\\mimikatz.exe", "whoami", "", "credential_dumping"), ("C:\\cmd.exe", "", "C:\\WINWORD.EXE", "office_macro_spawn"), ("C:\\Temp\\mimikatz.exe", "", "", "exec_from_suspicious_path"), ("C:\\ok.exe", "", "", ""),
])
def test_last_process_rule_wins(spark, binary, args, parent, rule):
    df = spark.createDataFrame([(binary, args, parent)], "binary_path string, arguments string, parent_binary string")
    assert WE.suspicious_process(df).first()["detection_rule"] == rule


def test_events_are_conserved(spark):
    """Typed rows plus dead letters are the input."""
    values = ['{"message":"a"}', "broken", '{"message":"b","metadata":{"user_id":"u"}}', "[1,2]", '{"timestamp":5}']
    df = spark.createDataFrame([(v,) for v in values], "value string").withColumns({"topic": F.lit("raw-logs"), "ingest_ts": F.current_timestamp()})
    rows, dead = Y.typed_rows(df, "raw_logs"), Y.dead_letters(df)
    assert rows.count() + dead.count() == len(values) and dead.count() == 2
    assert [r["user_id"] for r in rows.where("message = 'b'").collect()] == ["u"]


def test_asset_patterns(spark):
    hosts = spark.createDataFrame([("db-1",), ("DB-prod-2",), ("web-1",), ("",), ("x_y",)], "hostname string")
    assets = spark.createDataFrame([("db-%", 1.5), ("%prod%", 2.0), ("web-_", 1.2), ("db-prod%", 3.0)], "hostname_pattern string, multiplier double")
    got = {r["hostname"]: r["asset_multiplier"] for r in J.asset_pattern_join(hosts, assets).collect()}
    assert got == {"db-1": 1.5, "DB-prod-2": 2.0, "web-1": 1.2, "": 1.0, "x_y": 1.0}


def test_template_properties(spark):
    lines = [f"user u{i} logged in from 10.0.0.{i}" for i in range(9)] + ["disk full on /a/b/c/d", "disk full on /a/b/c/e", "", "one two three"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id int, message string")
    out = {r["id"]: r for r in L.assign_templates(df, L.log_templates(df)).collect()}
    assert len(out) == len(lines) and len({out[i]["template_id"] for i in range(9)}) == 1
    assert out[0]["template"] == "user <*> logged in from <IP>" and out[9]["template_id"] == out[10]["template_id"] == out[9]["template_id"]
    assert out[11]["template_id"] == "empty" and abs(out[0]["template_rarity"] - (1 - 9 / 12)) < 1e-9


def test_exact_percentiles_and_samples(spark):
    rnd = random.Random(5)
    rows = [("a" if i % 3 else "b", round(rnd.random(), 4)) for i in range(999)]
    df = spark.createDataFrame(rows, "g string, s double")
    for r in K.exact_percentiles(df, ["g"], "s", {"p5": 0.05, "p50": 0.5, "p95": 0.95}).collect():
        mine = [s for g, s in rows if g == r["g"]]
        assert np.allclose([r["p5"], r["p50"], r["p95"]], np.percentile(mine, [5, 50, 95]))
    few = K.smallest_per_group(df, ["g"], ["s"], 10)
    for g in "ab":
        assert sorted(r["s"] for r in few.where(F.col("g") == g).collect()) == sorted(s for k, s in rows if k == g)[:10]


def test_auc_against_pairs(spark):
    rnd = random.Random(6)
    rows = [(round(rnd.random(), 2), rnd.randint(0, 1)) for _ in range(300)]
    got = E.auc_ap(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()["auc_roc"]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert abs(got - np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])) < 1e-9


@pytest.mark.parametrize("metric,same,skip", [("l2", None, False), ("cosine", None, False), ("l2", "g", False), ("l2", None, True)])
def test_knn_equals_numpy(spark, monkeypatch, metric, same, skip):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(60, 8)), rng.normal(size=(90, 8)) * 0.05 + 3, np.zeros((2, 8)), np.ones((3, 8))]).astype("float32")
    g = rng.integers(0, 3, len(x))
    df = spark.createDataFrame([(i, int(g[i]), [float(v) for v in x[i]]) for i in range(len(x))], "vec_id long, g int, embedding array<float>").repartition(5)
    monkeypatch.setattr(Q, "MOST_ROWS", 16)
    got = {}
    for r in Q.knn_join(df, df, 4, "vec_id", "vec_id", metric=metric, same=same, skip_self=skip).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    d = np.round(Q._distances(x.astype(float), x.astype(float), metric), 9)
    for i in range(len(x)):
        allowed = [j for j in range(len(x)) if (same is None or g[i] == g[j]) and not (skip and i == j)]
        assert [j for _, j in sorted(got[i])] == sorted(allowed, key=lambda j: (d[j, i], j))[:4]
    assert Q.knn_join(df, df.limit(0), 4, "vec_id", "vec_id").count() == 0


def test_knn_join_of_copies_in_many_blocks(spark, monkeypatch):
    """A third of the rows is one vector, other vectors occur twice, numbers are doubles; queries that are done early take no part in later rounds."""
    rng = np.random.default_rng(17)
    centres = rng.normal(size=(5, 6)) * 20
    y = centres[rng.integers(0, 5, 70)] + rng.normal(size=(70, 6))
    x = np.concatenate([y, y, np.tile(rng.normal(size=6), (70, 1))])
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))], "vec_id long, embedding array<double>").repartition(4)
    monkeypatch.setattr(Q, "MOST_ROWS", 24)
    d = np.round(Q._distances(x, x, "l2"), 9)
    got = {}
    for r in Q.knn_join(df, df, 3, "vec_id", "vec_id").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"]))
    for i in range(len(x)):
        assert np.allclose([v for _, v in sorted(got[i])], np.sort(d[:, i])[:3], atol=1e-6)


def test_folding_keeps_the_smaller_id_and_the_limit():
    x = np.array([[1.0], [0.0], [1.0], [2.0], [0.0]])
    ids, q = np.array([9, 4, 7, 1, 3]), np.array([[0.0], [0.0]])
    best_d, best_i = np.full((2, 3), np.inf), np.full((2, 3), Q._NONE, dtype=np.int64)
    limit = np.array([np.inf, 0.5])
    for part in (slice(0, 2), slice(2, 5)):
        Q._fold(x[part], ids[part], q, np.array([0, 1]), 3, "l2", limit, best_d, best_i)
    assert best_i[0].tolist() == [3, 4, 7] and best_d[0].tolist() == [0, 0, 1]
    assert best_i[1].tolist() == [3, 4, Q._NONE] and best_d[1].tolist() == [0, 0, np.inf]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("away", [0.0, 1e4, 1e20])
def test_candidates_in_single_precision_lose_no_neighbour(metric, away):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 7)), np.zeros((3, 7)), rng.normal(size=(3, 7)) * 1e-9]) + away
    d = Q._distances(x[:80], x, metric)
    worst = np.sort(d, axis=1)[:, 4]
    pairs = Q._near(x, x[:80], worst, metric)
    assert set(np.flatnonzero(d <= worst[:, None])) <= set(pairs)
    assert away or len(pairs) < 80 * 40
    at, j = np.divmod(pairs, len(x))
    assert np.allclose(Q._between(x[j], x[:80][at], metric), d[at, j], rtol=0, atol=1e-9 * max(1.0, away) ** 2)


def test_rows_meet_few_centres_at_a_time(monkeypatch):
    """What a task holds while it looks for centres does not grow with its batch."""
    seen, real = [], Q._gaps
    monkeypatch.setattr(Q, "_gaps", lambda x, centres: seen.append(len(x)) or real(x, centres))
    rng = np.random.default_rng(6)
    x, centres = rng.normal(size=(1000, 5)), rng.normal(size=(9, 5))
    c, gap = Q._nearest(x, centres)
    d = real(x, centres)
    assert max(seen) <= Q._VISITORS and (c == d.argmin(1)).all() and np.allclose(gap, d.min(1))


def test_short_lists_are_compared_together():
    runs = Q._runs(np.array([2, 0, 3, 1]), np.array([600, 400, 300, 5000]))
    assert [r.tolist() for r in runs] == [[2, 0], [3], [1]]


def test_ann_recall(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8)) * 5
    x = (centres[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8))).astype("float32")
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(300)], "vec_id long, embedding array<float>")
    exact = {(r["query_id"], r["id"]) for r in Q.knn_join(df, df, 5, "vec_id", "vec_id").collect()}
    found = {(r["query_id"], r["id"]) for r in Q.ann_search(df, df, 5, "vec_id", "vec_id", share=0.5).collect()}
    assert len(exact & found) / len(exact) > 0.9


def test_ann_search_as_registered_finds_neighbours_without_clusters(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(600, 32)).astype("float32"))], "vec_id long, embedding array<float>")
    exact = {(r["query_id"], r["id"]) for r in Q.knn_join(df, df, 10, "vec_id", "vec_id").collect()}
    found = {(r["query_id"], r["id"]) for r in Q.ann_search(df, df, 10, "vec_id", "vec_id").collect()}
    assert found == exact


def test_vector_filter_refuses_other_text(spark):
    df = spark.createDataFrame([(1, "a")], "severity int, hostname string")
    assert S.vector_filter(df, "severity >= 1 AND hostname = 'a'", ["severity", "hostname"]).count() == 1
    for text in ("1=1", "severity >= 1; DROP TABLE x", "other = 1", "severity >= (select 1)"):
        with pytest.raises(ValueError):
            S.vector_filter(df, text, ["severity", "hostname"])


def test_rules_can_be_registered(spark):
    with pytest.raises(ValueError):
        I.register_rule({"id": "x"})
    rule = I.Rule("r1", "Both", "low", "t", keywords=("alpha", "beta"), condition="and", where="dst_port = 22", more_than=1)
    alerts = spark.createDataFrame([(1, "h", "1.1.1.1", "alpha beta", "2024-01-01 00:10:00"), (2, "h", "1.1.1.1", "alpha", "2024-01-01 00:10:00")], "event_id long, hostname string, source_ip string, message string, ts string").withColumn("timestamp", F.to_timestamp("ts"))
    net = spark.createDataFrame([("h", "1.1.1.1", 22, f"2024-01-01 00:0{i}:00") for i in range(3)], "hostname string, src_ip string, dst_port int, ts string").withColumn("timestamp", F.to_timestamp("ts"))
    got = {r["event_id"]: r["sigma_hit_count"] for r in I.sigma_rules(alerts, net, {"r1": rule}).collect()}
    assert got == {1: 1, 2: 0}


def test_heuristic_weights_are_pinned():
    assert len(H.FEATURE_ORDER) == 42
    assert round(sum(abs(w) for _, w, _ in H.FEATURES), 6) == 1.08
    inverted = [n for n, w, _ in H.FEATURES if "dist" in n and w > 0]
    assert "distinct_categories" in inverted


def test_scores_do_not_depend_on_the_batch(spark):
    df = spark.createDataFrame([(i, i / 10, 1 - i / 10, 0.5) for i in range(11)], "id int, lgbm_score double, eif_score double, arf_score double")
    whole = {r["id"]: r["combined_score"] for r in G.score_fusion(df).collect()}
    part = {r["id"]: r["combined_score"] for r in G.score_fusion(df.where("id > 6")).collect()}
    assert all(abs(whole[i] - s) < 1e-12 for i, s in part.items())


@pytest.mark.parametrize("name", sorted(D.HARMONIZERS))
def test_harmonisers_give_complete_rows(spark, name):
    sample = {
        "binary_label": "1", "attack_type": "dos", "Label": "Anomaly", "Attack": "ddos", "classification": "1", "lenght": "10", "URL": "http://x/abc", "Content": "Failed password for invalid user bob", "Time": "13:05:01",
        "Component": "sshd", "Level": "error", "EVTX_Tactic": "Lateral Movement", "EventID": "4625", "DestPort": "445", "_label": "1", "entropy": "4", "FQDN_count": "20", "labels": "3", "Features": "E1,E2,E3", "Latency": "5", "Flow Duration": "inf",
        "Total Fwd Packets": "4", "SYN Flag Count": "2", "IN_BYTES": "10", "sbytes": "5", "proto": "udp", "protocol_type": "icmp",
    }
    df = spark.createDataFrame([tuple(sample.values())], ", ".join(f"`{k}` string" for k in sample))
    out = D.combine_datasets([D.dataset_to_features(df, name)])
    assert D.count_violations(out).first()["violations"] == 0
    r = out.first()
    assert r["label"] == 1 and r["attack_type"] not in (None, "", "normal", "unknown")


@pytest.mark.parametrize("name,row,word", [
    ("evtx", {"EventID": "4625", "Computer": "pc", "TargetUserName": "bob", "IpAddress": "1.1.1.1", "EVTX_Tactic": "x"}, "An account failed to log on."), ("cicids", {"Label": "DDoS", "Destination Port": "80"}, "DDoS attack detected"),
    ("dns", {"Domain": "b'abc.test.'", "entropy": "4.2", "IP": "nan"}, "suspicious domain=abc.test"), ("nsl_kdd", {"label": "neptune", "attack_type": "dos", "service": "http"}, "IDS alert: dos (neptune)"),
    ("nf_ton_iot", {"a": "1.1.1.1", "b": "5", "c": "2.2.2.2", "d": "80", "e": "tcp", "f": "9"}, "1.1.1.1:5 → 2.2.2.2:80 proto=tcp f=9"), ("apache_structured", {"Content": "boom", "Level": "warn"}, "Apache: boom"),
])
def test_event_converters(spark, name, row, word):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` string" for k in row))
    assert word in json.loads(D.dataset_to_event(df, name).first()["value"])["message"]


def test_multiline_messages(spark):
    rows = [("f", i, x) for i, x in enumerate(["2024-01-01 start", " at a", " at b", "2024-01-02 next", "[x] third"])]
    out = readers.multiline_merge(spark.createDataFrame(rows, "file string, seq long, line string"), "file", "seq", "line", chunk=2)
    assert [r["line_count"] for r in out.orderBy("first_seq").collect()] == [3, 1, 1]


def test_case_sensitive_aliases(spark):
    df = spark.createDataFrame([('{"PID":"7","pid":null,"exe":"/bin/x"}',)], "value string")
    r = N.normalize_process(N.parse_messages(df)).first()
    assert (r["pid"], r["binary_path"]) == (7, "/bin/x")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_cross_joins_or_row_udfs(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    for name in ("triage_result", "conn_window_2s", "conn_window_100", "sigma_rules", "graph_features", "temporal_correlation", "campaign_detection", "project_event_security", "merkle_root", "drift_kl", "asset_pattern_join"):
        plan = _plan(entry.queries()[name](spark, sf))
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan, name


def test_time_filters_reach_the_scan(spark):
    import __spark_entry__ as entry

    plan = _plan(entry.queries()["event_count_24h"](spark, "/root/testdata/sf0.001"))
    assert "GreaterThanOrEqual(ts" in plan


def test_long_windows_use_finer_buckets(spark):
    rows, df = facts(spark, seed=9, span=600)
    span = 90_000_000
    assert T._width(span) < span / 4
    out = T.sweep(df.select("id", "k", "ts"), ["k"], "ts", span, [T.sum_deltas(df, ["k"], "ts", span, {"n": F.lit(1)}), T.distinct_deltas(df, ["k"], "ts", span, {"d": F.col("v")})])
    got = {r["id"]: (r["n"], r["d"]) for r in out.collect()}
    some = {}
    for r in T.window_values(df.select("id", "k", "ts"), df.select("k", "v", "ts"), "k", "ts", span, "v", "id").collect():
        some.setdefault(r["id"], set()).add(r["v"])
    for i, k, _, s in rows:
        inside = [r for r in rows if r[1] == k and s - 90 - 1e-9 <= r[3] <= s + 1e-9]
        values = {r[2] for r in inside}
        assert got[i] == (len(inside), len(values))
        assert some[i] == values


def test_campaign_lists_every_host(spark):
    t0 = 1_700_000_000
    seen = [(k, "1.1.1.1", f"host-{39 - k:02d}", f"t{k % 3}", 0.9, t0 + k) for k in range(40)]
    scored = spark.createDataFrame(seen, "event_id long, source_ip string, hostname string, mitre_tactic string, adjusted_score double, s long").withColumn("timestamp", F.timestamp_seconds("s"))
    flows = spark.createDataFrame([("1.1.1.1", f"host-{k:02d}", t0 + i) for k in range(40) for i in range(3)], "src_ip string, hostname string, s long").withColumn("timestamp", F.timestamp_seconds("s"))
    alert = scored.where("event_id = 39")
    hosts = [f"host-{k:02d}" for k in range(40)]
    assert I.campaign_detection(alert, scored, flows).first()["related_hosts"] == hosts
    assert I.campaign_detection(alert, scored, flows, most_hosts=20).first()["related_hosts"] == hosts[:20]


def test_higher_scores_below_the_gate_count(spark):
    rows = [(1, 0.60, 0), (2, 0.40, 10)]
    scored = spark.createDataFrame([(i, "h", "1.1.1.1", "u", "src", "tac", v, 1_700_000_000 + s) for i, v, s in rows], "event_id long, hostname string, source_ip string, user_id string, source_type string, mitre_tactic string, adjusted_score double, s long").withColumn("timestamp", F.timestamp_seconds("s"))
    got = {r["event_id"]: r["temporal_escalation_count"] for r in I.temporal_correlation(I.investigation_gate(scored, 0.3), scored).collect()}
    assert got == {1: 0, 2: 1}


def test_templates_do_not_depend_on_other_lines(spark):
    """Two similar rare lines are one template among any number of others."""
    rare = ["job alpha took long on red node", "job alpha took short on blue node"]
    rnd = random.Random(3)
    for n in (0, 10, 200):
        others = [" ".join(["job", "alpha", *["".join(rnd.choice("ghijklmnop") for _ in range(6)) for _ in range(5)]]) for _ in range(n)]
        df = spark.createDataFrame([(i, x) for i, x in enumerate(rare + others * 2)], "id int, message string")
        out = {r["id"]: r["template_id"] for r in L.assign_templates(df, L.log_templates(df)).collect()}
        assert out[0] == out[1], n
        assert len(set(out.values())) == n + 1


def test_buckets_share_a_table_of_leaders():
    """Small buckets are led in one table as each would be alone; tokens stay with leaders that more rows will meet."""
    rnd = random.Random(4)
    rows = [{"bucket": f"{n} a", "sig": f"{n}{k:03d}", "size": rnd.randrange(3), "tokens": ["a", *[rnd.choice("xyz") for _ in range(n - 1)]], "more": n == 9} for n in (4, 9, 17) for k in range(30)]
    rnd.shuffle(rows)
    got = {r["sig"]: r for r in L._lead(pa.Table.from_pylist(rows), 0.4).to_pylist()}
    for n in (4, 9, 17):
        leaders = []
        for r in sorted((r for r in rows if len(r["tokens"]) == n), key=lambda r: (-r["size"], r["sig"])):
            close = [x for x in leaders if sum(a == b for a, b in zip(x["tokens"], r["tokens"])) / n >= 0.4]
            leaders += [] if close else [r]
            mine = got[r["sig"]]
            assert mine["cluster"] == (close or [r])[0]["sig"]
            assert mine["tokens"] == (r["tokens"] if n == 9 and not close else None)


def test_looking_ahead_changes_no_mask():
    import re

    rnd, parts = random.Random(5), ["Jan", "Dec ", "2024-01-05", "T", " ", ":", "::", "0x", "1f", "fe80", "10.0.0.1", "-", "00", "abcdef12", "-1234", "/a", "/b.c", "z"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 30))) for _ in range(4000)]
    texts += ["550e8400-e29b-41d4-a716-446655440000", "00:11:22:33:44:55", "1:2:3:4:5:6:7:8", "Jan 12 10:11:12"]
    for place, first in L._FIRST.items():
        pattern, name = L.MASKS[place]
        assert [re.sub(first + pattern, name, t) for t in texts] == [re.sub(pattern, name, t) for t in texts]
        assert any(re.search(pattern, t) for t in texts)


def test_template_leaders_equal_a_plain_pass(spark):
    rnd = random.Random(8)
    lines = [" ".join(["a", "b", *[rnd.choice("cdef") * 2 for _ in range(rnd.choice([3, 4]))]]) for _ in range(150)]
    sizes = {}
    for x in lines:
        sizes[x] = sizes.get(x, 0) + 1
    order = sorted(sizes, key=lambda x: (-sizes[x], hashlib.md5(x.encode()).hexdigest()))
    close = lambda x, y: len(x.split()) == len(y.split()) and sum(p == q for p, q in zip(x.split(), y.split())) / len(x.split()) >= 0.7
    leaders, cluster = [], {}
    for x in order:
        found = next((y for y in leaders if close(x, y)), None)
        if found is None:
            leaders.append(x)
        cluster[x] = found or x
    df = spark.createDataFrame([(x,) for x in lines], "message string")
    got = {r["message"]: r["template_id"] for r in L.assign_templates(df, L.log_templates(df, similarity=0.7)).collect()}
    assert got == {x: "T" + hashlib.md5(cluster[x].encode()).hexdigest()[:12] for x in sizes}


def test_hot_templates_are_decided_block_by_block(spark):
    """Half of the signatures share a token and a bucket; small blocks and parts give the plain pass, and no task holds the bucket."""
    rnd = random.Random(9)
    lines = sorted({" ".join(["x", "y", "hot" if k % 2 else rnd.choice("abc"), *[rnd.choice("cdefgh") * 2 for _ in range(5)]]) for k in range(1200)})
    df = spark.createDataFrame([(x,) for x in lines], "message string")
    s = L.computed(L.signatures(df, "message"), {"tokens": F.split("masked", " ")}).withColumn("bucket", F.lit("b"))
    plain, leaders = {}, []
    for x in sorted(lines, key=lambda x: hashlib.md5(x.encode()).hexdigest()):
        y = next((y for y in leaders if sum(p == q for p, q in zip(x.split(), y.split())) / 8 >= 0.75), None)
        leaders += [] if y else [x]
        plain[hashlib.md5(x.encode()).hexdigest()] = hashlib.md5((y or x).encode()).hexdigest()
    got = {r["sig"]: r["cluster"] for r in L._clusters(s, 0.75, block=16, part=100).collect()}
    assert got == plain and len(leaders) > 50
    parts = s.withColumn("salt", F.pmod(F.xxhash64("sig"), F.ceil(F.lit(len(lines)) / 100))).groupBy("salt").count().agg(F.max("count")).first()[0]
    assert parts < 0.25 * len(lines)


def test_search_refuses_pages_out_of_bounds(spark):
    df = spark.range(3).select(F.col("id").alias("event_id"))
    for limit, offset in ((0, 0), (201, 0), (50, 100_001), (50, -1)):
        with pytest.raises(ValueError):
            S.event_search(df, "security_events", limit=limit, offset=offset)


def test_long_lines_and_unknown_topics_are_dead_letters(spark, tmp_path):
    (tmp_path / "a.log").write_text("short\n" + "x" * 50 + "\n")
    lines = lambda f: [r["value"] for r in f(spark, str(tmp_path), max_bytes=20).collect()]
    assert lines(readers.log_file_source) == ["short"] and lines(readers.log_file_dead_letters) == ["x" * 50]
    sent = [("raw-logs", '{"message":"a"}'), ("raw-logs", "[1]"), ("other", '{"message":"b"}'), (None, "{}"), ("labels", '{"label":"maybe"}'), ("labels", '{"label":"unknown"}'), ("raw-logs", "y" * 20_000)]
    df = spark.createDataFrame(sent, "topic string, value string").withColumn("ingest_ts", F.current_timestamp())
    topics = {"raw-logs": "raw_logs", "labels": "feedback_labels"}
    dead = sorted((r["failed_stage"], r["raw_payload"]) for r in Y.dead_letters(df, topics=topics).collect())
    assert dead == sorted([("json_parse", "[1]"), ("json_parse", "y" * 20_000), ("topic", '{"message":"b"}'), ("topic", "{}"), ("row_build", '{"label":"maybe"}')])
    assert sum(Y.typed_rows(df.where(F.col("topic") == k), v).count() for k, v in topics.items()) == 2


def test_csv_files_are_all_read(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.csv").write_text(f"\ufeff a , b\n{k},x\n")
    assert sorted(r["a"] for r in readers.csv_dataset_source(spark, str(tmp_path), "*.csv").collect()) == ["0", "1", "2"]
    (tmp_path / "part-9.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception):
        readers.csv_dataset_source(spark, str(tmp_path), "*.csv").collect()


def test_late_rows_count_and_are_kept(spark, tmp_path):
    from watchtide.streaming import rollups as TR

    t0 = 1_700_000_000
    batches = [[(1, t0), (2, t0 + 7200)], [(3, t0 + 60), (4, t0 + 7100)], [(5, t0 + 9000), (1, t0)]]
    rollup = lambda df: df.groupBy(F.window("timestamp", "1 hour").start.alias("hour")).agg(F.count("*").alias("event_count"))
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "event_id long, s long").select("event_id", F.timestamp_seconds("s").alias("timestamp"))
        df.write.parquet(f"{tmp_path}/in/{k}")
        s = lambda: spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        TR.keep_rollup(s(), rollup, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        TR.stream_dedup(s(), f"{tmp_path}/once", f"{tmp_path}/cp2").awaitTermination()
    assert sum(r["event_count"] for r in TR.read_rollup(spark, f"{tmp_path}/out", ["hour"]).collect()) == 6
    assert sorted(r["event_id"] for r in TR.late_rows(spark, f"{tmp_path}/out").collect()) == [1, 3]
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/once").collect()) == [1, 2, 3, 4, 5]


def test_rules_come_from_a_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "x-1", "title": "X", "severity": "high", "category": "c", "keywords": ["boom"], "keys": ["hostname"], "status": "test"}))
    (tmp_path / "b.json").write_text(json.dumps({"id": "x-2", "title": "Y", "severity": "low", "category": "c"}))
    try:
        assert [r.id for r in I.load_rules(spark, str(tmp_path))] == ["x-1", "x-2"] and I.RULES["x-1"].keywords == ("boom",)
    finally:
        I.RULES.pop("x-1", None), I.RULES.pop("x-2", None)
    (tmp_path / "c.json").write_text('{"id": "x-3"}')
    with pytest.raises(ValueError):
        I.load_rules(spark, str(tmp_path / "c.json"))


def test_messages_are_written_with_keys(spark, tmp_path):
    from watchtide.sources import sinks

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    sinks.message_sink(sinks.keyed_messages(df, "id"), "json", path=str(tmp_path / "m"))
    assert sorted((r["key"], json.loads(r["value"])["x"]) for r in spark.read.json(str(tmp_path / "m")).collect()) == [("1", "a"), ("2", "b")]
    with pytest.raises(ValueError):
        sinks.message_sink(df, "carrier pigeon")


def test_unknown_scorers_are_refused(spark):
    with pytest.raises(ValueError):
        G.score_events(spark.range(1), "nobody")


def test_split_gives_each_stratum_its_share(spark):
    rows = [(i, "a" if i % 50 else "b", None if i % 3 else 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, source string, label int")
    train, test = E.train_test(df, ["id"], 0.25, strata=["source", "label"])
    count = lambda d: {(r["source"], r["label"]): r["count"] for r in d.groupBy("source", "label").count().collect()}
    whole, held, rest = count(df), count(test), count(train)
    assert all(abs(held.get(k, 0) - n / 4) <= 1 and held.get(k, 0) + rest[k] == n for k, n in whole.items())


def test_ids_with_a_common_beginning_fall_into_many_segments(spark):
    df = spark.range(20_000).select((F.col("id") + 10_000_000_000).cast("string").alias("event_id"))
    sizes = [r["count"] for r in df.groupBy(T.text_segments(df, "event_id").alias("s")).count().collect()]
    assert len(sizes) > 100 and max(sizes) < 20_000 * 0.03
    ranked = T.segment_rank(df.withColumn("k", F.lit(1)), ["k"], ["event_id"], T.text_segments(df, "event_id"))
    assert ranked.where(F.col("rn") != F.col("event_id").cast("long") - 9_999_999_999).count() == 0


def test_leading_wildcards_do_not_share_one_key(spark):
    names = spark.createDataFrame([(f"srv{i}-{w}-x",) for i in range(300) for w in ("alpha", "beta", "gamma")] + [("zz",)], "hostname string")
    rules = spark.createDataFrame([(f"%{w}%", float(k)) for k, w in enumerate(("alpha", "gamma", "none"))] + [(f"srv{i}-%", 100.0 + i) for i in range(0, 300, 7)] + [("%z", 7.0)], "hostname_pattern string, multiplier double")
    got = {r["hostname"]: r["asset_multiplier"] for r in J.asset_multipliers(names, rules).collect()}
    want = {}
    for i in range(300):
        for w in ("alpha", "beta", "gamma"):
            hits = [(p, m) for p, m in [("%alpha%", 0.0), ("%gamma%", 1.0)] if p.strip("%") in w] + ([(f"srv{i}-%", 100.0 + i)] if i % 7 == 0 else [])
            if hits:
                want[f"srv{i}-{w}-x"] = min(hits)[1]
    assert got == {**want, "zz": 7.0}
