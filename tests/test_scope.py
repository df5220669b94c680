"""Facts bounded by the alerts: the same signals as over all facts, and a plan that reads less."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from watchtide.operators.investigate import scope as W, signals as S

T0 = 1_700_000_000


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    rnd = random.Random(8)
    hosts, sources, users = ["h1", "h1", "h2", "h3", None], ["1.1.1.1", "1.1.1.1", "2.2.2.2", "3.3.3.3", None], ["u1", "u2", None]
    stamp = lambda: T0 + rnd.choice([rnd.random() * 9000, float(rnd.randrange(0, 9000, 300))])
    net = [(k, stamp(), rnd.choice(hosts), rnd.choice(sources), f"9.9.9.{rnd.randrange(6)}", rnd.choice([445, 80]), "DNS", "q" * rnd.choice([3, 200]), rnd.choice(["deny", "snmp x", "snmp y", "login then fail", ""])) for k in range(3000)]
    scored = [(k, stamp(), rnd.choice(hosts), rnd.choice(sources), rnd.choice(users), round(rnd.random(), 2), "net", rnd.choice(["discovery", "impact", ""]), rnd.choice(["escalate", "log"]), rnd.randrange(2)) for k in range(1500)]
    times = lambda df: df.withColumn("timestamp", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s")
    folder = str(tmp_path_factory.mktemp("facts"))
    times(spark.createDataFrame(net, "event_id long, s double, hostname string, src_ip string, dst_ip string, dst_port int, protocol string, dns_query string, detection_rule string")).write.parquet(f"{folder}/net")
    times(spark.createDataFrame(scored, "event_id long, s double, hostname string, source_ip string, user_id string, adjusted_score double, source_type string, mitre_tactic string, action string, ioc_match int")).write.parquet(f"{folder}/scored")
    iocs = spark.createDataFrame([("1.1.1.1", "ip")], "ioc_value string, ioc_type string").withColumns({"expires_at": F.lit("2099-01-01").cast("timestamp"), "is_active": F.lit(1), "confidence": F.lit(90)})
    return spark.read.parquet(f"{folder}/net"), spark.read.parquet(f"{folder}/scored"), iocs


def signals(alerts, net, scored, within):
    yield S.temporal_correlation(alerts, scored, within=within)
    yield S.campaign_detection(alerts, scored, net, min_events=1, within=within)
    yield S.sigma_rules(alerts.withColumn("message", F.lit("a port scan")), net, within=within)


@pytest.mark.parametrize("bound", [W.BROADCAST_ROWS, 0])
def test_signals_of_few_alerts_are_those_over_all_facts(spark, facts, bound, monkeypatch):
    net, scored, _ = facts
    alerts = scored.where("event_id % 211 = 3").select("event_id", "timestamp", "hostname", "source_ip", "user_id", "adjusted_score")
    assert 5 <= alerts.count() <= 10
    within = W.scope(alerts, bound=bound)
    text = lambda df: sorted(str(r) for r in df.select("event_id", *sorted(set(df.columns) - {"event_id"})).collect())
    got = [text(x) for x in signals(alerts, net, scored, within)]
    assert within.near(net, [], S.minutes(15)).count() < net.count()
    monkeypatch.setattr(W.Scope, "near", lambda self, facts, keys, window_us, ts="timestamp": facts)
    assert got == [text(x) for x in signals(alerts, net, scored, within)]


def test_plan_reads_the_alerts_times_and_keys_only(facts):
    net, scored, _ = facts
    alerts = scored.where("event_id = 100 OR event_id = 200")
    near = W.scope(alerts).near(S._facts(net), ["hostname", "source_ip"], S.minutes(15))
    with contextlib.redirect_stdout(io.StringIO()) as out:
        near.explain("formatted")
    plan = out.getvalue()
    assert "GreaterThanOrEqual(timestamp" in plan and "LessThanOrEqual(timestamp" in plan
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan and plan.count("Exchange hashpartitioning") <= 1  # that of the distinct keys
    assert near.count() < 0.2 * net.count()


def test_no_alerts_need_no_facts(facts):
    net, scored, _ = facts
    assert W.scope(scored.where("event_id < 0")).near(net, ["hostname"], 1000).count() == 0


def test_correlation_meets_facts_once_per_bucket(spark):
    """Random alerts, with null keys and repeated ids, against all pairs; no row is sent once per score level or per related alert."""
    import random
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from watchtide.operators.investigate import signals as S

    rnd, day = random.Random(7), datetime(2024, 1, 1)
    pick = lambda *x: rnd.choice(x)
    rows = [(k, pick("h1", "h2"), pick("a", "b", None), pick("u", "v", "", None), day + timedelta(seconds=rnd.randrange(4000)), rnd.randrange(10_000) / 10_000, pick("dns", "syslog", None), pick("x", "y", "")) for k in range(700)]
    df = spark.createDataFrame(rows, "event_id long, hostname string, source_ip string, user_id string, timestamp timestamp, adjusted_score double, source_type string, mitre_tactic string")
    alerts = df.where("adjusted_score >= 0.65")
    out = S.temporal_correlation(alerts, df)
    got = {r["event_id"]: r for r in out.collect()}
    for a in (r for r in rows if r[5] >= 0.65):
        near = [f for f in rows if f[1] == a[1] and (f[2] == a[2] or f[3] == a[3]) and timedelta(0) <= a[4] - f[4] <= timedelta(minutes=15)]
        r = got.pop(a[0])
        assert r["temporal_escalation_count"] == sum(f[2] == a[2] and f[5] > a[5] + 1e-9 for f in near)
        assert r["temporal_unique_categories"] == len({f[6] for f in near} - {None}) and r["temporal_tactic_diversity"] == len({f[7] for f in near})
        assert abs(r["temporal_mean_score"] - sum(f[5] for f in near) / len(near)) < 1e-6
        assert r["related_alert_ids"] == [f[0] for f in sorted(near, key=lambda f: (f[4], f[0]), reverse=True)[: S.RELATED]]
    assert not got
    assert "shiftright" not in out._jdf.queryExecution().toString()
    twice = {r["event_id"]: r for r in S.temporal_correlation(alerts.unionByName(alerts), df).collect()}
    once = {r["event_id"]: r for r in S.temporal_correlation(alerts, df).collect()}
    assert all(twice[k]["temporal_escalation_count"] == 2 * r["temporal_escalation_count"] and twice[k]["related_alert_ids"] == r["related_alert_ids"] for k, r in once.items())
    assert S.temporal_correlation(alerts.withColumn("timestamp", F.lit(None).cast("timestamp")), df).agg(F.max("temporal_escalation_count")).first()[0] == 0


def test_process_context_is_one_list_per_alert(spark):
    """Programs around random alerts against all pairs, ranked; alerts meet facts, not each program's facts (no shuffle per alert and program)."""
    import random
    from collections import Counter
    from datetime import datetime, timedelta

    from watchtide.operators import experimental as X

    rnd, day = random.Random(3), datetime(2024, 1, 1)
    moment = lambda: day + timedelta(seconds=rnd.randrange(9000))
    facts = [(rnd.choice(["h1", "h2", "h3", None]), rnd.choice("abcé"), rnd.choice(["-x", "-y", None]), moment()) for _ in range(600)]
    alerts = [(k, rnd.choice(["h1", "h2", "nowhere", None]), moment()) for k in range(120)]
    process = spark.createDataFrame(facts, "hostname string, binary_path string, arguments string, timestamp timestamp")
    df = spark.createDataFrame(alerts, "event_id long, hostname string, timestamp timestamp")
    out = X.process_chain_context(df, process)
    got = {}
    for r in out.orderBy("event_id", "rank").collect():
        got.setdefault(r["event_id"], []).append((r["binary_path"], r["arguments"], r["exec_count"], r["rank"]))
    for k, host, at in alerts:
        seen = Counter(f[1:3] for f in facts if host is not None and f[0] == host and abs(f[3] - at) <= timedelta(minutes=15))
        mine = got.pop(k, [])
        assert {x[:2]: x[2] for x in mine} == dict(seen) and [x[3] for x in mine] == list(range(1, len(mine) + 1))
        assert [x[2] for x in mine] == sorted((x[2] for x in mine), reverse=True)
    assert not got and X.process_chain_context(df, process, k=2).where("rank > 2").count() == 0
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString() and "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().toString()
