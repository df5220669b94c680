"""Hot keys and large reference tables: keys that tell apart, rule tables of any size, retention that goes on where it was."""

import random

from pyspark.sql import functions as F

from watchtide.operators import lookups as J
from watchtide.operators.investigate import signals as S
from watchtide.sources import sinks


def like(pattern, name):
    import re

    return re.fullmatch("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern.lower()), name.lower()) is not None


def test_patterns_match_as_like_does(spark):
    rnd = random.Random(1)
    names = ["".join(rnd.choice("abAB-1") for _ in range(rnd.randint(1, 9))) for _ in range(300)] + ["é-x", "", None]
    patterns = ["".join(rnd.choice("ab-1%_") for _ in range(rnd.randint(1, 6))) for _ in range(120)] + ["%", "zzz%", "_-x", "abc%1"]
    hosts = spark.createDataFrame([(n,) for n in names], "hostname string")
    assets = spark.createDataFrame([(p, float(k)) for k, p in enumerate(dict.fromkeys(patterns))], "hostname_pattern string, multiplier double")
    got = {r["hostname"]: r["asset_multiplier"] for r in J.asset_multipliers(hosts, assets).collect()}
    order = sorted((p.encode(), p, float(k)) for k, p in enumerate(dict.fromkeys(patterns)))
    want = {n: next(m for _, p, m in order if like(p, n)) for n in set(names) - {"", None}}  # % matches all
    assert got == want


def test_one_naming_scheme_has_no_hot_key(spark):
    """100,000 names and 10,000 patterns that begin alike: no key makes more than a thousandth of all comparisons."""
    hosts = spark.range(100_000).select(F.format_string("host-%06d.prod", "id").alias("hostname"))
    assets = spark.range(10_000).select(F.format_string("host-%05d%%", "id").alias("hostname_pattern"), F.lit(2.0).alias("multiplier"))
    names, patterns = J._pattern_keys(hosts, assets)
    load = names.groupBy("gram", "salt").count().join(patterns.groupBy("gram", "salt").agg(F.count("*").alias("p")), ["gram", "salt"]).select((F.col("count") * F.col("p")).alias("w"))
    most, total = load.agg(F.max("w"), F.sum("w")).first()
    assert most <= 100_000 * 10_000 / 1000 and total < 100_000 * 10_000 / 5
    small = J.asset_multipliers(hosts.limit(500), assets.where("hostname_pattern LIKE 'host-0000%'"))
    assert small.count() == 100


def test_rules_of_any_number(spark):
    rnd = random.Random(4)
    names = ["f1", "f2", "f3", "f4"]
    rules = [(f"r{k:05d}", rnd.randrange(1000), rnd.sample(names, rnd.randint(1, 2)), round(rnd.random(), 3), f"T{k}", "n", "t", "HIGH") for k in range(50_000)]
    alerts = [(k, round(rnd.random(), 4), rnd.sample(names, rnd.randint(0, 3))) for k in range(60)]
    df = spark.createDataFrame(alerts, "event_id long, adjusted_score double, active_triggers array<string>")
    table = S.rule_table(spark, rules)
    assert S.rule_index(table).count() < 5_000
    got = {r["event_id"]: [m["rule_id"] for m in r["mitre_matches"]] for r in S.rule_overlap(df, table).collect()}
    order = sorted(rules, key=lambda r: (r[1], r[0]))
    for k, score, active in alerts:
        reached = [r for r in order if r[3] <= score]
        want = [r[0] for r in reached if set(r[2]) & set(active)][:25] if active else [r[0] for r in reached][:5]
        assert got[k] == want


def test_retention_goes_on_where_it_was(spark, tmp_path):
    path = str(tmp_path)
    df = spark.range(40).select("id", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, CAST(id AS INT))").alias("timestamp"))
    for batch in (0, 1):
        sinks.write_table(df, path, "raw_logs", batch_id=batch)
    policy = spark.createDataFrame([("raw_logs", 7, 20, 30), ("missing", 1, 2, 3)], "table_name string, warm_days int, cold_days int, delete_days int")
    tiers = lambda: {t: sorted(d.isoformat() for _, d in sinks._days(path + (f"/tier={t}" if t else ""), "raw_logs")) for t in ("", "warm", "cold")}
    # a move that was cut off: half a folder is at the target already
    half = tmp_path / "tier=warm/raw_logs/batch=0/event_date=2024-01-30"
    half.mkdir(parents=True)
    (half / "part-0").write_text("broken")
    done = sinks.apply_retention(spark, path, policy, "2024-02-09 10:00:00")
    assert {r["tier"] for r in done.collect()} == {"hot", "warm", "cold", "delete"}
    first = tiers()
    sinks.apply_retention(spark, path, policy, "2024-02-09 10:00:00")
    assert tiers() == first and {k: len(x) for k, x in first.items()} == {"": 14, "warm": 26, "cold": 20}
    assert spark.read.parquet(f"{path}/tier=warm/raw_logs").count() == 26
    later = sinks.apply_retention(spark, path, policy, "2024-03-20 10:00:00")
    assert {k: len(x) for k, x in tiers().items()} == {"": 0, "warm": 0, "cold": 0} and later.where("tier <> 'delete'").count() == 0


def test_forest_does_not_depend_on_partitions(spark):
    from watchtide.operators import models as M

    rnd = random.Random(6)
    rows = [(k, rnd.random(), rnd.random(), 0) for k in range(400)]
    df = spark.createDataFrame(rows, "event_id long, x double, y double, label int")
    one, other = (M.grow_forest(d, ["x", "y"], trees=5, sample=32) for d in (df.coalesce(1), df.repartition(7)))
    assert len(one) == 5 and one == other


def test_registered_embedders_are_used(spark):
    from watchtide.operators import vectors as Q

    length = F.udf(lambda t: [float(len(t)), 1.0], "array<float>")
    Q.register_embedder("length", length)
    try:
        df = spark.createDataFrame([("abc",), ("a",)], "message string")
        assert [r["vector"] for r in Q.embed(df, "message", embedder="length").collect()] == [[3.0, 1.0], [1.0, 1.0]]
        assert len(Q.embed(df, "message", dim=16).first()["vector"]) == 16
    finally:
        Q.EMBEDDERS.pop("length")


def test_a_stratum_is_many_tasks(spark):
    """A split with one large stratum: its share is exact, and no task gets half of its rows."""
    from watchtide.operators import evaluate as E

    df = spark.range(4000).select(F.col("id").alias("event_id"), (F.col("id") % 100 == 0).cast("int").alias("label"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        train, test = E.train_test(df, ["event_id"], strata=["label"])
        parts = train.where("label = 0").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in parts) < 3168 / 2 and sum(r["count"] for r in parts) == 3168
        assert {r["label"]: r["count"] for r in test.groupBy("label").count().collect()} == {0: 792, 1: 8}
        assert train.join(test, "event_id").count() == 0
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_a_host_is_many_tasks(spark):
    """Training rows of one host meet what is known of it in several tasks, and nothing is lost or doubled."""
    from watchtide.operators import models as M

    scored = spark.range(2000).selectExpr("id AS event_id", "IF(id % 50 = 0, NULL, 'h') AS hostname", "0.5D AS adjusted_score", "0.5D AS combined_score", "0.1D AS template_rarity", "0 AS ioc_match", "0 AS ioc_confidence")
    context = spark.createDataFrame([("h", 7, 3, 2)], "hostname string, unique_destinations long, unique_src_ips long, hop_count long")
    history = spark.createDataFrame([("h", 4, 0.25), ("other", 1, 0.5)], "hostname string, escalation_count long, mean_score double")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = M.training_set_assembly(scored, context, history, F.lit(1))
        parts = out.where("hostname = 'h'").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in parts) < 1960 / 2 and sum(r["count"] for r in parts) == 1960 and out.count() == 2000
        place = {n: i for i, n in enumerate(M.FEATURE_ORDER)}
        seen = {(r["hostname"], r["feature_vector"][place["graph_unique_destinations"]], r["feature_vector"][place["temporal_mean_score"]]) for r in out.collect()}
        assert seen == {("h", 7.0, 0.25), (None, 0.0, 0.0)}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_a_feed_keeps_its_partitions(spark, tmp_path):
    from watchtide.plans.roundtrip import feed

    assert feed(spark.range(1000, numPartitions=10), f"{tmp_path}/in") == 4
    assert len(list((tmp_path / "in").glob("part-*"))) == 10 and spark.read.parquet(f"{tmp_path}/in").count() == 1000
