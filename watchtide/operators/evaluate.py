"""Sampling, labels, metrics, calibration and drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from watchtide.functions.expr import first_case, since
from watchtide.functions.ranking import exact_percentiles, running_totals, smallest_per_group

BINS, EPS = 10, 1e-8
KL_LIMIT, PSI_LIMIT, SHIFT_LIMIT = 0.1, 0.25, 0.1
PSI_FEATURES = ["adjusted_score", "sigma_hit_count", "similarity_attack_embed_dist", "spc_z_score"]
POSITIVE = ["CONFIRMED_ATTACK", "ACTIVE_CAMPAIGN", "BEHAVIOURAL_ANOMALY", "SIGMA_MATCH", "ANOMALOUS_PATTERN"]
MIN_CONFIDENCE, MIN_ROWS, MIN_NEGATIVES, NEWEST = 0.50, 100, 0.10, 50_000


def row_hash(columns: Sequence[str], seed: int = 42) -> Column:
    """Order of a sample that does not depend on partitions."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def stratified_sample(df: DataFrame, strata: list[str], n: int, key: list[str], seed: int = 42) -> DataFrame:
    """At most n rows per stratum, by hash order."""
    return smallest_per_group(df.withColumn("_h", row_hash(key, seed)), strata, ["_h"], n).drop("_h")


def holdout_split(df: DataFrame, training: DataFrame, key: list[str]) -> DataFrame:
    """Rows that are not in the training sample."""
    return df.join(training.select(*key).distinct(), key, "left_anti")


def train_test(df: DataFrame, key: list[str], test_share: float = 0.2, seed: int = 42, strata: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Split by the hash of the key, so reruns agree.

    With ``strata`` each of them gives its exact share: the rows whose hash lies below the stratum's own percentile.
    """
    place = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 50)) / F.lit(float(1 << 50))
    if not strata:
        part = place < test_share
        return df.where(~part), df.where(part)
    placed = df.withColumns({"_place": place, "_stratum": F.to_json(F.struct(*strata))})
    cut = exact_percentiles(placed, ["_stratum"], "_place", {"_cut": test_share})
    # strata are few and large: each is dealt out by its rows' hash, so that no task gets a whole one
    salts = max(256, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = placed.withColumn("_salt", F.floor(F.col("_place") * salts).cast("int"))
    cut = cut.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    marked = placed.join(cut, ["_stratum", "_salt"]).withColumn("_part", F.col("_place") < F.col("_cut"))
    return tuple(marked.where(x).select(*df.columns) for x in (~F.col("_part"), F.col("_part")))


def binary_metrics(df: DataFrame, score: str, label: str, thresholds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and the usual rates at each threshold, in one pass."""
    s, y = F.col(score), F.col(label) == 1
    aggs = []
    for i, t in enumerate(thresholds):
        p = s >= t
        aggs += [F.count_if(p & y).alias(f"tp{i}"), F.count_if(p & ~y).alias(f"fp{i}"), F.count_if(~p & ~y).alias(f"tn{i}"), F.count_if(~p & y).alias(f"fn{i}")]
    one = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "tn", "fn")]) for i, t in enumerate(thresholds)])
    out = one.select(*keys, F.inline(rows))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumns({"n": tp + fp + tn + fn, "accuracy": rate(tp + tn, tp + fp + tn + fn), "precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "fpr": rate(fp, fp + tn)})
    return out.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def auc_ap(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half, and average precision."""
    keys = list(keys) or ["_all"]
    df = df.withColumn("_all", F.lit(0)) if keys == ["_all"] else df
    counted = df.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    r = running_totals(counted, keys, -F.col(score), -F.floor(F.col(score) * 1000), ["pos", "neg"])
    above = F.col("cum_pos") - F.col("pos")
    area = F.sum(F.col("neg") * (above + 0.5 * F.col("pos"))) / (F.max("all_pos") * F.max("all_neg"))
    ap = F.sum(F.col("pos") / F.col("all_pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    out = r.groupBy(*keys).agg(area.alias("auc_roc"), ap.alias("avg_precision"))
    return out.drop("_all")


def per_group_detection(df: DataFrame, group: str, score: str, label: str, threshold: float = 0.5, least: int = 5) -> DataFrame:
    hit = (F.col(score) >= threshold).cast("double")
    return df.groupBy(group).agg(
        F.count("*").alias("n"), F.avg(F.when(F.col(label) == 1, hit)).alias("detection_rate"), F.avg(F.when(F.col(label) == 0, hit)).alias("fpr"), F.avg(score).alias("mean_score"),
    ).where(F.col("n") >= least)


def leakage_check(df: DataFrame, dataset: str, feature: str, label: str, limit: float = 1.0) -> DataFrame:
    """A feature that tells the label by its mean alone."""
    mean = lambda v: F.coalesce(F.avg(F.when(F.col(label) == v, F.col(feature))), F.lit(0.0))
    out = df.groupBy(dataset).agg(mean(0).alias("normal_mean"), mean(1).alias("attack_mean"))
    out = out.withColumn("delta", F.abs(F.col("attack_mean") - F.col("normal_mean")))
    return out.withColumn("status", F.when(F.col("delta") < limit, "OK").otherwise("WARN"))


def dataset_fingerprint(df: DataFrame, name: str) -> DataFrame:
    """The same for any row order: counts, and sums and extremes of row hashes (56 bits of the md5 of the values)."""
    def text(name: str, kind: str) -> Column:
        c = F.col(name)
        shown = F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else c.cast("decimal(38,9)") if kind in ("double", "float") else c
        return F.coalesce(shown.cast("string"), F.lit("?"))

    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[text(c, k) for c, k in df.dtypes])), 1, 14), 16, 10).cast("bigint")
    one = df.select(h.alias("h")).agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total"), F.min("h").alias("low"), F.max("h").alias("high"))
    return one.select(F.lit(name).alias("dataset"), F.lit(len(df.columns)).alias("columns"), "rows", F.sha2(F.concat_ws("|", F.lit(name), F.lit(",".join(df.columns)), *[F.col(c).cast("string") for c in ("rows", "total", "low", "high")]), 256).alias("fingerprint"))


def calibrate_thresholds(df: DataFrame, score: str, label: str) -> DataFrame:
    """Suspicious at the 95th percentile of normal rows, anomalous at the median of malicious ones."""
    pct = exact_percentiles(df, [label], score, {"p25": 0.25, "p50": 0.5, "p95": 0.95})
    pick = lambda y, c: F.max(F.when(F.col(label) == y, F.col(c)))
    one = pct.agg(pick(0, "p95").alias("n95"), pick(1, "p25").alias("m25"), pick(1, "p50").alias("m50"))
    low = F.round("n95", 2)
    one = one.select(low.alias("suspicious"), F.when(low >= F.round("m50", 2), F.round(F.greatest(F.col("m25"), low + 0.05), 2)).otherwise(F.round("m50", 2)).alias("anomalous"))
    at = lambda y, t: F.avg(F.when(F.col(label) == y, (F.col(score) >= F.col(t)).cast("double")))
    return df.crossJoin(F.broadcast(one)).groupBy("suspicious", "anomalous").agg(  # one row
        at(1, "suspicious").alias("detect_suspicious"), at(1, "anomalous").alias("detect_anomalous"), at(0, "suspicious").alias("fpr_suspicious"), at(0, "anomalous").alias("fpr_anomalous"))


# ---- labels ----------------------------------------------------------------------------


def verdict_label(finding: str = "finding_type") -> Column:
    return F.col(finding).isin(*POSITIVE).cast("int")


def training_rows(verdicts: DataFrame, vector: str = "feature_vector", size: int = 42) -> DataFrame:
    """Verdicts worth keeping: full vector, enough confidence, no fast path."""
    ok = (F.col("is_fast_path") == 0) & (F.size(vector) == size) & (F.col("hunter_score") >= MIN_CONFIDENCE)
    kind = F.when(F.col("finding_type").isin("CONFIRMED_ATTACK", "ACTIVE_CAMPAIGN"), "positive").when(F.col("finding_type").isin("FALSE_POSITIVE", "NORMAL_BEHAVIOUR"), "negative").otherwise("ambiguous")
    text = F.concat_ws("_", F.when(F.col("model_used") == "heuristic", "heuristic").otherwise("model"), kind)
    return verdicts.where(ok).withColumns({"label": verdict_label(), "label_source": text})


def training_set(rows: DataFrame, ts: str = "recorded_at", least: int = MIN_ROWS, newest: int = NEWEST) -> DataFrame:
    """The newest rows, or none when there are too few rows or too few negatives."""
    recent = rows.orderBy(F.desc(ts), "alert_id").limit(newest)
    share = recent.agg(F.count("*").alias("_n"), F.avg((F.col("label") == 0).cast("double")).alias("_neg"))
    return recent.crossJoin(F.broadcast(share)).where((F.col("_n") >= least) & (F.col("_neg") >= MIN_NEGATIVES)).drop("_n", "_neg")  # one row


def consensus_label(attack_hosts: Sequence[str] = (), benign_hosts: Sequence[str] = ()) -> Column:
    """Label from agreement of the scores, hosts known to be bad or good, and the action."""
    c, s, e, h = F.col("combined_score"), F.col("lgbm_score"), F.col("eif_score"), F.col("hostname")
    known = h.isin(*attack_hosts) if attack_hosts else F.lit(False)
    good = h.isin(*benign_hosts) if benign_hosts else F.lit(False)
    agree = (s >= 0.90) & ((e >= 0.80) | (c >= 0.90)) | (s >= 0.80) & (e >= 0.50) & (c >= 0.85)
    return first_case([
        (good | (c < 0.50), F.lit(0)), (known & (((s >= 0.80) & (c >= 0.85)) | (e >= 0.90)), F.lit(1)), (agree | ((F.col("action") == "escalate") & (c >= 0.85)), F.lit(1)),
        ((F.col("action") == "discard") | (c < 0.75), F.lit(0))], F.lit(1))


def consensus_label_strict() -> Column:
    """Second rule set: scores and action only."""
    c, s, e, a = F.col("combined_score"), F.col("lgbm_score"), F.col("eif_score"), F.col("action")
    sure = ((s >= 0.90) & (e >= 0.90) & (c >= 0.90)) | ((s >= 0.95) & (c >= 0.88)) | ((e >= 0.95) & (c >= 0.85)) | ((c >= 0.93) & (a == "escalate"))
    lean = (c < 0.60) | (a == "discard") | ((a == "monitor") & ((c < 0.80) | ((s >= 0.80) & (e < 0.50))))
    return first_case([(sure, F.lit(1)), (lean, F.lit(0)), ((a == "escalate") & (c >= 0.80), F.lit(1)), (c >= 0.85, F.lit(1))], F.lit(0))


# Label sources from most to least trusted.
LABEL_SOURCES = ["analyst", "verifier", "pseudo_positive", "pseudo_negative", "anchored_negative"]


def label_hierarchy(labels: DataFrame, key: str = "event_id") -> DataFrame:
    """Most trusted label of each event."""
    trust = F.array_position(F.array(*[F.lit(s) for s in LABEL_SOURCES]), F.col("label_source"))
    ranked = labels.withColumn("_t", F.when(trust > 0, trust))
    return ranked.where(F.col("_t").isNotNull()).groupBy(key).agg(F.min(F.struct("_t", "label", "label_source")).alias("b")).select(key, "b.label", "b.label_source")


# ---- drift -----------------------------------------------------------------------------


def _histograms(base: DataFrame, now: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, bin, p, q, width, np, nq): counts of both sides in bins over their common range.

    The ranges of all features are one row of columns, and every row is binned in place.
    """
    sides = base.select(F.lit(True).alias("_p"), *[F.col(f).cast("double").alias(f) for f in features]).unionByName(now.select(F.lit(False).alias("_p"), *[F.col(f).cast("double").alias(f) for f in features]))
    bounds = sides.agg(*[x for i, f in enumerate(features) for x in (F.min(f).alias(f"_lo{i}"), (F.max(f) + EPS).alias(f"_hi{i}"))])
    width = lambda i: (F.col(f"_hi{i}") - F.col(f"_lo{i}")) / BINS
    bin_of = lambda i, f: F.least(F.floor((F.col(f) - F.col(f"_lo{i}")) / width(i)), F.lit(BINS - 1))
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), bin_of(i, f).alias("bin"), width(i).alias("width")) for i, f in enumerate(features)])
    rows = sides.crossJoin(F.broadcast(bounds)).select("_p", F.inline(cells)).where("bin IS NOT NULL")  # one row
    counts = rows.groupBy("feature", "bin").agg(F.count_if("_p").alias("p"), F.count_if(~F.col("_p")).alias("q"))
    totals = rows.groupBy("feature").agg(F.first("width").alias("width"), F.count_if("_p").alias("np"), F.count_if(~F.col("_p")).alias("nq"))
    grid = totals.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(BINS - 1).cast("bigint"))).alias("bin"))  # a row per feature and bin
    return grid.join(counts, ["feature", "bin"], "left").fillna(0, ["p", "q"])


def drift_kl(base: DataFrame, now: DataFrame, features: Sequence[str]) -> DataFrame:
    """Symmetric divergence of the densities per feature."""
    h = _histograms(base, now, features)
    p, q = F.col("p") / (F.col("np") * F.col("width")) + EPS, F.col("q") / (F.col("nq") * F.col("width")) + EPS
    return h.groupBy("feature").agg(((F.sum(p * F.log(p / q)) + F.sum(q * F.log(q / p))) / 2).alias("kl"))


def drift_psi(base: DataFrame, now: DataFrame, features: Sequence[str] = PSI_FEATURES) -> DataFrame:
    """Population stability index per feature."""
    h = _histograms(base, now, features)
    e, a = F.col("p") / (F.col("np") + EPS), F.col("q") / (F.col("nq") + EPS)
    e, a = F.when(e == 0, EPS).otherwise(e), F.when(a == 0, EPS).otherwise(a)
    return h.groupBy("feature").agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


def drift_report(rows: DataFrame, as_of, features: Sequence[str], psi_features: Sequence[str] = PSI_FEATURES, anchor: str = "adjusted_score", ts: str = "recorded_at", base_days: int = 7, now_days: int = 1) -> DataFrame:
    """One row: divergences, shift of the mean score, affected features and the drift flag."""
    base, now = (rows.where(since(ts, as_of, f"{days} DAYS")) for days in (base_days, now_days))
    kl = drift_kl(base, now, features).agg(F.avg("kl").alias("kl_divergence"), F.array_sort(F.collect_list(F.when(F.col("kl") > KL_LIMIT, F.col("feature")))).alias("affected_features"))
    psi = drift_psi(base, now, psi_features).agg(F.avg("psi").alias("psi"))
    sides = base.agg(F.count("*").alias("n_base"), F.avg(anchor).alias("_mb")).crossJoin(now.agg(F.count("*").alias("n_now"), F.avg(anchor).alias("_mn")))  # one row each
    one = kl.crossJoin(psi).crossJoin(sides).withColumn("triage_anchor_divergence", F.abs(F.col("_mb") - F.col("_mn"))).drop("_mb", "_mn")
    enough = (F.col("n_base") >= 10) & (F.col("n_now") >= 5)
    drift = (F.col("kl_divergence") > KL_LIMIT) | (F.col("psi") > PSI_LIMIT) | (F.col("triage_anchor_divergence") > SHIFT_LIMIT)
    return one.withColumn("drift_detected", F.when(enough, drift.cast("int")).otherwise(0))


def triage_anchored_divergence(verdicts: DataFrame) -> DataFrame:
    """Mean absolute difference and bias of the verdict against its trigger."""
    d = F.col("confidence") - F.col("trigger_score")
    return verdicts.agg(F.avg(F.abs(d)).alias("divergence"), F.avg(d).alias("bias"), F.count("*").alias("n"))
