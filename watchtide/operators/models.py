"""Training and scoring. Models are Spark ML, or small trees built per group."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from watchtide.functions.ranking import exact_percentiles, smallest_per_group
from watchtide.operators.evaluate import binary_metrics, train_test
from watchtide.operators.investigate.verdict import FEATURE_ORDER, heuristic_score
from watchtide.operators.triage import calibrated_sigmoid
from watchtide.session import cut_lineage

F1_GATE = 0.80
#: Tasks that may share the rows of one host.
HOST_PARTS = 32
#: Rows that a task of boosting has at least: every level of every tree is a job.
BOOST_ROWS = 20_000
#: Rows that pass an isolation tree together; their values stay in the cache.
WALK_ROWS = 5_000
SCORERS: dict[str, object] = {}


def register_scorer(name: str, scorer) -> None:
    """A fitted transformer, or a function from DataFrame to DataFrame that adds a score column."""
    SCORERS[name] = scorer


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep").transform(df)


def _weighted(df: DataFrame, label: str) -> DataFrame:
    """Weight positives by the ratio of negatives to positives."""
    ratio = df.agg((F.count_if(F.col(label) == 0) / F.greatest(F.count_if(F.col(label) == 1), F.lit(1))).alias("_r"))
    return df.crossJoin(F.broadcast(ratio)).withColumn("_w", F.when(F.col(label) == 1, F.col("_r")).otherwise(1.0)).drop("_r")  # one row


def probability(df: DataFrame, model, features: Sequence[str], out: str = "score") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(_assembled(df, features))
    return scored.withColumn(out, F.get(vector_to_array("probability"), F.lit(1))).drop("_x", "rawPrediction", "probability", "prediction")


def _boosting_rows(df: DataFrame) -> DataFrame:
    """Training rows written once, in as many tasks as they are worth; the checkpoints of rounds lie in the same folder."""
    rows = cut_lineage(df)
    return rows.coalesce(max(1, rows.count() // BOOST_ROWS))


def train_supervised(df: DataFrame, features: Sequence[str], label: str, key: list[str], rounds: int = 100, depth: int = 6, seed: int = 42, strata: Sequence[str] = ()):
    """Boosted trees; returns (model, metrics, importances). ``passed`` is the F1 gate.

    The split is by hash, and each label (of each dataset, or whatever else is in ``strata``) gives its exact share.
    """
    from pyspark.ml.classification import GBTClassifier

    train, test = train_test(df, key, seed=seed, strata=[*strata, label])
    fit = GBTClassifier(featuresCol="_x", labelCol=label, weightCol="_w", maxIter=rounds, maxDepth=depth, seed=seed)
    model = fit.fit(_boosting_rows(_assembled(_weighted(train, label), features).select("_x", "_w", label)))
    metrics = binary_metrics(probability(test, model, features), "score", label, [0.5]).withColumn("passed", (F.col("f1") >= F1_GATE).cast("int"))
    weights = [(f, float(w)) for f, w in zip(features, model.featureImportances.toArray())]
    return model, metrics, df.sparkSession.createDataFrame(weights, "feature string, importance double")


def train_verdict_model(df: DataFrame, label: str = "label", vector: str = "feature_vector", rounds: int = 300, depth: int = 6, step: float = 0.05, positive_weight: float = 3.0, seed: int = 42):
    """Boosted trees on the ordered verdict features."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(vector).alias("_x"), F.col(label).cast("double").alias("label"), F.when(F.col(label) == 1, positive_weight).otherwise(1.0).alias("_w"))
    return GBTClassifier(featuresCol="_x", labelCol="label", weightCol="_w", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed).fit(_boosting_rows(rows))


def score_with_model(df: DataFrame, model=None, vector: str = "feature_vector", out: str = "hunter_score") -> DataFrame:
    """Probability of a trained model, else the heuristic."""
    if model is None:
        return df.withColumns({out: heuristic_score(vector), "model_used": F.lit("heuristic")})
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(df.withColumn("_x", array_to_vector(vector)))
    return scored.withColumns({out: F.get(vector_to_array("probability"), F.lit(1)), "model_used": F.lit("model")}).drop("_x", "rawPrediction", "probability", "prediction")


def refit_streaming_model(replay: DataFrame, features: Sequence[str], label: str = "label", trees: int = 10, seed: int = 42):
    """Third scorer, fitted again from the replay window whenever the caller decides."""
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=8, seed=seed).fit(_assembled(replay, features))


# ---- isolation forest ------------------------------------------------------------------


def _grow(x: np.ndarray, depth: int, limit: int, rng: np.random.Generator, extension: int) -> dict:
    """Split by random planes that involve ``extension + 1`` features."""
    if depth >= limit or len(x) <= 1:
        return {"n": int(len(x))}
    low, high = x.min(0), x.max(0)
    open_dims = np.flatnonzero(high > low)
    if not len(open_dims):
        return {"n": int(len(x))}
    dims = rng.choice(open_dims, size=min(extension + 1, len(open_dims)), replace=False)
    normal, point = rng.normal(size=len(dims)), rng.uniform(low[dims], high[dims])
    side = (x[:, dims] - point) @ normal <= 0
    return {"d": dims.tolist(), "w": normal.tolist(), "c": float(point @ normal), "l": _grow(x[side], depth + 1, limit, rng, extension), "r": _grow(x[~side], depth + 1, limit, rng, extension)}


def _mean_path(n) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _flat(tree: dict) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, int]:
    """A tree as arrays by node: features and weights of its plane, bound, children (right, left), path length; and its height. A leaf leads to itself."""
    nodes, children, height = [(tree, 0)], [], 0
    for at, (node, depth) in enumerate(nodes):
        height = max(height, depth)
        if "n" in node:
            children += [at, at]
        else:
            children += [len(nodes) + 1, len(nodes)]
            nodes += [(node["l"], depth + 1), (node["r"], depth + 1)]
    wide = max([len(n["d"]) for n, _ in nodes if "d" in n], default=0)
    dims = [np.array([n["d"][min(k, len(n["d"]) - 1)] if "d" in n else 0 for n, _ in nodes]) for k in range(wide)]
    weights = [np.array([n["w"][k] if k < len(n.get("w", ())) else 0.0 for n, _ in nodes]) for k in range(wide)]
    bound = np.array([n.get("c", 0.0) for n, _ in nodes])
    return dims, weights, bound, np.array(children), np.array([depth + _mean_path(n["n"]) if "n" in n else 0.0 for n, depth in nodes]), height


def _walk(flat: tuple, x: np.ndarray) -> np.ndarray:
    """Path lengths of rows, all of them a level down at a time."""
    dims, weights, bound, children, length, height = flat
    at, cells, first = np.zeros(len(x), np.int64), x.ravel(), np.arange(len(x)) * x.shape[1]
    for _ in range(height):
        place = np.zeros(len(x))
        for d, w in zip(dims, weights):
            place += cells.take(first + d.take(at)) * w.take(at)
        at = children.take(2 * at + (place <= bound.take(at)))
    return length[at]


def _lengths(tree: dict, x: np.ndarray) -> np.ndarray:
    return _walk(_flat(tree), x)


def grow_forest(normal: DataFrame, features: Sequence[str], trees: int = 300, sample: int = 256, extension: int = 1, seed: int = 42) -> list[dict]:
    """One tree per group of sampled rows; a few hundred small trees come back to the driver."""
    count = normal.count()
    share = min(1.0, 1.5 * trees * sample / max(1, count))
    copies = max(1, -(-trees * sample // max(1, count)))  # small inputs serve several trees
    # draws by the row itself, so the forest does not depend on partitions
    own = [F.col(f"`{c}`") for c, kind in normal.dtypes if not kind.startswith("map")]
    draw = lambda k, *more: F.pmod(F.xxhash64(F.lit(seed + k), *own, *more), F.lit(1 << 40)) / float(1 << 40)
    drawn = normal.where(draw(0) < share).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    drawn = drawn.select(*features, F.floor(draw(1, F.col("_copy")) * trees).cast("int").alias("tree"), draw(2, F.col("_copy")).alias("_o"))
    picked = smallest_per_group(drawn, ["tree"], ["_o"], sample, salts=1)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["tree"].iloc[0])
        x = rows.sort_values("_o", kind="stable")[list(features)].to_numpy(dtype=np.float64)
        root = _grow(x, 0, int(np.ceil(np.log2(max(2, sample)))), np.random.default_rng(seed + number), extension)
        return pd.DataFrame({"tree": [number], "body": [json.dumps(root)]})

    grown = picked.groupBy("tree").applyInPandas(build, "tree int, body string").orderBy("tree").collect()
    return [json.loads(r["body"]) for r in grown]


def path_score(df: DataFrame, forest: list[dict], features: Sequence[str], sample: int = 256, out: str = "raw") -> DataFrame:
    """Anomaly measure 2^(-path / expected path) of every row; the forest is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast([_flat(t) for t in forest])

    @F.pandas_udf("double")
    def mean_path(x: pd.DataFrame) -> pd.Series:
        rows = np.nan_to_num(np.ascontiguousarray(x.to_numpy(dtype=np.float64)), nan=0.0, posinf=1e9, neginf=-1e9)
        total = np.zeros(len(rows))
        for first in range(0, len(rows), WALK_ROWS):
            some = rows[first : first + WALK_ROWS]
            for flat in shared.value:
                total[first : first + WALK_ROWS] += _walk(flat, some)
        return pd.Series(2.0 ** (-total / len(shared.value) / _mean_path(sample)))

    return df.withColumn(out, mean_path(F.struct(*features)))


def train_isolation_forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 300, sample: int = 256, seed: int = 42) -> tuple[list[dict], dict]:
    """Forest from normal rows with calibration: mean and deviation, 99th percentile, and whether the order is inverted."""
    forest = grow_forest(df.where(F.col(label) == 0), features, trees, sample, seed=seed)
    # every row passes the forest once; the statistics, read several times, have two columns
    raw = cut_lineage(path_score(df.select(*features, label), forest, features, sample).select(label, "raw"))
    stats = raw.agg(*[f(F.when(F.col(label) == 0, F.col("raw"))).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_pop))], F.avg(F.when(F.col(label) == 1, F.col("raw"))).alias("bad")).first()
    flip = stats["bad"] is not None and stats["bad"] > stats["mean"]  # the score falls with the raw value unless flipped
    p99 = exact_percentiles(raw.where(F.col(label) == 0).withColumn("s", isolation_score("raw", stats["mean"], stats["std"], flip)), [], "s", {"p99": 0.99}).first()["p99"]
    return forest, {"mean": stats["mean"], "std": stats["std"], "flip": bool(flip), "threshold": p99}


def isolation_score(raw: str, mean: float, std: float, flip: bool) -> Column:
    return calibrated_sigmoid(raw, mean, std, flip)


# ---- training rows ---------------------------------------------------------------------


def augment_rows(df: DataFrame, vector: str = "feature_vector", copies: int = 4, noise: float = 0.04, seed: int = 42) -> DataFrame:
    """Noisy copies: zeros get a little noise now and then, scores stay in range, counts vary in proportion."""
    df = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    size = len(FEATURE_ORDER)
    gauss, even, chance = (F.array(*[f(seed + base + i) for i in range(size)]) for f, base in ((F.randn, 0), (F.rand, 1000), (F.rand, 2000)))
    df = df.withColumns({"_g": gauss, "_u": even, "_c": chance})
    new = F.transform(F.col(vector), lambda v, i: F.when(v == 0, F.when(F.get("_c", i) < 0.3, F.get("_u", i) * noise).otherwise(0.0))
                      .when((v > 0) & (v <= 1), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v + F.get("_g", i) * noise))).otherwise(F.greatest(F.lit(0.0), v + F.get("_g", i) * noise * v)))
    return df.withColumn(vector, new).drop("_g", "_u", "_c")


def training_set_assembly(scored: DataFrame, context: DataFrame, history: DataFrame, label: Column, similarity: DataFrame | None = None) -> DataFrame:
    """Scores with host context, host history and label as ordered feature rows."""
    from watchtide.operators.investigate.verdict import hunter_features

    ctx = context.select("hostname", F.col("unique_destinations").alias("graph_unique_destinations"), F.col("unique_src_ips").alias("graph_unique_src_ips"), F.col("hop_count").alias("graph_hop_count"))
    past = history.select("hostname", F.col("escalation_count").alias("temporal_escalation_count"), F.col("mean_score").alias("temporal_mean_score"))
    known = ctx.join(past, "hostname", "full")
    if similarity is not None:
        known = known.join(similarity, "hostname", "full")
    # a busy host's rows are dealt out by their ids; what is known of a host goes to each part
    known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(HOST_PARTS - 1))))
    salted = scored.withColumns({"label": label, "_salt": F.pmod(F.xxhash64("event_id"), F.lit(HOST_PARTS)).cast("int")})
    out = salted.join(known, ["hostname", "_salt"], "left").drop("_salt")
    near = {c: F.coalesce(c, F.lit(1.0)) if c in out.columns else F.lit(1.0) for c in ("similarity_attack_embed_dist", "similarity_historical_dist", "similarity_min_confirmed_dist")}
    fixed = {"asset_multiplier": F.lit(1.0), "temporal_unique_categories": F.lit(1), "temporal_tactic_diversity": F.lit(0), "mitre_match_count": F.lit(2), "mitre_tactic_breadth": F.lit(1)}
    return hunter_features(out.withColumns({**near, **fixed})).select("event_id", "hostname", "label", "feature_vector")
