"""Nearest-neighbour search over embedding tables and the texts that are embedded."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from watchtide.session import cut_lineage

MOST_LISTS = 4096  # centres that the driver and every task hold; with more rows the lists get longer and are split
MOST_ROWS = 8_192  # base rows, and queries, that a task holds
_SLICE = 1024  # rows compared at a time
_VISITORS = 256  # queries that are sent to their lists at a time
_NONE = np.iinfo(np.int64).max
EMBEDDERS: dict[str, object] = {}


def register_embedder(name: str, fn) -> None:
    """A pandas_udf from text to array<float>."""
    EMBEDDERS[name] = fn


def normalize_vectors(vector: str = "embedding") -> Column:
    """Unit length; a zero vector stays."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def hashed_embedding(df: DataFrame, text: str, out: str = "vector", dim: int = 256) -> DataFrame:
    """Built-in embedding: hashed word counts of unit length."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = df.withColumn("_w", F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != ""))
    tf = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dim).transform(words)
    unit = Normalizer(inputCol="_tf", outputCol="_u").transform(tf)
    return unit.withColumn(out, vector_to_array("_u", "float32")).drop("_w", "_tf", "_u")


def embed(df: DataFrame, text: str, out: str = "vector", embedder: str | None = None, dim: int = 256) -> DataFrame:
    return hashed_embedding(df, text, out, dim) if embedder is None else df.withColumn(out, EMBEDDERS[embedder](F.col(text)))


def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    d = x @ q.T
    if metric == "cosine":
        d /= np.maximum(np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)), 1e-300)
        np.subtract(1.0, d, out=d)
    else:
        d *= -2.0
        d += (x * x).sum(1)[:, None]
        d += (q * q).sum(1)
    return np.maximum(d, 0.0, out=d)


def _between(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows that stand side by side."""
    dot = np.einsum("ij,ij->i", x, q)
    if metric == "cosine":
        d = 1.0 - dot / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(q, axis=1), 1e-300)
    else:
        d = (x * x).sum(1) + (q * q).sum(1) - 2.0 * dot
    return np.maximum(d, 0.0)


def _near(x: np.ndarray, q: np.ndarray, worst: np.ndarray, metric: str) -> np.ndarray:
    """Places in a table of q by x of pairs among which are all that are no further apart than worst.

    One product in single precision, of rows round their mean, is compared with a bound that allows for its rounding, so some pairs may be further apart.
    """
    if metric == "cosine":  # unit vectors are apart by the root of twice their distance
        x, q, worst = _unit(x), _unit(q), 2.0 * worst
    middle = x.mean(0)
    left, right = np.c_[q - middle, np.ones(len(q))], np.c_[x - middle, np.zeros(len(x))]
    square = (left[:, :-1] ** 2).sum(1)
    right[:, -1] = (right * right).sum(1) / -2.0
    size = square.max(initial=0.0) - 4.0 * right[:, -1].min(initial=0.0)
    if not size < 1e30:  # beyond single precision, or not a number
        return np.arange(len(q) * len(x))
    low = (square - worst) / 2.0 - (left.shape[1] * 2.0**-22 * size + 1e-9)
    return np.flatnonzero(left.astype(np.float32) @ right.astype(np.float32).T >= np.maximum(low, -1e35).astype(np.float32)[:, None])


def _fold(x: np.ndarray, ids: np.ndarray, q: np.ndarray, rows: np.ndarray, k: int, metric: str, limit: np.ndarray, best_d: np.ndarray, best_i: np.ndarray) -> None:
    """Fold base rows into the k best of the queries ``rows``, none beyond their limit; equal distances go to the smaller id."""
    worst, last = best_d[rows, -1], best_i[rows, -1]
    last = np.where(worst <= limit[rows], last, _NONE)
    worst = np.minimum(worst, limit[rows])
    some = q[rows]
    pairs = _near(x, some, worst, metric) if np.isfinite(worst).all() else None
    if pairs is not None and len(pairs) <= len(x) * len(rows) // 32:
        at, j = np.divmod(pairs, len(x))
        found = np.round(_between(x[j], some[at], metric), 9)
    else:
        d = _distances(some, x, metric)
        if d.shape[1] > k and not np.isfinite(worst).all():
            worst = np.where(np.isfinite(worst), worst, np.round(np.partition(d, k - 1, axis=1)[:, k - 1], 9))
        at, j = np.divmod(np.flatnonzero(d <= worst[:, None] + 1e-9), len(x))
        found = np.round(d[at, j], 9)
    new = ids[j]
    keep = (found < worst[at]) | ((found == worst[at]) & (new < last[at]))
    if not keep.any():
        return
    hit, who = np.unique(at[keep], return_inverse=True)
    to = rows[hit]
    who = np.concatenate([np.repeat(np.arange(len(to)), k), who])
    all_d, all_i = np.concatenate([best_d[to].ravel(), found[keep]]), np.concatenate([best_i[to].ravel(), new[keep]])
    order = np.lexsort((all_i, all_d, who))
    first = np.searchsorted(who[order], np.arange(len(to)))
    order = order[(first[:, None] + np.arange(k)).ravel()]
    best_d[to], best_i[to] = all_d[order].reshape(-1, k), all_i[order].reshape(-1, k)


def _rows(qid: np.ndarray, best_d: np.ndarray, best_i: np.ndarray) -> pd.DataFrame:
    k = best_d.shape[1]
    out = pd.DataFrame({"query_id": np.repeat(qid, k), "id": best_i.ravel(), "distance": best_d.ravel()})
    return out[np.isfinite(out["distance"])]


_OUT = "query_id bigint, id bigint, distance double"


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _points(df: DataFrame, key: str, vector: str, same: str | None, kind: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast(kind).alias("v"), (F.col(same).cast("bigint") if same else F.lit(0).cast("bigint")).alias("same"))


def _matrix(vectors: pd.Series, metric: str) -> np.ndarray:
    """Rows to compare by Euclidean distance: for cosine those of unit length, half of whose squared distance is never more."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return _unit(x) if metric == "cosine" else x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = _distances(x, centres, "l2")
    return np.sqrt(d, out=d)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its distance, a few rows at a time: rows by centres is the widest table a task makes."""
    c, gap = np.zeros(len(x), np.int32), np.zeros(len(x))
    for lo in range(0, len(x), _VISITORS):
        d = _gaps(x[lo : lo + _VISITORS], centres)
        c[lo : lo + len(d)], gap[lo : lo + len(d)] = d.argmin(1), d.min(1)
    return c, gap


def _runs(order: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Lists in order, as many together as have the rows of one comparison."""
    cuts, held = [], 0
    for place, n in enumerate(size[order]):
        if held and held + n > _SLICE:
            cuts.append(place)
            held = 0
        held += n
    return np.split(order, cuts)


def _side_by_side(x: np.ndarray) -> np.ndarray:
    """An order of the rows in which near ones stand together: halves along the way to the row that is furthest out, again and again."""
    if len(x) < 3:
        return np.arange(len(x))
    y = x - x.mean(0)
    order = np.argsort(y @ y[(y * y).sum(1).argmax()], kind="stable")
    half = len(x) // 2
    return np.concatenate([part[_side_by_side(x[part])] for part in (order[:half], order[half:])])


class _Lists:
    """Base rows in lists round centres: a bounded number of base rows, as many as the root of the table's size.

    Lists that lie side by side share a block of at most ``most`` rows, so that a query is sent once to a block and not
    to each of its lists; a longer list is a block of its own and is dealt out by salts.
    """

    def __init__(self, base: DataFrame, metric: str, most: int):
        total, kind = base.count(), base.schema["v"].dataType.simpleString()
        lists = max(1, min(MOST_LISTS, math.isqrt(total)))
        picked = base.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(lists).toPandas()
        self.metric, self.most = metric, most
        self.centres = _matrix(picked["v"], metric) if len(picked) else np.zeros((0, 0))
        shared = base.sparkSession.sparkContext.broadcast(self.centres)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                if len(x):
                    c, gap = _nearest(_matrix(x["v"], metric), shared.value)
                    yield x.assign(c=c, gap=gap)

        rows = cut_lineage(base.mapInPandas(place, f"id bigint, v {kind}, same bigint, c int, gap double"))
        sizes = rows.groupBy("c").agg(F.count("*").alias("n"), F.max("gap").alias("r")).collect()  # a row per list
        self.size, self.radius = np.zeros(len(self.centres)), np.full(len(self.centres), -np.inf)
        for r in sizes:
            self.size[r["c"]], self.radius[r["c"]] = r["n"], r["r"]
        self.order = _side_by_side(self.centres)
        self.block, self.starts, held = np.zeros(len(self.centres), np.int32), [], math.inf
        for at, c in enumerate(self.order):
            if held + self.size[c] > most:
                self.starts.append(at)
                held = 0
            held += self.size[c]
            self.block[c] = len(self.starts) - 1
        blocks = base.sparkSession.createDataFrame([(c, int(b)) for c, b in enumerate(self.block)], "c int, b int")
        self.rows = rows.join(F.broadcast(blocks), "c")  # at most MOST_LISTS rows
        self.shared = base.sparkSession.sparkContext.broadcast(self._plain())

    def _plain(self) -> dict:
        return {"centres": self.centres, "size": self.size, "radius": self.radius, "order": self.order, "starts": self.starts}

    def search(self, visits: DataFrame, k: int) -> DataFrame:
        """k best (query_id, id, distance) of each query (id, v, same, b, worst) in each block it visits, none beyond its worst.

        Blocks and their queries are split into salted parts. A task takes the lists of its block one after the other, and leaves
        out queries that have already found k rows nearer than any of the list can be.
        """
        parts = lambda df, name: df.groupBy("same", "b").agg((F.floor(F.count("*") / self.most) + 1).cast("int").alias(name))
        plan = parts(self.rows, "bp").join(parts(visits, "qp"), ["same", "b"])
        salt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        b = self.rows.join(plan, ["same", "b"]).select("id", "v", "same", "c", "b", salt("bp").alias("bs"), F.explode(F.sequence(F.lit(0), F.col("qp") - 1)).alias("qs"))
        q = visits.join(plan, ["same", "b"]).select("id", "v", "same", "worst", "b", salt("qp").alias("qs"), F.explode(F.sequence(F.lit(0), F.col("bp") - 1)).alias("bs"))
        shared, metric = self.shared, self.metric

        def run(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"query_id": [], "id": [], "distance": []}).astype({"query_id": "int64", "id": "int64", "distance": "float64"})]
            if not len(bs) or not len(qs):
                return out[0]
            bs = bs.sort_values(["c", "id"])
            x, ids, c = np.stack(bs["v"].to_numpy()).astype(np.float64), bs["id"].to_numpy(), bs["c"].to_numpy()
            start = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            end, lists = np.append(start[1:], len(c)), c[start]
            centres, radius = shared.value["centres"][lists], shared.value["radius"][lists]
            for lo in range(0, len(qs), _SLICE):
                some = qs.iloc[lo : lo + _SLICE]
                q, limit = np.stack(some["v"].to_numpy()).astype(np.float64), some["worst"].to_numpy()
                least = _gaps(_matrix(some["v"], metric), centres) - radius
                best_d, best_i = np.full((len(some), k), np.inf), np.full((len(some), k), _NONE, dtype=np.int64)
                for near in _runs(np.argsort(least.mean(0), kind="stable"), end - start):
                    places = np.concatenate([np.arange(start[at], end[at]) for at in near])
                    for one in range(0, len(places), _SLICE):
                        reach = _reach(np.minimum(limit, best_d[:, -1]), metric)
                        rows = np.flatnonzero((least[:, near] <= reach[:, None]).any(1))
                        if len(rows):
                            part = places[one : one + _SLICE]
                            _fold(x[part], ids[part], q, rows, k, metric, limit, best_d, best_i)
                out.append(_rows(some["id"].to_numpy(), best_d, best_i))
            return pd.concat(out)

        keys = ["same", "b", "bs", "qs"]
        return q.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(run, _OUT)


def _reach(worst: np.ndarray, metric: str) -> np.ndarray:
    """How far a row may lie, as a Euclidean distance, that is no worse."""
    return np.sqrt(worst * (2 if metric == "cosine" else 1)) + 1e-4


def knn_join(queries: DataFrame, base: DataFrame, k: int, query_id: str, base_id: str, vector: str = "embedding", metric: str = "l2", same: str | None = None, skip_self: bool = False, share: float = 0.0) -> DataFrame:
    """Exact k nearest base rows of every query: (query_id, id, distance, rank). Ids are whole numbers, once each among the queries.

    A query first searches the nearest block of lists, or as many as hold a share of all blocks, and then twice as many in each
    round. The k-th distance found so far rules out, by the triangle inequality, every list whose centre is further than that
    plus the list's radius; a query without blocks left takes no part in later rounds. So about k rows per query and round are
    candidates, not k per block. Queries stay on the cluster, and no pair is written out.
    ``same`` restricts neighbours to rows with an equal whole-number column.
    """
    want = k + 1 if skip_self else k
    single = all(df.schema[vector].dataType.simpleString() == "array<float>" for df in (queries, base))
    kind = "array<float>" if single else "array<double>"
    q, lists = _points(queries, query_id, vector, same, kind), _Lists(_points(base, base_id, vector, same, kind), metric, MOST_ROWS)
    if not len(lists.centres):
        return queries.sparkSession.createDataFrame([], _OUT + ", rank int")
    shared = lists.shared

    def left(rows: pd.DataFrame, lo: int, hi: int) -> np.ndarray:
        """Which blocks, from the lo-th nearest to the hi-th, a query has to search."""
        centres, size, radius, by_block, starts = (shared.value[x] for x in ("centres", "size", "radius", "order", "starts"))
        d = np.where(size > 0, _gaps(_matrix(rows["v"], metric), centres), np.inf)
        near = np.minimum.reduceat(d[:, by_block], starts, axis=1)
        reach = (d - radius <= _reach(rows["worst"].to_numpy(), metric)[:, None]) & (size > 0)
        place = np.argsort(np.argsort(near, axis=1, kind="stable"), axis=1)
        return np.logical_or.reduceat(reach[:, by_block], starts, axis=1) & (place >= lo) & (place < hi)

    def visits(lo: int, hi: int):
        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in some(batches):
                at, b = np.nonzero(left(rows, lo, hi))
                yield rows.iloc[at].assign(b=b.astype("int32"))[["id", "v", "same", "b", "worst"]]

        return go

    def unfinished(lo: int):
        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in some(batches):
                yield rows[left(rows, lo, blocks).any(1)][["id", "v", "same", "worst"]]

        return go

    some = lambda batches: (x.iloc[lo : lo + _VISITORS] for x in batches for lo in range(0, len(x), _VISITORS))
    blocks, columns, never = len(lists.starts), f"id bigint, v {kind}, same bigint, ", F.lit(float("inf"))
    asked, found, lo, hi = q.withColumn("worst", never), None, 0, max(1, int(share * len(lists.starts)))
    while True:
        new = lists.search(asked.mapInPandas(visits(lo, hi), columns + "b int, worst double"), want)
        found = cut_lineage(_best(new if found is None else found.unionByName(new), want))
        if hi >= blocks:
            break
        worst = found.where(F.col("rank") == want).select(F.col("query_id").alias("id"), F.col("distance").alias("worst"))
        found = found.drop("rank")
        asked = asked.drop("worst").join(worst, "id", "left").select("id", "v", "same", F.coalesce("worst", never).alias("worst"))
        asked = cut_lineage(asked.mapInPandas(unfinished(hi), columns + "worst double"))
        if asked.isEmpty():
            break
        lo, hi = hi, 2 * hi
    found = found.drop("rank")
    if skip_self:
        found = found.where("query_id <> id")
    return _best(found, k)


def vector_search(base: DataFrame, query: list[float], k: int, base_id: str, vector: str = "embedding", metric: str = "l2") -> DataFrame:
    """k nearest rows to one vector, without the vectors. The caller filters ``base``."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    square = F.aggregate(F.zip_with(v, q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    dist = square if metric == "l2" else 1 - dot(v, q) / F.sqrt(dot(v, v) * dot(q, q))
    return base.withColumn("distance", dist).drop(vector).orderBy("distance", base_id).limit(k)


def similar_events(base: DataFrame, k: int, base_id: str, ids: list | None = None, vector: str = "embedding", metric: str = "l2") -> DataFrame:
    """Neighbours of stored rows, themselves left out; all rows when no ids are given."""
    queries = base if ids is None else base.where(F.col(base_id).isin(*ids))
    return knn_join(queries, base, k, base_id, base_id, vector, metric, skip_self=True)


def ann_search(queries: DataFrame, base: DataFrame, k: int, query_id: str, base_id: str, vector: str = "embedding", share: float = 0.25) -> DataFrame:
    """Neighbours of every query, by lists: it searches the nearest blocks of lists, a share of all, and
    then the blocks that the distances found do not rule out, twice as many a round. So no neighbour is lost, with clusters or without; the share
    decides how much is searched at first, and rows without clusters are compared about as often as in all pairs, block by block."""
    return knn_join(queries, base, k, query_id, base_id, vector, share=share)


# ---- texts and tables ------------------------------------------------------------------


def log_text(table: str) -> Column:
    """Text of an event that gets embedded."""
    c, lit = F.col, F.lit
    return {
        "raw_logs": lambda: c("message"),
        "security_events": lambda: F.concat(c("category"), lit(": "), c("description"), lit(" ["), c("mitre_tactic"), lit("/"), c("mitre_technique"), lit("]")),
        "process_events": lambda: F.concat(lit("Process: "), c("binary_path"), lit(" "), c("arguments"), lit(" (pid:"), c("pid").cast("string"), lit(")")),
        "network_events": lambda: F.concat(c("src_ip"), lit(":"), c("src_port").cast("string"), lit(" -> "), c("dst_ip"), lit(":"), c("dst_port").cast("string"), lit(" "), c("protocol"), lit(" "), c("dns_query")),
    }[table]()


def intel_text() -> Column:
    return F.concat_ws(" ", "ioc_type", "ioc_value", "description", "tags")


def incident_text() -> Column:
    return F.concat(F.concat_ws(" ", "title", "description", "resolution"), F.lit(" tactics: "), F.col("mitre_tactics"), F.lit(" techniques: "), F.col("mitre_techniques"))


def attack_text() -> Column:
    return F.concat_ws(" ", "source_type", "hostname", "mitre_tactic", "mitre_technique", "template_id", "description")


def log_rows(events: DataFrame, table: str) -> DataFrame:
    """Rows of the log embedding table before embedding."""
    have = set(events.columns)
    source = {"process_events": F.lit(""), "network_events": F.col("protocol")}.get(table, F.col("source") if "source" in have else F.lit(""))
    severity = F.col("severity") if table == "security_events" else F.col("is_suspicious") if table == "process_events" else F.lit(0)
    return events.select(F.col("event_id").cast("string").alias("event_id"), F.col("timestamp").cast("string").alias("timestamp"), F.lit(table).alias("source_table"), source.alias("log_source"),
                         (F.col("hostname") if "hostname" in have and table != "raw_logs" else F.lit("")).alias("hostname"), severity.cast("int").alias("severity"), log_text(table).alias("text"))


def vector_ingest(rows: DataFrame, text: str = "text", embedder: str | None = None) -> DataFrame:
    return embed(rows, text, "vector", embedder)


def attack_embedding_set(scored: DataFrame, feedback: DataFrame, security: DataFrame, min_score: float = 0.8, min_severity: int = 3) -> DataFrame:
    """Confirmed attacks only, once per event: escalated with a high score, confirmed by an analyst, or of high severity."""
    pick = lambda df, source: df.select(F.col("event_id").alias("attack_id"), F.lit(source).alias("label_source"))
    parts = pick(scored.where((F.col("action") == "escalate") & (F.col("adjusted_score") > min_score)), "pseudo_positive")
    parts = parts.unionByName(pick(feedback.where("label = 'true_positive'"), "analyst")).unionByName(pick(security.where(F.col("severity") >= min_severity), "severity"))
    return parts.groupBy("attack_id").agg(F.min("label_source").alias("label_source"))


def incremental_sync(events: DataFrame, since, since_id=None, limit: int = 1000, ts: str = "timestamp") -> DataFrame:
    """Next rows after a watermark in time order; rows of the same time continue by id."""
    from watchtide.functions.expr import moment

    t = moment(since)
    after = F.col(ts) > t
    if since_id is not None:
        after = after | ((F.col(ts) == t) & (F.col("event_id") > F.lit(since_id)))
    return events.where((F.col(ts) >= t) & after).orderBy(ts, "event_id").limit(limit)
