"""Vector search, similarity features and embedding texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchtide.operators import vectors as X
from watchtide.operators.investigate import signals as S
from watchtide.operators.search import vector_filter
from watchtide.plans.registry import query
from watchtide.plans.investigate import scored
from watchtide.plans.triage import RESULTS
from watchtide.sources.views import Tables

D2 = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: power(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2)))"
PAIRS = f"pr AS (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label AS la, b.label AS lb, round(greatest({D2}, 0), 9) AS distance FROM embeddings a, embeddings b)"


def emb(t: Tables):
    return t.spread("embeddings")


@query("vector_search", f"SELECT vec_id, CAST(label AS BIGINT) AS label, round(distance, 6) AS distance FROM (SELECT b.vec_id, b.label, {D2} AS distance FROM embeddings b, (SELECT [0.1::FLOAT for x in range(64)] AS embedding) a WHERE b.label >= 2) ORDER BY distance, vec_id LIMIT 20")
def vector_search(t):
    return X.vector_search(vector_filter(emb(t), "label >= 2", ["label"]), [0.10000000149011612] * 64, 20, "vec_id")


@query("knn_join", f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pr) SELECT query_id, id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 10")
def knn_join(t):
    return X.knn_join(emb(t), emb(t), 10, "vec_id", "vec_id")


@query("similar_events", f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pr WHERE query_id <> id) SELECT query_id, id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5")
def similar_events(t):
    return X.similar_events(emb(t), 5, "vec_id")


@query("ann_search", "SELECT vec_id AS query_id, CAST(10 AS BIGINT) AS found, CAST(1 AS BIGINT) AS itself_first FROM embeddings")
def ann_search(t):
    """Every row is a query: it finds ten rows, itself among the nearest."""
    out = X.ann_search(emb(t), emb(t), 10, "vec_id", "vec_id")
    return out.groupBy("query_id").agg(F.count("*").alias("found"), F.max((F.col("distance") <= 0.000001).cast("int")).alias("itself_first"))


@query("ann_recall", "SELECT count(*) AS queries, CAST(1 AS BIGINT) AS recall_is_high FROM embeddings")
def ann_recall(t):
    """Share of the exact ten neighbours that the search of `ann_search`, with its parameters, finds, over all rows: at least 0.9."""
    near = X.ann_search(emb(t), emb(t), 10, "vec_id", "vec_id").select("query_id", "id")
    exact = X.knn_join(emb(t), emb(t), 10, "vec_id", "vec_id").select("query_id", "id")
    hits = exact.join(near.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).cast("int").alias("recall_is_high"))


ATT, HIS = "label IN (0, 1, 2)", "label IN (3, 4, 5)"


@query("similarity_features", f"""WITH {PAIRS}, ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pr WHERE lb IN (0, 1, 2)), rh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pr WHERE lb IN (3, 4, 5)),
 rl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pr WHERE la = lb),
 xa AS (SELECT query_id, min(distance) AS m, count(*) FILTER (distance < 0.3) AS c3, count(*) FILTER (distance < 0.5) AS c5, min(distance) FILTER (distance < 0.3) AS m3 FROM ra WHERE rank <= 10 GROUP BY 1), xh AS (SELECT query_id, min(distance) AS m FROM rh WHERE rank <= 10 GROUP BY 1), xl AS (SELECT query_id, count(*) FILTER (distance < 0.4) AS c FROM rl WHERE rank <= 20 GROUP BY 1)
SELECT query_id, round(xa.m, 6) AS similarity_attack_embed_dist, c3 AS similarity_confirmed_neighbor_count, round(coalesce(m3, 1.0), 6) AS similarity_min_confirmed_dist, round(CASE WHEN c5 > 0 THEN c3 / c5 ELSE 0 END, 6)::DOUBLE AS similarity_label_confidence, round(xh.m, 6) AS similarity_historical_dist, xl.c AS similarity_log_embed_matches, 0::BIGINT AS similarity_false_positive_count
FROM xa JOIN xh USING (query_id) JOIN xl USING (query_id)""")
def similarity_features(t):
    e = emb(t)
    find = lambda base, k, **kw: X.knn_join(e, base, k, "vec_id", "vec_id", **kw)
    return S.similarity_features(e.select(F.col("vec_id").alias("query_id")), find(e.where(ATT), 10), find(e.where(HIS), 10), find(e, 20, same="label"))


@query("embedding_text", """SELECT 'security_events' AS source_table, CAST(event_id AS VARCHAR) AS event_id, concat(category, ': ', description, ' [', mitre_tactic, '/', mitre_technique, ']') AS text, CAST(severity AS BIGINT) AS severity, hostname FROM fx_security
 UNION ALL SELECT 'process_events', CAST(event_id AS VARCHAR), concat('Process: ', binary_path, ' ', arguments, ' (pid:', pid, ')'), is_suspicious, hostname FROM fx_process
 UNION ALL SELECT 'network_events', CAST(event_id AS VARCHAR), concat(src_ip, ':', src_port, ' -> ', dst_ip, ':', dst_port, ' ', protocol, ' ', dns_query), 0, hostname FROM fx_network UNION ALL SELECT 'raw_logs', CAST(event_id AS VARCHAR), message, 0, '' FROM fx_raw""")
def embedding_text(t):
    out = None
    for table, df in {"raw_logs": t.raw, "security_events": t.security, "process_events": t.process, "network_events": t.network}.items():
        part = X.log_rows(df, table).select("source_table", "event_id", "text", "severity", "hostname")
        out = part if out is None else out.unionByName(part)
    return out


@query("embedding_text_tables", """SELECT 'incident' AS kind, doc_id AS id, concat('case ', source, ' ', lang, ' ', 'closed', ' tactics: ', 'x', ' techniques: ', 'y') AS text FROM documents
 UNION ALL SELECT 'attack', event_id, concat(source_type, ' ', hostname, ' ', mitre_tactic, ' ', mitre_technique, ' ', template_id, ' ', message) FROM fx_scores
 UNION ALL SELECT 'intel', s_suppkey, concat('ip', ' ', s_name, ' ', 'seen', ' ', 'tag') FROM supplier""")
def embedding_text_tables(t):
    inc = t.base("documents").select(F.lit("incident").alias("kind"), F.col("doc_id").alias("id"), F.concat(F.lit("case "), "source").alias("title"), F.col("lang").alias("description"), F.lit("closed").alias("resolution"), F.lit("x").alias("mitre_tactics"), F.lit("y").alias("mitre_techniques"))
    att = t.scores.withColumn("description", F.col("message"))
    intel = t.base("supplier").select(F.lit("intel").alias("kind"), F.col("s_suppkey").alias("id"), F.lit("ip").alias("ioc_type"), F.col("s_name").alias("ioc_value"), F.lit("seen").alias("description"), F.lit("tag").alias("tags"))
    return inc.select("kind", "id", X.incident_text().alias("text")).unionByName(att.select(F.lit("attack").alias("kind"), F.col("event_id").alias("id"), X.attack_text().alias("text"))).unionByName(intel.select("kind", "id", X.intel_text().alias("text")))


@query("vector_ingest", "SELECT CAST(event_id AS VARCHAR) AS event_id, 'raw_logs' AS source_table, CAST(256 AS BIGINT) AS dim, CASE WHEN regexp_matches(message, '[A-Za-z0-9_]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm2 FROM fx_raw")
def vector_ingest(t):
    """Hashed embeddings of every log text: 256 numbers, of unit length if the text has words."""
    out = X.vector_ingest(X.log_rows(t.raw, "raw_logs")).select("event_id", "source_table", F.size("vector").alias("dim"), F.aggregate(F.transform("vector", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x).alias("norm2"))
    return out.withColumn("norm2", F.round("norm2", 4))


@query("attack_embedding_set", f"""WITH {RESULTS}, x AS (SELECT event_id AS attack_id, 'pseudo_positive' AS s FROM res WHERE action = 'escalate' AND adjusted_score > 0.8 UNION ALL SELECT doc_id, 'analyst' FROM labels WHERE toxic = 1 UNION ALL SELECT event_id, 'severity' FROM fx_security WHERE severity >= 4)
SELECT attack_id, min(s) AS label_source FROM x GROUP BY 1""")
def attack_embedding_set(t):
    feedback = t.base("labels").select(F.col("doc_id").alias("event_id"), F.when(F.col("toxic") == 1, "true_positive").otherwise("false_positive").alias("label"))
    return X.attack_embedding_set(scored(t), feedback, t.security, min_severity=4)


@query("vector_table_stats", "SELECT label::BIGINT AS label, count(*) AS n, count(DISTINCT len(embedding)) AS dims FROM embeddings GROUP BY 1")
def vector_table_stats(t):
    return t.base("embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_distinct(F.size("embedding")).alias("dims"))


@query("normalize_vectors", "SELECT vec_id, round(embedding[1]::DOUBLE * 3 / sqrt(list_sum(list_transform(embedding, lambda x: power(x::DOUBLE * 3, 2)))), 6) AS first_value, 1.0::DOUBLE AS norm2 FROM embeddings")
def normalize_vectors(t):
    tripled = t.base("embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * 3))
    unit = tripled.select("vec_id", X.normalize_vectors().alias("u"))
    return unit.select("vec_id", F.get("u", F.lit(0)).alias("first_value"), F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x).alias("norm2"))


@query("incremental_sync", "SELECT event_id, CAST(timestamp AS VARCHAR) AS timestamp FROM fx_raw WHERE timestamp > TIMESTAMP '2024-01-10 00:00:00' ORDER BY fx_raw.timestamp, event_id LIMIT 1000")
def incremental_sync(t):
    return X.incremental_sync(t.raw, "2024-01-10 00:00:00", limit=1000).select("event_id", "timestamp")
