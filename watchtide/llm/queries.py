"""One registered query per operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from watchtide.llm import dartminhash, decontaminate, divergence, html_extract, imatch, langid, merkle, packing, suffix_dedup, suffix_tree, token_rollup, toxicity, warc
from watchtide.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    archives = warc.write(table(spark, sf_dir, "pages"), folder)
    found = warc.read(archives, folder)
    return found.select(warc.page_of("record_id").alias("page_id"), F.col("content_length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", warc.page_of("refers_to").alias("refers_to"))


ORACLES["op1_warc"] = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), coded AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 8), lambda k: list_reduce(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(k AS INTEGER) * 5 + 1, 5) AS BIGINT) >> s) & 31 AS INTEGER) + 1, 1)), lambda a, b: a || b)), '') AS payload_digest
  FROM hashed
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM coded
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM firsts
"""


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted, recounted with single spaces, and toxic ones deleted; the second batch comes twice."""
    counts = cut_lineage(token_rollup.count(table(spark, sf_dir, "documents"), {"byte_bpe_50k": tokenizer(), "words": "words"}, lambda text: " ".join(text.split())))
    toxic = table(spark, sf_dir, "labels").where("toxic > 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    gone = counts.join(toxic, "doc_id", "left_semi").withColumn("n_tokens", F.col("n_revised"))
    folder = token_rollup.new_folder(spark)
    for batch, deltas in ((1, token_rollup.inserted(counts)), (2, token_rollup.revised(counts)), (2, token_rollup.revised(counts)), (3, token_rollup.deleted(gone))):
        token_rollup.commit(deltas, folder, batch)
    return token_rollup.totals(spark, folder)


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out().alias("held_out"), F.col("_lang.pred").alias("lang_pred"), F.col("_lang.score").alias("score"), F.size("_lang.spans").cast("long").alias("n_spans"))


#: A document counts as toxic from this score on.
TOXIC = 0.3


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~langid.held_out()))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out().alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= TOXIC).cast("int").alias("predicted"))


@query
def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return imatch.edited(docs, imatch.fit(docs))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLES["op8_decontamination"] = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w,
    row_number() OVER () AS r
  FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), cuts AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM cuts
), sizes AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n
), hits AS (
  SELECT p.r, p.i, p.n, windows.item_id FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM places) p JOIN windows USING (n, win)
), covered AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r
), found AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY r
)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


@query
def op10_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dartminhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("is_kept"))


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.digest(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


ORACLES["op2_suffix_dedup"] = """
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), hexes AS (
  SELECT r, doc_id, octet_length(b) AS n, lower(hex(b)) AS h FROM texts
), places AS (
  SELECT r, coalesce(doc_id, 9223372036854775807) AS d, h, unnest(range(0, n - 49)) AS i FROM hexes WHERE n >= 50
), windows AS (
  SELECT r, d, i, md5_number(substr(h, 2 * i + 1, 100)) AS win FROM places
), first AS (
  SELECT win, min(d) AS d FROM windows GROUP BY win
), hit AS (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM windows JOIN first USING (win) WHERE first.d < windows.d
), runs AS (
  SELECT r, i, sum(CASE WHEN before IS NULL OR before + 50 < i THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM hit
), spans AS (
  SELECT r, run, min(i) AS s, max(i) + 50 AS e FROM runs GROUP BY r, run
), gaps AS (
  SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS s, s AS e FROM spans
  UNION ALL SELECT r, max(e), NULL FROM spans GROUP BY r
), kept AS (
  SELECT r, string_agg(CASE WHEN gaps.e IS NULL THEN substr(h, 2 * s + 1) ELSE substr(h, 2 * s + 1, 2 * (gaps.e - s)) END, '' ORDER BY s) AS h FROM gaps JOIN hexes USING (r) GROUP BY r
), counts AS (
  SELECT r, sum(e - s) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN hexes.h ELSE kept.h END)) AS kept_sha256
FROM hexes LEFT JOIN counts USING (r) LEFT JOIN kept USING (r)
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


ORACLES["op10_dartminhash"] = """
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 0 THEN '=' || text ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, text, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE pairs.n >= 0.8 * (p.n + q.n - pairs.n)
), both_ways AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT reached.doc_id, both_ways.b FROM reached JOIN both_ways ON both_ways.a = reached.other
)
SELECT doc_id, min(other) AS class_id, doc_id = min(other) AS is_kept FROM reached GROUP BY doc_id
"""


#: Levels of a tree that the SQL below goes up: 16 to this power leaves.
SQL_LEVELS = 6


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))"
    return f"xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: {byte}))"


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document, by its id's checksum, is checked with its letters in lower case."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf(*fields, F.translate("text", upper, lower)))
    out = merkle.manifest(table(spark, sf_dir, "documents"), changed=changed)
    out = out.withColumn("folded_root", merkle.folded(F.coalesce("changed", "leaf")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _merkle_sql() -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = f"""
WITH leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || source, '-') AS tree, {leaf('text')} AS h, CASE WHEN {_crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS x
  FROM documents
), a0 AS MATERIALIZED (
  SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id, h) - 1 AS i, h FROM leaves
)"""
    for t, last in (("a", "subs"), ("b", "tops")):
        for k in range(SQL_LEVELS):  # a run's digests in order, and the next level, where a lone node stays as it is
            sql += f""", {t}r{k} AS MATERIALIZED (
  SELECT tree, i // 16 AS run, list(h ORDER BY i) AS hs, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {t}{k}) GROUP BY tree, i // 16
), {t}{k + 1} AS MATERIALIZED (
  SELECT tree, run AS i, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {t}r{k}
)"""
        sql += f", {last} AS (SELECT tree, h FROM {t}{SQL_LEVELS})"
        if t == "a":
            sql += ", b0 AS MATERIALIZED (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, h, tree AS of FROM subs)"
    sql += """, f0 AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, h) - 1 AS i, '' AS proof FROM leaves
)"""
    step = lambda r, n: f"""  SELECT f.* REPLACE (i // 16 AS i, CASE WHEN n > 1 THEN sha256(array_to_string(hs[1:i % 16], '') || x || array_to_string(hs[i % 16 + 2:], '')) ELSE x END AS x,
    CASE WHEN n > 1 THEN proof || array_to_string(hs[1:i % 16], '') || array_to_string(hs[i % 16 + 2:], '') ELSE proof END AS proof)
  FROM f{n} f JOIN {r} r ON r.tree = f.tree AND r.run = f.i // 16"""  # noqa: E731
    for k in range(SQL_LEVELS):
        sql += f", f{k + 1} AS MATERIALIZED (\n{step(f'ar{k}', k)}\n)"
    sql += f""", f{SQL_LEVELS + 1} AS MATERIALIZED (
  SELECT doc_id, f.h, x, proof, '' AS tree, b0.i, subs.h AS subroot FROM f{SQL_LEVELS} f JOIN subs USING (tree) JOIN b0 ON b0.of = f.tree
)"""
    for k in range(SQL_LEVELS):
        sql += f", f{SQL_LEVELS + 2 + k} AS MATERIALIZED (\n{step(f'br{k}', SQL_LEVELS + 1 + k)}\n)"
    return sql + f"""
SELECT doc_id, f.h AS leaf, subroot, tops.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = tops.h AS verified FROM f{2 * SQL_LEVELS + 1} f, tops
"""


ORACLES["op12_merkle_manifest"] = _merkle_sql()


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", "rank")


ORACLES["op13_source_divergence"] = """
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), words AS (
  SELECT r, lang, source, unnest(w) AS term FROM docs
), kept AS MATERIALIZED (
  SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 3
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL
), dense AS MATERIALIZED (
  SELECT g.lang, g.source, kept.term, coalesce(counts.n, 0) AS n, kept.n AS lang_n
  FROM (SELECT DISTINCT lang, source FROM docs) g JOIN kept USING (lang) LEFT JOIN counts ON counts.lang = g.lang AND counts.source = g.source AND counts.term = kept.term
), totals AS (
  SELECT lang, source, sum(n) + count(*) AS total, sum(lang_n) + count(*) AS lang_total FROM dense GROUP BY ALL
), shares AS MATERIALIZED (
  SELECT d.lang, d.source, d.term, d.n, CAST(1 + 1000000000 * (d.n + 1) // t.total AS BIGINT) AS p, CAST(1 + 1000000000 * (d.lang_n + 1) // t.lang_total AS BIGINT) AS q
  FROM dense d JOIN totals t USING (lang, source)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM (SELECT DISTINCT lang, source FROM docs) g JOIN (SELECT DISTINCT lang, source FROM docs) o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = o.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found QUALIFY part = 'pair' OR rank <= 200
"""


@query
def op11_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_tree.score(*suffix_tree.fit(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
