"""The corpus operators' queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import archives, bpe, decontamination, fingerprint, hardneg, licenses, mixing, pii, sharding, simhash, topk, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive_pages(_table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.balanced_mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(vectors.withColumn("label", moved))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_OP2_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM g
"""

_OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

#: A window's rarest word (of equals the first) says where it may start; its other words may miss their places by two.
_OP13_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), i AS MATERIALIZED (
  SELECT DISTINCT item, list_slice(w, p, p + 9) AS x FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)
), win AS MATERIALIZED (
  SELECT row_number() OVER () AS n, x FROM (SELECT DISTINCT x FROM i)
), k AS MATERIALIZED (
  SELECT n, p, x[p] AS word FROM (SELECT n, x, unnest(range(1, len(x) + 1)) AS p FROM win)
), t AS MATERIALIZED (
  SELECT r, p AS pos, w[p] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d) WHERE w[p] IN (SELECT word FROM k)
), f AS (
  SELECT word, count(*) AS c FROM t GROUP BY word
), h AS (
  SELECT n, p, word FROM k JOIN f USING (word) QUALIFY row_number() OVER (PARTITION BY n ORDER BY c, p) = 1
), s AS MATERIALIZED (
  SELECT r, n, pos - p AS start FROM h JOIN t USING (word)
), m AS (
  SELECT s.r, s.n, s.start, k.p, min(abs(t.pos - (s.start + k.p))) AS miss
  FROM s JOIN k USING (n) JOIN t ON t.r = s.r AND t.word = k.word AND t.pos BETWEEN s.start + k.p - 2 AND s.start + k.p + 2 GROUP BY ALL
), o AS MATERIALIZED (
  SELECT m.r, m.n, m.start, len(win.x) AS size, max(m.miss) = 0 AS exact FROM m JOIN win USING (n) GROUP BY ALL HAVING count(*) = len(win.x)
), g AS (
  SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(start + 1, start + size + 1)) FROM o WHERE exact) GROUP BY r
), a AS (
  SELECT o.r, i.item, bool_or(o.exact) AS exact FROM o JOIN win USING (n) JOIN i USING (x) WHERE i.item IS NOT NULL GROUP BY ALL
), l AS (
  SELECT r, count(*) FILTER (WHERE exact) AS n_items, string_agg(item, ',' ORDER BY item) FILTER (WHERE exact) AS ids, count(*) AS n_near_items FROM a GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN g USING (r) LEFT JOIN l USING (r)
"""

_OP11_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS alike, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_warc, op3_bpe, op4_fingerprint, op5_toxicity, op6_licenses, op7_topk, op8_mixing, op9_pii, op10_sharding, op11_hard_negatives, op12_whitening, op13_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": _OP2_SQL, "op7_topk": _OP7_SQL, "op11_hard_negatives": _OP11_SQL, "op13_decontamination": _OP13_SQL}
