"""The registered query of each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeway.llm import ann, line_dedup, mixing, pieces, quality, secrets, sharding, simhash, token_files, url_filter
from galeway.llm.common import _written, shared_dir, table

#: Relative weights of sources; others have 1.
WEIGHTS = {"src0": 5.0}
BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_dir(spark)}/galeway-ledger-{uuid.uuid4().hex}"
    ledger = secrets.Ledger(spark, path).update(docs)
    _written.append((spark, path))
    return secrets.digest(secrets.findings(docs, ledger))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), WEIGHTS)
    return mixed.select("doc_id", "source", "block", "slot", "start", "phase")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/galeway-{uuid.uuid4().hex}"
    token_files.write_blocks(table(spark, sf_dir, "documents"), path, token_files.vocabulary(BPE))
    _written.append((spark, path))
    return token_files.read_blocks(spark, path)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", pieces.digest(spark, F.col("text"), token_files.vocabulary(PIECES)).alias("d")).select("doc_id", "d.*")


QUERIES = {f.__name__: f for f in (
    op1_url_filters, op2_nearest_neighbours, op3_line_dedup, op4_secret_scans, op5_simhash_near_dedup,
    op6_quality_rules, op7_mixing, op8_sharding, op9_token_files, op10_pieces,
)}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH rules(action, r_host, r_path) AS (VALUES {", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in url_filter.RULES)}),
cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
)
SELECT page_id, host, path,
  (SELECT r_host || r_path FROM rules WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) ORDER BY length(r_host || r_path) DESC, action DESC LIMIT 1) AS rule,
  coalesce((SELECT action FROM rules WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) ORDER BY length(r_host || r_path) DESC, action DESC LIMIT 1), '{url_filter.DEFAULT}') AS verdict
FROM parts
"""

_RUN = "{w} AS (PARTITION BY doc_id ORDER BY {o} RANGE BETWEEN {a} PRECEDING AND {b} FOLLOWING)"
OP3_SQL = rf"""
WITH cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, pos - 1 AS pos, ls[pos] AS line, len(regexp_extract_all(ls[pos], '[^\x20\x09-\x0D]+')) AS nw
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM cut)
), units AS (
  SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY pos) AS e, sum(nw) OVER (PARTITION BY doc_id ORDER BY pos) - nw AS s FROM lines WHERE nw > 0
), runs AS (
  SELECT doc_id, min(pos) OVER f AS lo, max(pos) OVER f AS hi, sum(nw) OVER f AS n, list(line) OVER f AS body FROM units
  WINDOW {_RUN.format(w="f", o="s", a=0, b=line_dedup.MIN_WORDS - 1)}
  UNION
  SELECT doc_id, min(pos) OVER b, max(pos) OVER b, sum(nw) OVER b, list(line) OVER b FROM units
  WINDOW {_RUN.format(w="b", o="e", a=line_dedup.MIN_WORDS - 1, b=0)}
), whole AS (SELECT doc_id, lo, hi, md5(array_to_string(body, chr(10))) AS k FROM runs WHERE n >= {line_dedup.MIN_WORDS}),
firsts AS (SELECT k, min({{'d': doc_id, 'lo': lo, 'hi': hi}}) AS f FROM whole GROUP BY k),
later AS (
  SELECT doc_id, CASE WHEN doc_id = f.d THEN greatest(lo, f.hi + 1) ELSE lo END AS lo, hi
  FROM whole JOIN firsts USING (k) WHERE NOT (doc_id = f.d AND lo = f.lo AND hi = f.hi)
), gone AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS pos FROM later WHERE lo <= hi),
per AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
rest AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT c.doc_id, coalesce(len(c.ls), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed,
  CASE WHEN n IS NULL THEN c.text ELSE coalesce(rest.text, '') END AS text
FROM cut c LEFT JOIN per ON c.doc_id = per.doc_id LEFT JOIN rest ON c.doc_id = rest.doc_id
"""


def _kind_sql(kind: str, rank: int) -> str:
    pattern, group, least = secrets.KINDS[kind]
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, len(g[i]) >= {least} AS ok,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, length(m[i]) AS size
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS g, string_split_regex(text, '{p}') AS gaps FROM documents))"""


OP4_SQL = f"""
WITH spans AS ({" UNION ALL ".join(_kind_sql(k, i) for i, k in enumerate(secrets.KINDS))}),
joined AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)},
    string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, rank) FILTER (kind IN ({", ".join(f"'{k}'" for k in secrets.BASE)})) AS base,
    string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, rank) AS spans
  FROM spans WHERE ok GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN joined ON d.doc_id = joined.doc_id
"""

ORACLE_SQL = {"op1_url_filters": OP1_SQL, "op3_line_dedup": OP3_SQL, "op4_secret_scans": OP4_SQL}
