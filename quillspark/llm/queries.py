"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontaminate, digest, langid, line_dedup, minhash, mixing_lm, ordinal, sharding, token_scan

#: The rank file of op1 and op5, by its name in the installed package of public tokenizers.
RANKS, SEPARATOR = "byte_bpe_multi_50k.tiktoken", 50256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_ranks(name: str = RANKS) -> bpe.Ranks:
    import public_tokenizers

    return bpe.Ranks.read(public_tokenizers.path(name), public_tokenizers.PATTERN)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_check(table(spark, sf_dir, "documents").select("doc_id", "text"), public_ranks())


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.score_documents(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.document_token_counts(table(spark, sf_dir, "documents"), public_ranks(), SEPARATOR)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.compare_neighbours(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_byte_bpe, op2_line_dedup, op3_near_duplicates, op4_lm_score, op5_token_counts, op6_decontamination, op7_quality, op8_sharding, op9_language_id, op10_fingerprints]
    return {f.__name__: f for f in found}


#: ASCII capitals only, as the contracts say (``lower`` would fold all letters).
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Shingle sets, a join on shingles, and a walk over the links.
OP3_SQL = rf"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
  s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
  x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
  e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  t AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  r AS (SELECT a AS d, a AS m FROM t UNION SELECT t.b, r.m FROM r JOIN t ON t.a = r.d)
  SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.m, s.doc_id)) AS component_id, least(s.doc_id, coalesce(c.m, s.doc_id)) = s.doc_id AS kept FROM s LEFT JOIN (SELECT d, min(m) AS m FROM r GROUP BY 1) c ON c.d = s.doc_id"""

#: All windows of the items, joined with the windows of the same lengths of all documents.
OP6_SQL = rf"""WITH i AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  b AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0) x),
  d AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
  p AS MATERIALIZED (SELECT d.doc_id, l.l, unnest(range(1, len(d.w) - l.l + 2)) AS k FROM d JOIN (SELECT DISTINCT l FROM b) l ON len(d.w) >= l.l),
  h AS MATERIALIZED (SELECT q.doc_id, q.k, q.l, b.item_id FROM (SELECT p.doc_id, p.k, p.l, array_to_string(d.w[p.k:p.k + p.l - 1], ' ') AS g FROM p JOIN d ON d.doc_id = p.doc_id) q JOIN b ON b.g = q.g AND b.l = q.l),
  n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + l)) AS pos FROM h) y GROUP BY 1),
  m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS items_sha256 FROM h GROUP BY 1)
  SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, coalesce(m.items_sha256, sha256('')) AS items_sha256, coalesce(n.n_hit > 0 AND 20 * n.n_hit >= len(d.w), FALSE) AS contaminated FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """Twins of the queries that SQL can express; the others are held against brute force, libraries or held-out labels in the tests."""
    return {"op3_near_duplicates": OP3_SQL, "op6_decontamination": OP6_SQL}
