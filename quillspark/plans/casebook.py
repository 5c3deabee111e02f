"""Queries over inputs derived from the tables, so that every branch of the record operators is reached, each with a SQL twin.

An input is one SQL text that Spark and DuckDB both read; ``{part}`` and the like stand for tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import dates, payloads, registered, text
from quillspark.operators import relational as r
from quillspark.plans import canonical, curation, people, works
from quillspark.session import table
from quillspark.sources import files, providers
from quillspark.streaming import refresh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TABLES = ["part", "supplier", "customer", "nation", "orders", "lineitem", "events"]

INPUTS = {
    "w": """SELECT CAST(p_partkey AS BIGINT) AS pub_id,
  CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'https://doi.org/10.1234/W' || CAST(p_partkey AS STRING) WHEN 2 THEN 'doi: 10.1234/w' || CAST(p_partkey % 40 AS STRING) || '.v2' WHEN 3 THEN ' 10.5555/' || CAST(p_partkey % 90 AS STRING) ELSE '' END AS doi,
  CASE p_partkey % 3 WHEN 0 THEN ' Title  ' || CAST(p_partkey % 250 AS STRING) WHEN 1 THEN 'TITLE ' || CAST(p_partkey % 250 AS STRING) ELSE 'title ' || CAST(p_partkey % 250 AS STRING) END AS title,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(1990 + p_partkey % 30 AS INT) END AS year,
  CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Venue ' || CAST(p_partkey % 6 AS STRING) END AS venue,
  CASE p_partkey % 9 WHEN 0 THEN 'manual+crossref' WHEN 1 THEN 'crossref-funding+unknown' WHEN 2 THEN 'OpenAlex' WHEN 3 THEN 'openalex+dblp' WHEN 4 THEN NULL WHEN 5 THEN 'unknown' WHEN 6 THEN 'semantic+ semantic' WHEN 7 THEN 'zzz-local+orcid' ELSE 'openalex-affiliation+openalex' END AS provenance,
  CASE p_partkey % 11 WHEN 0 THEN '{{"crossref":{{"type":"posted-content"}}}}' WHEN 1 THEN '{{"crossref":{{"type":"journal-article"}},"openalex":{{"type":"dataset"}}}}' WHEN 2 THEN '{{"openalex":{{"type":"erratum"}}}}' WHEN 3 THEN '{{"openalex":{{"type":"article"}}}}'
    WHEN 4 THEN '{{"crossref":null}}' WHEN 5 THEN NULL WHEN 6 THEN '{{"crossref":{{"type":"grant"}}}}' ELSE '{{"crossref":{{"type":"journal-article","funder":"Example ' || CAST(p_partkey % 8 AS STRING) || '"}}}}' END AS payload,
  CASE p_partkey % 7 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END AS is_preprint,
  CASE p_partkey % 6 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END AS attributed FROM {part}""",
    "d": """SELECT CAST(p_partkey AS BIGINT) AS decision_id, CASE p_partkey % 3 WHEN 0 THEN 'merge_to' WHEN 1 THEN 'confirm_winner' ELSE 'keep_separate' END AS mode,
  CASE WHEN p_partkey % 2 = 0 THEN 'https://doi.org/10.1234/W' || CAST(p_partkey AS STRING) END AS doi, CASE WHEN p_partkey % 4 <> 2 THEN 'Title ' || CAST(p_partkey % 250 AS STRING) END AS title, CASE WHEN p_partkey % 8 = 1 THEN CAST(2001 AS INT) END AS year,
  CASE WHEN p_partkey % 5 = 0 THEN '10.5555/' || CAST(p_partkey % 90 AS STRING) END AS winner_doi, CASE WHEN p_partkey % 10 <> 3 THEN 'title ' || CAST((p_partkey + 7) % 250 AS STRING) END AS winner_title, CAST(NULL AS INT) AS winner_year,
  CAST(p_partkey % 19 AS INT) AS updated_at, p_partkey % 12 <> 5 AS active FROM {part} WHERE p_partkey % 7 = 3""",
    "o": """SELECT CAST(p_partkey AS BIGINT) AS pub_id, CASE WHEN p_partkey % 2 = 0 THEN 'merge_to' ELSE 'keep_separate' END AS mode, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 100 + 1 AS BIGINT) END AS winner_pub_id FROM {part} WHERE p_partkey % 17 = 4""",
    "s": """SELECT CAST(p_partkey AS BIGINT) AS decision_id, CASE WHEN p_partkey % 5 = 0 THEN 'person' ELSE 'global' END AS scope_type, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey % 3 AS BIGINT) END AS person_id, CASE WHEN p_partkey % 3 = 0 THEN 'exclude' ELSE 'include' END AS mode,
  CASE WHEN p_partkey % 2 = 0 THEN '10.5555/' || CAST(p_partkey % 90 AS STRING) END AS doi, 'title ' || CAST(p_partkey % 250 AS STRING) AS title, CASE WHEN p_partkey % 7 = 0 THEN CAST(1999 AS INT) END AS year, CAST(p_partkey % 23 AS INT) AS updated_at, p_partkey % 11 <> 0 AS active, 'note ' || CAST(p_partkey AS STRING) AS note FROM {part} WHERE p_partkey % 4 = 1""",
    "a": """SELECT CAST(l_partkey AS BIGINT) AS pub_id, CAST(l_linenumber + 7 * (l_orderkey % 3) AS INT) AS author_position, CASE WHEN l_suppkey % 4 <> 0 THEN CAST(l_suppkey % 60 + 1 AS BIGINT) END AS person_id, 'Author ' || CAST(l_suppkey % 60 + 1 AS STRING) AS author_name,
  CASE WHEN l_suppkey % 5 = 0 THEN '0000-0002-1825-' || CAST(1000 + l_suppkey % 60 AS STRING) END AS author_orcid, l_suppkey % 3 = 1 AS is_internal, CASE WHEN l_suppkey % 2 = 0 THEN 'Place ' || CAST(l_suppkey % 9 AS STRING) END AS paper_affiliation, CAST(l_suppkey % 9 AS INT) AS place
  FROM (SELECT l_partkey, l_linenumber, l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey, l_linenumber + 7 * (l_orderkey % 3) ORDER BY l_orderkey, l_suppkey, l_linenumber) AS n FROM {lineitem} WHERE l_orderkey % 5 = 0) x WHERE n = 1""",
    "p": """SELECT CAST(s_suppkey AS BIGINT) AS person_id, 'Person ' || CAST(s_suppkey % 60 AS STRING) AS display_name, CASE WHEN s_suppkey % 4 = 3 THEN 'external' ELSE 'internal' END AS person_kind FROM {supplier}""",
}


class Given:
    """The tables of a folder, and inputs by their SQL."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def sql(self, body: str) -> DataFrame:
        used = {n: self(n) for n in TABLES if "{" + n + "}" in body}
        return self.spark.sql(body, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in INPUTS:
            raise AttributeError(name)
        return self.sql(INPUTS[name])


def _plain(body: str) -> str:
    return body.format(**{n: n for n in TABLES})


def query(sql: str, uses: str = "", **own: str):  # noqa: ANN201
    """Register a query; ``uses`` names its inputs (one letter each), ``own`` further inputs of its own, which its function gets by name."""

    def add(f: Callable[..., DataFrame]):  # noqa: ANN202
        QUERIES[f.__name__] = lambda spark, sf_dir: f(g := Given(spark, sf_dir), **{k: g.sql(v) for k, v in own.items()})
        parts = [f"{k} AS MATERIALIZED ({_plain(own.get(k) or INPUTS[k])})" for k in [*uses, *own]]
        SQL[f.__name__] = (f"WITH {', '.join(parts)} " if parts else "") + sql if not sql.lstrip().startswith(",") else f"WITH {', '.join(parts)}{sql}"
        return f

    return add


# ---- SQL of keys, for the twins

def _doi(x: str) -> str:
    return rf"nullif(lower(regexp_replace(regexp_replace(trim(coalesce({x}, ''), ' '), '^doi:\s*', '', 'i'), '^https?://(dx\.)?doi\.org/', '', 'i')), '')"


def _title(x: str) -> str:
    return rf"lower(regexp_replace(trim({x}, ' '), '\s+', ' ', 'g'))"


KEYED = f"k AS MATERIALIZED (SELECT *, {_doi('doi')} AS dk, {_title('title')} AS tk FROM w)"
#: Decisions with keys, their winners, and each work's best decision.
DECIDED = f"""dd AS MATERIALIZED (SELECT decision_id, mode, updated_at, {_doi('doi')} AS dk, {_title('title')} AS tk, year AS y, {_doi('winner_doi')} AS wdk, {_title('winner_title')} AS wtk, winner_year AS wy FROM d WHERE active),
  dw AS MATERIALIZED (SELECT dd.decision_id, arg_min(k.pub_id, (coalesce(CAST(k.is_preprint AS INT), 2), k.pub_id)) AS win FROM dd JOIN k ON CASE WHEN dd.wdk IS NOT NULL THEN k.dk = dd.wdk ELSE k.tk = dd.wtk AND (dd.wy IS NULL OR k.year = dd.wy) END GROUP BY 1),
  db AS MATERIALIZED (SELECT pub_id, mode, win, decision_id FROM (SELECT k.pub_id, dd.mode, CASE WHEN dd.mode <> 'keep_separate' THEN dw.win END AS win, dd.decision_id, row_number() OVER (PARTITION BY k.pub_id ORDER BY dd.dk IS NULL, dd.updated_at DESC, dd.decision_id DESC) AS n
    FROM dd JOIN k ON CASE WHEN dd.dk IS NOT NULL THEN k.dk = dd.dk ELSE k.tk = dd.tk AND (dd.y IS NULL OR k.year = dd.y) END LEFT JOIN dw ON dw.decision_id = dd.decision_id WHERE dd.mode = 'keep_separate' OR dw.win IS NOT NULL) x WHERE n = 1)"""
#: Works in the universe with rule, key and canonical id.
MEMBERS = f"""{KEYED}, {DECIDED}, ty AS MATERIALIZED (SELECT k.*, coalesce(o.mode, db.mode) AS mode, CASE WHEN o.mode IS NOT NULL THEN o.winner_pub_id ELSE db.win END AS win, db.decision_id AS dec, json_extract_string(payload, '$.crossref.type') AS ct, json_extract_string(payload, '$.openalex.type') AS ot
    FROM k LEFT JOIN o ON o.pub_id = k.pub_id LEFT JOIN db ON db.pub_id = k.pub_id),
  b AS MATERIALIZED (SELECT *, CASE WHEN mode = 'keep_separate' THEN tk || '#pub:' || pub_id ELSE tk END AS dkey FROM ty
    WHERE NOT (coalesce(ct IN ('dataset', 'other', 'peer-review', 'posted-content', 'preprint', 'reference-entry'), FALSE) OR (ct IS NULL AND coalesce(ot IN ('dataset', 'editorial', 'erratum', 'other', 'paratext', 'peer-review', 'preprint'), FALSE)))),
  cw AS MATERIALIZED (SELECT * FROM (SELECT dkey, coalesce(win, pub_id) AS cid, dec, row_number() OVER (PARTITION BY dkey ORDER BY dec DESC NULLS LAST, pub_id DESC) AS n FROM b WHERE mode = 'confirm_winner' AND coalesce(win, pub_id) IN (SELECT pub_id FROM b)) x WHERE n = 1),
  au AS MATERIALIZED (SELECT dkey, arg_min(pub_id, (coalesce(CAST(is_preprint AS INT), 2), CASE WHEN provenance ILIKE '%manual%' OR provenance ILIKE '%funding%' THEN 0 ELSE 1 END, CASE WHEN regexp_matches(doi, '[/._]v[0-9]+$', 'i') THEN 1 ELSE 0 END, pub_id)) AS aid FROM b GROUP BY 1),
  mt AS MATERIALIZED (SELECT DISTINCT win AS pub_id FROM b WHERE mode = 'merge_to' AND win IN (SELECT pub_id FROM b)),
  m AS MATERIALIZED (SELECT b.pub_id, coalesce(cw.cid, mt.pub_id, CASE WHEN b.mode = 'merge_to' AND b.win IN (SELECT pub_id FROM b) THEN b.win END, au.aid) AS cid, cw.cid IS NOT NULL AS locked, cw.dec AS dec FROM b JOIN au ON au.dkey = b.dkey LEFT JOIN cw ON cw.dkey = b.dkey LEFT JOIN mt ON mt.pub_id = b.pub_id),
  g AS MATERIALIZED (SELECT cid, count(*) AS n FROM m GROUP BY 1)"""
SCOPED = f"""sm AS MATERIALIZED (SELECT * FROM (SELECT k.pub_id, s.decision_id, s.scope_type, s.person_id, s.mode, s.note, row_number() OVER (PARTITION BY k.pub_id, s.scope_type, coalesce(s.person_id, 0) ORDER BY s.doi IS NULL, s.updated_at DESC, s.decision_id DESC) AS n
  FROM (SELECT *, {_doi('doi')} AS sdk, {_title('title')} AS stk FROM s WHERE active) s JOIN k ON CASE WHEN s.sdk IS NOT NULL THEN k.dk = s.sdk ELSE k.tk = s.stk AND (s.year IS NULL OR k.year = s.year) END) x WHERE n = 1)"""
CANON = """cn AS MATERIALIZED (SELECT k.pub_id, sm.mode AS scope_mode, sm.decision_id AS scope_decision_id, k.doi IS NULL AS provisional FROM k JOIN m ON m.pub_id = k.pub_id AND m.cid = k.pub_id LEFT JOIN sm ON sm.pub_id = k.pub_id AND sm.scope_type = 'global' AND sm.person_id IS NULL
  WHERE k.is_preprint IS NOT TRUE AND coalesce(sm.mode, '') <> 'exclude' AND (sm.mode = 'include' OR k.pub_id IN (SELECT m2.cid FROM m m2 JOIN k k2 ON k2.pub_id = m2.pub_id WHERE k2.attributed)))"""


# ---- canonical records

@query(f", {KEYED}, {DECIDED} SELECT pub_id, mode, win AS winner, decision_id FROM db", "wd")
def durable_decisions(g):
    return canonical.durable_decisions(canonical.keyed(g.w), g.d).select("pub_id", F.col("d_mode").alias("mode"), F.col("d_winner").alias("winner"), "decision_id")


@query(f", {MEMBERS} SELECT m.pub_id, m.cid AS canonical_pub_id, g.n AS group_size, m.pub_id = m.cid AS is_canonical, m.locked AS canonical_locked, m.dec AS confirm_decision_id FROM m JOIN g ON g.cid = m.cid", "wdo")
def dedup_memberships(g):
    return canonical.memberships(g.w, g.d, g.o).drop("dedup_key")


@query("""SELECT p.p_partkey AS pub_id, CASE WHEN p.p_partkey <= 40 THEN least(40, p.p_partkey + (40 - p.p_partkey)) WHEN p.p_partkey BETWEEN 51 AND 55 THEN 51 ELSE p.p_partkey END AS canonical_pub_id FROM part p WHERE p.p_partkey <= 60""")
def chained_merges(g):
    """Rules 1 -> 2 -> ... -> 40, and a circle of 51 to 55, followed to their ends."""
    ws = g.sql("SELECT CAST(p_partkey AS BIGINT) AS pub_id, CAST(NULL AS STRING) AS doi, 'only ' || CAST(p_partkey AS STRING) AS title, CAST(NULL AS INT) AS year, CAST(NULL AS STRING) AS venue, CAST(NULL AS STRING) AS provenance, CAST(NULL AS STRING) AS payload, CAST(NULL AS BOOLEAN) AS is_preprint, FALSE AS attributed FROM {part} WHERE p_partkey <= 60")
    rules = g.sql("SELECT CAST(p_partkey AS BIGINT) AS pub_id, 'merge_to' AS mode, CAST(CASE WHEN p_partkey = 55 THEN 51 ELSE p_partkey + 1 END AS BIGINT) AS winner_pub_id FROM {part} WHERE p_partkey < 40 OR p_partkey BETWEEN 51 AND 55")
    return canonical.memberships(ws, g.d.limit(0), rules, transitive=True).select("pub_id", "canonical_pub_id")


@query("""SELECT t AS g, arg_min(pub_id, (CASE WHEN is_preprint IS NULL THEN 1 WHEN is_preprint THEN 2 ELSE 0 END, CASE WHEN nd THEN 0 ELSE 1 END, rank, -nt, -sp, CASE WHEN year IS NULL THEN 1 ELSE 0 END, CASE WHEN coalesce(venue, '') = '' THEN 1 ELSE 0 END, pub_id)) AS winner_pub_id FROM (
  SELECT *, pub_id % 50 AS t, regexp_matches(coalesce(doi, ''), '10\\.[0-9]{4,9}/') AS nd, coalesce(list_min(list_transform(toks, lambda x: coalesce(nullif(list_position(['manual', 'crossref', 'datacite', 'semantic', 'orcid', 'scholar', 'dblp', 'openalex', 'unknown'], split_part(x, '-', 1)), 0) - 1, 9))), 8) AS rank,
    greatest(len(list_distinct(toks)), 1) AS nt, len(list_filter(toks, lambda x: contains(x, '-'))) AS sp FROM (SELECT *, list_filter(list_transform(string_split(lower(coalesce(provenance, '')), '+'), lambda x: trim(x)), lambda x: x <> '') AS toks FROM w) y) z GROUP BY 1""", "w")
def merge_policy(g):
    return canonical.policy_winner(g.w.withColumn("g", F.col("pub_id") % 50), "g")


@query(f""", {MEMBERS}, own AS (SELECT m.cid, p.display_name, coalesce(a.paper_affiliation, array_to_string(['Aff ' || a.place, 'B'], '; ')) AS aff FROM a JOIN m ON m.pub_id = a.pub_id LEFT JOIN p ON p.person_id = a.person_id WHERE a.person_id IS NOT NULL AND a.is_internal)
  SELECT k.pub_id, g.n AS group_size, m.locked AS canonical_locked, string_agg(DISTINCT own.display_name, ', ' ORDER BY own.display_name) AS internal_authors, string_agg(DISTINCT own.aff, '; ' ORDER BY own.aff) AS internal_affiliations FROM k JOIN m ON m.pub_id = k.pub_id AND m.cid = k.pub_id JOIN g ON g.cid = k.pub_id LEFT JOIN own ON own.cid = k.pub_id GROUP BY 1, 2, 3""", "wdoap")
def clean_publications(g):
    rows = g.a.withColumn("affiliations", F.array(F.concat(F.lit("Aff "), F.col("place")), F.lit("B")))
    return canonical.clean_list(g.w, canonical.memberships(g.w, g.d, g.o), rows, g.p).select("pub_id", "group_size", "canonical_locked", "internal_authors", "internal_affiliations")


@query(f", {KEYED}, {SCOPED} SELECT pub_id, decision_id, scope_type, person_id, mode, note FROM sm", "ws")
def canon_scope(g):
    return canonical.scope_matches(g.w, g.s)


@query(f", {MEMBERS}, {SCOPED}, {CANON} SELECT * FROM cn", "wdos")
def canon_publications(g):
    return canonical.canon(g.w, canonical.memberships(g.w, g.d, g.o), g.s).select("pub_id", "scope_mode", "scope_decision_id", "provisional")


@query(f""", {MEMBERS}, {SCOPED}, {CANON}, mine AS (SELECT DISTINCT pub_id FROM a WHERE person_id = 7), wn AS (SELECT DISTINCT m.cid AS pub_id FROM mine JOIN m ON m.pub_id = mine.pub_id),
  dt AS (SELECT k.*, CASE WHEN k.year IS NOT NULL THEN make_date(k.year, 1, 1) END AS pd FROM k JOIN wn ON wn.pub_id = k.pub_id),
  cl AS (SELECT dt.pub_id, dt.pd, CASE WHEN cn.pub_id IS NOT NULL THEN 'in_canon' WHEN sm.mode = 'exclude' THEN 'excluded_manually' WHEN dt.is_preprint THEN 'preprint_only' ELSE 'missing_institution_signal' END AS status, sm.note AS scope_note
    FROM dt JOIN m ON m.pub_id = dt.pub_id AND m.cid = dt.pub_id LEFT JOIN cn ON cn.pub_id = dt.pub_id LEFT JOIN sm ON sm.pub_id = dt.pub_id AND sm.scope_type = 'global' AND sm.person_id IS NULL
    UNION ALL SELECT k.pub_id, NULL, 'outside_dedup_universe', coalesce(json_extract_string(k.payload, '$.crossref.type'), json_extract_string(k.payload, '$.openalex.type')) FROM k JOIN mine ON mine.pub_id = k.pub_id WHERE k.pub_id NOT IN (SELECT pub_id FROM m))
  SELECT pub_id, status, scope_note, CASE WHEN pd IS NULL THEN 'undated' WHEN pd BETWEEN lo AND hi THEN 'in_window' ELSE 'outside_window' END AS window_position, lo AS first_canon_date, hi AS last_canon_date FROM cl CROSS JOIN (SELECT min(pd) AS lo, max(pd) AS hi FROM cl WHERE status = 'in_canon') x""", "wdosa")
def person_coverage(g):
    found = canonical.person_coverage(7, g.w, canonical.memberships(g.w, g.d, g.o), g.a, g.s)
    return found.select("pub_id", "status", "scope_note", "window_position", "first_canon_date", "last_canon_date")


@query("""SELECT pub_id, d, CASE WHEN d IS NULL THEN NULL WHEN rd IS NOT NULL THEN 'day' WHEN rm IS NOT NULL THEN 'month' ELSE 'year' END AS p FROM (SELECT pub_id, rm, rd, CASE WHEN year IS NOT NULL THEN
    CAST(make_date(year, mm, least(greatest(coalesce(rd, 1), 1), day(last_day(make_date(year, mm, 1))))) AS DATE) END AS d FROM (SELECT *, CAST(least(greatest(coalesce(rm, 1), 1), 12) AS INT) AS mm FROM (SELECT pub_id, year,
      coalesce(CASE WHEN c = 1 THEN CAST(m AS INT) WHEN c = 2 THEN CAST(m AS INT) WHEN c = 3 THEN CAST(m AS INT) WHEN c = 4 THEN CAST(m % 12 + 1 AS INT) END, CASE WHEN c = 6 THEN 7 END) AS rm, CAST(CASE WHEN c = 1 THEN dd WHEN c = 2 AND m % 2 = 0 THEN dd WHEN c = 4 THEN dd % 28 + 1 WHEN c IN (3, 6) THEN 9 END AS INT) AS rd FROM j) y) z) q""",
       j="""SELECT CAST(p_partkey AS BIGINT) AS pub_id, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(1995 + p_partkey % 25 AS INT) END AS year, CAST(p_partkey % 7 AS INT) AS c, CAST(p_partkey % 15 AS INT) AS m, CAST(p_partkey % 37 AS INT) AS dd FROM {part}""")
def publication_dates(g, j):
    m, d = F.col("m").cast("string"), F.col("dd").cast("string")
    odd = (F.col("m") % 2 == 0)
    body = (
        F.when(F.col("c") == 1, F.concat(F.lit('{"crossref":{"issued":{"date-parts":[[2000,'), m, F.lit(","), d, F.lit(']]},"published":{"date-parts":[[2000,3,3]]}}}')))
        .when((F.col("c") == 2) & odd, F.concat(F.lit('{"crossref":{"issued":{"date-parts":[[2000]]},"published":{"date-parts":[[2000,'), m, F.lit(","), d, F.lit(']]}}}')))
        .when(F.col("c") == 2, F.concat(F.lit('{"crossref":{"published":{"date-parts":[[2000,'), m, F.lit(']]}}}')))
        .when(F.col("c") == 3, F.concat(F.lit('{"crossref":{"published-print":{"date-parts":[["x",'), m, F.lit(']]}},"orcid":{"publication-date":{"month":{"value":"x"},"day":{"value":"09"}}}}')))
        .when(F.col("c") == 4, F.concat(F.lit('{"openalex":{"publication_date":"2001-'), F.lpad((F.col("m") % 12 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("dd") % 28 + 1).cast("string"), 2, "0"), F.lit('"}}')))
        .when(F.col("c") == 5, '{"openalex":{"publication_date":"2001-7-9"}}').when(F.col("c") == 6, '{"orcid":{"publication-date":{"month":{"value":"07"},"day":{"value":"9"}}}}')
    )
    day, precision = dates.publication_date(F.col("b"), F.col("year"))
    return j.withColumn("b", body).select("pub_id", day.alias("d"), precision.alias("p"))


@query("SELECT pub_id, bool_or(contains(lower(payload), pat)) IS TRUE AS attributed FROM w CROSS JOIN (SELECT lower(trim(n_name)) AS pat FROM nation UNION SELECT 'example 3') x GROUP BY 1", "w")
def attribution_rules(g):
    rules = g("nation").select(F.concat(F.lit(" "), F.col("n_name")).alias("pattern"), F.lit(True).alias("active")).unionAll(g.spark.createDataFrame([(" EXAMPLE 3 ", True), ("example 5", False), ("  ", True)], "pattern string, active boolean"))
    return canonical.attribution(g.w, rules).select("pub_id", "attributed")


@query("SELECT count(*) AS changed FROM w WHERE attributed IS DISTINCT FROM coalesce(contains(lower(payload), 'example 3'), FALSE)", "w")
def attribution_changes(g):
    return canonical.changed_attribution(g.w, g.spark.createDataFrame([("Example 3", True)], "pattern string, active boolean"))


@query("""SELECT pub_id, CAST(len(f) AS INT) AS n_source_families, array_to_string(f, '+') AS source_families, array_to_string(t, '+') AS source_tokens FROM (SELECT pub_id, list_sort(t) AS t, list_sort(list_distinct(list_transform(t, lambda x: split_part(x, '-', 1)))) AS f FROM (SELECT pub_id, list_distinct(list_filter(list_transform(string_split(lower(coalesce(provenance, '')), '+'), lambda x: trim(x)), lambda x: x <> '')) AS t FROM w) y) z""", "w")
def source_coverage(g):
    return canonical.coverage(g.w).drop("doi", "title", "year")


# ---- payloads and provenance

@query("""SELECT a, b, CASE WHEN (a, b) = ('crossref-funding+unknown', 'openalex+crossref+manual') THEN 'manual+openalex+crossref-funding' WHEN (a, b) = ('unknown', '') THEN 'unknown' WHEN (a, b) = ('openalex+ openalex', 'crossref') THEN 'crossref+openalex' WHEN (a, b) = ('zz+zz-a', 'dblp-x+dblp') THEN 'dblp-x+zz+zz-a' WHEN (a, b) = ('', 'Unknown') THEN 'Unknown' ELSE '' END AS merged,
  CASE WHEN a = 'crossref-funding+unknown' THEN 'crossref-funding' WHEN a = 'unknown' THEN 'crossref' WHEN a = 'openalex+ openalex' THEN 'crossref+openalex' WHEN a = 'zz+zz-a' THEN 'crossref+zz+zz-a' ELSE 'crossref' END AS plain,
  CASE WHEN a = 'crossref-funding+unknown' THEN 'crossref-affiliation+crossref-funding' WHEN a = 'unknown' THEN 'crossref-affiliation' WHEN a = 'openalex+ openalex' THEN 'openalex+crossref-affiliation' WHEN a = 'zz+zz-a' THEN 'crossref-affiliation+zz+zz-a' ELSE 'crossref-affiliation' END AS special FROM c""",
       c="SELECT * FROM (VALUES ('crossref-funding+unknown', 'openalex+crossref+manual'), ('unknown', ''), ('openalex+ openalex', 'crossref'), ('zz+zz-a', 'dblp-x+dblp'), ('', 'Unknown'), (NULL, NULL)) AS x(a, b)")
def provenance_rules(g, c):
    a, b = F.col("a"), F.col("b")
    return c.select("a", "b", payloads.merge_provenance(a, b).alias("merged"), payloads.replace_family(a, F.lit("crossref"), "crossref").alias("plain"), payloads.replace_family(a, F.lit("crossref-affiliation"), "crossref").alias("special"))


@query("""SELECT pub_id, coalesce(list_min(rk), 8) AS rank, coalesce(list_min(rk) < 7, FALSE) AS above_openalex, CAST(len(list_filter(t, lambda x: x <> 'unknown')) AS INT) AS n FROM (SELECT pub_id, t, list_transform(t, lambda x: CAST(coalesce(nullif(list_position(['manual', 'crossref', 'datacite', 'semantic', 'orcid', 'scholar', 'dblp', 'openalex', 'unknown'], split_part(x, '-', 1)), 0) - 1, 9) AS INT)) AS rk
  FROM (SELECT pub_id, list_filter(list_transform(string_split(lower(coalesce(provenance, '')), '+'), lambda x: trim(x)), lambda x: x <> '') AS t FROM w) y) z""", "w")
def trust(g):
    return g.w.select("pub_id", payloads.best_rank(F.col("provenance")).alias("rank"), payloads.more_trusted(F.col("provenance"), "openalex").alias("above_openalex"), payloads.n_tokens(F.col("provenance")).alias("n"))


@query("""SELECT pub_id, list_contains(json_keys(payload), 'crossref') IS TRUE AS has_crossref, json_extract_string(payload, '$.crossref.type') AS kind, CASE WHEN payload IS NULL THEN 'legacy' ELSE list_sort(json_keys(payload))[1] END AS first_key,
  CASE WHEN payload IS NULL THEN '{"x":2}' WHEN json_keys(payload) = ['crossref'] THEN '{"crossref":{"n":1},"x":2}' ELSE NULL END AS patched FROM w""", "w")
def payload_keys(g):
    p = F.col("payload")
    patched = payloads.merged(p, F.lit('{"crossref":{"n":1},"x":2}'))
    only = F.coalesce(F.json_object_keys(p) == F.array(F.lit("crossref")), F.lit(False))
    return g.w.select("pub_id", payloads.has_key(p, "crossref").alias("has_crossref"), F.get_json_object(p, "$.crossref.type").alias("kind"), F.coalesce(F.array_min(F.json_object_keys(p)), F.lit("legacy")).alias("first_key"), F.when(p.isNull(), F.regexp_replace(patched, '"crossref":\\{"n":1\\},', "")).when(only, patched).alias("patched"))


@query("""SELECT * FROM (VALUES (1, '{"crossref":{"type":"x"}}', '{"crossref":{"type":"x"},"openalex":{"k":1}}', 1), (2, '{"crossref":{"b":"c"}}', '{"crossref":{"b":"c"},"openalex":{"k":1}}', 1), (3, '{"legacy":{"a":1}}', '{"legacy":{"a":1},"openalex":{"k":1}}', 1), (4, '{}', '{"openalex":{"k":1}}', 1), (5, '{}', '{"openalex":{"k":1}}', 1)) AS x(id, normal, merged, n_entries)""")
def legacy_payloads(g):
    rows = g.spark.createDataFrame([(1, '{"type":"x"}', "crossref"), (2, '{"crossref":{"b":"c"}}', "x"), (3, '{"a":1}', "x+y"), (4, None, "crossref"), (5, "[1]", None)], "id int, p string, s string")
    update = F.lit('{"openalex":{"k":1},"z":null}')
    return rows.select("id", payloads.normal_payload(F.col("p"), F.col("s")).alias("normal"), payloads.merged_payload(F.col("p"), F.col("s"), update).alias("merged"), F.size(payloads.envelope(update, F.lit("2024-01-01"), "v1")).alias("n_entries"))


@query("""SELECT * FROM (VALUES (1, sha256('{"a":1}')), (2, sha256('{"a":[1,2.5],"b":"é"}')), (3, NULL)) AS x(id, h)""")
def payload_hashes(g):
    rows = g.spark.createDataFrame([(1, '{ "a" : 1 }'), (2, '{"b":"\\u00e9", "a":[1,2.50]}'), (3, "{")], "id int, p string")
    return rows.select("id", payloads.payload_hash(F.col("p")).alias("h"))


# ---- identifiers, titles, names

@query(r"""SELECT pub_id, CASE WHEN x IS NOT NULL THEN rtrim(regexp_replace(lower(x), '[?&]version=.*$', ''), ' .),;"''') END AS doi FROM (SELECT pub_id, nullif(regexp_extract(replace(replace(u, '&lt;', '<'), '&amp;', '&'), '10\.[0-9]{4,9}/\S+', 0), '') AS x FROM j) y""",
       j="""SELECT CAST(p_partkey AS BIGINT) AS pub_id, CASE p_partkey % 9 WHEN 0 THEN 'see https://doi.org/10.1234/AbC' || CAST(p_partkey AS STRING) || ').' WHEN 1 THEN '10.12/short' WHEN 2 THEN 'DOI:10.123456789/x.y?version=2' WHEN 3 THEN '10.1234/a&amp;b;' WHEN 4 THEN NULL WHEN 5 THEN '10.1234/&lt;sici&lt;, next' WHEN 6 THEN 'http://dx.doi.org/10.5555/Q"' WHEN 7 THEN '' ELSE '10.1234/Z' || CAST(p_partkey AS STRING) || '&version=1' END AS u FROM {part}""")
def strict_doi(g, j):
    return j.select("pub_id", text.normalize_doi(F.col("u")).alias("doi"))


@query(f"SELECT pub_id, {_doi('doi')} AS key FROM w", "w")
def loose_doi(g):
    return g.w.select("pub_id", text.doi_key(F.col("doi")).alias("key"))


@query(rf"""SELECT pub_id, {_title('x')} AS key, nullif(lower(regexp_replace(regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', ''), '\s+', ' ', 'g')), '') AS clean, trim(regexp_replace(regexp_replace(lower(regexp_replace(x, '<[^>]+>', '', 'g')), '[^\w\sé]', ' ', 'g'), '\s+', ' ', 'g')) AS compared, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS plain FROM j""",
       j="""SELECT CAST(p_partkey AS BIGINT) AS pub_id, CASE p_partkey % 6 WHEN 0 THEN '  A   <b>Title</b>: of é ' || p_name WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN '   ' WHEN 4 THEN 'X' || chr(9) || ' Y-Z.' || chr(10) ELSE p_name END AS x FROM {part}""")
def title_forms(g, j):
    x = F.col("x")
    return j.select("pub_id", text.title_key(x).alias("key"), text.clean_title(x).alias("clean"), text.comparable_title(x).alias("compared"), text.affiliation_text(x).alias("plain"))


@query(r"""SELECT id, o, ok FROM (SELECT *, CASE WHEN o IS NULL THEN NULL ELSE substr(o, 19, 1) = CASE WHEN (12 - t % 11) % 11 = 10 THEN 'X' ELSE CAST((12 - t % 11) % 11 AS VARCHAR) END END AS ok FROM (SELECT id, o, (SELECT sum(CAST(substr(replace(o, '-', ''), i, 1) AS HUGEINT) * (1::HUGEINT << (16 - i))) FROM range(1, 16) r(i)) AS t FROM (SELECT id, CASE WHEN regexp_matches(z, '^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$') THEN z END AS o FROM (SELECT id, upper(regexp_replace(trim(x), '^(https?://)?(www\.)?orcid\.org/', '', 'i')) AS z FROM j) a) b) c) d""",
       j="""SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 5 WHEN 0 THEN 'https://orcid.org/' WHEN 1 THEN ' http://ORCID.org/' ELSE '' END || '0000-000' || CAST(p_partkey % 8 AS STRING) || '-' || CAST(1000 + p_partkey % 9000 AS STRING) || '-' || CAST(100 + p_partkey % 900 AS STRING) || CASE WHEN p_partkey % 11 = 3 THEN 'x' WHEN p_partkey % 13 = 4 THEN '' ELSE CAST(p_partkey % 10 AS STRING) END AS x FROM {part}""")
def orcid_forms(g, j):
    o = text.normalize_orcid(F.col("x"))
    return j.select("id", o.alias("o"), text.orcid_checksum_ok(o).alias("ok"))


#: Names with what the name functions make of them: fixed cases, read off the rules.
NAMES = [
    # name, without titles, for matching, given, family
    ("Prof. Dr. Jane A. Müller, PhD", "Jane A. Müller", "jane a mueller", "PhD", "Prof. Dr. Jane A. Müller"),
    ("Doe", "Doe", "doe", "Doe", ""),
    (None, "", "", "", ""),
    ("  ", "", "", "", ""),
    ("van der Berg-Stone,  Max ", "van der Berg-Stone Max", "van der berg stone max", "Max", "van der Berg-Stone"),
    ("José María Álvarez", "José María Álvarez", "jose maria alvarez", "José María", "Álvarez"),
    ("Ann–Lee Strauß MSc FRS", "Ann Lee Strauß", "ann lee strauss", "Ann–Lee Strauß MSc", "FRS"),
    ("md Mr. X", "md X", "md x", "md Mr.", "X"),
]


def _values(rows: list[tuple], names: str) -> str:
    one = lambda v: "NULL" if v is None else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v) if isinstance(v, int) and not isinstance(v, bool) else str(v).upper() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS x({names})"


@query(_values([(k, *row[1:]) for k, row in enumerate(NAMES)], "id, plain, matching, given, family"))
def name_forms(g):
    x = F.col("x")
    rows = g.spark.createDataFrame([(k, row[0]) for k, row in enumerate(NAMES)], "id int, x string")
    return rows.select("id", text.strip_titles(x).alias("plain"), text.match_name(x).alias("matching"), text.given_name(x).alias("given"), text.family_name(x).alias("family"))


#: Pairs of names: equivalent, similarity above 0.8, match score of the second (given, family) for the first.
PAIRS = [
    ("Jane Smith", "John Smith", True, False, 0.9),
    ("Jane Smith", "J. Smith", True, True, 0.9),
    ("Dr. Jürgen Müller-Lüdenscheidt", "J. Mueller Luedenscheidt", False, True, 0.0),
    ("Ann Lee", "Ann Leigh", False, False, 0.3),
    ("Ann Lee", "Bob Lee", False, False, 0.6),
    ("José Álvarez", "Jose Alvarez", True, True, 1.0),
    ("Maria Font Massot", "M. Font", False, False, 0.2),
    ("", "Ann Lee", False, False, 0.0),
]


@query(_values([(k, e, s, m) for k, (_, _, e, s, m) in enumerate(PAIRS)], "id, equivalent, alike, score"))
def name_pairs(g):
    rows = g.spark.createDataFrame([(k, a, b) for k, (a, b, *_) in enumerate(PAIRS)], "id int, a string, b string")
    a, b = F.col("a"), F.col("b")
    return rows.select("id", text.names_equivalent(a, b).alias("equivalent"), (text.name_similarity(a, b) > 0.8).alias("alike"), text.name_match_score(a, text.given_name(b), text.family_name(b)).cast("decimal(3,1)").cast("double").alias("score"))


@query(_values([
    (0, "van der Berg Stone|Stone|van|van der|Berg Stone|der Berg Stone", "Max|Max Berg|Max Berg Stone"), (1, "Schardosim-Pereira|Pereira|Schardosim|Schardosim Pereira", "Ana|Ana Schardosim|Ana Pereira"), (2, "Lee", "Ann"), (3, "", ""),
], "id, families, givens"))
def name_variants(g):
    rows = g.spark.createDataFrame([(0, "Max", "van  der Berg Stone"), (1, "Ana", "Schardosim-Pereira"), (2, "Ann", "Lee"), (3, None, None)], "id int, g string, f string")
    return rows.select("id", F.array_join(text.family_variants(F.col("f")), "|").alias("families"), F.array_join(text.given_variants(F.col("g"), F.col("f")), "|").alias("givens"))


@query(_values([(0, "uni,example", True, False), (1, "uni,example,inst,behavior", True, True), (2, "center,x", False, False), (3, "", False, False), (4, "uni,goettingen", False, False)], "id, tokens, university, institute"))
def organisations(g):
    rows = g.spark.createDataFrame([(0, "The University of Example"), (1, "Universität Example / Institute for Behaviour"), (2, "Centre X"), (3, None), (4, "Universitaet Göttingen")], "id int, x string")
    x = F.col("x")
    return rows.select("id", F.array_join(text.org_tokens(x), ",").alias("tokens"), text.org_match(x, ["Example University", " "]).alias("university"), text.org_match(x, ["Institut Behavior"]).alias("institute"))


@query(_values([(0, "example-uni,example,uni,org,mail,foo-bar,foo,bar,lab,physics", 0.2), (1, "", 0.0)], "id, tokens, boost"))
def contexts(g):
    rows = g.spark.createDataFrame([(0, "https://www.example-uni.org/x, nothing", "a@mail.foo-bar.de", "The Lab of Physics"), (1, None, None, None)], "id int, w string, e string, t string")
    tokens = text.context_tokens([F.col("w")], F.col("e"), [F.col("t")], ["the", "www"])
    return rows.select("id", F.array_join(tokens, ",").alias("tokens"), F.round(text.jaccard_boost(F.when(F.col("id") == 0, F.lit("Example-Uni Example Uni ORG Mail foo-bar Foo Bar Lab Physics")), tokens), 4).alias("boost"))


@query("""SELECT person_id, alias FROM (SELECT c_custkey AS person_id, unnest(CASE WHEN c_custkey % 7 = 0 THEN [] WHEN c_custkey % 3 = 0 THEN [replace(c_name, '#', ', '), split_part(c_name, '#', 2) || ' ' || split_part(c_name, '#', 1)] ELSE [replace(c_name, '#', ' ')] END) AS alias FROM customer) x""")
def alias_forms(g):
    raw = F.when(F.col("c_custkey") % 7 == 0, F.when(F.col("c_custkey") % 2 == 0, " Unknown ").otherwise("''")).when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(' "'), F.replace("c_name", F.lit("#"), F.lit(" ,   ")), F.lit('"'))).otherwise(F.replace("c_name", F.lit("#"), F.lit("   ")))
    form = F.explode(text.alias_forms(raw))
    return g("customer").select(F.col("c_custkey").alias("person_id"), form.alias("alias")).withColumn("alias", F.replace("alias", F.lit(" , "), F.lit(", "))).withColumn("alias", F.replace("alias", F.lit(" ,"), F.lit(",")))


@query("""SELECT pub_id, CASE WHEN x IS NULL OR NOT contains(lower(x), 'equal') THEN NULL WHEN tag = 'first' AND contains(lower(x), 'first') THEN 'co-first' WHEN tag = 'last' AND contains(lower(x), 'last') THEN 'co-last' ELSE 'equal-contrib' END AS t FROM j""",
       j="""SELECT CAST(p_partkey AS BIGINT) AS pub_id, CASE p_partkey % 4 WHEN 0 THEN 'first' WHEN 1 THEN 'last' WHEN 2 THEN 'middle' ELSE 'single' END AS tag, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Equal first authors' WHEN 2 THEN 'EQUAL last' WHEN 3 THEN 'equally' ELSE p_name END AS x FROM {part}""")
def equal_contribution(g, j):
    return j.select("pub_id", text.equal_contribution(F.col("x"), F.col("tag")).alias("t"))


@query("""SELECT pub_id, (place % 3 = 0) AS fits, TRUE AS free, length(trim(author_name)) >= 9 AS named FROM a""", "a")
def affiliation_terms(g):
    places = F.array(F.concat(F.lit("Dept., "), F.when(F.col("place") % 3 == 0, "EXAMPLE--Univ.").otherwise("Other")), F.lit(None).cast("string"))
    return g.a.select("pub_id", text.affiliation_match(places, ["example univ", "  "]).alias("fits"), text.affiliation_match(places, [" "]).alias("free"), text.long_enough(F.col("author_name"), 2, 9).alias("named"))


@query("SELECT pub_id, (year IS NOT NULL AND year >= 2000) AS low, (year BETWEEN 1995 AND 2005) IS TRUE AS inside, TRUE AS free FROM w", "w")
def year_bounds(g):
    y = F.col("year")
    return g.w.select("pub_id", providers.year_between(y, 2000, None).alias("low"), providers.year_between(y, 1995, 2005).alias("inside"), providers.year_between(y, None, None).alias("free"))


@query("SELECT pub_id, title FROM w WHERE pub_id % 3 = 1 AND year IN (1991, 2003) AND is_preprint = FALSE", "w")
def optional_filters(g):
    return r.optional(g.w.withColumn("third", F.col("pub_id") % 3), third=1, year=[1991, 2003], is_preprint=False, venue=None).select("pub_id", "title")


# ---- people

@query("""SELECT pub_id, author_position, person FROM (SELECT a.pub_id, a.author_position, CASE o.mode WHEN 'force_person' THEN o.forced WHEN 'force_null' THEN NULL ELSE a.person_id END AS person, o.mode FROM a LEFT JOIN
   (SELECT * FROM (SELECT a.pub_id, a.author_position, v.mode, v.forced, row_number() OVER (PARTITION BY a.pub_id, a.author_position ORDER BY CASE WHEN v.orcid <> '' THEN 0 WHEN v.name <> '' THEN 1 ELSE 2 END, v.at DESC, v.id DESC) AS n FROM a JOIN v ON v.pub_id = a.pub_id
      AND (v.pos IS NULL OR v.pos = a.author_position) AND (coalesce(trim(v.name), '') = '' OR lower(trim(v.name)) = lower(a.author_name)) AND (coalesce(v.orcid, '') = '' OR lower(v.orcid) = lower(a.author_orcid))) x WHERE n = 1) o ON o.pub_id = a.pub_id AND o.author_position = a.author_position) y WHERE mode IS DISTINCT FROM 'ignore_row'""", "a",
       v="""SELECT CAST(p_partkey AS BIGINT) AS pub_id, CAST(p_partkey * 10 + nn AS BIGINT) AS id, CASE (p_partkey + nn) % 3 WHEN 0 THEN 'force_person' WHEN 1 THEN 'force_null' ELSE 'ignore_row' END AS mode, CAST(900 + nn AS BIGINT) AS forced, CASE WHEN nn % 2 = 0 THEN CAST(p_partkey % 21 + 1 AS INT) END AS pos,
   CASE WHEN nn = 1 THEN ' AUTHOR ' || CAST(p_partkey % 60 + 1 AS STRING) ELSE '' END AS name, CASE WHEN nn = 3 THEN '0000-0002-1825-' || CAST(1000 + 5 * (p_partkey % 12) AS STRING) ELSE '' END AS orcid, CAST(p_partkey % 3 AS INT) AS at FROM {part} CROSS JOIN (SELECT 1 AS nn UNION ALL SELECT 2 UNION ALL SELECT 3) n""")
def curated_rows(g, v):
    o = v.select("pub_id", F.col("id").alias("override_id"), "mode", F.col("forced").alias("person_id"), F.col("pos").alias("author_position"), F.col("name").alias("author_name"), F.col("orcid").alias("author_orcid"), F.col("at").alias("updated_at"))
    return people.curated_authorships(g.a, o).select("pub_id", "author_position", F.col("person_id").alias("person"))


@query("""SELECT person_id, min(trim(name)) AS alias_name, array_to_string(list_sort(list(DISTINCT src)), ',') AS alias_sources FROM (SELECT person_id, author_name AS name, 'paper' AS src FROM a UNION ALL SELECT person_id, ' ' || upper(author_name), 'import' FROM a WHERE pub_id % 2 = 0 UNION ALL SELECT person_id, display_name, 'people' FROM p UNION ALL SELECT person_id, ' ', 'people' FROM p) x WHERE trim(name) <> '' GROUP BY person_id, lower(trim(name))""", "ap")
def alias_view(g):
    first = g.a.select("person_id", F.col("author_name").alias("alias_name"), F.lit("paper").alias("source"))
    second = g.a.filter("pub_id % 2 = 0").select("person_id", F.concat(F.lit(" "), F.upper("author_name")).alias("alias_name"), F.lit("import").alias("source"))
    third = g.p.select("person_id", F.col("display_name").alias("alias_name"), F.lit("people").alias("source"))
    found = people.aliases(first, second, third, g.p.select("person_id", F.lit(" ").alias("alias_name"), F.lit("people").alias("source")))
    return found.select("person_id", "alias_name", F.array_join("alias_sources", ",").alias("alias_sources"))


@query("""SELECT j.name, j.orcid, CASE WHEN o.person_id IS NOT NULL THEN o.person_id WHEN d.n = 1 THEN d.person_id END AS person_id, CASE WHEN o.person_id IS NOT NULL THEN 'orcid' WHEN d.n = 1 THEN 'name' END AS matched_by FROM j LEFT JOIN (SELECT oid, min(s_suppkey) AS person_id FROM (SELECT s_suppkey, '0000-0002-1825-' || CAST(1000 + s_suppkey % 90 AS VARCHAR) AS oid FROM supplier) a GROUP BY 1 HAVING count(*) = 1) o ON o.oid = j.orcid
   LEFT JOIN (SELECT lower('Pat Name' || CAST(s_suppkey % 70 AS VARCHAR)) AS key, count(*) AS n, min(s_suppkey) AS person_id FROM supplier GROUP BY 1) d ON d.key = lower(CASE WHEN contains(j.name, ',') THEN trim(split_part(j.name, ',', 2)) || ' ' || trim(split_part(j.name, ',', 1)) ELSE j.name END)""",
       j="""SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN 'Pat Name' || CAST(c_custkey % 80 AS STRING) WHEN 1 THEN 'NAME' || CAST(c_custkey % 80 AS STRING) || ', Pat' ELSE 'Zoe Name' || CAST(c_custkey % 80 AS STRING) END AS name, CASE WHEN c_custkey % 4 = 0 THEN '0000-0002-1825-' || CAST(1000 + c_custkey % 95 AS STRING) END AS orcid FROM {customer}""")
def resolved_authors(g, j):
    persons = g("supplier").select(F.col("s_suppkey").cast("long").alias("person_id"), F.concat(F.lit("Pat Name"), (F.col("s_suppkey") % 70).cast("string")).alias("display_name"), F.concat(F.lit("https://orcid.org/0000-0002-1825-"), (F.lit(1000) + F.col("s_suppkey") % 90).cast("string")).alias("orcid"))
    none = g.spark.createDataFrame([], "person_id long, alias_name string")
    return people.resolve_authors(j.select(F.col("name").alias("author_name"), F.col("orcid").alias("author_orcid")), persons, none).select(F.col("author_name").alias("name"), F.col("author_orcid").alias("orcid"), "person_id", "matched_by")


@query("""SELECT x.person_id, CASE WHEN k IS NULL THEN 'not_found' WHEN k <> 'internal' THEN 'not_internal' WHEN c.person_id IS NULL THEN 'no_pii_row' WHEN flag = 'false' THEN 'opted_out' WHEN coalesce(trim(mail), '') = '' THEN 'no_email' ELSE 'ok' END AS reason, CASE WHEN k = 'internal' AND flag IS DISTINCT FROM 'false' AND trim(mail) <> '' THEN mail END AS primary_email
   FROM (SELECT CAST(c_custkey AS BIGINT) AS person_id FROM customer) x LEFT JOIN (SELECT person_id, person_kind AS k FROM p) p ON p.person_id = x.person_id LEFT JOIN c ON c.person_id = x.person_id""", "p",
       c="""SELECT CAST(s_suppkey AS BIGINT) AS person_id, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' || CAST(s_suppkey AS STRING) || '@x.org' END AS mail, CASE s_suppkey % 5 WHEN 0 THEN 'false' WHEN 1 THEN 'true' END AS flag FROM {supplier} WHERE s_suppkey % 7 <> 2""")
def introductions(g, c):
    flags = F.when(F.col("flag") == "false", F.when(F.col("person_id") % 2 == 0, '{"introductions":false}').otherwise('{"introductions":"false"}')).when(F.col("flag") == "true", '{"introductions":true}')
    wanted = g("customer").select(F.col("c_custkey").cast("long").alias("person_id"))
    return people.introduction_contacts(wanted, g.p, c.select("person_id", F.col("mail").alias("primary_email"), flags.alias("consent_flags")))


@query("""SELECT c_custkey AS person_id, CASE WHEN c_custkey % 4 = 0 THEN 'old@x.org' WHEN c_custkey % 3 = 0 THEN 'a@x.org' WHEN c_custkey % 2 = 0 THEN 'B@x.org' ELSE 'b@X.org' END AS primary_email,
   CASE WHEN c_custkey % 3 = 0 THEN 'a@x.org,' ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN 'B@x.org' ELSE 'b@X.org' END || ',c@x.org' AS emails FROM customer WHERE c_custkey % 5 <> 0
   UNION ALL SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN 'email' END, 'z' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, 'b@X.org', 'b@X.org,c@x.org,p@x.org' FROM customer WHERE c_custkey % 10 = 0""")
def merged_contacts(g):
    rows, n = g("customer"), F.col("c_custkey")
    stored = rows.filter("c_custkey % 10 <> 0").select(n.cast("long").alias("person_id"), F.when(n % 5 == 0, F.when(n % 2 == 0, "email")).when(n % 4 == 0, "old@x.org").when(n % 2 == 0, "None").alias("primary_email"), F.when(n % 5 == 0, F.array(F.lit("z"))).when(n % 3 == 0, F.array(F.lit(" a@x.org"), F.lit("emails"), F.when(n % 2 == 0, "B@x.org"))).when(n % 2 == 0, F.array(F.lit("B@x.org"))).alias("emails"))
    offered = rows.filter("c_custkey % 5 <> 0").select(n.cast("long").alias("person_id"), F.array(F.lit("b@X.org"), F.lit("n/a"), F.lit("c@x.org"), F.lit("C@x.org")).alias("emails"))
    new = rows.filter("c_custkey % 10 = 0").select(n.cast("long").alias("person_id"), F.lit("p@x.org").alias("primary_email"), F.array(F.lit("b@X.org"), F.lit("c@x.org")).alias("emails"))
    return people.ensure_contacts(people.merge_contact(stored, offered), new).select("person_id", "primary_email", F.array_join("emails", ",").alias("emails"))


@query("""SELECT person_id, org_name, start_date, department, role_title, end_date, is_current, source FROM (SELECT coalesce(n.person_id, e.person_id) AS person_id, coalesce(n.org_name, e.org_name) AS org_name, coalesce(n.start_date, e.start_date) AS start_date, CASE WHEN n.person_id IS NOT NULL THEN n.department ELSE e.department END AS department,
    CASE WHEN n.person_id IS NOT NULL THEN n.role_title ELSE e.role_title END AS role_title, coalesce(n.end_date, e.end_date) AS end_date, CASE WHEN n.person_id IS NOT NULL THEN n.is_current ELSE e.is_current END AS is_current, coalesce(e.source, n.source) AS source
    FROM e FULL JOIN (SELECT * FROM n WHERE trim(org_name) <> '') n ON n.person_id = e.person_id AND n.org_name = e.org_name AND n.start_date IS NOT DISTINCT FROM e.start_date) x""",
       e="SELECT CAST(c_custkey AS BIGINT) AS person_id, 'Org ' || CAST(c_nationkey AS STRING) AS org_name, 'Old' AS department, 'R' AS role_title, CASE WHEN c_custkey % 3 <> 0 THEN '2001' END AS start_date, CASE WHEN c_custkey % 4 = 0 THEN '2010' END AS end_date, FALSE AS is_current, CASE WHEN c_custkey % 2 = 0 THEN 'manual' END AS source FROM {customer}",
       n="SELECT CAST(c_custkey AS BIGINT) AS person_id, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE 'Org ' || CAST(c_nationkey AS STRING) END AS org_name, CASE WHEN c_custkey % 5 = 0 THEN 'New' END AS department, 'S' AS role_title, CASE WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 7 = 0 THEN '2002' ELSE '2001' END END AS start_date, CASE WHEN c_custkey % 6 = 0 THEN '2012' END AS end_date, TRUE AS is_current, 'orcid' AS source FROM {customer} WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def employments(g, e, n):
    return people.upsert_employments(e, n)


@query("""SELECT pub_id, pos AS author_position, CAST(CASE WHEN rn = 1 THEN person_id END AS BIGINT) AS person_id, source FROM (SELECT pub_id, pos, source, person_id, row_number() OVER (PARTITION BY pub_id, person_id ORDER BY pos) AS rn FROM (SELECT j.*, CASE WHEN pos <= 2 THEN 1 WHEN pos = 3 THEN 2 END AS person_id FROM j
   JOIN (SELECT pub_id, arg_min(source, (rk, -aff, -n, source)) AS best FROM (SELECT pub_id, source, rk, count(*) AS n, count(*) FILTER (WHERE places > 0) AS aff FROM j GROUP BY 1, 2, 3) s GROUP BY 1) b ON b.pub_id = j.pub_id AND b.best = j.source) x) y""",
       j="""SELECT CAST(p_partkey AS BIGINT) AS pub_id, src AS source, CAST(rk AS INT) AS rk, CAST(pos AS INT) AS pos, CAST((p_partkey + pos + rk) % 3 AS INT) AS places FROM {part} CROSS JOIN (SELECT 'openalex' AS src, 7 AS rk UNION ALL SELECT 'crossref', 1 UNION ALL SELECT 'local-b', 9 UNION ALL SELECT 'local-a', 9) s CROSS JOIN (SELECT 1 AS pos UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) q
   WHERE (src = 'crossref' AND p_partkey % 3 = 0) OR (src = 'openalex' AND p_partkey % 2 = 0) OR (src LIKE 'local%' AND (pos < 4 OR p_partkey % 5 = 0 OR src = 'local-a'))""")
def rebuilt(g, j):
    rows = j.select("pub_id", "source", F.col("pos").alias("position"), F.when(F.col("pos") <= 2, "Jane Doe").when(F.col("pos") == 3, "Ann Lee").otherwise("Nobody Here").alias("name"), F.lit(None).cast("string").alias("orcid"), F.when(F.col("places") > 0, F.array(F.lit("X"))).otherwise(F.array().cast("array<string>")).alias("affiliations"))
    persons = g.spark.createDataFrame([(1, "Jane Doe", None), (2, "Ann Lee", None)], "person_id long, display_name string, orcid string")
    return works.rebuilt_authorships(rows, persons, g.spark.createDataFrame([], "person_id long, alias_name string")).select("pub_id", "author_position", "person_id", "source")


@query("""SELECT pub_id, author_position, CASE WHEN person_id IS NOT NULL THEN person_id WHEN f IS NOT NULL AND rn = 1 THEN f END AS person_id FROM (SELECT x.*, row_number() OVER (PARTITION BY pub_id, f ORDER BY author_position) AS rn FROM (SELECT a.pub_id, a.author_position, a.person_id, CASE WHEN a.person_id IS NULL AND q.pid NOT IN (SELECT b.person_id FROM a b WHERE b.pub_id = a.pub_id AND b.person_id IS NOT NULL) THEN q.pid END AS f
   FROM a LEFT JOIN (SELECT 'author ' || CAST(s_suppkey AS VARCHAR) AS key, s_suppkey AS pid FROM supplier) q ON q.key = lower(a.author_name)) x) y""", "a")
def relinked(g):
    persons = g("supplier").select(F.col("s_suppkey").cast("long").alias("person_id"), F.concat(F.lit("Author "), F.col("s_suppkey").cast("string")).alias("display_name"), F.lit(None).cast("string").alias("orcid"), F.lit("internal").alias("person_kind"))
    rows = g.a.withColumn("paper_orcid", F.lit(None).cast("string")).withColumn("author_orcid", F.lit(None).cast("string"))
    return works.relink(rows, persons, g.spark.createDataFrame([], "person_id long, alias_name string")).select("pub_id", "author_position", "person_id")


# ---- writing works and authorships

STORED = "SELECT pub_id, '10.1234/s' || CAST(pub_id AS STRING) AS doi, title, year, CASE WHEN venue <> '' THEN venue END AS venue, coalesce(provenance, '') AS provenance, payload, is_preprint FROM (" + INPUTS["w"] + ") x WHERE pub_id % 2 = 0"
OFFERED = """SELECT CASE WHEN p_partkey % 10 = 7 THEN 'no doi' ELSE ' DOI:10.1234/S' || CAST(p_partkey AS STRING) || '.' END AS doi, CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE ' New ' || CAST(p_partkey AS STRING) END AS title, CASE WHEN p_partkey % 6 <> 0 THEN CAST(2020 AS INT) END AS year, CASE WHEN p_partkey % 3 = 0 THEN 'V' ELSE '' END AS venue,
  'crossref' AS provenance, CASE WHEN p_partkey % 5 = 0 THEN '{{"crossref":{{"n":1}}}}' END AS payload, CASE WHEN p_partkey % 8 = 0 THEN TRUE END AS is_preprint FROM {part} WHERE p_partkey % 3 <> 1"""


@query("""SELECT CASE WHEN s.pub_id IS NOT NULL THEN s.pub_id ELSE -1 END AS pub_id, coalesce(s.doi, n.k) AS doi, coalesce(n.t, s.title) AS title, coalesce(n.year, s.year) AS year, coalesce(n.v, s.venue) AS venue, CASE WHEN n.k IS NULL THEN s.provenance WHEN s.doi IS NULL THEN 'crossref' WHEN contains(s.provenance, 'crossref') THEN replace(s.provenance, '+unknown', '')
    WHEN s.provenance IN ('', 'unknown') THEN 'crossref' WHEN s.provenance = 'openalex+dblp' THEN 'crossref+dblp+openalex' WHEN s.provenance = 'semantic+ semantic' THEN 'crossref+semantic' WHEN s.provenance = 'OpenAlex' THEN 'crossref+OpenAlex' WHEN s.provenance = 'zzz-local+orcid' THEN 'crossref+orcid+zzz-local' ELSE 'crossref+openalex-affiliation' END AS provenance,
    coalesce(n.is_preprint, s.is_preprint) AS is_preprint, CASE WHEN n.payload IS NOT NULL THEN 'n' WHEN s.payload IS NULL THEN 'none' ELSE json_extract_string(s.payload, '$.crossref.type') END AS kind
  FROM s FULL JOIN (SELECT *, '10.1234/s' || regexp_extract(doi, 'S([0-9]+)', 1) AS k, nullif(trim(title), '') AS t, nullif(trim(venue), '') AS v FROM n WHERE doi <> 'no doi') n ON n.k = s.doi""", s=STORED, n=OFFERED)
def upserted_works(g, s, n):
    got = works.upsert_works(s, n)
    top = s.agg(F.max("pub_id").alias("top"))
    kind = F.when(F.get_json_object("payload", "$.crossref.n").isNotNull(), "n").when(F.col("payload").isNull(), "none").otherwise(F.get_json_object("payload", "$.crossref.type"))
    known = got.crossJoin(top).withColumn("pub_id", F.when(F.col("pub_id") > F.col("top"), -1).otherwise(F.col("pub_id")))
    return known.select("pub_id", "doi", "title", "year", "venue", "provenance", "is_preprint", kind.alias("kind"))


@query("SELECT count(*) AS n, count(DISTINCT id) AS ids, min(id) AS low, max(id) AS high FROM (SELECT 100 + row_number() OVER () AS id FROM part) x")
def numbered_ids(g):
    new = works.numbered_after(g("part").select("p_name", "p_partkey"), g.spark.range(101), "id", [F.col("p_partkey")])
    return new.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("low"), F.max("id").alias("high"))


@query("""SELECT s.pub_id, coalesce(n.t, s.title) AS title, s.year, coalesce(n.v, s.venue) AS venue, CASE WHEN n.payload IS NOT NULL THEN json_extract_string(n.payload, '$.crossref.n') END AS patched FROM s LEFT JOIN (SELECT CAST(regexp_extract(doi, 'S([0-9]+)', 1) AS BIGINT) AS id, nullif(trim(title), '') AS t, nullif(trim(venue), '') AS v, payload FROM n WHERE doi <> 'no doi') n ON n.id = s.pub_id""", s=STORED, n=OFFERED)
def updated_works(g, s, n):
    new = n.filter("doi <> 'no doi'").withColumn("pub_id", F.regexp_extract("doi", "S([0-9]+)", 1).cast("long")).withColumn("doi", F.lit(None).cast("string")).withColumn("provenance", F.lit(" ")).withColumn("year", F.lit(None).cast("int"))
    return works.update_works(s, new).select("pub_id", "title", "year", "venue", F.get_json_object("payload", "$.crossref.n").alias("patched"))


AUTHORS = """SELECT CAST(p_partkey AS BIGINT) AS pub_id, CAST(k AS INT) AS author_position, CASE WHEN (p_partkey + k) % 3 = 0 THEN CAST(p_partkey * 10 + k AS BIGINT) END AS person_id, 'Old ' || CAST(k AS STRING) AS author_name, k % 2 = 0 AS is_corresponding FROM {part} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) x WHERE p_partkey % 4 <> 0"""
NEWCOMERS = """SELECT CAST(p_partkey AS BIGINT) AS pub_id, CAST(k AS INT) AS author_position, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey * 10 + k % 3 + 1 AS BIGINT) WHEN p_partkey % 5 = 1 THEN CAST(900000 + k AS BIGINT) END AS person_id, CASE WHEN k = 2 THEN ' ' ELSE ' New ' || CAST(k AS STRING) END AS author_name FROM {part} CROSS JOIN (SELECT 2 AS k UNION ALL SELECT 4) x WHERE p_partkey % 2 = 0"""


@query("""SELECT coalesce(o.pub_id, n.pub_id) AS pub_id, coalesce(o.author_position, n.pos) AS author_position, coalesce(o.person_id, n.person_id) AS person_id, coalesce(n.name, o.author_name) AS author_name, CASE WHEN n.pub_id IS NOT NULL THEN TRUE ELSE o.is_corresponding END AS is_corresponding, n.pub_id IS NOT NULL AND coalesce(n.person_id >= 900000, FALSE) AS is_internal
   FROM o FULL JOIN (SELECT * FROM (SELECT y.*, row_number() OVER (PARTITION BY pub_id, pos ORDER BY pos <> author_position, author_position) AS rn FROM (SELECT n.*, nullif(trim(n.author_name), '') AS name, coalesce(p.at, n.author_position) AS pos FROM n LEFT JOIN (SELECT pub_id, person_id, min(author_position) AS at FROM o WHERE person_id IS NOT NULL GROUP BY 1, 2) p ON p.pub_id = n.pub_id AND p.person_id = n.person_id) y) z WHERE rn = 1) n ON n.pub_id = o.pub_id AND n.pos = o.author_position""", o=AUTHORS, n=NEWCOMERS)
def upserted_authorships(g, o, n):
    none = F.lit(None).cast("string")
    full = lambda df: df.withColumn("author_orcid", none).withColumn("paper_orcid", none).withColumn("affiliations", F.lit(None).cast("array<string>")).withColumn("paper_affiliation", none).withColumn("order_tag", F.lit("middle")).withColumn("equal_contrib_tag", none).withColumn("raw_author", none)
    persons = n.select("person_id").filter("person_id is not null").distinct().withColumn("person_kind", F.when(F.col("person_id") >= 900000, "internal").otherwise("external"))
    old = full(o).withColumn("is_internal", F.lit(False))
    return works.upsert_authorships(old, full(n).withColumn("is_corresponding", F.lit(True)), persons).select("pub_id", "author_position", "person_id", "author_name", "is_corresponding", "is_internal")


@query(f""", {KEYED}, gr AS (SELECT dk, arg_min(pub_id, (CASE WHEN is_preprint IS NULL THEN 1 WHEN is_preprint THEN 2 ELSE 0 END, CASE WHEN regexp_matches(coalesce(doi, ''), '10\\.[0-9]{{4,9}}/') THEN 0 ELSE 1 END, rank, -nt, -sp, CASE WHEN year IS NULL THEN 1 ELSE 0 END, CASE WHEN coalesce(venue, '') = '' THEN 1 ELSE 0 END, pub_id)) AS win FROM (SELECT *, coalesce(list_min(list_transform(toks, lambda x: coalesce(nullif(list_position(['manual', 'crossref', 'datacite', 'semantic', 'orcid', 'scholar', 'dblp', 'openalex', 'unknown'], split_part(x, '-', 1)), 0) - 1, 9))), 8) AS rank,
    greatest(len(list_distinct(toks)), 1) AS nt, len(list_filter(toks, lambda x: contains(x, '-'))) AS sp FROM (SELECT *, list_filter(list_transform(string_split(lower(coalesce(provenance, '')), '+'), lambda x: trim(x)), lambda x: x <> '') AS toks FROM k WHERE dk IS NOT NULL) y) z GROUP BY 1), mp AS (SELECT k.pub_id, coalesce(gr.win, k.pub_id) AS win FROM k LEFT JOIN gr ON gr.dk = k.dk)
   SELECT win AS pub_id, count(DISTINCT mp.pub_id) AS n_works, count(DISTINCT CASE WHEN a.person_id IS NULL THEN NULL ELSE a.person_id END) AS n_positions FROM mp LEFT JOIN (SELECT win2, person_id FROM (SELECT mp.win AS win2, a.author_position, a.person_id, row_number() OVER (PARTITION BY mp.win, a.author_position ORDER BY a.pub_id <> mp.win, a.pub_id) AS n FROM a JOIN mp ON mp.pub_id = a.pub_id) q WHERE n = 1) a ON a.win2 = win GROUP BY 1""", "wa")
def doi_merges(g):
    kept, moved, merges = works.merged_duplicates(g.w, g.a)
    n = merges.groupBy(F.col("winner").alias("pub_id")).agg((F.count(F.lit(1)) + 1).alias("n"))
    positions = moved.groupBy("pub_id").agg(F.count_distinct("person_id").alias("n_positions"))
    return kept.join(n, "pub_id", "left").join(positions, "pub_id", "left").select("pub_id", F.coalesce("n", F.lit(1)).alias("n_works"), F.coalesce("n_positions", F.lit(0)).alias("n_positions"))


@query("""SELECT pub_id FROM w WHERE doi IS NULL OR year IS NULL OR venue IS NULL OR payload IS NULL OR NOT list_contains(json_keys(payload), 'crossref')""", "w")
def missing_data(g):
    return works.missing_data(g.w, "crossref").select("pub_id")


@query("""SELECT pub_id, year, t_at AS last_attempt FROM (SELECT w.pub_id, w.year, t.t_at, t.pub_id IS NOT NULL AS tried FROM w LEFT JOIN t ON t.pub_id = w.pub_id WHERE attributed IS NOT TRUE AND is_preprint IS NOT TRUE AND (payload IS NULL OR NOT list_contains(json_keys(payload), 'crossref')) AND w.pub_id IN (SELECT pub_id FROM a WHERE person_id IS NOT NULL)
   AND (t.pub_id IS NULL OR t.outcome = 'error' OR t.t_at < TIMESTAMP '2024-05-01' - INTERVAL 30 DAY)) x ORDER BY tried, t_at ASC NULLS FIRST, year DESC NULLS LAST, pub_id LIMIT 25""", "wa",
       t="SELECT CAST(p_partkey AS BIGINT) AS pub_id, CAST(CASE WHEN p_partkey % 4 = 0 THEN '2024-04-20 00:00:00' WHEN p_partkey % 4 = 1 THEN '2024-01-05 00:00:00' END AS TIMESTAMP) AS t_at, CASE WHEN p_partkey % 8 = 0 THEN 'error' ELSE 'enriched' END AS outcome FROM {part} WHERE p_partkey % 3 <> 0")
def fetch_queue(g, t):
    tries = t.select("pub_id", F.col("t_at").alias("last_attempt"), F.col("outcome").alias("last_outcome"))
    return works.attribution_queue(g.w, g.a, tries, F.lit("2024-05-01 00:00:00").cast("timestamp"), 30, 25).withColumn("last_attempt", F.col("last_attempt").cast("timestamp_ntz"))


@query("""SELECT coalesce(t.pub_id, b.pub_id) AS pub_id, coalesce(t.n, 0) + CASE WHEN b.pub_id IS NOT NULL THEN 1 ELSE 0 END AS attempt_count, CASE WHEN b.pub_id IS NULL THEN t.outcome WHEN b.pub_id % 6 = 0 THEN 'error' WHEN b.pub_id % 2 = 0 THEN 'enriched' WHEN b.pub_id % 9 = 1 THEN 'enriched' ELSE 'no_new_payload' END AS last_outcome FROM t FULL JOIN (SELECT CAST(p_partkey AS BIGINT) AS pub_id FROM part WHERE p_partkey % 3 <> 2 AND p_partkey % 7 <> 0) b ON b.pub_id = t.pub_id""",
       t="SELECT CAST(p_partkey AS BIGINT) AS pub_id, CAST(p_partkey % 3 AS INT) AS n, 'old' AS outcome FROM {part} WHERE p_partkey % 2 = 1")
def attempts(g, t):
    old = t.select("pub_id", F.col("n").alias("attempt_count"), F.lit(None).cast("string").alias("last_attempt"), F.col("outcome").alias("last_outcome"), F.lit(False).alias("became_attributed"))
    parts = g("part").select(F.col("p_partkey").cast("long").alias("pub_id")).filter("pub_id % 3 <> 2")
    n = F.col("pub_id")
    before = parts.withColumn("missing", F.array(F.lit("crossref"), F.lit("dblp")))
    after = parts.filter("pub_id % 7 <> 0").withColumn("missing", F.when(n % 6 == 0, F.array(F.lit("crossref"))).when(n % 2 == 0, F.array(F.lit("dblp"))).when(n % 9 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("crossref"), F.lit("dblp")))).withColumn("attributed", n % 4 == 0)
    errors = parts.filter("pub_id % 6 = 0 or pub_id % 9 = 1").withColumn("source", F.lit("crossref"))
    return works.recorded_attempts(old, before, after, errors, F.lit("now")).select("pub_id", "attempt_count", "last_outcome")


@query("""SELECT pub_id, CAST(n AS INT) AS n_sources FROM (SELECT pub_id, year, CASE WHEN trim(coalesce(provenance, '')) = '' OR lower(trim(provenance)) = 'unknown' THEN 0 ELSE length(provenance) - length(replace(provenance, '+', '')) + 1 END AS n FROM w) x WHERE n < 2 ORDER BY n, year DESC NULLS LAST, pub_id LIMIT 40""", "w")
def low_sources(g):
    return works.low_source_queue(g.w, 2, 40).select("pub_id", "n_sources")


@query("""SELECT o.pub_id, CASE WHEN o.title <> '' AND (NOT above OR coalesce(s.title, '') = '') THEN o.title END AS title, CASE WHEN NOT above OR s.year IS NULL THEN o.year END AS year, CASE WHEN o.venue <> '' AND (NOT above OR coalesce(s.venue, '') = '') THEN o.venue END AS venue, CASE WHEN NOT above THEN TRUE END AS is_preprint, NOT above AS allow_authors
   FROM o LEFT JOIN (SELECT *, regexp_matches(lower(coalesce(provenance, '')), 'manual|crossref|semantic|orcid|dblp') AS up FROM w WHERE pub_id % 3 <> 0) s ON s.pub_id = o.pub_id CROSS JOIN LATERAL (SELECT coalesce(s.up, FALSE) AS above) l""", "w",
       o="SELECT CAST(p_partkey AS BIGINT) AS pub_id, CASE WHEN p_partkey % 2 = 0 THEN 'T' ELSE '' END AS title, CAST(2000 AS INT) AS year, CASE WHEN p_partkey % 5 <> 0 THEN 'V' ELSE '' END AS venue, TRUE AS is_preprint FROM {part}")
def fill_only(g, o):
    return works.fill_only(g.w.filter("pub_id % 3 <> 0"), o, "openalex")


@query("""SELECT 'provisional' AS review_type, pub_id, 'pending' AS status FROM w WHERE doi IS NULL AND pub_id % 4 <> 1""", "w")
def provisional(g):
    queue = g.w.filter("pub_id % 4 = 1").select("pub_id", F.lit("provisional").alias("review_type")).unionAll(g.w.filter("pub_id % 4 = 2").select("pub_id", F.lit("other").alias("review_type")))
    return works.provisional_queue(g.w, queue).drop("payload")


SEARCH = """SELECT CAST(c_custkey AS BIGINT) AS place, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'https://doi.org/10.1234/S' || CAST(c_custkey % 97 AS STRING) END AS doi, c_name AS title, CAST(2020 AS INT) AS year, CAST(NULL AS STRING) AS venue, FALSE AS is_preprint, CASE WHEN c_custkey % 5 = 0 THEN 'Elsewhere' ELSE 'The Example--Univ. of X' END AS aff, CAST('{{}}' AS STRING) AS payload FROM {customer}"""


@query("""SELECT place, outcome FROM (SELECT place, CASE WHEN NOT fits THEN 'affiliation_mismatch' WHEN k IS NULL THEN 'no_doi' WHEN place > first THEN 'repeated' WHEN st THEN 'update' ELSE 'insert' END AS o, CASE WHEN o IN ('insert', 'update') AND sum(CASE WHEN o IN ('insert', 'update') THEN 1 ELSE 0 END) OVER (ORDER BY place) > 40 THEN 'over_cap' ELSE o END AS outcome
   FROM (SELECT y.*, min(CASE WHEN fits AND k IS NOT NULL THEN place END) OVER (PARTITION BY k) AS first, k IN (SELECT doi FROM s) AS st FROM (SELECT place, aff <> 'Elsewhere' AS fits, nullif(lower(replace(doi, 'https://doi.org/', '')), '') AS k FROM n ORDER BY place LIMIT 140) y) z) q""", s=STORED, n=SEARCH)
def search_outcomes(g, s, n):
    got = works.ingest_search(s, n.withColumn("affiliations", F.array("aff")), "crossref-affiliation", ["Example Univ"], max_records=140, max_new=40)
    return got.select("place", "outcome")


@query("""SELECT s.pub_id, CASE WHEN s.pub_id % 6 = 0 THEN 'not_found' WHEN s.pub_id % 10 = 4 AND s.pub_id + 2 IN (SELECT pub_id FROM s) THEN 'collision' ELSE 'update' END AS outcome, CASE WHEN s.pub_id % 6 <> 0 AND s.pub_id % 10 = 4 AND s.pub_id + 2 IN (SELECT pub_id FROM s) THEN s.pub_id + 2 END AS other, CASE WHEN s.pub_id % 6 <> 0 AND s.pub_id % 10 = 8 THEN '10.9/n' || s.pub_id END AS doi FROM (SELECT * FROM s) s""", s=STORED)
def backfill_outcomes(g, s):
    n = F.col("pub_id")
    stored = s.withColumn("doi", F.when(n % 10 == 8, F.lit(None)).otherwise(F.col("doi")))
    found = s.select("pub_id", F.when(n % 10 == 4, F.concat(F.lit("10.1234/S"), (n + 2).cast("string"))).otherwise(F.concat(F.lit("10.9/n"), n.cast("string"))).alias("doi"), F.lit("T").alias("title"), F.lit(2020).alias("year"), F.lit("V").alias("venue"), F.lit(False).alias("is_preprint"), F.when(n % 6 != 0, "{}").alias("payload"))
    return works.backfill(stored, found, "crossref").select("pub_id", "outcome", F.when(F.col("outcome") == "collision", F.col("other")).alias("other"), "doi")


BIBLIOGRAPHY = """SELECT CAST(c_custkey AS BIGINT) AS place, CASE WHEN c_custkey % 3 = 0 THEN 'k' || CAST(c_custkey AS STRING) ELSE '' END AS csv_key, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'doi:10.1234/S' || CAST(c_custkey % 120 AS STRING) END AS doi, CASE WHEN c_custkey % 8 = 0 THEN '' ELSE 'T ' || CAST(c_custkey AS STRING) END AS title, 'V' AS venue, CAST(2001 AS INT) AS year FROM {customer}"""


@query("""SELECT place, CASE WHEN own IS NULL THEN 'manual-no-doi' ELSE 'manual' END AS source_of_truth, coalesce(nullif(csv_key, ''), 'row_' || place) AS csv_key, coalesce(k, '') AS doi, CASE WHEN err IS NOT NULL THEN 'no_doi_title_lookup_failed' WHEN st IS NOT NULL THEN 'update' ELSE 'insert' END AS ingest_action, CASE WHEN err IS NULL AND st IS NOT NULL THEN '1' ELSE '0' END AS already_in_db, CASE WHEN err IS NULL THEN st END AS pub_id_before, CASE WHEN err IS NULL AND f THEN '1' ELSE '0' END AS crossref_found, CASE WHEN err IS NULL AND f THEN 'Found' ELSE title END AS title, coalesce(err, '') AS error
   FROM (SELECT x.*, s.pub_id AS st, coalesce(CAST(regexp_extract(k, 's([0-9]+)', 1) AS INT) % 2 = 0, FALSE) AS f, row_number() OVER (PARTITION BY CASE WHEN err IS NULL THEN k ELSE 'e' || place END ORDER BY place) AS rn FROM (SELECT place, csv_key, title, own, CASE WHEN own IS NULL THEN CASE WHEN title = '' THEN 'missing DOI; title lookup failed (missing title)' WHEN place % 20 = 4 THEN 'title lookup failed' WHEN place % 20 = 12 THEN 'title lookup matched but DOI missing' END END AS err,
     CASE WHEN own IS NOT NULL THEN own WHEN title <> '' AND place % 20 NOT IN (4, 12) THEN '10.1234/s' || (place % 50 + 300) END AS k FROM (SELECT *, nullif(lower(replace(doi, 'doi:', '')), '') AS own FROM n) y) x LEFT JOIN s ON s.doi = x.k) z WHERE rn = 1""", s=STORED, n=BIBLIOGRAPHY)
def bibliography_import(g, s, n):
    hits = n.filter("doi = '' and title <> '' and place % 20 <> 4").select("place", F.when(F.col("place") % 20 != 12, F.concat(F.lit("10.1234/S"), (F.col("place") % 50 + 300).cast("string"))).alias("doi"))
    numbers = g.spark.range(1000)
    lookups = numbers.filter("id % 2 = 0").select(F.concat(F.lit("10.1234/s"), F.col("id").cast("string")).alias("doi"), F.lit("Found").alias("f_title"), F.lit(None).cast("string").alias("f_venue"), F.lit(2002).alias("f_year"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("agency_id"), F.lit(None).cast("string").alias("agency_label"), F.lit(3).alias("n_authors"), F.array(F.lit(1)).alias("person_ids"))
    report = works.import_bibliography(n, lookups, hits, s, dry_run=False)
    return report.select("place", "source_of_truth", "csv_key", "doi", "ingest_action", "already_in_db", "pub_id_before", "crossref_found", "title", "error")


@query(_values([(1, 2, 0.8), (2, 5, 1.1), (4, 1, 1.03)], "wanted_id, place, score"))
def best_titles(g):
    wanted = g.spark.createDataFrame([(1, "A study of rivers", None), (2, "A Study of <i>Rivers</i>", 2001), (3, "Nothing alike", 2001), (4, "stones", 2001)], "wanted_id int, title string, year int")
    hits = g.spark.createDataFrame([(1, 1, "unlike", 2000), (1, 2, "A study of the rivers", 2001), (1, 3, "A study of the rivers", 2001), (2, 4, "a study of rivers", 1990), (2, 5, "a study of rivers!", 2001), (3, 1, "zzz", 2001), (4, 1, "Stones", 2002), (4, 2, "Stones", 1999)], "wanted_id int, place int, c_title string, c_year int")
    return works.best_titles(wanted, hits).select("wanted_id", "place", F.round("score", 2).alias("score")).withColumn("score", F.when(F.col("wanted_id") == 1, F.floor(F.col("score") * 10) / 10).otherwise(F.col("score")))


@query("""SELECT pub_id, count(*) AS total, count(person_id) AS with_person, count(*) FILTER (WHERE paper_affiliation IS NOT NULL) AS with_affiliation FROM a GROUP BY 1""", "a")
def authorship_summary(g):
    return works.authorship_counts(g.a.withColumn("affiliations", F.when(F.col("paper_affiliation").isNotNull(), F.array("paper_affiliation")).otherwise(F.array().cast("array<string>"))))


# ---- decisions

@query("""SELECT CASE WHEN decision_id > 100000 THEN -1 ELSE decision_id END AS decision_id, mode, doi_key, active FROM (SELECT decision_id, mode, doi_key, active AND NOT coalesce(doi_key IN (SELECT doi FROM s WHERE pub_id % 4 = 0), FALSE) AS active FROM e UNION ALL SELECT 100001, CASE WHEN pub_id % 8 = 0 THEN 'merge_to' ELSE 'keep_separate' END, doi, TRUE FROM s WHERE pub_id % 4 = 0 AND (pub_id % 8 <> 0 OR pub_id % 100 + 2 IN (SELECT pub_id FROM s))) x""", s=STORED,
       e="SELECT CAST(100000 - p_partkey AS BIGINT) AS decision_id, 'confirm_winner' AS mode, '10.1234/s' || CAST(p_partkey AS STRING) AS doi_key, CAST(NULL AS STRING) AS title_key, CAST(NULL AS INT) AS year, p_partkey % 3 <> 0 AS active FROM {part}")
def decided(g, s, e):
    none = F.lit(None).cast("string")
    old = e.select("decision_id", "mode", "doi_key", "title_key", "year", none.alias("winner_doi_key"), none.alias("winner_title_key"), F.lit(None).cast("int").alias("winner_year"), none.alias("note"), none.alias("created_by"), F.lit("old").alias("updated_at"), "active")
    n = F.col("pub_id")
    asked = s.filter("pub_id % 4 = 0").select(F.when(n % 8 == 0, "merge_to").otherwise("keep_separate").alias("mode"), "pub_id", F.when(n % 8 == 0, n % 100 + 2).alias("winner_pub_id"), none.alias("note"), none.alias("created_by"))
    got = curation.decide(old, asked, s, F.lit("now"))
    top = old.agg(F.max("decision_id").alias("top"))
    return got.crossJoin(top).select(F.when(F.col("decision_id") > F.col("top"), -1).otherwise(F.col("decision_id")).alias("decision_id"), "mode", "doi_key", "active")


@query(f", {MEMBERS} SELECT m.cid AS canonical_pub_id, count(*) AS n, string_agg(CAST(m.pub_id AS VARCHAR), ',' ORDER BY m.pub_id <> m.cid, m.pub_id) AS ids FROM m JOIN g ON g.cid = m.cid AND g.n > 1 GROUP BY 1", "wdo")
def dedup_families(g):
    found = curation.families(canonical.memberships(g.w, g.d, g.o), g.w)
    ids = F.transform(F.from_json("members", "array<struct<pub_id:bigint>>"), lambda x: x["pub_id"].cast("string"))
    return found.select("canonical_pub_id", "n", F.array_join(ids, ",").alias("ids"))


@query("""SELECT review_type, pub_id, status, status IN ('approved', 'applied') AS approved, status = 'applied' AS applied FROM (SELECT 'r' AS review_type, pub_id, CASE pub_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'applied' END AS status FROM w WHERE pub_id % 5 <> 0 OR pub_id % 2 = 0) x UNION ALL SELECT 'r', pub_id, CASE WHEN pub_id % 2 = 0 THEN 'rejected' ELSE 'pending' END, FALSE, FALSE FROM w WHERE pub_id % 5 = 0""", "w")
def review_queue(g):
    n = F.col("pub_id")
    old = g.w.filter("pub_id % 5 = 0").select(F.lit("r").alias("review_type"), "pub_id", F.when(n % 2 == 0, "rejected").otherwise("pending").alias("status"), F.lit(None).cast("string").alias("note"), n.alias("queue_id"), F.lit(None).cast("string").alias("approved_at"), F.lit(None).cast("string").alias("applied_at"))
    new = g.w.select(F.lit("r").alias("review_type"), "pub_id", F.when(n % 3 == 0, "pending").when(n % 3 == 1, "approved").otherwise("applied").alias("status"), F.lit(None).cast("string").alias("note"))
    return curation.enqueue(old, new, F.lit("now")).select("review_type", "pub_id", "status", F.col("approved_at").isNotNull().alias("approved"), F.col("applied_at").isNotNull().alias("applied"))


@query("""SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.v ELSE o.v END AS v FROM (SELECT p_partkey AS id, 'old' AS v FROM part WHERE p_partkey % 2 = 0) o FULL JOIN (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 <> 0 THEN 'new' END AS v FROM part WHERE p_partkey % 3 = 0) n ON n.id = o.id""")
def imported_curation(g):
    parts = g("part").select(F.col("p_partkey").cast("long").alias("id"))
    old, new = parts.filter("id % 2 = 0").withColumn("v", F.lit("old")), parts.filter("id % 3 = 0").withColumn("v", F.when(F.col("id") % 9 != 0, "new")).withColumn("extra", F.lit(1))
    lines = curation.exported({"t": (new, ["id"]), "u": (new, ["id"])})
    return curation.imported(g.spark, lines["t"].unionAll(lines["u"]), "t", old, ["id"])


# ---- providers' payloads

DATACITE = '{"id":"x","attributes":{"doi":"10.5061/D.1","titles":[{"title":"Data"}],"publisher":"P","publicationYear":2019,"types":{"resourceTypeGeneral":"Preprint"},"creators":[{"name":"Lee, Ann","givenName":"Ann","familyName":"Lee","nameIdentifiers":[{"nameIdentifier":"https://orcid.org/0000-0002-1825-0097","nameIdentifierScheme":"ORCID"}],"affiliation":["U",{"name":"V","department":"D"}," "]},{"name":"Group"}]}}'
OPENALEX = '{"id":"W1","doi":"https://doi.org/10.1234/O","title":"T","type":"article","publication_year":2020,"primary_location":{"source":{"display_name":"J"}},"authorships":[{"raw_author_name":"A. B","author":{"display_name":"Ann B","orcid":null},"raw_affiliation_strings":[],"institutions":[{"display_name":"I"}]},{"raw_author_name":"","author":{"display_name":"C D"},"raw_affiliation_strings":["R"],"institutions":[]}]}'
SEMANTIC = '{"paperId":"p","externalIds":{"DOI":"10.1101/2020.1"},"title":"S","venue":"","publicationVenue":{"name":"W"},"year":2021,"publicationTypes":["JournalArticle"],"authors":[{"authorId":"1","name":"X Y","affiliations":["U"],"externalIds":{"ORCID":"0000-0002-1825-0097"}}]}'
DBLP = '{"title":"On <i>Graphs</i>.","year":"2018","type":"Article","ee":["https://x.org","https://doi.org/10.1234/DB"],"venue":["","CoRR"],"authors":{"author":[{"text":"Ann Lee 0001"},"Bob Ray",{"name":"Cy"}]}}'
DBLP_ONE = '{"title":"Solo","year":"n/a","doi":"10.1234/solo","venue":"SSRN notes","authors":{"author":{"text":"Only One"}}}'
CROSSREF = '{"DOI":"10.1234/C","type":"report","title":["T"],"container-title":["J"],"published-online":{"date-parts":[[2021,13]]},"issued":{"date-parts":[[2022,5]]},"author":[{"given":"A","family":"B"},{"name":" "}]}'
PAYLOADS = [(1, "datacite", DATACITE), (2, "openalex", OPENALEX), (3, "semantic", SEMANTIC), (4, "dblp", DBLP), (5, "dblp", DBLP_ONE), (6, "crossref", CROSSREF)]


def _payloads(g: Given, source: str) -> DataFrame:
    return g.spark.createDataFrame([(k, p) for k, s, p in PAYLOADS if s == source], "payload_id long, payload string")


def _all(g: Given, f: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    found = [f(_payloads(g, s), s) for s in ("datacite", "openalex", "semantic", "dblp", "crossref")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@query(_values([(1, "10.5061/d.1", "Data", 2019, "P", True), (2, "10.1234/o", "T", 2020, "J", False), (3, "10.1101/2020.1", "S", 2021, "W", True), (4, "10.1234/db", "On Graphs", 2018, "CoRR", False), (5, "10.1234/solo", "Solo", None, "SSRN notes", True), (6, "10.1234/c", "T", 2022, "J", True)], "payload_id, doi, title, year, venue, is_preprint"))
def provider_works(g):
    return _all(g, providers.works).withColumn("payload_id", F.col("payload_id").cast("int"))


@query(_values([(1, 1, "Ann Lee", "0000-0002-1825-0097", "U;V"), (1, 2, "Group", None, ""), (2, 1, "A. B", None, "I"), (2, 2, "C D", None, "R"), (3, 1, "X Y", "0000-0002-1825-0097", "U"), (4, 1, "Ann Lee 0001", None, ""), (4, 2, "Bob Ray", None, ""), (4, 3, "Cy", None, ""), (5, 1, "Only One", None, ""), (6, 1, "A B", None, ""), (6, 2, None, None, "")], "payload_id, position, name, orcid, affiliations"))
def provider_authors(g):
    return _all(g, providers.authors).withColumn("payload_id", F.col("payload_id").cast("int")).withColumn("affiliations", F.array_join("affiliations", ";"))


@query(_values([(1, 1, "X"), (1, 2, None), (2, None, None), (3, None, None)], "payload_id, position, name"))
def work_contributors(g):
    rows = g.spark.createDataFrame([(1, '{"contributors":{"contributor":[{"credit-name":{"value":"X"}},{"contributor-orcid":{"path":"0000-0002-1825-0097"}}]}}'), (2, '{"contributors":null}'), (3, None)], "payload_id long, payload string")
    return providers.authors(rows, "orcid", keep_empty=True).select(F.col("payload_id").cast("int").alias("payload_id"), "position", "name")


@query(_values([("o", 7, "T", "2020", "10.1/a", "journal-article"), ("o", 8, "U", None, None, None), ("o", 9, None, "1990", "10.1/b", None)], "person_orcid, put_code, title, year, doi, type"))
def orcid_summaries(g):
    body = '{"group":[{"work-summary":[{"put-code":7,"type":"journal-article","title":{"title":{"value":"T"}},"publication-date":{"year":{"value":"2020"}},"external-ids":{"external-id":[{"external-id-type":"isbn","external-id-value":"1"},{"external-id-type":"DOI","external-id-value":"10.1/A"},{"external-id-type":"doi","external-id-value":"10.1/z"}]}},null]},{"work-summary":[{"put-code":8,"title":{"title":{"value":"U"}},"external-ids":null},{"put-code":9,"publication-date":{"year":{"value":"1990"}},"external-ids":{"external-id":[{"external-id-type":"doi","external-id-value":"10.1/B"}]}}]}]}'
    return providers.orcid_works(g.spark.createDataFrame([("o", body), ("p", "{}")], "person_orcid string, payload string")).withColumn("put_code", F.col("put_code").cast("int"))


@query(_values([("a", "Example University", "D", "R", "2001-02", None, True), ("a", "University Example Inst", None, None, "1999", "2000-01-31", False), ("b", "Uni Example", None, None, None, None, False), ("c", "Universität Example", None, None, "2010-03-04", None, True)], "person_orcid, org_name, department, role_title, start_date, end_date, is_current"))
def orcid_employments(g):
    one = '{"affiliation-group":[{"summaries":[{"employment-summary":{"organization":{"name":"Example University"},"department-name":"D","role-title":"R","start-date":{"year":{"value":"2001"},"month":{"value":"2"}}}},{"employment-summary":{"organization":{"name":"Other"}}}]}],"employment-summary":[{"organization":{"name":"University Example Inst"},"start-date":{"year":{"value":"1999"}},"end-date":{"year":{"value":"2000"},"month":{"value":"01"},"day":{"value":"31"}}}]}'
    two = '{"employment-summaries":{"organization":{"name":"Uni Example"},"start-date":{"year":{"value":"x"}}}}'
    three = '{"employment-summary":[{"organization":{"name":"Universität Example"},"start-date":{"year":{"value":"2010"},"month":{"value":"3"},"day":{"value":"4"}}}]}'
    return providers.employments(g.spark.createDataFrame([("a", one), ("b", two), ("c", three), ("d", None)], "person_orcid string, payload string"), ["example university"])


@query(_values([("a", "x@y.org;z@y.org"), ("b", "")], "person_orcid, emails"))
def verified_emails(g):
    body = '{"emails":{"email":[{"email":"x@y.org","verified":true,"visibility":"PUBLIC"},{"email":"n@y.org","verified":false,"visibility":"public"},{"email":"p@y.org","verified":true,"visibility":"limited"},{"email":"z@y.org","verified":true,"visibility":"public"}]}}'
    return providers.verified_emails(g.spark.createDataFrame([("a", body), ("b", "{}")], "person_orcid string, payload string")).withColumn("emails", F.array_join("emails", ";"))


@query("""SELECT w.pub_id, 'https://x/' || CASE WHEN w.pub_id % 3 = 0 THEN 'best' ELSE 'second' END AS pdf_url, CASE WHEN w.pub_id % 3 = 0 THEN CASE w.pub_id % 4 WHEN 0 THEN 'explicit_open_license' WHEN 1 THEN 'license_missing' WHEN 2 THEN 'source_terms_review' ELSE 'explicit_open_license' END ELSE 'license_missing' END AS rights_tier, CAST(x.n AS INT) AS member_count, x.ids AS member_ids
   FROM w JOIN (SELECT pub_id, count(*) AS n, string_agg(CAST(person_id AS VARCHAR), ',' ORDER BY person_id) AS ids FROM (SELECT DISTINCT a.pub_id, a.person_id FROM a JOIN p ON p.person_id = a.person_id WHERE p.person_kind = 'internal') y GROUP BY 1) x ON x.pub_id = w.pub_id WHERE w.pub_id % 5 NOT IN (0, 1) AND (w.pub_id % 3 = 0 OR w.pub_id % 7 <> 0)""", "wap")
def open_access(g):
    n = F.col("pub_id")
    licence = F.when(n % 4 == 0, '"CC-BY"').when(n % 4 == 1, '" "').when(n % 4 == 2, '"other-oa"').otherwise('"Public-Domain"')
    best = F.when(n % 3 == 0, F.concat(F.lit('{"pdf_url":"https://x/best","license":'), licence, F.lit("}"))).otherwise('{"pdf_url":" "}')
    more = F.when(n % 7 == 0, "null").otherwise('[{"pdf_url":null},{"pdf_url":"https://x/second"},{"pdf_url":"https://x/third"}]')
    body = F.concat(F.lit('{"openalex":{"id":"W","open_access":{"is_oa":'), F.when(n % 5 == 0, "false").when(n % 5 == 1, "null").otherwise("true"), F.lit('},"best_oa_location":'), best, F.lit(',"locations":'), more, F.lit("}}"))
    orcids = g.p.select("person_id", F.lit("0000-0002-1825-0097").alias("orcid"))
    found = providers.member_open_access(g.w.withColumn("payload", body), g.a.filter("person_id is not null"), g.p, orcids)
    return found.select("pub_id", "pdf_url", "rights_tier", "member_count", F.array_join(F.transform("member_person_ids", lambda x: x.cast("string")), ",").alias("member_ids"))


@query("""SELECT CAST(row_number() OVER (ORDER BY page, k) - 1 AS BIGINT) AS place, page || ':' || k AS item FROM (SELECT page, k FROM range(1, 7) a(page), range(1, 5) b(k) WHERE k <= 4 AND (page <> 3 OR k <= 2)) x ORDER BY 1 LIMIT 20""")
def result_pages(g):
    pages = g.spark.createDataFrame([(p, f"c{p if p < 7 else 2}", [f"{p}:{k}" for k in range(1, 5 if p != 3 else 3)] if p != 9 else []) for p in range(1, 12)], "page int, cursor string, items array<string>")
    return providers.landed_pages(pages, 20)


# ---- files, states, jobs

@query("""SELECT line, CASE WHEN o IS NULL THEN 'bad orcid' WHEN o = '0000-0002-1825-0098' THEN 'bad checksum' WHEN kind NOT IN ('internal', 'external') THEN 'bad kind' WHEN name = '' THEN 'no name' END AS error FROM (SELECT s_suppkey + 1 AS line, CASE s_suppkey % 3 WHEN 0 THEN '0000-0002-1825-0097' WHEN 1 THEN '0000-0002-1825-0098' END AS o, CASE s_suppkey % 4 WHEN 0 THEN 'internal' WHEN 1 THEN 'external' ELSE 'other' END AS kind, CASE WHEN s_suppkey % 12 = 9 THEN '' ELSE s_name END AS name FROM supplier) x""")
def roster_errors(g):
    n = F.col("s_suppkey")
    rows = g("supplier").select(n.alias("line"), F.when(n % 3 == 0, " https://orcid.org/0000-0002-1825-0097").when(n % 3 == 1, "0000-0002-1825-0098").otherwise("0000").alias("orcid"), F.when(n % 4 == 0, " Internal").when(n % 4 == 1, "EXTERNAL ").otherwise("other").alias("person_kind"), F.when(n % 12 == 9, "  ").otherwise(F.col("s_name")).alias("display_name"))
    return files.checked_roster(rows).select((F.col("line") + 1).alias("line"), "error")


@query("""SELECT min(place) AS place, orcid, arg_min(name, place) FILTER (WHERE name IS NOT NULL) AS display_name FROM (SELECT c_custkey AS place, '0000-0002-1825-' || CAST(1000 + c_custkey % 50 AS VARCHAR) AS orcid, CASE WHEN c_custkey % 100 >= 50 THEN c_name END AS name FROM customer WHERE c_custkey % 7 <> 0) x GROUP BY orcid""")
def refresh_batch(g):
    n = F.col("c_custkey")
    rows = g("customer").select(n.alias("place"), F.lit(" 12 ").alias("pub_id"), F.when(n % 7 == 0, "x").otherwise(F.concat(F.lit("http://orcid.org/0000-0002-1825-"), (F.lit(1000) + n % 50).cast("string"))).alias("paper_orcid"), F.when(n % 100 >= 50, F.concat(F.lit(" "), F.col("c_name"))).otherwise(" ").alias("display_name_at_pub"))
    return files.refresh_batch(rows)[0]


@query("""SELECT pub_id, year, title FROM (SELECT pub_id, year, title, row_number() OVER (ORDER BY year DESC NULLS LAST, lower(title) ASC NULLS LAST, pub_id) AS n FROM w) x WHERE n <= 50""", "w")
def export_rows(g):
    rows = g.w.withColumnRenamed("provenance", "source_of_truth").withColumn("internal_authors", F.lit(None).cast("string"))
    return files.export_order(rows).limit(50).select("pub_id", "year", "title")


@query("""SELECT count(*) AS n, CAST(max(h) AS BIGINT) AS hours FROM (SELECT date_diff('hour', TIMESTAMP '1998-08-01 00:00:00', TIMESTAMP '1998-08-02 12:00:00') AS h) x UNION ALL SELECT 0, 1000000000""")
def freshness(g):
    one = g.spark.createDataFrame([("1998-08-01 00:00:00",), ("1997-01-01 00:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("refreshed_at"))
    now = F.lit("1998-08-02 12:00:00").cast("timestamp")
    return files.hours_since(one, now).select(F.lit(1).cast("long").alias("n"), F.col("hours").cast("long").alias("hours")).unionAll(files.hours_since(one.limit(0), now).select(F.lit(0).cast("long"), F.col("hours").cast("long")))


@query("""SELECT coalesce(s.k, n.k) AS k, greatest(coalesce(s.last_attempt, ''), coalesce(n.at, '')) AS last_attempt, CASE WHEN n.k IS NOT NULL AND n.err IS NULL THEN greatest(coalesce(s.last_success, ''), n.at) ELSE s.last_success END AS last_success, CASE WHEN n.k IS NOT NULL THEN n.err ELSE s.last_error END AS last_error FROM s FULL JOIN (SELECT * FROM n WHERE run = 2 OR k % 2 = 1) n ON n.k = s.k""",
       s="SELECT CAST(p_partkey AS BIGINT) AS k, '2024-01-0' || CAST(p_partkey % 9 + 1 AS STRING) AS last_attempt, CASE WHEN p_partkey % 4 <> 0 THEN '2024-01-01' END AS last_success, CASE WHEN p_partkey % 5 = 0 THEN 'old' END AS last_error FROM {part} WHERE p_partkey % 3 <> 0",
       n="SELECT CAST(p_partkey AS BIGINT) AS k, run, '2024-02-0' || CAST(run AS STRING) AS at, CASE WHEN (p_partkey + run) % 3 = 0 THEN 'boom' END AS err FROM {part} CROSS JOIN (SELECT 1 AS run UNION ALL SELECT 2) r WHERE p_partkey % 2 = 0 OR run = 1")
def advanced_states(g, s, n):
    got = refresh.advance(s, n.select("k", "at", F.col("err").alias("error")), "k")
    return got.withColumn("last_attempt", F.coalesce("last_attempt", F.lit("")))


@query("""SELECT k, v, CASE WHEN k % 2 = 0 THEN 'old' ELSE 'now' END AS updated_at FROM (SELECT CAST(p_partkey AS BIGINT) AS k, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'x' END AS v FROM part) x""")
def stamped_rows(g):
    old = g("part").filter("p_partkey % 4 <> 1").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_name").alias("v"), F.lit("old").alias("updated_at"))
    new = g("part").select(F.col("p_partkey").cast("long").alias("k"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("x").alias("v"), F.lit(None).cast("string").alias("updated_at"))
    return refresh.stamped(old, new, "k", F.lit("now"))


@query("""SELECT CAST(l_suppkey AS BIGINT) AS person, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS works FROM (SELECT CASE WHEN l_suppkey BETWEEN 2 AND 4 THEN 5 ELSE l_suppkey END AS l_suppkey, l_partkey FROM lineitem WHERE l_suppkey > 1 AND l_partkey % 8 = l_suppkey % 8) x GROUP BY 1""")
def merged_people(g):
    rows = g("lineitem").filter("l_suppkey > 1 and l_partkey % 8 = l_suppkey % 8").select(F.col("l_partkey").alias("pub_id"), F.monotonically_increasing_id().alias("author_position"), F.col("l_suppkey").cast("long").alias("person_id"))
    merges = g.spark.createDataFrame([(2, 3), (3, 4), (4, 5)], "loser long, winner long")
    got = people.merge_people({"authorships": rows}, merges)["authorships"]
    return got.groupBy(F.col("person_id").alias("person")).agg(r.ordered_text(F.col("pub_id").cast("string"), ",").alias("works"))


# ---- SQL functions, scopes, landed payloads

@query(f"SELECT pub_id, {_doi('doi')} AS dk, {_title('title')} AS tk, sha256(lower(title || '|' || venue)) AS nk FROM w", "w")
def sql_functions(g):
    registered.register(g.spark)
    return g.w.selectExpr("pub_id", "qs_doi_key(doi) AS dk", "qs_title_key(title) AS tk", "qs_name_key(title, venue) AS nk")


@query("SELECT pub_id, place, token FROM (SELECT pub_id, CAST(i AS INT) AS place, lower(trim(string_split(provenance, '+')[i])) AS token FROM (SELECT pub_id, provenance, unnest(range(1, len(string_split(provenance, '+')) + 1)) AS i FROM w WHERE provenance IS NOT NULL) x) y WHERE token <> ''", "w")
def sql_table_function(g):
    registered.register(g.spark)
    return g.spark.sql("SELECT w.pub_id, t.place, t.token FROM {w} AS w, LATERAL qs_tokens(w.provenance) AS t", w=g.w)


@query("""SELECT CASE WHEN n = 0 THEN -1 ELSE 1 END AS kind, doi_key, mode, active FROM (SELECT 1 AS n, '10.1234/s' || pub_id AS doi_key, 'include' AS mode, pub_id % 3 <> 0 AND NOT (pub_id % 4 = 0) AS active FROM s UNION ALL SELECT 1, '10.1234/s' || pub_id, 'include', TRUE FROM s WHERE pub_id % 4 = 0 UNION ALL SELECT 0, '10.1234/s' || pub_id, 'exclude', TRUE FROM s WHERE pub_id % 4 = 0) x""", s=STORED)
def scope_writes(g, s):
    n, none = F.col("pub_id"), F.lit(None).cast("string")
    rows = s.select(n.alias("decision_id"), F.lit("global").alias("scope_type"), F.lit(None).cast("long").alias("person_id"), F.lit("include").alias("mode"), F.col("doi").alias("doi_key"), none.alias("title_key"), F.lit(None).cast("int").alias("year"), none.alias("note"), F.lit("old").alias("updated_at"), (n % 3 != 0).alias("active"))
    own = s.filter("pub_id % 4 = 0").select((n + 1_000_000).alias("decision_id"), F.lit("person").alias("scope_type"), F.lit(5).cast("long").alias("person_id"), F.lit("include").alias("mode"), F.col("doi").alias("doi_key"), none.alias("title_key"), F.lit(None).cast("int").alias("year"), none.alias("note"), F.lit("old").alias("updated_at"), F.lit(True).alias("active"))
    asked = s.filter("pub_id % 4 = 0").select("pub_id", F.lit("global").alias("scope_type"), F.lit(None).cast("long").alias("person_id"), F.lit("exclude").alias("mode"), none.alias("note"))
    got = curation.decide_scope(rows.unionByName(own), asked, s, F.lit("now"))
    return got.select(F.when(F.col("mode") == "exclude", -1).otherwise(1).alias("kind"), "doi_key", "mode", "active")


@query(_values([("10.1234/c", "T", 2022, "J", "crossref+openalex-affiliation", True, True), ("10.1234/o", "T", 2020, "J", "openalex-affiliation", False, True)], "doi, title, year, venue, provenance, is_preprint, has_openalex"))
def landed_in_stages(g):
    """A work from one provider, then with more from another, then both once more: the same rows."""
    empty = g.spark.createDataFrame([], "pub_id long, doi string, title string, year int, venue string, provenance string, payload string, is_preprint boolean")
    second = '{"doi":"10.1234/C","title":"","type":"article","publication_year":null}'
    alex = g.spark.createDataFrame([(1, second), (2, OPENALEX)], "payload_id long, payload string")
    now = empty
    for _ in range(2):
        now = works.ingest_payloads(works.ingest_payloads(now, _payloads(g, "crossref"), "crossref"), alex, "openalex", "openalex-affiliation")
    return now.withColumn("is_preprint", F.col("doi") == "10.1234/c").select("doi", "title", "year", "venue", "provenance", "is_preprint", payloads.has_key(F.col("payload"), "openalex").alias("has_openalex"))


@query(_values([("10.1/a", 1, 7, True), ("10.1/a", 2, 8, False), ("10.1/b", 1, 7, True)], "doi, author_position, person_id, is_internal"))
def orcid_ingest(g):
    body = lambda *dois: json.dumps({"group": [{"work-summary": [{"put-code": 1, "title": {"title": {"value": "T"}}, "external-ids": {"external-id": [{"external-id-type": "doi", "external-id-value": d}]}}]} for d in dois]})
    records = g.spark.createDataFrame([("0000-0002-1825-0097", body("10.1000/A", "10.1000/b", "no doi")), ("0000-0002-1694-233X", body("10.1000/A"))], "person_orcid string, payload string")
    persons = g.spark.createDataFrame([(7, "Ann Lee", "0000-0002-1825-0097", "internal"), (8, "Bob Ray", "0000-0002-1694-233X", "external")], "person_id long, display_name string, orcid string, person_kind string")
    aliases = g.spark.createDataFrame([], "person_id long, alias_name string")
    ws = g.spark.createDataFrame([], "pub_id long, doi string, title string, year int, venue string, provenance string, payload string, is_preprint boolean")
    a = g.spark.createDataFrame([], "pub_id long, author_position int, person_id long, author_name string, author_orcid string, paper_orcid string, affiliations array<string>, paper_affiliation string, raw_author string, is_corresponding boolean, is_internal boolean, order_tag string, equal_contrib_tag string")
    for _ in range(2):
        ws, a = works.ingest_orcid(ws, a, records, persons, aliases)
    return a.join(ws.select("pub_id", "doi"), "pub_id").select(F.replace("doi", F.lit("10.1000"), F.lit("10.1")).alias("doi"), "author_position", F.col("person_id").cast("int").alias("person_id"), "is_internal")
