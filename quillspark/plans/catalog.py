"""Queries over the test tables, one for each operator shape, with SQL twins for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import dates, payloads, text
from quillspark.operators import relational as r
from quillspark.plans import canonical, casebook
from quillspark.session import table
from quillspark.streaming.refresh import due_items

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):  # noqa: ANN202
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT least(a.l_partkey, b.l_partkey) AS u, greatest(a.l_partkey, b.l_partkey) AS v, count(*) AS joint,
  CAST(min(year(o_orderdate)) AS INT) AS first_year, CAST(max(year(o_orderdate)) AS INT) AS last_year
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey JOIN orders ON o_orderkey = a.l_orderkey GROUP BY 1, 2""")
def pair_edges(t):
    pairs = r.pairs_within(t("lineitem"), "l_orderkey", "l_partkey").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("y")), "l_orderkey")
    return pairs.groupBy(F.col("low").alias("u"), F.col("high").alias("v")).agg(F.count(F.lit(1)).alias("joint"), F.min("y").alias("first_year"), F.max("y").alias("last_year"))


@query("""SELECT c_nationkey, (array_agg(c_custkey ORDER BY c_mktsegment <> 'BUILDING', c_acctbal DESC, c_custkey))[1] AS winner, count(*) AS members FROM customer GROUP BY c_nationkey""")
def canonical_winner(t):
    return t("customer").groupBy("c_nationkey").agg(r.first_by(F.col("c_custkey"), (F.col("c_mktsegment") != "BUILDING").cast("int"), -F.col("c_acctbal"), F.col("c_custkey")).alias("winner"), F.count(F.lit(1)).alias("members"))


@query(r"""SELECT md5(lower(regexp_replace(trim(text, ' '), '[ \t\n\r\f\v]+', ' ', 'g'))) AS k, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1""")
def dedup_groups(t):
    return t("documents").groupBy(F.md5(text.title_key(F.col("text"))).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("""SELECT DISTINCT ON (l_partkey) l_partkey, l_orderkey, l_linenumber, l_shipdate FROM lineitem ORDER BY l_partkey, l_shipdate DESC, l_orderkey, l_linenumber""")
def distinct_on_latest(t):
    return r.top_per_group(t("lineitem"), ["l_partkey"], [F.col("l_shipdate").desc_nulls_first(), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate")


@query("""SELECT p_brand, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS types FROM part GROUP BY p_brand""")
def ordered_string_agg(t):
    return t("part").groupBy("p_brand").agg(r.ordered_text(F.col("p_type"), "; ").alias("types"))


@query("""SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS parts FROM lineitem GROUP BY l_orderkey""")
def ordered_array_set(t):
    return t("lineitem").groupBy("l_orderkey").agg(r.ordered_set(F.col("l_partkey")).alias("p")).select("l_orderkey", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("parts"))


@query("""SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY l_orderkey""")
def ordered_objects(t):
    rows = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    return rows.select("l_orderkey", F.array_join(F.transform("x", lambda s: F.concat_ws(":", s["l_linenumber"], s["l_partkey"])), ",").alias("lines"))


@query("""SELECT p_type, CAST(length(p_type) - length(replace(p_type, ' ', '')) + 1 AS INT) AS n_tokens, count(*) AS parts FROM part GROUP BY p_type""")
def token_count(t):
    return t("part").groupBy("p_type").agg(F.count(F.lit(1)).alias("parts")).select("p_type", F.size(F.split("p_type", " ")).alias("n_tokens"), "parts")


@query("""SELECT family, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_type), ' ')) AS family FROM part) GROUP BY family""")
def family_counts(t):
    f = payloads.families(F.replace("p_type", F.lit(" "), F.lit("+")))
    return t("part").select(F.explode(f).alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s_suppkey, sha256(lower(s_name || '|' || CAST(s_nationkey AS VARCHAR))) AS k FROM supplier""")
def hash_key(t):
    return t("supplier").select("s_suppkey", F.sha2(F.lower(F.concat("s_name", F.lit("|"), F.col("s_nationkey").cast("string"))), 256).alias("k"))


@query(r"""SELECT page_id, nullif(lower(regexp_replace(regexp_replace(trim(coalesce(url, ''), ' '), '^doi:\s*', '', 'i'), '^https?://(dx\.)?doi\.org/', '', 'i')), '') AS k FROM pages""")
def doi_key(t):
    return t("pages").select("page_id", text.doi_key(F.col("url")).alias("k"))


@query(r"""SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g') AS k FROM pages""")
def url_words(t):
    return t("pages").select("page_id", F.regexp_replace(F.lower("url"), "[^a-z0-9]+", " ").alias("k"))


@query("""SELECT d.doc_id, bool_or(contains(lower(d.text), lower(n_name))) AS attributed FROM documents d CROSS JOIN nation GROUP BY d.doc_id""")
def substring_attribution(t):
    works = t("documents").select("doc_id", F.col("text").alias("payload"))
    rules = t("nation").select(F.col("n_name").alias("pattern"), F.lit(True).alias("active"))
    return canonical.attribution(works, rules).select("doc_id", "attributed")


@query("""SELECT c_custkey, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey OR (c_custkey % 25) = n_regionkey * 5""")
def or_key_match(t):
    return r.or_equi_join(t("customer"), t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), (F.col("c_custkey") % 25) == F.col("n_regionkey") * 5).select("c_custkey", "n_nationkey")


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) o ON o_custkey = c_custkey AND rn = 1""")
def lateral_top1(t):
    top = r.top_per_group(t("orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return t("customer").select("c_custkey").join(top, "c_custkey", "left")


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')""")
def anti_join(t):
    return t("customer").join(t("orders").filter("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def semi_join(t):
    return t("orders").join(t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("""SELECT l_partkey FROM lineitem WHERE l_suppkey = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey = 2""")
def shared_keys(t):
    return r.shared_keys(t("lineitem"), "l_suppkey", "l_partkey", 1, 2)


@query("""SELECT c_name AS name FROM customer UNION SELECT s_name FROM supplier""")
def union_distinct(t):
    return t("customer").select(F.col("c_name").alias("name")).union(t("supplier").select("s_name")).distinct()


@query("""SELECT 'customer' AS kind, c_custkey AS id, CAST(c_nationkey AS INT) AS nation, CAST(NULL AS VARCHAR) AS note FROM customer UNION ALL SELECT 'supplier', s_suppkey, CAST(s_nationkey AS INT), 'vendor' FROM supplier""")
def union_all_constants(t):
    a = t("customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("int").alias("nation"), F.lit(None).cast("string").alias("note"))
    return a.unionByName(t("supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("int").alias("nation"), F.lit("vendor").alias("note")))


@query("""SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_attempt FROM orders GROUP BY 1) s ON o_custkey = c_custkey WHERE last_attempt IS NULL OR last_attempt < TIMESTAMP '1997-01-01' - INTERVAL 30 DAY ORDER BY last_attempt ASC NULLS FIRST, c_custkey LIMIT 50""")
def due_topk(t):
    state = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_attempt"))
    return due_items(t("customer").select("c_custkey"), state, "c_custkey", F.lit("1997-01-01").cast("timestamp_ntz"), 30, 50).select("c_custkey")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 101""")
def keyset_page(t):
    return r.keyset_page(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 100)


@query("""SELECT l_orderkey, l_linenumber, CAST(make_date(CAST(year(l_shipdate) AS INT), CAST(least(greatest(l_linenumber * 3, 1), 12) AS INT), 1) + CAST(least(CAST(l_quantity AS INT), day(last_day(make_date(CAST(year(l_shipdate) AS INT), CAST(least(greatest(l_linenumber * 3, 1), 12) AS INT), 1)))) - 1 AS INT) AS DATE) AS d FROM lineitem""")
def date_clamp(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", dates.clamped_date(F.year("l_shipdate"), F.col("l_linenumber").cast("int") * 3, F.col("l_quantity").cast("int")).alias("d"))


@query("""SELECT doc_id, CAST(k AS INT) AS k, word FROM (SELECT doc_id, unnest(string_split(source, 'r')) AS word, generate_subscripts(string_split(source, 'r'), 1) AS k FROM documents)""")
def unnest_ordinality(t):
    return t("documents").select("doc_id", F.posexplode(F.split("source", "r")).alias("p", "word")).select("doc_id", (F.col("p") + 1).alias("k"), "word")


@query("""SELECT c_custkey, CASE WHEN n IS NULL THEN 'none' WHEN last < hi - INTERVAL 365 DAY THEN 'stale' WHEN n >= 15 THEN 'full' WHEN total > 1000000 THEN 'large' ELSE 'some' END AS status
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY 1) o ON o_custkey = c_custkey CROSS JOIN (SELECT max(o_orderdate) AS hi FROM orders)""")
def coverage_status(t):
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    window = t("orders").agg(F.max("o_orderdate").alias("hi"))  # one row
    rows = t("customer").join(o, "c_custkey", "left").crossJoin(F.broadcast(window))
    status = F.when(F.col("n").isNull(), "none").when(F.col("last") < F.col("hi") - F.expr("interval 365 days"), "stale").when(F.col("n") >= 15, "full").when(F.col("total") > 1000000, "large").otherwise("some")
    return rows.select("c_custkey", status.alias("status"))


@query("""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL THEN greatest(a.o_totalprice, b.o_totalprice) ELSE coalesce(a.o_totalprice, b.o_totalprice) END AS o_totalprice, coalesce(b.o_orderstatus, a.o_orderstatus) AS o_orderstatus, coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority
  FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey, o_totalprice + 100 AS o_totalprice, CASE WHEN o_orderkey % 5 <> 0 THEN 'X' END AS o_orderstatus, 'new' AS o_orderpriority FROM orders WHERE o_orderkey % 2 = 0) b ON a.o_orderkey = b.o_orderkey""")
def upsert_policy(t):
    o = t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    delta = o.filter("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_totalprice") + 100).alias("o_totalprice"), F.when(F.col("o_orderkey") % 5 != 0, "X").alias("o_orderstatus"), F.lit("new").alias("o_orderpriority"))
    return r.upsert(o.filter("o_orderkey % 3 <> 0"), delta, ["o_orderkey"], {"o_totalprice": "greatest", "o_orderpriority": "coalesce_old"})


@query("""SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'drop' WHEN l.quality = 1 THEN 'keep' WHEN l.doc_id IS NULL THEN 'unknown' ELSE 'poor' END AS verdict FROM documents d LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY toxic DESC, quality) AS rn FROM labels) WHERE rn = 1) l ON l.doc_id = d.doc_id""")
def curated_overlay(t):
    best = r.top_per_group(t("labels"), ["doc_id"], [F.col("toxic").desc_nulls_last(), F.col("quality").asc_nulls_last()]).withColumn("rated", F.lit(True))
    verdict = F.when(F.col("toxic") == 1, "drop").when(F.col("quality") == 1, "keep").when(F.col("rated").isNull(), "unknown").otherwise("poor")
    return t("documents").join(best, "doc_id", "left").select("doc_id", verdict.alias("verdict"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type""")
def count_by_source(t):
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F' AND (o_orderpriority ILIKE '%urgent%' OR regexp_matches(o_orderpriority, '^[23]-'))""")
def null_safe_filters(t):
    return t("orders").filter("o_orderstatus is distinct from 'F' and (o_orderpriority ilike '%urgent%' or o_orderpriority rlike '^[23]-')").select("o_orderkey", "o_orderstatus")


@query("""SELECT c_nationkey, c_mktsegment, c_custkey, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INT) AS rn FROM customer) WHERE rn <= 3""")
def ranked_decisions(t):
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return t("customer").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("c_nationkey", "c_mktsegment", "c_custkey", "rn")


@query("""SELECT 'total_canonical_publications' AS metric, count(*) AS value FROM part UNION ALL SELECT 'publications_with_family=' || w, count(*) FROM (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_type), ' ')) AS w FROM part) GROUP BY w
  UNION ALL SELECT 'single_source_publications', count(*) FILTER (WHERE n = 1) FROM (SELECT len(list_distinct(string_split(lower(p_type), ' '))) AS n FROM part) UNION ALL SELECT 'publications_with_n_families=' || n, count(*) FROM (SELECT len(list_distinct(string_split(lower(p_type), ' '))) AS n FROM part) GROUP BY n""")
def coverage_summary(t):
    return canonical.coverage_summary(t("part").select(F.col("p_partkey").alias("pub_id"), F.replace("p_type", F.lit(" "), F.lit("+")).alias("provenance")))


@query("""SELECT o_orderkey, CASE WHEN n = 1 THEN 'single' WHEN l_linenumber = 1 THEN 'first' WHEN l_linenumber = n THEN 'last' ELSE 'middle' END AS tag, l_linenumber FROM orders JOIN (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) ON l_orderkey = o_orderkey""")
def order_tag(t):
    from pyspark.sql import Window

    lines = t("lineitem").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")))
    return t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", text.name_order_tag(F.col("l_linenumber"), F.col("n")).alias("tag"), "l_linenumber")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS v, CAST(contains(props, '"k"') AS BOOLEAN) AS has_k FROM events""")
def payload_path(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").alias("v"), payloads.has_key(F.col("props"), "k").alias("has_k"))


@query("""SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS turns FROM conversations GROUP BY conv_id""")
def extract_turns(t):
    rows = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x"), F.count(F.lit(1)).alias("turns"))
    return rows.select("conv_id", F.array_join(F.transform("x", lambda s: s["role"]), ">").alias("roles"), "turns")


@query("""SELECT k.* FROM (SELECT p_name AS title_key, min(p_partkey) AS canonical_id, count(*) AS group_size FROM part GROUP BY p_name) k""")
def group_sizes(t):
    return t("part").groupBy(F.col("p_name").alias("title_key")).agg(F.min("p_partkey").alias("canonical_id"), F.count(F.lit(1)).alias("group_size"))


@query("""SELECT count(*) FILTER (WHERE o_totalprice IS DISTINCT FROM CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END) AS o_totalprice, count(*) FILTER (WHERE o_orderkey % 11 = 0) AS o_orderstatus FROM orders""")
def change_counters(t):
    o = t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.when(F.col("o_orderkey") % 11 == 0, F.lit("?")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return r.changed(o, new, ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


@query("""SELECT p_partkey, p_name FROM part WHERE p_partkey IN (7, 3, 11, 5)""")
def by_list(t):
    return r.by_list(t("part").select("p_partkey", "p_name"), "p_partkey", [7, 3, 11, 3, 5])


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS tier, least(c_acctbal, 100) AS lo, greatest(c_acctbal, NULL) AS hi FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey""")
def tiered(t):
    tier = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").otherwise("high")
    return t("customer").select("c_custkey", tier.alias("tier"), F.least("c_acctbal", F.lit(100.0)).alias("lo"), F.greatest("c_acctbal", F.lit(None).cast("double")).alias("hi")).orderBy(F.col("hi").desc_nulls_last(), "c_custkey")


@query("""SELECT c_name, s_name, CAST(26 AS DOUBLE) / 36 AS similarity FROM customer JOIN supplier ON split_part(c_name, '#', 2) = split_part(s_name, '#', 2)""")
def name_similarity(t):
    """Names are compared only where their last words agree, so the join is on that word. ("Customer n" and "Supplier n" share 13 of 18 signs in order.)"""
    plain = lambda c: F.replace(c, F.lit("#"), F.lit(" "))
    a, b = t("customer").withColumn("last", F.split_part("c_name", F.lit("#"), F.lit(2))), t("supplier").withColumn("last", F.split_part("s_name", F.lit("#"), F.lit(2)))
    return a.join(b, "last").select("c_name", "s_name", text.name_similarity(plain("c_name"), plain("s_name")).alias("similarity"))


@query()
def canonical_list(t):
    works = t("documents").select(F.col("doc_id").alias("pub_id"), F.lit(None).cast("string").alias("doi"), F.col("text").alias("title"), F.lit(2020).alias("year"), F.lit(None).cast("string").alias("venue"), F.col("source").alias("provenance"), F.lit("{}").alias("payload"), F.lit(None).cast("boolean").alias("is_preprint"), F.lit(True).alias("attributed"))
    spark = works.sparkSession
    decisions = spark.createDataFrame([], "decision_id long, mode string, doi string, title string, year int, winner_doi string, winner_title string, winner_year int, updated_at timestamp, active boolean")
    overrides = spark.createDataFrame([], "pub_id long, mode string, winner_pub_id long")
    return canonical.memberships(works, decisions, overrides).select("pub_id", "canonical_pub_id", "group_size", "is_canonical")


SQL["canonical_list"] = r"""SELECT doc_id AS pub_id, min(doc_id) OVER w AS canonical_pub_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS is_canonical FROM documents
  WINDOW w AS (PARTITION BY lower(regexp_replace(trim(text, ' '), '[ \t\n\r\f\v]+', ' ', 'g')))"""


#: The queries over derived inputs.
QUERIES |= casebook.QUERIES
SQL |= casebook.SQL
