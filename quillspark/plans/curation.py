"""Curators' writes: durable decisions, overrides, review queue and correction log, and their backup. Each returns the new rows of its table."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators.relational import top_per_group, upsert
from quillspark.plans.works import numbered_after

DECISION = ["decision_id", "mode", "doi_key", "title_key", "year", "winner_doi_key", "winner_title_key", "winner_year", "note", "created_by", "updated_at", "active"]


def _keys(works: DataFrame, prefix: str) -> DataFrame:
    """pub_id and the durable keys of works: strict DOI, title, year; works with neither DOI nor title have none."""
    rows = works.select(F.col("pub_id").alias(f"{prefix}pub_id"), text.normalize_doi(F.col("doi")).alias(f"{prefix}doi_key"), text.clean_title(F.col("title")).alias(f"{prefix}title_key"), F.col("year").alias(f"{prefix}year"))
    return rows.filter(F.coalesce(f"{prefix}doi_key", f"{prefix}title_key").isNotNull())


def decide(decisions: DataFrame, requests: DataFrame, works: DataFrame, now: Column) -> DataFrame:
    """Decisions after requests (mode, pub_id, winner_pub_id, note, created_by).

    A decision keeps the works' keys, not their ids. Active decisions about the same work (its DOI, or without one its title and
    year) are switched off first. Of several requests about one work the last by id of the winner stands.
    """
    subjects, winners = _keys(works, ""), _keys(works, "winner_")
    rows = requests.join(subjects, "pub_id").join(winners, "winner_pub_id", "left").filter("mode = 'keep_separate' or winner_doi_key is not null or winner_title_key is not null")
    rows = top_per_group(rows.withColumn("k", F.coalesce("doi_key", F.concat(F.lit("t:"), "title_key"))), ["k"], [F.col("winner_pub_id").desc_nulls_last(), F.col("mode")])
    fresh = numbered_after(rows, decisions, "decision_id", [F.col("pub_id")]).withColumn("updated_at", now).withColumn("active", F.lit(True)).select(*DECISION)
    about = rows.select(F.col("doi_key").alias("r_doi"), F.col("title_key").alias("r_title"), F.col("year").alias("r_year")).distinct()
    active = decisions.filter("active")
    by_doi = active.join(about.filter("r_doi is not null"), F.col("doi_key") == F.col("r_doi")).select("decision_id")
    same_year = F.col("year").isNull() | (F.col("year") == F.col("r_year"))
    by_title = active.join(about.filter("r_doi is null"), (F.col("title_key") == F.col("r_title")) & same_year).select("decision_id")
    off = by_doi.unionByName(by_title).distinct().withColumn("off", F.lit(True))
    kept = decisions.join(off, "decision_id", "left").withColumn("updated_at", F.when(F.col("off"), now).otherwise(F.col("updated_at"))).withColumn("active", F.col("active") & F.col("off").isNull())
    return kept.select(*DECISION).unionByName(fresh)


def cleared(decisions: DataFrame, ids: list[int], now: Column) -> DataFrame:
    """Decisions with the listed ones switched off."""
    hit = F.col("active") & F.col("decision_id").isin(ids)
    return decisions.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).withColumn("active", F.col("active") & ~F.coalesce(hit, F.lit(False)))


def decisions_from_overrides(decisions: DataFrame, overrides: DataFrame, works: DataFrame, now: Column) -> DataFrame:
    """Durable decisions for overrides by id (pub_id, mode, winner_pub_id) about which no active decision speaks yet."""
    known = decisions.filter("active").select(F.coalesce("doi_key", F.concat(F.lit("t:"), "title_key")).alias("k")).distinct()
    wanted = overrides.join(_keys(works, ""), "pub_id").withColumn("k", F.coalesce("doi_key", F.concat(F.lit("t:"), "title_key"))).join(known, "k", "left_anti")
    return decide(decisions, wanted.select("mode", "pub_id", "winner_pub_id", F.lit("from override").alias("note"), F.lit("backfill").alias("created_by")), works, now)


def described(decisions: DataFrame, works: DataFrame) -> DataFrame:
    """Active decisions with the work that each is about now (least id of its key) and, for merges, its winner; either may be gone."""
    keyed = _keys(works, "w_")

    def resolved(doi: str, title: str, year: str, name: str) -> DataFrame:
        rows = decisions.filter("active").select("decision_id", F.col(doi).alias("d"), F.col(title).alias("t"), F.col(year).alias("y"))
        first = rows.filter("d is not null").join(keyed, F.col("d") == F.col("w_doi_key"))
        other = rows.filter("d is null").join(keyed, (F.col("t") == F.col("w_title_key")) & (F.col("y").isNull() | (F.col("y") == F.col("w_year"))))
        return first.unionByName(other).groupBy("decision_id").agg(F.min("w_pub_id").alias(name))

    rows = decisions.filter("active").join(resolved("doi_key", "title_key", "year", "pub_id"), "decision_id", "left").join(resolved("winner_doi_key", "winner_title_key", "winner_year", "winner_pub_id"), "decision_id", "left")
    return rows.withColumn("winner_pub_id", F.when(F.col("mode") == "merge_to", F.col("winner_pub_id"))).select("decision_id", "mode", "pub_id", "winner_pub_id", "note")


def families(members: DataFrame, works: DataFrame) -> DataFrame:
    """Groups of more than one work: canonical_pub_id, n, and the members as ordered JSON (canonical first, then by id)."""
    rows = members.filter("group_size > 1").select("pub_id", "canonical_pub_id", "is_canonical").join(works.select("pub_id", "doi", "title", "year"), "pub_id")
    entry = F.struct((~F.col("is_canonical")).alias("o"), "pub_id", F.struct("pub_id", "doi", "title", "year", "is_canonical").alias("m"))
    got = rows.groupBy("canonical_pub_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(entry)).alias("m"))
    return got.select("canonical_pub_id", "n", F.to_json(F.transform("m", lambda x: x["m"])).alias("members"))


def person_families(members: DataFrame, works: DataFrame, authorships: DataFrame, person_id: int) -> DataFrame:
    """:func:`families` in which one person has a work."""
    own = authorships.filter(F.col("person_id") == person_id).select("pub_id").join(members, "pub_id").select("canonical_pub_id").distinct()
    return families(members, works).join(own, "canonical_pub_id", "left_semi")


OVERRIDE_KEY = ["pub_id", "author_position", "author_name", "author_orcid"]


def override_authors(overrides: DataFrame, requests: DataFrame) -> DataFrame:
    """Authorship overrides after requests, by their null-safe selector (work, position, name, ORCID; blank counts as none, case is ignored); the newest request stands."""
    tidy = lambda df: df.withColumn("author_name", F.nullif(F.lower(F.btrim("author_name")), F.lit(""))).withColumn("author_orcid", F.nullif(F.upper(F.btrim("author_orcid")), F.lit("")))
    new = top_per_group(tidy(requests), OVERRIDE_KEY, [F.col("updated_at").desc_nulls_last(), F.col("mode")])
    return upsert(tidy(overrides), new.select(*overrides.columns), OVERRIDE_KEY, {"mode": "new", "person_id": "new", "updated_at": "new"})


def log_correction(log: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """The correction log with new entries (action, pub_id, note, created_by) appended; nothing is ever changed in it."""
    rows = numbered_after(entries, log, "log_id", [F.col("pub_id"), F.col("action")]).withColumn("created_at", now)
    return log.unionByName(rows.select(*log.columns))


def enqueue(queue: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """The review queue with new entries (review_type, pub_id, status, note): the status says when it counts as approved and applied; an open entry of the kind is not repeated."""
    open_ = queue.filter("status in ('pending', 'approved')").select("review_type", "pub_id")
    rows = numbered_after(entries.join(open_, ["review_type", "pub_id"], "left_anti"), queue, "queue_id", [F.col("review_type"), F.col("pub_id")])
    rows = rows.withColumn("approved_at", F.when(F.col("status").isin("approved", "applied"), now)).withColumn("applied_at", F.when(F.col("status") == "applied", now))
    return queue.unionByName(rows.select(*queue.columns))


VERSION = 1


def exported(tables: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
    """For each table (rows, order) its rows as ordered JSON lines, with the version of the format in each."""
    return {name: df.orderBy(*order).select(F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit(name).alias("table"), F.struct("*").alias("row"))).alias("value")) for name, (df, order) in tables.items()}


def imported(spark: SparkSession, lines: DataFrame, name: str, table: DataFrame, key: list[str]) -> DataFrame:
    """A table after the import of its exported lines (value): columns that the table doesn't have are left out, keys that are there are overwritten."""
    wrong = lines.select(F.get_json_object("value", "$.version").alias("v")).filter(f"v is null or v <> '{VERSION}'")
    if not wrong.isEmpty():
        raise ValueError("unsupported version of the curation backup")
    rows = lines.filter(F.get_json_object("value", "$.table") == name).select(F.from_json(F.get_json_object("value", "$.row"), table.schema).alias("r")).select("r.*")
    return upsert(table, rows, key, {c: "new" for c in table.columns if c not in key})


def page(rows: list[dict], limit: int, key: str = "pub_id") -> str:
    """The JSON envelope of a page that was read with one row more than its limit."""
    items = rows[:limit]
    return json.dumps({"items": items, "limit": limit, "next_after": items[-1][key] if len(rows) > limit else None})


SCOPE = ["decision_id", "scope_type", "person_id", "mode", "doi_key", "title_key", "year", "note", "updated_at", "active"]


def decide_scope(scopes: DataFrame, requests: DataFrame, works: DataFrame, now: Column) -> DataFrame:
    """Scope decisions after requests (pub_id, scope_type, person_id, mode, note); the active ones of the same scope, person and work are switched off."""
    rows = requests.join(_keys(works, ""), "pub_id").withColumn("k", F.coalesce("doi_key", F.concat(F.lit("t:"), "title_key")))
    rows = top_per_group(rows.withColumn("who", F.coalesce("person_id", F.lit(0))), ["k", "scope_type", "who"], [F.col("pub_id").desc(), F.col("mode")])
    fresh = numbered_after(rows, scopes, "decision_id", [F.col("pub_id"), F.col("scope_type"), F.col("who")]).withColumn("updated_at", now).withColumn("active", F.lit(True)).select(*SCOPE)
    about = rows.select("k", "scope_type", "who", F.lit(True).alias("off")).distinct()
    kept = scopes.withColumn("k", F.coalesce("doi_key", F.concat(F.lit("t:"), "title_key"))).withColumn("who", F.coalesce("person_id", F.lit(0))).join(about, ["k", "scope_type", "who"], "left")
    hit = F.col("off").isNotNull() & F.col("active")
    kept = kept.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).withColumn("active", F.col("active") & F.col("off").isNull())
    return kept.select(*SCOPE).unionByName(fresh)
