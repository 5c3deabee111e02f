"""Writing works and authorships: upserts by key, duplicate merges, what to refresh next, and ingests of landed payloads.

Every writer takes the stored rows and returns the new ones, so a dry run is the same call without saving its result.

* ``works``: pub_id, doi, title, year, venue, provenance, payload, is_preprint
* ``authorships``: pub_id, author_position, person_id, author_name, author_orcid, paper_orcid, affiliations, paper_affiliation,
  is_corresponding, is_internal, order_tag, equal_contrib_tag, raw_author
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.durable import settled
from quillspark.functions import payloads, text
from quillspark.operators.relational import first_by, top_per_group
from quillspark.plans import canonical, people
from quillspark.sources import providers

WORK = ["pub_id", "doi", "title", "year", "venue", "provenance", "payload", "is_preprint"]


def _said(x: Column) -> Column:
    """Text that says something, trimmed, else null."""
    y = F.btrim(x)
    return F.when(y != "", y)


def numbered_after(new: DataFrame, old: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``new`` with ids that follow the highest of ``old``.

    Ids come without a global sort: from counts by hash bucket (a fixed number of rows meets in one task), then the order inside a bucket.
    """
    buckets = 4096
    spread = new.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = spread.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    top = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    placed = spread.join(F.broadcast(starts), "__bucket").crossJoin(F.broadcast(top))
    number = F.col("__top") + F.col("__start") + F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    return placed.withColumn(key, number.cast("long")).drop("__bucket", "__start", "__top")


def upsert_works(works: DataFrame, incoming: DataFrame, replace: bool = False) -> DataFrame:
    """Works after an upsert by strict DOI of ``incoming`` (doi, title, year, venue, provenance, payload, is_preprint).

    Rows without a DOI are left out, of several with one DOI the first by title stays. What a new row says
    wins over what is stored; blanks and nulls change nothing; provenance is merged (or, with ``replace``,
    replaced), payloads are merged by source.
    """
    new = incoming.select(
        text.normalize_doi(F.lower(F.btrim("doi"))).alias("doi"), _said(F.col("title")).alias("n_title"), F.col("year").alias("n_year"), _said(F.col("venue")).alias("n_venue"),
        F.col("provenance").alias("n_provenance"), F.col("payload").alias("n_payload"), F.col("is_preprint").alias("n_preprint"),
    ).filter("doi is not null")
    new = top_per_group(new, ["doi"], [F.col("n_title").asc_nulls_last(), F.col("n_year").asc_nulls_last(), F.col("n_provenance").asc_nulls_last(), F.xxhash64("n_payload")]).withColumn("__new", F.lit(True))
    old = works.select(*WORK).withColumn("__old", F.lit(True))
    provenance = F.col("n_provenance") if replace else F.when(F.col("__old"), payloads.merge_provenance(F.col("provenance"), F.col("n_provenance"))).otherwise(F.col("n_provenance"))
    both = F.when(F.col("n_payload").isNull() & F.col("payload").isNull(), F.lit(None)).otherwise(payloads.merged_payload(F.col("payload"), F.col("provenance"), F.coalesce("n_payload", F.lit("{}"))))
    rows = old.join(new, "doi", "full_outer")
    changed = F.col("__new").isNotNull()
    rows = rows.select(
        "pub_id", "doi", F.coalesce("n_title", "title").alias("title"), F.coalesce("n_year", "year").alias("year"), F.coalesce("n_venue", "venue").alias("venue"),
        F.when(changed, F.coalesce(F.when(provenance != "", provenance), F.lit("unknown"))).otherwise(F.col("provenance")).alias("provenance"),
        F.when(changed, both).otherwise(F.col("payload")).alias("payload"), F.coalesce("n_preprint", "is_preprint").alias("is_preprint"),
    )
    rows = settled(rows, "upserted")
    fresh = numbered_after(rows.filter("pub_id is null").drop("pub_id"), works, "pub_id", [F.col("doi")])
    return rows.filter("pub_id is not null").unionByName(fresh.select(*WORK))


def update_works(works: DataFrame, patches: DataFrame) -> DataFrame:
    """In-place updates by pub_id: only fields that say something, payloads merged key by key."""
    new = patches.select("pub_id", *[_said(F.col(c)).alias(f"n_{c}") for c in ("doi", "title", "venue", "provenance")], F.col("year").alias("n_year"), F.col("is_preprint").alias("n_is_preprint"), F.col("payload").alias("n_payload"))
    rows = works.join(new, "pub_id", "left")
    kept = [F.coalesce(f"n_{c}", c).alias(c) if c not in ("pub_id", "payload") else F.col(c) for c in WORK]
    kept[WORK.index("payload")] = F.when(F.col("n_payload").isNotNull(), payloads.merged(F.col("payload"), F.col("n_payload"))).otherwise(F.col("payload")).alias("payload")
    return rows.select(*kept)


#: How an authorship that is there takes a new one.
_KEEP_NEW = ["author_name", "author_orcid", "paper_orcid", "affiliations", "paper_affiliation", "raw_author"]
_NEW = ["is_corresponding", "is_internal", "order_tag", "equal_contrib_tag"]
AUTHORSHIP = ["pub_id", "author_position", "person_id", *_KEEP_NEW, *_NEW]


def _authorship(incoming: DataFrame, persons: DataFrame) -> DataFrame:
    """Incoming rows cleaned, and internal as the linked person is."""
    internal = persons.select("person_id", (F.col("person_kind") == "internal").alias("__internal"))
    places = F.when(F.size("affiliations") > 0, F.col("affiliations"))
    rows = incoming.join(internal, "person_id", "left")
    cleaned = {
        "author_name": _said(F.col("author_name")), "author_orcid": _said(F.col("author_orcid")), "affiliations": places, "paper_affiliation": F.array_join(places, "; "),
        "paper_orcid": text.normalize_orcid(F.col("paper_orcid")), "is_internal": F.coalesce("__internal", F.lit(False)),
    }
    return rows.select(*[cleaned[c].alias(c) if c in cleaned else F.col(c) for c in AUTHORSHIP])


def upsert_authorships(authorships: DataFrame, incoming: DataFrame, persons: DataFrame) -> DataFrame:
    """Authorships after a batch of ``incoming`` rows (the stored columns but is_internal and paper_affiliation, which follow).

    A row with a person updates that person's row of the work, whatever its position; else it takes over the
    row of its position: one without a person gets this one, one with another person keeps it. Any other row is
    new. Of several rows of a batch that aim at one row the lowest position, then the last name, wins.
    """
    new = _authorship(incoming, persons)
    new = top_per_group(new, ["pub_id", "author_position"], [F.col("person_id").asc_nulls_last(), F.col("author_name").desc_nulls_last(), F.xxhash64("raw_author")])
    old = authorships.select(*AUTHORSHIP)
    by_person = old.filter("person_id is not null").groupBy("pub_id", "person_id").agg(F.min("author_position").alias("__at"))
    aimed = new.join(by_person, ["pub_id", "person_id"], "left").withColumn("__at", F.coalesce("__at", "author_position"))
    aimed = top_per_group(aimed, ["pub_id", "__at"], [(F.col("__at") != F.col("author_position")).asc(), F.col("author_position"), F.col("author_name").desc_nulls_last()])
    aimed = aimed.select("pub_id", F.col("__at").alias("author_position"), *[F.col(c).alias(f"n_{c}") for c in AUTHORSHIP[2:]], F.lit(True).alias("__new"))
    both = old.withColumn("__old", F.lit(True)).join(aimed, ["pub_id", "author_position"], "full_outer")
    is_new = F.col("__new").isNotNull()
    out = [F.col("pub_id"), F.col("author_position"), F.coalesce("person_id", "n_person_id").alias("person_id")]
    out += [F.coalesce(f"n_{c}", c).alias(c) for c in _KEEP_NEW]
    out += [F.when(is_new, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in _NEW]
    return both.select(*out)


def relink(authorships: DataFrame, persons: DataFrame, known_aliases: DataFrame, overwrite: bool = False) -> DataFrame:
    """Authorships in which rows without a person get the one that their name or ORCID resolves to, unless that person is on the work already."""
    open_ = authorships if overwrite else authorships.filter("person_id is null")
    wanted = open_.select("pub_id", "author_position", _said(F.col("author_name")).alias("author_name"), F.coalesce(_said(F.col("paper_orcid")), _said(F.col("author_orcid"))).alias("author_orcid")).filter("author_name is not null")
    found = people.resolve_authors(wanted, persons, known_aliases).filter("person_id is not null").select("pub_id", "author_position", F.col("person_id").alias("__found"))
    there = authorships.filter("person_id is not null").select("pub_id", F.col("person_id").alias("__found"))
    found = found.join(there, ["pub_id", "__found"], "left_anti")
    found = top_per_group(found, ["pub_id", "__found"], [F.col("author_position")])  # one row of a work for a person
    internal = persons.select(F.col("person_id").alias("__found"), (F.col("person_kind") == "internal").alias("__internal"))
    rows = authorships.join(found.join(internal, "__found", "left"), ["pub_id", "author_position"], "left")
    return rows.withColumn("person_id", F.coalesce("__found", "person_id")).withColumn("is_internal", F.when(F.col("__found").isNotNull(), F.coalesce("__internal", F.lit(False))).otherwise(F.col("is_internal"))).drop("__found", "__internal")


def best_author_source(authors: DataFrame, require_affiliations: bool = False) -> DataFrame:
    """Of author rows of several sources (pub_id, source, position, name, orcid, affiliations) those of each work's best source:
    the most trusted, then with more affiliations, then more authors, then by name."""
    rows = authors.filter(F.size("affiliations") > 0) if require_affiliations else authors
    scored = rows.groupBy("pub_id", "source").agg(F.count_if(F.size("affiliations") > 0).alias("with"), F.count(F.lit(1)).alias("n"))
    best = scored.groupBy("pub_id").agg(first_by(F.col("source"), payloads.trust_rank(F.col("source")), -F.col("with"), -F.col("n"), F.col("source")).alias("source"))
    return rows.join(best, ["pub_id", "source"])


def rebuilt_authorships(authors: DataFrame, persons: DataFrame, known_aliases: DataFrame, require_affiliations: bool = False) -> DataFrame:
    """Authorships made anew from the best source's authors, linked to persons; a person is linked once in a work."""
    best = best_author_source(authors, require_affiliations)
    rows = people.resolve_authors(best.withColumnRenamed("name", "author_name").withColumnRenamed("orcid", "author_orcid"), persons, known_aliases)
    first = Window.partitionBy("pub_id", "person_id").orderBy("position")
    n = F.count(F.lit(1)).over(Window.partitionBy("pub_id"))
    person = F.when(F.col("person_id").isNotNull() & (F.row_number().over(first) == 1), F.col("person_id"))
    return rows.select("pub_id", F.col("position").alias("author_position"), person.alias("person_id"), "author_name", "author_orcid", "affiliations", "source", text.name_order_tag(F.col("position"), n).alias("order_tag"))


def merged_duplicates(works: DataFrame, authorships: DataFrame, durable_winner: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(works, authorships, merges): works of one DOI key become one.

    The policy's winner stays (or ``durable_winner``'s: doi_key, winner) with the losers' tokens, and their payloads for sources that it lacks.
    The losers' authorships move to it; of one position the winner's row stays, and a person stays once.
    """
    keyed = works.select(*WORK).withColumn("key", text.doi_key(F.col("doi")))
    groups = keyed.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    same = keyed.join(groups, "key", "left_semi")
    if durable_winner is not None:
        same = same.join(durable_winner.select(F.col("doi_key").alias("key"), F.col("winner").alias("__durable")), "key", "left")
    winners = canonical.policy_winner(same, "key", "__durable" if durable_winner is not None else None)
    merges = settled(same.join(winners, "key").filter("pub_id <> winner_pub_id").select(F.col("pub_id").alias("loser"), F.col("winner_pub_id").alias("winner")), "merges")
    mapping = merges.select(F.col("loser").alias("pub_id"), "winner")
    sources = keyed.join(mapping, "pub_id").select("winner", "pub_id", F.explode(F.from_json(payloads.normal_payload(F.col("payload"), F.col("provenance")), "map<string,variant>")).alias("k", "v"), "provenance")
    gaps = sources.filter(~F.is_variant_null("v")).groupBy("winner", "k").agg(F.min_by(F.to_json("v"), "pub_id").alias("body"))
    gaps = gaps.groupBy(F.col("winner").alias("pub_id")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "body")))).alias("gaps"))
    said = keyed.join(mapping, "pub_id").groupBy(F.col("winner").alias("pub_id")).agg(F.array_join(F.sort_array(F.collect_list(F.coalesce("provenance", F.lit("")))), "+").alias("losers"))
    rows = keyed.join(mapping.select("pub_id"), "pub_id", "left_anti").join(said, "pub_id", "left").join(gaps, "pub_id", "left").withColumn("own", payloads.normal_payload(F.col("payload"), F.col("provenance")))
    extra = F.to_json(F.transform_values(F.map_filter("gaps", lambda k, _: ~F.array_contains(F.json_object_keys("own"), k)), lambda _, v: F.parse_json(v)))
    rows = rows.withColumn("payload", F.when(F.col("gaps").isNotNull(), payloads.merged(F.col("own"), extra)).otherwise(F.col("payload")))
    rows = rows.withColumn("provenance", F.when(F.col("losers").isNotNull(), F.coalesce(F.nullif(payloads.merge_provenance(F.col("provenance"), F.col("losers")), F.lit("")), F.lit("unknown"))).otherwise(F.col("provenance")))
    moved = authorships.join(mapping, "pub_id", "left").withColumn("__own", F.col("winner").isNull()).withColumn("__from", F.col("pub_id")).withColumn("pub_id", F.coalesce("winner", "pub_id"))
    moved = top_per_group(moved, ["pub_id", "author_position"], [F.col("__own").desc(), F.col("__from")])
    once = F.when(F.col("person_id").isNull(), F.concat(F.lit("#"), F.col("author_position"))).otherwise(F.col("person_id").cast("string"))
    moved = top_per_group(moved.withColumn("__person", once), ["pub_id", "__person"], [F.col("__own").desc(), F.col("author_position")])
    return rows.select(*WORK), moved.select(*authorships.columns), merges


def missing_data(works: DataFrame, source: str, force: bool = False, ids: list[int] | None = None) -> DataFrame:
    """Works that a source should be asked for: no DOI, year or venue, or no payload of it; all with ``force``."""
    rows = works if ids is None else works.filter(F.col("pub_id").isin(ids))
    return rows if force else rows.filter(F.col("doi").isNull() | F.col("year").isNull() | F.col("venue").isNull() | ~payloads.has_key(F.col("payload"), source))


def attribution_queue(works: DataFrame, authorships: DataFrame, attempts: DataFrame, now: Column, cooldown_days: int, k: int, source: str = "crossref") -> DataFrame:
    """Works to fetch for attribution: not attributed, no preprint, with a known person, without the source's payload, and not tried lately.

    Never tried first, then the oldest attempt, then by year, newest first, and id.
    """
    linked = authorships.filter("person_id is not null").select("pub_id")
    rows = works.filter("attributed is not true and is_preprint is not true").filter(~payloads.has_key(F.col("payload"), source)).join(linked, "pub_id", "left_semi").join(attempts.select("pub_id", "last_attempt", "last_outcome", F.lit(True).alias("tried")), "pub_id", "left")
    due = F.col("tried").isNull() | (F.col("last_outcome") == "error") | (F.col("last_attempt") < now - F.make_dt_interval(F.lit(cooldown_days)))
    order = [F.col("tried").isNotNull(), F.col("last_attempt").asc_nulls_first(), F.col("year").desc_nulls_last(), F.col("pub_id")]
    return rows.filter(due).orderBy(*order).limit(k).select("pub_id", "year", "last_attempt")


def recorded_attempts(attempts: DataFrame, before: DataFrame, after: DataFrame, errors: DataFrame, now: Column) -> DataFrame:
    """Attempts after a run: enriched if a missing payload came, error if the provider failed on one still missing, else no_new_payload.

    ``before`` and ``after`` have pub_id and missing (array of sources), ``after`` also attributed; ``errors`` pub_id and source. Works merged away have no row.
    """
    failed = errors.groupBy("pub_id").agg(F.collect_set("source").alias("failed"))
    both = before.select("pub_id", F.col("missing").alias("missing_before")).join(after.select("pub_id", F.col("missing").alias("missing_after"), "attributed"), "pub_id").join(failed, "pub_id", "left")
    still = F.coalesce(F.arrays_overlap("failed", "missing_after"), F.lit(False))
    outcome = F.when(still, "error").when(F.size(F.array_except("missing_before", "missing_after")) > 0, "enriched").otherwise("no_new_payload")
    new = both.select("pub_id", F.col("attributed").alias("became_attributed"), outcome.alias("last_outcome"), F.lit(True).alias("ran"))
    old = attempts.select("pub_id", "attempt_count", "last_attempt", F.col("last_outcome").alias("o_outcome"), F.col("became_attributed").alias("o_attributed"))
    rows = old.join(new, "pub_id", "full_outer")
    ran = F.col("ran").isNotNull()
    return rows.select(
        "pub_id", (F.coalesce("attempt_count", F.lit(0)) + ran.cast("int")).alias("attempt_count"), F.when(ran, now).otherwise(F.col("last_attempt")).alias("last_attempt"),
        F.coalesce("last_outcome", "o_outcome").alias("last_outcome"), F.when(ran, F.col("became_attributed")).otherwise(F.col("o_attributed")).alias("became_attributed"),
    )


def low_source_queue(canon: DataFrame, threshold: int, k: int | None = None) -> DataFrame:
    """Canonical works with fewer tokens than ``threshold``: fewest first, then newest, then by id."""
    said = F.btrim(F.coalesce("provenance", F.lit("")))
    raw = F.coalesce("provenance", F.lit(""))
    n = F.when((said == "") | (F.lower(said) == "unknown"), 0).otherwise(F.length(raw) - F.length(F.replace(raw, F.lit("+"), F.lit(""))) + 1)
    rows = canon.select("pub_id", "year", n.alias("n_sources")).filter(F.col("n_sources") < threshold).orderBy("n_sources", F.col("year").desc_nulls_last(), "pub_id")
    return rows.limit(k) if k else rows


def fill_only(stored: DataFrame, offered: DataFrame, source: str) -> DataFrame:
    """What a source may write: anything to a new work or beside sources it outranks, else only what is blank. Adds allow_authors."""
    rows = offered.join(stored.select("pub_id", F.col("title").alias("o_title"), F.col("year").alias("o_year"), F.col("venue").alias("o_venue"), F.col("provenance").alias("o_provenance"), F.lit(True).alias("there")), "pub_id", "left")
    above = F.coalesce(F.col("there"), F.lit(False)) & payloads.more_trusted(F.col("o_provenance"), source)
    blank = lambda c: F.coalesce(c == "", F.lit(True))
    return rows.select(
        "pub_id", F.when(~blank(F.col("title")) & (~above | blank(F.col("o_title"))), F.col("title")).alias("title"), F.when(~above | F.col("o_year").isNull(), F.col("year")).alias("year"),
        F.when(~blank(F.col("venue")) & (~above | blank(F.col("o_venue"))), F.col("venue")).alias("venue"), F.when(~above, F.coalesce("is_preprint", F.lit(False))).alias("is_preprint"), (~above).alias("allow_authors"),
    )


def provisional_queue(works: DataFrame, queue: DataFrame) -> DataFrame:
    """Review entries for works without a DOI that have none yet; a second run adds nothing."""
    there = queue.filter("review_type = 'provisional'").select("pub_id")
    payload = F.to_json(F.struct(F.lit("no_doi").alias("reason"), "title", "year", F.col("provenance").alias("source_of_truth")))
    return works.filter("doi is null").join(there, "pub_id", "left_anti").select(F.lit("provisional").alias("review_type"), "pub_id", F.lit("pending").alias("status"), payload.alias("payload"))


def best_titles(wanted: DataFrame, candidates: DataFrame, least: float = 0.70) -> DataFrame:
    """For each wanted work (wanted_id, title, year) its best candidate (wanted_id, place, c_title, c_year): title similarity, 0.10 more in
    the same year, 0.03 in the year beside it; the first of equals; none below ``least``."""
    rows = wanted.join(candidates, "wanted_id")
    gap = F.abs(F.coalesce("c_year", F.lit(0)) - F.col("year"))
    score = text.title_similarity(F.col("title"), F.col("c_title")) + F.when(F.col("year") > 0, F.when(gap == 0, 0.10).when(gap == 1, 0.03)).otherwise(0.0)
    score = F.coalesce(score, text.title_similarity(F.col("title"), F.col("c_title")))
    return top_per_group(rows.withColumn("score", score), ["wanted_id"], [F.col("score").desc(), F.col("place")]).filter(F.col("score") >= least)


def ingest_search(works: DataFrame, landed: DataFrame, token: str, affiliations: list[str] | None = None, skip_existing: bool = False, max_records: int | None = None, max_new: int | None = None) -> DataFrame:
    """Outcomes of landed search results (place, doi, title, year, venue, is_preprint, affiliations, payload): (place, doi, outcome) and the fields to upsert.

    In order of ``place``: the first ``max_records`` rows count; affiliation_mismatch, no_doi, repeated (a DOI seen before), existing
    (with ``skip_existing``), update or insert; after ``max_new`` of the last two: over_cap. Caps are a feature of this job, given by its caller.
    """
    rows = landed if max_records is None else landed.orderBy("place").limit(max_records)
    rows = rows.withColumn("doi", text.normalize_doi(F.col("doi"))).withColumn("fits", text.affiliation_match(F.col("affiliations"), affiliations or []))
    first = rows.filter("fits and doi is not null").groupBy("doi").agg(F.min("place").alias("first"))
    stored = works.select(text.normalize_doi(F.col("doi")).alias("doi"), F.lit(True).alias("stored")).filter("doi is not null").distinct()
    rows = rows.join(first, "doi", "left").join(stored, "doi", "left")
    outcome = F.when(~F.col("fits"), "affiliation_mismatch").when(F.col("doi").isNull(), "no_doi").when(F.col("place") > F.col("first"), "repeated")
    outcome = outcome.when(F.col("stored") & F.lit(skip_existing), "existing").when(F.col("stored"), "update").otherwise("insert")
    rows = rows.withColumn("outcome", outcome)
    if max_new is not None:
        last = rows.filter("outcome in ('insert', 'update')").orderBy("place").limit(max_new).agg(F.max("place").alias("last"))
        rows = rows.crossJoin(F.broadcast(last)).withColumn("outcome", F.when(F.col("outcome").isin("insert", "update") & ((F.col("place") > F.col("last")) | F.col("last").isNull()), "over_cap").otherwise(F.col("outcome"))).drop("last")
    return rows.select("place", "doi", "title", "year", "venue", "is_preprint", F.lit(token).alias("provenance"), "payload", "outcome")


def backfill(works: DataFrame, found: DataFrame, source: str) -> DataFrame:
    """What a lookup (pub_id, doi, title, year, venue, is_preprint, payload; null payload: nothing found) does to each work:
    not_found, collision (another work has that DOI: the two go to a duplicate merge) or update; an update sets the DOI only where there is none."""
    others = works.select(F.col("pub_id").alias("other"), text.doi_key(F.col("doi")).alias("k")).filter("k is not null")
    rows = works.select("pub_id", F.col("doi").alias("o_doi"), F.col("provenance").alias("o_provenance")).join(found.withColumn("k", text.doi_key(F.col("doi"))), "pub_id")
    clash = rows.join(others, "k").filter("pub_id <> other").groupBy("pub_id").agg(F.min("other").alias("other"))
    rows = rows.join(clash, "pub_id", "left")
    outcome = F.when(F.col("payload").isNull(), "not_found").when(F.col("other").isNotNull(), "collision").otherwise("update")
    update = F.col("outcome") == "update"
    return rows.withColumn("outcome", outcome).select(
        "pub_id", "outcome", "other", F.when(update & F.col("o_doi").isNull(), F.col("doi")).alias("doi"), F.when(update, F.col("title")).alias("title"), F.when(update, F.col("year")).alias("year"), F.when(update, F.col("venue")).alias("venue"),
        F.when(update, payloads.merge_provenance(F.col("o_provenance"), F.lit(source))).alias("provenance"), F.when(update, F.col("is_preprint")).alias("is_preprint"), F.when(update, F.col("payload")).alias("payload"),
    )


REPORT = ["source_of_truth", "csv_key", "doi", "title", "venue", "pub_year", "crossref_found", "authors_total", "authors_internal_matched", "already_in_db", "is_new", "pub_id_before", "pub_id_after", "ingest_action", "crossref_http_status", "registration_agency_id", "registration_agency_label", "internal_person_ids", "error"]


def import_bibliography(rows: DataFrame, lookups: DataFrame, title_hits: DataFrame, works: DataFrame, dry_run: bool = True) -> DataFrame:
    """The report of a bibliography import (:data:`REPORT`, and place): one row for each input row that counts.

    ``rows``: place, csv_key, doi, title, venue, year. ``lookups``: doi and what was found (f_title, f_venue, f_year, status, agency_id,
    agency_label, n_authors, person_ids). ``title_hits``: place, doi of the best title match. A row without a DOI takes its title match's
    DOI or fails; of rows with one DOI the first counts.
    """
    clean = rows.select("place", F.coalesce(_said(F.col("csv_key")), F.concat(F.lit("row_"), F.col("place"))).alias("csv_key"), text.normalize_doi(F.col("doi")).alias("own"), F.coalesce(F.btrim("title"), F.lit("")).alias("title"), F.coalesce(F.btrim("venue"), F.lit("")).alias("venue"), "year")
    clean = clean.join(title_hits.select("place", text.normalize_doi(F.col("doi")).alias("hit"), F.lit(True).alias("matched")), "place", "left")
    error = F.when(F.col("title") == "", "missing DOI; title lookup failed (missing title)").when(F.col("matched").isNull(), "title lookup failed").when(F.col("hit").isNull(), "title lookup matched but DOI missing")
    clean = clean.withColumn("error", F.when(F.col("own").isNull(), error)).withColumn("doi", F.when(F.col("error").isNull(), F.coalesce("own", "hit")))
    failed, good = clean.filter("error is not null"), top_per_group(clean.filter("error is null"), ["doi"], [F.col("place")])
    stored = works.groupBy(text.normalize_doi(F.col("doi")).alias("doi")).agg(F.min("pub_id").alias("pub_id_before"))
    found = lookups.withColumn("found", F.lit(True))
    both = good.unionByName(failed).join(found, "doi", "left").join(stored, "doi", "left")
    ok = F.col("error").isNull()
    seen = ok & F.coalesce(F.col("found"), F.lit(False)) & F.col("f_title").isNotNull()
    there = ok & F.col("pub_id_before").isNotNull()
    action = F.when(~ok, "no_doi_title_lookup_failed").when(there, "would_update" if dry_run else "update").otherwise("would_insert" if dry_run else "insert")
    flag = lambda c: F.when(c, "1").otherwise("0")
    out = {
        "source_of_truth": F.when(F.col("own").isNull(), "manual-no-doi").otherwise("manual"), "csv_key": F.col("csv_key"), "doi": F.coalesce("doi", F.lit("")), "title": F.when(seen, F.coalesce("f_title", "title")).otherwise(F.col("title")), "venue": F.when(seen, F.coalesce("f_venue", "venue")).otherwise(F.col("venue")),
        "pub_year": F.when(seen, F.coalesce("f_year", "year")).otherwise(F.col("year")), "crossref_found": flag(seen), "authors_total": F.when(ok, F.coalesce("n_authors", F.lit(0))).otherwise(0), "authors_internal_matched": F.when(ok, F.coalesce(F.size("person_ids"), F.lit(0))).otherwise(0),
        "already_in_db": flag(there), "is_new": flag(~there), "pub_id_before": F.when(ok, F.col("pub_id_before")), "pub_id_after": F.when(ok, F.col("pub_id_before")), "ingest_action": action, "crossref_http_status": F.when(ok & F.col("own").isNotNull(), F.col("status")),
        "registration_agency_id": F.coalesce(F.when(ok & ~seen, F.col("agency_id")), F.lit("")), "registration_agency_label": F.coalesce(F.when(ok & ~seen, F.col("agency_label")), F.lit("")), "internal_person_ids": F.coalesce(F.array_join(F.when(ok, F.transform("person_ids", lambda p: p.cast("string"))), ";"), F.lit("")), "error": F.coalesce("error", F.lit("")),
    }
    return both.select("place", *[out[c].alias(c) for c in REPORT]).orderBy("place")


def action_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("ingest_action").agg(F.count(F.lit(1)).alias("n"))


def author_counts(works: DataFrame, source: str) -> DataFrame:
    """pub_id, authors and with_affiliation: how many authors a source's payload names, and how many of them with an affiliation."""
    at = {"crossref": "author", "openalex": "authorships", "datacite": "attributes.creators", "semantic": "authors"}[source]
    kind = {"crossref": "array<struct<affiliation:array<struct<name:string>>>>", "openalex": "array<struct<raw_affiliation_strings:array<string>,institutions:array<struct<display_name:string>>>>", "datacite": "array<struct<affiliation:array<string>>>", "semantic": "array<struct<affiliations:array<string>>>"}[source]
    rows = F.from_json(F.get_json_object("payload", f"$.{source}.{at}"), kind)
    said = lambda names: F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda n: text.nonblank(n))
    has = {"crossref": lambda a: said(a["affiliation"]["name"]), "openalex": lambda a: said(a["raw_affiliation_strings"]) | said(a["institutions"]["display_name"]), "datacite": lambda a: said(a["affiliation"]), "semantic": lambda a: said(a["affiliations"])}[source]
    return works.select("pub_id", rows.alias("a")).select("pub_id", F.greatest(F.coalesce(F.size("a"), F.lit(0)), F.lit(0)).alias("authors"), F.coalesce(F.size(F.filter("a", has)), F.lit(0)).alias("with_affiliation"))


def authorship_counts(authorships: DataFrame) -> DataFrame:
    """pub_id, total, with_person and with_affiliation of the stored rows."""
    return authorships.groupBy("pub_id").agg(F.count(F.lit(1)).alias("total"), F.count("person_id").alias("with_person"), F.count_if(F.size("affiliations") > 0).alias("with_affiliation"))


def ingest_payloads(works: DataFrame, landed: DataFrame, source: str, token: str | None = None) -> DataFrame:
    """Works after landed payloads of one source (payload_id, payload): fields are read, and merged by DOI with the payload under the source's key. The same payloads again change nothing."""
    fields = providers.works(landed, source)
    body = landed.select("payload_id", F.concat(F.lit(f'{{"{source}":'), F.col("payload"), F.lit("}")).alias("payload"))
    incoming = fields.join(body, "payload_id").withColumn("provenance", F.lit(token or source))
    return upsert_works(works, incoming)


def ingest_orcid(works: DataFrame, authorships: DataFrame, records: DataFrame, persons: DataFrame, known_aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(works, authorships) after the ORCID records of persons (person_orcid, payload): summaries with a DOI are upserted, and the person, found by the record's ORCID, is put on each."""
    listed = providers.orcid_works(records).withColumn("doi", text.normalize_doi(F.col("doi"))).filter("doi is not null")
    incoming = listed.select("doi", "title", F.col("year").try_cast("int").alias("year"), F.lit(None).cast("string").alias("venue"), F.lit("orcid").alias("provenance"), F.lit(None).cast("string").alias("payload"), F.lit(None).cast("boolean").alias("is_preprint"))
    new = settled(upsert_works(works, incoming), "orcid-works")
    who = listed.select("doi", F.col("person_orcid").alias("author_orcid"), F.lit(None).cast("string").alias("author_name")).distinct()
    found = people.resolve_authors(who, persons, known_aliases).filter("person_id is not null").join(new.select("pub_id", "doi"), "doi")
    there = authorships.filter("person_id is not null").select("pub_id", "person_id")
    last = authorships.groupBy("pub_id").agg(F.max("author_position").alias("last"))
    missing = found.join(there, ["pub_id", "person_id"], "left_anti").join(last, "pub_id", "left")
    place = F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("pub_id").orderBy("person_id"))
    none = F.lit(None).cast("string")
    rows = missing.join(persons.select("person_id", "display_name"), "person_id").select(
        "pub_id", place.cast("int").alias("author_position"), "person_id", F.col("display_name").alias("author_name"), "author_orcid", F.col("author_orcid").alias("paper_orcid"), F.lit(None).cast("array<string>").alias("affiliations"),
        none.alias("paper_affiliation"), F.lit(False).alias("is_corresponding"), none.alias("order_tag"), none.alias("equal_contrib_tag"), none.alias("raw_author"),
    )
    return new, upsert_authorships(authorships, rows, persons)
