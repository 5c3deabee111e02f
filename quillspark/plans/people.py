"""People: resolution of authors, overlays of curators, merges of persons, co-author edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.durable import settled
from quillspark.functions import text
from quillspark.operators.relational import ordered_set, pairs_within, top_per_group, upsert


def coauthor_edges(authorships: DataFrame, works: DataFrame) -> DataFrame:
    """(person_a < person_b): joint works, first and last year."""
    linked = authorships.filter("person_id is not null").select("pub_id", "person_id").distinct()
    pairs = pairs_within(linked, "pub_id", "person_id").join(works.select("pub_id", "year"), "pub_id")
    return pairs.groupBy(F.col("low").alias("person_a"), F.col("high").alias("person_b")).agg(F.count(F.lit(1)).alias("joint_works"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def curated_authorships(authorships: DataFrame, overrides: DataFrame) -> DataFrame:
    """Authorships under manual overrides (force_person, force_null, ignore_row).

    Selectors are optional: a blank one fits all rows. ORCID goes before name before position, then newest, then highest id.
    """
    o = overrides.select("pub_id", "override_id", "mode", F.col("person_id").alias("forced"), F.col("author_position").alias("o_position"), F.lower(F.btrim("author_name")).alias("o_name"), F.lower(F.btrim("author_orcid")).alias("o_orcid"), "updated_at")
    blank = lambda c: F.coalesce(c == "", F.lit(True))
    fits = (F.col("o_position").isNull() | (F.col("o_position") == F.col("author_position"))) & (blank(F.col("o_name")) | (F.col("o_name") == F.lower("author_name"))) & (blank(F.col("o_orcid")) | (F.col("o_orcid") == F.lower("author_orcid")))
    specific = F.when(~blank(F.col("o_orcid")), 0).when(~blank(F.col("o_name")), 1).otherwise(2)
    found = authorships.select("pub_id", "author_position", "author_name", "author_orcid").join(o, "pub_id").filter(fits).withColumn("specific", specific)
    best = top_per_group(found, ["pub_id", "author_position"], [F.col("specific"), F.col("updated_at").desc_nulls_last(), F.col("override_id").desc()]).select("pub_id", "author_position", "mode", "forced")
    rows = authorships.join(best, ["pub_id", "author_position"], "left").filter("mode is distinct from 'ignore_row'")
    person = F.when(F.col("mode") == "force_person", F.col("forced")).when(F.col("mode") == "force_null", F.lit(None)).otherwise(F.col("person_id"))
    return rows.withColumn("person_id", person).drop("mode", "forced")


def aliases(*sources: DataFrame) -> DataFrame:
    """(person_id, alias_name, alias_sources) from any number of (person_id, alias_name, source) tables; blanks go, case is folded for grouping."""
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more)
    rows = rows.filter(text.nonblank(F.col("alias_name"))).withColumn("key", F.lower(F.btrim("alias_name")))
    return rows.groupBy("person_id", "key").agg(F.min(F.btrim("alias_name")).alias("alias_name"), ordered_set(F.col("source")).alias("alias_sources")).drop("key")


def name_candidates(x: Column) -> Column:
    """Forms of a name to look up, in order: as given, with plain dashes and single blanks, and both of "Last, First" swapped; lower case."""

    def plain(y: Column) -> Column:
        return F.btrim(F.regexp_replace(F.regexp_replace(y, r"[\u2010-\u2015\u2212\u00ad]", "-"), r"\s+", " "))

    def swapped(y: Column) -> Column:
        parts = F.filter(F.transform(F.split(y, ","), lambda part: F.btrim(part)), lambda part: part != "")
        return F.when(F.size(parts) >= 2, F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(0))))

    given = F.btrim(x)
    forms = F.array(given, plain(given), swapped(given), plain(swapped(given)), swapped(plain(given)))
    return F.array_distinct(F.filter(F.transform(forms, lambda f: F.lower(f)), lambda f: f.isNotNull() & (f != "")))


def fits_person(candidate: Column, display_name: Column, least: float) -> Column:
    """Equivalent names with a similarity of ``least`` or more."""
    return text.names_equivalent(candidate, display_name) & (text.name_similarity(candidate, display_name) >= least)


def resolve_authors(authors: DataFrame, people: DataFrame, known_aliases: DataFrame, least: float = 0.8) -> DataFrame:
    """authors (author_name, author_orcid, ...) with person_id and matched_by: ORCID, else a display name or alias that one person alone has.

    Names are looked up by each of :func:`name_candidates` in turn, display names before aliases; the
    candidate must fit the person's display name (:func:`fits_person`), else the next one is tried.
    """
    by_orcid = people.select(text.normalize_orcid(F.col("orcid")).alias("o"), "person_id").filter("o is not null").groupBy("o").agg(F.count_distinct("person_id").alias("n"), F.min("person_id").alias("by_orcid")).filter("n = 1").drop("n")
    shown = people.select("person_id", "display_name").distinct()
    spelled = shown.select(F.lower("display_name").alias("name_key"), "person_id", "display_name", F.lit(0).alias("kind"))
    spelled = spelled.unionByName(known_aliases.join(shown, "person_id").select(F.lower("alias_name").alias("name_key"), "person_id", "display_name", F.lit(1).alias("kind")).distinct())
    unique = spelled.groupBy("kind", "name_key").agg(F.count(F.lit(1)).alias("n"), F.min("person_id").alias("found"), F.min("display_name").alias("display_name")).filter("n = 1").drop("n")
    names = authors.select(F.col("author_name").alias("wanted")).distinct().select("wanted", F.posexplode(name_candidates(F.col("wanted"))).alias("place", "name_key"))
    fitting = names.join(unique, "name_key").filter(fits_person(F.col("name_key"), F.lower("display_name"), least))
    by_name = top_per_group(fitting, ["wanted"], [F.col("kind"), F.col("place")]).select("wanted", "found", "kind")
    rows = authors.withColumn("o", text.normalize_orcid(F.col("author_orcid"))).join(by_orcid, "o", "left").join(by_name, F.col("author_name") == F.col("wanted"), "left")
    how = F.when(F.col("by_orcid").isNotNull(), "orcid").when(F.col("kind") == 0, "name").when(F.col("kind") == 1, "alias")
    return rows.withColumn("person_id", F.coalesce("by_orcid", "found")).withColumn("matched_by", how).drop("o", "wanted", "found", "kind", "by_orcid")


def attach_score(author: Column, author_orcid: Column, person: Column, person_orcid: Column) -> Column:
    """1 on equal ORCIDs, else the similarity of the names."""
    same = text.normalize_orcid(author_orcid) == text.normalize_orcid(person_orcid)
    return F.when(same, F.lit(1.0)).otherwise(text.name_similarity(author, person))


def move_children(child: DataFrame, merges: DataFrame, owner: str, key: list[str], order: list[Column]) -> DataFrame:
    """Child rows of merged owners under their winner; of rows that then agree in ``key`` the first by ``order`` stays.

    ``merges`` maps loser to winner.
    """
    moved = child.join(merges.select(F.col("loser").alias(owner), "winner"), owner, "left").withColumn(owner, F.coalesce("winner", owner)).drop("winner")
    return top_per_group(moved, key, order)


def refused_merges(authorships: DataFrame, merges: DataFrame) -> DataFrame:
    """Person merges whose two sides share a work: they must not be merged."""
    a = authorships.select(F.col("person_id").alias("loser"), "pub_id")
    b = authorships.select(F.col("person_id").alias("winner"), "pub_id")
    return merges.join(a, "loser").join(b, ["winner", "pub_id"]).select("loser", "winner").distinct()


def contact_status(wanted: DataFrame, people: DataFrame, contacts: DataFrame) -> DataFrame:
    """wanted (person_id) with a reason: not_found, not_internal, no_pii_row, opted_out, no_email or ok, in this order of precedence."""
    rows = wanted.join(people.select("person_id", "person_kind"), "person_id", "left").join(contacts.select("person_id", "opted_out", "email", F.lit(True).alias("has_row")), "person_id", "left")
    reason = F.when(F.col("person_kind").isNull(), "not_found").when(F.col("person_kind") != "internal", "not_internal").when(F.col("has_row").isNull(), "no_pii_row").when(F.col("opted_out"), "opted_out").when(~text.nonblank(F.col("email")), "no_email").otherwise("ok")
    return rows.select("person_id", reason.alias("reason"))


def merged_emails(rows: DataFrame) -> DataFrame:
    """(person_id, emails, primary_email) of (person_id, place, email): first casing wins, order of first mention, placeholders out."""
    e = rows.filter(text.nonblank(F.col("email"))).withColumn("email", F.btrim("email")).filter(~F.lower("email").isin("none", "null", "n/a", "unknown"))
    first = top_per_group(e.withColumn("k", F.lower("email")), ["person_id", "k"], [F.col("place")])
    got = first.groupBy("person_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "email"))), lambda s: s["email"]).alias("emails"))
    return got.withColumn("primary_email", F.get("emails", F.lit(0)))


#: Entries of address lists that are no addresses.
NO_EMAILS = ["[]", "email", "emails", "n/a", "none"]
NO_PRIMARY = ["email", "n/a", "none", "primary_email"]


def _addresses(emails: Column) -> Column:
    """Distinct addresses of an array, first casing and first place; placeholders go."""
    clean = F.filter(F.transform(F.coalesce(emails, F.array().cast("array<string>")), lambda e: F.btrim(e)), lambda e: (e != "") & ~F.lower(e).isin(NO_EMAILS))
    low = F.transform(clean, lambda e: F.lower(e))
    return F.filter(F.transform(F.arrays_zip(clean.alias("e"), F.sequence(F.lit(0), F.size(clean)).alias("k")), lambda z: F.when(F.array_position(low, F.lower(z["e"])) == z["k"] + 1, z["e"])), lambda e: e.isNotNull())


def merge_contact(contacts: DataFrame, offered: DataFrame) -> DataFrame:
    """Contacts (person_id, primary_email, emails) after verified addresses (person_id, emails): stored ones first, then new ones;
    a real primary address stays, else the first is it. Persons without a row get none."""
    rows = contacts.join(offered.select("person_id", F.col("emails").alias("more")), "person_id", "left").withColumn("has", F.col("more").isNotNull())
    both = _addresses(F.concat(F.coalesce("emails", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>"))))
    real = F.coalesce((F.btrim("primary_email") != "") & ~F.lower(F.btrim("primary_email")).isin(NO_PRIMARY), F.lit(False))
    rows = rows.withColumn("all", both)
    return rows.select("person_id", F.when(F.col("has") & ~real, F.get("all", F.lit(0))).otherwise(F.col("primary_email")).alias("primary_email"), F.when(F.col("has"), F.col("all")).otherwise(F.col("emails")).alias("emails"))


def ensure_contacts(contacts: DataFrame, wanted: DataFrame, update: bool = True) -> DataFrame:
    """Contacts in which every person of ``wanted`` (person_id, primary_email, emails) has a row; those that are there are merged, or left with ``update`` false."""
    listed = wanted.select("person_id", F.concat(F.coalesce("emails", F.array().cast("array<string>")), F.array("primary_email")).alias("emails"))
    kept = merge_contact(contacts, listed) if update else contacts.select("person_id", "primary_email", "emails")
    new = listed.join(contacts.select("person_id"), "person_id", "left_anti").select("person_id", _addresses(F.col("emails")).alias("emails"))
    return kept.unionByName(new.select("person_id", F.get("emails", F.lit(0)).alias("primary_email"), "emails"))


def introduction_contacts(wanted: DataFrame, people: DataFrame, contacts: DataFrame) -> DataFrame:
    """:func:`contact_status` by consent flags (JSON: introductions false, as a boolean or text, opts out), with the address where the reason is ok."""
    opted = F.coalesce(F.get_json_object("consent_flags", "$.introductions"), F.lit("true")) == "false"
    rows = contacts.select("person_id", opted.alias("opted_out"), F.col("primary_email").alias("email"))
    return contact_status(wanted, people, rows).join(rows.select("person_id", "email"), "person_id", "left").select("person_id", "reason", F.when(F.col("reason") == "ok", F.col("email")).alias("primary_email"))


def log_introductions(log: DataFrame, sent: DataFrame) -> DataFrame:
    """The introduction log with pairs (person_a, person_b, note) that are new in either order, the lower id first."""
    pair = sent.select(F.least("person_a", "person_b").alias("person_a"), F.greatest("person_a", "person_b").alias("person_b"), "note").filter("person_a <> person_b")
    new = top_per_group(pair, ["person_a", "person_b"], [F.col("note").asc_nulls_last()]).join(log.select("person_a", "person_b"), ["person_a", "person_b"], "left_anti")
    return log.unionByName(new.select(*log.columns))


def add_paper_emails(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """Addresses of authors on papers (pub_id, person_id, email): added where the work, person and address (case ignored) aren't there."""
    tidy = offered.withColumn("email", F.btrim("email")).filter(text.nonblank(F.col("email")) & ~F.lower("email").isin(NO_EMAILS)).withColumn("k", F.lower("email"))
    new = top_per_group(tidy, ["pub_id", "person_id", "k"], [F.col("email")])
    return stored.unionByName(new.join(stored.select("pub_id", "person_id", F.lower("email").alias("k")), ["pub_id", "person_id", "k"], "left_anti").select(*stored.columns))


def upsert_employments(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Employments (person_id, org_name, department, role_title, start_date, end_date, is_current, source) after an upsert by person, organisation and start.

    A missing start is a key of its own. New department, role and is_current win; a known end stays if the new one is missing; the source stays.
    """
    rows = top_per_group(incoming.filter(text.nonblank(F.col("org_name"))), ["person_id", "org_name", "start_date"], [F.col("end_date").desc_nulls_last(), F.col("role_title").asc_nulls_last()])
    return upsert(stored, rows, ["person_id", "org_name", "start_date"], {"department": "new", "role_title": "new", "end_date": "coalesce_new", "is_current": "new", "source": "coalesce_old"})


def refresh_profiles(persons: DataFrame, found: DataFrame) -> DataFrame:
    """Persons (person_id, first_name, last_name, orcid_updated) after profiles: names are filled where blank, dates only move forward."""
    rows = persons.join(found.select("person_id", F.col("first_name").alias("f"), F.col("last_name").alias("l"), F.col("orcid_updated").alias("u")), "person_id", "left")
    fill = lambda old, new: F.coalesce(F.when(text.nonblank(F.col(old)), F.col(old)), F.when(text.nonblank(F.col(new)), F.btrim(new)))
    return rows.withColumn("first_name", fill("first_name", "f")).withColumn("last_name", fill("last_name", "l")).withColumn("orcid_updated", F.greatest("orcid_updated", "u")).drop("f", "l", "u")


def import_roster(persons: DataFrame, rows: DataFrame) -> DataFrame:
    """Persons (orcid, display_name, first_name, last_name, person_kind) after the good rows of a roster: by ORCID; the display name is derived from the parts where blank."""
    name = F.coalesce(F.when(text.nonblank(F.col("display_name")), F.btrim("display_name")), F.nullif(F.btrim(F.concat_ws(" ", "first_name", "last_name")), F.lit("")))
    good = rows.filter("error is null").withColumn("display_name", name)
    good = top_per_group(good, ["orcid"], [F.col("display_name").asc_nulls_last()]).select(*persons.columns)
    return upsert(persons, good, ["orcid"], {"person_kind": "new"})


def search_names(persons: DataFrame, known_aliases: DataFrame) -> DataFrame:
    """person_id, place, name: the distinct names (case ignored) to search a person by: display name, ORCID name, then aliases; short ones are left out."""
    names = known_aliases.groupBy("person_id").agg(ordered_set(F.col("alias_name")).alias("more"))
    rows = persons.join(names, "person_id", "left")
    every = F.concat(F.array("display_name", F.concat_ws(" ", "first_name", "last_name")), F.coalesce("more", F.array().cast("array<string>")))
    listed = rows.select("person_id", F.posexplode(every).alias("k", "name")).withColumn("name", F.btrim(F.regexp_replace("name", r"\s+", " "))).filter(text.long_enough(F.col("name")))
    first = top_per_group(listed.withColumn("low", F.lower("name")), ["person_id", "low"], [F.col("k")])
    place = F.row_number().over(Window.partitionBy("person_id").orderBy("k"))
    return first.select("person_id", place.alias("place"), "name")


def pick_candidate(searches: DataFrame, hits: DataFrame, least: float = 0.25, require_family: bool = False) -> DataFrame:
    """For each search (search_id, name, context: array of words) its best identifier among hits (search_id, place, orcid, given, family, institution, other_names).

    Score: name match, up to 0.2 for words of the institution in the context, 0.2 or 0.1 for another name that matches at 0.8 or 0.6. Hits whose
    family name shares a word with the name's go first; the earlier of equals wins; nothing is taken below ``least``.
    """
    rows = searches.join(hits, "search_id")
    base = text.name_match_score(F.col("name"), F.col("given"), F.col("family"))
    aka = rows.select("search_id", "place", "name", F.explode("other_names").alias("o")).withColumn("s", text.name_match_score(F.col("name"), text.given_name(F.col("o")), text.family_name(F.col("o"))))
    best = aka.groupBy("search_id", "place").agg(F.max("s").alias("aka"))
    words = lambda x: F.filter(F.split(F.lower(text.ascii_fold(F.coalesce(x, F.lit("")))), r"[^a-z0-9]+"), lambda t: t != "")
    shares = F.arrays_overlap(words(text.family_name(F.col("name"))), words(F.col("family")))
    rows = rows.join(best, ["search_id", "place"], "left").withColumn("fits", F.coalesce(shares, F.lit(False)))
    bonus = F.when(F.col("aka") >= 0.8, 0.2).when(F.col("aka") >= 0.6, 0.1).otherwise(0.0)
    rows = rows.withColumn("score", F.round(F.least(F.lit(1.0), base + text.jaccard_boost(F.col("institution"), F.col("context")) + bonus), 3))
    if require_family:
        rows = rows.filter("fits")
    return top_per_group(rows.filter("orcid is not null"), ["search_id"], [F.col("fits").desc(), F.col("score").desc(), F.col("place")]).filter(F.col("score") >= least).select("search_id", "orcid", "score", "fits")


def name_searches(persons: DataFrame, most: int = 8) -> DataFrame:
    """search_id, place, given, family: at most ``most`` queries for each name (search_id, name), family variants before given ones, structured before ASCII forms."""
    rows = persons.withColumn("g", text.given_name(F.col("name"))).withColumn("f", text.family_name(F.col("name")))
    rows = rows.withColumn("gs", text.given_variants(F.col("g"), F.col("f"))).withColumn("fs", text.family_variants(F.col("f")))
    pairs = rows.select("search_id", F.posexplode("fs").alias("i", "family"), "gs").select("search_id", "i", "family", F.posexplode("gs").alias("j", "given"))
    folded = pairs.withColumn("given", text.ascii_fold(F.col("given"))).withColumn("family", text.ascii_fold(F.col("family"))).withColumn("kind", F.lit(1))
    every = pairs.withColumn("kind", F.lit(0)).unionByName(folded)
    first = top_per_group(every, ["search_id", "given", "family"], [F.col("kind"), F.col("j"), F.col("i")])
    place = F.row_number().over(Window.partitionBy("search_id").orderBy("kind", "j", "i"))
    return first.withColumn("place", place).filter(F.col("place") <= most).select("search_id", "place", "given", "family")


def attach(authorships: DataFrame, requests: DataFrame, persons: DataFrame, least: float = 0.80) -> DataFrame:
    """What comes of requests (pub_id, person_id): the row of the work that fits the person best, and attach, low_score, already_there or conflict (the row has another person)."""
    person = persons.select("person_id", "display_name", "orcid").withColumnRenamed("person_id", "want")
    rows = requests.withColumnRenamed("person_id", "want").join(person, "want").join(authorships.select("pub_id", "author_position", "author_name", "author_orcid", "person_id"), "pub_id")
    rows = rows.withColumn("score", attach_score(F.col("author_name"), F.col("author_orcid"), F.col("display_name"), F.col("orcid"))).withColumn("there", F.coalesce(F.col("person_id") == F.col("want"), F.lit(False)))
    best = top_per_group(rows, ["pub_id", "want"], [F.col("there").desc(), F.col("score").desc_nulls_last(), F.col("author_position")])
    outcome = F.when(F.col("there"), "already_there").when(F.coalesce(F.col("score") < least, F.lit(True)), "low_score").when(F.col("person_id").isNotNull(), "conflict").otherwise("attach")
    return best.select("pub_id", F.col("want").alias("person_id"), "author_position", "score", outcome.alias("outcome"))


def editor_profile(person: DataFrame, known_aliases: DataFrame, contacts: DataFrame) -> DataFrame:
    """person_id, display_name, aliases (ordered without case) and emails of persons."""
    names = known_aliases.groupBy("person_id").agg(F.transform(F.sort_array(F.collect_set(F.struct(F.lower("alias_name").alias("k"), "alias_name"))), lambda s: s["alias_name"]).alias("aliases"))
    none = F.array().cast("array<string>")
    rows = person.join(names, "person_id", "left").join(contacts.select("person_id", "emails"), "person_id", "left")
    return rows.select("person_id", "display_name", F.coalesce("aliases", none).alias("aliases"), _addresses(F.col("emails")).alias("emails"))


#: What a person merge does with each child table: the key on which two rows meet, and how each column of the kept row takes the other's.
CHILD_POLICIES: dict[str, tuple[list[str], dict[str, str]]] = {
    "authorships": (["pub_id", "author_position"], {}),
    "authorship_overrides": (["pub_id", "author_position", "author_name", "author_orcid"], {}),
    "refresh_log": (["log_id"], {}),
    "fetch_jobs": (["job_id"], {}),
    "employments": (["person_id", "org_name", "start_date"], {}),
    "orcids": (["person_id", "orcid"], {"verified_at": "greatest"}),
    "scholar_ids": (["person_id"], {"scholar_id": "coalesce_old"}),
    "person_keys": (["person_id", "key_hash"], {"first_seen": "least", "last_seen": "greatest"}),
    "aliases": (["person_id", "alias_key"], {"alias_sources": "union"}),
    "source_state": (["source", "person_id"], {"last_attempt": "greatest", "last_success": "greatest", "last_error_at": "greatest"}),
    "person_state": (["person_id"], {"last_orcid_profile_at": "greatest", "last_works_at": "greatest"}),
    "contacts": (["person_id"], {"primary_email": "coalesce_old", "emails": "union"}),
    "orcid_emails": (["person_id", "email"], {}),
    "paper_emails": (["pub_id", "person_id", "email"], {}),
    "orcid_payloads": (["person_id"], {"payload": "coalesce_old", "fetched_at": "greatest"}),
    "email_log": (["log_id"], {}),
}


def resolved_merges(merges: DataFrame) -> DataFrame:
    """(loser, winner) with chains followed to their last winner; a cycle, or a loser with two winners, is an error."""
    twice = merges.groupBy("loser").agg(F.count_distinct("winner").alias("n")).filter("n > 1")
    if not twice.isEmpty():
        raise ValueError("a person can be merged into one other only")
    now = settled(merges.select("loser", "winner").distinct(), "person-merges")
    for _ in range(max(1, now.count()).bit_length() + 1):
        step = now.select(F.col("loser").alias("winner"), F.col("winner").alias("next"))
        more = now.join(step, "winner", "left")
        if more.filter("next is not null").isEmpty():
            return now
        now = settled(more.select("loser", F.coalesce("next", "winner").alias("winner")), "person-merges")
    raise ValueError("the merges go round in a circle")


def merge_people(tables: dict[str, DataFrame], merges: DataFrame) -> dict[str, DataFrame]:
    """The child tables after person merges (loser, winner), by :data:`CHILD_POLICIES`: rows of losers move; of rows that then meet the winner's stays, taking from the others what its policy says.

    Merges whose two sides share a work are refused (an error), as :func:`refused_merges` lists them.
    """
    final = resolved_merges(merges)
    if not refused_merges(tables["authorships"], final).isEmpty():
        raise ValueError("two persons of one work cannot be merged")
    fold = {"greatest": lambda c: F.max(c), "least": lambda c: F.min(c), "union": lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), "coalesce_old": lambda c: F.get(F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("__moved", "__from", F.col(c).alias("v"))))), lambda s: s["v"]), F.lit(0))}
    out = {}
    for name, df in tables.items():
        key, policy = CHILD_POLICIES[name]
        moved = df.join(final.select(F.col("loser").alias("person_id"), "winner"), "person_id", "left").withColumn("__moved", F.col("winner").isNotNull()).withColumn("__from", F.col("person_id")).withColumn("person_id", F.coalesce("winner", "person_id"))
        first = top_per_group(moved, key, [F.col("__moved"), F.col("__from")])
        used = {c: how for c, how in policy.items() if c in df.columns}
        if used:
            taken = moved.groupBy(*key).agg(*[fold[how](c).alias(f"__{c}") for c, how in used.items()])
            same = [first[k].eqNullSafe(taken[k]) for k in key]
            first = first.join(taken, same).select(*[F.col(f"__{c}").alias(c) if c in used else first[c] for c in df.columns])
        out[name] = first.select(*df.columns)
    return out
