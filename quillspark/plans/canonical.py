"""Canonical records: grouping of duplicate works, decisions of curators, and the canonical list.

Inputs are DataFrames with these columns:

* ``works``: pub_id, doi, title, year, venue, provenance, payload (JSON by source), is_preprint, attributed
* ``decisions``: decision_id, mode (merge_to, keep_separate, confirm_winner), doi, title, year,
  winner_doi, winner_title, winner_year, updated_at, active: durable, matched by key and not by id
* ``overrides``: pub_id, mode (merge_to, keep_separate), winner_pub_id
* ``scopes``: decision_id, scope_type (global, person), person_id, mode (include, exclude), doi, title, year, updated_at, active, note
* ``authorships``: pub_id, person_id, is_internal, paper_affiliation, affiliations (array); ``people``: person_id, display_name
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.durable import settled
from quillspark.functions import dates, text
from quillspark.functions.payloads import best_rank, families, token_list, tokens
from quillspark.operators.relational import false_null_true, first_by, or_equi_join, ordered_text, top_per_group

#: Record types that are no publications.
CROSSREF_EXCLUDED = ["dataset", "other", "peer-review", "posted-content", "preprint", "reference-entry"]
OPENALEX_EXCLUDED = ["dataset", "editorial", "erratum", "other", "paratext", "peer-review", "preprint"]


def excluded_type(payload: Column) -> Column:
    """By the first source's type; by the other's only if the first has none."""
    first, second = F.get_json_object(payload, "$.crossref.type"), F.get_json_object(payload, "$.openalex.type")
    return F.coalesce(first.isin(CROSSREF_EXCLUDED), F.lit(False)) | (first.isNull() & F.coalesce(second.isin(OPENALEX_EXCLUDED), F.lit(False)))


def keyed(works: DataFrame) -> DataFrame:
    return works.withColumn("norm_title", text.title_key(F.col("title"))).withColumn("doi_key", text.doi_key(F.col("doi")))


def _keyed_once(works: DataFrame) -> DataFrame:
    """:func:`keyed` works, computed once by as many tasks as there is work for: a small file is one task's, and each join below would derive its keys again."""
    return settled(keyed(works.repartition("pub_id")), "keyed")


def _best(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The greatest row of each group by ``order`` (nulls last), without a window: a group of any size is reduced where it lies."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__best")).select(*keys, "__best.*")


def _winners(works: DataFrame, wanted: DataFrame) -> DataFrame:
    """(decision_id, winner_pub_id): the first work that fits w_doi, or w_title (and w_year if given) where there is no DOI.

    Each key's first work is found before the join: never are all works of a title beside all decisions that name it.
    """
    pre = false_null_true(F.col("is_preprint"))
    least = [F.min(F.when(F.col("pre") == k, F.col("id"))).alias(f"id{k}") for k in range(3)]  # numbers are aggregated by hash, structs by sort
    first = F.coalesce(*[F.when(F.col(f"id{k}").isNotNull(), F.struct(F.lit(k).alias("pre"), F.col(f"id{k}").alias("id"))) for k in range(3)])
    of = lambda **keys: works.select(*[F.col(c).alias(k) for k, c in keys.items()], pre.alias("pre"), F.col("pub_id").alias("id")).dropna(subset=list(keys)).groupBy(*keys).agg(*least).select(*keys, first.alias("first"))
    by_doi = wanted.filter("w_doi is not null").join(of(w_doi="doi_key"), "w_doi")
    untold = wanted.filter("w_doi is null")
    by_title = untold.filter("w_year is null").join(of(w_title="norm_title"), "w_title")
    by_year = untold.filter("w_year is not null").join(of(w_title="norm_title", w_year="year"), ["w_title", "w_year"])
    found = by_doi.select("decision_id", F.struct(F.lit(0).alias("by_title"), "first").alias("first"))
    for more in (by_title, by_year):
        found = found.unionByName(more.select("decision_id", F.struct(F.lit(1).alias("by_title"), "first").alias("first")))
    return found.groupBy("decision_id").agg(F.min("first")["first"]["id"].alias("winner_pub_id"))


def _best_matches(works: DataFrame, wanted: DataFrame, own: list[str]) -> DataFrame:
    """For each work (and each value of ``own``, columns of ``wanted``) its best row of ``wanted``: by DOI key before title (and d_year if given, only for rows without a DOI), then the newest, then the highest decision_id.

    The best row of each key is found before the join, so a work meets three rows at most of each value of ``own``.
    """
    newest = [F.col("updated_at"), F.col("decision_id")]
    untold = wanted.filter("d_doi is null")
    ways = [
        (1, wanted.drop("d_title", "d_year"), {"d_doi": "doi_key"}),
        (0, untold.filter("d_year is null").drop("d_doi", "d_year"), {"d_title": "norm_title"}),
        (0, untold.filter("d_year is not null").drop("d_doi"), {"d_title": "norm_title", "d_year": "year"}),
    ]
    found = None
    for by_doi, rows, keys in ways:
        best = _best(rows.dropna(subset=list(keys)), [*keys, *own], newest)
        fit = works.select("pub_id", *[F.col(c).alias(k) for k, c in keys.items()]).join(best, list(keys)).drop(*keys).withColumn("by_doi", F.lit(by_doi))
        found = fit if found is None else found.unionByName(fit)
    return _best(found, ["pub_id", *own], [F.col("by_doi"), *newest])


def durable_decisions(works: DataFrame, decisions: DataFrame) -> DataFrame:
    """(pub_id, mode, winner_pub_id): the best active decision of each work whose winner, if it needs one, exists."""
    rows = decisions.filter("active").select(
        "decision_id", "mode", "updated_at", text.doi_key(F.col("doi")).alias("d_doi"), text.title_key(F.col("title")).alias("d_title"), F.col("year").alias("d_year"),
        text.doi_key(F.col("winner_doi")).alias("w_doi"), text.title_key(F.col("winner_title")).alias("w_title"), F.col("winner_year").alias("w_year"),
    )
    rows = settled(rows, "decisions")
    winners = _winners(works, rows.select("decision_id", "w_doi", "w_title", "w_year"))
    usable = rows.drop("w_doi", "w_title", "w_year").join(winners, "decision_id", "left").filter((F.col("mode") == "keep_separate") | F.col("winner_pub_id").isNotNull())
    best = _best_matches(works, settled(usable, "usable"), [])
    return best.select("pub_id", F.col("mode").alias("d_mode"), F.when(F.col("mode") != "keep_separate", F.col("winner_pub_id")).alias("d_winner"), "decision_id")


def memberships(works: DataFrame, decisions: DataFrame, overrides: DataFrame, transitive: bool = False) -> DataFrame:
    """pub_id, dedup_key, canonical_pub_id, group_size, is_canonical, canonical_locked, confirm_decision_id.

    Precedence: the key's confirmed winner (of the newest decision), itself if others merge to it, its
    merge target, the automatic winner (not a preprint with unknown last, manual or funded provenance,
    unversioned DOI, least id). Excluded types vanish, even as targets. Rules are not chained; with
    ``transitive`` they are followed to their end, and a cycle ends at its least id.
    """
    rows = _keyed_once(works)
    ids = overrides.select("pub_id", F.col("mode").alias("o_mode"), F.col("winner_pub_id").alias("o_winner"))
    typed = rows.join(ids, "pub_id", "left").join(durable_decisions(rows, decisions), "pub_id", "left")
    mode = F.coalesce("o_mode", "d_mode")
    winner = F.when(F.col("o_mode").isNotNull(), F.col("o_winner")).otherwise(F.col("d_winner"))
    own_key = F.concat(F.lit("#pub:"), F.col("pub_id"))
    # titles can be long: from here on a key of fixed size stands for them
    key = F.when(mode == "keep_separate", F.concat(F.coalesce("norm_title", F.lit("")), own_key)).otherwise(F.coalesce("norm_title", own_key))
    funded = F.coalesce(F.col("provenance").ilike("%manual%") | F.col("provenance").ilike("%funding%"), F.lit(False))
    versioned = F.coalesce(F.col("doi").rlike(r"(?i)[/._]v[0-9]+$"), F.lit(False))
    order = F.struct(false_null_true(F.col("is_preprint")).alias("a"), (~funded).cast("int").alias("b"), versioned.cast("int").alias("c"), F.col("pub_id").alias("id"))
    base = typed.filter(~excluded_type(F.col("payload"))).select("pub_id", "decision_id", mode.alias("mode"), winner.alias("winner"), F.sha2(key, 256).alias("dedup_key"), order.alias("order"))
    base = settled(base, "members")
    ids = base.select(F.col("pub_id").alias("winner"))
    confirmed = base.filter("mode = 'confirm_winner'").withColumn("winner", F.coalesce("winner", "pub_id")).join(ids, "winner", "left_semi")
    confirmed = top_per_group(confirmed, ["dedup_key"], [F.col("decision_id").desc_nulls_last(), F.col("pub_id").desc()]).select("dedup_key", F.col("winner").alias("confirmed"), F.col("decision_id").alias("confirm_decision_id"))
    automatic = base.groupBy("dedup_key").agg(F.min("order")["id"].alias("automatic"))
    merges = base.filter("mode = 'merge_to'").join(ids, "winner", "left_semi")
    targets = merges.select(F.col("winner").alias("pub_id"), F.lit(True).alias("is_target")).distinct()
    mapped = base.join(automatic, "dedup_key").join(confirmed, "dedup_key", "left").join(targets, "pub_id", "left").join(merges.select("pub_id", F.col("winner").alias("merged_to")), "pub_id", "left")
    itself = F.when(F.col("is_target"), F.col("pub_id"))
    chosen = F.coalesce("confirmed", *((F.col("merged_to"), itself) if transitive else (itself, F.col("merged_to"))), "automatic")
    out = mapped.select("pub_id", "dedup_key", chosen.alias("canonical_pub_id"), F.col("confirmed").isNotNull().alias("canonical_locked"), "confirm_decision_id")
    out = _followed(out) if transitive else settled(out, "mapped")
    sizes = out.groupBy("canonical_pub_id").agg(F.count(F.lit(1)).alias("group_size"))
    return out.join(sizes, "canonical_pub_id").select("pub_id", "dedup_key", "canonical_pub_id", "group_size", (F.col("pub_id") == F.col("canonical_pub_id")).alias("is_canonical"), "canonical_locked", "confirm_decision_id")


def _followed(members: DataFrame) -> DataFrame:
    """Canonical ids followed to the end of their chain by doubling steps: log2 of the longest possible chain rounds."""
    members = settled(members, "chained")
    held = members.select(F.col("canonical_pub_id").alias("pub_id")).distinct()
    hop = settled(members.join(held, "pub_id", "left_semi").filter("pub_id <> canonical_pub_id").select(F.col("pub_id").alias("at"), F.col("canonical_pub_id").alias("to"), F.least("pub_id", "canonical_pub_id").alias("least")), "hops")
    n = hop.count()
    if not n:
        return members
    for _ in range(n.bit_length() + 1):  # after 2**k hops every walk is at a root or in a cycle
        more = hop.select(F.col("at").alias("to"), F.col("to").alias("next"), F.col("least").alias("next_least"))
        hop = settled(hop.join(more, "to", "left").select("at", F.coalesce("next", "to").alias("to"), F.least("least", "next_least").alias("least")), "hops")
    # an end that still hops is in a cycle, and its walk has seen the whole cycle
    ends = hop.select(F.col("at").alias("to"), F.col("least").alias("cycle"))
    ends = hop.join(ends, "to", "left").select(F.col("at").alias("canonical_pub_id"), F.coalesce("cycle", "to").alias("end"))
    return members.join(ends, "canonical_pub_id", "left").withColumn("canonical_pub_id", F.coalesce("end", "canonical_pub_id")).drop("end")


def policy_score(durable_winner: Column | None = None) -> list[Column]:
    """The merge policy as sort keys, best first: the durable winner, published before unknown before preprint, DOI, trusted source, more tokens, more that say more, year, venue, least id."""
    published = F.when(F.col("is_preprint").isNull(), 1).when(F.col("is_preprint"), 0).otherwise(2)
    said = token_list(F.col("provenance"))
    first = F.lit(0) if durable_winner is None else (~F.coalesce(F.col("pub_id") == durable_winner, F.lit(False))).cast("int")
    has = lambda c: -F.coalesce(c, F.lit(False)).cast("int")
    return [first, -published, has(text.normalize_doi(F.col("doi")).isNotNull()), best_rank(F.col("provenance")), -F.greatest(F.size(F.array_distinct(said)), F.lit(1)), -F.size(F.filter(said, lambda t: F.contains(t, F.lit("-")))), has(F.col("year").isNotNull()), has(F.col("venue") != ""), F.col("pub_id")]


def policy_winner(works: DataFrame, group: str, durable_winner: str | None = None) -> DataFrame:
    """The merge policy's winner of each group, by :func:`policy_score`; ``durable_winner`` names a column with the curators' choice."""
    return works.groupBy(group).agg(first_by(F.col("pub_id"), *policy_score(F.col(durable_winner) if durable_winner else None)).alias("winner_pub_id"))


def clean_list(works: DataFrame, members: DataFrame, authorships: DataFrame, people: DataFrame) -> DataFrame:
    """Canonical works with the names and affiliations of the internal authors of their whole group."""
    own = authorships.filter("person_id is not null and is_internal is true").select("pub_id", "person_id", F.coalesce("paper_affiliation", F.array_join("affiliations", "; ")).alias("affiliation"))
    rows = members.select("pub_id", "canonical_pub_id").join(own, "pub_id").join(people.select("person_id", "display_name"), "person_id", "left")
    gathered = rows.groupBy(F.col("canonical_pub_id").alias("pub_id")).agg(ordered_text(F.col("display_name"), ", ").alias("internal_authors"), ordered_text(F.col("affiliation"), "; ").alias("internal_affiliations"))
    kept = members.filter("is_canonical").select("pub_id", "group_size", "canonical_locked", "confirm_decision_id")
    return works.join(kept, "pub_id").join(gathered, "pub_id", "left")


def scope_matches(works: DataFrame, scopes: DataFrame) -> DataFrame:
    """pub_id, decision_id, scope_type, person_id, mode, note: each work's one active decision of a scope (and person): by DOI before title, then the newest."""
    return _scoped(_keyed_once(works.select("pub_id", "doi", "title", "year")), scopes.filter("active"))


def _global(works: DataFrame, scopes: DataFrame) -> DataFrame:
    """:func:`scope_matches` of the global scope: no other scope's decisions have a part in it."""
    keys = _keyed_once(works.select("pub_id", "doi", "title", "year"))
    return _scoped(keys, scopes.filter("active and scope_type = 'global' and coalesce(person_id, 0) = 0")).filter("person_id is null")


def _scoped(works: DataFrame, scopes: DataFrame) -> DataFrame:
    rows = scopes.select("decision_id", "scope_type", "person_id", "mode", "note", "updated_at", text.doi_key(F.col("doi")).alias("d_doi"), text.title_key(F.col("title")).alias("d_title"), F.col("year").alias("d_year"))
    rows = settled(rows.withColumn("person", F.coalesce("person_id", F.lit(0))), "scopes")
    best = _best_matches(works, rows, ["scope_type", "person"])
    return best.select("pub_id", "decision_id", "scope_type", "person_id", "mode", "note")


def canon(works: DataFrame, members: DataFrame, scopes: DataFrame) -> DataFrame:
    """Canonical works: not preprints, not excluded, and included or with an attributed member; provisional without DOI. Adds scope_mode and scope_decision_id."""
    return _canon(works, members, _global(works, scopes))


def _canon(works: DataFrame, members: DataFrame, decided: DataFrame) -> DataFrame:
    decided = decided.select("pub_id", F.col("mode").alias("scope_mode"), F.col("decision_id").alias("scope_decision_id"))
    attributed = members.select("pub_id", "canonical_pub_id").join(works.filter("attributed").select("pub_id"), "pub_id", "left_semi").select(F.col("canonical_pub_id").alias("pub_id")).distinct().withColumn("group_attributed", F.lit(True))
    rows = works.join(members.filter("is_canonical").select("pub_id"), "pub_id", "left_semi").filter("is_preprint is not true")
    rows = rows.join(decided, "pub_id", "left").join(attributed, "pub_id", "left").filter("scope_mode is distinct from 'exclude' and (scope_mode = 'include' or group_attributed)")
    return rows.drop("group_attributed").withColumn("provisional", F.col("doi").isNull())


def dated(clean: DataFrame, payloads: DataFrame) -> DataFrame:
    """Clean works with pub_date, pub_month, pub_day and pub_date_precision from their payloads (pub_id, payload)."""
    rows = clean.drop("payload").join(payloads.select("pub_id", F.col("payload").alias("__payload")), "pub_id", "left")
    day, precision = dates.publication_date(F.col("__payload"), F.col("year"))
    rows = rows.withColumn("pub_date", day).withColumn("pub_date_precision", precision).drop("__payload")
    return rows.withColumn("pub_month", F.month("pub_date")).withColumn("pub_day", F.day("pub_date"))


def person_coverage(person_id: int, works: DataFrame, members: DataFrame, authorships: DataFrame, scopes: DataFrame) -> DataFrame:
    """Where each work of one person stands: status (in_canon, excluded_manually, preprint_only, missing_institution_signal,
    outside_dedup_universe) and whether its date lies between the person's first and last canonical ones."""
    own = settled(authorships.filter(F.col("person_id") == person_id).select("pub_id").distinct(), "own")
    members, matched = settled(members, "members"), settled(_global(works, scopes), "matched")
    mine = own.join(members.select("pub_id", F.col("canonical_pub_id").alias("winner")), "pub_id", "left")
    winners = mine.filter("winner is not null").select(F.col("winner").alias("pub_id")).distinct()
    kept = works.join(members.filter("is_canonical").select("pub_id", "group_size"), "pub_id").join(winners, "pub_id", "left_semi")
    in_canon = _canon(works, members, matched).select("pub_id", F.lit(True).alias("is_canon"))
    decided = matched.select("pub_id", F.col("mode").alias("scope_mode"), F.col("note").alias("scope_note"))
    status = F.when(F.col("is_canon"), "in_canon").when(F.col("scope_mode") == "exclude", "excluded_manually").when(F.col("is_preprint"), "preprint_only").otherwise("missing_institution_signal")
    columns = ["pub_id", "title", "year", "pub_date", "pub_date_precision", "venue", "doi", "provenance", "group_size", "scope_note", "status"]
    rows = dated(kept, works).join(in_canon, "pub_id", "left").join(decided, "pub_id", "left").withColumn("status", status).select(*columns)
    rows = settled(rows, "coverage")  # read for the rows and for the person's first and last dates
    kind = F.coalesce(F.get_json_object("payload", "$.crossref.type"), F.get_json_object("payload", "$.openalex.type"))
    outside = works.join(mine.filter("winner is null").select("pub_id"), "pub_id", "left_semi").select(
        "pub_id", "title", "year", F.lit(None).cast("date").alias("pub_date"), F.lit(None).cast("string").alias("pub_date_precision"), "venue", "doi", "provenance",
        F.lit(None).cast("long").alias("group_size"), kind.alias("scope_note"), F.lit("outside_dedup_universe").alias("status"),
    )
    every = rows.unionByName(outside)
    window = rows.filter("status = 'in_canon'").agg(F.min("pub_date").alias("first_canon_date"), F.max("pub_date").alias("last_canon_date"))
    placed = every.crossJoin(F.broadcast(window))  # one row
    position = F.when(F.col("pub_date").isNull(), "undated").when(F.col("pub_date").between(F.col("first_canon_date"), F.col("last_canon_date")), "in_window").otherwise("outside_window")
    return placed.withColumn("window_position", position).orderBy(F.col("status") == "in_canon", F.col("pub_date").asc_nulls_last(), "pub_id")


def attribution(works: DataFrame, rules: DataFrame) -> DataFrame:
    """works with ``attributed``: an active rule's pattern is in the payload (funding rules look at provenance too). Rules are few: a broadcast of checked size."""
    active = rules.filter("active").select(F.btrim(F.lower("pattern")).alias("p")).filter("p <> ''").distinct()
    patterns = [r[0] for r in active.limit(MAX_RULES + 1).collect()]
    if len(patterns) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} attribution rules")
    body = works.drop("attributed").withColumn("__body", F.lower("payload"))
    hit = F.lit(False)
    for lo in range(0, len(patterns), 100):  # code-generated tests of one lowered column, as a balanced tree
        hit = hit | _any([F.contains(F.col("__body"), F.lit(p)) for p in patterns[lo : lo + 100]])
    return body.withColumn("attributed", F.coalesce(hit, F.lit(False))).drop("__body")


#: Rules are written by hand; the bound keeps their broadcast and the expression small.
MAX_RULES = 10_000


def _any(tests: list[Column]) -> Column:
    while len(tests) > 1:
        tests = [tests[k] | tests[k + 1] if k + 1 < len(tests) else tests[k] for k in range(0, len(tests), 2)]
    return tests[0]


def changed_attribution(works: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: how many works' attribution the rules would change."""
    new = attribution(works, rules).select("pub_id", F.col("attributed").alias("now"))
    return works.select("pub_id", "attributed").join(new, "pub_id").agg(F.count_if(~F.col("attributed").eqNullSafe(F.col("now"))).alias("changed"))


def coverage(works: DataFrame) -> DataFrame:
    """pub_id, doi, title, year, and the source families and tokens of each work, by id."""
    f, t = families(F.col("provenance")), F.array_sort(tokens(F.col("provenance")))
    return works.select("pub_id", "doi", "title", "year", F.size(f).alias("n_source_families"), F.array_join(f, "+").alias("source_families"), F.array_join(t, "+").alias("source_tokens")).orderBy("pub_id")


def coverage_summary(works: DataFrame) -> DataFrame:
    """(metric, value): works, works of each family, works of one family, and how many have each breadth."""
    rows = works.select(families(F.col("provenance")).alias("f"))
    total = rows.agg(F.count(F.lit(1)).alias("value")).select(F.lit("total_canonical_publications").alias("metric"), "value")
    each = rows.select(F.explode("f").alias("x")).groupBy("x").count().select(F.concat(F.lit("publications_with_family="), F.col("x")).alias("metric"), F.col("count").alias("value"))
    single = rows.agg(F.count_if(F.size("f") == 1).alias("value")).select(F.lit("single_source_publications").alias("metric"), "value")
    breadth = rows.groupBy(F.size("f").alias("n")).count().select(F.concat(F.lit("publications_with_n_families="), F.col("n")).alias("metric"), F.col("count").alias("value"))
    return total.unionByName(each).unionByName(single).unionByName(breadth).orderBy("metric")


def key_match(works: DataFrame, wanted: DataFrame) -> DataFrame:
    """Works that agree with a wanted row in DOI key or else title key; both sides carry doi_key and norm_title."""
    w = wanted.select(F.col("doi_key").alias("w_doi"), F.col("norm_title").alias("w_title"), "wanted_id")
    return or_equi_join(works, w, F.col("doi_key") == F.col("w_doi"), F.col("norm_title") == F.col("w_title"))
