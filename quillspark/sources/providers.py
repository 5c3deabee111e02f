"""Rows from the JSON payloads of metadata providers: one work per payload, one row per author."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import dates, text
from quillspark.operators.relational import ordered_set

_CROSSREF = "struct<DOI:string,type:string,title:array<string>,`container-title`:array<string>,issued:struct<`date-parts`:array<array<int>>>,author:array<struct<given:string,family:string,name:string,ORCID:string,affiliation:array<struct<name:string>>>>>"
_OPENALEX = "struct<id:string,doi:string,title:string,type:string,publication_year:int,primary_location:struct<source:struct<display_name:string>>,authorships:array<struct<raw_author_name:string,author:struct<display_name:string,orcid:string>,raw_affiliation_strings:array<string>,institutions:array<struct<display_name:string>>,is_corresponding:boolean>>>"
_DATACITE = "struct<id:string,attributes:struct<doi:string,titles:array<struct<title:string>>,publisher:string,container:struct<title:string>,publicationYear:int,types:struct<resourceTypeGeneral:string>,creators:array<struct<name:string,givenName:string,familyName:string,nameIdentifiers:array<struct<nameIdentifier:string,nameIdentifierScheme:string>>,affiliation:array<string>>>>>"
_SEMANTIC = "struct<paperId:string,externalIds:struct<DOI:string>,title:string,venue:string,publicationVenue:struct<name:string>,year:int,publicationTypes:array<string>,authors:array<struct<authorId:string,name:string,affiliations:array<string>,externalIds:struct<ORCID:string>>>>"
_ORCID_WORK = "struct<`put-code`:bigint,type:string,title:struct<title:struct<value:string>>,`publication-date`:struct<year:struct<value:string>,month:struct<value:string>,day:struct<value:string>>,`external-ids`:struct<`external-id`:array<struct<`external-id-type`:string,`external-id-value`:string>>>,contributors:struct<contributor:array<struct<`credit-name`:struct<value:string>,`contributor-orcid`:struct<path:string>>>>>"

_DBLP = "struct<title:string,year:string,type:string,doi:string,ee:variant,venue:variant,booktitle:variant,journal:variant,series:variant,authors:struct<author:variant>>"

#: DOI prefixes of preprint servers, record types of preprints, and words of venues or titles that speak of them.
PREPRINT_PREFIXES = ["10.1101/", "10.21203/", "10.2139/", "10.48550/"]
PREPRINT_TYPES = ["posted-content", "report"]
PREPRINT_WORDS = ["arxiv", "biorxiv", "medrxiv", "preprint", "research square", "ssrn"]


def _or_null(x: Column) -> Column:
    y = F.btrim(x)
    return F.when(y != "", y)


def guess_preprint(doi: Column, kind: Column, venue: Column, title: Column, types: list[str] | None = None) -> Column:
    """A preprint server's DOI, a type that says so, or a venue or title that speaks of one."""
    by_doi = F.exists(F.array(*[F.lit(p) for p in PREPRINT_PREFIXES]), lambda p: F.startswith(F.coalesce(text.normalize_doi(doi), F.lit("")), p))
    said = F.lower(F.concat_ws(" ", venue, title))
    by_words = F.exists(F.array(*[F.lit(w) for w in PREPRINT_WORDS]), lambda w: F.contains(said, w))
    return by_doi | F.coalesce(F.lower(kind).isin(types or PREPRINT_TYPES), F.lit(False)) | by_words


def _texts(value: Column) -> Column:
    """The texts of a JSON value that may be one text or a list of them."""
    many = F.try_variant_get(value, "$", "array<string>")
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), many).when(value.isNotNull(), F.array(F.try_variant_get(value, "$", "string")))


def _first_text(*values: Column) -> Column:
    return F.coalesce(*[F.get(F.filter(_texts(v), lambda t: text.nonblank(t)), F.lit(0)) for v in values])


def works(payloads: DataFrame, source: str, column: str = "payload") -> DataFrame:
    """payload_id, doi, title, year, venue, is_preprint of payloads (payload_id, JSON)."""
    schema = {"crossref": _CROSSREF, "openalex": _OPENALEX, "datacite": _DATACITE, "semantic": _SEMANTIC, "orcid": _ORCID_WORK, "dblp": _DBLP}[source]
    df = payloads.select("payload_id", F.col(column).alias("body"), F.from_json(column, schema).alias("p"))
    types = {"openalex": [*PREPRINT_TYPES, "preprint"], "datacite": [*PREPRINT_TYPES, "preprint"]}.get(source)
    if source == "crossref":
        doi, title, venue, kind = F.col("p.DOI"), F.get("p.title", F.lit(0)), F.get("p.container-title", F.lit(0)), F.col("p.type")
        year = F.year(dates.picked_date(F.col("body")))
    elif source == "openalex":
        doi, title, venue, kind, year = F.col("p.doi"), F.col("p.title"), F.col("p.primary_location.source.display_name"), F.col("p.type"), F.col("p.publication_year")
    elif source == "datacite":
        a = "p.attributes."
        doi, title, kind, year = F.col(a + "doi"), F.get(F.col(a + "titles.title"), F.lit(0)), F.col(a + "types.resourceTypeGeneral"), F.col(a + "publicationYear")
        venue = F.coalesce(a + "container.title", a + "publisher")
    elif source == "semantic":
        doi, title, kind, year = F.col("p.externalIds.DOI"), F.col("p.title"), F.array_join("p.publicationTypes", ","), F.col("p.year")
        venue = F.coalesce(_or_null(F.col("p.publicationVenue.name")), _or_null(F.col("p.venue")))
    elif source == "dblp":
        kind, year = F.col("p.type"), F.regexp_extract("p.year", r"(\d{4})", 1).try_cast("int")
        title, venue = text.bibliography_title(F.col("p.title")), _first_text(F.col("p.venue"), F.col("p.booktitle"), F.col("p.journal"), F.col("p.series"))
        link = F.get(F.filter(_texts(F.col("p.ee")), lambda u: F.contains(u, F.lit("doi.org/")) | F.startswith(F.lower(u), F.lit("doi:"))), F.lit(0))
        doi = F.coalesce(_or_null(F.col("p.doi")), link)
    else:
        ids = F.filter(F.col("p.external-ids.external-id"), lambda x: F.lower(x["external-id-type"]) == "doi")
        doi, title, venue, kind = F.get(ids, F.lit(0))["external-id-value"], F.col("p.title.title.value"), F.lit(None).cast("string"), F.col("p.type")
        year = dates.first_number(F.col("p.publication-date.year.value"))
    doi = text.normalize_doi(doi)
    return df.select("payload_id", doi.alias("doi"), _or_null(title).alias("title"), year.cast("int").alias("year"), _or_null(venue).alias("venue"), guess_preprint(doi, kind, venue, title, types).alias("is_preprint"))


def authors(payloads: DataFrame, source: str, column: str = "payload", keep_empty: bool = False) -> DataFrame:
    """payload_id, position (from 1), name, orcid, affiliations; a payload without authors has no row, or one of nulls with ``keep_empty``."""
    schema, path = {"crossref": (_CROSSREF, "p.author"), "openalex": (_OPENALEX, "p.authorships"), "datacite": (_DATACITE, "p.attributes.creators"), "semantic": (_SEMANTIC, "p.authors"), "orcid": (_ORCID_WORK, "p.contributors.contributor"), "dblp": (_DBLP, "p.authors.author")}[source]
    df = payloads.select("payload_id", F.from_json(column, schema).alias("p"))
    listed = F.col(path)
    if source == "dblp":  # one author or a list, each a text or an object
        one = F.when(F.schema_of_variant(listed).startswith("ARRAY"), F.try_variant_get(listed, "$", "array<variant>")).when(listed.isNotNull(), F.array(listed))
        listed = F.transform(one, lambda a: F.struct(F.coalesce(F.try_variant_get(a, "$.text", "string"), F.try_variant_get(a, "$.name", "string"), F.when(F.schema_of_variant(a) == "STRING", F.try_variant_get(a, "$", "string"))).alias("name")))
    df = df.select("payload_id", (F.posexplode_outer(listed) if keep_empty else F.posexplode(listed)).alias("k", "a"))
    full = lambda given, last: _or_null(F.concat_ws(" ", _or_null(F.col(given)), _or_null(F.col(last))))
    none = F.array().cast("array<string>")
    if source == "crossref":
        name, orcid, places = F.coalesce(full("a.given", "a.family"), _or_null(F.col("a.name"))), F.col("a.ORCID"), F.col("a.affiliation.name")
    elif source == "openalex":
        name, orcid = F.coalesce(_or_null(F.col("a.raw_author_name")), _or_null(F.col("a.author.display_name"))), F.col("a.author.orcid")
        places = F.when(F.size("a.raw_affiliation_strings") > 0, F.col("a.raw_affiliation_strings")).otherwise(F.col("a.institutions.display_name"))
    elif source == "datacite":
        name = F.coalesce(full("a.givenName", "a.familyName"), _or_null(F.col("a.name")))
        orcid = F.get(F.filter("a.nameIdentifiers", lambda x: F.lower(x["nameIdentifierScheme"]) == "orcid"), F.lit(0))["nameIdentifier"]
        places = F.transform("a.affiliation", lambda x: F.when(F.startswith(x, F.lit("{")), F.get_json_object(x, "$.name")).otherwise(x))
    elif source == "dblp":
        name, orcid, places = _or_null(F.col("a.name")), F.lit(None).cast("string"), none
    elif source == "semantic":
        name, orcid, places = _or_null(F.col("a.name")), F.col("a.externalIds.ORCID"), F.col("a.affiliations")
    else:
        name, orcid, places = _or_null(F.col("a.credit-name.value")), F.col("a.contributor-orcid.path"), none
    places = F.array_distinct(F.filter(F.coalesce(places, none), lambda x: F.btrim(x) != ""))
    return df.select("payload_id", (F.col("k") + 1).alias("position"), name.alias("name"), text.normalize_orcid(orcid).alias("orcid"), places.alias("affiliations"))


def orcid_works(records: DataFrame, column: str = "payload") -> DataFrame:
    """person_orcid, put_code, title, year, doi (lower case), type of the works of ORCID records (person_orcid, JSON): one row for each summary of each group."""
    summary = "struct<`put-code`:bigint,type:string,title:struct<title:struct<value:string>>,`publication-date`:struct<year:struct<value:string>>,`external-ids`:struct<`external-id`:array<struct<`external-id-type`:string,`external-id-value`:string>>>>"
    rows = records.select("person_orcid", F.explode(F.from_json(column, f"struct<group:array<struct<`work-summary`:array<{summary}>>>>")["group"]).alias("g"))
    rows = rows.select("person_orcid", F.explode("g.work-summary").alias("s")).filter("s is not null")
    doi = F.get(F.filter(F.col("s.external-ids.external-id"), lambda x: F.lower(x["external-id-type"]) == "doi"), F.lit(0))["external-id-value"]
    return rows.select("person_orcid", F.col("s.put-code").alias("put_code"), F.col("s.title.title.value").alias("title"), F.col("s.publication-date.year.value").alias("year"), F.lower(doi).alias("doi"), F.col("s.type").alias("type"))


def since(works_: DataFrame, year: int) -> DataFrame:
    """Works of a year or later; those without one stay."""
    n = dates.first_number(F.col("year").cast("string"))
    return works_.filter(n.isNull() | (n >= year))


def employments(records: DataFrame, patterns: list[str], column: str = "payload") -> DataFrame:
    """person_orcid, org_name, department, role_title, start_date, end_date, is_current of ORCID employments at organisations that match a pattern.

    Both shapes are read: groups of summaries, and summaries listed directly (one or several).
    """
    body = F.parse_json(F.col(column))
    groups = F.try_variant_get(body, "$['affiliation-group']", "array<variant>")
    grouped = F.flatten(F.transform(groups, lambda g: F.coalesce(F.try_variant_get(g, "$.summaries", "array<variant>"), F.array().cast("array<variant>"))))
    grouped = F.transform(grouped, lambda x: F.try_variant_get(x, "$['employment-summary']", "variant"))
    direct = []
    for key in ("employment-summary", "employment-summaries"):
        v = F.try_variant_get(body, f"$['{key}']", "variant")
        direct.append(F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(F.schema_of_variant(v).startswith("OBJECT"), F.array(v)))
    none = F.array().cast("array<variant>")
    every = F.concat(*[F.coalesce(x, none) for x in (grouped, *direct)])
    rows = records.select("person_orcid", F.explode(every).alias("e")).filter("e is not null")
    rows = rows.select("person_orcid", F.from_json(F.to_json("e"), "struct<organization:struct<name:string>,`department-name`:string,`role-title`:string,`start-date`:string,`end-date`:string>").alias("e"))
    start, end = dates.partial_iso(F.col("e.start-date")), dates.partial_iso(F.col("e.end-date"))
    rows = rows.filter(text.org_match(F.col("e.organization.name"), patterns))
    return rows.select("person_orcid", F.col("e.organization.name").alias("org_name"), F.col("e.department-name").alias("department"), F.col("e.role-title").alias("role_title"), start.alias("start_date"), end.alias("end_date"), (start.isNotNull() & end.isNull()).alias("is_current"))


def verified_emails(records: DataFrame, column: str = "payload") -> DataFrame:
    """person_orcid and the addresses of a person record that are verified and public."""
    kind = "struct<emails:struct<email:array<struct<email:string,verified:boolean,visibility:string>>>>"
    listed = F.from_json(column, kind)["emails"]["email"]
    good = F.filter(listed, lambda e: F.coalesce(e["verified"] & (F.lower(e["visibility"]) == "public") & (e["email"] != ""), F.lit(False)))
    return records.select("person_orcid", F.coalesce(F.transform(good, lambda e: e["email"]), F.array().cast("array<string>")).alias("emails"))


def rights_tier(license_: Column) -> Column:
    """explicit_open_license for public domain and ``cc-`` licences, license_missing for none, else source_terms_review."""
    low = F.lower(F.coalesce(license_, F.lit("")))
    return F.when((low == "public-domain") | low.like("cc-%"), "explicit_open_license").when(F.btrim(low) == "", "license_missing").otherwise("source_terms_review")


def open_access(works_: DataFrame, column: str = "payload") -> DataFrame:
    """pub_id, openalex_id, oa_status, pdf_url, landing page, licence and rights tier of open works with a PDF: the best location's, else the first location's that has one."""
    loc = "struct<pdf_url:string,landing_page_url:string,license:string,version:string>"
    p = F.from_json(F.get_json_object(column, "$.openalex"), f"struct<id:string,open_access:struct<is_oa:boolean,oa_status:string>,best_oa_location:{loc},locations:array<{loc}>>")
    df = works_.select("pub_id", p.alias("p")).filter("p.open_access.is_oa")
    places = F.concat(F.array("p.best_oa_location"), F.coalesce("p.locations", F.array().cast(f"array<{loc}>")))
    df = df.withColumn("l", F.get(F.filter(places, lambda x: text.nonblank(x["pdf_url"])), F.lit(0))).filter("l is not null")
    return df.select("pub_id", F.col("p.id").alias("openalex_id"), F.col("p.open_access.oa_status").alias("oa_status"), F.col("l.pdf_url").alias("pdf_url"), F.col("l.landing_page_url").alias("pdf_landing_page_url"), F.col("l.license").alias("pdf_license"), F.col("l.version").alias("pdf_version"), rights_tier(F.col("l.license")).alias("rights_tier"))


def member_open_access(works_: DataFrame, curated: DataFrame, persons: DataFrame, orcids: DataFrame, column: str = "payload") -> DataFrame:
    """:func:`open_access` of works with internal persons (of curated authorships): member_count, member_person_ids and members as ordered JSON."""
    linked = curated.select("pub_id", "person_id").distinct().join(persons.filter("person_kind = 'internal'").select("person_id", "display_name"), "person_id")
    known = orcids.groupBy("person_id").agg(ordered_set(F.col("orcid")).alias("orcids"))
    rows = linked.join(known, "person_id", "left").withColumn("orcids", F.coalesce("orcids", F.array().cast("array<string>")))
    members = rows.groupBy("pub_id").agg(F.sort_array(F.collect_list(F.struct("person_id", "display_name", "orcids"))).alias("m"))
    members = members.select("pub_id", F.size("m").alias("member_count"), F.transform("m", lambda x: x["person_id"]).alias("member_person_ids"), F.to_json("m").alias("members"))
    return open_access(works_, column).join(members, "pub_id")


def landed_pages(pages: DataFrame, max_records: int | None = None) -> DataFrame:
    """(place, item) of landed result pages (page, cursor, items: array of JSON), in order: pages end at the first that is empty or whose cursor came before; the first ``max_records`` items count.

    Only page numbers, cursors and sizes are compared in one place, not the items.
    """
    from pyspark.sql import Window

    head = pages.select("page", F.size("items").alias("n"), F.row_number().over(Window.partitionBy("cursor").orderBy("page")).alias("again"))
    stop = head.filter("n = 0 or again > 1").agg(F.min("page").alias("stop"))
    before = Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    kept = head.crossJoin(F.broadcast(stop)).filter("stop is null or page < stop").select("page", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rows = pages.join(F.broadcast(kept), "page").select("start", F.posexplode("items").alias("k", "item")).select((F.col("start") + F.col("k")).cast("long").alias("place"), "item")
    return rows if max_records is None else rows.filter(F.col("place") < max_records)


def year_between(year: Column, low: int | None, high: int | None) -> Column:
    """A year within bounds; no year passes only if there are none."""
    if low is None and high is None:
        return F.lit(True)
    test = F.lit(True) if low is None else year >= low
    test = test if high is None else test & (year <= high)
    return F.coalesce(test, F.lit(False))
