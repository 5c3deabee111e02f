"""Record operators that no query reaches: files, request builders, job configurations, curators' writes, person search."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import dates, payloads, text
from quillspark.plans import canonical, curation, people, works
from quillspark.sources import files, providers, requests
from quillspark.streaming import refresh


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_request_builders():
    assert requests.crossref_filter("A1", "F", None, 2000, 2001) == "award.number:A1,funder:F,from-pub-date:2000-01-01,until-pub-date:2001-12-31"
    assert requests.crossref_filter() is None and requests.openalex_filter("award") == ""
    specs = list(requests.crossref_specs(["a", "b"], ["Uni X"], [], ["0"], "both"))
    assert specs == [{"filter": f"award.number:{x},orcid:0", "query.affiliation": "Uni X", "query": x} for x in "ab"]
    assert list(requests.crossref_specs([], [], [], [])) == [{}]
    assert list(requests.openalex_specs(["a"], [], "awards.id", "query")) == [("", "a")]
    assert requests.datacite_query("q", titles=["A b", 'say "x" y'], awards=["z"]) == '(q) AND ("A b" OR "say \\"x\\" y") AND z'
    assert requests.dblp_query(authors=["Ann Lee", " "], series=["lncs", "journals/x", "stream:y"], dois=["10.1/a"]) == 'author:"Ann Lee" AND (stream:series/lncs OR stream:journals/x OR stream:y) AND doi:10.1/a'
    assert requests.dblp_query(series=["a b"], series_mode="field") == 'series:"a b"' and requests.semantic_query("q", [" T "], ["u"]) == '(q) "T" u'
    with pytest.raises(ValueError):
        requests.datacite_query(titles=[])
    with pytest.raises(ValueError):
        requests.dblp_query()


def test_jobs_and_pages():
    good = {"name": "n", "source": "s", "scope_type": "query", "module": "m", "scope_key": "k", "stale_after_days": 3, "base_args": ["--affiliation", "x"]}
    job = requests.jobs(json.dumps({"jobs": [good]}))[0]
    assert (job.stale_after, job.limit, job.enabled) == (("days", 3), 20, True)
    assert requests.discovery_verdict(job, 10, 5).startswith("WARN: no --max-new-records cap; any-word")
    bounded = requests.Job("n", "s", "query", "m", ("days", 1), base_args=("--max-new-records", "5"))
    assert [requests.discovery_verdict(bounded, t, 5, e) for t, e in ((9, None), (1, None), (None, "x"))] == ["OK (bounded)", "OK", "ERROR"]
    wrong = [{"scope_type": "x"}, {"stale_after_hours": 2}, {"stale_after_days": None}, {"scope_key": None}, {"limit": 0}, {"limit": True}, {"name": " "}, {"base_args": [1]}, {"scope_type": "person"}]
    for change in wrong:
        with pytest.raises(ValueError):
            requests.jobs(json.dumps({"jobs": [good | change]}))
    for body in ({}, {"jobs": []}, {"jobs": [1]}, {"jobs": [good, good]}):
        with pytest.raises(ValueError):
            requests.jobs(json.dumps(body))
    assert requests.page_parameters([("after", "7"), ("limit", "100")]) == requests.Page(7, 100)
    for pairs in ([("limit", "0")], [("limit", "101")], [("after", "-1")], [("limit", "1"), ("limit", "1")], [("x", "1")], [("limit", "1.0")]):
        with pytest.raises(ValueError):
            requests.page_parameters(pairs)
    assert json.loads(curation.page([{"pub_id": 1}, {"pub_id": 2}], 1)) == {"items": [{"pub_id": 1}], "limit": 1, "next_after": 1}
    assert json.loads(curation.page([], 1))["next_after"] is None


def test_files(spark, tmp_path):
    (tmp_path / "roster.csv").write_text("﻿ORCID, Display_Name ,person_kind\n0000-0002-1825-0097,Ann,internal\nx,Bob,internal\n0000-0002-1825-0098,C,external\n", encoding="utf-8")
    got = {r.line: r.error for r in files.roster(spark, f"file://{tmp_path}/roster.csv").collect()}
    assert got == {2: None, 3: "bad orcid", 4: "bad checksum"}
    with pytest.raises(ValueError):
        files.csv_rows(spark, f"file://{tmp_path}/roster.csv", ["nothing"])
    (tmp_path / "bib.csv").write_text('DOI,Title,Publication Title,Publication Year,Author\n10.1234/A,"T, x",J,2020,"Doe, Jane; Lee, Ann"\n,U,,x,\n')
    assert rows_of(files.bibliography(spark, f"file://{tmp_path}/bib.csv")) == [("10.1234/a", "T, x", "J", 2020, ["Doe, Jane", "Lee, Ann"]), (None, "U", None, None, None)]
    (tmp_path / "pairs.csv").write_text("Loser_Pub_ID,winner_pub_id,note\n1,2,x\n")
    assert rows_of(files.merge_pairs(spark, f"file://{tmp_path}/pairs.csv")) == [(1, 2)]
    (tmp_path / "bad.csv").write_text("loser_pub_id,winner_pub_id\n1,\n")
    with pytest.raises(ValueError):
        files.merge_pairs(spark, f"file://{tmp_path}/bad.csv")
    (tmp_path / "ids.csv").write_text("pub_id\n7\n3\n7\n")
    assert [r.pub_id for r in files.id_file(spark, f"file://{tmp_path}/ids.csv").orderBy("place").collect()] == [7, 3] and files.id_list("3,1\n3") == [3, 1]
    df = spark.createDataFrame([(1, 'a "q", b', None), (2, "", "x\ny")], "a int, b string, c string")
    files.write_named_csv(df.orderBy("a"), f"file://{tmp_path}/out.csv")
    files.write_named_csv(df.orderBy("a"), f"file://{tmp_path}/out.csv")
    assert (tmp_path / "out.csv").read_text() == 'a,b,c\n1,"a ""q"", b",\n2,,"x\ny"\n'
    assert files.has_columns(df, ["a", "b", "c"]) and not files.has_columns(df, ["b", "a", "c"])
    assert files.described({"t": df})[0] == ("t", 1, "a", "int", True)


def test_a_crash_leaves_the_last_snapshot(spark, tmp_path):
    s = files.Snapshots(spark, f"file://{tmp_path}/snap")
    s.publish("2024-01-01", a=spark.range(1))
    with pytest.raises(ZeroDivisionError):
        s.publish("2024-01-02", a=spark.range(2), b=_Broken())
    (tmp_path / "snap" / "draft-x").write_text("half")
    assert s.read("a").count() == 1 and s.manifest()["refreshed_at"] == "2024-01-01"


class _Broken:
    @property
    def write(self):
        return 1 / 0


def test_streaming_helpers(spark):
    log = refresh.run_all({"a": lambda: 1 / 0, "b": lambda: None})
    assert refresh.status_of(log) == 1 and refresh.status_of(log[1:]) == 0
    runs = spark.createDataFrame([("x", "success", None, "2024-01-01")], "job string, status string, error string, at string")
    assert refresh.append_log(runs, log, "2024-02-01").count() == 3
    every = {n: (lambda: None) for n in ("dblp", "openalex", "crossref", "semantic")}
    assert list(refresh.backfill_jobs(every, ["dblp"])) == ["crossref", "openalex", "dblp"]


def test_person_search(spark):
    searches = spark.createDataFrame([(1, "Ann Font Massot", ["example"]), (2, "Bob Ray", []), (3, "Cy", [])], "search_id int, name string, context array<string>")
    hits = spark.createDataFrame(
        [(1, 1, "A", "Amy", "Massot", "Other", []), (1, 2, "B", "Amy", "Massot", "Example", []), (1, 3, None, "Amy", "Massot", "Example", []), (2, 1, "C", "Robert", "Jones", None, ["Bob Ray"]), (3, 1, "D", "X", "Y", None, [])],
        "search_id int, place int, orcid string, given string, family string, institution string, other_names array<string>",
    )
    got = {r.search_id: (r.orcid, r.score, r.fits) for r in people.pick_candidate(searches, hits).collect()}
    assert got == {1: ("B", 1.0, True)}
    loose = {r.search_id: r.orcid for r in people.pick_candidate(searches, hits, least=0.05).collect()}
    assert loose == {1: "B", 2: "C"} and {r.search_id for r in people.pick_candidate(searches, hits, 0.05, True).collect()} == {1}
    asked = people.name_searches(spark.createDataFrame([(1, "Max van der Berg Stone")], "search_id int, name string")).orderBy("place").collect()
    assert [(r.given, r.family) for r in asked] == [("Max van der Berg", "Stone")] and asked[0].place == 1
    umlaut = people.name_searches(spark.createDataFrame([(1, "Müller-Lüd, Jörg")], "search_id int, name string"), most=8).orderBy("place").collect()
    assert len(umlaut) == 8 and (umlaut[0].given, umlaut[0].family) == ("Jörg", "Müller-Lüd")
    persons = spark.createDataFrame([(1, "Jane Doe", "JANE", "doe"), (2, "X", None, None)], "person_id long, display_name string, first_name string, last_name string")
    known = spark.createDataFrame([(1, "J. A. Doe"), (2, "Xavier Young"), (2, "xavier young")], "person_id long, alias_name string")
    assert rows_of(people.search_names(persons, known)) == [(1, 1, "Jane Doe"), (1, 2, "J. A. Doe"), (2, 1, "Xavier Young")]


def test_people_writes(spark):
    persons = spark.createDataFrame([("0000-0002-1825-0097", "Ann Lee", "Ann", "Lee", "internal")], "orcid string, display_name string, first_name string, last_name string, person_kind string")
    roster = spark.createDataFrame([("0000-0002-1825-0097", " ", "Anna", "Leigh", "external", None), ("0000-0002-1694-233X", "", "Bob", "Ray", "internal", None), ("0000-0001-0000-0000", "Bad", "", "", "internal", "bad")], "orcid string, display_name string, first_name string, last_name string, person_kind string, error string")
    assert rows_of(people.import_roster(persons, roster)) == [("0000-0002-1694-233X", "Bob Ray", "Bob", "Ray", "internal"), ("0000-0002-1825-0097", "Anna Leigh", "Anna", "Leigh", "external")]
    stored = spark.createDataFrame([(1, " ", "Lee", dt.date(2024, 1, 1)), (2, "B", None, None)], "person_id long, first_name string, last_name string, orcid_updated date")
    found = spark.createDataFrame([(1, "Ann", "Other", dt.date(2023, 1, 1)), (2, "C", "Ray", dt.date(2024, 5, 1))], "person_id long, first_name string, last_name string, orcid_updated date")
    assert rows_of(people.refresh_profiles(stored, found)) == [(1, "Ann", "Lee", dt.date(2024, 1, 1)), (2, "B", "Ray", dt.date(2024, 5, 1))]
    log = spark.createDataFrame([(1, 2, "x")], "person_a long, person_b long, note string")
    sent = spark.createDataFrame([(2, 1, "y"), (3, 1, "z"), (1, 3, None), (4, 4, "w")], "person_a long, person_b long, note string")
    assert rows_of(people.log_introductions(log, sent)) == [(1, 2, "x"), (1, 3, "z")]
    mails = spark.createDataFrame([(1, 1, "a@x.org")], "pub_id long, person_id long, email string")
    more = spark.createDataFrame([(1, 1, " A@x.org"), (1, 1, "b@x.org"), (1, 1, "none"), (2, 1, "a@x.org")], "pub_id long, person_id long, email string")
    assert rows_of(people.add_paper_emails(mails, more)) == [(1, 1, "a@x.org"), (1, 1, "b@x.org"), (2, 1, "a@x.org")]
    profile = people.editor_profile(spark.createDataFrame([(1, "Ann")], "person_id long, display_name string"), spark.createDataFrame([(1, "b"), (1, "A"), (1, "c")], "person_id long, alias_name string"), spark.createDataFrame([(1, ["X@y.org", "x@Y.org", "n/a"])], "person_id long, emails array<string>")).first()
    assert profile.aliases == ["A", "b", "c"] and profile.emails == ["X@y.org"]


def test_person_merges(spark):
    tables = {
        "authorships": spark.createDataFrame([(1, 1, 10), (2, 1, 20)], "pub_id long, author_position int, person_id long"),
        "contacts": spark.createDataFrame([(10, None, ["a"]), (20, "p", ["b", "a"])], "person_id long, primary_email string, emails array<string>"),
        "person_state": spark.createDataFrame([(10, dt.date(2024, 1, 1)), (20, dt.date(2023, 1, 1))], "person_id long, last_works_at date"),
        "aliases": spark.createDataFrame([(10, "x", ["s"]), (20, "x", ["t"]), (20, "y", ["t"])], "person_id long, alias_key string, alias_sources array<string>"),
        "employments": spark.createDataFrame([(10, "o", None, "k"), (20, "o", None, "d")], "person_id long, org_name string, start_date string, department string"),
    }
    got = people.merge_people(tables, spark.createDataFrame([(10, 20)], "loser long, winner long"))
    assert rows_of(got["authorships"]) == [(1, 1, 20), (2, 1, 20)] and rows_of(got["contacts"]) == [(20, "p", ["a", "b"])]
    assert rows_of(got["person_state"]) == [(20, dt.date(2024, 1, 1))] and rows_of(got["aliases"]) == [(20, "x", ["s", "t"]), (20, "y", ["t"])]
    assert rows_of(got["employments"]) == [(20, "o", None, "d")]
    shared = tables | {"authorships": spark.createDataFrame([(1, 1, 10), (1, 2, 20)], "pub_id long, author_position int, person_id long")}
    for wrong, merges in ((shared, [(10, 20)]), (tables, [(10, 20), (20, 10)]), (tables, [(10, 20), (10, 30)])):
        with pytest.raises(ValueError):
            people.merge_people(wrong, spark.createDataFrame(merges, "loser long, winner long"))


def test_attach(spark):
    rows = spark.createDataFrame([(1, 1, "J. Doe", None, None), (1, 2, "Jane Doe", None, 9), (2, 1, "X", "https://orcid.org/0000-0002-1825-0097", None), (3, 1, "Nobody", None, None), (4, 1, "Z", None, 5)], "pub_id long, author_position int, author_name string, author_orcid string, person_id long")
    persons = spark.createDataFrame([(5, "Jane Doe", "0000-0002-1825-0097")], "person_id long, display_name string, orcid string")
    asked = spark.createDataFrame([(n, 5) for n in (1, 2, 3, 4)], "pub_id long, person_id long")
    assert {r.pub_id: (r.author_position, r.outcome) for r in people.attach(rows, asked, persons).collect()} == {1: (2, "conflict"), 2: (1, "attach"), 3: (1, "low_score"), 4: (1, "already_there")}


def test_curators_writes(spark):
    schema = "pub_id long, author_position int, author_name string, author_orcid string, mode string, person_id long, updated_at int"
    old = spark.createDataFrame([(1, 1, " ANN ", None, "force_null", None, 1), (1, None, None, None, "ignore_row", None, 1)], schema)
    new = spark.createDataFrame([(1, 1, "ann", "", "force_person", 7, 2), (1, 1, "Ann", None, "ignore_row", None, 1), (2, None, "", None, "force_null", None, 3)], schema)
    assert {(r.pub_id, r.author_position, r.author_name, r.mode, r.person_id) for r in curation.override_authors(old, new).collect()} == {(1, 1, "ann", "force_person", 7), (1, None, None, "ignore_row", None), (2, None, None, "force_null", None)}
    log = spark.createDataFrame([(5, "x", 1, None, "me", "old")], "log_id long, action string, pub_id long, note string, created_by string, created_at string")
    got = curation.log_correction(log, spark.createDataFrame([("y", 2, "n", "me"), ("z", 1, None, "me")], "action string, pub_id long, note string, created_by string"), F.lit("now"))
    assert sorted(r.log_id for r in got.collect()) == [5, 6, 7]
    w = spark.createDataFrame([(1, "10.1234/a", "A", 2000, None), (2, None, "B", 2001, None), (3, "10.1234/c", "C", 2002, None)], "pub_id long, doi string, title string, year int, venue string")
    empty = spark.createDataFrame([], "decision_id long, mode string, doi_key string, title_key string, year int, winner_doi_key string, winner_title_key string, winner_year int, note string, created_by string, updated_at string, active boolean")
    overrides = spark.createDataFrame([(2, "merge_to", 1), (3, "keep_separate", None)], "pub_id long, mode string, winner_pub_id long")
    once = curation.decisions_from_overrides(empty, overrides, w, F.lit("now"))
    assert {(r.mode, r.doi_key, r.title_key) for r in once.collect()} == {("merge_to", None, "b"), ("keep_separate", "10.1234/c", "c")}
    assert curation.decisions_from_overrides(once, overrides, w, F.lit("now")).count() == 2
    assert {(r.mode, r.pub_id, r.winner_pub_id) for r in curation.described(once, w).collect()} == {("merge_to", 2, 1), ("keep_separate", 3, None)}
    ids = [r.decision_id for r in once.collect()]
    assert curation.cleared(once, ids[:1], F.lit("later")).filter("active").count() == 1
    lines = curation.exported({"t": (overrides, ["pub_id"])})["t"].withColumn("value", F.replace("value", F.lit('"version":1'), F.lit('"version":9')))
    with pytest.raises(ValueError):
        curation.imported(spark, lines, "t", overrides, ["pub_id"])


def test_functions_of_dates_and_payloads(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    work = lambda body: dates.picked_date(F.lit(json.dumps(body)))
    parts = lambda *p: {"date-parts": [list(p)]}
    assert one(work({"issued": parts(2020, 5), "published-print": parts(2021, 2, 30)})) == dt.date(2020, 5, 1)
    assert one(work({"created": parts(2019)})) == dt.date(2019, 1, 1) and one(work({"published": parts(2018, 13)})) == dt.date(2018, 1, 1)
    assert one(dates.picked_date(F.lit("{}"), F.lit(1999))) == dt.date(1999, 1, 1) and one(work({})) is None
    assert one(dates.work_year(F.lit('{"created":{"date-parts":[[2001]]},"issued":{"date-parts":[["x"]]}}'))) == 2001
    assert one(dates.millis_date(F.lit("1700000000000"))) == dt.date(2023, 11, 14) and one(dates.millis_date(F.lit("x"))) is None
    assert one(dates.newest_message(F.lit(1), F.lit("a"), F.lit(2), F.lit("b"))) == "b" and one(dates.newest_message(F.lit(None), F.lit("a"), F.lit(2), F.lit("b"))) == "b"
    old, new = (payloads.envelope(F.lit(json.dumps(b)), F.lit(t), "v") for b, t in (({"a": 1, "b": 2}, "1"), ({"b": 3, "c": None}, "2")))
    assert {k: v["fetched_at"] for k, v in one(payloads.merged_envelope(old, new)).items()} == {"a": "1", "b": "2"}
    followed = payloads.followed_envelope(F.lit('{"a":1}'), old, F.lit('{"a":1,"b":3}'), new)
    assert {k: v["fetched_at"] for k, v in one(followed).items()} == {"a": "1", "b": "2"}
    assert one(payloads.empty_to_null(F.lit("{}"))) is None and one(payloads.empty_to_null(F.lit('{"a":1}'))) == '{"a":1}'
    assert one(text.bibliography_title(F.lit(" <i>On</i> X. "))) == "On X" and one(text.bibliography_title(F.lit("<b></b>"))) is None


def test_transitive_cycles_and_policy(spark):
    schema = "pub_id long, doi string, title string, year int, venue string, provenance string, payload string, is_preprint boolean, attributed boolean"
    w = spark.createDataFrame([(k, None, f"t{k}", None, None, None, None, None, None) for k in range(1, 8)], schema)
    none = spark.createDataFrame([], "decision_id long, mode string, doi string, title string, year int, winner_doi string, winner_title string, winner_year int, updated_at timestamp, active boolean")
    rules = spark.createDataFrame([(1, "merge_to", 2), (2, "merge_to", 3), (3, "merge_to", 4), (5, "merge_to", 6), (6, "merge_to", 5)], "pub_id long, mode string, winner_pub_id long")
    got = {r.pub_id: r.canonical_pub_id for r in canonical.memberships(w, none, rules, transitive=True).collect()}
    assert got == {1: 4, 2: 4, 3: 4, 4: 4, 5: 5, 6: 5, 7: 7}
    chosen = canonical.policy_winner(w.withColumn("g", F.lit(1)).withColumn("d", F.lit(3)), "g", "d").first()
    assert chosen.winner_pub_id == 3
    with pytest.raises(ValueError):
        canonical.attribution(w, spark.range(canonical.MAX_RULES + 1).select(F.concat(F.lit("p"), "id").alias("pattern"), F.lit(True).alias("active")))


def test_author_counts_and_since(spark):
    w = spark.createDataFrame([(1, '{"crossref":{"author":[{"affiliation":[{"name":"U"}]},{"affiliation":[]},{"affiliation":[{"name":" "}]}]}}'), (2, "{}"), (3, None)], "pub_id long, payload string")
    assert rows_of(works.author_counts(w, "crossref")) == [(1, 3, 1), (2, 0, 0), (3, 0, 0)]
    o = spark.createDataFrame([(1, '{"openalex":{"authorships":[{"raw_affiliation_strings":["x"]},{"institutions":[{"display_name":"I"}]},{}]}}')], "pub_id long, payload string")
    assert rows_of(works.author_counts(o, "openalex")) == [(1, 3, 2)]
    y = spark.createDataFrame([(1, "2019"), (2, "2021"), (3, None)], "k int, year string")
    assert {r.k for r in providers.since(y, 2020).collect()} == {2, 3}
