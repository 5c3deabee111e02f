import datetime as dt

from pyspark.sql import functions as F

from quillspark.operators import relational as r
from quillspark.plans import canonical, people
from quillspark.sources import files, providers
from quillspark.streaming import refresh

NO_DECISIONS = "decision_id long, mode string, doi string, title string, year int, winner_doi string, winner_title string, winner_year int, updated_at timestamp, active boolean"
WORKS = "pub_id long, doi string, title string, year int, venue string, provenance string, payload string, is_preprint boolean, attributed boolean"


def works(spark, *rows):
    return spark.createDataFrame([(i, doi, title, 2020, None, src, payload, pre, True) for i, doi, title, src, payload, pre in rows], WORKS)


def members(spark, w, decisions=(), overrides=(), **more):
    d, o = spark.createDataFrame(list(decisions), NO_DECISIONS), spark.createDataFrame(list(overrides), "pub_id long, mode string, winner_pub_id long")
    return {x.pub_id: (x.canonical_pub_id, x.group_size, x.canonical_locked) for x in canonical.memberships(w, d, o, **more).collect()}


def test_or_join_counts_pairs_once(spark):
    a = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "x int, y int")
    b = spark.createDataFrame([(1, 1), (9, 9)], "p int, q int")
    got = sorted((v.x, v.p) for v in r.or_equi_join(a, b, F.col("x") == F.col("p"), F.col("y") == F.col("q")).collect())
    assert got == [(1, 1), (2, 9)]


def test_winner_puts_unknown_preprint_last(spark):
    got = members(spark, works(spark, (1, None, "T", "x", "{}", None), (2, None, "t ", "x", "{}", False), (3, "10.1/a.v2", "T", "x", "{}", False)))
    assert {v[0] for v in got.values()} == {2} and got[1][1] == 3


def test_excluded_types(spark):
    cases = [('{"crossref":{"type":"posted-content"}}', False), ('{"crossref":{"type":"grant"}}', True), ('{"crossref":{"type":"article"},"openalex":{"type":"paratext"}}', True), ('{"openalex":{"type":"paratext"}}', False), ("{}", True)]
    got = members(spark, works(spark, *[(k, None, f"t{k}", "x", p, None) for k, (p, _) in enumerate(cases)]))
    assert sorted(got) == [k for k, (_, kept) in enumerate(cases) if kept]


def test_overrides_are_not_chained_unless_asked(spark):
    w = works(spark, *[(k, None, "same", "x", "{}", None) for k in (1, 2, 3)])
    assert {k: v[0] for k, v in members(spark, w, overrides=[(1, "merge_to", 2)]).items()} == {1: 2, 2: 2, 3: 1}
    assert {k: v[0] for k, v in members(spark, w, overrides=[(1, "merge_to", 2)], transitive=True).items()} == {1: 2, 2: 2, 3: 2}


def test_durable_decisions_match_by_doi_or_title(spark):
    w = works(spark, (1, "10.1/A", "one", "x", "{}", None), (2, "10.1/b", "two", "x", "{}", None), (3, None, "Two", "x", "{}", None))
    at = dt.datetime(2024, 1, 1)
    got = members(spark, w, decisions=[(1, "merge_to", "doi:10.1/a", None, None, "10.1/B", None, None, at, True), (2, "confirm_winner", None, "two", 2020, None, "two", None, at, True), (3, "keep_separate", "10.1/b", None, None, None, None, None, at, False)])
    assert got[1][0] == 2 and got[3] == (2, 3, True)


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (None, "n", 2)], "k int, v string, c int")
    new = spark.createDataFrame([(1, None, 5), (2, "z", 7), (None, "m", 1)], "k int, v string, c int")
    policy = {"c": "greatest"}
    once = r.upsert(old, new, ["k"], policy)
    rows = sorted(map(tuple, once.collect()), key=repr)
    assert rows == sorted([(1, "a", 5), (2, "z", 7), (None, "m", 2)], key=repr)
    assert sorted(map(tuple, r.upsert(once, new, ["k"], policy).collect()), key=repr) == rows


def test_curated_authorships(spark):
    a = spark.createDataFrame([(1, 1, "Ann", None, 10), (1, 2, "Bob", None, 11), (1, 3, "Cy", None, 12)], "pub_id long, author_position int, author_name string, author_orcid string, person_id long")
    o = spark.createDataFrame([(1, 1, "force_null", None, 1, None, None, None), (1, 2, "force_person", 99, None, "ann", None, None), (1, 3, "ignore_row", None, 3, "", "", None)], "pub_id long, override_id long, mode string, person_id long, author_position int, author_name string, author_orcid string, updated_at timestamp")
    assert {x.author_position: x.person_id for x in people.curated_authorships(a, o).collect()} == {1: 99, 2: 11}


def test_crossref_payload(spark):
    p = spark.createDataFrame([(1, '{"DOI":"10.1234/X","type":"journal-article","title":["T"],"issued":{"date-parts":[[2021,3]]},"author":[{"given":"A","family":"B","ORCID":"http://orcid.org/0000-0002-1825-0097","affiliation":[{"name":"U"}]},{"name":"Group"}]}')], "payload_id long, payload string")
    w = providers.works(p, "crossref").first()
    assert (w.doi, w.title, w.year, w.is_preprint) == ("10.1234/x", "T", 2021, False)
    assert [(x.position, x.name, x.orcid, x.affiliations) for x in providers.authors(p, "crossref").collect()] == [(1, "A B", "0000-0002-1825-0097", ["U"]), (2, "Group", None, [])]


def test_refresh_state(spark):
    t = dt.datetime
    state = spark.createDataFrame([(1, t(2024, 1, 1), t(2024, 1, 1), None)], "k int, last_attempt timestamp, last_success timestamp, last_error string")
    done = refresh.advance(state, spark.createDataFrame([(1, t(2024, 2, 1), "boom"), (2, t(2024, 2, 1), None)], "k int, at timestamp, error string"), "k")
    assert {x.k: (x.last_success, x.last_error) for x in done.collect()} == {1: (t(2024, 1, 1), "boom"), 2: (t(2024, 2, 1), None)}
    assert [s for _, s, _ in refresh.run_all({"a": lambda: 1 / 0, "b": lambda: None})] == ["failed", "success"]


def test_snapshots_swap_together(spark, tmp_path):
    s = files.Snapshots(spark, f"file://{tmp_path}/snap")
    s.publish("2024-01-01", a=spark.range(1), b=spark.range(2))
    s.publish("2024-01-02", a=spark.range(3), b=spark.range(4))
    assert (s.read("a").count(), s.read("b").count(), s.manifest()["refreshed_at"]) == (3, 4, "2024-01-02")


def test_stream_replay_changes_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"k":1,"v":"a"}\n{"k":2,"v":"b"}\n{"k":1,"v":"c"}\n')
    held = {"rows": []}
    load = lambda: spark.createDataFrame(held["rows"], "k int, v string")
    save = lambda df: held.update(rows=[tuple(x) for x in df.collect()])
    for n in (1, 2):
        refresh.merge_stream(spark, str(tmp_path / "in"), "k int, v string", load, save, ["k"], [F.col("v").desc()], {}, str(tmp_path / f"ck{n}")).awaitTermination()
        assert sorted(held["rows"]) == [(1, "c"), (2, "b")]


def test_authors_resolve_by_candidates_that_fit(spark):
    persons = spark.createDataFrame([(1, "Jane Doe", "0000-0002-1825-0097"), (2, "Ann Lee", None), (3, "Ann Lee", None), (4, "Max Mustermann", None), (5, "José Álvarez", None), (6, "Doe", None)], "person_id long, display_name string, orcid string")
    known = spark.createDataFrame([(4, "The Fox"), (4, "Maxi Mustermann"), (4, "M. Mustermann"), (5, "Jose Alvarez"), (1, "X Doe"), (2, "A. Lee"), (3, "A. Lee"), (9, "Gone Person")], "person_id long, alias_name string")
    want = {"Doe, Jane": (1, "name"), "jane  DOE": (1, "name"), "Jane Doe": (1, "name"), "Ann Lee": (None, None), "A. Lee": (None, None), "The Fox": (None, None), "X Doe": (None, None), "Mustermann, Maxi": (4, "alias"), "Jose Alvarez": (5, "alias"), "Gone Person": (None, None), "": (None, None), None: (None, None)}
    rows = [(n, None) for n in want] + [("Nobody", "https://orcid.org/0000-0002-1825-0097")]
    authors = spark.createDataFrame(rows, "author_name string, author_orcid string")
    got = {x.author_name: (x.person_id, x.matched_by) for x in people.resolve_authors(authors, persons, known).collect()}
    assert got == want | {"Nobody": (1, "orcid")}
    loose = {x.author_name: x.person_id for x in people.resolve_authors(authors, persons, known, least=0.0).collect()}
    strict = {x.author_name: x.person_id for x in people.resolve_authors(authors, persons, known, least=0.99).collect()}
    assert (loose["Mustermann, Maxi"], strict["Mustermann, Maxi"], loose["The Fox"], strict["Doe, Jane"]) == (4, None, None, 1)
