"""Many works of one title beside many decisions that name it: no join may give out all pairs."""

import pytest

from quillspark.plans import canonical, curation

N = 300
WORKS = f"SELECT id AS pub_id, CAST(IF(id % 2 = 0, '10.1234/same', NULL) AS STRING) AS doi, 'Same  title' AS title, CAST(2000 + id % 3 AS INT) AS year, 'v' AS venue, 'crossref' AS provenance, '{{}}' AS payload, id % 5 = 0 AS is_preprint, id % 2 = 0 AS attributed FROM range({N})".replace("{{}}", "{}")
DECISIONS = f"""SELECT id AS decision_id, CASE id % 3 WHEN 0 THEN 'merge_to' WHEN 1 THEN 'confirm_winner' ELSE 'keep_separate' END AS mode, CAST(IF(id % 4 = 0, 'doi:10.1234/SAME', NULL) AS STRING) AS doi, 'same title' AS title, CAST(IF(id % 8 = 1, 2001, NULL) AS INT) AS year,
  CAST(IF(id % 5 = 0, '10.1234/same', NULL) AS STRING) AS winner_doi, 'same title' AS winner_title, CAST(IF(id % 7 = 0, 2002, NULL) AS INT) AS winner_year, CAST(IF(id % 11 = 0, NULL, id % 19) AS INT) AS updated_at, id % 13 <> 5 AS active FROM range({N})"""
SCOPES = f"""SELECT id AS decision_id, IF(id % 5 = 0, 'person', 'global') AS scope_type, IF(id % 5 = 0, id % 3, NULL) AS person_id, IF(id % 3 = 0, 'exclude', 'include') AS mode, CAST(IF(id % 4 = 0, 'doi:10.1234/SAME', NULL) AS STRING) AS doi, 'same title' AS title,
  CAST(IF(id % 8 = 1, 2001, NULL) AS INT) AS year, CAST(IF(id % 11 = 0, NULL, id % 19) AS INT) AS updated_at, id % 13 <> 5 AS active, 'note' AS note FROM range({N})"""
AUTHORSHIPS = f"SELECT id AS pub_id, 7L AS person_id, TRUE AS is_internal, 'Place' AS paper_affiliation, array('A') AS affiliations FROM range({N})"


class Given:
    def __init__(self, spark):
        self.works, self.decisions, self.scopes, self.authorships = (spark.sql(body) for body in (WORKS, DECISIONS, SCOPES, AUTHORSHIPS))
        self.overrides = spark.createDataFrame([], "pub_id long, mode string, winner_pub_id long")
        self.people = spark.createDataFrame([(7, "Person")], "person_id long, display_name string")

    def members(self):
        return canonical.memberships(self.works, self.decisions, self.overrides)


CASES = {
    "durable_decisions": lambda g: canonical.durable_decisions(canonical.keyed(g.works), g.decisions),
    "canon_scope": lambda g: canonical.scope_matches(g.works, g.scopes),
    "dedup_memberships": lambda g: g.members(),
    "dedup_families": lambda g: curation.families(g.members(), g.works),
    "canon_publications": lambda g: canonical.canon(g.works, g.members(), g.scopes),
    "clean_publications": lambda g: canonical.clean_list(g.works, g.members(), g.authorships, g.people),
    "person_coverage": lambda g: canonical.person_coverage(7, g.works, g.members(), g.authorships, g.scopes),
}


def joins(node):
    """Rows given out by each join of a plan that was run."""
    out = [node.metrics().get("numOutputRows").get().value()] if "Join" in node.nodeName() else []
    children = node.children()
    return out + [n for k in range(children.size()) for n in joins(children.apply(k))]


@pytest.mark.parametrize("name", sorted(CASES))
def test_no_pairs_of_a_group(spark, monkeypatch, name):
    counts = []

    def run(df, what=None):
        rows = df.collect()
        counts.extend(joins(df._jdf.queryExecution().executedPlan()))
        return spark.createDataFrame(rows, df.schema)

    monkeypatch.setattr(canonical, "settled", run)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a plan that holds its joins from the first on
    try:
        assert run(CASES[name](Given(spark))).count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert counts and max(counts) <= 5 * N  # all pairs are N * N


def first(rows, key):
    return max(rows, key=key, default=None)


def test_best_of_a_group_by_definition(spark):
    """Every work's decision, by looking at all pairs."""
    g = Given(spark)
    works, decisions = g.works.collect(), [d for d in g.decisions.collect() if d.active]
    none_last = lambda v: (v is not None, v or 0)
    fits = lambda w, doi, year: w.doi is not None if doi else year is None or w.year == year
    want = {}
    winner = {d.decision_id: max((w for w in works if fits(w, d.winner_doi, d.winner_year)), key=lambda w: (not w.is_preprint, -w.pub_id)).pub_id for d in decisions}
    for w in works:
        d = first([d for d in decisions if fits(w, d.doi, d.year)], lambda d: (d.doi is not None, none_last(d.updated_at), d.decision_id))
        want[w.pub_id] = (d.mode, None if d.mode == "keep_separate" else winner[d.decision_id], d.decision_id)
    found = canonical.durable_decisions(canonical.keyed(g.works), g.decisions).collect()
    assert len(found) == N and {x.pub_id: (x.d_mode, x.d_winner, x.decision_id) for x in found} == want


@pytest.mark.parametrize(("name", "most"), [("dedup_memberships", 1), ("dedup_families", 2), ("clean_publications", 2), ("canon_publications", 4), ("person_coverage", 7)])
def test_works_are_keyed_once(spark, name, most):
    """The works are not derived again, with their keys, for each join that needs them."""
    g, read = Given(spark), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    g.works = g.works.mapInArrow(counted, g.works.schema)
    assert CASES[name](g).collect()
    assert read.value <= most * N
