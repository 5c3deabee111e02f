import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark.functions import dates, payloads, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(("x", "y"), [(" DOI: 10.1/A ", "10.1/a"), ("https://dx.doi.org/10.1/B", "10.1/b"), ("", None), (None, None), ("doi:", None)])
def test_doi_key(spark, x, y):
    assert one(spark, x, text.doi_key) == y


@pytest.mark.parametrize(("x", "y"), [("see https://doi.org/10.1234/AbC).", "10.1234/abc"), ("10.1234/x?version=2", "10.1234/x"), ("10.12/short", None), ("10.1234/a&amp;b", "10.1234/a&b"), (None, None)])
def test_normalize_doi(spark, x, y):
    assert one(spark, x, text.normalize_doi) == y


@pytest.mark.parametrize(("x", "y"), [("  A\t b ", "a b"), ("", "")])
def test_title_key(spark, x, y):
    assert one(spark, x, text.title_key) == y


@pytest.mark.parametrize(("x", "ok"), [("0000-0002-1825-0097", True), ("0000-0002-1825-0098", False), ("0000-0002-1694-233X", True)])
def test_orcid_checksum(spark, x, ok):
    assert one(spark, x, text.orcid_checksum_ok) is ok
    assert one(spark, "https://orcid.org/" + x.lower(), text.normalize_orcid) == x


def test_names(spark):
    row = spark.createDataFrame([("Jürgen Müller-Lüdenscheidt", "J. Mueller Luedenscheidt")], "a string, b string")
    b = F.col("b")
    assert not row.select(text.names_equivalent(F.col("a"), b).alias("x")).first()[0]  # a hyphen joins the last word
    assert row.select(text.name_similarity(F.col("a"), b).alias("x")).first()[0] > 0.8


@pytest.mark.parametrize(("y", "m", "d", "want"), [(2020, 2, 31, dt.date(2020, 2, 29)), (2021, 13, 5, dt.date(2021, 12, 5)), (2021, None, None, dt.date(2021, 1, 1)), (None, 3, 4, None), (2021, 0, 0, dt.date(2021, 1, 1))])
def test_clamped_date(spark, y, m, d, want):
    row = spark.createDataFrame([(y, m, d)], "y int, m int, d int").select(dates.clamped_date(F.col("y"), F.col("m"), F.col("d")).alias("x")).first()
    assert row[0] == want


def test_provenance(spark):
    row = spark.createDataFrame([("crossref-search+unknown", "openalex+crossref+manual")], "a string, b string")
    assert row.select(payloads.merge_provenance(F.col("a"), F.col("b")).alias("x")).first()[0] == "manual+openalex+crossref-search"
    assert one(spark, "", payloads.best_rank) == len(payloads.TRUST) - 1


def test_payload_merge_and_keys(spark):
    row = spark.createDataFrame([('{"a":1,"b":null}', '{"b":{"c":2}}')], "a string, b string")
    assert row.select(payloads.merged(F.col("a"), F.col("b")).alias("x")).first()[0] == '{"a":1,"b":{"c":2}}'
    assert row.select(payloads.has_key(F.col("a"), "b").alias("x")).first()[0] is True
    assert one(spark, None, lambda x: payloads.has_key(x, "b")) is False
