"""Functions for SQL texts: scalar and table functions of a session, written in SQL, so that the optimizer sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name and parameters, what is returned, and the body.
FUNCTIONS = [
    ("qs_doi_key(x STRING)", "STRING", r"nullif(lower(regexp_replace(regexp_replace(btrim(coalesce(x, '')), r'(?i)^doi:\s*', ''), r'(?i)^https?://(dx\.)?doi\.org/', '')), '')"),
    ("qs_title_key(x STRING)", "STRING", r"lower(regexp_replace(btrim(x), r'\s+', ' '))"),
    ("qs_name_key(name STRING, place STRING)", "STRING", "sha2(lower(concat(name, '|', place)), 256)"),
    ("qs_tokens(provenance STRING)", "TABLE(place INT, token STRING)", r"SELECT pos + 1, lower(btrim(col)) FROM posexplode(split(coalesce(provenance, ''), r'\+')) WHERE btrim(col) <> ''"),
]


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL texts."""
    for head, returned, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {returned} RETURN {body}")
