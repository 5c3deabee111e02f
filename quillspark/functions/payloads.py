"""JSON payloads keyed by source, provenance tokens, and the envelope that says where a payload came from."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sources from the most to the least trusted.
TRUST = ["manual", "crossref", "datacite", "semantic", "orcid", "scholar", "dblp", "openalex", "unknown"]
#: Sources whose plain token goes when a token of theirs says more.
FAMILIES = ["crossref", "datacite", "semantic", "orcid", "scholar", "dblp", "openalex"]
#: Keys by which a payload is known to be keyed by source.
PAYLOAD_KEYS = ["crossref", "datacite", "dblp", "legacy", "manual", "manual_csv", "openalex", "orcid", "scholar", "semantic"]
_OBJECT = "map<string,variant>"
_NO_TEXTS = "array<string>"


def has_key(payload: Column, key: str) -> Column:
    """The key exists, even with a null value; false for no payload."""
    return F.coalesce(F.array_contains(F.json_object_keys(payload), key), F.lit(False))


def _object(payload: Column) -> Column:
    return F.from_json(F.coalesce(payload, F.lit("{}")), _OBJECT)


def merged(old: Column, new: Column) -> Column:
    """Shallow merge of two objects; the new side's keys win, an empty side changes nothing."""
    a, b = _object(old), _object(new)
    kept = F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k))
    return F.to_json(F.map_concat(kept, b))


def without_nulls(payload: Column) -> Column:
    """Without keys whose value is null (updates that say nothing)."""
    return F.to_json(F.map_filter(_object(payload), lambda _, v: ~F.is_variant_null(v)))


def empty_to_null(payload: Column) -> Column:
    """An object without keys counts as none."""
    return F.when(F.coalesce(F.size(F.json_object_keys(payload)), F.lit(1)) > 0, payload)


def _list(provenance: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(provenance, F.lit("")), r"\+"), lambda t: F.btrim(t)), lambda t: t != "")


def token_list(provenance: Column) -> Column:
    """Non-blank tokens of ``a+b+c`` in lower case, repeats included."""
    return F.transform(_list(provenance), lambda t: F.lower(t))


def tokens(provenance: Column) -> Column:
    """Distinct non-blank tokens of ``a+b+c`` in lower case."""
    return F.array_distinct(token_list(provenance))


def n_tokens(provenance: Column) -> Column:
    """How many tokens say something: blank ones and ``unknown`` don't count, repeats do."""
    return F.size(F.filter(token_list(provenance), lambda t: t != "unknown"))


def family(token: Column) -> Column:
    """The source that a token belongs to: the part before the first ``-``."""
    return F.split_part(token, F.lit("-"), F.lit(1))


def families(provenance: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(tokens(provenance), family)))


def trust_rank(token: Column) -> Column:
    """0 is the most trusted; sources that are not listed come after ``unknown``."""
    place = F.array_position(F.array(*[F.lit(t) for t in TRUST]), family(token)) - 1
    return F.when(place < 0, len(TRUST)).otherwise(place).cast("int")


def best_rank(provenance: Column) -> Column:
    """The rank of the most trusted token; without any, that of ``unknown``."""
    return F.coalesce(F.array_min(F.transform(tokens(provenance), trust_rank)), F.lit(len(TRUST) - 1))


def more_trusted(provenance: Column, than: str) -> Column:
    """Some token outranks the named source."""
    rank = TRUST.index(than.split("-")[0]) if than.split("-")[0] in TRUST else len(TRUST)
    return F.exists(tokens(provenance), lambda t: trust_rank(t) < rank)


def _settled(every: Column) -> Column:
    """Distinct tokens as provenance: ``unknown`` goes beside others, a family's plain token beside one that says more; plain sources in trust order, then the rest by name."""
    known = F.filter(every, lambda t: t != "unknown")
    rest = F.array_distinct(F.when(F.size(known) > 0, known).otherwise(every))
    special = F.filter(rest, lambda t: F.contains(t, F.lit("-")))
    plain = F.array(*[F.lit(f) for f in FAMILIES])
    rest = F.filter(rest, lambda t: ~(F.array_contains(plain, t) & F.exists(special, lambda s: F.startswith(F.lower(s), F.concat(t, F.lit("-"))))))
    order = F.array(*[F.lit(t) for t in TRUST[:-1]])
    keyed = F.transform(rest, lambda t: F.struct(F.when(F.array_position(order, t) > 0, F.array_position(order, t)).otherwise(len(TRUST)).alias("place"), t.alias("token")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["token"]), "+")


def merge_provenance(a: Column, b: Column) -> Column:
    """Union of tokens; see the rules of :func:`_settled`. Case is kept."""
    return _settled(F.concat(_list(a), _list(b)))


def replace_family(existing: Column, add: Column, source: str) -> Column:
    """Provenance in which one family's tokens are replaced by ``add``.

    The plain token yields to tokens of the family that say more; a funding token replaces the
    family's funding tokens only, another one of the family those that aren't about funding.
    """
    mine = lambda t: (t == source) | F.startswith(t, F.lit(f"{source}-"))
    funding = lambda t: F.startswith(F.lower(t), F.lit(f"{source}-")) & F.contains(F.lower(t), F.lit("funding"))
    every, new = _list(existing), F.btrim(F.coalesce(add, F.lit("")))
    own, others = F.filter(every, mine), F.filter(every, lambda t: ~mine(t))
    one = F.when(new != "", F.array(new)).otherwise(F.array().cast(_NO_TEXTS))
    special = F.filter(own, lambda t: t != source)
    specific = F.concat(F.when(funding(new), F.filter(own, lambda t: ~funding(t))).otherwise(F.filter(own, funding)), one)
    kept = F.when(new == source, F.when(F.size(special) > 0, special).otherwise(one)).when(F.startswith(new, F.lit(f"{source}-")), specific).otherwise(one)
    return _settled(F.concat(others, kept))


def normal_payload(payload: Column, provenance: Column) -> Column:
    """A payload keyed by source: as it is if a known key is there, else under its only source, else under ``legacy``; no object is empty."""
    keys = F.json_object_keys(payload)
    only = _list(provenance)
    source = F.get(only, F.lit(0))
    single = (F.size(only) == 1) & F.coalesce(source.isin(PAYLOAD_KEYS), F.lit(False))
    known = F.arrays_overlap(keys, F.array(*[F.lit(k) for k in PAYLOAD_KEYS]))
    wrapped = F.to_json(F.map_from_arrays(F.array(F.when(single, source).otherwise("legacy")), F.array(F.try_parse_json(payload))))
    return F.when(keys.isNull(), F.lit("{}")).when(known, payload).otherwise(wrapped)


def merged_payload(payload: Column, provenance: Column, updates: Column) -> Column:
    """New payloads over the stored ones, by source; null updates are left out."""
    return merged(normal_payload(payload, provenance), without_nulls(updates))


@F.pandas_udf(T.StringType())
def payload_hash(x: pd.Series) -> pd.Series:
    """SHA-256 of JSON with sorted keys, no blanks and letters as they are; null for no JSON."""

    def of(body: str) -> str | None:
        try:
            return hashlib.sha256(json.dumps(json.loads(body), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        except ValueError:
            return None

    return x.map(of, na_action="ignore")


def envelope(updates: Column, fetched_at: Column, version: str) -> Column:
    """For each source of ``updates`` that has a payload: fetched_at, transform_version, payload_sha256 (a map)."""
    said = F.filter(F.map_entries(_object(updates)), lambda e: ~F.is_variant_null(e["value"]))
    entry = lambda e: F.struct(e["key"].alias("key"), F.struct(fetched_at.cast("string").alias("fetched_at"), F.lit(version).alias("transform_version"), F.to_json(e["value"]).alias("body")).alias("value"))
    return F.map_from_entries(F.transform(said, entry))


def merged_envelope(old: Column, new: Column) -> Column:
    """Entries by source, the new ones over the old ones."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def followed_envelope(winner_payload: Column, winner: Column, loser_payload: Column, loser: Column) -> Column:
    """The envelope of a duplicate merge: entries follow the payloads, which must be normal (:func:`normal_payload`)."""
    kept = F.map_filter(winner, lambda k, _: F.array_contains(F.json_object_keys(winner_payload), k))
    gaps = F.array_except(F.json_object_keys(loser_payload), F.json_object_keys(winner_payload))
    return F.map_concat(kept, F.map_filter(loser, lambda k, _: F.array_contains(gaps, k)))
