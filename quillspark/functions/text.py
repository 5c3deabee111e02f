"""Identifier, title and name functions as column expressions; Pandas UDFs only where Spark has no function."""

from __future__ import annotations

import html
import re
import unicodedata
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def blank_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def nonblank(x: Column) -> Column:
    """True for text with more than spaces; never null."""
    return F.coalesce(F.btrim(x) != "", F.lit(False))


def doi_key(x: Column) -> Column:
    """Loose DOI key: prefixes off, lower case, empty is null (trims spaces only)."""
    y = F.btrim(F.coalesce(x, F.lit("")))
    y = F.regexp_replace(y, r"(?i)^doi:\s*", "")
    y = F.regexp_replace(y, r"(?i)^https?://(dx\.)?doi\.org/", "")
    return blank_to_null(F.lower(y))


def normalize_doi(x: Column) -> Column:
    """Strict DOI: the first ``10.<4-9 digits>/...`` in the text, without version query and closing punctuation."""
    y = x
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        y = F.replace(y, F.lit(entity), F.lit(sign))
    y = F.regexp_extract(y, r"(?i)(10\.\d{4,9}/\S+)", 1)
    y = F.regexp_replace(y, r"(?i)[?&]version=.*$", "")
    y = F.regexp_replace(y, r"[ .),;\"']+$", "")
    return blank_to_null(F.lower(y))


def title_key(x: Column) -> Column:
    """Grouping key of titles: spaces trimmed, runs of white space to one blank, lower case."""
    return F.lower(F.regexp_replace(F.btrim(x), r"\s+", " "))


def clean_title(x: Column) -> Column:
    """Like :func:`title_key` with all white space trimmed and empty as null."""
    y = F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"\s+$", "")
    return blank_to_null(F.lower(F.regexp_replace(y, r"\s+", " ")))


def comparable_title(x: Column) -> Column:
    """For similarity: no tags, no punctuation, one blank between words."""
    y = F.regexp_replace(F.lower(F.regexp_replace(x, r"<[^>]+>", "")), r"(?U)[^\w\s]", " ")
    return F.btrim(F.regexp_replace(y, r"\s+", " "))


def affiliation_text(x: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", " "))


def normalize_orcid(x: Column) -> Column:
    """The bare identifier from bare, http or https forms; anything else is null."""
    y = F.upper(F.regexp_replace(F.btrim(x), r"(?i)^(https?://)?(www\.)?orcid\.org/", ""))
    return F.when(y.rlike(r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$"), y)


def orcid_checksum_ok(x: Column) -> Column:
    """ISO 7064 MOD 11-2 over a bare identifier."""
    digits = F.regexp_replace(x, "-", "")
    total = F.aggregate(F.split(F.substring(digits, 1, 15), ""), F.lit(0), lambda a, d: (a + d.try_cast("int")) * 2 % 11)
    check = (F.lit(12) - total % 11) % 11
    return F.substring(digits, 16, 1) == F.when(check == 10, "X").otherwise(check.cast("string"))


def contains_text(text: Column, pattern: Column) -> Column:
    """Literal, case-insensitive substring test; a blank pattern matches nothing."""
    p = F.btrim(F.lower(pattern))
    return (p != "") & F.contains(F.lower(text), p)


def name_order_tag(position: Column, count: Column) -> Column:
    return F.when(count == 1, "single").when(position == 1, "first").when(position == count, "last").otherwise("middle")


#: Words of a name that are titles, and those that follow it.
TITLES = ["doc", "dott", "dr", "mr", "mrs", "ms", "prof", "professor"]
SUFFIXES = ["b.sc", "bsc", "dphil", "frcp", "frs", "m.sc", "md", "msc", "phd"]
#: Particles of family names.
PARTICLES = ["da", "das", "de", "del", "della", "den", "der", "di", "do", "dos", "du", "la", "le", "van", "von"]
_DASHES = r"[\u2010-\u2015\u2212\u00ad]"


def _bare(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"^\.+|\.+$", "")


def strip_titles(x: Column) -> Column:
    """A name without titles anywhere and suffixes at its end; commas, dashes and semicolons separate words like blanks."""
    plain = F.btrim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))
    parts = F.filter(F.transform(F.split(plain, r"[,\u2013\u2014;]| - "), lambda t: F.btrim(t)), lambda t: t != "")
    words = F.filter(F.split(F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(plain), " "), lambda t: (t != "") & ~_bare(t).isin(TITLES))
    state = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    gone = F.aggregate(F.reverse(words), state, lambda a, w: F.struct((a["n"] + (a["on"] & _bare(w).isin(SUFFIXES)).cast("int")).alias("n"), (a["on"] & _bare(w).isin(SUFFIXES)).alias("on")), lambda a: a["n"])
    return F.array_join(F.slice(words, F.lit(1), F.size(words) - gone), " ")


def match_name(x: Column) -> Column:
    """Names for matching: ASCII form without titles, in lower case, dashes and ``.,;/`` as blanks."""
    y = F.regexp_replace(F.btrim(F.lower(ascii_fold(strip_titles(x)))), _DASHES, "-")
    return F.btrim(F.regexp_replace(F.regexp_replace(y, r"[.,;/-]", " "), r"\s+", " "))


def name_words(x: Column) -> Column:
    """Words of a name for equivalence: as for matching, but hyphens join."""
    y = F.regexp_replace(F.btrim(F.lower(ascii_fold(strip_titles(x)))), _DASHES, "-")
    return F.filter(F.split(F.regexp_replace(y, "[.,;]", " "), r"\s+"), lambda t: t != "")


def names_equivalent(a: Column, b: Column) -> Column:
    """Equal last words, and first words that begin with the same letter; false for empty names."""
    x, y = name_words(a), name_words(b)
    first = F.left(F.get(x, F.lit(0)), F.lit(1)) == F.left(F.get(y, F.lit(0)), F.lit(1))
    return F.coalesce((F.get(x, F.size(x) - 1) == F.get(y, F.size(y) - 1)) & first, F.lit(False))


def _spaced(x: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def family_name(x: Column) -> Column:
    """"Family, Given", or the last of several words; empty for a single one."""
    y = _spaced(x)
    words = F.split(y, " ")
    return F.when(F.contains(y, F.lit(",")), F.btrim(F.split_part(y, F.lit(","), F.lit(1)))).when(F.size(words) > 1, F.element_at(words, -1)).otherwise("")


def given_name(x: Column) -> Column:
    """The part after the first comma, or all words but the last; a single word is a given name."""
    y = _spaced(x)
    words = F.split(y, " ")
    after = F.btrim(F.regexp_extract(y, r"^[^,]*,(.*)$", 1))
    return F.when(F.contains(y, F.lit(",")), after).when(F.size(words) > 1, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")).otherwise(y)


def _name_parts(x: Column) -> Column:
    return F.filter(F.split(x, r"[ \-]+"), lambda t: t != "")


def _own_parts(parts: Column) -> Column:
    return F.filter(parts, lambda t: ~F.lower(t).isin(PARTICLES))


def _first(parts: Column, n: int) -> Column:
    return F.array_join(F.slice(parts, F.lit(1), F.lit(n)), " ")


def _last(parts: Column, n: int) -> Column:
    return F.when(F.size(parts) <= n, F.array_join(parts, " ")).otherwise(F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), " "))


def family_variants(x: Column) -> Column:
    """At most six family names to search for, the likeliest first: whole, its last and first word, pairs, without an end, without particles."""
    whole = _spaced(x)
    parts = _name_parts(whole)
    own, size = _own_parts(parts), F.size(parts)
    inner = F.array_join(F.slice(parts, F.lit(2), F.greatest(size - 1, F.lit(0))), " ")
    outer = F.array_join(F.slice(parts, F.lit(1), F.greatest(size - 1, F.lit(0))), " ")
    two = lambda c: F.when(size >= 2, c)
    pair = lambda c: F.when(F.size(own) >= 2, c)
    forms = F.array(whole, _last(parts, 1), _first(parts, 1), two(_first(parts, 2)), two(_last(parts, 2)), two(inner), two(outer), F.array_join(own, " "), _first(own, 1), _last(own, 1), pair(_first(own, 2)), pair(_last(own, 2)))
    kept = F.array_distinct(F.filter(F.transform(forms, lambda f: F.btrim(f)), lambda f: f.isNotNull() & (f != "")))
    return F.when(whole == "", F.array(F.lit(""))).otherwise(F.slice(kept, F.lit(1), F.lit(6)))


def given_variants(given: Column, family: Column) -> Column:
    """At most three given names: as it is, and with the words before the family's last or after its first, particles left out."""
    g, parts = _spaced(given), _name_parts(_spaced(family))
    size = F.size(parts)
    before = _own_parts(F.slice(parts, F.lit(1), F.greatest(size - 1, F.lit(0))))
    after = _own_parts(F.slice(parts, F.lit(2), F.greatest(size - 1, F.lit(0))))
    joined = lambda words: F.when((g != "") & (F.size(words) > 0), F.concat_ws(" ", g, F.array_join(words, " ")))
    forms = F.array_distinct(F.filter(F.array(g, joined(before), joined(after)), lambda f: f.isNotNull()))
    return F.slice(forms, F.lit(1), F.lit(3))


def _plain_name(x: Column) -> Column:
    y = F.regexp_replace(F.btrim(F.lower(ascii_fold(F.coalesce(x, F.lit(""))))), r"[^a-z0-9\s\-]", " ")
    return F.btrim(F.regexp_replace(y, r"\s+", " "))


def name_match_score(name: Column, given: Column, family: Column) -> Column:
    """How well a candidate fits a name, 0 to 1: family name 0.7 (or its last word 0.6), initial 0.2 (another one: -0.1), first word 0.1."""
    qg, qf, cg, cf = (_plain_name(x) for x in (given_name(name), family_name(name), given, family))
    both = (qf != "") & (cf != "")
    same = both & ((qf == cf) | (F.replace(qf, F.lit(" "), F.lit("")) == F.replace(cf, F.lit(" "), F.lit(""))))
    last = both & (F.element_at(F.split(qf, " "), -1) == F.element_at(F.split(cf, " "), -1))
    given_both = (qg != "") & (cg != "")
    initial = F.left(qg, F.lit(1)) == F.left(cg, F.lit(1))
    word = F.split_part(qg, F.lit(" "), F.lit(1)) == F.split_part(cg, F.lit(" "), F.lit(1))
    score = F.when(same, 0.7).when(last, 0.6).otherwise(0.0) + F.when(given_both & initial, 0.2).when(given_both, -0.1).otherwise(0.0) + F.when(given_both & word, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 6)))


#: Words that say nothing of an organisation.
ORG_STOP = ["and", "da", "das", "de", "den", "der", "die", "do", "du", "for", "of", "the"]
#: Forms of one word.
ORG_FORMS = [("universitaet|universit[aä]t|universitat|university|uni", "uni"), ("centre|center|ctr", "center"), ("behaviour|behavior", "behavior"), ("institut|institute", "inst")]


def org_tokens(x: Column) -> Column:
    """The words of an organisation's name, folded to one form each, without words that say nothing."""
    y = F.lower(ascii_fold(F.coalesce(x, F.lit(""))))
    for forms, one in ORG_FORMS:
        y = F.regexp_replace(y, rf"(?U)\b({forms})\b", one)
    words = F.split(F.regexp_replace(y, "[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda t: (t != "") & ~t.isin(ORG_STOP)))


def org_match(name: Column, patterns: list[str]) -> Column:
    """All words of some pattern are in the name; blank patterns match nothing."""
    words = org_tokens(name)
    return F.coalesce(reduce(lambda a, b: a | b, [covers_tokens(org_tokens(F.lit(p)), words) for p in patterns], F.lit(False)), F.lit(False))


def host_tokens(host: Column) -> Column:
    """Labels of a host name, and their parts between hyphens, in order."""
    labels = F.filter(F.split(F.lower(host), r"\."), lambda t: t != "")
    return F.filter(F.flatten(F.transform(labels, lambda t: F.concat(F.array(t), F.split(t, "-")))), lambda t: t != "")


def context_tokens(websites: list[Column], email: Column, texts: list[Column], stop: list[str]) -> Column:
    """Distinct words of three signs or more: of the hosts of URLs, of an e-mail's domain, of free texts, in this order; ``stop`` words go."""
    none = F.array().cast("array<string>")
    hosts = [F.flatten(F.transform(F.split(F.coalesce(w, F.lit("")), "[ ,;]+"), lambda u: host_tokens(F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit(""))))) for w in websites]
    domain = host_tokens(F.regexp_extract(F.coalesce(email, F.lit("")), r"@([A-Za-z0-9.\-]+)", 1))
    words = [F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "") for t in texts]
    every = F.concat(none, *hosts, domain, *words)
    return F.array_distinct(F.filter(every, lambda t: (F.length(t) >= 3) & ~t.isin(stop)))


def jaccard_boost(institution: Column, context: Column) -> Column:
    """A fifth of the shared part of an institution's and the context's words: 0 to 0.2."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.btrim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9\s\-]", " "), r"\s+", " ")), " "), lambda t: t != ""))
    return F.coalesce(F.least(F.lit(0.2), 0.2 * token_jaccard(words(institution), words(F.array_join(context, " ")))), F.lit(0.0))


#: Aliases that name nobody.
NO_NAMES = ["author", "authors", "n/a", "none", "unknown"]


def alias_forms(x: Column) -> Column:
    """The forms in which a name becomes an alias: without quotes and extra blanks, and "Last, First" also swapped; placeholders have none."""

    def clean(y: Column) -> Column:
        y = F.regexp_replace(F.btrim(F.coalesce(y, F.lit(""))), '^"+|"+$', "")
        return F.btrim(F.regexp_replace(F.regexp_replace(y, "^'+|'+$", ""), r"\s+", " "))

    whole = clean(x)
    parts = F.filter(F.transform(F.split(whole, ","), lambda t: F.btrim(t)), lambda t: t != "")
    swapped = F.when(F.size(parts) >= 2, clean(F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))))
    forms = F.array(whole, F.when(F.lower(swapped) != F.lower(whole), swapped))
    return F.filter(forms, lambda f: f.isNotNull() & (f != "") & ~F.lower(f).isin(NO_NAMES))


def long_enough(name: Column, words: int = 2, signs: int = 5) -> Column:
    """A name that may be searched for: enough words and signs."""
    y = _spaced(name)
    return (F.size(F.filter(F.split(y, " "), lambda t: t != "")) >= words) & (F.length(y) >= signs)


def affiliation_match(affiliations: Column, terms: list[str]) -> Column:
    """Some affiliation holds some term, both as plain text; without terms everything matches."""
    wanted = [t for t in (" ".join("".join(c if c.isascii() and c.isalnum() else " " for c in x.lower()).split()) for x in terms) if t]
    if not wanted:
        return F.lit(True)
    return F.coalesce(F.exists(affiliations, lambda a: reduce(lambda p, q: p | q, [F.contains(affiliation_text(F.coalesce(a, F.lit(""))), F.lit(t)) for t in wanted])), F.lit(False))


def equal_contribution(notes: Column, order_tag: Column) -> Column:
    """co-first, co-last or equal-contrib if an author's notes speak of equal parts, else null."""
    low = F.lower(F.coalesce(notes, F.lit("")))
    tag = F.when((order_tag == "first") & F.contains(low, F.lit("first")), "co-first").when((order_tag == "last") & F.contains(low, F.lit("last")), "co-last").otherwise("equal-contrib")
    return F.when(F.contains(low, F.lit("equal")), tag)


def bibliography_title(x: Column) -> Column:
    """A title without tags and without a dot at its end; blank is null."""
    y = F.btrim(F.regexp_replace(x, "<[^>]+>", ""))
    return blank_to_null(F.when(F.endswith(y, F.lit(".")), F.rtrim(F.left(y, F.length(y) - 1))).otherwise(y))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared part of two token arrays; 0 when both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def covers_tokens(pattern: Column, tokens: Column) -> Column:
    """All tokens of a non-empty pattern are there."""
    return (F.size(pattern) > 0) & (F.size(F.array_except(pattern, tokens)) == 0)


#: Letters whose ASCII form is more than their base letter.
DIGRAPHS = {"ß": "ss", "ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue"}


def fold(text: str) -> str:
    """ASCII form: digraphs first, then decomposition without combining marks."""
    text = "".join(DIGRAPHS.get(c, c) for c in text)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def ascii_fold(x: pd.Series) -> pd.Series:
    return x.map(fold, na_action="ignore")


@F.pandas_udf(T.StringType())
def plain_text(x: pd.Series) -> pd.Series:
    """Without markup tags, entities resolved, white space collapsed."""
    return x.map(lambda t: re.sub(r"\s+", " ", html.unescape(re.sub(r"</?[A-Za-z][^<>]*>", "", t))).strip(), na_action="ignore")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts; null if either is null."""
    return pd.Series([None if pd.isna(x) or pd.isna(y) else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def name_similarity(a: Column, b: Column) -> Column:
    """0 unless the last words agree, else the sequence ratio of the matching forms."""
    x, y = match_name(a), match_name(b)
    same = (F.element_at(F.split(x, " "), -1) == F.element_at(F.split(y, " "), -1)) & (x != "")
    return F.when(same, sequence_ratio(x, y)).otherwise(F.lit(0.0))


def title_similarity(a: Column, b: Column) -> Column:
    """Sequence ratio of two titles as :func:`comparable_title`; 0 if one is empty."""
    x, y = comparable_title(F.coalesce(a, F.lit(""))), comparable_title(F.coalesce(b, F.lit("")))
    return F.when((x != "") & (y != ""), sequence_ratio(x, y)).otherwise(F.lit(0.0))
