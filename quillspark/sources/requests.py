"""Query strings of metadata providers, the products of their parameters, and validated job configurations (no network, no tables)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import product


def quoted(term: str, escape: str = '\\"') -> str:
    """A search term, in quotation marks if it holds a blank; marks inside become ``escape``."""
    plain = term.strip().replace('"', escape)
    return f'"{plain}"' if re.search(r"\s", plain) else plain


def any_of(terms: Iterable[str]) -> str | None:
    kept = [t for t in terms if t]
    return None if not kept else kept[0] if len(kept) == 1 else f"({' OR '.join(kept)})"


def crossref_filter(award: str | None = None, funder: str | None = None, orcid: str | None = None, from_year: int | None = None, to_year: int | None = None) -> str | None:
    named = {"award.number": award, "funder": funder, "orcid": orcid, "from-pub-date": from_year and f"{from_year}-01-01", "until-pub-date": to_year and f"{to_year}-12-31"}
    return ",".join(f"{k}:{v}" for k, v in named.items() if v) or None


def openalex_filter(award_field: str, award: str | None = None, affiliation: str | None = None, from_year: int | None = None, to_year: int | None = None) -> str:
    named = {award_field: award, "authorships.institutions.display_name.search": affiliation, "from_publication_date": from_year and f"{from_year}-01-01", "to_publication_date": to_year and f"{to_year}-12-31"}
    return ",".join(f"{k}:{v}" for k, v in named.items() if v)


def crossref_specs(awards: list[str], affiliations: list[str], funders: list[str], orcids: list[str], award_mode: str = "filter", from_year: int | None = None, to_year: int | None = None) -> Iterator[dict[str, str]]:
    """Parameters of each combination; an empty list counts as one that asks for nothing."""
    for award, affiliation, funder, orcid in product(awards or [None], affiliations or [None], funders or [None], orcids or [None]):
        asked = {"filter": crossref_filter(award if award_mode in ("filter", "both") else None, funder, orcid, from_year, to_year), "query.affiliation": affiliation, "query": award if award_mode in ("query", "both") else None}
        yield {k: v for k, v in asked.items() if v}


def openalex_specs(awards: list[str], affiliations: list[str], award_field: str, award_mode: str = "filter", from_year: int | None = None, to_year: int | None = None) -> Iterator[tuple[str, str | None]]:
    for award, affiliation in product(awards or [None], affiliations or [None]):
        yield openalex_filter(award_field, award if award_mode in ("filter", "both") else None, affiliation, from_year, to_year), award if award and award_mode in ("query", "both") else None


def datacite_query(query: str | None = None, dois: Iterable[str] = (), titles: Iterable[str] = (), awards: Iterable[str] = (), affiliations: Iterable[str] = (), addresses: Iterable[str] = ()) -> str:
    groups = [f"({query})" if query else None, *(any_of(quoted(t) for t in terms) for terms in (dois, titles, awards, affiliations, addresses))]
    if not any(groups):
        raise ValueError("a search needs at least one term")
    return " AND ".join(g for g in groups if g)


def _series(value: str, mode: str) -> str:
    name = value.strip()
    if not name:
        return ""
    if mode == "stream":
        return name if name.startswith("stream:") else f"stream:{name if '/' in name else f'series/{name}'}"
    return f"series:{quoted(name, chr(39))}" if mode == "field" else quoted(name, "'")


def dblp_query(query: str | None = None, titles: Iterable[str] = (), authors: Iterable[str] = (), venues: Iterable[str] = (), series: Iterable[str] = (), series_mode: str = "stream", dois: Iterable[str] = (), free: Iterable[str] = ()) -> str:
    def fielded(name: str, values: Iterable[str]) -> str | None:
        return any_of(f"{name}:{q}" for v in values if (q := quoted(v, "'")))

    groups = [f"({query})" if query else None, fielded("title", titles), fielded("author", authors), fielded("venue", venues), any_of(_series(v, series_mode) for v in series), fielded("doi", dois), any_of(quoted(v, "'") for v in free)]
    if not any(groups):
        raise ValueError("a search needs at least one term")
    return " AND ".join(g for g in groups if g)


def semantic_query(query: str | None = None, titles: Iterable[str] = (), free: Iterable[str] = ()) -> str:
    return " ".join([*([f"({query})"] if query else []), *(f'"{t.strip()}"' for t in titles if t.strip()), *(t.strip() for t in free if t.strip())])


STALE = {"stale_after_hours": "hours", "stale_after_days": "days", "stale_after_months": "months"}


@dataclass(frozen=True)
class Job:
    """A refresh job: what it asks, for whom, and after which time again."""

    name: str
    source: str
    scope_type: str
    module: str
    stale_after: tuple[str, int]
    scope_key: str | None = None
    limit: int = 20
    enabled: bool = True
    base_args: tuple[str, ...] = ()
    env: dict[str, str] = field(default_factory=dict)


def _count(value: object, where: str, default: int | None = None) -> int | None:
    if value is None:
        return default
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{where} must be a positive whole number")
    return value


def _word(item: dict, key: str, where: str) -> str:
    value = item.get(key)
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{where}.{key} must be a non-empty text")
    return value


def jobs(config: str) -> list[Job]:
    """The jobs of a JSON configuration; every violation raises with its place."""
    root = json.loads(config)
    listed = root.get("jobs") if isinstance(root, dict) else None
    if not isinstance(listed, list) or not listed:
        raise ValueError("the configuration needs a non-empty list of jobs")
    found: dict[str, Job] = {}
    for k, item in enumerate(listed):
        where = f"jobs[{k}]"
        if not isinstance(item, dict):
            raise ValueError(f"{where} must be an object")
        name, scope, key = _word(item, "name", where), item.get("scope_type"), item.get("scope_key")
        if name in found:
            raise ValueError(f"job {name} is there twice")
        if scope not in ("person", "query"):
            raise ValueError(f"{where}.scope_type must be person or query")
        if (scope == "query") != bool(key):
            raise ValueError(f"{where}.scope_key belongs to jobs of scope query, and to all of them")
        stale = [(unit, n) for option, unit in STALE.items() if (n := _count(item.get(option), f"{where}.{option}"))]
        if len(stale) != 1:
            raise ValueError(f"{where} needs exactly one of {', '.join(STALE)}")
        args = item.get("base_args") or []
        if not isinstance(args, list) or not all(isinstance(a, str) for a in args):
            raise ValueError(f"{where}.base_args must be a list of texts")
        found[name] = Job(name, _word(item, "source", where), scope, _word(item, "module", where), stale[0], key, _count(item.get("limit"), f"{where}.limit", 20) or 20, bool(item.get("enabled", True)), tuple(args), dict(item.get("env") or {}))
    return list(found.values())


def discovery_verdict(job: Job, total: int | None, threshold: int, error: str | None = None) -> str:
    """OK, OK (bounded), WARN with reasons, or ERROR for a discovery job: it needs a cap, and an any-word affiliation search a post-filter."""
    if error:
        return "ERROR"
    reasons = [] if "--max-new-records" in job.base_args else ["no --max-new-records cap"]
    if "--affiliation" in job.base_args and "--require-affiliation-match" not in job.base_args:
        reasons.append("any-word affiliation query without --require-affiliation-match")
    return "WARN: " + "; ".join(reasons) if reasons else "OK (bounded)" if total is not None and total >= threshold else "OK"


@dataclass(frozen=True)
class Page:
    after: int
    limit: int


def page_parameters(pairs: list[tuple[str, str]], most: int = 100, default: int = 50) -> Page:
    """``after`` and ``limit`` of a page request: whole numbers, each at most once, nothing else."""
    names = [k for k, _ in pairs]
    if unknown := set(names) - {"after", "limit"}:
        raise ValueError(f"unknown_parameter: {', '.join(sorted(unknown))}")
    given = dict(pairs)

    def number(key: str, low: int, high: int, otherwise: int) -> int:
        raw = given.get(key)
        if names.count(key) > 1 or raw is not None and not (re.fullmatch("[0-9]{1,19}", raw) and low <= int(raw) <= high):
            raise ValueError(f"invalid_parameter: {key}")
        return otherwise if raw is None else int(raw)

    return Page(number("after", 0, 2**63 - 1, 0), number("limit", 1, most, default))
