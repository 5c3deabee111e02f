"""Dates with partial precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_number(*texts: Column) -> Column:
    """The first of several texts that is all digits, as a number."""
    return F.coalesce(*[F.when(t.rlike("^[0-9]+$"), t.try_cast("int")) for t in texts])


def clamped_date(year: Column, month: Column, day: Column) -> Column:
    """A date with month in 1-12 and day within the month; a missing month or day counts as 1; no year, no date."""
    m = F.least(F.greatest(F.coalesce(month, F.lit(1)), F.lit(1)), F.lit(12))
    start = F.make_date(year, m, F.lit(1))
    d = F.least(F.greatest(F.coalesce(day, F.lit(1)), F.lit(1)), F.day(F.last_day(start)))
    return F.date_add(start, d - 1)


def date_precision(year: Column, month: Column, day: Column) -> Column:
    return F.when(year.isNull(), F.lit(None)).when(month.isNull(), "year").when(day.isNull(), "month").otherwise("day")


def flexible_date(x: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD; anything else, or no such day, is null."""
    full = F.when(x.rlike(r"^\d{4}$"), F.concat(x, F.lit("-01-01"))).when(x.rlike(r"^\d{4}-\d{2}$"), F.concat(x, F.lit("-01"))).when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), x)
    return full.try_cast("date")


def due(last: Column, now: Column, days: int) -> Column:
    """Never refreshed, or longer ago than ``days``."""
    return last.isNull() | (last < now - F.make_dt_interval(F.lit(days)))


def _parts(payload: Column, path: str, k: int) -> Column:
    return F.get_json_object(payload, f"$.{path}['date-parts'][0][{k}]")


def publication_date(payload: Column, year: Column) -> tuple[Column, Column]:
    """(date, precision): month and day each from the first source that has digits there.

    Sources in order: Crossref issued, published, published-print, ORCID, OpenAlex. Without a year there is neither.
    """
    found = []
    for k, unit in ((1, "month"), (2, "day")):
        texts = [_parts(payload, f"crossref{f}", k) for f in (".issued", ".published", "['published-print']")]
        texts.append(F.get_json_object(payload, f"$.orcid['publication-date'].{unit}.value"))
        whole = F.get_json_object(payload, "$.openalex.publication_date")
        texts.append(F.when(whole.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(whole, 6 if k == 1 else 9, 2)))
        found.append(first_number(*texts))
    month, day = found
    precision = F.when(year.isNull(), F.lit(None)).when(day.isNotNull(), "day").when(month.isNotNull(), "month").otherwise("year")
    return clamped_date(year, month, day), precision


def _parts_date(payload: Column, field: str) -> Column:
    """A date of date-parts; missing parts count as 1; null unless it is a real day."""
    at = lambda k: F.get_json_object(payload, f"$['{field}']['date-parts'][0][{k}]")
    y, m, d = at(0), F.coalesce(at(1), F.lit("1")), F.coalesce(at(2), F.lit("1"))
    real = y.rlike(r"^\d{1,4}$") & m.rlike(r"^\d{1,2}$") & d.rlike(r"^\d{1,2}$")
    return F.when(real, F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date"))


def picked_date(work: Column, fallback_year: Column | None = None) -> Column:
    """The date of a Crossref work: print, online, issued, created, published, else the first of January of a year that is known."""
    whole = [_parts_date(work, f) for f in ("published-print", "published-online", "issued", "created", "published")]
    years = [F.get_json_object(work, f"$['{f}']['date-parts'][0][0]") for f in ("published", "issued")]
    january = [F.concat(F.lpad(F.when(y.rlike(r"^\d{1,4}$"), y), 4, "0"), F.lit("-01-01")).try_cast("date") for y in years]
    last = [] if fallback_year is None else [F.when(fallback_year.between(1, 9999), F.concat(F.lpad(fallback_year.cast("string"), 4, "0"), F.lit("-01-01")).try_cast("date"))]
    return F.coalesce(*whole, *january, *last)


def work_year(work: Column) -> Column:
    """The year of a Crossref work: issued, online, print, created."""
    return first_number(*[F.get_json_object(work, f"$['{f}']['date-parts'][0][0]") for f in ("issued", "published-online", "published-print", "created")])


def partial_iso(value: Column) -> Column:
    """An ORCID date object as YYYY, YYYY-MM or YYYY-MM-DD; null without a year."""
    at = lambda unit: first_number(F.get_json_object(value, f"$.{unit}.value"))
    y, m, d = at("year"), at("month"), at("day")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    year = F.lpad(y.cast("string"), 4, "0")
    return F.when(y.isNull() | (y == 0), F.lit(None)).when(m.isNull() | (m == 0), year).when(d.isNull() | (d == 0), F.concat_ws("-", year, two(m))).otherwise(F.concat_ws("-", year, two(m), two(d)))


def millis_date(millis: Column) -> Column:
    """The UTC day of epoch milliseconds; null for other texts."""
    seconds = F.floor(F.when(millis.rlike(r"^-?\d{1,15}$"), millis.try_cast("long")) / 86_400_000)
    return F.date_add(F.lit("1970-01-01").cast("date"), seconds.cast("int"))


def newest_message(a_at: Column, a: Column, b_at: Column, b: Column) -> Column:
    """Of two (time, message) the later one's message, a missing time being the earliest; of equal times the first's."""
    return F.when(b_at.isNull() | (a_at >= b_at), a).otherwise(b)
