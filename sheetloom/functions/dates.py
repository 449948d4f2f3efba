"""Dates, clock times and durations as they are written by hand. The readers differ on purpose; each accepts what its
users' sheets hold and gives null for the rest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    return c.try_cast("int")


def padded(c: Column, width: int = 2) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def iso_from(day: Column, month: Column, year: Column) -> Column:
    """YYYY-MM-DD as text, years under 100 as 20xx; months to 12 and days to 31, whatever the month has."""
    y = F.when(year < 100, year + 2000).otherwise(year)
    return F.when(day.between(1, 31) & month.between(1, 12) & y.between(1, 9999), F.concat_ws("-", padded(y, 4), padded(month), padded(day)))


def date_parts(c: Column) -> Column:
    """Day, month and year between any of - / . and white space; exactly three parts."""
    p = F.split(F.trim(c), r"[-/.\s]+")
    fits = (F.size(p) == 3) & F.forall(p, lambda x: x.rlike("^[0-9]+$"))
    return F.when(fits, iso_from(number(F.get(p, F.lit(0))), number(F.get(p, F.lit(1))), number(F.get(p, F.lit(2)))))


def date_numeric(c: Column) -> Column:
    """Day, month and year between single - / or . (no spaces), after which such a sign may trail."""
    at = r"^\s*([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{2,4})[-/.]*\s*$"
    part = lambda k: number(F.regexp_extract(c, at, k))
    return F.when(c.rlike(at), iso_from(part(1), part(2), part(3)))


def date_strict(c: Column) -> Column:
    """DD-MM-YYYY turned around, without a look at the ranges."""
    at = "^([0-9]{2})-([0-9]{2})-([0-9]{4})$"
    return F.when(F.trim(c).rlike(at), F.regexp_replace(F.trim(c), at, "$3-$2-$1"))


def hours(c: Column) -> Column:
    """Hours as a number: 8:30, 5,5 or 6 H; only above 0 and up to 24."""
    t = F.upper(F.trim(c))
    clock = r"^([0-9]{1,3})[:H]([0-9]{2})$"
    plain = r"^([0-9]+(?:[.,][0-9]+)?)\s*H?$"
    value = F.when(t.rlike(clock), F.regexp_extract(t, clock, 1).try_cast("double") + F.regexp_extract(t, clock, 2).try_cast("double") / 60).when(t.rlike(plain), F.replace(F.regexp_extract(t, plain, 1), F.lit(","), F.lit(".")).try_cast("double"))
    return F.when((value > 0) & (value <= 24), value)


def clock_strict(c: Column) -> Column:
    """Minutes since midnight: hours, one of : h . or ',', and two digits."""
    at = "^([0-9]{1,2})[:hH.,]([0-9]{2})$"
    t = F.trim(c)
    h, m = number(F.regexp_extract(t, at, 1)), number(F.regexp_extract(t, at, 2))
    return F.when(t.rlike(at) & (h <= 23) & (m <= 59), h * 60 + m)


def clock_loose(c: Column) -> Column:
    """Minutes since midnight, also from 11h, 9+15 and 1430."""
    t = F.lower(F.trim(c))
    two, one, run = r"^([0-9]{1,2})\s*[:h.,+]\s*([0-9]{1,2})$", r"^([0-9]{1,2})\s*h?$", "^([0-9]{1,2})([0-9]{2})$"
    part = lambda at, k: number(F.regexp_extract(t, at, k))
    h = F.when(t.rlike(two), part(two, 1)).when(t.rlike(one), part(one, 1)).when(t.rlike(run), part(run, 1))
    m = F.when(t.rlike(two), part(two, 2)).when(t.rlike(one), 0).when(t.rlike(run), part(run, 2))
    return F.when((h <= 23) & (m <= 59), h * 60 + m)


def minutes_between(start: Column, end: Column) -> Column:
    """Past midnight if the end is smaller; nothing over 12 hours."""
    d = F.when(end >= start, end - start).otherwise(end - start + 24 * 60)
    return F.when(d <= 12 * 60, d)


def length_between(start: Column, end: Column) -> Column:
    """HH:MM, past midnight if the end is smaller; empty for none."""
    d = F.when(end >= start, end - start).otherwise(end - start + 24 * 60)
    return F.when(d == 0, "").otherwise(F.concat_ws(":", padded(F.floor(d / 60)), padded(d % 60)))


def minutes_text(c: Column) -> Column:
    """Minutes from 1:30, 1h30, 2h or a number of minutes."""
    t = F.lower(F.trim(c))
    two, one, plain = "^([0-9]{1,3})[:h]([0-9]{1,2})$", "^([0-9]{1,3})h$", r"^([0-9]+)\s*(?:m|min)?$"
    part = lambda at, k: number(F.regexp_extract(t, at, k))
    return F.when(t.rlike(two), part(two, 1) * 60 + part(two, 2)).when(t.rlike(one), part(one, 1) * 60).when(t.rlike(plain), part(plain, 1))


def yes_no(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("s", "sim", "y", "yes", "x", "1", "true", "ok"), True).when(t.isin("n", "nao", "não", "no", "0", "false"), False)


def square_metres(c: Column) -> Column:
    """A number with a comma or a point, with or without a unit; nothing above 1000."""
    at = r"^\s*([0-9]+(?:[.,][0-9]+)?)\s*(?:m2|m²)?\s*$"
    v = F.replace(F.regexp_extract(F.lower(c), at, 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(v <= 1000, v)


def whole(c: Column) -> Column:
    """All but digits and minus signs dropped, then a number."""
    return F.regexp_replace(c, "[^0-9-]", "").try_cast("bigint")


def decimal(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def capture_day(ts: Column, zone: str) -> Column:
    """The local date of a moment kept in UTC."""
    return F.to_date(F.from_utc_timestamp(ts, zone))
