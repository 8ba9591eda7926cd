"""Dates in text as column expressions: a parser for machine, mail and prose dates that knows the channel's zone.

A text with an offset (``Z`` or ``+hh:mm`` at its end) is that instant. Any other is local time of the zone: one that a clock
change repeats is standard time (the later of the two), one that it skips is read as UTC, and so is every time of an unknown
zone. Three numbers are year, month, day if the last has two digits at most, else day, month, year. What has no day, or
no such day, is null.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave.functions.texts import let

MAX_CHARS = 128
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*([AaPp]\.?[Mm]\.?)?\s*([Zz]|[+-]\d{2}:?\d{2}|[A-Za-z]{2,5}(?:/[A-Za-z_]+)*)?$"
_NUMBERS = r"^(\d{1,4})[./-](\d{1,2})[./-](\d{1,4})$"
_DAY_FIRST = r"^(\d{1,2})(?:st|nd|rd|th)?\.?[ -](\p{L}{3,9})\.?\s*,?[ -]?(\d{4})$"
_MONTH_FIRST = r"^(\p{L}{3,9})\.? (\d{1,2})(?:st|nd|rd|th)?\s*,? ?(\d{4})$"


def known_zone(zone: str | None) -> str:
    return zone if zone in available_timezones() else "UTC"


def _number(x: Column) -> Column:
    return x.try_cast("int")


def _groups(x: Column, pattern: str, n: int) -> Column:
    """The groups of a pattern that x matches, by one pass over it."""
    return F.split(F.regexp_replace(x, pattern, "|".join(f"${k}" for k in range(1, n + 1))), r"\|", -1)


def _month(name: Column) -> Column:
    return let(F.instr(F.lit(MONTHS), F.lower(F.left(name, F.lit(3)))), lambda at: F.when((at > 0) & ((at - 1) % 3 == 0), F.floor((at - 1) / 3) + 1).cast("int"))


def _day(x: Column) -> Column:
    """Struct y, m, d of a date without a time; null where it has none."""

    def date(y: Column, m: Column, d: Column) -> Column:
        return F.struct(_number(y).alias("y"), m.cast("int").alias("m"), _number(d).alias("d"))

    def numbers(g: Column) -> Column:
        late = F.length(g[2]) > 2
        short = F.when(late, g[2]).otherwise(g[0])
        year = F.when(F.length(short) > 2, _number(short)).otherwise(_number(short) + F.when(_number(short) >= 69, 1900).otherwise(2000))
        return F.struct(year.cast("int").alias("y"), _number(g[1]).alias("m"), _number(F.when(late, g[0]).otherwise(g[2])).alias("d"))

    digits = F.regexp_like(x, F.lit(r"^\d{1,4}[./-]\d"))
    first = F.regexp_like(x, F.lit(r"^\d"))
    return (
        F.when(digits, F.when(F.regexp_like(x, F.lit(_NUMBERS)), let(_groups(x, _NUMBERS, 3), numbers)))
        .when(first, F.when(F.regexp_like(x, F.lit(_DAY_FIRST)), let(_groups(x, _DAY_FIRST, 3), lambda g: date(g[2], _month(g[1]), g[0]))))
        .when(F.regexp_like(x, F.lit(_MONTH_FIRST)), let(_groups(x, _MONTH_FIRST, 3), lambda g: date(g[2], _month(g[0]), g[1])))
    )


def _local(text: Column) -> Column:
    """Struct of local time (without zone) and the offset in seconds it names, null without one."""

    def read(x: Column) -> Column:
        return let(F.regexp_extract(x, _CLOCK, 0), lambda clock: parted(x, clock))

    def parted(x: Column, clock: Column) -> Column:
        day = F.regexp_replace(F.left(x, F.length(x) - F.length(clock)), r"(?:\s*(?:,|\bat\b)?\s*|T)$", "")
        parts = F.struct(F.when(clock != "", _groups(clock, _CLOCK, 5)).alias("g"), F.when(clock != "", day).otherwise(x).alias("day"))
        return let(parts, timed)

    def timed(p: Column) -> Column:
        clock = [p["g"][k] for k in range(5)]
        late, zone = F.lower(F.left(clock[3], F.lit(1))), F.upper(clock[4])
        hour = F.when(late == "p", _number(clock[0]) % 12 + 12).when(late == "a", _number(clock[0]) % 12).otherwise(_number(clock[0]))
        sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
        seconds = sign * (_number(F.substr(zone, F.lit(2), F.lit(2))) * 3600 + _number(F.right(zone, F.lit(2))) * 60)
        offset = F.when(zone == "Z", 0).when(F.left(zone, F.lit(1)).isin("+", "-"), seconds)

        def made(d: Column) -> Column:
            times = [F.coalesce(_number(clock[k]), F.lit(0)) for k in (1, 2)]
            at = F.try_make_timestamp_ntz(d["y"], d["m"], d["d"], F.coalesce(hour, F.lit(0)), *times)
            return F.struct(at.alias("at"), offset.cast("int").alias("offset"))

        return let(_day(p["day"]), made)

    plain = F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))
    plain = F.regexp_replace(plain, r"^\p{L}{2,9}\.?, ?(?=[\p{L}\d])", "")  # a weekday
    return let(plain, lambda x: F.when(F.length(x) <= MAX_CHARS, read(x)))


def moment(text: Column, zone: str = "UTC") -> Column:
    """Struct of instant (UTC), local time and offset in seconds; null where the text is no date."""
    zone = known_zone(zone)

    def there(x: Column) -> Column:
        return F.convert_timezone(F.lit("UTC"), F.lit(zone), x)

    def resolved(at: Column, offset: Column) -> Column:
        if zone == "UTC":
            return F.timestamp_add("SECOND", -F.coalesce(offset, F.lit(0)), at)

        def settled(first: Column) -> Column:
            hours_on = F.timestamp_add("HOUR", F.lit(3), first)
            later = F.timestamp_add("SECOND", -F.timestamp_diff("SECOND", hours_on, there(hours_on)), at)
            named = F.timestamp_add("SECOND", -offset, at)
            return F.when(offset.isNotNull(), named).when(there(first) != at, at).when((later > first) & (there(later) == at), later).otherwise(first)

        return let(F.convert_timezone(F.lit(zone), F.lit("UTC"), at), settled)

    def whole(x: Column) -> Column:
        def result(instant: Column) -> Column:
            return F.when(instant.isNotNull(), F.struct(instant.alias("instant"), x["at"].alias("at"), F.timestamp_diff("SECOND", instant, x["at"]).cast("int").alias("offset")))

        return let(resolved(x["at"], x["offset"]), result)

    return let(_local(text), whole)


def earliest(texts: Column, zone: str = "UTC") -> Column:
    """The moment of the earliest of an array of texts; those that are no dates do not count."""
    return F.array_min(F.filter(F.transform(texts, lambda x: moment(x, zone)), lambda m: m.isNotNull()))


def _offset(seconds: Column, gap: str) -> Column:
    size = F.abs(seconds)
    return F.concat(F.when(seconds < 0, "-").otherwise("+"), F.lpad(F.floor(size / 3600).cast("string"), 2, "0"), F.lit(gap), F.lpad(F.floor(size % 3600 / 60).cast("string"), 2, "0"))


def iso(m: Column) -> Column:
    """A moment as ISO 8601 to the second, in its own offset."""
    return let(m, lambda x: F.concat(F.date_format(x["at"], "yyyy-MM-dd'T'HH:mm:ss"), _offset(x["offset"], ":")))


def mail(m: Column) -> Column:
    """A moment as mail and RSS write it, in its own offset."""
    return let(m, lambda x: F.concat(F.date_format(x["at"], "EEE, dd MMM yyyy HH:mm:ss "), _offset(x["offset"], "")))
