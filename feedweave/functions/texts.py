"""Text classification as column expressions: word counts, junk titles, description lines, interstitials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave.functions import lexicon as L

WORD = r"[\p{L}\p{M}\p{Nd}]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[ \t\r\n\f\x0B]+", " "))


def word_count(x: Column) -> Column:
    """Runs of letters, marks and digits; 0 for null."""
    return F.size(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(WORD), 0)).cast("long")


def utility(x: Column) -> Column:
    return F.coalesce(F.regexp_like(x, F.lit(L.UTILITY_TEXT)), F.lit(False))


def utility_prefix(x: Column) -> Column:
    return F.coalesce(F.regexp_like(x, F.lit(L.UTILITY_PREFIX_TEXT)), F.lit(False))


def recommended(x: Column) -> Column:
    return F.coalesce(F.regexp_like(x, F.lit(L.RECOMMENDED_TEXT)), F.lit(False))


def junk_title_reason(title: Column) -> Column:
    """Reason of the first rule that matches; null where none does."""
    out = None
    for reason, pattern in L.JUNK_TITLE_RULES:
        out = (F if out is None else out).when(F.regexp_like(title, F.lit(pattern)), F.lit(reason))
    return out


def _lower_in(x: Column, words: tuple) -> Column:
    return F.lower(x).isin(*words)


def date_core(line: Column) -> Column:
    """The line without a trailing type chip or clock, or without a leading type chip."""
    out = line
    for sep in reversed(L.CHIP_SEPARATORS):
        at = F.length(line) - F.instr(F.reverse(line), sep[::-1]) - (len(sep) - 2)
        has = F.instr(line, sep) > 0
        left = F.substr(line, F.lit(1), at - 1)
        right = F.substr(line, at + len(sep))
        peeled = F.when(_lower_in(right, L.TYPE_CHIPS) | F.regexp_like(right, F.lit(L.CLOCK_ZONE)), left).when(_lower_in(left, L.TYPE_CHIPS), right)
        out = F.when(has & peeled.isNotNull(), peeled).otherwise(out)
    return out


def date_shaped(line: Column) -> Column:
    """Whether a line, without chips, is a date; lines without a digit and long ones without a chip are not looked at closely."""

    def shape(core: Column) -> Column:
        hit = F.lit(False)
        for p in L.DATE_SHAPES:
            hit = hit | F.regexp_like(core, F.lit(p))
        return (F.length(core) <= L.MAX_DATE_CHARS) & (core != "") & hit

    parted = F.lit(False)
    for sep in L.CHIP_SEPARATORS:
        parted = parted | (F.instr(line, sep) > 0)
    return ((F.length(line) <= L.MAX_DATE_CHARS) | parted) & F.regexp_like(line, F.lit("[0-9]")) & let(F.when(parted, date_core(line)).otherwise(line), shape)


def keep_line(line: Column, title: Column) -> Column:
    """A description line stays unless blank, call to action, chip, section name, label, date or the title again."""
    key, t = F.lower(line), F.lower(F.trim(F.coalesce(title, F.lit(""))))
    chrome = key.isin(*L.CTA, *L.TYPE_CHIPS, *L.SECTION_NAMES) | F.endswith(line, F.lit(":")) | date_shaped(line) | ((t != "") & (key == t))
    return (line != "") & ~chrome


def description(text: Column, title: Column) -> Column:
    """Kept lines joined by line ends; null where none is kept."""
    lines = F.transform(F.split(text, r"\n+"), lambda x: F.trim(F.regexp_replace(x, r"[\s\p{Z}]+", " ")))
    kept = F.filter(lines, lambda x: keep_line(x, title))
    return let(kept, lambda k: F.when(F.size(k) > 0, F.array_join(k, "\n")))


def strip_title_echo(text: Column, title: Column) -> Column:
    """The first occurrence of the title goes if it begins in the first half."""
    at = F.instr(text, title)
    cut = F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(title)))
    return F.when((at > 0) & (at - 1 <= F.floor(F.length(text) * 0.5)), cut).otherwise(text)


def interstitial(body: Column) -> Column:
    """Key of the first signature with enough matches; null without one."""
    out = None
    for key, least, patterns in L.INTERSTITIALS:
        hits = F.lit(0)
        for p in patterns:
            hits = hits + F.regexp_like(body, F.lit(p)).cast("int")
        out = (F if out is None else out).when(hits >= least, F.lit(key))
    return out


def slug(x: Column) -> Column:
    """Lower case, other runs become dashes, one dash at each end goes; null if empty."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-", ""), "-$", "")
    return F.when(s != "", s)


def guid(source: Column) -> Column:
    return F.lower(F.conv(F.crc32(source).cast("string"), 10, 36))
