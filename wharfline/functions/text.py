"""Parsers for what carriers write: bills of lading, cities, dates, amounts, weights and pro numbers. Junk gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import MONEY

BOL_LENGTH = 8


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")


def canonical_bol(c: Column) -> Column:
    """Digits only, left-padded to eight; null without digits or with more than eight."""
    d = digits(c)
    return F.when(F.length(d).between(1, BOL_LENGTH), F.lpad(d, BOL_LENGTH, "0"))


def city_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def without_state(key: Column) -> Column:
    """A city key without a trailing two-letter state; null where there is none."""
    return F.when(key.rlike("^.+ [a-z0-9]{2}$"), F.regexp_replace(key, " [a-z0-9]{2}$", ""))


def parse_date(c: Column, *formats: str) -> Column:
    """The first format that fits; a format with a time of day gives its date. Years of two digits from 69 on are of the last century."""

    def read(f: str) -> Column:
        d = F.to_date(F.try_to_timestamp(c, F.lit(f)))
        return d if "yyyy" in f or "yy" not in f else F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)

    return F.coalesce(*[read(f) for f in formats])


def parse_money(c: Column) -> Column:
    return F.regexp_replace(c, r"[$,\s]", "").try_cast(MONEY)


def parse_weight(c: Column, unit: str = "lbs") -> Column:
    """Whole pounds from text like ``1,250 LB`` or hundredweights; null unless positive."""
    number = F.regexp_replace(F.regexp_replace(c, ",", ""), r"(?i)\s*lbs?\.?\s*$", "")
    pounds = F.trim(number).try_cast("decimal(18,4)") * (100 if unit == "cwt" else 1)
    whole = F.round(pounds, 0).cast("int")
    return F.when(whole > 0, whole)


def pro_parts(c: Column) -> tuple[Column, Column]:
    """The digits of a pro number and the suffix after them ('' if none); null where it does not begin with digits."""
    shape = r"^(\d+)(\D.*)?$"
    good = c.rlike(shape)
    return F.when(good, F.regexp_extract(c, shape, 1)), F.when(good, F.regexp_extract(c, shape, 2))


def lookup(c: Column, pairs: dict[str, str]) -> Column:
    """The value a text maps to, null for others."""
    if not pairs:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), c)


def noisy_bol(bol: Column, style: Column) -> Column:
    """Dressings that carriers put on a bill of lading, chosen by ``style`` (0 to 5)."""
    bare = F.regexp_replace(bol, "^0+", "")
    forms = [F.concat(F.lit("BOL-"), bol), F.concat(F.lit("BOL#"), bol), bare, F.concat(F.substring(bol, 1, 4), F.lit("-"), F.substring(bol, 5, 4)), F.concat(F.lit(" "), bol, F.lit(" ")), F.concat(F.lit("bol "), bare)]
    out = forms[-1]
    for i, form in enumerate(forms[:-1]):
        out = F.when(style == i, form).otherwise(out)
    return out


def transposed(bol: Column, at: Column) -> Column:
    """The text with the characters at places ``at`` and ``at + 1`` (from 1) swapped."""
    at = at.cast("int")
    return F.concat(F.substring(bol, F.lit(1), at - 1), F.substring(bol, at + 1, F.lit(1)), F.substring(bol, at, F.lit(1)), F.substring(bol, at + 2, F.length(bol)))
