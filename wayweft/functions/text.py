"""Names, categories and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import c

LONG_NAME = 30


def is_blank(x) -> Column:
    """Null, empty or Unicode white space alone."""
    return c(x).isNull() | c(x).rlike(r"(?U)^\s*$")


def blank_to_null(x) -> Column:
    return F.when(~is_blank(x), c(x))


def empty_to_null(x) -> Column:
    return F.nullif(c(x), F.lit(""))


def utf16_length(x) -> Column:
    """Length in UTF-16 units: one more for each supplementary character."""
    return F.length(c(x)) + F.length(F.regexp_replace(c(x), r"[^\x{10000}-\x{10FFFF}]", ""))


def is_bare_label(x) -> Column:
    """A single character, or decimal digits alone."""
    trimmed = F.regexp_replace(c(x), r"(?U)^\s+|\s+$", "")
    return (utf16_length(trimmed) == 1) | trimmed.rlike(r"^\p{Nd}+$")


def resolve_name(name, short_name, brand, operator) -> Column:
    """The name, its short form if it is long, else brand, else operator; bare labels are no names."""
    name, short = blank_to_null(name), blank_to_null(short_name)
    found = F.coalesce(F.when(short.isNotNull() & (utf16_length(name) > LONG_NAME), short).otherwise(name), blank_to_null(brand), blank_to_null(operator))
    return F.when(~is_bare_label(found), found)


def klass(category) -> Column:
    return F.substring_index(c(category), ".", 1)


def subclass(category) -> Column:
    at = F.instr(c(category), ".")
    return F.when(at > 0, F.substr(c(category), at + 1)).otherwise(F.lit(""))


def humanize(category) -> Column:
    """The subclass in words, or `unnamed`."""
    at = F.instr(c(category), ".")
    plain = F.when(at > 0, F.substr(c(category), at + 1)).otherwise(c(category))
    return F.when(empty_to_null(category).isNull(), "unnamed").otherwise(F.translate(plain, "_", " "))


def name_of(name, category) -> Column:
    return F.coalesce(empty_to_null(name), humanize(category))


def slug(name) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(c(name)), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(plain == "", "chunk").otherwise(plain)


def token(rank, count) -> Column:
    """`[01]`: the rank, as wide as the count and at least two digits."""
    return F.concat(F.lit("["), F.lpad(c(rank).cast("string"), F.greatest(F.lit(2), F.length(c(count).cast("string"))), F.lit("0")), F.lit("]"))


def decimals4(x) -> Column:
    """Up to four decimals."""
    return F.call_function("format_number", c(x), F.lit("0.####"))


def counted(name, count) -> Column:
    return F.when(c(count) > 1, F.concat(c(name), F.lit(" ×"), c(count).cast("string"))).otherwise(c(name))
