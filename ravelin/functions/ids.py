"""Identifiers: trimming, evening out of spelling, references in prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, with the space-like and invisible characters that Java's \s leaves out.
_EDGE = r"^[\s\p{Z}\x{FEFF}\x{200B}-\x{200D}\x{2060}]+|[\s\p{Z}\x{FEFF}\x{200B}-\x{200D}\x{2060}]+$"
#: A requirement id at the beginning of a text: REQ-, area, -, seven digits.
REQUIREMENT_PREFIX = r"(?i)^(REQ-[A-Z0-9_]+-\d{7})(?!\d)"


def clean_id(c: Column | str) -> Column:
    """``c`` without surrounding white space; null if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    trimmed = F.when(c.rlike(r"^[\x21-\x7E]*$"), c).otherwise(F.regexp_replace(c, _EDGE, ""))
    return F.when(trimmed != "", trimmed)


def clean_requirement_id(c: Column | str) -> Column:
    """As :func:`clean_id`, in upper case: ids of requirements, work units and specs."""
    return F.upper(clean_id(c))


def leading_requirement_id(c: Column | str) -> Column:
    """The requirement id that a text begins with, in upper case; null if it begins with none."""
    found = F.regexp_extract(clean_id(c), REQUIREMENT_PREFIX, 1)
    return F.when(found != "", F.upper(found))


def spelling(c: Column | str) -> Column:
    """A mode or label with case, surrounding space and separators evened out; null stays null."""
    return F.regexp_replace(F.lower(clean_id(c)), r"[_\s-]+", "-")
