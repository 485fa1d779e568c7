"""Label expressions: MPL- and one to six numbers of three digits between dots, then perhaps a letter for a variant.

Labels are names; the hierarchy is in the parent column, which labels are never taken to tell.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The prefix, the most numbers, the largest number, and the digits of one.
PREFIX, MAX_DEPTH, MAX_NUMBER, DIGITS = "MPL-", 6, 999, 3
WHOLE = r"^MPL-(\d{3}(?:\.\d{3})*)([a-z])?$"
MENTION = r"\bMPL-\d{3}(?:\.\d{3})*[a-z]?\b"


def _body(label: Column) -> Column:
    return F.regexp_extract(label, WHOLE, 1)


def is_valid(label: Column) -> Column:
    """False for null, malformed and too deep labels."""
    return F.coalesce(label.rlike(WHOLE) & (F.size(F.split(_body(label), r"\.")) <= MAX_DEPTH), F.lit(False))


def segments(label: Column) -> Column:
    """The numbers, as integers; null for a label that isn't valid."""
    return F.when(is_valid(label), F.transform(F.split(_body(label), r"\."), lambda x: x.cast("int")))


def suffix(label: Column) -> Column:
    """The variant's letter, else null."""
    found = F.regexp_extract(label, WHOLE, 2)
    return F.when(is_valid(label) & (found != ""), found)


def depth(label: Column) -> Column:
    return F.when(is_valid(label), F.size(segments(label)))


def formed(numbers: Column, letter: Column | None = None) -> Column:
    """The label of an array of numbers and a letter."""
    body = F.array_join(F.transform(numbers, lambda x: F.lpad(x.cast("string"), DIGITS, "0")), ".")
    return F.concat(F.lit(PREFIX), body, F.coalesce(letter, F.lit("")) if letter is not None else F.lit(""))


def parent(label: Column) -> Column:
    """Of a variant its base, else the label without its last number; null at the top and for labels that aren't valid."""
    own = segments(label)
    return F.when(suffix(label).isNotNull(), formed(own)).when(F.size(own) > 1, formed(F.slice(own, 1, F.size(own) - 1)))


def mentions(text: Column) -> Column:
    """The labels that a text names, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MENTION), F.lit(0)))
