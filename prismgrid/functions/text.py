"""Small text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
SPACES = r"[\s\p{Z}]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def filled(c: Column) -> Column:
    """Null for null, empty and blank text, else the text without outer white space."""
    return F.nullif(strip(c), F.lit(""))


def squeezed(c: Column) -> Column:
    """Lower case, inner white space as one space, none outside; '' for null."""
    return F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), SPACES, " ")


def any_word(words) -> str:
    """A pattern of any of the words, bounded by what is no letter, digit or underscore."""
    return r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + r")(?:[^\p{L}\p{N}_]|$)"
