"""Redaction of text by fixed detectors in order, each on what the one before left.

A detector with a check digit or a plausibility test keeps the matches that fail it. The
text is split at the matches and joined again with each match's replacement, which is a
replacement with a callback in native expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The shapes of the detectors.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
IBAN = r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){10,30}\b"
CARD = r"\b(?:\d[ -]?){12,18}\d\b"
# The look-aheads of a national number stand apart in national_id_ok, because the SQL that
# this is compared with runs on an engine without look-aheads.
NATIONAL_ID = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
PHONE = (
    r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,5}\)[ .-]?|\d{2,5}[ .-])\d{2,4}[ .-]?\d{2,4}(?:[ .-]?\d{2,4})?(?![\w.])"
)
DATE_LIKE = r"^\s*(?:\d{4}[ .-]\d{1,2}[ .-]\d{1,2}|\d{1,2}[ .-]\d{1,2}[ .-]\d{4})\s*$"
STYLES = {"tag": "<{}>", "mask": "****", "remove": ""}


def luhn_ok(match: Column) -> Column:
    """Check digit of a card number of at least 13 digits."""
    digits = F.split(F.reverse(F.regexp_replace(match, "[^0-9]", "")), "")
    digits = F.filter(digits, lambda d: d != "")

    def weighed(d: Column, i: Column) -> Column:
        n = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(n > 9, n - 9).otherwise(n)

    total = F.aggregate(F.transform(digits, weighed), F.lit(0), lambda a, n: a + n)
    return (F.size(digits) >= 13) & (total % 10 == 0)


def iban_ok(match: Column) -> Column:
    """Remainder 1 of the rearranged number by 97, carried from character to character."""
    compact = F.upper(F.replace(match, F.lit(" "), F.lit("")))
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))

    def carry(a: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.when(value > 9, a * 100 + value).otherwise(a * 10 + value) % 97

    letters = F.filter(F.split(turned, ""), lambda c: c.rlike("[A-Z0-9]"))
    return F.length(compact).between(15, 34) & (F.aggregate(letters, F.lit(0), carry) == 1)


def national_id_ok(match: Column) -> Column:
    return ~match.rlike("^(?:000|666|9[0-9][0-9])") & (F.substr(match, F.lit(5), F.lit(2)) != "00") & (F.right(match, F.lit(4)) != "0000")


def phone_ok(match: Column) -> Column:
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    marked = match.rlike(r"^\s*\+") | match.contains("(") | (F.regexp_count(F.trim(match), F.lit("[ .-]")) >= 2)
    return ~match.rlike(DATE_LIKE) & digits.between(9, 15) & marked


DETECTORS = [
    ("EMAIL", EMAIL, None),
    ("IBAN", IBAN, iban_ok),
    ("CARD", CARD, luhn_ok),
    ("NATIONAL_ID", NATIONAL_ID, national_id_ok),
    ("PHONE", PHONE, phone_ok),
]


def matches(text: Column, pattern: str, valid) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.filter(found, valid) if valid else found


def replaced(text: Column, pattern: str, valid, by: str) -> Column:
    """Text with valid matches replaced; null stays null."""
    if valid is None:
        return F.regexp_replace(text, pattern, by.replace("\\", r"\\").replace("$", r"\$"))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(valid(m), by).otherwise(m))
    joined = F.zip_with(F.split(text, pattern, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(joined, "")).otherwise(text)


def redact(rows: DataFrame, column: str, entities=None, style: str = "tag", names=()) -> DataFrame:
    """Adds ``redacted`` and one counter ``n_<entity>`` per detector to the rows.

    ``entities`` limits the detectors, an unknown one or style is an error; ``names`` are
    replaced last, whole words in any case, the longest first. Null and '' are unchanged.
    """
    import re

    known = [d[0] for d in DETECTORS] + ["PERSON"]
    wanted = known if entities is None else list(entities)
    if unknown := set(wanted) - set(known):
        raise ValueError(f"unknown entities: {sorted(unknown)}")
    if style not in STYLES:
        raise ValueError(f"unknown style: {style}")
    out = rows.withColumn("redacted", F.col(column))
    for entity, pattern, valid in DETECTORS:
        if entity in wanted:
            out = out.withColumn(f"n_{entity.lower()}", F.coalesce(F.size(matches(F.col("redacted"), pattern, valid)), F.lit(0))).withColumn(
                "redacted", replaced(F.col("redacted"), pattern, valid, STYLES[style].format(entity))
            )
    spelled = sorted({n.strip() for n in names if n.strip()}, key=lambda n: (-len(n), n))
    if spelled and "PERSON" in wanted:
        person = r"(?iu)(?<![\p{L}\p{N}_])(?:" + "|".join(re.escape(n) for n in spelled) + r")(?![\p{L}\p{N}_])"
        out = out.withColumn("n_person", F.coalesce(F.size(matches(F.col("redacted"), person, None)), F.lit(0))).withColumn(
            "redacted", replaced(F.col("redacted"), person, None, STYLES[style].format("PERSON"))
        )
    return out


def narrowest_targets(targets: DataFrame) -> DataFrame:
    """Mask targets (frame, dom_path) without those that contain another one.

    Each path is unfolded into its ancestors, so containment is an equi-join: the cost is
    the depth of the paths, not the square of their number.
    """
    rows = targets.select(F.coalesce("frame", F.lit("")).alias("frame"), "dom_path").where("dom_path <> ''").distinct()
    parts = F.split("dom_path", " > ")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), " > ")
    )
    ancestors = rows.where(F.size(parts) > 1).select("frame", F.explode(above).alias("dom_path")).distinct()
    return rows.join(ancestors, ["frame", "dom_path"], "left_anti")


def redact_snapshot(tree: Column) -> Column:
    """An accessibility tree without what was typed: text after typed roles is left out."""
    return F.regexp_replace(tree, r"(?m)^(\s*-\s+(?:textbox|searchbox)\b[^:\n]*):[ \t]*\S.*$", "$1:")
