"""Normalization keys and text scalars as native column expressions.

White space is Unicode's, as an explicit class: engines differ in what their short class holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
TRUNCATED = " ... [TRUNCATED]"


def clean_text(c: Column) -> Column:
    """N0: null is empty, white space collapsed, outer space gone."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))


def clean_multiline(c: Column) -> Column:
    """N1: N0 for each line, blank lines dropped."""
    lines = F.split(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")
    return F.array_join(F.filter(F.transform(lines, clean_text), lambda x: x != ""), "\n")


def official_key(c: Column) -> Column:
    """N2: N0 and lower case; punctuation stays."""
    return F.lower(clean_text(c))


def loose_key(c: Column) -> Column:
    """N3: tags of two or three capital letters go, lower case, all but a-z and 0-9 is space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(clean_text(c), r"\[/?[A-Z]{2,3}\]", " ")), "[^a-z0-9]+", " "))


def compact_key(c: Column) -> Column:
    """N6: trade marks and micro signs spelled, lower case, letters and digits alone."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"\[/?[A-Z]{2,3}\]", "")
    out = F.replace(F.replace(F.replace(out, F.lit("™"), F.lit("tm")), F.lit("®"), F.lit("r")), F.lit("µ"), F.lit("u"))
    return F.regexp_replace(F.lower(out), "[^a-z0-9]", "")


def dedupe_key(c: Column) -> Column:
    """N7: tags stripped, lower case, white space; punctuation stays."""
    return F.lower(clean_text(F.regexp_replace(F.coalesce(c, F.lit("")), r"\[/?[A-Z]{2,3}\]", " ")))


def typography_key(c: Column) -> Column:
    """N8: dashes are one, a hyphen between letters is a space, a final period goes."""
    out = F.regexp_replace(official_key(c), "[‐‑‒–—−]", "-")
    out = F.regexp_replace(out, r"([a-z])-([a-z])", "$1 $2")
    return F.regexp_replace(out, r"\.$", "")


def truncate(c: Column, n: int) -> Column:
    """Over n characters: the first n - 18, right-trimmed, and a marker."""
    return F.when(F.length(c) > n, F.concat(F.regexp_replace(F.substring(c, 1, n - 18), r"[\s]+$", ""), F.lit(TRUNCATED))).otherwise(c)


def tagged_items(c: Column, tag: str = "I") -> Column:
    """Cleaned texts between [B?] and [E?], empty ones dropped."""
    found = F.regexp_extract_all(c, F.lit(rf"(?s)\[B{tag}\](.*?)\[E{tag}\]"), F.lit(1))
    return F.filter(F.transform(found, clean_text), lambda x: x != "")


def serialize_items(items: Column, tag: str = "I") -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit(f"[B{tag}]"), x, F.lit(f"[E{tag}]"))), "")


def ordered_distinct(items: Column) -> Column:
    """First occurrences, in order."""
    return F.array_distinct(items)


def yes_no(c: Column) -> Column:
    low = official_key(c)
    return F.when(low.rlike("^yes"), "yes").when(low.rlike("^no"), "no")


def answer_style(c: Column) -> Column:
    return F.when(c.rlike(r"\[BI\]"), "list").when(c.rlike(r"\[BE\]"), "factoid").when(yes_no(c).isNotNull(), "yesno").otherwise("other")


def count_bucket(n: Column) -> Column:
    out = F.when(n == 0, "0")
    for lo, hi in ((1, 5), (6, 10), (11, 20), (21, 50), (51, 100)):
        out = out.when(n <= hi, f"{lo}-{hi}")
    return out.otherwise(">100")


def is_placeholder(c: Column) -> Column:
    return F.lower(c).rlike(r"^(item|expression)_\d+$")
