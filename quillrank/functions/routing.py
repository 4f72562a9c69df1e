"""Local decisions on generated variants: accepted or rejected without a model where columns prove it (STR43), by keys of
formatting and of numeric expressions (STR42)."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import dedupe_key

# Phrases of comparison and their signs.
SIGNS = [
    (r"\b(?:more|greater)\s+than\b", ">"), (r"\b(?:less|fewer)\s+than\b", "<"),
    (r"\b(?:at\s+least|no\s+less\s+than)\b", ">="), (r"\b(?:at\s+most|no\s+more\s+than)\b", "<="), ("≥", ">="), ("≤", "<="),
]


@F.pandas_udf(StringType())
def unescaped(c: pd.Series) -> pd.Series:
    """HTML entities as characters; Spark has no function for them."""
    return c.map(html.unescape, na_action="ignore")


def routing_key(c: Column) -> Column:
    """Trade marks as letters, trailing punctuation gone, white space one, lower case; c is unescaped."""
    marked = F.replace(F.replace(c, F.lit("™"), F.lit(" TM")), F.lit("®"), F.lit(" R"))
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(marked, r"[\s.,;:]+$", ""), r"\s+", " ")))


def numeric_key(c: Column) -> Column:
    """A numeric expression with signs for words and no space; null without a digit; c is unescaped."""
    out = F.lower(c)
    for pattern, sign in SIGNS:
        out = F.regexp_replace(out, pattern, sign)
    out = F.regexp_replace(F.regexp_replace(out, r"(?<=\d),(?=\d)", ""), r"\s+", "")
    return F.when(out.rlike(r"\d"), out)


def _literal(c: Column) -> Column:
    """A pattern of the text itself, any white space for its spaces."""
    return F.regexp_replace(F.regexp_replace(c, r"([\\^$.|?*+()\[\]{}])", r"\\$1"), r"\s+", r"\\s+")


def in_parentheses(left: Column, right: Column, text: Column) -> Column:
    """text says left (right) or right (left)."""
    said = lambda a, b: F.regexp_like(text, F.concat(F.lit("(?i)"), _literal(a), F.lit(r"\s*\(\s*"), _literal(b), F.lit(r"\s*\)")))
    return (left != "") & (right != "") & (said(left, right) | said(right, left))


def local_decision(answer: Column, relation: Column, aliases: Column, snippets: Column) -> Column:
    """struct(decision, route): reject a repeated alias, accept what formatting, numbers or the snippets prove, else verify.

    answer and the arrays aliases and snippets are unescaped; null arrays are empty."""
    listed = F.coalesce(aliases, F.array().cast("array<string>"))
    texts = F.coalesce(snippets, F.array().cast("array<string>"))
    some = lambda check: F.coalesce(F.exists(listed, check), F.lit(False))
    out = lambda decision, route: F.struct(F.lit(decision).alias("decision"), F.lit(route).alias("route"))
    return (
        F.when(some(lambda a: dedupe_key(a) == dedupe_key(answer)), out("reject", "duplicates_official_alias"))
        .when((relation == "harmless_formatting") & some(lambda a: routing_key(a) == routing_key(answer)), out("accept", "deterministic_terminal_or_trademark_formatting"))
        .when((relation == "numerically_equivalent") & some(lambda a: numeric_key(a) == numeric_key(answer)), out("accept", "deterministic_numeric_expression"))
        .when((relation == "abbreviation_expansion") & some(lambda a: F.exists(texts, lambda t: in_parentheses(answer, a, t))), out("accept", "explicit_parenthetical_abbreviation_in_snippets"))
        .otherwise(out("verify", "requires_semantic_verification")))
