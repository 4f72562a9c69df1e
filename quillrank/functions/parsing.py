"""Parsers of model answers, as column expressions: lists with diagnostics, factoid candidates, single answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, is_placeholder, tagged_items

_OUTER = " \t\r\n\"'`|"


def _times(c: Column, tag: str) -> Column:
    return F.size(F.split(c, rf"\[{tag}\]")) - 1


def parse_list(c: Column, fallback: bool = True) -> Column:
    """items, status (ok, malformed, fallback_split, empty) and warnings of a tagged list."""
    raw = clean_text(c)
    begin, end = _times(raw, "BI"), _times(raw, "EI")
    found = tagged_items(raw)
    empty = F.size(F.regexp_extract_all(raw, F.lit(r"\[BI\](.*?)\[EI\]"), F.lit(1))) > F.size(found)
    split = F.filter(F.transform(F.split(raw, ";"), clean_text), lambda x: x != "")
    tagged = (begin > 0) | (end > 0)
    source = F.when(tagged, found).otherwise(split if fallback else F.array().cast("array<string>"))
    items = F.filter(source, lambda x: ~is_placeholder(x))
    some = F.size(items) > 0
    status = F.when(raw == "", "empty").when(tagged & some & (begin == end), "ok").when(tagged | ~some, "malformed").otherwise("fallback_split")
    warn = F.array_compact(F.array(
        F.when(empty, "empty_items"), F.when(F.size(source) > F.size(items), "placeholder_items_dropped"),
        F.when((begin == 0) & (end > 0), "end_tag_without_begin_tag"), F.when(begin != end, "mismatched_tag_count"),
        F.when(begin > end, "truncated_final_item"), F.when(~tagged, "missing_tags"), F.when(~tagged & ~some, "no_items_found")))
    warn = F.when(raw == "", F.array().cast("array<string>")).when(tagged & ~some & (F.size(warn) == 0), F.array(F.lit("unparseable_tag_structure"))).otherwise(warn)
    return F.struct(F.when(raw == "", F.array().cast("array<string>")).otherwise(items).alias("items"), status.alias("status"), warn.alias("warnings"))


def clean_candidate(c: Column) -> Column:
    """A factoid candidate without tags, label, list marker (53BP1 and 1:2000 stay), outer quotes and final ;,:"""
    out = clean_text(F.regexp_replace(F.coalesce(c, F.lit("")), r"\[(?:BE|EE|BS|ES|BI|EI)\]", " "))
    out = F.regexp_replace(out, r"(?i)^(?:answer|answers|candidate|candidates)\s*:\s*", "")
    out = clean_text(F.regexp_replace(out, r"^\s*(?:\(?\d+\)?[.)]|[-*])\s+", ""))
    out = F.btrim(out, F.lit(_OUTER))
    return F.trim(F.regexp_replace(out, "[;,:]+$", ""))


def factoid_candidates(c: Column) -> Column:
    """Tagged items, else two or more numbered segments, else the whole; cleaned, distinct, in order."""
    raw = clean_text(c)
    tidy = lambda a: F.array_distinct(F.filter(F.transform(a, clean_candidate), lambda x: x != ""))
    tagged = tidy(tagged_items(raw, "E"))
    parts = F.split(F.regexp_replace(raw, r"(^|\s)(\d+[.)]|[-*])\s+", "\u0001"), "\u0001")
    numbered = F.when(F.size(parts) > 2, tidy(F.slice(parts, 2, F.size(parts))))
    return F.when(F.size(tagged) > 0, tagged).when(F.size(F.coalesce(numbered, F.array())) > 0, numbered).otherwise(tidy(F.array(raw)))


def single_answer(c: Column) -> Column:
    """The one tagged answer with nothing but an Answer: label outside, else null."""
    body = F.regexp_replace(c, r"(?i)^\s*Answer:\s*", "")
    found = F.regexp_extract_all(body, F.lit(r"(?s)\[BE\](.*?)\[EE\]"), F.lit(1))
    outside = clean_text(F.regexp_replace(body, r"(?s)\[BE\].*?\[EE\]", ""))
    return F.when((F.size(found) == 1) & (outside == "") & (clean_text(found[0]) != ""), clean_text(found[0]))


def recover_answer(c: Column) -> Column:
    """(answer, how): strict_tagged, single_answer_line or unrecoverable."""
    strict = single_answer(c)
    line = F.regexp_extract(F.btrim(c, F.lit(" \t\r\n")), r"(?is)^Answer:\s*(.*)$", 1)
    line = F.btrim(F.regexp_replace(F.regexp_replace(line, r"^\[BE\]\s*", ""), r"\s*\[EE\]$", ""), F.lit(" \t\r\n"))
    bad = (line == "") | line.rlike(r"[\n\r]|\[BE\]|\[EE\]|(?i:\bAnswer:)")
    answer = F.coalesce(strict, F.when(~bad, clean_text(line)))
    return F.struct(answer.alias("answer"), F.when(strict.isNotNull(), "strict_tagged").when(answer.isNotNull(), "single_answer_line").otherwise("unrecoverable").alias("how"))


def boundary_key(c: Column) -> Column:
    return F.regexp_replace(F.btrim(F.lower(clean_text(c)), F.lit(" \t\r\n.,;:")), r"^(?:a|an|the)\s+", "")


def match_type(intended: Column, extracted: Column) -> Column:
    exact = F.lower(clean_text(intended)) == F.lower(clean_text(extracted))
    return F.when(exact, "exact").when(boundary_key(intended) == boundary_key(extracted), "boundary_variant").otherwise("mismatch")


def contains_tokens(longer: Column, shorter: Column) -> Column:
    """The normalized shorter text stands in the longer one at token bounds; an empty one never does."""
    return (shorter != "") & F.contains(F.concat(F.lit(" "), longer, F.lit(" ")), F.concat(F.lit(" "), shorter, F.lit(" ")))


def supported(aliases: Column, snippets: Column) -> Column:
    """Aliases that stand whole in one snippet; both normalized."""
    return F.filter(aliases, lambda a: F.exists(snippets, lambda s: contains_tokens(s, a)))


def relevance(text: Column, question: Column, answer: Column) -> Column:
    """Share of the question's words in the text, and twice that of the answer's."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\w+"), F.lit(0)))
    share = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(b))
    return share(words(text), words(question)) + 2 * share(words(text), words(answer))


def draw_seed(question: Column, draw: Column, seed: int = 3407) -> Column:
    """The first four bytes of SHA-256 of seed:question:draw."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), question.cast("string"), draw.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hash_fold(c: Column, folds: int = 5) -> Column:
    return F.conv(F.substring(F.sha2(c.cast("string"), 256), 1, 8), 16, 10).cast("long") % folds
