"""Audits of single rows: span pairs, aliases, generated variants, judged responses, score lines, completion masks.

All but the alias relation are column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .text import loose_key

WORDS = r"[A-Za-z0-9]+(?:[+./'-][A-Za-z0-9]+)*"
# Words at a boundary that change what an answer means.
RISK_WORDS = "acute activating all at chronic familial human mouse only oral partial primary received secondary treated type wild with without".split()


def compact(c: Column) -> Column:
    return F.regexp_replace(loose_key(c), " ", "")


def word_list(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({WORDS})")), F.lower)


def named(*checks: tuple[str, Column]) -> Column:
    """The names of the checks that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))


def span_audit(chosen: Column, rejected: Column, context: Column, gold: Column, direction: Column, delta: Column, key: Callable[[Column], Column] = compact) -> Column:
    """struct(failed, flags, disposition) of a pair of literal spans (STR20); gold is an array of aliases.

    failed names the formal checks that don't hold; flags name what a reviewer should look at; nulls are empty."""
    c, r, around = key(chosen), key(rejected), key(context)
    outer, inner = F.when(direction == "too_short", c).when(direction == "too_long", r), F.when(direction == "too_short", r).otherwise(c)
    nested = F.coalesce((c != "") & (r != "") & (c != r) & F.contains(outer, inner), F.lit(False))
    failed = named(
        ("chosen_in_source_context", ~F.contains(around, c)), ("rejected_in_source_context", ~F.contains(around, r)),
        ("strict_directional_span_relation", ~nested), ("rejected_does_not_match_any_gold_alias", F.coalesce(F.exists(gold, lambda g: key(g) == r), F.lit(False))))
    cw, rw, low_c, low_r = word_list(chosen), word_list(rejected), F.trim(F.lower(chosen)), F.trim(F.lower(rejected))
    longer = (F.when(F.endswith(low_r, low_c), word_list(F.substring(rejected, F.lit(1), F.length(rejected) - F.length(chosen))))
              .when(F.startswith(low_r, low_c), word_list(F.substring(rejected, F.length(chosen) + 1, F.length(rejected)))).otherwise(F.filter(rw, lambda w: ~F.array_contains(cw, w))))
    edge = F.when(direction == "too_long", longer).otherwise(F.array_except(cw, rw))
    flags = named(
        ("semantic_modifier_at_boundary", F.arrays_overlap(edge, F.array(*map(F.lit, RISK_WORDS)))),
        ("numeric_boundary", F.exists(edge, lambda w: w.rlike("^[0-9]+$"))),
        ("abbreviation_or_parenthetical_boundary", F.concat_ws(" ", chosen, rejected).rlike("[()]")),
        ("very_short_answer", F.least(F.size(cw), F.size(rw)) <= 2), ("multi_token_boundary_change", F.coalesce(delta, F.lit(0)) > 1))
    disposition = F.when(F.size(failed) > 0, "reject_formal").when(F.size(flags) > 0, "manual_review_high_risk").otherwise("manual_review_standard")
    return F.struct(failed.alias("failed"), flags.alias("flags"), disposition.alias("disposition"))


def _weak(text: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", text or "").casefold().split())


def _alias_relation(candidate: str, alias: str) -> tuple:
    """((rank, likeness), relation, direction) of a candidate beside one alias."""
    c, a = _weak(candidate), _weak(alias)
    cw, aw = c.split(), a.split()
    steps = ((c == a, 5, "same_weak_surface"), (bool(a) and a in c, 4, "gold_inside_candidate"), (bool(c) and c in a, 4, "candidate_inside_gold"),
             (not set(cw).isdisjoint(aw), 3, "shared_literal_tokens"), (True, 1, "zero_literal_token_overlap"))
    rank, relation = next((rank, name) for holds, rank, name in steps if holds)
    words, chars = (len(cw) > len(aw)) - (len(cw) < len(aw)), (len(c) > len(a)) - (len(c) < len(a))
    direction = {1: "candidate_longer", -1: "candidate_shorter"}.get(words or chars, "same_length")
    if not words and chars:
        direction += "_same_token_count"
    return (rank, SequenceMatcher(None, c, a).ratio()), relation, direction


@F.pandas_udf(StructType([StructField(c, StringType()) for c in ("alias", "relation", "direction")]))
def alias_relation(candidate: pd.Series, aliases: pd.Series) -> pd.DataFrame:
    """The alias closest to a candidate with how they contain each other (STR21); without aliases all is null.

    Compatibility forms and the matching-blocks ratio have no SQL function."""
    out = []
    for c, found in zip(candidate, aliases):
        best = max(((*_alias_relation(c, a), -i) for i, a in enumerate(() if found is None else found)), key=lambda x: (x[0], x[-1]), default=None)
        out.append((found[-best[-1]], best[1], best[2]) if best else (None, None, None))
    return pd.DataFrame(out, columns=["alias", "relation", "direction"])


# Patterns of words that a variant may not bring in.
NUMBER = r"(?<![A-Za-z])\d+(?:[.,]\d+)?"
INTRODUCED = {
    "introduced_numeric_approximation": r"(?i)(?:\b(?:about|approximately|approx\.?|around|roughly|nearly|circa)\b|[~≈])",
    "introduced_salt_form": r"(?i)\b(?:hydrochloride|hcl|hydrobromide|mesylate|maleate|fumarate|succinate|tartrate|acetate|phosphate|sodium|potassium|calcium|magnesium)\b",
    "introduced_species_qualifier": r"(?i)\b(?:human|murine|mouse|rat|bovine|porcine)\b",
    "introduced_scope_qualifier": r"(?i)\b(?:high[- ]risk|drug[- ]resistant|treatment[- ]resistant|medically refractory|refractory|intractable|relapsed|metastatic|advanced|late[- ]stage|early[- ]stage|pediatric|paediatric|adult)\b",
}
RANGE = r"(?i)(\d+(?:[.,]\d+)?)\s*(?:-|–|—|to)\s*(\d+(?:[.,]\d+)?)\s*(%|percent(?:age)?|years?|months?|weeks?|days?|hours?|mg|g|kg|µg|ug|ml|l|mm|cm|m)?(?=$|[\s,.;:)\]])"
ADMITTED = [
    r"\bslightly narrower\b",
    r"\bis (?:a |the )?narrower (?:answer|term|range|concept|form)\b",
    r"\bis broader than\b",
    r"\baccepted alias is (?:a |the )?broader term\b",
    r"\bcandidate is (?:a |the )?(?:subtype|subset)\b",
    r"\bmore specific\b",
    r"\bmore precise and correct answer\b",
    r"\baccepted alias .*?\bomits?\b",
]
RATIONALIZED = r"(?i)\b(?:does not|doesn't|not) (?:make (?:it|the candidate) )?(?:narrow|narrower|broaden|broader)|\bnot (?:a )?narrower or broader\b"
PRODRUG = r"(?i)\b(?:prodrug|pro-drug) (?:of|form of)\b"
LITTLE_WORDS = ["a", "an", "and", "of", "the", "to", "in", "for", "with"]


def _plain_words(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+)")), F.lower)


def ranges(c: Column) -> Column:
    """Number ranges with a unit, one string each: low-high-unit."""
    low, high, unit = (F.regexp_extract_all(c, F.lit(RANGE), F.lit(i)) for i in (1, 2, 3))
    unit = F.transform(unit, lambda u: F.regexp_replace(F.lower(u), "^percent(age)?$", "%"))
    numbers = F.zip_with(low, high, lambda a, b: F.concat(F.replace(a, F.lit(","), F.lit("")), F.lit("-"), F.replace(b, F.lit(","), F.lit("")), F.lit("-")))
    return F.filter(F.zip_with(numbers, unit, lambda a, b: F.concat(a, b)), lambda x: ~F.endswith(x, F.lit("-")))


def variant_reasons(answer: Column, aliases: Column, relation: Column, basis: Column, route: Column, validated: Column) -> Column:
    """Why a generated variant is not a safe second name of the answer, in order; empty where it is (FLT14).

    Variants proven by rule are only held to the first three; nulls are empty and not validated."""
    squeeze = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    text, basis, route, relation = squeeze(answer), squeeze(basis), squeeze(route), squeeze(relation)
    aliases = F.filter(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), squeeze), lambda a: a != "")
    brings = lambda name: text.rlike(INTRODUCED[name]) & ~F.exists(aliases, lambda a: a.rlike(INTRODUCED[name]))
    unit = lambda x: F.element_at(F.split(x, "-"), 3)
    mine, theirs = ranges(text), F.flatten(F.transform(aliases, ranges))
    changed = F.arrays_overlap(F.transform(mine, unit), F.transform(theirs, unit)) & ~F.arrays_overlap(mine, theirs)
    content = lambda c: F.array_except(_plain_words(c), F.array(*map(F.lit, LITTLE_WORDS)))
    wider = F.exists(aliases, lambda a: (F.size(content(a)) > 0) & (F.size(F.array_except(content(a), content(text))) == 0) & (F.size(content(text)) > F.size(content(a))))
    words, longest = F.size(_plain_words(text)), F.coalesce(F.array_max(F.transform(aliases, lambda a: F.size(_plain_words(a)))), F.lit(0))
    surfaces = F.replace(F.lower(F.concat_ws(" ", F.array(text), aliases)), F.lit("-"), F.lit(""))
    first = named(("input_not_validated", ~F.coalesce(validated, F.lit(False))), ("empty_answer", text == ""), ("duplicates_official_alias", F.exists(aliases, lambda a: F.lower(a) == F.lower(text))))
    short = relation == "abbreviation_expansion"
    more = named(
        ("introduced_numeric_approximation", brings("introduced_numeric_approximation") & text.rlike(NUMBER)), ("changed_numeric_range", changed),
        ("introduced_salt_form", (words >= 2) & brings("introduced_salt_form")), ("prodrug_active_moiety_change", basis.rlike(PRODRUG) & ~F.contains(surfaces, F.lit("prodrug"))),
        ("introduced_species_qualifier", ~short & brings("introduced_species_qualifier")), ("introduced_scope_qualifier", ~short & brings("introduced_scope_qualifier")),
        ("verifier_admits_scope_or_specificity_change", F.exists(F.array(*[F.lit(f"(?i){p}") for p in ADMITTED]), lambda p: F.regexp_like(basis, p))), ("verifier_rationalizes_added_scope", basis.rlike(RATIONALIZED) & wider),
        ("descriptive_expansion_not_concise_surface", ~short & (words >= 13) & (words > 2 * F.greatest(longest, F.lit(1)) + 4)))
    proven = F.startswith(route, F.lit("deterministic_")) | (route == "explicit_parenthetical_abbreviation_in_snippets")
    return F.when(proven, first).otherwise(F.concat(first, more))


def reliable(candidates: Column, snippets: Column, reviewer: Column, excluded: Column) -> Column:
    """Whether each judged candidate of a response has a sure and consistent decision with literal evidence (FLT15).

    candidates: array of struct(official_accepted, confidence, issues array, correctness, support, equivalence,
    relation_valid, evidence array of struct(snippet_id, quote)); snippets: map of id to text.  Null fields are unsure."""

    def quoted(e: Column) -> Column:
        return (F.length(F.trim(e["quote"])) >= 8) & F.contains(F.element_at(snippets, e["snippet_id"]), e["quote"])

    def sure(c: Column) -> Column:
        evidence = F.coalesce(c["evidence"], F.expr("cast(array() as array<struct<snippet_id:string,quote:string>>)"))
        known = (c["confidence"] == "high") & (F.size(F.coalesce(c["issues"], F.array().cast("array<string>"))) == 0) & c["official_accepted"].isNotNull()
        known &= c["correctness"].isin("correct", "incorrect") & c["support"].isin("supported", "unsupported", "contradicted")
        known &= c["equivalence"].isin("equivalent", "different") & c["relation_valid"].isin("valid", "invalid")
        agrees = ~(c["official_accepted"] & (c["correctness"] != "correct"))
        silent = F.size(evidence) == 0  # no support is shown by itself, and is no proof of an error
        shown = ~(silent & ((c["support"] == "supported") | ((c["correctness"] == "incorrect") & (c["support"] == "unsupported"))))
        return F.coalesce(known & agrees & shown & F.forall(evidence, lambda e: F.coalesce(quoted(e), F.lit(False))), F.lit(False))

    reviewed = (F.coalesce(reviewer, F.lit("")) != "") & (F.coalesce(excluded, F.lit("")) == "")
    return reviewed & F.coalesce(F.forall(candidates, sure), F.lit(False))


FLOAT = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"


def score_line(output: Column, n: int = 10) -> Column:
    """The last line of exactly n numbers in a program's output, else all its numbers if they are n, else null (MET10)."""
    lines = F.filter(F.transform(F.split(output, r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x.rlike(rf"^{FLOAT}(?: {FLOAT}){{{n - 1}}}$"))
    numbers = F.regexp_extract_all(output, F.lit(f"({FLOAT})"))
    found = F.when(F.size(lines) > 0, F.split(F.element_at(F.when(F.size(lines) > 0, lines), -1), " ")).when(F.size(numbers) == n, numbers)
    return found.cast("array<double>")


def completion_start(ids: Column, template: Column) -> Column:
    """Where the last run equal to template ends, in elements; null without one or for an empty template."""
    starts = F.filter(F.transform(ids, lambda x, i: F.when((x == template[0]) & (F.slice(ids, i + 1, F.size(template)) == template), i + F.size(template))), lambda e: e.isNotNull())
    return F.when(F.size(template) > 0, F.array_max(starts))


def completion_mask(ids: Column, template: Column, fallback: Column | None = None) -> Column:
    """0 up to the end of the template's last occurrence (else the fallback's) and 1 after it; all 1 without one (SFT13)."""
    start = completion_start(ids, template)
    start = F.coalesce(start, completion_start(ids, fallback)) if fallback is not None else start
    return F.transform(ids, lambda x, i: (i >= F.coalesce(start, F.lit(0))).cast("int"))
